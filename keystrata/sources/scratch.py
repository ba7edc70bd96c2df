"""Fresh folders for queries that write: below the cluster's shared checkpoint folder, or a temporary one in local mode."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="keystrata-")
        root = _own[app]
    return f"{root.rstrip('/')}/keystrata/{label}-{uuid.uuid4().hex}"
