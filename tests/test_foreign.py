"""A database that belongs to one process, where tasks run in others; odd values; tables without rows or keys."""

import datetime as dt
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pyspark
import pytest

from keystrata.functions.types import EngineError
from keystrata.queries import QUERIES, SQL
from keystrata.sources import foreign

from .conftest import ROOT, SF, same_rows

RUN = """
import sys
from pyspark.sql import SparkSession
from keystrata.queries import QUERIES
top, tables = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1", "spark.checkpoint.dir": f"file://{top}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
QUERIES["foreign_roundtrip"](spark, tables).write.parquet(f"{top}/out")
spark.stop()
"""


@pytest.fixture()
def apart(monkeypatch):
    """As on a cluster, though one process does all here."""
    monkeypatch.setattr(foreign, "_apart", lambda *_: True)


def test_round_trip_on_a_cluster(spark, duck, tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # the executors' logs go there
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    got = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    same_rows(spark.read.parquet(str(tmp_path / "out")), duck, SQL["foreign_roundtrip"])


@pytest.mark.parametrize("rows", ["SELECT * FROM p WHERE false", "SELECT NULL::BIGINT AS p_partkey, p_name, p_size FROM p", "SELECT p_partkey - 90 AS p_partkey, nullif(p_name, 'x') AS p_name, nullif(p_size, 30) AS p_size FROM p UNION ALL SELECT 7, '', 26 UNION ALL SELECT NULL, NULL, 27 UNION ALL SELECT 7, '', 26"])
@pytest.mark.parametrize("cluster", [False, True])
def test_round_trip_of_odd_tables(spark, tmp_path, monkeypatch, rows, cluster):
    """No rows, no keys at all, negative, repeated and missing keys."""
    if cluster:
        monkeypatch.setattr(foreign, "_apart", lambda *_: True)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW p AS SELECT p_partkey, p_name, p_size FROM '{SF}/part.parquet'")
    c.sql(f"COPY ({rows}) TO '{tmp_path}/part.parquet'")
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    same_rows(QUERIES["foreign_roundtrip"](spark, str(tmp_path)), c, SQL["foreign_roundtrip"])


def test_values_through_an_import(spark, tmp_path, apart):
    url = f"derby://{tmp_path}/db"
    texts = [None, "", " ", "a,b", 'q"x', '""', '"', "l\nm", "r\r\ns", "\r", "\n", "  pad  ", "é漢😀", "NULL", "\\", '\\"', "x" * 300_000]
    made = [(i, x, Decimal("1E-8") * i, dt.date(1999, 12, 31), dt.datetime(2024, 3, 10, 6, 30, 0, i), i % 2 == 0, 1e10 * i, bytes([i, 0, 255]) if i % 3 else None) for i, x in enumerate(texts)]
    df = spark.createDataFrame(made, "k long, T string, d decimal(20,8), y date, m timestamp, b boolean, f double, `x y` binary")
    foreign.write(df, url, "odd")
    got = foreign.read(spark, url, "odd", split=("k", 0, len(made), 3))
    assert got.rdd.getNumPartitions() == 3 and sorted(got.collect()) == sorted(df.collect())
    assert "EqualTo(k,3)" in got.where("k = 3")._jdf.queryExecution().executedPlan().toString()


def test_modes_of_an_import(spark, tmp_path, apart):
    url, one = f"derby://{tmp_path}/db", spark.createDataFrame([(None,), ("",), ("z",)], "v string")
    foreign.write(one, url, '"Of one"')
    before = foreign.read(spark, url, '"Of one"')
    foreign.write(one.selectExpr("v AS V"), url, '"Of one"')
    assert foreign.read(spark, url, '"Of one"').count() == 6 and sorted(before.collect(), key=str) == sorted(one.collect(), key=str)
    foreign.write(one, url, '"Of one"', "ignore")
    assert foreign.read(spark, url, '"Of one"').count() == 6
    with pytest.raises(Exception, match="already exists"):
        foreign.write(one, url, '"Of one"', "error")
    foreign.write(one.limit(1), url, '"Of one"', "overwrite")
    assert foreign.read(spark, url, query='SELECT count(*) AS n FROM "Of one"').first()[0] == 1


def test_import_needs_a_mounted_folder(spark, tmp_path, apart, monkeypatch):
    monkeypatch.setattr("keystrata.sources.scratch.scratch", lambda *_: "hdfs://far/shared")
    with pytest.raises(EngineError, match="mounted"):
        foreign.write(spark.range(1), f"derby://{tmp_path}/db", "t")
