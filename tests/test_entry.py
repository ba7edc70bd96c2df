import os
import shutil
import subprocess
import sys

from .conftest import ROOT

RUN = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert "point_read" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not [n for n in e.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() == 1
print("whole")
"""


def test_without_the_corpus_operators(tmp_path):
    """The folders of the corpus operators are gone, the pipeline's file is still there; and without that file too."""
    top = tmp_path / "copy"
    shutil.copytree(ROOT, top, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or n == "llm"])
    env = os.environ | {"PYTHONPATH": str(top)}
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (top / name).unlink(missing_ok=True)
        got = subprocess.run([sys.executable, "-c", RUN], cwd=top, env=env, capture_output=True, text=True, timeout=300)
        assert got.stdout.strip().endswith("whole"), got.stderr[-2000:]


def test_other_import_errors_are_not_hidden(tmp_path):
    import __spark_entry__ as e

    (tmp_path / "broken_module.py").write_text("import not_there_at_all")
    sys.path.insert(0, str(tmp_path))
    try:
        try:
            e._optional("broken_module")
        except ModuleNotFoundError as x:
            assert x.name == "not_there_at_all"
        else:
            raise AssertionError("hidden")
    finally:
        sys.path.remove(str(tmp_path))
    assert e._optional("no_such_module_here") is None
