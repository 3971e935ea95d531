"""The entry point without the corpus operators and outside this machine's Spark defaults; intermediate tables."""

import os
import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from kerbline import storage
from kerbline.operators import graph

ROOT = Path(__file__).resolve().parents[1]


def run(code, cwd, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=os.environ | {"PYTHONPATH": str(cwd)} | env, capture_output=True, text=True, timeout=300)


def test_entry_without_the_corpus_operators():
    copy = Path(tempfile.mkdtemp(prefix="kerbline-"))
    shutil.copytree(ROOT / "kerbline", copy / "kerbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) >= 78 and not any(n.startswith('op') for n in q if n[2:3].isdigit()); print(len(q), len(o))"
    done = run(code, copy)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[1]) > 60


def test_an_empty_configuration_gets_a_folder_that_goes_at_the_end():
    code = """
from pyspark.sql import SparkSession
from kerbline import storage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert storage.stored(spark.range(5)).count() == 5
print("FOLDER", storage.shared_dir(spark))
"""
    done = run(code, ROOT, SPARK_CONF_DIR=tempfile.mkdtemp())
    assert done.returncode == 0, done.stderr
    folder = Path(done.stdout.split("FOLDER ")[1].strip().removeprefix("file:"))
    assert not list(folder.rglob("*.parquet"))


def test_settled_tables_leave_only_their_result(spark):
    def tables():
        return {p.name for p in Path(storage.shared_dir(spark).removeprefix("file:")).rglob("*") if len(p.name) == 32 and p.is_dir()}

    before = tables()
    outer = storage.settled(lambda: storage.settled(lambda: storage.stored(spark.range(9)).filter("id > 2")).filter("id < 7"))
    assert len(tables() - before) == 1
    assert sorted(r.id for r in outer.collect()) == [3, 4, 5, 6]
    before = tables()
    parts = graph.connected_parts(spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert len(tables() - before) == 1
    assert {r.root for r in parts.collect()} == {0}
