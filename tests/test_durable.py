import os
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lociweave import durable

JOB = """
import sys
from pyspark.sql import SparkSession
from lociweave.durable import cut, discard
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
a, b = cut(spark.range(5)), cut(spark.range(7))
discard(a)
assert b.count() == 7
print("OK")
"""


def test_shared_folder_ends_empty(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, PYTHONPATH=root)
    run = subprocess.run([sys.executable, "-c", JOB, str(tmp_path / "shared")], env=env, capture_output=True, text=True, timeout=300)
    assert "OK" in run.stdout, run.stderr[-2000:]
    # Spark makes an empty folder of its own there; nothing else is left
    assert not [x for _, dirs, files in os.walk(tmp_path / "shared") for x in (*dirs, *files) if x.startswith("lociweave") or x in files]


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(applicationId="none", master="spark://x", getCheckpointDir=lambda: None)
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: default))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        durable.folder(spark)


def test_cut_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {name for i in range(every.size()) if (name := every.apply(i).getName()).startswith("shuffle_")}

    before = files()
    df = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    assert len(durable.cut(df).collect()) == 10
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
