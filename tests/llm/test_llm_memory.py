"""What Python workers keep when a stage is over; they stay beside the executor for the next one."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
#: Runs a stage of the pipeline in a session of its own, with one worker, and prints the MB of memory the worker has before and after.
SCRIPT = """
import re, sys, time
import psutil
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

spark = (
    SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.driver.memory", "3g").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
)

def held():
    time.sleep(1)
    most = 0
    for p in psutil.Process().children(recursive=True):
        if "pyspark.daemon" in " ".join(p.cmdline()):
            most = max(most, sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open(f"/proc/{p.pid}/smaps_rollup").read()))))
    return most // 1024

def same(batches):
    import siltstone.llm.ngram_join, siltstone.llm.decontamination
    yield from batches

spark.range(1).mapInArrow(same, "id long").count()
before = held()
docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
# one task of several MB of text
docs = docs.crossJoin(spark.range(4)).withColumn("doc_id", F.col("doc_id") * 4 + F.col("id")).drop("id").coalesce(1)
dict(corpus_pipeline.STAGES)[sys.argv[1]](spark, docs, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
print("HELD", before, held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
@pytest.mark.parametrize("stage", ["toxicity", "n-gram Jaccard join", "benchmark decontamination"])
def test_workers_give_memory_back(stage, tmp_path):
    env = os.environ | {"PYTHONPATH": f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable}
    said = subprocess.run([sys.executable, "-c", SCRIPT, stage, str(tmp_path)], env=env, capture_output=True, text=True, timeout=240)
    assert "HELD" in said.stdout, said.stderr[-2000:]
    before, after = map(int, said.stdout.split("HELD")[1].split())
    assert after <= before + 30
