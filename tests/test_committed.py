import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import Row

from lumengrid.sources import committed

REPO = Path(__file__).resolve().parents[1]
#: A task that fails the first time after some rows; Spark runs it again.
SCRIPT = """
import os, sys
from pyspark.sql import SparkSession
from lumengrid.sources import committed

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
folder = sys.argv[1]

def fragile(row):
    with open(f"{folder}/calls", "a") as f:
        f.write("x")
    if row.id == 70 and not os.path.exists(f"{folder}/failed"):
        open(f"{folder}/failed", "w").close()
        raise RuntimeError("lost")
    return {"id": row.id}

committed.sink_committed(spark.range(0, 100, 1, 4), committed.FolderReceiver(f"{folder}/out", fragile, rows=10))
"""


def test_a_task_that_runs_twice_delivers_once(spark, tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=os.environ | {"PYTHONPATH": str(REPO)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len((tmp_path / "calls").read_text()) == 121 and (tmp_path / "failed").exists()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(100))
    assert not os.path.exists(f"{tmp_path}/out-staged")


def test_nothing_counts_if_the_job_fails(spark, tmp_path):
    def broken(row):
        if row.id == 99:
            raise RuntimeError("lost")
        return {"id": row.id}

    with pytest.raises(Exception, match="lost"):
        committed.sink_committed(spark.range(0, 100, 1, 4), committed.FolderReceiver(f"{tmp_path}/out", broken, rows=5))
    assert not os.path.exists(f"{tmp_path}/out") and not os.path.exists(f"{tmp_path}/out-staged")


def test_rows_may_give_nothing_and_folders_grow(spark, tmp_path):
    even = committed.FolderReceiver(f"{tmp_path}/out", lambda row: {"id": row.id} if row.id % 2 == 0 else None)
    committed.sink_committed(spark.range(0, 10, 1, 10), even)
    committed.sink_committed(spark.range(10, 20), committed.FolderReceiver(f"{tmp_path}/out"))
    committed.sink_committed(spark.range(0), even)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6, 8, *range(10, 20)]
    with pytest.raises(NotImplementedError):
        committed.Receiver().receive(Row(id=1))
