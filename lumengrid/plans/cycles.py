"""Iterative jobs that write their state after each turn and can go on from the last complete one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumengrid.plans.checkpoint import shared_dir


class Run:
    """The folder of an iterative job: a table for each turn, and a manifest of each complete turn.

    A turn's rows that are finished (`over`) and those that go on lie in folders of their own. Once the next turn is
    complete, what went on is deleted, so that one state is kept besides the one being written. A run whose driver is
    lost goes on from its last manifest if it is opened by the same path; a turn without one is written anew.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/lumengrid-run-{uuid.uuid4().hex}").rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name) if name else self._root, True)

    def last(self) -> dict | None:
        """The manifest of the last complete turn."""
        if not self.exists("manifests"):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        turns = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        if not turns:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{turns[-1]:06d}.json", wholetext=True).first()[0])

    def commit(self, turn: int, **facts) -> dict:
        """Mark a turn as complete; the manifest gets its name only when it is whole."""
        facts = {"turn": turn, **facts}
        part, whole = self._at(f"manifests/{turn:06d}.part"), self._at(f"manifests/{turn:06d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        self._fs.rename(part, whole)
        return facts

    def write(self, name: str, df: DataFrame, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")

    def read(self, schema, *names: str) -> DataFrame:
        there = [f"{self.path}/{n}" for n in names if self.exists(n)]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)


def run_turns(run: Run, start: Callable[[], DataFrame], turn: Callable[[DataFrame, int], DataFrame], most: Callable[[DataFrame], int], keep: Callable[[DataFrame, int], tuple[str, DataFrame]] | None = None) -> DataFrame:
    """Finished rows after as many turns as any row needs.

    `start` gives the first state, `turn` a state's successor with a boolean `over`, and `most` a bound for the number
    of turns, from the first state. A row leaves the state when it is over. `keep` names a table to store after each turn.
    """
    done = run.last()
    if done is None:
        run.write("turn-000000/over=false", start())
        schema = run.spark.read.parquet(f"{run.path}/turn-000000/over=false").schema
        done = run.commit(0, most=most(run.read(schema, "turn-000000/over=false")), schema=schema.json())
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(json.loads(done["schema"]))
    folder = lambda k, over: f"turn-{k:06d}/over={str(over).lower()}"
    k = done["turn"]
    while k < done["most"] and run.exists(folder(k, False)):
        name, k = folder(k, False), k + 1
        run.write(f"turn-{k:06d}", turn(run.read(schema, name), k - 1), by="over")
        if keep:
            run.write(*keep(run.read(schema, folder(k, False), folder(k, True)), k - 1))
        run.commit(k, most=done["most"], schema=done["schema"])
        run.delete(name)
    return run.read(schema, *[folder(j, True) for j in range(1, k + 1)])
