"""Helpers shared by the corpus operators: tables, shared-folder materialisation and Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.plans.checkpoint import discard, materialise, shared_dir

__all__ = ["BROADCAST_ROWS", "WORD", "crc_fold", "discard", "fresh", "join_checked", "join_split", "map_text", "materialise", "shared_dir", "small_batches", "table"]

#: Java and Python pattern of one word: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast; larger tables are joined by shuffling.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a materialised `right`: broadcast only if its counted rows are within BROADCAST_ROWS, else by shuffle."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the table has it."""
    while name in df.columns:
        name += "_"
    return name


def join_split(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join materialised tables where a few keys may hold most rows of `left`; keys of `right` are unique.

    Fewer than BROADCAST_ROWS keys can hold more than one in BROADCAST_ROWS of the rows each: what `right` has for
    those is broadcast, and only the other keys are dealt by shuffling.
    """
    total = left.count()
    heavy = materialise(left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") * BROADCAST_ROWS > total).select(*on, F.lit(True).alias("__heavy")))
    marked = left.join(F.broadcast(heavy), on, "left")
    known = right.join(F.broadcast(heavy.select(*on)), on, "left_semi")
    of_heavy = marked.where("__heavy").drop("__heavy").join(F.broadcast(known), on, how)
    of_others = marked.where("__heavy is null").drop("__heavy").join(right, on, how)
    return of_heavy.unionByName(of_others)


def crc_fold(id_column: str) -> F.Column:
    """crc32 of the id's text, modulo 4; fold 2 is held out."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches small for this session: whole texts can be long, and a batch is held several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def map_text(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list], list]],
    outputs: list[tuple[str, T.DataType]],
    carry: list[str],
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """Apply a Python function over whole texts, in Arrow slices of bounded size.

    `make` runs once in each task and returns a function from a list of texts (None for null) to one
    list or Arrow array for each output. Columns named in `carry` pass through; one that has an
    output's name is replaced by that output.
    """
    small_batches(df.sparkSession)
    names = {n for n, _ in outputs}
    carry = [c for c in carry if c not in names]
    schema = T.StructType([f for f in df.select(*carry).schema] + [T.StructField(n, t, True) for n, t in outputs])
    kinds = [_arrow_type(t) for _, t in outputs]
    sent = [F.col(f"`{c}`") for c in carry]
    place = carry.index(text) if text in carry else len(carry)
    if place == len(carry):
        sent.append(F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            rows = batch.num_rows
            step = max(1, min(rows, int(rows * slice_bytes / max(1, batch.nbytes))))
            for at in range(0, rows, step):
                part = batch.slice(at, step)
                results = fn(part.column(place).to_pylist())
                arrays = [r if isinstance(r, pa.Array) else pa.array(r, k) for r, k in zip(results, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[: len(carry)] + arrays, names=schema.names)

    return df.select(*sent).mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]
