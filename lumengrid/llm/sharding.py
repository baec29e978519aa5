"""Shards of near equal bytes by a histogram sort.

Rows are put in one global order, by a digest of their text, then by id, and the order is cut where the bytes
below are nearest to each multiple of total / shards. The cuts are found by counting: a round counts the exact
bytes and rows below a few thousand candidate keys in all partitions, keeps for each cut the bucket that its
target falls in, narrowed to the least and largest key seen there, and probes that bucket more finely, until a
cut is within tolerance or its bucket holds a single row. A key that many rows share (copies of a text, or rows
that repeat text and id) is cut inside like any other stretch, since the key ends with a row number. Only counts
reach the driver, as many as there are probes. Then rows are exchanged once, by the pieces between cuts, and
numbered.

Rows: a null text has no bytes and counts as empty; texts may be of any length; rows that repeat text and id
are told apart by an arbitrary number, so that a rerun may swap them with each other, which changes no result;
a null id comes first among equal texts; an empty table gives an empty result. A carried column that has a
result's name is left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.llm.common import materialise

#: Bytes of a key: 8 of the text's digest, 8 of the id, 8 of a row number.
WIDTH = 24
RESULTS = ("id", "size", "text_crc32", "shard", "slot")
#: Candidate keys for each cut that a round still looks for.
PROBES = 64


@dataclass
class Cut:
    """A place in the global order: keys from `key` on are to its right."""

    target: int
    slack: int
    low: int
    high: int
    key: int | None = None
    size: int = 0
    rows: int = 0


def keyed(df: DataFrame, text: str = "text", id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, id, size, text_crc32) and what is carried: 24 bytes that order rows, and the bytes of the text plus 1."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = isinstance(df.schema[id].dataType, T.IntegralType)
    number = F.col(f"`{id}`").cast("long") if whole else F.xxhash64(F.col(f"`{id}`"))
    ordered = F.coalesce(number, F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    key = F.unhex(F.concat(F.substring(F.md5(body), 1, 16), digits(ordered), digits(F.monotonically_increasing_id())))
    kept = [F.col(f"`{c}`") for c in carry if c not in (*RESULTS, "key")]
    return df.select(key.alias("key"), F.col(f"`{id}`").alias("id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *kept)


def _keys(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(WIDTH))
    return np.frombuffer(fixed.buffers()[1], f"S{WIDTH}", len(fixed), fixed.offset * WIDTH)


def _as_bytes(keys: list[int]) -> np.ndarray:
    return np.array([min(k, (1 << 8 * WIDTH) - 1).to_bytes(WIDTH, "big") for k in keys], f"S{WIDTH}")


def _counts(rows: DataFrame, probes: list[int]) -> list:
    """For each bucket between probes that has rows: its number, bytes, rows, and least and largest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, n = _as_bytes(probes), len(probes) + 1
        size, count, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), {}, {}
        for batch in batches:
            keys = _keys(batch.column(0))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            buckets = np.searchsorted(edges, keys, "right")
            found, first, number = np.unique(buckets, return_index=True, return_counts=True)
            size[found] += np.add.reduceat(batch.column(1).to_numpy()[order], first) if len(found) else 0
            count[found] += number
            for b, at, k in zip(found.tolist(), first.tolist(), number.tolist(), strict=True):
                lowest, highest = bytes(keys[at]), bytes(keys[at + k - 1])
                low[b], high[b] = min(low.get(b, lowest), lowest), max(high.get(b, highest), highest)
        there = np.flatnonzero(count)
        ends = [pa.array([x[b].ljust(WIDTH, b"\0") for b in there.tolist()], pa.binary()) for x in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(size[there]), pa.array(count[there]), *ends], names=["bucket", "size", "rows", "low", "high"])

    parts = rows.select("key", "size").mapInArrow(run, "bucket int, size long, rows long, low binary, high binary")
    sums = parts.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    return sorted(sums.collect(), key=lambda r: r.bucket)


def cuts(rows: DataFrame, shards: int, pieces: int = 16, tolerance: float = 0.0, probes: int = PROBES) -> list[Cut]:
    """Cuts of materialised (key, size) rows into shards * pieces stretches; every `pieces`-th one ends a shard.

    A cut between shards is accepted when its bytes are within `tolerance` of a shard's share, or as near as whole
    rows allow; cuts within a shard only serve the exchange and may be off by a quarter of a piece. Targets are
    counted in units of 1 / (shards * pieces) bytes, which keeps them whole numbers.
    """
    parts = shards * pieces
    ends = rows.agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    if ends.low is None:
        return []
    low, high = int.from_bytes(ends.low, "big"), int.from_bytes(ends.high, "big") + 1
    found = [Cut(k * ends["size"], int(tolerance * ends["size"] * pieces) if k % pieces == 0 else ends["size"] // 4, low, high) for k in range(1, parts)]
    while waiting := [c for c in found if c.key is None]:
        edges: set[int] = set()
        for lo, hi in {(c.low, c.high) for c in waiting}:
            n = probes * sum((c.low, c.high) == (lo, hi) for c in waiting)
            edges |= {lo + (hi - lo) * k // (n + 1) for k in range(n + 2)}
        buckets = _counts(rows, sorted(edges))
        before, starts, above = 0, [], []
        for b in buckets:
            starts.append((before * parts, above[-1] if above else 0))
            before += b["size"]
            above.append((above[-1] if above else 0) + b.rows)
        for c in waiting:
            at = bisect.bisect_right(starts, (c.target, 1 << 63)) - 1
            b, (under, rows_under) = buckets[at], starts[at]
            lo, hi = int.from_bytes(b.low, "big"), int.from_bytes(b.high, "big") + 1
            over = under + b["size"] * parts
            left = c.target - under <= over - c.target
            near = min(c.target - under, over - c.target)
            if hi - lo == 1 or near <= c.slack:
                c.key, c.size, c.rows = (lo, under // parts, rows_under) if left else (hi, over // parts, rows_under + b.rows)
            else:
                c.low, c.high = lo, hi
    return found


def assign(df: DataFrame, shards: int = 8, text: str = "text", id: str = "doc_id", carry: tuple[str, ...] = (), pieces: int = 16, tolerance: float = 0.0) -> DataFrame:
    """(id, size, text_crc32, shard, slot) and what is carried, for every row.

    Equal texts stand together in a shard unless a cut falls among them. `slot` numbers a shard's rows from 0 in
    the global order.
    """
    rows = materialise(keyed(df, text, id, carry))
    found = cuts(rows, shards, pieces, tolerance)
    edges, below = [c.key for c in found], [0, *(c.rows for c in found)]
    schema = T.StructType([*rows.schema, T.StructField("__piece", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("__ahead", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows_below = _as_bytes(edges), np.array(below, np.int64)
        for batch in batches:
            piece = np.searchsorted(keys, _keys(batch.column(0)), "right").astype(np.int32) if edges else np.zeros(batch.num_rows, np.int32)
            shard = piece // pieces
            ahead = rows_below[piece] - rows_below[shard * pieces]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece), pa.array(shard.astype(np.int32)), pa.array(ahead)], names=schema.names)

    inside = F.row_number().over(Window.partitionBy("__piece").orderBy("key")) - 1
    placed = rows.mapInArrow(place, schema).withColumn("slot", F.col("__ahead") + inside)
    return placed.select(*RESULTS, *[c for c in rows.columns if c not in (*RESULTS, "key")])


def write(assigned: DataFrame, path: str) -> None:
    """Store assigned rows as Parquet, one folder for each shard; files hold stretches of the shard's order."""
    assigned.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
