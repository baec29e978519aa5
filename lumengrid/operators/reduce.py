"""Reductions with a user's own functions over long tables, and over prefixes of long series.

A `Reduction` folds arrays of values into a state and merges two states. Tasks fold the batches that they hold, and
only states travel: for a key, one from each task, merged in two steps, so that a key with most of the rows costs no
task more than its share and a state from each of the others. For prefixes a series is cut into chunks, which are
folded apart; a scan over the chunks' states then gives the state before each of them. The cost depends neither on
the number of prefixes asked for nor on how the rows are spread over series.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Positions of a series that are folded apart.
CHUNK = 10_000
#: Keys whose states a task holds before it hands them on.
KEYS = 100_000
#: Tasks whose states of a key are merged first.
FAN = 64


@dataclass(frozen=True)
class Reduction:
    """`update(state, *arrays)` folds values in, `merge(a, b)` joins two states, `finish(state)` gives the result.

    Merging must be associative, and for reductions by key commutative too, since tasks end in any order. For
    prefixes `a` is always what stands before `b`. Missing values are None where an array holds objects, else NaN.
    `finish` gives a value, or a tuple if the result has several columns.
    """

    start: Callable[[], Any]
    update: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any] = lambda state: state


def _merge_moments(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n, max(a[3], b[3]), a[4] if b[4] is None else b[4]


def _moments(v: np.ndarray) -> tuple:
    if not len(v):
        return 0, 0.0, 0.0, -math.inf, None
    return len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum()), float(v.max()), float(v[-1])


#: Number, mean, sample standard deviation, largest and (of a prefix) last value, in one pass without cancellation.
MOMENTS = Reduction(
    lambda: (0, 0.0, 0.0, -math.inf, None),
    lambda state, v: _merge_moments(state, _moments(v)),
    _merge_moments,
    lambda s: (s[0], s[1], math.sqrt(s[2] / (s[0] - 1)) if s[0] > 1 else None, s[3], s[4]),
)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each group, from batches in which a group's rows follow each other."""
    held: list[pa.RecordBatch] = []
    key: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for column in at:
            codes = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            change |= codes[1:] != codes[:-1]
        for a, b in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]):
            this = tuple(column[a].as_py() for column in at)
            if held and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _arrays(table, names: list[str]) -> list[np.ndarray]:
    out = []
    for n in names:
        column = table.column(n) if isinstance(table, pa.Table) else table.column(table.schema.get_field_index(n))
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        out.append(column.to_numpy(zero_copy_only=False))
    return out


def _result(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _finished(reduction: Reduction, state: Any, width: int) -> tuple:
    result = reduction.finish(state)
    return tuple(result) if width > 1 else (result,)


def reduce_by_key(rows: DataFrame, key: str, values: list[str], reduction: Reduction, returns: str) -> DataFrame:
    """The key and the results of a reduction over its rows; `returns` names them with their types. A null key is one."""
    result = T._parse_datatype_string(returns) if not isinstance(returns, T.StructType) else returns
    key_type = rows.schema[key].dataType
    states = T.StructType([T.StructField(key, key_type), T.StructField("__group", T.IntegerType()), T.StructField("__state", T.BinaryType())])
    out = T.StructType([T.StructField(key, key_type), *result])
    kinds = [to_arrow_type(key_type), pa.int32(), pa.binary()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = TaskContext.get().partitionId() // FAN, {}

        def handed_on() -> pa.RecordBatch:
            return _result(states.names, kinds, [(k, group, pickle.dumps(s)) for k, s in held.items()])

        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            names = [*codes.dictionary.to_pylist(), None]
            number = pc.fill_null(codes.indices, len(names) - 1).to_numpy(zero_copy_only=False)
            order = np.argsort(number, kind="stable")
            arrays = [a[order] for a in _arrays(batch, values)]
            ends = np.flatnonzero(np.diff(number[order])) + 1
            for a, b in pairwise([0, *ends.tolist(), batch.num_rows]) if batch.num_rows else ():
                k = names[number[order[a]]]
                held[k] = reduction.update(held[k] if k in held else reduction.start(), *[x[a:b] for x in arrays])
            if len(held) >= KEYS:
                yield handed_on()
                held.clear()
        yield handed_on()

    def merged(names: list[str], finish: bool) -> Callable:
        types = [to_arrow_type(f.dataType) for f in out] if finish else kinds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            key: tuple | None = None
            state = None
            for batch in batches:
                for *this, dumped in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    this = tuple(this[: len(names)])
                    if this != key:
                        if key is not None:
                            rows.append((*key, *_finished(reduction, state, len(result))) if finish else (*key, pickle.dumps(state)))
                        key, state = this, pickle.loads(dumped)
                    else:
                        state = reduction.merge(state, pickle.loads(dumped))
                    if len(rows) >= 1000:
                        yield _result(out.names if finish else states.names, types, rows)
                        rows = []
            if key is not None:
                rows.append((*key, *_finished(reduction, state, len(result))) if finish else (*key, pickle.dumps(state)))
            yield _result(out.names if finish else states.names, types, rows)

        return run

    parts = rows.select(key, *values).mapInArrow(fold, states)
    near = parts.repartition(key, "__group").sortWithinPartitions(key, "__group").mapInArrow(merged([key, "__group"], False), states)
    return near.repartition(key).sortWithinPartitions(key).mapInArrow(merged([key], True), out)


def reduce_prefixes(series: DataFrame, points: list[int], reduction: Reduction, returns: str) -> DataFrame:
    """(series_id, n, results) of a reduction over the first n values of each series, for each n of `points` that it has.

    `series` has series_id, pos (from 0, without gaps) and v. Two exchanges: rows by chunk, and states by series.
    """
    result = T._parse_datatype_string(returns)
    id_type = series.schema["series_id"].dataType
    points = sorted({n for n in points if n > 0})
    parts = T.StructType([T.StructField("series_id", id_type), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("state", T.BinaryType())])
    out = T.StructType([T.StructField("series_id", id_type), T.StructField("n", T.LongType()), *result])
    part_kinds, out_kinds = ([to_arrow_type(f.dataType) for f in s] for s in (parts, out))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk, its state (n NULL) and those of its beginnings that a point asks for."""
        for (series_id, chunk), rows in sorted_groups(batches, ["series_id", "chunk"]):
            (v,), first = _arrays(rows, ["v"]), chunk * CHUNK
            asked = points[bisect.bisect_right(points, first) : bisect.bisect_right(points, first + len(v))]
            state, at, found = reduction.start(), 0, []
            for n in asked:
                state, at = reduction.update(state, v[at : n - first]), n - first
                found.append((series_id, chunk, n, pickle.dumps(state)))
            found.append((series_id, chunk, None, pickle.dumps(reduction.update(state, v[at:]))))
            yield _result(parts.names, part_kinds, found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before = object(), None
        for batch in batches:
            rows = []
            for series_id, _, n, dumped in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                state = pickle.loads(dumped)
                if series_id != current:
                    current, before = series_id, None
                joined = state if before is None else reduction.merge(pickle.loads(before), state)
                if n is None:
                    before = pickle.dumps(joined)
                else:
                    rows.append((series_id, n, *_finished(reduction, joined, len(result))))
            yield _result(out.names, out_kinds, rows)

    chunks = series.select("series_id", F.floor(F.col("pos") / CHUNK).alias("chunk"), "pos", "v")
    states = chunks.repartition("series_id", "chunk").sortWithinPartitions("series_id", "chunk", "pos").mapInArrow(fold, parts)
    order = ["series_id", "chunk", F.col("n").asc_nulls_last()]
    return states.repartition("series_id").sortWithinPartitions(*order).mapInArrow(scan, out)
