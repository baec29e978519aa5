"""Retrieval of frames that keep arriving, with each frame's state in the state store.

A trigger takes in new frames and advances every frame in flight by some cycles; finished ones leave as rows. So a
frame that needs many cycles doesn't hold up those that came with it or after it. A frame is in flight for
ceil(n_cycles / cycles_a_trigger) triggers at most, which bounds the frames in flight by that many triggers' input
(`files`). State survives a lost executor or driver with the query's checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from lumengrid.operators import retrieve

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARAMS = ", ".join(f"{n} {'int' if isinstance(d, int) else 'double'}" for n, d in retrieve.DEFAULTS.items())
STATE = f"height int, width int, {_PARAMS}, cycles int, mag array<double>, g_re array<double>, g_im array<double>"
_object = Row("image_id", "height", "width", "values", "cycles", "error", "converged")
OBJECTS = "height int, width int, values array<double>, cycles int, error double, converged boolean"


class Retrieval(StatefulProcessor):
    """The state of one frame: parameters, cycles so far, magnitude and guess."""

    def __init__(self, cycles: int):
        self.cycles = cycles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frame = handle.getValueState("frame", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A new frame; one that comes again while it is in flight starts anew, the last of several in a trigger counts."""
        row = list(rows)[-1]
        whole = row.height and row.width and row["values"] is not None and len(row["values"]) == row.height * row.width and None not in row["values"]
        if not whole:
            self.frame.clear()
            yield _object(key[0], row.height, row.width, None, 0, None, False)
            return
        params = [row[n] for n in retrieve.DEFAULTS]
        yield from self._advance(key, (row.height, row.width, *params, 0, list(row["values"]), None, None), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.frame.exists():
            yield from self._advance(key, self.frame.get(), timerValues)

    def _advance(self, key, state: tuple, timerValues) -> Iterator[Row]:
        height, width, *params, cycles, mag, g_re, g_im = state
        of = {n: np.array([v]) for n, v in zip(retrieve.DEFAULTS, params, strict=True)}
        frame = lambda x: np.array(x, float).reshape(1, height, width)
        found = retrieve.shrink_cycles(of, frame(mag), frame(g_re) + 1j * frame(g_im) if cycles else None, cycles, self.cycles)
        if found["over"][0]:
            self.frame.clear()
            error = found["error"][0]
            yield _object(key[0], height, width, found["new"][0].real.ravel().tolist(), int(found["cycles"][0]), None if np.isnan(error) else float(error), bool(found["converged"][0]))
        else:
            g = found["g"][0].ravel()
            self.frame.update((height, width, *params, cycles + self.cycles, list(mag), g.real.tolist(), g.imag.tolist()))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)

    def close(self) -> None:
        pass


def retrieved(frames: DataFrame, params: DataFrame | None = None, cycles_a_trigger: int = 5) -> DataFrame:
    """Finished objects of a stream of frames (image_id, height, width, values), as they get ready."""
    known = retrieve.resolve_params(frames, params).select("image_id", "height", "width", "values", *retrieve.DEFAULTS)
    schema = StructType.fromDDL(f"image_id {frames.schema['image_id'].dataType.simpleString()}, {OBJECTS}")
    return known.groupBy("image_id").transformWithState(statefulProcessor=Retrieval(cycles_a_trigger), outputStructType=schema, outputMode="append", timeMode="processingTime")


def run_stream_keyed(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, params: DataFrame | None = None, files: int = 8, cycles_a_trigger: int = 5) -> StreamingQuery:
    """Retrieve new Parquet frames of `source` into Parquet files of `target`; at most `files` files a trigger are taken in."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # this operator's only store; a query keeps the setting that it is started with
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        return retrieved(stream, params, cycles_a_trigger).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def drain(query: StreamingQuery, timeout: float = 600) -> bool:
    """Wait until all files there were have been taken in and no frame is in flight, then stop; False if it took too long."""
    began = time.time()
    while time.time() - began < timeout:
        if failed := query.exception():
            raise failed
        last = query.lastProgress
        if last and last["numInputRows"] == 0 and not any(s["numRowsTotal"] for s in last["stateOperators"]) and not query.status["isDataAvailable"]:
            query.stop()
            return True
        time.sleep(0.2)
    query.stop()
    return False
