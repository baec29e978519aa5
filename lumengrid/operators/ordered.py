"""Series: ordered values of a key, and running reductions over them.

No step gathers a whole series in one task: rows are numbered by ranges, and windows reach over chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.functions import arrays as A
from lumengrid.operators.reduce import sorted_groups
from lumengrid.operators.tiles import LONG_KERNEL
from lumengrid.plans.checkpoint import materialise


#: Positions of a series that one window holds at most.
CHUNK = 10_000


def series(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(series_id, pos, v), with positions from 0 in the given order.

    Rows are dealt by ranges of key and order, so that a long series lies in several ranges; they are numbered
    within a range and key, and what the ranges before hold of the key is added.
    """
    places = [f"__place{k}" for k in range(len(order))]
    rows = df.select(F.col(key).alias("series_id"), F.col(value).cast("double").alias("v"), *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)])
    rows = materialise(rows.repartitionByRange("series_id", *places).withColumn("__range", F.spark_partition_id()))
    sizes = rows.groupBy("series_id", "__range").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("series_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("series_id").alias("__id"), F.col("__range").alias("__at"), F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("series_id", "__range").orderBy(*places)) - 1
    rows = rows.withColumn("__inside", inside).join(sizes, F.col("series_id").eqNullSafe(F.col("__id")) & (F.col("__range") == F.col("__at")))
    return rows.select("series_id", (F.col("__ahead") + F.col("__inside")).cast("int").alias("pos"), "v")


def _chunks(rows: DataFrame, before: int, after: int) -> DataFrame:
    """Rows by chunks of CHUNK positions, each with the last `before` of the chunk before and the first `after` of the next."""
    own, place = F.floor(F.col("pos") / CHUNK), F.col("pos") % CHUNK
    to = F.array(own, F.when(place >= CHUNK - before, own + 1), F.when(place < after, own - 1))
    dealt = rows.withColumn("__chunk", F.explode(F.filter(to, lambda c: c >= 0)))
    return dealt.withColumn("__own", F.col("__chunk") == own)


def step_profile(rows: DataFrame) -> DataFrame:
    """(series_id, max_step, total_variation): differences of neighbours; both are 0 for equal values."""
    before = F.lag("v").over(Window.partitionBy("series_id", "__chunk").orderBy("pos"))
    step = _chunks(rows, 1, 0).select("series_id", "__own", F.abs(F.col("v") - before).alias("step")).where("__own")
    return step.groupBy("series_id").agg(F.max("step").alias("max_step"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_variation"))


def convolve_series(rows: DataFrame, weights: list[float]) -> DataFrame:
    """(series_id, pos, v): weighted sums with an odd kernel of any length, borders extended.

    Chunks of at least twice the kernel's reach get the rows around them, so that rows are sent twice at most, and
    are convolved in Arrow batches: directly for short kernels, for long ones by transforms of the chunk (the
    overlapping margins are thrown away), whose cost hardly depends on the kernel. A sum over a NULL is NULL.
    """
    half = len(weights) // 2
    size = max(CHUNK, 2 * half)
    kernel = np.array(weights)
    to = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - half) / size)), F.floor((F.col("pos") + half) / size))
    dealt = rows.select("series_id", "pos", "v", F.explode(to).alias("chunk"))
    dealt = dealt.repartition("series_id", "chunk").sortWithinPartitions("series_id", "chunk", "pos")
    schema = T.StructType([rows.schema[n] for n in ("series_id", "pos", "v")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, chunk), part in sorted_groups(batches, ["series_id", "chunk"]):
            part = part.combine_chunks()
            pos = part.column("pos").to_numpy()
            own = (pos >= chunk * size) & (pos < (chunk + 1) * size)
            if not own.any():
                continue
            v = part.column("v").to_numpy()
            first, last = pos[own][0], pos[own][-1]
            v = np.pad(v, (half - int(first - pos[0]), half - int(pos[-1] - last)), mode="edge")
            missing = np.pad(part.column("v").is_null().to_numpy(), (half - int(first - pos[0]), half - int(pos[-1] - last)), mode="edge")
            if len(kernel) > LONG_KERNEL and np.isfinite(v).all():
                n = 1 << (len(v) - 1).bit_length()
                found = np.fft.irfft(np.fft.rfft(v, n) * np.fft.rfft(kernel[::-1], n), n)[2 * half : len(v)]
            else:
                found = np.convolve(v, kernel[::-1], "valid")
            hidden = np.convolve(missing, np.ones(len(kernel)), "valid") > 0.5 if missing.any() else np.zeros(len(found), bool)
            kept = part.filter(pa.array(own))
            yield pa.RecordBatch.from_arrays([kept.column("series_id").combine_chunks(), kept.column("pos").combine_chunks(), pa.array(found, mask=hidden)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def blur_series(rows: DataFrame, sigma: float) -> DataFrame:
    """(series_id, pos, v) smoothed with a Gaussian of any width and extended borders."""
    return convolve_series(rows, A.gaussian_weights(sigma))


def log_spaced(start: int, end: int, n: int) -> list[int]:
    """n integers from start to end, evenly spaced in logarithm and strictly increasing."""
    if n > end - start + 1:
        raise ValueError("more points than integers")
    points: list[int] = []
    for i in range(n):
        ideal = round(start * (end / start) ** (i / max(1, n - 1)))
        points.append(max(ideal, points[-1] + 1 if points else start))
    for i in range(n - 1, -1, -1):  # keep room for those that follow
        points[i] = min(points[i], end - (n - 1 - i))
    return points


def prefix_profile(rows: DataFrame, points: list[int]) -> DataFrame:
    """(series_id, n, max, min, sum) over the first n elements, for each n of `points` that the series has.

    In two levels: sums of chunks, added up before each chunk, and running sums within those chunks that a point lies
    in. Any number of points costs the same, but for their rows in the result.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(n,) for n in sorted(set(points))], "n int").select("n", F.floor((F.col("n") - 1) / CHUNK).alias("chunk"))
    number = F.when(~F.isnan("v"), F.col("v"))
    rows = rows.select("series_id", "pos", "v", number.alias("x"), F.floor(F.col("pos") / CHUNK).alias("chunk"))
    sums = rows.groupBy("series_id", "chunk").agg(F.max("x").alias("max"), F.min("x").alias("min"), F.sum("v").alias("sum"))
    earlier = Window.partitionBy("series_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("series_id").alias("__id"), F.col("chunk").alias("__chunk"), *[f("%s" % n).over(earlier).alias(f"__{n}") for n, f in (("max", F.max), ("min", F.min), ("sum", F.sum))])
    inside = rows.join(asked.select("chunk").distinct(), "chunk", "left_semi")
    running = Window.partitionBy("series_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select("series_id", "chunk", (F.col("pos") + 1).alias("n"), F.max("x").over(running).alias("max"), F.min("x").over(running).alias("min"), F.sum("v").over(running).alias("sum"))
    found = inside.join(asked.select("n"), "n")
    found = found.join(before, F.col("series_id").eqNullSafe(F.col("__id")) & (F.col("chunk") == F.col("__chunk")))
    total = F.when(F.col("__sum").isNull(), F.col("sum")).when(F.col("sum").isNull(), F.col("__sum")).otherwise(F.col("__sum") + F.col("sum"))
    return found.select("series_id", F.col("n").cast("int").alias("n"), F.greatest("max", "__max").alias("max"), F.least("min", "__min").alias("min"), total.alias("sum"))
