"""Separable Gaussian smoothing of packed frames; borders are extended or periodic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions import arrays as A


def _weights(sigma: float | Column) -> Column:
    return A.gaussian_kernel(sigma) if isinstance(sigma, Column) else F.array(*[F.lit(w) for w in A.gaussian_weights(sigma)])


def blur(frames: DataFrame, sigma: float | Column, axes: str = "both", periodic: bool = False, values: str = "values") -> DataFrame:
    """Smooth rows, cols or both, with one sigma or a sigma of each frame (a column)."""
    frames = frames.withColumn("__w", _weights(sigma))
    h, w, k = F.col("height"), F.col("width"), F.col("__w")
    if axes in ("rows", "both"):
        frames = frames.withColumn(values, A.convolve_rows(F.col(values), h, w, k, periodic))
    if axes in ("cols", "both"):
        frames = frames.withColumn(values, A.convolve_cols(F.col(values), h, w, k, periodic))
    return frames.drop("__w")


def smoothing_invariants(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, min_ok, max_ok, step_ok): smoothing lowers no minimum, raises no maximum and no largest step within a row."""

    def profile(df: DataFrame, name: str) -> DataFrame:
        inner = F.filter(F.transform("values", lambda v, p: F.when(p % F.col("width") > 0, F.abs(v - F.get("values", p - 1)))), lambda x: x.isNotNull())
        return df.select("image_id", A.vector_min(F.col("values")).alias(f"lo_{name}"), A.vector_max(F.col("values")).alias(f"hi_{name}"), F.coalesce(F.array_max(inner), F.lit(0.0)).alias(f"step_{name}"))

    both = profile(before, "a").join(profile(after, "b"), "image_id")
    slack = 1e-12
    return both.select("image_id", (F.col("lo_b") >= F.col("lo_a") - slack).alias("min_ok"), (F.col("hi_b") <= F.col("hi_a") + slack).alias("max_ok"), (F.col("step_b") <= F.col("step_a") + slack).alias("step_ok"))
