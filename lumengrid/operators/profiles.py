"""Value profiles of sets of frames that can be stored and merged without reading the frames again.

A profile has the number of values, their sum, least and largest, and two sketches: of the distinct values
(HyperLogLog, relative standard error about 1.04 / sqrt(2^size)) and of their order (KLL, rank error about 2.3 / k^0.9).
NaN and missing values are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of the distinct-value sketch, and k of the quantile sketch.
REGISTERS, K = 12, 400


def profile(frames: DataFrame, *keys: str, values: str = "values") -> DataFrame:
    """One profile for each set of frames: the keys, n, sum, min, max, distinct_sketch, order_sketch."""
    cells = frames.select(*keys, F.explode(values).alias("__v")).where("__v is not null and not isnan(__v)")
    # Both zeros are one value.
    text = F.when(F.col("__v") == 0, F.lit("0")).otherwise(F.col("__v").cast("string"))
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("__v").alias("sum"), F.min("__v").alias("min"), F.max("__v").alias("max"),
        F.hll_sketch_agg(text, F.lit(REGISTERS)).alias("distinct_sketch"), F.kll_sketch_agg_double("__v", F.lit(K)).alias("order_sketch"),
    )


def merge(profiles: DataFrame, *keys: str) -> DataFrame:
    """Profiles of the unions of sets with equal keys (of all sets, without keys)."""
    return profiles.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("order_sketch", F.lit(K)).alias("order_sketch"),
    )


def estimates(profiles: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What profiles say: n, sum, mean, min, max exactly, n_distinct and quantiles within the sketches' errors."""
    others = [c for c in profiles.columns if c not in ("distinct_sketch", "order_sketch")]
    found = F.kll_sketch_get_quantile_double("order_sketch", F.array(*map(F.lit, quantiles)))
    return profiles.select(*others, F.try_divide("sum", "n").alias("mean"), F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), found.alias("quantiles"))
