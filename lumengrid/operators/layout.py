"""Frames in their two forms.

frames: image_id, height, width, values (one row per frame, row-major). Operators work on this form,
since a frame that is one row needs no shuffle. pixels: image_id, iy, ix, v (one row per cell).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frames_from_arrays(df: DataFrame, id_column: str, values: str, height: int, width: int) -> DataFrame:
    """Rows of arrays as frames of one shape; arrays of another length are left out."""
    v = F.col(values).cast("array<double>")
    return df.where(F.size(values) == height * width).select(F.col(id_column).alias("image_id"), F.lit(height).alias("height"), F.lit(width).alias("width"), v.alias("values"))


def unpack(frames: DataFrame, *values: str) -> DataFrame:
    """Pixels of the array columns named (default: values, as v)."""
    arrays = [F.col(v).alias("v" if v == "values" else v) for v in (values or ("values",))]
    cells = frames.select("image_id", "width", F.posexplode(F.arrays_zip(*arrays)).alias("pos", "cell"))
    names = ["v" if v == "values" else v for v in (values or ("values",))]
    return cells.select("image_id", F.floor(F.col("pos") / F.col("width")).cast("int").alias("iy"), (F.col("pos") % F.col("width")).alias("ix"), *[F.col("cell")[n].alias(n) for n in names])


def pack(pixels: DataFrame) -> DataFrame:
    """Frames from pixels; cells that are missing are NULL, and the shape is that of the largest indices."""
    shape = pixels.groupBy("image_id").agg((F.max("iy") + 1).alias("height"), (F.max("ix") + 1).alias("width"), F.map_from_entries(F.collect_list(F.struct(F.struct("iy", "ix"), "v"))).alias("cells"))
    at = lambda p: F.element_at("cells", F.struct(F.floor(p / F.col("width")).cast("int").alias("iy"), (p % F.col("width")).alias("ix")))
    return shape.select("image_id", "height", "width", F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), at).alias("values"))


def pairs(frames: DataFrame, step: int = 1) -> DataFrame:
    """Each frame with the one whose id is larger by `step`: image_id, height, width, a and b. One shuffle of whole frames."""
    other = frames.select((F.col("image_id") - step).alias("image_id"), F.col("height").alias("__h"), F.col("width").alias("__w"), F.col("values").alias("b"))
    both = frames.withColumnRenamed("values", "a").join(other, "image_id")
    return both.where("height = __h and width = __w").drop("__h", "__w")
