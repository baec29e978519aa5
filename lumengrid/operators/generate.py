"""Generators of frames, one for each row of a table that gives their shape and parameters.

A table needs image_id, height and width; parameters are numbers or columns of it. Rotations are in
radians. Each frame is made within its row, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.functions import arrays as A

#: Steps from each disc of the cluster to the next, in disc diameters, and the first centre in shares of
#: the frame (fixed values).
FIRST_DISC = (0.45, 0.61)
DISC_STEPS = [
    (0.10, 0.90), (1.00, -0.10), (0.70, -0.70), (0.70, -0.70), (0.94, 0.15), (-0.70, 0.70), (-0.70, 0.70), (0.94, 0.14), (0.75, -0.70), (0.00, 1.00),
    (-1.80, 0.50), (-0.70, 0.70), (0.10, 0.95), (0.70, -0.70), (0.10, 0.95), (-0.25, 0.90), (0.90, 0.14), (0.20, -0.90), (0.60, -0.70),
    (-6.00, -25.0), (-0.10, 0.90), (-0.70, 0.95), (0.40, 0.80), (0.25, 0.90), (0.25, 0.90), (0.25, 0.90), (-0.60, 0.90), (-0.25, -0.90), (-0.25, -0.90), (-0.25, -0.90), (-0.25, -1.10),
    (0.20, 3.50), (-0.05, 1.00), (-0.15, 0.90),
]
RADIUS = 1.6

Number = float | Column


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _cells(table: DataFrame, value) -> DataFrame:
    """Frames whose cell at (x, y) is value(x, y), a column of the row."""
    w = F.col("width")
    cells = F.transform(F.sequence(F.lit(0), F.col("height") * w - 1), lambda p: value((p % w).cast("double"), F.floor(p / w).cast("double")).cast("double"))
    return table.withColumn("values", cells)


def rectangle(table: DataFrame, dx: Number, dy: Number, x0: Number = 0.5, y0: Number = 0.5, phi: Number = 0.0) -> DataFrame:
    """1 inside a rectangle of dx by dy shares of the frame about (x0, y0); its bounds are whole cells, inclusive."""
    dx, dy, x0, y0 = map(_c, (dx, dy, x0, y0))
    w, h = F.col("width"), F.col("height")
    whole = lambda x: x.cast("int")

    def value(x: Column, y: Column) -> Column:
        x, y = A.rotate(x, y, x0 * w, y0 * h, _c(phi))
        return x.between(whole((x0 - dx / 2) * w), whole((x0 + dx / 2) * w)) & y.between(whole((y0 - dy / 2) * h), whole((y0 + dy / 2) * h))

    return _cells(table, value)


def checkerboard(table: DataFrame, dx: Number, dy: Number, phi: Number = 0.0) -> DataFrame:
    """1 where the field numbers along both axes are even."""
    w, h = F.col("width"), F.col("height")

    def even(x: Column, d: Column, n: Column) -> Column:
        return F.floor(x / (d * n) + F.ceil(n / d)) % 2 == 0

    def value(x: Column, y: Column) -> Column:
        x, y = A.rotate(x, y, w / 2, h / 2, _c(phi))
        return even(x, _c(dx), w) & even(y, _c(dy), h)

    return _cells(table, value)


def circular_section(table: DataFrame, r: Number, x0: Number = 0.5, y0: Number = 0.5, phi0: Number = 0.0, phi1: Number = 2 * math.pi) -> DataFrame:
    """1 within r (in shares of the shorter side) of (x0, y0), at angles from phi0 to phi1 counted from the negative x axis."""
    w, h = F.col("width"), F.col("height")

    def value(x: Column, y: Column) -> Column:
        x, y = (x - _c(x0) * w) / F.least(w, h), (y - _c(y0) * h) / F.least(w, h)
        return (F.atan2(y, x) + math.pi).between(_c(phi0), _c(phi1)) & (x * x + y * y <= _c(r) * _c(r))

    return _cells(table, value)


def atom_cluster(table: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Discs with the profile 1 - (distance / radius)^6, summed and clipped at 1.

    A disc reaches from one cell before the start of its box up to, not including, one after its end, and
    never the last row or column.
    """
    sums, centres = [0.0, 0.0], [(0.0, 0.0)]
    for dx, dy in DISC_STEPS:
        sums = [sums[0] + dx * 2 * radius, sums[1] + dy * 2 * radius]
        centres.append(tuple(sums))
    shifts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in centres])
    w, h = F.col("width"), F.col("height")
    discs = F.transform(shifts, lambda s: F.struct((w * FIRST_DISC[0] + s["x"]).alias("x"), (h * FIRST_DISC[1] + s["y"]).alias("y")))
    table = table.withColumn("__discs", discs)

    def value(x: Column, y: Column) -> Column:
        def share(disc: Column) -> Column:
            near = F.pow((F.pow(x - disc["x"], 2) + F.pow(y - disc["y"], 2)) / (radius * radius), 3)
            box = (x >= F.floor(disc["x"] - radius) - 1) & (x < F.least(w - 1, F.ceil(disc["x"] + radius) + 1)) & (y >= F.floor(disc["y"] - radius) - 1) & (y < F.least(h - 1, F.ceil(disc["y"] + radius) + 1))
            return F.when(box & (near < 1), 1 - near).otherwise(F.lit(0.0))

        return F.least(F.lit(1.0), F.aggregate("__discs", F.lit(0.0), lambda a, d: a + share(d)))

    return _cells(table, value).drop("__discs")


def combine_max(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell-wise maximum of two tables of frames, joined by image_id."""
    both = a.join(b.select("image_id", F.col("values").alias("__b")), "image_id")
    return both.withColumn("values", F.zip_with("values", "__b", lambda x, y: F.greatest(x, y))).drop("__b")


def combo(table: DataFrame, r: Number, dx: Number, dy: Number, phi: Number = 0.0) -> DataFrame:
    """A circle and a rectangle, as a cell-wise maximum within each row."""
    both = circular_section(table, r).withColumnRenamed("values", "__a")
    both = rectangle(both, dx, dy, phi=phi)
    return both.withColumn("values", F.zip_with("values", "__a", lambda x, y: F.greatest(x, y))).drop("__a")
