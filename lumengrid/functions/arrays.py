"""Column functions over packed frames (row-major arrays of doubles) and index arrays.

All of them stay within a row, so that no shuffle is needed between them. NaN is skipped by maxima and
minima; an empty array gives NULL for those, and 0 for sums and the largest absolute value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half-width of a Gaussian kernel in standard deviations (fixed value).
HALF_WIDTH = 2.884402748387961466


def _numbers(values: Column) -> Column:
    return F.filter(values, lambda x: ~F.isnan(x))


def vector_max(values: Column) -> Column:
    return F.array_max(_numbers(values))


def vector_min(values: Column) -> Column:
    return F.array_min(_numbers(values))


def vector_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def vector_max_abs(values: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(_numbers(values), F.abs)), F.when(values.isNotNull(), F.lit(0.0)))


def vector_max_abs_diff(a: Column, b: Column) -> Column:
    return vector_max_abs(F.zip_with(a, b, lambda x, y: x - y))


def mean_abs_diff(a: Column, b: Column) -> Column:
    return F.try_divide(vector_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.size(a))


def every(values: Column, stride: int, offset: int = 0) -> Column:
    """Elements offset, offset + stride, ...; the argument of a strided reduction."""
    return F.filter(values, lambda _, i: i % stride == offset)


def reduce_with(values: Column, start: Column, merge) -> Column:
    """Fold with any function of two columns and a start value."""
    return F.aggregate(values, start, merge)


def mean(values: Column) -> Column:
    return F.try_divide(vector_sum(values), F.size(values))


def stddev(values: Column) -> Column:
    """Sample standard deviation, about the mean (two passes within the row)."""
    centre = mean(values)
    squares = vector_sum(F.transform(values, lambda x: (x - centre) * (x - centre)))
    return F.sqrt(F.try_divide(squares, F.size(values) - 1))


def relative_error(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude; 0 where both are 0."""
    size = F.greatest(F.abs(a), F.abs(b))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), size))


def frame_relative_error(a: Column, b: Column) -> Column:
    """Largest difference over the largest magnitude (1 if all are 0)."""
    size = F.greatest(vector_max_abs(a), vector_max_abs(b))
    return vector_max_abs_diff(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size)


def steps(values: Column) -> Column:
    """Absolute differences of neighbours."""
    return F.filter(F.transform(values, lambda x, i: F.abs(x - F.get(values, i - 1))), lambda x: x.isNotNull())


def max_step(values: Column) -> Column:
    return F.array_max(steps(values))


def total_variation(values: Column) -> Column:
    return vector_sum(steps(values))


def cutoff(value: Column, threshold: Column, lower, upper) -> Column:
    """lower where value < threshold, else upper: ties and NaN are upper."""
    return F.when(value < threshold, lower).otherwise(upper)


def quantise16(value: Column, largest: Column) -> Column:
    """Scale by the frame's maximum (0 counts as 1) to 0..65535; NULL where that isn't a number."""
    scale = F.when(largest == 0, F.lit(1.0)).otherwise(largest)
    scaled = value / scale * 65535 + 0.5
    fine = ~F.isnan(scaled) & (F.abs(scaled) < float("inf"))
    return F.when(fine, F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("long"))


def log_scale(value: Column) -> Column:
    """Natural logarithm; NULL for values that have none."""
    return F.when(value > 0, F.ln(value))


def gaussian_weights(sigma: float) -> list[float]:
    """Kernel of width 2n + 1 whose weights sum to 1; sigma 0 is the identity."""
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    if sigma == 0:
        return [1.0]
    n = math.ceil(HALF_WIDTH * sigma - 0.5)
    raw = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-n, n + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_kernel(sigma: Column) -> Column:
    """The same kernel as an array column, for a sigma of each row; NULL for a negative sigma."""
    n = F.ceil(HALF_WIDTH * sigma - 0.5).cast("int")
    raw = F.transform(F.sequence(-n, n), lambda i: F.exp(-(i * i) / (2 * sigma * sigma)))
    total = vector_sum(raw)
    return F.when(sigma == 0, F.array(F.lit(1.0))).when(sigma > 0, F.transform(raw, lambda w: w / total))


def _inside(index: Column, size: Column, periodic: bool) -> Column:
    return F.pmod(index, size) if periodic else F.greatest(F.lit(0), F.least(size - 1, index))


def convolve_1d(values: Column, weights: Column, periodic: bool = False) -> Column:
    """Weighted sums with an odd kernel; the border is extended, or wrapped if periodic."""
    n = F.size(values)
    half = (F.size(weights) / 2).cast("int")
    return F.transform(values, lambda _, p: _gather(values, weights, half, lambda k: _inside(p + k, n, periodic)))


def _gather(values: Column, weights: Column, half: Column, place) -> Column:
    return F.aggregate(F.sequence(-half, half), F.lit(0.0), lambda a, k: a + F.get(values, place(k)) * F.get(weights, k + half))


def convolve_rows(values: Column, height: Column, width: Column, weights: Column, periodic: bool = False) -> Column:
    half = (F.size(weights) / 2).cast("int")
    return F.transform(values, lambda _, p: _gather(values, weights, half, lambda k: p - p % width + _inside(p % width + k, width, periodic)))


def convolve_cols(values: Column, height: Column, width: Column, weights: Column, periodic: bool = False) -> Column:
    half = (F.size(weights) / 2).cast("int")
    return F.transform(values, lambda _, p: _gather(values, weights, half, lambda k: _inside(F.floor(p / width).cast("int") + k, height, periodic) * width + p % width))


def to_linear(index: Column, sizes: Column) -> Column:
    """Position of an index of any rank, last dimension fastest."""
    pairs = F.zip_with(index, sizes, lambda i, n: F.struct(i.cast("long").alias("i"), n.cast("long").alias("n")))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, s: a * s["n"] + s["i"])


def to_vector(position: Column, sizes: Column) -> Column:
    """Index of a position, last dimension fastest."""

    def after(d: Column) -> Column:
        return F.aggregate(F.filter(sizes, lambda _, e: e > d), F.lit(1).cast("long"), lambda a, n: a * n)

    return F.transform(sizes, lambda n, d: (F.floor(position / after(d)).cast("long") % n).cast("int"))


def fft_shift_index(index: Column, size: Column) -> Column:
    """Cyclic shift by half the size, which moves frequency 0 to the centre."""
    return (index + F.floor(size / 2).cast("int")) % size


def rotate(x: Column, y: Column, cx, cy, phi) -> tuple[Column, Column]:
    """(x, y) rotated by phi radians about (cx, cy)."""
    cx, cy, phi = (c if isinstance(c, Column) else F.lit(float(c)) for c in (cx, cy, phi))
    return cx + F.cos(phi) * (x - cx) - F.sin(phi) * (y - cy), cy + F.sin(phi) * (x - cx) + F.cos(phi) * (y - cy)


def unpack_bits(words: Column, n: Column) -> Column:
    """First n bits of unsigned 32-bit words held as longs, most significant bit first, as booleans."""
    bits = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(31), F.lit(0), F.lit(-1)), lambda b: F.getbit(w, b) == 1)))
    return F.slice(bits, F.lit(1), n)


def pack_bits(bits: Column) -> Column:
    """Booleans as unsigned 32-bit words in longs, most significant bit first; the last word is filled with 0."""
    n_words = F.ceil(F.size(bits) / 32).cast("int")
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, b: a * 2 + F.coalesce(F.get(bits, w * 32 + b), F.lit(False)).cast("long"))
    return F.when(n_words > 0, F.transform(F.sequence(F.lit(0), n_words - 1), word)).otherwise(F.array().cast("array<bigint>"))


def masked_error(norms: Column, masked: Column, invert: bool = False) -> tuple[Column, Column, Column]:
    """(total, count, error) of the magnitudes in masked cells; the error is NULL if no cell is masked."""
    chosen = F.zip_with(norms, masked, lambda v, m: F.when(~m if invert else m, v))
    total = F.aggregate(chosen, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    count = F.aggregate(masked, F.lit(0).cast("long"), lambda a, m: a + (~m if invert else m).cast("long"))
    return total, count, F.try_divide(F.sqrt(total), count)
