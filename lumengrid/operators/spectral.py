"""Two-dimensional discrete Fourier transforms, unnormalised in both directions.

Packed frames are transformed in Arrow batches with NumPy's FFT, frames of one shape together; there is
no shuffle. For single frames that don't fit in a task there is the separable transform on pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())


def by_shape(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(row numbers, stacks of frames) for each shape in a batch, without frames that are NULL, hold one, or have too many or few cells."""
    at = {n: batch.column(batch.schema.get_field_index(n)) for n in ("height", "width", *columns)}
    shapes = np.stack([pc.fill_null(at[n], 0).to_numpy(zero_copy_only=False) for n in ("height", "width")], 1)
    whole = shapes.min(1) > 0
    for c in columns:
        whole &= pc.fill_null(pc.list_value_length(at[c]), -1).to_numpy(zero_copy_only=False) == shapes[:, 0] * shapes[:, 1]
        if at[c].flatten().null_count:
            holes = pc.list_parent_indices(at[c]).filter(at[c].flatten().is_null())
            whole[np.unique(holes.to_numpy(zero_copy_only=False))] = False
    for h, w in np.unique(shapes[whole], axis=0):
        rows = np.flatnonzero(whole & (shapes == (h, w)).all(1))
        yield rows, [at[c].take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, h, w) for c in columns]


def with_frames(batch: pa.RecordBatch, schema: T.StructType, results: dict[str, list]) -> pa.RecordBatch:
    """The batch with some columns replaced or added."""
    out = [pa.array(results[n], pa.list_(pa.float64())) if n in results else batch.column(batch.schema.get_field_index(n)) for n in schema.names]
    return pa.RecordBatch.from_arrays(out, names=schema.names)


def dft2(frames: DataFrame, re: str = "values", im: str | None = None, inverse: bool = False) -> DataFrame:
    """Add re and im (replacing the inputs): the transform of the frames; im None means real frames.

    A frame that is NULL, holds a NULL or hasn't height * width cells gets NULL. The inverse has no factor 1 / N.
    """
    kept = [f for f in frames.schema if f.name not in (re, im, "re", "im")]
    schema = T.StructType([*kept, T.StructField("re", DOUBLES), T.StructField("im", DOUBLES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = {"re": [None] * batch.num_rows, "im": [None] * batch.num_rows}
            for rows, stacks in by_shape(batch, [re] + ([im] if im else [])):
                x = stacks[0] + 1j * stacks[1] if im else stacks[0]
                y = np.fft.ifft2(x, norm="forward") if inverse else np.fft.fft2(x)
                for k, r in enumerate(rows):
                    results["re"][r], results["im"][r] = y[k].real.ravel(), y[k].imag.ravel()
            yield with_frames(batch, schema, results)

    return frames.mapInArrow(run, schema)


def dft2_pixels(pixels: DataFrame, height: int, width: int, inverse: bool = False) -> DataFrame:
    """The transform of complex pixels (image_id, iy, ix, re, im), one axis after the other.

    For frames too large for one row: each axis is an aggregation over the other's cells, of one frame
    shape. Angles are reduced modulo the size before their sines, which keeps them accurate.
    """
    sign = 1 if inverse else -1

    def axis(df: DataFrame, index: str, other: str, n: int) -> DataFrame:
        df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        angle = sign * 2 * math.pi / n * ((F.col("k") * F.col(index)) % n)
        re = F.sum(F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))
        im = F.sum(F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle))
        return df.groupBy("image_id", other, "k").agg(re.alias("re"), im.alias("im")).withColumnRenamed("k", index)

    return axis(axis(pixels, "ix", "iy", width), "iy", "ix", height).select("image_id", "iy", "ix", "re", "im")


def complex_norm(re: str = "re", im: str = "im") -> F.Column:
    return F.zip_with(re, im, lambda a, b: F.hypot(a, b))


def to_complex(frames: DataFrame) -> DataFrame:
    """Real frames as re and im, which is 0."""
    return frames.withColumns({"re": F.col("values"), "im": F.transform("values", lambda _: F.lit(0.0))}).drop("values")


def real_part(frames: DataFrame) -> DataFrame:
    """The real part of re and im, as values."""
    return frames.withColumn("values", F.col("re")).drop("re", "im")


def diffraction_magnitude(frames: DataFrame) -> DataFrame:
    """The magnitude of the transform, as values; neither squared nor shifted."""
    return dft2(frames).withColumn("values", complex_norm()).drop("re", "im")


def autocorrelation_guess(frames: DataFrame) -> DataFrame:
    """The inverse transform of a magnitude: re and im of the first guess of the object."""
    return dft2(frames, inverse=True)


#: Modulus and factors of the draws: a Mersenne prime and primitive roots of it.
PRIME, FACTORS = (1 << 31) - 1, (48_271, 69_621, 16_807)


def _draw(number: F.Column, place: F.Column, seed: int) -> F.Column:
    """A number in [0, 1) for a frame, a cell and a seed, by squaring modulo PRIME: the same in any system."""
    x = (F.pmod(number.cast("long"), F.lit(PRIME)) * FACTORS[0] + place.cast("long") * FACTORS[1] + F.lit((seed * FACTORS[2] + 1) % PRIME)) % PRIME
    for factor in FACTORS:
        x = (x * x + factor) % PRIME
    return x.cast("double") / float(PRIME)


def random_phase(frames: DataFrame, seed: int = 0) -> DataFrame:
    """Add re and im: the magnitudes in `values` with the phases of a random real frame, drawn from seed and image_id."""
    draw = F.transform("values", lambda _, i: _draw(F.col("image_id"), i, seed))
    phased = dft2(frames.withColumn("__draw", draw), "__draw")
    phase = F.zip_with("re", "im", lambda a, b: F.atan2(b, a))
    phased = phased.withColumn("__phase", phase)
    return phased.withColumns({"re": F.zip_with("values", "__phase", lambda v, p: v * F.cos(p)), "im": F.zip_with("values", "__phase", lambda v, p: v * F.sin(p))}).drop("__phase")


def fft_shift(frames: DataFrame) -> DataFrame:
    """Frequency 0 to the centre: a cyclic shift of both axes by half their size."""
    h, w = F.col("height"), F.col("width")
    half = lambda n: n - F.floor(n / 2).cast("int")
    source = lambda p: ((F.floor(p / w).cast("int") + half(h)) % h) * w + (p % w + half(w)) % w
    return frames.withColumn("values", F.transform("values", lambda _, p: F.get("values", source(p))))


def mirror_symmetry(frames: DataFrame) -> DataFrame:
    """(image_id, asymmetry): largest relative difference of cells k and -k, leaving out index 0 of either axis.

    0 for the magnitudes of a real object.
    """
    h, w = F.col("height"), F.col("width")
    mirrored = lambda p: (h - F.floor(p / w).cast("int")) * w + (w - p % w)
    inner = lambda p: (p % w > 0) & (p >= w)
    error = F.transform("values", lambda v, p: F.when(inner(p), _relative(v, F.get("values", mirrored(p)))))
    return frames.select("image_id", F.coalesce(F.array_max(error), F.lit(0.0)).alias("asymmetry"))


def _relative(a: F.Column, b: F.Column) -> F.Column:
    size = F.greatest(F.abs(a), F.abs(b))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), size))
