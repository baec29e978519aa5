"""Phase retrieval of frames that don't fit in a task: the jobs of `retrieve` on tiles.

The object's side of the state lies in bands of whole rows, the measured magnitude in bands of whole columns. A step
transforms the rows of its bands, hands the pieces to the bands of columns, where they meet the magnitude (one
exchange), replaces it, transforms back, and hands the pieces to the bands of rows, where they meet the guess and
the mask (a second exchange). Only one table is written a step: the next guess with its mask. Maxima and errors of
frames are sums over their bands, small tables with a row for each frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.functions import arrays as A
from lumengrid.operators import retrieve, spectral, tiles
from lumengrid.operators.tiles import CELLS, KEY, Cells, Layout, Tile
from lumengrid.plans.checkpoint import discard, materialise
from lumengrid.plans.cycles import Run, run_turns

GUESS = ["g_re", "g_im"]
RESULTS = ["sigma", "threshold", "n_masked", "total_error", "error", "converged", "cycles"]


def _pieces(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Tiles as pieces of themselves."""
    rows, cols = F.least(F.col("gh"), F.col("height") - F.col("y0")), F.least(F.col("gw"), F.col("width") - F.col("x0"))
    scalars = [c for c in df.columns if c not in KEY and not isinstance(df.schema[c].dataType, T.ArrayType)]
    return df.select(*KEY, F.col("y0").alias("py"), F.col("x0").alias("px"), rows.cast("int").alias("ph"), cols.cast("int").alias("pw"), *scalars, *arrays)


def _scalars(df: DataFrame) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name in KEY or not isinstance(f.dataType, T.ArrayType)])


def _modulus(tile: Tile) -> tuple[Cells, Cells]:
    """Columns' spectrum with the magnitude replaced, transformed back along the columns."""
    mag = tile.arrays.get("mag")
    re, im = tiles.line_transform(tile.arrays.get("re"), tile.arrays.get("im"), 0, False)
    if re is None or mag is None:
        return None, None
    norm = np.hypot(re[0], im[0])
    scale, whole = mag[0] / np.where(norm == 0, 1, norm), re[1] & mag[1]
    return tiles.line_transform((re[0] * scale, whole), (im[0] * scale, whole), 0, True)


def _constrained(tile: Tile, re: Cells, im: Cells) -> tuple[Cells, Cells]:
    known = [re, im, *(tile.arrays.get(n) for n in (*GUESS, "masked"))]
    if any(x is None for x in known):
        return None, None
    (re, im, g_re, g_im, masked), whole = (x[0] for x in known), np.all([x[1] for x in known], axis=0)
    out, beta = (masked > 0) | (re < 0), tile.scalars["beta"].to_numpy(zero_copy_only=False)[:, None, None]
    return (np.where(out, g_re - beta * re, re), whole), (np.where(out, g_im - beta * im, im), whole)


def hio_step(guess: DataFrame, magnitudes: DataFrame, cells: int = CELLS, last: str | None = None) -> DataFrame:
    """The transform of a guess, and the next guess from it: g_re, g_im, re, im, masked in bands of whole rows.

    `guess` has g_re, g_im, masked in bands of whole rows and the scalar beta; `magnitudes` has mag in bands of whole
    columns. Where the boolean column `last` holds the guess stays as it is, and re, im are its transform; elsewhere
    they are NULL. Two exchanges.
    """
    rows, cols = tiles.row_bands(cells), tiles.col_bands(cells)
    state, half = Layout(_scalars(guess), [*GUESS, "masked"]), Layout(guess.select(*KEY).schema, ["re", "im"])
    middle, joined, out = Layout(guess.select(*KEY).schema, ["re", "im", "mag"]), Layout(_scalars(guess), ["re", "im", *GUESS, "masked"]), Layout(_scalars(guess), [*GUESS, "re", "im", "masked"])

    def over_rows(tile: Tile) -> Iterator[Tile]:
        re, im = tiles.line_transform(tile.arrays["g_re"], tile.arrays["g_im"], 1, False)
        return tiles._cut(tile.with_arrays(re=re, im=im), cols(tile.height, tile.width))

    def over_cols(tile: Tile) -> Iterator[Tile]:
        re, im = _modulus(tile)
        if re is None:
            return iter([])
        return tiles._cut(tile.with_arrays(re=re, im=im).where(re[1]), rows(tile.height, tile.width))

    def back(tile: Tile) -> Iterator[Tile]:
        ends = tile.scalars[last].to_numpy(zero_copy_only=False).astype(bool) if last else np.zeros(len(tile.image), bool)
        for part, over in ((tile.where(ends), True), (tile.where(~ends), False)):
            re, im = tiles.line_transform(part.arrays.get("re"), part.arrays.get("im"), 1, True)
            masked = part.arrays.get("masked")
            if over:
                yield part.with_arrays(g_re=part.arrays.get("g_re"), g_im=part.arrays.get("g_im"), re=re, im=im, masked=masked)
            else:
                g_re, g_im = _constrained(part, re, im)
                yield part.with_arrays(g_re=g_re, g_im=g_im, masked=masked)

    guess = guess.select(*state.schema().names)
    sent = tiles._narrow(guess, state, half, over_rows, pieces=True)
    measured = _pieces(magnitudes.select(*KEY, "mag"), ["mag"])
    met = tiles.gather(sent.unionByName(measured, allowMissingColumns=True), middle, half, over_cols, out_pieces=True)
    return tiles.gather(met.unionByName(_pieces(guess, [*GUESS, "masked"]), allowMissingColumns=True), joined, out, back)


def update_mask(state: DataFrame, sigma: str, share: F.Column) -> DataFrame:
    """Add threshold and masked (1 or 0) to bands of whole rows with re, im: as `retrieve.update_mask`."""
    norms = state.select(*KEY, sigma, spectral.complex_norm().alias("norm"))
    smoothed = materialise(tiles.blur(norms, sigma, values="norm", whole_rows=True))
    largest = smoothed.groupBy("image_id").agg(F.max(A.vector_max(F.col("norm"))).alias("__largest"))
    out = state.join(smoothed.select("image_id", "y0", "norm"), ["image_id", "y0"]).join(largest, "image_id")
    out = out.withColumn("threshold", share * F.col("__largest"))
    masked = F.transform("norm", lambda v: F.coalesce((v < F.col("threshold")).cast("double"), F.lit(0.0)))
    return out.withColumn("masked", masked).drop("norm", "__largest")


def with_error(state: DataFrame) -> DataFrame:
    """Add total_error, n_masked and error of each frame to its bands."""
    total, count, _ = A.masked_error(spectral.complex_norm(), F.transform("masked", lambda m: m > 0))
    sums = state.groupBy("image_id").agg(F.sum(total).alias("total_error"), F.sum(count).alias("n_masked"))
    sums = sums.withColumn("error", F.try_divide(F.sqrt("total_error"), F.col("n_masked")))
    return state.join(sums, "image_id")


def shrink_wrap(magnitudes: DataFrame, params: DataFrame | None = None, folder: str | None = None, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Objects and iteration trace from tiles whose values are magnitudes, in any tiling: as `retrieve.shrink_wrap`.

    Objects are tiles (bands of whole rows of about `cells` cells) with values and the frame's cycles, error and
    converged. The state is written after each cycle and each step; a run with a `folder` that was broken off goes on
    from its last complete cycle. A frame with a tile that isn't whole has NULL values, and no error.
    """
    spark = magnitudes.sparkSession
    run = Run(spark, folder)
    names = [*KEY, *retrieve.DEFAULTS]
    measured = T.StructType([T.StructField("image_id", magnitudes.schema["image_id"].dataType), *[T.StructField(n, T.IntegerType()) for n in KEY[1:]], T.StructField("mag", T.ArrayType(T.DoubleType()))])

    def start() -> DataFrame:
        known = retrieve.resolve_params(magnitudes.select(*KEY, "values"), params).select(*names, "values")
        run.write("magnitudes", tiles.regrid(known, tiles.col_bands(cells)).withColumnRenamed("values", "mag"))
        mags = spark.read.parquet(f"{run.path}/magnitudes")
        layout, target = Layout(mags.schema), Layout(_scalars(mags), ["re", "im"])

        def over_cols(tile: Tile) -> Iterator[Tile]:
            re, im = tiles.line_transform(tile.arrays["mag"], None, 0, True, real=True)
            return tiles._cut(tile.with_arrays(re=re, im=im), tiles.row_bands(cells)(tile.height, tile.width))

        def over_rows(tile: Tile) -> Iterator[Tile]:
            re, im = tiles.line_transform(tile.arrays.get("re"), tile.arrays.get("im"), 1, True)
            yield tile.with_arrays(re=re, im=im)

        guess = tiles.gather(tiles._narrow(mags, layout, target, over_cols, pieces=True), target, target, over_rows)
        null = F.lit(None)
        blank = {n: null.cast("double") for n in RESULTS[:5]} | {"n_masked": null.cast("long"), "converged": F.lit(False), "cycles": F.lit(0)}
        return guess.withColumns({"g_re": F.col("re"), "g_im": F.col("im"), "masked": null.cast("array<double>")} | blank)

    def turn(state: DataFrame, k: int) -> DataFrame:
        columns, active = state.columns, state.select("image_id").distinct()
        state = state.withColumn("sigma", retrieve.sigma_at(F.col("sigma0"), F.col("sigma_change"), k))
        state = update_mask(state.drop("threshold", "masked"), "sigma", F.col("cutoff_auto" if k == 0 else "cutoff"))
        state = state.drop(*[n for n in RESULTS if n not in ("sigma", "threshold")])
        first = retrieve.hio_constraint(state.withColumn("masked", F.transform("masked", lambda m: m > 0)), F.col("beta"))
        guess = materialise(first.withColumn("masked", F.transform("masked", lambda m: m.cast("double"))).drop("re", "im"))
        asked = sorted(r[0] for r in guess.select("n_hio").distinct().collect())
        mags = run.read(measured, "magnitudes").join(active, "image_id", "left_semi")
        parts = []
        for step in range(1, asked[-1] + 1):
            going = guess.where(F.col("n_hio") >= step).withColumn("__last", F.col("n_hio") == step)
            found = materialise(hio_step(going, mags, cells, "__last").drop("__last"))
            if step - 1 not in asked:
                discard(guess)
            guess = found
            if step in asked:
                parts.append(found.where(F.col("n_hio") == step))
        done = parts[0]
        for part in parts[1:]:
            done = done.unionByName(part)
        done = with_error(done).withColumns({"converged": F.coalesce(F.col("error") < F.col("target_error"), F.lit(False)), "cycles": F.lit(k + 1)})
        return done.select(*columns, (F.col("converged") | (F.col("n_cycles") <= k + 1)).alias("over"))

    def keep(state: DataFrame, k: int) -> tuple[str, DataFrame]:
        return f"trace-{k:06d}", state.where("y0 = 0").select("image_id", F.lit(k).alias("cycle"), *RESULTS[:-1])

    done = run_turns(run, start, turn, lambda s: s.agg(F.max("n_cycles")).first()[0] or 0, keep)
    id_type = magnitudes.schema["image_id"].dataType.simpleString()
    trace = run.read(f"image_id {id_type}, {retrieve.TRACE}", *[f"trace-{k:06d}" for k in range((run.last() or {}).get("turn", 0))])
    return done.select(*KEY, F.col("re").alias("values"), "cycles", "error", "converged"), trace
