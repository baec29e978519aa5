"""Batch phase retrieval: objects from Fourier magnitudes by hybrid input-output with a shrinking mask.

A mask cell is true outside the object. `update_mask`, `hio_constraint`, `apply_modulus`, `hio_steps` and
`with_error` are the steps as column expressions or Arrow mappings. The jobs `shrink_wrap` and
`hybrid_input_output` take several cycles in one mapping over Arrow batches, in NumPy, frames of one shape
together. After some cycles the state is written to the shared folder: the magnitude and the guess, from which the
current object follows by one transform. Frames that are finished leave the state, the others are dealt by what
they still cost, which is the only shuffle, a state is deleted when the next one is complete, and a run that is
given a folder goes on from its last complete state.
"""
from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.functions import arrays as A
from lumengrid.operators import smooth, spectral
from lumengrid.plans.cycles import Run, run_turns
from lumengrid.plans.deal import dealt

#: What a parameter is if it is missing or not above 0.
DEFAULTS = {"n_cycles": 20, "n_hio": 20, "target_error": 1e-5, "beta": 0.9, "cutoff_auto": 0.04, "cutoff": 0.2, "sigma0": 3.0, "sigma_change": 0.01}
LEAST_SIGMA = 1.5
TRACE = "cycle int, sigma double, threshold double, n_masked long, total_error double, error double, converged boolean"
#: Bytes of frames that are advanced together.
TOGETHER = 64 << 20


def resolve_params(frames: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Frames with every parameter: from `params` by image_id where above 0, else the default."""
    joined = frames.join(params, "image_id", "left") if params is not None else frames
    value = lambda n: F.when(F.col(n) > 0, F.col(n)).otherwise(F.lit(DEFAULTS[n])) if n in joined.columns else F.lit(DEFAULTS[n])
    return joined.withColumns({n: value(n).cast("int" if isinstance(d, int) else "double") for n, d in DEFAULTS.items()})


def sigma_at(sigma0: F.Column, change: F.Column, cycle: int | F.Column) -> F.Column:
    """The width of the blur in a cycle: sigma0 first, then shrinking to LEAST_SIGMA at most."""
    cycle = cycle if isinstance(cycle, F.Column) else F.lit(cycle)
    return F.when(cycle == 0, sigma0).otherwise(F.greatest(F.lit(LEAST_SIGMA), sigma0 * F.pow(1 - change, cycle)))


def update_mask(frames: DataFrame, sigma: float | F.Column, share: float | F.Column) -> DataFrame:
    """Add threshold and masked: cells where the blurred magnitude of re, im is below share times its maximum."""
    share = share if isinstance(share, F.Column) else F.lit(share)
    out = smooth.blur(frames.withColumn("__norm", spectral.complex_norm()), sigma, values="__norm")
    out = out.withColumn("threshold", share * A.vector_max(F.col("__norm")))
    masked = F.transform("__norm", lambda v: F.coalesce(v < F.col("threshold"), F.lit(False)))
    return out.withColumn("masked", masked).drop("__norm")


def hio_constraint(frames: DataFrame, beta: float | F.Column) -> DataFrame:
    """g_re, g_im after the object constraint: less beta times re, im where masked or re is negative, else re, im."""
    beta = beta if isinstance(beta, F.Column) else F.lit(beta)
    new = lambda g, p: F.transform(g, lambda x, i: F.when(F.get("masked", i) | (F.get("re", i) < 0), x - beta * F.get(p, i)).otherwise(F.get(p, i)))
    return frames.withColumns({"g_re": new("g_re", "re"), "g_im": new("g_im", "im")})


def apply_modulus(frames: DataFrame, magnitude: str = "mag") -> DataFrame:
    """re and im with the phase kept and the magnitude replaced; a norm of 0 counts as 1."""
    safe = F.transform(spectral.complex_norm(), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))
    out = frames.withColumn("__safe", safe)
    new = lambda p: F.transform(p, lambda x, i: x * F.get(magnitude, i) / F.get("__safe", i))
    return out.withColumns({"re": new("re"), "im": new("im")}).drop("__safe")


def hio_steps(frames: DataFrame, steps: int | str, beta: float | str, target: str | None = None) -> DataFrame:
    """Repeat constraint, transform, modulus and inverse transform; steps and beta are numbers or columns.

    With a column `target`, a frame whose error in the masked cells is below it takes no further step, and the
    column `cycles` is raised by the steps that a frame took. Frames that aren't whole get NULL.
    """
    schema = frames.schema
    kept = ["mag", "g_re", "g_im", "re", "im"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            n_steps = column(steps) if isinstance(steps, str) else np.full(batch.num_rows, steps)
            betas = column(beta) if isinstance(beta, str) else np.full(batch.num_rows, beta)
            results = {n: [None] * batch.num_rows for n in kept[1:]}
            taken = np.zeros(batch.num_rows, np.int64)
            for rows, (mag, g_re, g_im, re, im, masked) in spectral.by_shape(batch, [*kept, "masked"]):
                g, new, masked, b = g_re + 1j * g_im, re + 1j * im, masked.astype(bool), betas[rows][:, None, None]
                on = np.ones(len(rows), bool)
                for step in range(int(n_steps[rows].max(initial=0))):
                    on &= n_steps[rows] > step
                    if target:
                        with np.errstate(invalid="ignore", divide="ignore"):
                            error = np.sqrt((np.abs(new) * masked).sum((1, 2))) / masked.sum((1, 2))
                        on &= ~(error < column(target)[rows])
                    if not on.any():
                        break
                    kept_g = np.where(masked | (new.real < 0), g - b * new, new)
                    spectrum = np.fft.fft2(kept_g)
                    norm = np.abs(spectrum)
                    moved = np.fft.ifft2(spectrum * (mag / np.where(norm == 0, 1, norm)), norm="forward")
                    g, new = np.where(on[:, None, None], kept_g, g), np.where(on[:, None, None], moved, new)
                    taken[rows] += on
                for k, r in enumerate(rows):
                    for n, x in zip(kept[1:], (g[k].real, g[k].imag, new[k].real, new[k].imag), strict=True):
                        results[n][r] = x.ravel()
            out = spectral.with_frames(batch, schema, results)
            if target:
                at = schema.names.index("cycles")
                out = out.set_column(at, "cycles", pa.array((column("cycles") + taken).astype(np.int32)))
            yield out

    return frames.mapInArrow(run, schema)


def with_error(frames: DataFrame) -> DataFrame:
    """Add total_error, n_masked and error of re, im in the masked cells."""
    total, count, error = A.masked_error(spectral.complex_norm(), F.col("masked"))
    return frames.withColumns({"total_error": total, "n_masked": count, "error": error})


def blur_stack(frames: np.ndarray, sigma: float) -> np.ndarray:
    """Smooth a stack of frames, borders extended."""
    weights = A.gaussian_weights(sigma)
    half = len(weights) // 2
    for axis in (2, 1):
        n = frames.shape[axis]
        padded = np.pad(frames, [(half, half) if a == axis else (0, 0) for a in range(3)], mode="edge")
        frames = sum(w * (padded[:, :, k : k + n] if axis == 2 else padded[:, k : k + n]) for k, w in enumerate(weights))
    return frames


def masks_of(new: np.ndarray, sigma: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(masks, thresholds) of a stack: cells whose smoothed magnitude is below the share of its maximum."""
    smoothed = np.abs(new)
    for s in np.unique(sigma):
        smoothed[sigma == s] = blur_stack(smoothed[sigma == s], float(s))
    with warnings.catch_warnings(), np.errstate(invalid="ignore"):
        warnings.simplefilter("ignore")
        threshold = share * np.nanmax(smoothed, (1, 2))
        return smoothed < threshold[:, None, None], threshold


def errors_of(new: np.ndarray, masked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(total, count, error) of each frame of a stack; the error is NaN where nothing is masked."""
    total, count = np.where(masked, np.abs(new), 0).sum((1, 2)), masked.sum((1, 2))
    with np.errstate(invalid="ignore", divide="ignore"):
        return total, count, np.sqrt(total) / count


def transformed(mag: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The guess with its spectrum's magnitude replaced."""
    spectrum = np.fft.fft2(g)
    norm = np.abs(spectrum)
    return np.fft.ifft2(spectrum * (mag / np.where(norm == 0, 1, norm)), norm="forward")


def step(mag: np.ndarray, g: np.ndarray, new: np.ndarray, masked: np.ndarray, beta: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of the frames that are on."""
    if not on.all():
        g, new = g.copy(), new.copy()
        g[on], new[on] = step(mag[on], g[on], new[on], masked[on], beta[on], np.ones(int(on.sum()), bool))
        return g, new
    g = np.where(masked | (new.real < 0), g - beta[:, None, None] * new, new)
    return g, transformed(mag, g)


def _none(x: float) -> float | None:
    return None if np.isnan(x) else float(x)


def shrink_cycles(of: dict[str, np.ndarray], mag: np.ndarray, g: np.ndarray | None, first: int, count: int) -> dict:
    """Cycles first .. first + count of a stack; `of` has the parameters of each frame."""
    n = len(mag)
    new = np.fft.ifft2(mag, norm="forward") if g is None else transformed(mag, g)
    g = new if g is None else g
    out = {"cycles": np.full(n, first), "error": np.full(n, np.nan), "converged": np.zeros(n, bool), "trace": [[] for _ in range(n)]}
    for cycle in range(first, first + count):
        on = (of["n_cycles"] > cycle) & ~out["converged"]
        if not on.any():
            break
        sigma = of["sigma0"] if cycle == 0 else np.maximum(LEAST_SIGMA, of["sigma0"] * (1 - of["sigma_change"]) ** cycle)
        masked = np.zeros(mag.shape, bool)
        threshold = np.full(n, np.nan)
        masked[on], threshold[on] = masks_of(new[on], sigma[on], of["cutoff_auto" if cycle == 0 else "cutoff"][on])
        for k in range(int(of["n_hio"][on].max())):
            g, new = step(mag, g, new, masked, of["beta"], on & (of["n_hio"] > k))
        total, number, error = errors_of(new, masked)
        with np.errstate(invalid="ignore"):
            converged = error < of["target_error"]
        for r in np.flatnonzero(on):
            out["cycles"][r], out["error"][r], out["converged"][r] = cycle + 1, error[r], converged[r]
            out["trace"][r].append({"cycle": cycle, "sigma": float(sigma[r]), "threshold": _none(threshold[r]), "n_masked": int(number[r]), "total_error": float(total[r]), "error": _none(error[r]), "converged": bool(converged[r])})
    return out | {"g": g, "new": new, "over": out["converged"] | (of["n_cycles"] <= first + count)}


def fixed_steps(of: dict[str, np.ndarray], mag: np.ndarray, g: np.ndarray, masked: np.ndarray, first: int, count: int) -> dict:
    """Steps first .. first + count with a fixed mask; the error is tested before each."""
    n = len(mag)
    new = np.fft.ifft2(g, norm="forward") if first == 0 else transformed(mag, g)
    g = new if first == 0 else g
    cycles, stopped = np.full(n, first), np.zeros(n, bool)
    for k in range(first, first + count):
        with np.errstate(invalid="ignore"):
            stopped |= errors_of(new, masked)[2] < of["target_error"]
        on = ~stopped & (of["n_cycles"] > k)
        if not on.any():
            break
        g, new = step(mag, g, new, masked, of["beta"], on)
        cycles += on
    total, number, error = errors_of(new, masked)
    with np.errstate(invalid="ignore"):
        converged = error < of["target_error"]
    trace = [[{"cycle": (first // count), "sigma": None, "threshold": None, "n_masked": int(number[r]), "total_error": float(total[r]), "error": _none(error[r]), "converged": bool(converged[r])}] for r in range(n)]
    return {"g": g, "new": new, "cycles": cycles, "error": error, "converged": converged, "trace": trace, "over": converged | (of["n_cycles"] <= first + count)}


def _state(frames: DataFrame, *arrays: str) -> DataFrame:
    """The state before any cycle: parameters, magnitude and guess, nothing finished."""
    null = F.lit(None)
    kept = frames.select("image_id", "height", "width", *DEFAULTS, F.col("values").cast("array<double>").alias("mag"), *arrays)
    blank = {"cycles": F.lit(0), "error": null.cast("double"), "converged": F.lit(False), "values": null.cast("array<double>"), "trace": null.cast(f"array<struct<{TRACE}>>")}
    return kept.withColumns(blank | {n: null.cast("array<double>") for n in ("g_re", "g_im") if n not in arrays})


def cost_of(steps: F.Column) -> F.Column:
    """What a frame costs: steps times N log N for N cells."""
    cells = F.greatest(F.coalesce(F.col("height").cast("double") * F.col("width"), F.lit(2.0)), F.lit(2.0))
    return steps * cells * F.log2(cells)


def _job(state: DataFrame, first: int, count: int, advance: Callable, arrays: list[str], snapshots: bool = False) -> DataFrame:
    """Advance every frame of a state; frames that aren't whole are over, with NULL values and no cycle."""
    schema = T.StructType([*state.schema, T.StructField("over", T.BooleanType())])
    doubles, names = ("g_re", "g_im", "values", "mag"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, int(TOGETHER * whole.num_rows / max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, rows):
                yield advanced(whole.slice(at, rows))

    def advanced(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        results = {c: [None] * n for c in (*doubles, "error", "trace")} | {"cycles": [0] * n, "converged": [False] * n, "over": [True] * n}
        traces = column("trace").to_pylist()
        for rows, stacks in spectral.by_shape(batch, arrays):
            of = {c: column(c).to_numpy(zero_copy_only=False)[rows] for c in DEFAULTS}
            found = advance(of, dict(zip(arrays, stacks, strict=True)), first, count)
            for k, r in enumerate(rows):
                results["cycles"][r], results["error"][r] = int(found["cycles"][k]), _none(found["error"][k])
                results["converged"][r], results["over"][r] = bool(found["converged"][k]), bool(found["over"][k])
                results["trace"][r] = (traces[r] or []) + found["trace"][k]
                if found["over"][k] or snapshots:
                    results["values"][r] = found["new"][k].real.ravel()
                if not found["over"][k]:
                    results["g_re"][r], results["g_im"][r] = found["g"][k].real.ravel(), found["g"][k].imag.ravel()
                    results["mag"][r] = stacks[0][k].ravel()
        kinds = {c: batch.schema.field(c).type for c in batch.schema.names} | {"over": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array(results[c], kinds[c]) if c in results else column(c) for c in names], names=names)

    return state.mapInArrow(run, schema)


def _results(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    trace = done.select("image_id", F.explode("trace").alias("t")).select("image_id", "t.*")
    return done.select("image_id", "height", "width", "values", "cycles", "error", "converged"), trace


def shrink_wrap(frames: DataFrame, params: DataFrame | None = None, folder: str | None = None, cycles_a_job: int = 10, snapshots: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects and iteration trace from frames whose values are magnitudes.

    Returns (image_id, height, width, values, cycles, error, converged) and (image_id, cycle, sigma,
    threshold, n_masked, total_error, error, converged). The output is height * width times the object,
    since transforms are unnormalised. A frame that isn't whole has NULL values, no cycle and no trace.

    The state is written every `cycles_a_job` cycles. A run with a `folder` that was broken off goes on from its last
    complete state, whatever frames are then given. With `snapshots` each cycle is a job, and its frames are stored
    in the folder (see `snapshots_of`).
    """
    run = Run(frames.sparkSession, folder)
    a_job = 1 if snapshots else cycles_a_job

    def start() -> DataFrame:
        return _state(resolve_params(frames, params))

    def turn(state: DataFrame, k: int) -> DataFrame:
        def advance(of: dict, stacks: dict, first: int, count: int) -> dict:
            g = stacks["g_re"] + 1j * stacks["g_im"] if first else None
            return shrink_cycles(of, stacks["mag"], g, first, count)

        state = dealt(state, cost_of((F.col("n_cycles") - k * a_job) * F.col("n_hio")))
        return _job(state, k * a_job, a_job, advance, ["mag", "g_re", "g_im"] if k else ["mag"], snapshots)

    keep = (lambda state, k: (f"frames-{k:06d}", state.select("image_id", "height", "width", F.lit(k).alias("cycle"), "values"))) if snapshots else None
    return _results(run_turns(run, start, turn, lambda s: -(-(s.agg(F.max("n_cycles")).first()[0] or 0) // a_job), keep))


def snapshots_of(frames: DataFrame, folder: str) -> DataFrame:
    """(image_id, height, width, cycle, values): each frame after each cycle of a run that kept snapshots in a folder."""
    return frames.sparkSession.read.parquet(f"{folder}/frames-*")


def hybrid_input_output(frames: DataFrame, masks: DataFrame, params: DataFrame | None = None, seed: int = 0, steps_a_job: int = 100, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The same with a fixed mask (image_id, masked) and a random-phase start; n_cycles counts steps.

    The error is tested before each step, and a frame takes exactly n_cycles steps unless it falls below the
    target. The state is written, and the trace has a row, after every `steps_a_job` steps. A frame without a mask,
    or with one of another size, has NULL values and takes no step.
    """
    run = Run(frames.sparkSession, folder)
    arrays = ["mag", "g_re", "g_im", "masked"]

    def start() -> DataFrame:
        given = masks.select("image_id", F.transform("masked", lambda m: m.cast("double")).alias("masked"))
        resolved = resolve_params(frames, params).join(given, "image_id", "left")
        phased = spectral.random_phase(resolved, seed)
        return _state(phased.withColumnsRenamed({"re": "g_re", "im": "g_im"}), "g_re", "g_im", "masked")

    def turn(state: DataFrame, k: int) -> DataFrame:
        advance = lambda of, s, first, count: fixed_steps(of, s["mag"], s["g_re"] + 1j * s["g_im"], s["masked"].astype(bool), first, count)
        state = dealt(state, cost_of(F.col("n_cycles") - k * steps_a_job))
        return _job(state, k * steps_a_job, steps_a_job, advance, arrays)

    return _results(run_turns(run, start, turn, lambda s: -(-(s.agg(F.max("n_cycles")).first()[0] or 0) // steps_a_job)))
