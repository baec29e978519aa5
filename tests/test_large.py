import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.operators import generate, large, retrieve, spectral, tiles
from test_retrieve import shapes


def magnitudes(spark):
    small = generate.circular_section(shapes(spark, 2, 24, 32), 0.2, 0.4, 0.6, 0.3, 5.0)
    other = generate.rectangle(shapes(spark, 2, 15, 9), 0.4, 0.5).withColumn("image_id", F.col("image_id") + 2)
    return spectral.diffraction_magnitude(small.unionByName(other))


PARAMS = [(0, 3, 2, None), (1, 1, 3, None), (2, 2, 1, None), (3, 3, 2, 1e9)]
SCHEMA = "image_id long, n_cycles int, n_hio int, target_error double"


def test_a_run_on_tiles_agrees_with_one_on_packed_frames(spark):
    mags = magnitudes(spark)
    params = spark.createDataFrame(PARAMS, SCHEMA)
    wanted, wanted_trace = ({tuple(r)[:k]: r for r in df.collect()} for df, k in zip(retrieve.shrink_wrap(mags, params), (1, 2), strict=True))
    found, trace = large.shrink_wrap(tiles.split(mags, tiles.grid(7, 5)), params, cells=64)
    assert found.groupBy("image_id").count().where("count > 1").count() == 4
    for r in tiles.to_frames(found).collect():
        w = wanted[(r.image_id,)]
        assert np.allclose(r["values"], w["values"], rtol=0, atol=1e-8 * np.abs(w["values"]).max())
        assert (r.cycles, r.converged) == (w.cycles, w.converged) and r.error == pytest.approx(w.error)
    rows = {(r.image_id, r.cycle): r for r in trace.collect()}
    assert rows.keys() == wanted_trace.keys()
    for k, r in rows.items():
        assert tuple(r)[2:4] == pytest.approx(tuple(wanted_trace[k])[2:4]) and r.n_masked == wanted_trace[k].n_masked and r.total_error == pytest.approx(wanted_trace[k].total_error)


def test_a_broken_run_on_tiles_goes_on(spark, tmp_path, monkeypatch):
    mags = tiles.split(magnitudes(spark).where("image_id = 2"), tiles.row_bands(40))
    params = spark.createDataFrame(PARAMS[2:3], SCHEMA)
    wanted = large.shrink_wrap(mags, params, cells=40)[0].collect()
    take, calls = large.with_error, []

    def breaks(state):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return take(state)

    monkeypatch.setattr(large, "with_error", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        large.shrink_wrap(mags, params, f"{tmp_path}/run", cells=40)
    found, trace = large.shrink_wrap(mags, params, f"{tmp_path}/run", cells=40)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted)) and trace.where("image_id = 2").count() == 2


def test_a_step_has_two_exchanges(spark):
    mags = tiles.split(magnitudes(spark), tiles.col_bands(64)).withColumnRenamed("values", "mag")
    guess = tiles.split(magnitudes(spark).withColumns({"g_re": F.col("values"), "g_im": F.col("values"), "masked": F.transform("values", lambda v: F.lit(0.0)), "beta": F.lit(0.9)}), tiles.row_bands(64), ("g_re", "g_im", "masked"))
    out = large.hio_step(guess, mags, 64)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_frames_that_are_not_whole(spark):
    rows = [(0, 4, 4, [1.0] * 16), (1, 4, 4, [1.0] * 15 + [None])]
    cut = tiles.split(spark.createDataFrame(rows, "image_id long, height int, width int, values array<double>"), tiles.grid(2, 2))
    params = spark.createDataFrame([(k, 1, 1) for k in range(2)], "image_id long, n_cycles int, n_hio int")
    found = {r.image_id: r for r in tiles.to_frames(large.shrink_wrap(cut, params, cells=8)[0]).collect()}
    assert found[0]["values"] is not None and found[1]["values"] is None and found[1].error is None
