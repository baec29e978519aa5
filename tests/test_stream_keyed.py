import time

import pytest
from pyspark.sql import functions as F

from lumengrid.operators import generate, retrieve, spectral
from lumengrid.streaming import keyed
from test_retrieve import shapes


def test_a_slow_frame_does_not_hold_others(spark, tmp_path):
    frames = spectral.diffraction_magnitude(generate.rectangle(shapes(spark, 7, 8, 6), 0.4, 0.4)).select("image_id", "height", "width", "values").cache()
    params = spark.range(7).select(F.col("id").alias("image_id"), F.when(F.col("id") == 0, 24).otherwise(3).alias("n_cycles"), F.lit(2).alias("n_hio"))
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    frames.where("image_id < 4").coalesce(1).write.parquet(source)
    broken = frames.where("image_id = 1").select(F.lit(50).cast("long").alias("image_id"), "height", F.lit(9).alias("width"), "values")
    broken.write.mode("append").parquet(source)
    query = keyed.run_stream_keyed(spark, source, frames.schema, target, f"{tmp_path}/checkpoint", params, files=1, cycles_a_trigger=1)

    def found():
        try:
            return {r.image_id: r for r in spark.read.schema(f"image_id long, {keyed.OBJECTS}").parquet(target).collect()}
        except Exception:
            return {}

    began = time.time()
    while not {1, 2, 3, 50} <= found().keys() and time.time() - began < 90 and not query.exception():
        time.sleep(0.3)
    assert 0 not in found()
    frames.where("image_id >= 4").coalesce(1).write.mode("append").parquet(source)
    while not {4, 5, 6} <= found().keys() and time.time() - began < 150 and not query.exception():
        time.sleep(0.3)
    assert keyed.drain(query, 120)
    got = found()
    wanted = {r.image_id: r for r in retrieve.shrink_wrap(frames, params)[0].collect()}
    assert got.keys() == {*wanted, 50} and got[50]["values"] is None and got[50].cycles == 0
    for k, w in wanted.items():
        assert got[k].cycles == w.cycles and got[k]["values"] == pytest.approx(w["values"]) and got[k].converged == w.converged
