import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.functions import arrays as A
from lumengrid.operators import layout, ordered, reduce, smooth

NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(k, h, w, v) for k, (h, w, v) in enumerate(rows)], "image_id long, height int, width int, values array<double>")


def value(spark, values, fn):
    return spark.createDataFrame([(values,)], "v array<double>").select(fn(F.col("v")).alias("x")).first()[0]


def test_planted_extremes(spark):
    rng = random.Random(7)
    values = [rng.uniform(-0.5, 0.5) for _ in range(999)]
    values[417], values[5] = 7.37519, -7.5
    assert value(spark, values, A.vector_max) == 7.37519
    assert value(spark, values, A.vector_min) == -7.5
    assert value(spark, values, A.vector_max_abs) == 7.5
    assert value(spark, [3.25], A.vector_max) == value(spark, [3.25], A.vector_sum) == 3.25


def test_nan_empty_and_null(spark):
    assert value(spark, [1.0, NAN, 3.0], A.vector_max) == 3.0
    assert value(spark, [1.0, NAN, 3.0], A.vector_min) == 1.0
    assert value(spark, [], A.vector_max) is None and value(spark, [], A.vector_sum) == 0.0 and value(spark, [], A.vector_max_abs) == 0.0
    assert value(spark, None, A.vector_max_abs) is None and value(spark, None, A.vector_sum) is None
    assert value(spark, [], A.mean) is None and value(spark, [1.0], A.stddev) is None


def test_masked_error_of_three_and_four(spark):
    rng = random.Random(3)
    masked = [rng.random() < 0.4 for _ in range(200)]
    norms = [5.0 if m else rng.random() for m in masked]
    df = spark.createDataFrame([(norms, masked)], "n array<double>, m array<boolean>")
    row = df.select(*A.masked_error(F.col("n"), F.col("m"))).first()
    assert row[0] == 5 * row[1] == 5 * sum(masked) and math.isclose(row[2], math.sqrt(row[0]) / row[1])
    nothing = df.select(*A.masked_error(F.col("n"), F.transform("m", lambda x: F.lit(False)))).first()
    assert tuple(nothing) == (0.0, 0, None)


def test_bits(spark):
    df = spark.createDataFrame([([0x33333333], 30)], "w array<bigint>, n int")
    bits = df.select(A.unpack_bits(F.col("w"), F.col("n"))).first()[0]
    assert bits == [bool(i // 2 % 2) for i in range(30)]
    again = df.select(A.pack_bits(A.unpack_bits(F.col("w"), F.lit(32)))).first()[0]
    assert again == [0x33333333]


@pytest.mark.parametrize("position, sizes, index", [(5, [2, 3], [1, 2]), (8, [1, 3, 6], [0, 1, 2]), (2, [1, 3, 1], [0, 2, 0]), (9, [10], [9])])
def test_index(spark, position, sizes, index):
    df = spark.createDataFrame([(position, sizes, index)], "p long, n array<int>, i array<int>")
    row = df.select(A.to_vector(F.col("p"), F.col("n")), A.to_linear(F.col("i"), F.col("n"))).first()
    assert row[0] == index and row[1] == position


@pytest.mark.parametrize("sigma, size", [(0.0, 1), (0.1, 1), (0.5, 3), (1.0, 7), (1.5, 9), (2.0, 13), (3.0, 19), (4.0, 25)])
def test_kernel(spark, sigma, size):
    weights = A.gaussian_weights(sigma)
    assert len(weights) == size and math.isclose(sum(weights), 1)
    row = spark.range(1).select(A.gaussian_kernel(F.lit(sigma))).first()[0]
    assert row == pytest.approx(weights, abs=1e-15)


def test_kernel_refuses_negative():
    with pytest.raises(ValueError):
        A.gaussian_weights(-1.0)


@pytest.mark.parametrize("sigma", [0.5, 1.3, 3.0])
def test_comb_gives_kernels_and_constants_stay(spark, sigma):
    kernel = A.gaussian_weights(sigma)
    half = len(kernel) // 2
    n = 3 * len(kernel)
    comb = [1.0 if i % len(kernel) == half else 0.0 for i in range(n)]
    rows = frame(spark, [(1, n, comb), (n, 1, comb), (4, 5, [7.37519] * 20)])
    out = {r.image_id: r["values"] for r in smooth.blur(rows, sigma).collect()}
    assert out[0] == pytest.approx(kernel * 3) and out[1] == pytest.approx(kernel * 3) and out[2] == pytest.approx([7.37519] * 20)


def test_blur_of_each_frame_and_invariants(spark):
    rng = random.Random(11)
    rows = frame(spark, [(6, 9, [rng.uniform(-0.5, 0.5) for _ in range(54)]) for _ in range(3)])
    out = smooth.blur(rows.withColumn("s", F.lit(1.0) + F.col("image_id")), F.col("s"))
    assert all(r.min_ok and r.max_ok and r.step_ok for r in smooth.smoothing_invariants(rows, out).collect())
    for k in range(3):
        one = smooth.blur(rows.where(F.col("image_id") == k), 1.0 + k).first()["values"]
        assert out.where(F.col("image_id") == k).first()["values"] == pytest.approx(one, abs=1e-13)


def test_pack_round_trip(spark):
    rows = frame(spark, [(2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (1, 1, [9.0])])
    again = layout.pack(layout.unpack(rows))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_quantise(spark):
    largest = F.lit(2.0)
    got = [spark.range(1).select(A.quantise16(F.lit(v), largest)).first()[0] for v in (2.0, 1.0, 0.0, -1.0, NAN, float("inf"))]
    assert got == [65535, 32768, 0, -32767, None, None]


def test_series(spark):
    rows = spark.createDataFrame([("a", t, v) for t, v in enumerate([1.0, 1.0, 1.0])] + [("b", 0, 5.0)], "k string, t int, v double")
    s = ordered.series(rows, "k", ["t"], "v")
    assert {r.series_id: (r.max_step, r.total_variation) for r in ordered.step_profile(s).collect()} == {"a": (0.0, 0.0), "b": (None, 0.0)}
    assert [r.v for r in ordered.blur_series(s, 3.0).where("series_id = 'a'").collect()] == pytest.approx([1.0] * 3)
    points = ordered.log_spaced(2, 50, 20)
    assert points == sorted(set(points)) and len(points) == 20 and points[0] == 2 and points[-1] == 50


def test_long_series_in_ranges_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 7)
    rng = random.Random(11)
    rows = [("hot", k, rng.uniform(-1, 1)) for k in range(200)] + [(None, k, float(k)) for k in range(9)] + [("one", 0, 4.0)] + [("tie", 1, 2.0)] * 15
    rng.shuffle(rows)
    s = ordered.series(spark.createDataFrame(rows, "k string, t int, v double").repartition(5), "k", ["t"], "v")
    found = {}
    for r in s.collect():
        found.setdefault(r.series_id, {})[r.pos] = r.v
    wanted = {key: [v for k, _, v in sorted((x for x in rows if x[0] == key), key=lambda x: x[1])] for key in ("hot", None, "one", "tie")}
    assert {key: [v[k] for k in range(len(v))] for key, v in found.items()} == wanted
    for r in ordered.step_profile(s).collect():
        v = wanted[r.series_id]
        steps = [abs(b - a) for a, b in zip(v, v[1:], strict=False)]
        assert r.max_step == (max(steps) if steps else None) and r.total_variation == pytest.approx(sum(steps))
    weights = A.gaussian_weights(1.5)
    for r in ordered.blur_series(s, 1.5).collect():
        v = wanted[r.series_id]
        assert r.v == pytest.approx(sum(w * v[max(0, min(len(v) - 1, r.pos + k - 4))] for k, w in enumerate(weights)))
    for r in ordered.prefix_profile(s, [1, 2, 50, 200, 201]).collect():
        v = wanted[r.series_id][: r.n]
        assert len(v) == r.n and (r.max, r.min) == (max(v), min(v)) and r.sum == pytest.approx(sum(v))
    for sigma in (9.0, 60.0):
        weights = A.gaussian_weights(sigma)
        half = len(weights) // 2
        for r in ordered.blur_series(s, sigma).collect():
            v = wanted[r.series_id]
            assert r.v == pytest.approx(sum(w * v[max(0, min(len(v) - 1, r.pos + k - half))] for k, w in enumerate(weights)))


def test_series_with_missing_values(spark):
    v = [1.0, None, 3.0, float("nan"), 5.0] + [2.0] * 100
    s = spark.createDataFrame([(0, k, x) for k, x in enumerate(v)], "series_id long, pos int, v double")
    for n in (3, 81):
        found = {r.pos: r.v for r in ordered.convolve_series(s, [1.0 / n] * n).collect()}
        near = lambda k, i: max(0, k - n // 2) <= i <= k + n // 2  # noqa: B023, E731
        assert all((found[k] is None) == near(k, 1) for k in range(105))
        assert all(math.isnan(found[k]) for k in range(105) if near(k, 3) and not near(k, 1)) and found[104] == pytest.approx(2.0)
    rows = {r.n: r for r in ordered.prefix_profile(s, [1, 2, 4, 5, 105]).collect()}
    assert (rows[2].max, rows[2].sum, rows[4].max, rows[5].max) == (1.0, 1.0, 3.0, 5.0) and math.isnan(rows[5].sum)


RETURNS = "n long, mean double, stddev double, largest double, final double"


def test_reductions_of_a_users_own(spark, monkeypatch):
    monkeypatch.setattr(reduce, "FAN", 2)
    rng = random.Random(12)
    rows = [("hot" if k % 3 == 0 else None if k % 50 == 1 else f"k{k % 40}", rng.uniform(-1, 1)) for k in range(5000)] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(9)
    found = {r.k: r for r in reduce.reduce_by_key(df, "k", ["v"], reduce.MOMENTS, RETURNS).collect()}
    assert found.keys() == {k for k, _ in rows}
    for k, r in found.items():
        v = [x for key, x in rows if key == k]
        assert r["n"] == len(v) and r["mean"] == pytest.approx(np.mean(v)) and r["largest"] == max(v)
        assert r["stddev"] == (pytest.approx(np.std(v, ddof=1)) if len(v) > 1 else None)
    assert reduce.reduce_by_key(df.limit(0), "k", ["v"], reduce.MOMENTS, RETURNS).count() == 0
    listed = reduce.Reduction(list, lambda s, k, v: s + [(a, b) for a, b in zip(k, v, strict=True)], lambda a, b: a + b, lambda s: len({a for a, _ in s}))
    few = reduce.reduce_by_key(df.withColumn("same", F.lit(1)), "same", ["k", "v"], listed, "distinct long").first()
    assert few.distinct == len({k for k, _ in rows})


def test_prefixes_of_a_users_own(spark, monkeypatch):
    monkeypatch.setattr(reduce, "CHUNK", 7)
    rng = random.Random(13)
    data = {"hot": [rng.uniform(-1, 1) for _ in range(300)], None: [1.0, 2.0, 3.0], "seven": [float(k) for k in range(7)], "one": [5.0]}
    rows = [(key, k, x) for key, v in data.items() for k, x in enumerate(v)]
    s = spark.createDataFrame(rows, "series_id string, pos int, v double").repartition(5)
    points = [1, 2, 3, 7, 8, 14, 21, 22, 150, 300, 301, *range(40, 60)]
    found = {(r.series_id, r.n): r for r in reduce.reduce_prefixes(s, points, reduce.MOMENTS, RETURNS.replace("n long", "size long")).collect()}
    assert found.keys() == {(key, n) for key, v in data.items() for n in points if n <= len(v)}
    for (key, n), r in found.items():
        v = data[key][:n]
        assert r["size"] == n and r["mean"] == pytest.approx(np.mean(v)) and r["final"] == v[-1] and r["largest"] == max(v)
