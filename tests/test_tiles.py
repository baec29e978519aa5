import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.functions import arrays as A
from lumengrid.operators import layout, smooth, tiles


def frames(spark, shapes, seed=1):
    rng = np.random.default_rng(seed)
    data = {k: rng.normal(size=s) for k, s in enumerate(shapes)}
    rows = [(k, x.shape[0], x.shape[1], x.ravel().tolist(), 10 * k) for k, x in data.items()]
    return spark.createDataFrame(rows, "image_id long, height int, width int, values array<double>, tag int").repartition(3), data


SHAPES = [(8, 8), (5, 7), (1, 9), (6, 1), (1, 1), (12, 10)]


@pytest.mark.parametrize("size", [(3, 3), (1, 1), (4, 20), (50, 2)])
def test_tiles_and_back(spark, size):
    df, data = frames(spark, SHAPES)
    cut = tiles.split(df, tiles.grid(*size))
    assert cut.count() == sum(-(-h // size[0]) * -(-w // size[1]) for h, w in SHAPES)
    moved = tiles.regrid(cut, tiles.grid(2, 5))
    assert {(r.gh, r.gw, r.y0 % 2, r.x0 % 5, len(r["values"]) <= 10) for r in moved.collect()} == {(2, 5, 0, 0, True)}
    back = {r.image_id: r for r in tiles.to_frames(moved).collect()}
    assert all(np.array_equal(np.array(back[k]["values"]).reshape(x.shape), x) and back[k].tag == 10 * k for k, x in data.items())
    cells = {(r.image_id, r.iy, r.ix): r.v for r in tiles.to_pixels(moved).collect()}
    assert cells == {(k, y, x): v for k, a in data.items() for (y, x), v in np.ndenumerate(a)}


def test_tiles_from_cells(spark):
    df, data = frames(spark, SHAPES)
    out = tiles.from_pixels(layout.unpack(df), df, 3, 4)
    assert {(r.image_id, r.y0, r.x0): r["values"] for r in out.collect()} == {(r.image_id, r.y0, r.x0): r["values"] for r in tiles.split(df, tiles.grid(3, 4)).collect()}


@pytest.mark.parametrize("cells", [1, 16, 1 << 20])
@pytest.mark.parametrize("inverse", [False, True])
def test_transforms_match_numpy(spark, cells, inverse):
    df, data = frames(spark, SHAPES)
    other, more = frames(spark, SHAPES, 2)
    both = df.withColumnRenamed("values", "a").join(other.select("image_id", F.col("values").alias("b")), "image_id")
    cut = tiles.split(both, tiles.grid(4, 3), ("a", "b"))
    out = tiles.to_frames(tiles.dft2(cut, "a", "b", inverse, cells, back=True), "re", "im").collect()
    assert len(out) == len(data)
    for r in out:
        x = data[r.image_id] + 1j * more[r.image_id]
        wanted = np.fft.ifft2(x, norm="forward") if inverse else np.fft.fft2(x)
        assert np.allclose((np.array(r.re) + 1j * np.array(r.im)).reshape(x.shape), wanted, rtol=0, atol=1e-12 * x.size) and r.tag == 10 * r.image_id


def test_bands_need_one_exchange(spark):
    df, data = frames(spark, SHAPES)
    out = tiles.dft2(tiles.split(df, tiles.row_bands(16)), cells=16, banded=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = {r.image_id: r for r in tiles.to_frames(out, "re", "im").collect()}
    assert all(np.allclose(np.array(found[k].re).reshape(x.shape), np.fft.fft2(x).real) for k, x in data.items())


def numpy_blur(x, sigma, periodic, axes=(1, 0)):
    weights = np.array(A.gaussian_weights(sigma))
    half = len(weights) // 2
    for axis in axes:
        x = np.apply_along_axis(lambda v: np.convolve(np.pad(v, half, mode="wrap" if periodic else "edge"), weights, "valid"), axis, x)
    return x


@pytest.mark.parametrize("periodic", [False, True])
@pytest.mark.parametrize("sigma", [0.5, 1.5, 6.0, 15.0])
def test_smoothing_matches_numpy_with_kernels_wider_than_tiles(spark, sigma, periodic):
    df, data = frames(spark, SHAPES)
    found = {r.image_id: np.array(r["values"]) for r in tiles.to_frames(tiles.blur(tiles.split(df, tiles.grid(3, 3)), sigma, periodic=periodic)).collect()}
    assert all(np.allclose(found[k].reshape(x.shape), numpy_blur(x, sigma, periodic), rtol=0, atol=1e-12) for k, x in data.items())


def test_smoothing_of_bands_with_a_width_for_each_frame(spark):
    df, data = frames(spark, SHAPES)
    cut = tiles.split(df.withColumn("sigma", 0.5 + F.col("image_id") % 3), tiles.row_bands(16))
    found = {r.image_id: np.array(r["values"]) for r in tiles.to_frames(tiles.blur(cut, "sigma", whole_rows=True)).collect()}
    assert all(np.allclose(found[k].reshape(x.shape), numpy_blur(x, 0.5 + k % 3, False), rtol=0, atol=1e-12) for k, x in data.items())
    for axes, way in (("rows", (1,)), ("cols", (0,))):
        found = {r.image_id: np.array(r["values"]) for r in tiles.to_frames(tiles.blur(cut, 1.5, axes)).collect()}
        assert all(np.allclose(found[k].reshape(x.shape), numpy_blur(x, 1.5, False, way), rtol=0, atol=1e-12) for k, x in data.items())


def test_tiles_that_are_not_whole_make_null(spark):
    rows = [(0, 4, 4, [1.0] * 16), (1, 4, 4, [1.0] * 15 + [None]), (2, 4, 4, None), (3, None, 4, [1.0]), (4, 4, 4, [1.0] * 3)]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, values array<double>")
    cut = tiles.split(df, tiles.grid(2, 2))
    for out in (tiles.to_frames(tiles.blur(cut, 1.0)), tiles.to_frames(tiles.dft2(cut, cells=4), "re")):
        found = {r.image_id: r[-1] for r in out.collect()}
        assert found.keys() == {0, 1, 2, 4} and {k for k, v in found.items() if v is not None} == {0}
    holes = cut.where("image_id = 0 and (y0 > 0 or x0 > 0)")
    assert tiles.to_frames(holes).first()["values"] is None
    assert tiles.to_frames(tiles.blur(cut.limit(0), 1.0)).count() == 0


def test_a_frame_of_a_million_cells(spark):
    n = 1024
    shape = spark.range(1).select(F.col("id").alias("image_id"), F.lit(n).alias("height"), F.lit(n).alias("width"))
    cells = spark.range(n * n).select(F.lit(0).cast("long").alias("image_id"), F.floor(F.col("id") / n).cast("int").alias("iy"), (F.col("id") % n).cast("int").alias("ix"), F.sin(F.col("id") * 0.7).alias("v"))
    cut = tiles.from_pixels(cells, shape, 256, 256)
    x = np.sin(np.arange(n * n) * 0.7).reshape(n, n)

    def whole(df, name):
        out = np.full((n, n), np.nan)
        for r in df.collect():
            out[r.y0 : r.y0 + r.gh, r.x0 : r.x0 + r.gw] = np.array(r[name]).reshape(min(r.gh, n - r.y0), -1)
        return out

    assert np.allclose(whole(tiles.dft2(cut, cells=1 << 17), "re"), np.fft.fft2(x).real, atol=1e-6)
    assert np.allclose(whole(tiles.blur(cut, 3.0), "values"), numpy_blur(x, 3.0, False), atol=1e-12)
    assert whole(tiles.diffraction_magnitude(cut, 1 << 17), "values").max() == pytest.approx(np.abs(np.fft.fft2(x)).max())


def test_smoothing_keeps_invariants(spark):
    df, _ = frames(spark, [(9, 9)])
    after = tiles.to_frames(tiles.blur(tiles.split(df, tiles.grid(4, 4)), 2.0))
    assert tuple(smooth.smoothing_invariants(df, after).first())[1:] == (True, True, True)


def packed(n, seed=3):
    """Frames of two sizes, every seventh NULL and every eleventh with a NULL cell, as one batch of whole frames."""
    rng = np.random.default_rng(seed)
    shapes = [(8, 8) if k % 3 else (5, 7) for k in range(n)]
    cells = [None if k % 7 == 6 else rng.normal(size=h * w).tolist() for k, (h, w) in enumerate(shapes)]
    for k in range(10, n, 11):
        if cells[k]:
            cells[k][4] = None
    schema = T.StructType([T.StructField("image_id", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in tiles.KEY[1:]], T.StructField("tag", T.DoubleType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    places = [[k, h, w, h, w, 0, 0, k % 2 / 2] for k, (h, w) in enumerate(shapes)]
    columns = [pa.array(c, t) for c, t in zip(zip(*places, strict=True), [pa.int64(), *[pa.int32()] * 6, pa.float64()], strict=True)]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.list_(pa.float64()))], names=schema.names)
    return tiles.Layout(schema), batch, {k: np.array(c).reshape(s) for k, (s, c) in enumerate(zip(shapes, cells, strict=True)) if c and None not in c}


def test_small_tiles_are_handled_in_stacks():
    layout, batch, _ = packed(600)
    assert len(list(layout.read(iter([batch])))) == 2 and len(list(layout.read(iter([batch]), "tag"))) == 4
    pieces = layout.write((p for t in layout.read(iter([batch])) for p in tiles._cut(t, (3, 3))), True)
    rows = pa.Table.from_batches(pieces).sort_by([("image_id", "ascending"), ("y0", "ascending"), ("x0", "ascending")])
    assert len(list(tiles._assembled(iter(rows.to_batches()), layout))) == 9 + 6


@pytest.mark.parametrize(("batch_cells", "stack_cells"), [(1 << 20, 1 << 17), (1, 1), (40, 50), (300, 200)])
def test_tiles_across_batches_and_stacks(monkeypatch, batch_cells, stack_cells):
    monkeypatch.setattr(tiles, "BATCH_CELLS", batch_cells)
    monkeypatch.setattr(tiles, "STACK_CELLS", stack_cells)
    layout, batch, data = packed(90)
    bands = [t for t in layout.write((p for t in layout.read(iter([batch])) for p in tiles._cut(t, (3, 3))), True)]
    shuffled = pa.Table.from_batches(bands).sort_by([("image_id", "ascending"), ("y0", "ascending"), ("x0", "ascending")])
    small = tiles._assembled(iter(shuffled.to_batches(5)), layout)
    back = pa.Table.from_batches(layout.write((p for t in small for p in tiles._cut(t, (t.height, t.width))), True)).sort_by("image_id")
    found = {}
    for t in tiles._assembled(iter(back.to_batches(5)), layout):
        whole = t.arrays["values"][1] if t.arrays.get("values") else np.zeros(len(t.image), bool)
        for k, image in enumerate(t.image.to_pylist()):
            assert image not in found and t.scalars["tag"][k].as_py() == image % 2 / 2
            found[image] = t.arrays["values"][0][k] if whole[k] else None
    assert found.keys() == set(range(90))
    assert {k for k, x in found.items() if x is not None} == data.keys() and all(np.array_equal(found[k], x) for k, x in data.items())
