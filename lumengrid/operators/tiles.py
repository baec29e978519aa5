"""Frames cut into tiles, for frames that don't fit in a row or a task.

A tile is a row: image_id, height and width of the frame, gh and gw (the grid's tile size), y0 and x0 (the tile's
first cell), any scalars of the frame, and arrays of doubles in row-major order. Tiles at the right and lower edge
are smaller. Bands of whole rows (x0 = 0, gw = width) and of whole columns are tilings like any other, and a grid's
size may depend on the frame.

Nothing holds a frame: a tile is cut along the lines of the tiles that need its cells, the pieces are dealt by the
key of the tile that they go to, and each task puts together one tile at a time from its sorted pieces. A transform
is two passes of one-dimensional transforms with one such exchange as the transposition between them; a smoothing
pass sends each tile's margins to the tiles around it, as far as the kernel reaches. An array of a tile that is
NULL, or of which a cell is missing, makes what depends on it NULL.

Small tiles are handled in stacks: those of a batch that have the same place in frames of the same size share one
`Tile`, whose arrays have them along the first axis. A stack has about STACK_CELLS cells, or one larger tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.functions import arrays as A

KEY = ["image_id", "height", "width", "gh", "gw", "y0", "x0"]
#: Cells of a band, if nothing else is asked for.
CELLS = 1 << 20
#: Cells of tiles that are handed on together.
BATCH_CELLS = 1 << 20
#: Cells of small tiles that are handled together.
STACK_CELLS = 1 << 17
#: Kernels longer than this are applied by transforms of each tile with its margins.
LONG_KERNEL = 64

Grid = Callable[[int, int], tuple[int, int]]
#: An array of a stack of tiles, (tiles, rows, columns), and which tiles have it whole; None where none has it.
Cells = tuple[np.ndarray, np.ndarray] | None


def grid(rows: int, cols: int) -> Grid:
    """Tiles of one size in all frames."""
    return lambda height, width: (rows, cols)


def row_bands(cells: int = CELLS) -> Grid:
    """As many whole rows as have `cells` cells, one at least."""
    return lambda height, width: (max(1, cells // width), width)


def col_bands(cells: int = CELLS) -> Grid:
    return lambda height, width: (height, max(1, cells // height))


@dataclass
class Tile:
    """A stack of tiles, or of pieces on their way to tiles: the key, of which all but the image is shared, scalars of the frames, and arrays."""

    image: pa.Array
    height: int
    width: int
    gh: int
    gw: int
    y0: int
    x0: int
    scalars: dict[str, pa.Array] = field(default_factory=dict)
    arrays: dict[str, Cells] = field(default_factory=dict)
    #: Of pieces: their first cell, which may lie outside of the frame where borders are periodic, and their shape.
    py: int = 0
    px: int = 0
    ph: int = 0
    pw: int = 0

    @property
    def rows(self) -> int:
        return min(self.gh, self.height - self.y0)

    @property
    def cols(self) -> int:
        return min(self.gw, self.width - self.x0)

    def to(self, gh: int, gw: int, y0: int, x0: int) -> Tile:
        return Tile(self.image, self.height, self.width, gh, gw, y0, x0, self.scalars)

    def with_arrays(self, **arrays: Cells) -> Tile:
        return Tile(self.image, self.height, self.width, self.gh, self.gw, self.y0, self.x0, self.scalars, arrays)

    def where(self, keep: np.ndarray) -> Tile:
        """Those tiles of the stack for which keep holds."""
        if keep.all():
            return self
        mask = pa.array(keep)
        out = Tile(self.image.filter(mask), self.height, self.width, self.gh, self.gw, self.y0, self.x0, {n: c.filter(mask) for n, c in self.scalars.items()})
        out.arrays = {n: None if a is None else (a[0][keep], a[1][keep]) for n, a in self.arrays.items()}
        return out


def _kinds(*columns: np.ndarray) -> list[np.ndarray]:
    """The rows of each distinct combination of whole numbers, in order."""
    wide = np.ascontiguousarray(np.stack(columns, axis=1).astype(np.int64))
    kind = np.unique(wide.view(np.dtype((np.void, wide.dtype.itemsize * wide.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where values are."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


class _Batch:
    """Columns of a batch of tiles or pieces: places as numbers, scalars, and arrays as cells with their limits."""

    def __init__(self, batch: pa.RecordBatch, layout: Layout, places: list[str]):
        at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        self.n, self.image = batch.num_rows, at["image_id"]
        self.places = {n: at[n].to_numpy(zero_copy_only=False) for n in places}
        self.scalars = {f.name: at[f.name] for f in layout.scalars if f.name in at}
        self._cells = {}
        for n in layout.arrays:
            if n in at:
                flat = at[n].flatten()
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(at[n]), 0).to_numpy(zero_copy_only=False))))
                whole = ~at[n].is_null().to_numpy(zero_copy_only=False)
                if flat.null_count:
                    whole[pc.list_parent_indices(at[n]).filter(flat.is_null()).to_numpy(zero_copy_only=False)] = False
                self._cells[n] = (flat.to_numpy(zero_copy_only=False), ends, whole)

    def names(self) -> list[str]:
        return list(self._cells)

    def cells(self, name: str, rows: np.ndarray, shape: tuple[int, int]) -> Cells:
        """An array of some rows (in order) as a stack; it is whole where it isn't NULL, holds none and has the cells of its shape."""
        flat, ends, fine = self._cells[name]
        size = shape[0] * shape[1]
        whole = fine[rows] & (ends[rows + 1] - ends[rows] == size)
        if not whole.any():
            return None
        if whole.all() and rows[-1] - rows[0] + 1 == len(rows):
            return flat[ends[rows[0]] : ends[rows[-1] + 1]].reshape(-1, *shape), whole
        out = np.zeros((len(rows), size))
        out[whole] = flat[ends[rows[whole]][:, None] + np.arange(size)]
        return out.reshape(-1, *shape), whole


def _is_array(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.ArrayType)


class Layout:
    """Which columns of a table of tiles are scalars and which arrays, and tiles from and to Arrow batches."""

    def __init__(self, schema: T.StructType, arrays: list[str] | None = None):
        own = {*KEY, "py", "px", "ph", "pw"}
        self.id_type = schema["image_id"].dataType
        self.scalars = [f for f in schema if f.name not in own and not _is_array(f)]
        self.arrays = arrays if arrays is not None else [f.name for f in schema if f.name not in own and _is_array(f)]

    def schema(self, pieces: bool = False) -> T.StructType:
        places = KEY[1:] + (["py", "px", "ph", "pw"] if pieces else [])
        fields = [T.StructField("image_id", self.id_type), *[T.StructField(n, T.IntegerType()) for n in places], *self.scalars]
        return T.StructType(fields + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in self.arrays])

    def read(self, batches: Iterator[pa.RecordBatch], by: str | None = None) -> Iterator[Tile]:
        """Stacks of tiles; those in one stack have the same scalar `by`."""
        for batch in batches:
            rows = _Batch(batch, self, KEY[1:])
            for kind in _kinds(*rows.places.values(), *([_codes(rows.scalars[by])] if by else [])):
                place = [int(rows.places[n][kind[0]]) for n in KEY[1:]]
                shape = Tile(rows.image, *place)
                step = max(1, STACK_CELLS // max(1, shape.rows * shape.cols))
                for k in range(0, len(kind), step):
                    part = kind[k : k + step]
                    tile = Tile(rows.image.take(pa.array(part)), *place, {n: c.take(pa.array(part)) for n, c in rows.scalars.items()})
                    tile.arrays = {n: rows.cells(n, part, (tile.rows, tile.cols)) for n in rows.names()}
                    yield tile

    def write(self, tiles: Iterator[Tile], pieces: bool = False) -> Iterator[pa.RecordBatch]:
        held: list[Tile] = []
        n = 0
        for tile in tiles:
            if not len(tile.image):
                continue
            held.append(tile)
            n += sum(a[0].size for a in tile.arrays.values() if a is not None) + 64 * len(tile.image)
            if n >= BATCH_CELLS:
                yield self._batch(held, pieces)
                held, n = [], 0
        if held:
            yield self._batch(held, pieces)

    def _batch(self, tiles: list[Tile], pieces: bool) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        sizes = [len(t.image) for t in tiles]
        columns = [pa.concat_arrays([t.image for t in tiles])]
        for n in [*KEY[1:], *(["py", "px", "ph", "pw"] if pieces else [])]:
            columns.append(pa.array(np.repeat(np.array([getattr(t, n) for t in tiles], np.int32), sizes)))
        for f in self.scalars:
            kind = to_arrow_type(f.dataType)
            columns.append(pa.concat_arrays([t.scalars[f.name].cast(kind) if f.name in t.scalars else pa.nulls(k, kind) for t, k in zip(tiles, sizes, strict=True)]))
        for n in self.arrays:
            parts = [t.arrays.get(n) for t in tiles]
            whole = np.concatenate([np.zeros(k, bool) if p is None else p[1] for p, k in zip(parts, sizes, strict=True)])
            lengths = np.concatenate([np.zeros(k, np.int64) if p is None else p[1] * (p[0].shape[1] * p[0].shape[2]) for p, k in zip(parts, sizes, strict=True)])
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = np.concatenate([(p[0] if p[1].all() else p[0][p[1]]).ravel() for p in parts if p is not None] or [np.empty(0)]).astype(np.float64, copy=False)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~whole)))
        return pa.RecordBatch.from_arrays(columns, names=self.schema(pieces).names)


def split(frames: DataFrame, to: Grid, arrays: tuple[str, ...] = ("values",)) -> DataFrame:
    """Tiles of packed frames; other columns are scalars. A frame without a shape has no tile, one that isn't whole NULL tiles."""
    own = T.StructType([f for f in frames.schema if f.name in arrays or not _is_array(f)])
    layout = Layout(own, list(arrays))
    rows = frames.where("height > 0 and width > 0").select("image_id", "height", "width", *[F.lit(0).alias(n) for n in KEY[3:]], *[f.name for f in layout.scalars], *arrays)
    rows = rows.withColumns({"gh": F.col("height"), "gw": F.col("width")})
    return _narrow(rows, layout, layout, lambda frame: _whole_tiles(frame, to))


def _whole_tiles(tile: Tile, to: Grid) -> Iterator[Tile]:
    for piece in _cut(tile, to(tile.height, tile.width)):
        yield piece.with_arrays(**piece.arrays)


def from_pixels(pixels: DataFrame, shapes: DataFrame, rows: int, cols: int) -> DataFrame:
    """Tiles of one size from cells (image_id, iy, ix, v) and (image_id, height, width); no frame is gathered."""
    at = lambda i, n: (F.col(i) - F.col(i) % n).cast("int")
    cells = F.sort_array(F.collect_list(F.struct("iy", "ix", "v")))
    tiles = pixels.groupBy("image_id", at("iy", rows).alias("y0"), at("ix", cols).alias("x0")).agg(F.transform(cells, lambda c: c["v"]).alias("values"))
    return tiles.join(shapes.select("image_id", "height", "width"), "image_id").select("image_id", "height", "width", F.lit(rows).alias("gh"), F.lit(cols).alias("gw"), "y0", "x0", "values")


def to_pixels(tiles: DataFrame, *arrays: str) -> DataFrame:
    """Cells (image_id, iy, ix and the arrays named, `values` as v)."""
    names = arrays or ("values",)
    cols = F.least(F.col("gw"), F.col("width") - F.col("x0"))
    cells = tiles.select("image_id", "y0", "x0", cols.alias("__n"), F.posexplode(F.arrays_zip(*names)).alias("__p", "__c"))
    iy, ix = F.col("y0") + F.floor(F.col("__p") / F.col("__n")).cast("int"), F.col("x0") + F.col("__p") % F.col("__n")
    return cells.select("image_id", iy.alias("iy"), ix.alias("ix"), *[F.col("__c")[n].alias("v" if n == "values" else n) for n in names])


def to_frames(tiles: DataFrame, *arrays: str) -> DataFrame:
    """Packed frames, for frames that fit in a row."""
    whole = regrid(tiles, lambda height, width: (height, width))
    return whole.drop("gh", "gw", "y0", "x0").select("image_id", "height", "width", *[c for c in whole.columns if c not in (*KEY, *arrays) and not _is_array(whole.schema[c])], *(arrays or ("values",)))


def regrid(tiles: DataFrame, to: Grid) -> DataFrame:
    """The same frames in other tiles, by one exchange."""
    layout = Layout(tiles.schema)
    pieces = _narrow(tiles, layout, layout, lambda t: _cut(t, to(t.height, t.width)), pieces=True)
    return gather(pieces, layout, layout, lambda t: iter([t]))


def _narrow(tiles: DataFrame, source: Layout, target: Layout, fn: Callable[[Tile], Iterator[Tile]], pieces: bool = False, by: str | None = None) -> DataFrame:
    return tiles.mapInArrow(lambda batches: target.write((out for t in source.read(batches, by) for out in fn(t)), pieces), target.schema(pieces))


def gather(pieces: DataFrame, source: Layout, target: Layout, fn: Callable[[Tile], Iterator[Tile]], out_pieces: bool = False, **assembly) -> DataFrame:
    """Exchange pieces by the tile that they go to, put tiles together and hand them to fn, which gives tiles or pieces."""
    dealt = pieces.repartition("image_id", "y0", "x0").sortWithinPartitions("image_id", "y0", "x0")
    return dealt.mapInArrow(lambda batches: target.write((out for t in _assembled(batches, source, **assembly) for out in fn(t)), out_pieces), target.schema(out_pieces))


def _cut(tile: Tile, size: tuple[int, int], reach: tuple[int, int] = (0, 0), periodic: bool = False) -> Iterator[Tile]:
    """The pieces of a tile that tiles of a grid need, each with `reach` cells around it."""
    for (y0, py, rows), (x0, px, cols) in ((a, b) for a in _spans(tile.y0, tile.rows, tile.height, size[0], reach[0], periodic) for b in _spans(tile.x0, tile.cols, tile.width, size[1], reach[1], periodic)):
        piece = tile.to(*size, y0, x0)
        piece.py, piece.px, piece.ph, piece.pw = py, px, rows.stop - rows.start, cols.stop - cols.start
        piece.arrays = {n: None if a is None else (a[0][:, rows, cols], a[1]) for n, a in tile.arrays.items()}
        yield piece


def _spans(start: int, n: int, size: int, step: int, reach: int, periodic: bool) -> Iterator[tuple[int, int, slice]]:
    """(first cell of a tile, first cell of a piece for it, slice) along one axis, for cells start .. start + n of `size`."""
    turns = range(-(-reach // size), reach // size + 2) if periodic and reach else range(1)
    turns = range(-turns.stop, turns.stop) if periodic and reach else turns
    for turn in turns:
        low = start + turn * size
        first = max(0, (low - reach) // step) if low > reach else 0
        for place in range(first * step, size, step):
            a, b = max(low, place - reach), min(low + n, min(place + step, size) + reach)
            if place - reach >= low + n:
                break
            if a < b:
                yield place, a, slice(a - low, b - low)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces in batches of about BATCH_CELLS cells, no tile in two of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < 8 * BATCH_CELLS or not batch.num_rows:
            continue
        keys = [_codes(batch.column(batch.schema.get_field_index(n))) for n in ("image_id", "y0", "x0")]
        others = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        if len(others):
            at = int(others[-1]) + 1
            yield pa.concat_batches([*held[:-1], batch.slice(0, at)])
            held = [batch.slice(at)]
            size = held[0].nbytes
    if held:
        yield pa.concat_batches(held)


def _assembled(batches: Iterator[pa.RecordBatch], layout: Layout, by: str | None = None, reach: Callable[[Tile], tuple[int, int]] | None = None, periodic: bool = False) -> Iterator[Tile]:
    """Stacks of tiles from pieces in the order of their tiles; with `reach` each array has so many cells more on each side."""
    for batch in _chunks(batches):
        rows = _Batch(batch, layout, [*KEY[1:], "py", "px", "ph", "pw"])
        if not rows.n:
            continue
        keys = [_codes(rows.image), rows.places["y0"], rows.places["x0"]]
        first = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        starts, number = np.flatnonzero(first), np.cumsum(first) - 1
        scalars = {n: _first_known(c, starts) for n, c in rows.scalars.items()}
        image = rows.image.take(pa.array(starts))
        kinds = _kinds(*[rows.places[n][starts] for n in KEY[1:]], *([_codes(scalars[by])] if by else []))
        kind_of = np.empty(len(starts), np.int64)
        for k, kind in enumerate(kinds):
            kind_of[kind] = k
        sent: list[list[np.ndarray]] = [[] for _ in kinds]
        for part in _kinds(kind_of[number], *[rows.places[n] for n in ("py", "px", "ph", "pw")]):
            sent[kind_of[number[part[0]]]].append(part)
        for kind, parts in zip(kinds, sent, strict=True):
            yield from _stacks(rows, kind, parts, number, starts, image, scalars, reach, periodic)


def _first_known(column: pa.Array, starts: np.ndarray) -> pa.Array:
    """Of each stretch of rows the first value that isn't NULL."""
    n = len(column)
    at = np.minimum.reduceat(np.where(column.is_null().to_numpy(zero_copy_only=False), n, np.arange(n)), starts)
    return column.take(pa.array(at, mask=at == n))


def _stacks(rows: _Batch, kind: np.ndarray, parts: list[np.ndarray], number: np.ndarray, starts: np.ndarray, image: pa.Array, scalars: dict, reach: Callable | None, periodic: bool) -> Iterator[Tile]:
    """Tiles of one kind, with their pieces of each kind."""
    place = [int(rows.places[n][starts[kind[0]]]) for n in KEY[1:]]

    def of(tiles: np.ndarray) -> Tile:
        return Tile(image.take(pa.array(tiles)), *place, {n: c.take(pa.array(tiles)) for n, c in scalars.items()})

    one = of(kind[:1])
    margin = reach(one) if reach else (0, 0)
    top, bottom, left, right = one.y0 - margin[0], one.y0 + one.rows + margin[0], one.x0 - margin[1], one.x0 + one.cols + margin[1]
    step = max(1, STACK_CELLS // max(1, (bottom - top) * (right - left)))
    if not periodic:
        top, bottom, left, right = max(0, top), min(one.height, bottom), max(0, left), min(one.width, right)
    for k in range(0, len(kind), step):
        tile = of(kind[k : k + step])
        n, counts = len(tile.image), {}
        for part in parts:
            low, high = np.searchsorted(number[part], kind[k]), np.searchsorted(number[part], kind[min(k + step, len(kind)) - 1], "right")
            if low == high:
                continue
            some = part[low:high]
            py, px, ph, pw = (int(rows.places[c][some[0]]) for c in ("py", "px", "ph", "pw"))
            to = np.searchsorted(kind[k : k + step], number[some])
            for name in rows.names():
                cells = rows.cells(name, some, (ph, pw))
                if cells is None:
                    continue
                if name not in counts:
                    tile.arrays[name], counts[name] = (np.zeros((n, bottom - top, right - left)), np.zeros(n, bool)), np.zeros(n, np.int64)
                here = cells[1]
                tile.arrays[name][0][to[here], py - top : py - top + ph, px - left : px - left + pw] = cells[0] if here.all() else cells[0][here]
                np.add.at(counts[name], to[here], ph * pw)
        for name, count in counts.items():
            tile.arrays[name][1][:] = count >= (bottom - top) * (right - left)
        if reach:
            _extend(tile, margin, periodic)
        yield tile


def _extend(tile: Tile, margin: tuple[int, int], periodic: bool) -> None:
    if periodic:
        return
    up, down = max(0, margin[0] - tile.y0), max(0, tile.y0 + tile.rows + margin[0] - tile.height)
    left, right = max(0, margin[1] - tile.x0), max(0, tile.x0 + tile.cols + margin[1] - tile.width)
    for n, a in tile.arrays.items():
        if a is not None:
            tile.arrays[n] = np.pad(a[0], ((0, 0), (up, down), (left, right)), mode="edge"), a[1]


# Smoothing


def convolve(cells: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along an axis of tiles (0: down, 1: across) that have half a kernel more on both sides (overlap-save for long kernels)."""
    axis -= 2
    n = cells.shape[axis] - len(weights) + 1
    if len(weights) > LONG_KERNEL:
        size = 1 << (cells.shape[axis] - 1).bit_length()
        shape = [1, 1]
        shape[axis] = -1
        spectrum = np.fft.rfft(cells, size, axis) * np.fft.rfft(weights[::-1], size).reshape(shape)
        return np.take(np.fft.irfft(spectrum, size, axis), range(len(weights) - 1, len(weights) - 1 + n), axis)
    parts = (cells[..., k : k + n, :] if axis == -2 else cells[..., k : k + n] for k in range(len(weights)))
    return sum(w * p for w, p in zip(weights, parts, strict=True))


def blur(tiles: DataFrame, sigma: float | str, axes: str = "both", periodic: bool = False, values: str = "values", whole_rows: bool = False) -> DataFrame:
    """Gaussian smoothing of one array, by rows, cols or both, with one sigma or that in a scalar column; other arrays go.

    One exchange for each direction, none for the rows of bands of whole rows. A kernel may be wider than a tile.
    """
    layout = Layout(tiles.schema, [values])
    weights: dict[float, np.ndarray] = {}
    by = sigma if isinstance(sigma, str) else None

    def kernel(tile: Tile) -> np.ndarray:
        s = tile.scalars[sigma][0].as_py() if by else sigma
        if s not in weights:
            weights[s] = np.array(A.gaussian_weights(s))
        return weights[s]

    def smoothed(tile: Tile, axis: int) -> Iterator[Tile]:
        a = tile.arrays.get(values)
        yield tile.with_arrays(**{values: None if a is None else (convolve(a[0], kernel(tile), axis), a[1])})

    def margin(tile: Tile, axis: int) -> tuple[int, int]:
        half = len(kernel(tile)) // 2
        return (half, 0) if axis == 0 else (0, half)

    def turned(tile: Tile) -> Iterator[Tile]:
        half = len(kernel(tile)) // 2
        if (a := tile.arrays[values]) is not None:
            tile.arrays[values] = np.pad(a[0], ((0, 0), (0, 0), (half, half)), mode="wrap" if periodic else "edge"), a[1]
        return smoothed(tile, 1)

    def one_way(df: DataFrame, axis: int) -> DataFrame:
        pieces = _narrow(df, layout, layout, lambda t: _cut(t, (t.gh, t.gw), margin(t, axis), periodic), pieces=True, by=by)
        return gather(pieces, layout, layout, lambda t: smoothed(t, axis), by=by, reach=lambda t: margin(t, axis), periodic=periodic)

    tiles = tiles.select(*layout.schema().names)
    if axes in ("rows", "both"):
        tiles = _narrow(tiles, layout, layout, turned, by=by) if whole_rows else one_way(tiles, 1)
    return one_way(tiles, 0) if axes in ("cols", "both") else tiles


# Transforms


def line_transform(re: Cells, im: Cells, axis: int, inverse: bool, real: bool = False) -> tuple[Cells, Cells]:
    """One-dimensional transforms of all lines along an axis (0: down, 1: across); the inverse has no factor 1 / N."""
    if re is None or im is None and not real:
        return None, None
    x, whole = (re[0], re[1]) if real else (re[0] + 1j * im[0], re[1] & im[1])
    y = np.fft.ifft(x, axis=axis - 2, norm="forward") if inverse else np.fft.fft(x, axis=axis - 2)
    return (y.real, whole), (y.imag, whole)


def dft2(tiles: DataFrame, re: str = "values", im: str | None = None, inverse: bool = False, cells: int = CELLS, banded: bool = False, back: bool = False) -> DataFrame:
    """re and im of the transform, in bands of whole columns, or of whole rows if `back`; im None means real frames.

    Bands have about `cells` cells. Tiles are first dealt to bands of whole rows, unless they are such (`banded`).
    The transposition is one exchange, and `back` another one.
    """
    names = [re] + ([im] if im else [])
    source = Layout(tiles.schema, names)
    target = Layout(T.StructType([f for f in tiles.schema if f.name in KEY or not _is_array(f)]), ["re", "im"])
    columns = col_bands(cells)

    def first(tile: Tile) -> Iterator[Tile]:
        y = line_transform(tile.arrays.get(re), tile.arrays.get(im) if im else None, 1, inverse, not im)
        return _cut(tile.with_arrays(re=y[0], im=y[1]), columns(tile.height, tile.width))

    def second(tile: Tile) -> Iterator[Tile]:
        y = line_transform(tile.arrays.get("re"), tile.arrays.get("im"), 0, inverse)
        out = tile.with_arrays(re=y[0], im=y[1])
        return _cut(out, row_bands(cells)(tile.height, tile.width)) if back else iter([out])

    tiles = tiles.select(*source.schema().names)
    if not banded:
        pieces = _narrow(tiles, source, source, lambda t: _cut(t, row_bands(cells)(t.height, t.width)), pieces=True)
        halves = gather(pieces, source, target, first, out_pieces=True)
    else:
        halves = _narrow(tiles, source, target, first, pieces=True)
    out = gather(halves, target, target, second, out_pieces=back)
    return gather(out, target, target, lambda t: iter([t])) if back else out


def diffraction_magnitude(tiles: DataFrame, cells: int = CELLS, banded: bool = False) -> DataFrame:
    """The magnitude of the transform, as values, in bands of whole columns."""
    out = dft2(tiles, cells=cells, banded=banded)
    return out.withColumn("values", F.zip_with("re", "im", lambda a, b: F.hypot(a, b))).drop("re", "im")


def autocorrelation_guess(tiles: DataFrame, cells: int = CELLS, banded: bool = False, back: bool = True) -> DataFrame:
    """The inverse transform of a magnitude: re and im of the first guess of the object, in bands of whole rows."""
    return dft2(tiles, inverse=True, cells=cells, banded=banded, back=back)
