"""Near-duplicate embeddings by cross-polytope hashing with multiprobe and exact verification.

Equal vectors of one label form a class. Class vectors are rotated by three rounds of random signs
and a fast Hadamard transform; a hash function is the signed axis nearest to the rotated vector, and a
table's key joins several functions, as many as keep chance meetings within a label rare at the given
number of vectors. Each vector is also looked up under the keys in which functions give their second
nearest axis. Whoever meets in a bucket is compared exactly there. In a crowded bucket, as where all
vectors point one way, members are compared with the smallest one, and those that it isn't linked to with the
others; if these are many, all members are hashed again with as many functions as keys may join. Only
links found so give edges, and all pairs of the edges' components are then compared exactly, in blocks.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link
with nothing and stay. Vectors of different length do not link; long ones are only padded to a power
of two. Rows that repeat an id share its verdict; of equal vectors the smallest id stands for them. An
empty table gives an empty result. Only the three columns named are read, so that others may have any name.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.llm.common import join_split, materialise, small_batches
from lumengrid.llm.components import CROWD, candidate_edges, link


#: Functions that a key joins at most; a vector has 2 to the power of their number keys a table.
MOST_FUNCTIONS = 6


@lru_cache(maxsize=8)
def _signs(tables: int, functions: int, width: int) -> np.ndarray:
    return np.random.default_rng(40_009 + width).choice([-1.0, 1.0], (tables, functions, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(rows, width)
        step *= 2
    return x / math.sqrt(width)


def axes(x: np.ndarray, tables: int, functions: int) -> np.ndarray:
    """(rows, tables, functions, 2): the nearest and second nearest signed axis after each rotation."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = np.empty((len(x), tables, functions, 2), np.int64)
    signs = _signs(tables, functions, width)
    for t, f in product(range(tables), range(functions)):
        y = padded
        for s in signs[t, f]:
            y = hadamard(y * s)
        two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
        size = np.abs(np.take_along_axis(y, two, 1))
        two = np.where((size[:, 0] < size[:, 1])[:, None], two[:, ::-1], two)
        out[:, t, f] = 2 * two + (np.take_along_axis(y, two, 1) < 0)
    return out


def cosine_links(threshold: float):
    """The boolean matrix of pairs whose cosine, in double precision, is at least `threshold`."""

    def linked(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = (np.array([np.frombuffer(p, np.float64) for p in side]) for side in (left, right))
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        return (a @ b.T) / norms >= threshold

    return linked


@lru_cache(maxsize=64)
def meeting_chance(width: int, threshold: float, pairs: int = 2000) -> float:
    """Chance that the nearest axis of one vector is among the two nearest of another, at the threshold.

    Estimated from seeded pairs at that cosine, less three standard errors.
    """
    random = np.random.default_rng(70_001)
    x, z = random.normal(size=(2, pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(1 - threshold**2) * z
    share = float((axes(x, 1, 1)[..., :1] == axes(y, 1, 1)).any(-1).mean())
    return min(0.999, max(0.05, share - 3 * math.sqrt(share * (1 - share) / pairs)))


def plan(largest: int, width: int, threshold: float, miss: float = 1e-4, chance: float = 0.5, least: int = 1) -> tuple[int, int]:
    """(functions, tables): pairs at the threshold are missed with chance `miss` at most.

    With at least `least` functions, a vector meets fewer than `chance` others by chance among `largest`
    ones that point anywhere. Where the functions run out, as for very short vectors, buckets only get fuller.
    """
    meet = meeting_chance(width, threshold)
    for functions in range(least, MOST_FUNCTIONS + 1):
        tables = max(2, math.ceil(math.log(miss) / math.log(1 - meet**functions)))
        if 2 * tables * largest / width**functions <= chance:
            break
    return functions, tables


def cosine(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Cosine of each left vector and the right one beside it."""
    out = np.empty(len(left))
    for k, (p, q) in enumerate(zip(left, right, strict=True)):
        a, b = np.frombuffer(p), np.frombuffer(q)
        out[k] = a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b))
    return out


def buckets(classes: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """(key, node) of all keys of (node, label, payload): own ones and probes."""

    def run(batches):
        for batch in batches:
            nodes, payloads = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            labels = np.array([hash_label(x) for x in batch.column(1).to_pylist()])
            sizes = np.array([len(p) // 8 for p in payloads])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(payloads[k] for k in at)).reshape(-1, size)
                functions, tables = plans[int(size)]
                combos = np.array(list(product((0, 1), repeat=functions)))
                found = axes(x, tables, functions)
                key = np.repeat((labels[at] * np.int64(1_000_003) + size)[:, None, None], tables, 1) + np.arange(tables)[None, :, None]
                key = np.repeat(key, len(combos), 2)
                for f in range(functions):
                    key = (key ^ found[:, :, f, combos[:, f]]) * np.int64(-7046029254386353131)
                    key ^= key >> np.int64(29)
                shape = key.shape
                own = np.broadcast_to((combos.sum(1) == 0)[None, None, :], shape).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.broadcast_to(nodes[at][:, None, None], shape).ravel()), pa.array(own)], names=["key", "node", "own"])

    return classes.select("node", "label", "payload").mapInArrow(run, "key long, node long, own boolean")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, crowd: int = CROWD) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept, among vectors of equal label."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & fine, F.lit(False))
    classes = rows.where(valid).groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    small_batches(vectors.sparkSession, 200)
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()).mapInArrow(with_bytes, _with_payload(classes)))
    counts = classes.groupBy("label", F.size("v").alias("width")).agg(F.count("*").alias("n"))
    widths = counts.groupBy("width").agg(F.max("n").alias("n")).collect()  # one row for each length of vectors
    padded = {r["width"]: 1 << max(1, (r["width"] - 1).bit_length()) for r in widths}
    plans = {r["width"]: plan(r["n"], padded[r["width"]], threshold) for r in widths}
    finest = {r["width"]: plan(r["n"], padded[r["width"]], threshold, least=MOST_FUNCTIONS) for r in widths}
    hashed = materialise(classes.select("node", F.col("label").cast("string").alias("label"), "payload"))
    candidates = candidate_edges(
        buckets(hashed, plans),
        hashed.select("node", "payload"),
        cosine_links(threshold),
        cosine,
        threshold,
        lambda loose: buckets(hashed.join(loose.select("node"), "node", "left_semi"), finest),
        crowd,
    )

    def rows_of(found: DataFrame) -> DataFrame:
        return found.join(classes.select("node", "weight", "payload"), "node")

    links, groups = link(candidates, rows_of, cosine_links(threshold), crowd)
    known = classes.select("label", "v", "least", "weight", "node").join(links, "node", "left").join(groups, "node", "left")
    known = materialise(known.withColumn("component", F.coalesce("component", "node")))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select(F.col("label"), F.col("v"), "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = materialise(known)
    out = join_split(rows.where(valid), known, ["label", "v"]).select("id", "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
    alone = rows.where(~valid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionAll(alone)


def _with_payload(classes: DataFrame) -> T.StructType:
    return T.StructType([*classes.schema, T.StructField("node", T.LongType()), T.StructField("payload", T.BinaryType())])


def with_bytes(batches):
    """Add payload: the doubles of `v`, scaled by a power of two so that squares stay finite."""
    for batch in batches:
        v = batch.column(batch.schema.get_field_index("v"))
        payload = [np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes() for x in map(np.array, v.to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payload, pa.binary())], names=[*batch.schema.names, "payload"])


def hash_label(label: str) -> int:
    """A 64-bit hash of a label's text, the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(label.encode()) - (1 << 63)
