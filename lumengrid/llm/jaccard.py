"""Similarity join of documents by the Jaccard index of their word n-grams, over a MinHash LSH forest.

Documents with the same set of n-grams form a class, and one of them stands for it. A class has a
sketch: `trees` strings of `longest` MinHash bytes, the keys of as many prefix tries. The matched prefix is
shortened from `longest` until the chance that a pair at the threshold shares one in some tree reaches
`recall`, but not in a crowded node of a trie with many unlike its hub: its classes keep the whole length,
in as many more trees (other choices among the same bytes) as that takes to the same recall.
Whoever meets is compared by sketches, and only pairs that may reach the threshold give candidate
edges. Those who met are then compared exactly, or all pairs of a component of edges where that is less work.

A text of fewer than n words has one n-gram of all its words; a null text or one without words has
none, links with nothing and stays. Very long texts are read whole. Rows that repeat an id share its
verdict; of equal texts the smallest id stands for the class. An empty table gives an empty result.
Only the id and the text are read, so that other columns may have any name.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.llm.common import WORD, join_split, map_text, materialise
from lumengrid.llm.components import CROWD, candidate_edges, link

_WORD = re.compile(WORD)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """64-bit hashes of words, kept for up to `entries` words."""

    def __init__(self, entries: int = 150_000):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> int:
        if len(self) >= self.entries:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


def shingles(text: str | None, n: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words."""
    words = _WORD.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    mixed = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : k + len(mixed)]) * _M1
        mixed ^= mixed >> np.uint64(29)
    mixed *= _M2
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def prefix_length(threshold: float, trees: int, recall: float, longest: int) -> int:
    """Shorten the matched prefix until a pair at the threshold meets in some tree with chance `recall`."""
    length = longest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def more_trees(threshold: float, values: int, length: int, recall: float) -> int:
    """Trees over random choices of `length` among the same `values` until that recall, with prefixes kept long.

    Summed over how many of the values a pair at the threshold has in common.
    """
    at = np.arange(values + 1)
    log_choose = np.array([math.lgamma(values + 1) - math.lgamma(k + 1) - math.lgamma(values - k + 1) for k in at])
    chance = np.exp(log_choose + at * math.log(threshold) + (values - at) * math.log1p(-threshold))
    one = np.array([math.prod((m - i) / (values - i) for i in range(length)) if m >= length else 0.0 for m in at])
    trees = 1
    while chance @ (1 - one) ** trees > 1 - recall:
        trees += 1
    return trees


@lru_cache(maxsize=4)
def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_011)
    return random.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), random.integers(0, 1 << 32, count, dtype=np.uint32)


def sketch(items: np.ndarray, count: int) -> bytes:
    """`count` MinHash values, one byte of each."""
    a, b = _family(count)
    items = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(items), 512):
        np.minimum(least, (items[at : at + 512, None] * a + b).min(0), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _matrix(payloads: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1)


def _jaccard(equal: np.ndarray) -> np.ndarray:
    """Estimated Jaccard index from the share of equal bytes, of which 1 in 256 is equal by chance."""
    return (equal - 1 / 256) / (1 - 1 / 256)


def sketch_similarity(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Estimated Jaccard index of each left sketch and the right one beside it."""
    return _jaccard((_matrix(left) == _matrix(right)).mean(1))


#: Standard deviations below the threshold down to which an estimate doesn't rule out a pair.
DEVIATIONS = 4.3


def sketch_cut(threshold: float, values: int) -> float:
    return threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / values)


def sketch_links(threshold: float):
    """The boolean matrix of pairs whose sketches don't rule out the threshold.

    One bit of each value is compared first, then the bytes of the pairs that this leaves.
    """

    def linked(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = _matrix(left), _matrix(right)
        values = a.shape[1]
        bits = [np.pad(p := np.packbits(x & 1, axis=1), ((0, 0), (0, -p.shape[1] % 8))).view(np.uint64) for x in (a, b)]
        unequal = np.zeros((len(a), len(b)), np.uint16)
        for word in range(bits[0].shape[1]):
            unequal += np.bitwise_count(bits[0][:, word][:, None] ^ bits[1][:, word][None, :])
        agree = (1 + threshold) / 2
        match = 1 - unequal / values >= agree - DEVIATIONS * math.sqrt(agree * (1 - agree) / values)
        cut = sketch_cut(threshold, values)
        rows, columns = np.nonzero(match)
        for at in range(0, len(rows), 1 << 16):
            i, j = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
            match[i, j] = _jaccard((a[i] == b[j]).mean(1)) >= cut
        return match

    return linked


def jaccard_links(threshold: float):
    """The boolean matrix of pairs whose Jaccard index is at least `threshold`."""

    def linked(left: list[bytes], right: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(p, np.uint64) for p in left], [np.frombuffer(p, np.uint64) for p in right]
        sizes = [np.array([len(s) for s in side]) for side in sets]
        # Only n-grams on both sides count; they are numbered and multiplied as 0/1 columns, a part at a time.
        flat = [np.concatenate(side) for side in sets]
        shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True) if left is not right else np.unique(flat[0])
        common = np.zeros((len(left), len(right)), np.float32)
        place = []
        for side, items in zip(sizes, flat, strict=True):
            row = np.repeat(np.arange(len(side)), side)
            column = np.searchsorted(shared, items)
            hit = column < len(shared)
            hit[hit] = shared[column[hit]] == items[hit]
            row, column = row[hit], column[hit]
            order = np.argsort(column, kind="stable")
            place.append((row[order], column[order]))
        width = max(256, min(len(shared), (4 << 20) // max(1, len(left) + len(right))))
        for at in range(0, len(shared), width):
            parts = []
            for side, (row, column) in zip(sizes, place, strict=True):
                lo, hi = np.searchsorted(column, [at, at + width])
                part = np.zeros((len(side), min(width, len(shared) - at)), np.float32)
                part[row[lo:hi], column[lo:hi] - at] = 1
                parts.append(part)
            common += parts[0] @ parts[1].T
        common = common.astype(np.float64)
        union = sizes[0][:, None] + sizes[1][None, :] - common
        return common >= threshold * union

    return linked


def signer(n: int, values: int):
    """Makes a function from texts to the digests of their sets of n-grams, and their sketches (null if empty)."""
    hashes = _WordHashes()

    def run(texts: list) -> list:
        sets = [shingles(t, n, hashes) for t in texts]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [digests, [sketch(s, values) if len(s) else None for s in sets]]

    return run


def whole_prefixes(sketches: DataFrame, trees: int, length: int) -> DataFrame:
    """(key, node): the nodes of tries over random choices of `length` bytes, matched whole."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data = _matrix(batch.column(1).to_pylist())
            random = np.random.default_rng(30_011)
            for tree in range(trees):
                chosen = np.ascontiguousarray(data[:, np.sort(random.choice(data.shape[1], length, replace=False))])
                keys = [xxhash.xxh3_64_digest(row, seed=tree) for row in chosen]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "node"])

    return sketches.select("node", "payload").mapInArrow(run, "key binary, node long")


def join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    trees: int = 24,
    longest: int = 12,
    crowd: int = CROWD,
) -> DataFrame:
    """One row per document: id, class_id, n_links, group_id and kept.

    class_id is the smallest id with the same set of n-grams, n_links counts the other documents at the
    threshold or above, group_id is the smallest id that links reach, and kept is id = group_id.
    """
    length = prefix_length(threshold, trees, recall, longest)

    docs = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    signed = materialise(map_text(docs, "text", lambda: signer(n, trees * longest), [("digest", T.BinaryType()), ("payload", T.BinaryType())], ["id"]))
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("payload").alias("payload"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))
    prefixes = F.array(*[F.concat(F.lit(bytes([t])), F.substring("payload", t * longest + 1, length)) for t in range(trees)])
    candidates = candidate_edges(
        classes.select(F.explode(prefixes).alias("key"), "node"),
        classes.select("node", "payload"),
        sketch_links(threshold),
        sketch_similarity,
        sketch_cut(threshold, trees * longest),
        lambda sketches: whole_prefixes(sketches, more_trees(threshold, trees * longest, longest, recall), longest),
        crowd,
    )

    def rows_of(found: DataFrame) -> DataFrame:
        wanted = materialise(found.join(classes.select("node", "digest", "class_id", F.col("copies").alias("weight")), "node"))
        # One plan at every size: the texts of candidates are fetched by a sort-merge join.
        texts = docs.join(wanted.hint("merge"), docs["id"].eqNullSafe(wanted["class_id"]))

        def sets():
            hashes = _WordHashes()

            def run(texts: list) -> list:
                made = [shingles(t, n, hashes).tobytes() for t in texts]
                return [made, [xxhash.xxh3_128_digest(m) for m in made]]

            return run

        carry = ["groups", "node", "weight", "digest"]
        made = map_text(texts, "text", sets, [("payload", T.BinaryType()), ("made", T.BinaryType())], carry)
        return made.where("made = digest").drop("made", "digest")

    links, groups = link(candidates, rows_of, jaccard_links(threshold), crowd)
    known = classes.select("digest", "class_id", "copies", "node").join(links, "node", "left").join(groups, "node", "left")
    known = materialise(known.withColumn("component", F.coalesce("component", "node")))
    least = known.groupBy("component").agg(F.min("class_id").alias("group_id"))
    known = materialise(known.join(least, "component").select("digest", "class_id", "group_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    named = signed.where("digest is not null").select("id", "digest")
    out = join_split(named, known, ["digest"]).select("id", "class_id", "n_links", "group_id", F.col("group_id").eqNullSafe(F.col("id")).alias("kept"))
    alone = signed.where("digest is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("group_id"), F.lit(True).alias("kept"))
    return out.unionAll(alone)
