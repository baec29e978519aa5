"""Connected components, comparison of all pairs of a group in blocks, and of what meets in hash buckets.

Near-duplicate search goes in two steps. `candidate_edges` compares whoever meets in a bucket of a hash
family, and gives edges only for pairs that are similar enough. `link` then compares exactly whoever has an
edge to the same node, or all pairs of a component of edges where that is less work. A bucket is never turned into pairs: a small one is
compared whole, once for all buckets with the same members; in a crowded one all are compared with its
hub, and only those unlike the hub with the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import discard, join_checked, materialise, small_batches

#: A bucket with more members is crowded; also the nodes in one side of a comparison.
CROWD = 512


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    Alternating large-star and small-star steps, until the edges are stars about the smallest nodes. The smallest
    neighbours are pre-aggregated, so that a hub with very many edges is joined (and may be split there), never
    gathered.
    """
    step = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    step = materialise(step)
    for _ in range(rounds):
        if _are_stars(step):
            break
        both = step.unionAll(step.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = materialise(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        to = large.join(least, "hi")
        small = to.select("hi", F.col("m").alias("lo")).unionAll(to.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct()
        before, step = step, materialise(small)
        discard(before)
        discard(large)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return step.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(step.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, which itself has none."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("lo", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or down = 1 and up = 1").isEmpty()


def compare_blocks(
    rows: DataFrame,
    linked: Callable[[list[bytes], list[bytes]], np.ndarray],
    block: int = CROWD,
) -> DataFrame:
    """Compare all pairs of nodes within each component exactly.

    `rows` has component, members (nodes in it), node, weight (rows that the node stands for),
    payload, and may have centers: all components of the node, where those overlap, so that a pair counts only in
    the first that it shares. A component is dealt by hash into blocks of about `block` nodes; every pair of blocks is
    one group of bounded size, and a node travels to as many groups as there are blocks. `linked`
    gives the boolean matrix of two lists of payloads. Returns (node, links, root) for each node with
    a link in a group: links is the weight it is linked to there, root the smallest node reached there.
    """
    small_batches(rows.sparkSession)
    n = F.ceil(F.col("members") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    centers = F.col("centers") if "centers" in rows.columns else F.lit(None).cast("array<long>")
    pairs = rows.select("component", "node", "weight", "payload", centers.alias("centers"), own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    pairs = pairs.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "weight", "payload", "centers")
    return compare_dealt(pairs, linked)


def compare_dealt(pairs: DataFrame, linked: Callable[[list[bytes], list[bytes]], np.ndarray]) -> DataFrame:
    """Compare the rows (component, i, j, own, node, weight, payload, centers) whose own is i with those whose own is j, in each group."""
    small_batches(pairs.sparkSession)
    if "centers" not in pairs.columns:
        pairs = pairs.withColumn("centers", F.lit(None).cast("array<long>"))
    dealt = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "own", "node")

    def finish(key: tuple, items: dict[tuple[int, int], tuple[int, bytes, list[int] | None]]) -> pa.RecordBatch | None:
        component, i, j = key
        left = [(n, *x) for (o, n), x in items.items() if o == i]
        right = left if i == j else [(n, *x) for (o, n), x in items.items() if o == j]
        if not left or not right or i == j and len(left) < 2:
            return None
        match = linked([x[2] for x in left], [x[2] for x in right])
        ln, rn = np.array([x[0] for x in left]), np.array([x[0] for x in right])
        lw, rw = np.array([x[1] for x in left]), np.array([x[1] for x in right])
        if i == j:
            match = match & ~np.eye(len(left), dtype=bool)
        if left[0][3]:
            match = match & ~_share_earlier(component, [x[3] for x in left], [x[3] for x in right])
        if not match.any():
            return None
        ll, rl = ln.copy(), (ln.copy() if i == j else rn.copy())
        top = np.iinfo(np.int64).max
        while True:  # smallest label over the links of this group
            to_left = np.minimum(ll, np.where(match, rl, top).min(1))
            to_right = np.minimum(rl, np.where(match, to_left[:, None], top).min(0))
            if i == j:
                to_left = to_right = np.minimum(to_left, to_right)
            if (to_left == ll).all() and (to_right == rl).all():
                break
            ll, rl = to_left, to_right
        out = [(ln, match @ rw, ll, match.any(1))]
        if i != j:
            out.append((rn, match.T @ lw, rl, match.any(0)))
        nodes, links, roots = (np.concatenate([x[k][x[3]] for x in out]) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (nodes, links, roots)], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = None, {}
        for batch in batches:
            for c, i, j, o, node, w, p, centers in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (c, i, j) != key:
                    if key and (out := finish(key, items)):
                        yield out
                    key, items = (c, i, j), {}
                items[o, node] = (w, p, centers)
        if key and (out := finish(key, items)):
            yield out

    return dealt.mapInArrow(run, "node long, links long, root long")


def _share_earlier(component: int, left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    """Whether two nodes share one of their components before this one."""
    earlier = {c for centers in left for c in centers if c < component} & {c for centers in right for c in centers if c < component}
    place = {c: k for k, c in enumerate(earlier)}
    sides = []
    for side in (left, right):
        has = np.zeros((len(side), len(place)), np.float32)
        for k, centers in enumerate(side):
            has[k, [place[c] for c in centers if c in place]] = 1
        sides.append(has)
    return sides[0] @ sides[1].T > 0


def bucket_links(buckets: DataFrame, payloads: DataFrame, linked: Callable, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) among the members of small buckets, and the members (key, node, c, hub) of crowded ones.

    `buckets` has key and node, and may have own, of which one must be true in a bucket that counts; `payloads` has
    node and payload. c is a bucket's size and hub its smallest node. The lists of small buckets have
    `crowd` nodes at most, and equal lists are compared once.
    """
    own = F.max("own") if "own" in buckets.columns else F.lit(True)
    shared = buckets.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("hub"), own.alias("own")).where("c > 1 and own").drop("own")
    members = materialise(buckets.select("key", "node").join(shared, "key"))
    lists = members.where(F.col("c") <= crowd).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes")).where(F.size("nodes") > 1)
    lists = materialise(lists.select("nodes").distinct().withColumn("component", F.monotonically_increasing_id()))
    rows = lists.select("component", F.size("nodes").alias("members"), F.explode("nodes").alias("node")).join(payloads, "node")
    found = compare_blocks(rows.withColumn("weight", F.lit(1)), linked, crowd)
    return materialise(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), members.where(F.col("c") > crowd)


def to_hub(crowded: DataFrame, payloads: DataFrame, similarity: Callable[[list[bytes], list[bytes]], np.ndarray]) -> DataFrame:
    """(node, hub, similarity) of members of crowded buckets: one comparison each."""
    pairs = crowded.select("node", "hub").distinct()
    hubs = materialise(payloads.join(pairs.select(F.col("hub").alias("node")).distinct(), "node").select(F.col("node").alias("hub"), F.col("payload").alias("other")))
    both = join_checked(pairs.join(payloads, "node"), hubs, ["hub"]).select("node", "hub", "payload", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = similarity(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["node", "hub", "similarity"])

    return materialise(both.mapInArrow(run, "node long, hub long, similarity double"))


def far_links(members: DataFrame, payloads: DataFrame, linked: Callable, block: int = CROWD) -> DataFrame:
    """Edges (a, b) between the far members of buckets and all others, in pairs of blocks.

    `members` has key, node, c, far and n_far; the groups on either side have about `block` nodes.
    """
    rows = members.join(payloads, "node").withColumn("weight", F.lit(1))
    n, n_far = F.ceil(F.col("c") / block).cast("int"), F.ceil(F.col("n_far") / block).cast("int")
    place = lambda size: F.pmod(F.xxhash64("node"), size).cast("int")
    one = rows.where("far").select(F.col("key").alias("component"), (-1 - place(n_far)).alias("i"), F.explode(F.sequence(F.lit(0), n - 1)).alias("j"), "node", "weight", "payload").withColumn("own", F.col("i"))
    other = rows.select(F.col("key").alias("component"), F.explode(F.sequence(-n_far, F.lit(-1))).alias("i"), place(n).alias("j"), "node", "weight", "payload").withColumn("own", F.col("j"))
    found = compare_dealt(one.unionByName(other).select("component", "i", "j", "own", "node", "weight", "payload"), linked)
    return materialise(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def candidate_edges(
    buckets: DataFrame,
    payloads: DataFrame,
    linked: Callable,
    similarity: Callable,
    near: float,
    finer: Callable[[DataFrame], DataFrame],
    crowd: int = CROWD,
) -> DataFrame:
    """Edges (a, b) whose components hold every pair of `linked` nodes that meets in a bucket.

    In a crowded bucket a member of similarity `near` to the hub gets an edge to it; two of those need no
    comparison, since one component has both. The others are far, and are compared with all members, if
    there are `crowd` or fewer. With more of them the bucket says little: its members meet again in
    the buckets of `finer` (their payloads), a family with the same recall whose buckets hold fewer by
    chance, and what is crowded and far there too is compared in blocks.
    """
    edges: list[DataFrame] = []
    for last in (False, True):
        found, crowded = bucket_links(buckets, payloads, linked, crowd)
        edges.append(found)
        if crowded.isEmpty():
            break
        measured = to_hub(crowded, payloads, similarity)
        edges.append(measured.where((F.col("similarity") >= near) & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b")))
        placed = crowded.join(measured, ["node", "hub"]).select("key", "node", "c", (F.col("similarity") < near).alias("far"))
        placed = materialise(placed)
        counts = materialise(placed.where("far").groupBy("key").agg(F.count("*").alias("n_far")))
        placed = materialise(join_checked(placed, counts, ["key"]))
        if placed.isEmpty():
            break
        many = F.lit(False) if last else F.col("n_far") > crowd
        edges.append(far_links(placed.where(~many), payloads, linked, crowd))
        loose = materialise(payloads.join(placed.where(many).select("node").distinct(), "node"))
        if last or loose.isEmpty():
            break
        buckets = finer(loose)
    return reduce(DataFrame.unionAll, edges)


def link(candidates: DataFrame, rows_of: Callable[[DataFrame], DataFrame], linked: Callable, block: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Exact links among candidate edges (a, b), b being the node that stands for those that met.

    Who met has an edge to the same b. So the nodes about each b are compared, and a pair that shares several only in
    the first: as many comparisons as there are meetings, however far a component drifts. Where that would be more
    than all pairs of the component, as among near copies that met in many ways, all its pairs are compared once.
    `rows_of` adds weight and payload to (node, groups). Returns (node, links) and (node, component) under the exact
    links, both materialised.
    """
    stars = materialise(candidates.select(F.col("a").alias("node"), F.col("b").alias("center")).unionAll(candidates.select("b", "b")).distinct())
    found = materialise(connected_components(candidates))
    around = materialise(stars.groupBy("center").agg(F.count("*").alias("members")))
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))
    work = around.join(found.withColumnRenamed("node", "center"), "center").groupBy("component").agg(F.sum(F.col("members") * F.col("members")).alias("work"))
    sizes = materialise(sizes.join(work, "component").withColumn("sparse", F.col("work") * 2 < F.col("members") * F.col("members")))
    found = found.join(sizes, "component")
    group = lambda c: F.struct(F.col(c).alias("component"), "members")
    whole = found.where("not sparse").select("node", F.array(group("component")).alias("groups"))
    parts = stars.join(found.where("sparse").select("node"), "node").join(around, "center")
    parts = parts.groupBy("node").agg(F.array_sort(F.collect_list(group("center"))).alias("groups"))
    rows = rows_of(materialise(whole.unionByName(parts)))
    rows = rows.withColumn("centers", F.transform("groups", lambda g: g["component"])).withColumn("group", F.explode("groups"))
    rows = rows.select("group.component", "group.members", "node", "weight", "payload", "centers")
    compared = materialise(compare_blocks(rows, linked, block))
    links = materialise(compared.groupBy("node").agg(F.sum("links").alias("links")))
    return links, materialise(connected_components(compared.select(F.col("node").alias("a"), F.col("root").alias("b"))))
