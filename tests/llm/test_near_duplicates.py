import collections
import re

import numpy as np
import pytest
from oracle import run_sql, same
from pyspark.sql import functions as F

from lumengrid.llm import components, embeddings, jaccard, queries
from lumengrid.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_reachable(n, pairs):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            label[a] = label[label[a]]
            a = label[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def brute_force(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    links = collections.Counter(x for p in pairs for x in p)
    return links, smallest_reachable(len(sets), pairs)


def check(spark, texts, **options):
    out = {r.id: r for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()}
    links, groups = brute_force(texts)
    assert len(out) == len(texts)
    for k in range(len(texts)):
        assert (out[k].n_links, out[k].group_id, out[k].kept) == (links[k], groups[k], groups[k] == k), k


def test_join_finds_every_link(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", " \n ", "one", "one", "one two three", "one two three"]
    for _ in range(20):
        base = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(5, 200)))]
        texts.append(" ".join(base))
        for changes in rng.integers(0, 8, 4):
            copy = list(base)
            for at in rng.integers(0, len(copy), changes):
                copy[at] = f"x{rng.integers(0, 99)}"
            texts.append("\n".join(copy))
    texts.append("long " + " ".join(f"v{k}" for k in range(30_000)))
    check(spark, texts)


def test_large_groups_in_crowded_nodes(spark):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        copy = list(base)
        copy[int(rng.integers(0, 120))] = f"x{k}"
        texts.append(" ".join(copy))
    for k in range(60):  # shared passages, far below the threshold, and a few links among them
        own = [f"p{k}_{x}" for x in range(80)]
        texts += [" ".join(base + own)] + [" ".join(base + own + ["more"])] * (k % 10 == 0)
    check(spark, texts + [" ".join(base)] * 60, crowd=16)


def boilerplate(n, seed=3):
    return [(k, " ".join([f"w{x}" for x in range(180)] + [f"d{seed}_{k}_{x}" for x in range(120)])) for k in range(n)]


def test_shared_boilerplate_makes_no_candidates(spark, monkeypatch):
    seen = []
    edges = jaccard.candidate_edges
    monkeypatch.setattr(jaccard, "candidate_edges", lambda *a, **k: seen.append(edges(*a, **k)) or seen[-1])
    docs = spark.createDataFrame(boilerplate(600), "doc_id long, text string")
    assert jaccard.join(docs, crowd=16).where("n_links > 0 or not kept").count() == 0
    assert seen[0].count() == 0


def test_trees_and_sketches():
    assert 97 < jaccard.more_trees(0.8, 288, 12, 0.999) < 300
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for shared in (500, 600, 800, 850):
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, 900 - shared, dtype=np.uint64)])
        found = jaccard.sketch_similarity([jaccard.sketch(a, 288)], [jaccard.sketch(b, 288)])[0]
        wanted = shared / (1800 - shared)
        assert abs(found - wanted) < 0.1
        assert jaccard.sketch_links(0.8)([jaccard.sketch(a, 288)], [jaccard.sketch(b, 288)])[0, 0] == (wanted >= 0.8)


def test_join_of_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.n_links, r.group_id) for r in out) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_join_agrees_with_sql(spark, sf_dir):
    same(queries.op5_ngram_jaccard(spark, sf_dir).toPandas(), run_sql(sf_dir, queries.OP5_SQL))


def test_prefix_is_shortened_until_the_recall():
    assert jaccard.prefix_length(0.8, 24, 0.999, 12) == 6
    assert jaccard.prefix_length(0.99, 24, 0.999, 12) == 12
    assert jaccard.prefix_length(0.5, 2, 0.999, 12) == 1


def test_join_of_the_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").orderBy("doc_id").collect()
    links, groups = brute_force([d.text for d in docs])
    out = {r.doc_id: r for r in queries.op5_ngram_jaccard(spark, sf_dir).collect()}
    for k, d in enumerate(docs):
        assert (out[d.doc_id].n_links, out[d.doc_id].group_id) == (links[k], docs[groups[k]].doc_id)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 700)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    wanted = smallest_reachable(700, pairs)
    assert found == {k: wanted[k] for k in {x for p in pairs if p[0] != p[1] for x in p}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vectors_agree_with_sql(spark, sf_dir):
    same(queries.op7_embedding_near_dedup(spark, sf_dir).toPandas(), run_sql(sf_dir, queries.OP7_SQL))


def test_columns_of_results_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 1, 2)], "doc_id long, text string, id long, group_id long")
    assert sorted(map(tuple, jaccard.join(docs).collect())) == [(1, 1, 1, 1, True), (2, 1, 1, 1, False)]
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0, 5), (2, [1.0, 2.0], 0, 5)], "vec_id long, embedding array<double>, label int, n_links int")
    assert sorted(map(tuple, embeddings.near_duplicates(rows).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_vectors_that_point_one_way(spark, monkeypatch):
    """Mean cosine about 0.83, so that buckets are crowded, with planted links."""
    seen = []
    edges = embeddings.candidate_edges
    monkeypatch.setattr(embeddings, "candidate_edges", lambda *a, **k: seen.append(edges(*a, **k)) or seen[-1])
    rng = np.random.default_rng(12)
    way = rng.normal(size=64)
    way /= np.linalg.norm(way)
    x = way + 0.45 * rng.normal(size=(500, 64)) / 8
    x[400:] = x[:100] + 0.06 * rng.normal(size=(100, 64)) / 8
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    assert 0.8 < cos.mean() < 0.86
    pairs = [(a, b) for a, b in zip(*np.nonzero(cos >= 0.98), strict=True) if b < a]
    assert len(pairs) >= 90
    links, groups = collections.Counter(x for p in pairs for x in p), smallest_reachable(len(rows), pairs)
    out = {r.id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), crowd=32).collect()}
    assert out == {k: (links[k], groups[k]) for k in range(len(rows))}
    assert seen[0].distinct().count() < 3 * len(pairs)


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(size=24)
            for noise in (0, 0, 0.05, 0.1, 0.15, 0.2):
                rows.append((k, (base + noise * rng.normal(size=24)).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 24, 0), (k + 2, [float("nan")] + [1.0] * 23, 0), (k + 3, [None] + [1.0] * 23, 0), (k + 4, [float("inf")] + [1.0] * 23, 0), (k + 5, [1.0, 2.0], 0), (k + 6, [2.0, 4.0], 0), (k + 7, [], 0)]
    out = {r.id: r for r in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert len(out) == len(rows)
    exact = {i: np.array(v, float) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = []
    for a in exact:
        for b in exact:
            if b < a and rows[a][2] == rows[b][2] and len(exact[a]) == len(exact[b]):
                x, y = exact[a], exact[b]
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                    pairs.append((a, b))
    links, groups = collections.Counter(x for p in pairs for x in p), smallest_reachable(len(rows), pairs)
    assert len(pairs) > 50
    for i in out:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (links[i], groups[i], groups[i] == i), i


def test_hot_vector_and_nothing(spark):
    rows = [(k, [1.0, 2.0, 3.0, 4.0], 5) for k in range(300)] + [(300, [1.0, 2.0, 3.0, 4.1], 5), (301, [1.0, 2.0, 3.0, 4.0], 6), (0, [1.0, 2.0, 3.0, 4.0], 5)]
    out = embeddings.near_duplicates(vectors(spark, rows)).collect()
    assert len(out) == 303 and sorted({(r.n_links, r.component_id) for r in out}) == [(0, 301), (301, 0)]
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def test_hadamard_is_orthogonal():
    h = embeddings.hadamard(np.eye(16))
    assert h @ h.T == pytest.approx(np.eye(16)) and h == pytest.approx(h.T)


def test_drifting_components_cost_what_their_links_do(spark, monkeypatch):
    """A long chain of texts, each near its neighbours only: comparisons grow with links, and none is lost or counted twice."""
    words = [f"w{k}" for k in range(4000)]
    step, size, n = 10, 200, 300
    rows = [(k, " ".join(words[k * step : k * step + size])) for k in range(n)]
    rows += [(n + k, " ".join(words[3500 + k : 3500 + k + 150])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted, compare = [], components.compare_blocks

    def counting(rows, linked, block=components.CROWD):
        if "centers" in rows.columns:
            sizes = rows.groupBy("component").count().collect()
            counted.append(sum(r["count"] * (r["count"] - 1) // 2 for r in sizes))
        return compare(rows, linked, block)

    monkeypatch.setattr(components, "compare_blocks", counting)
    got = {r.id: r for r in jaccard.join(docs).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    near = [[j for j in range(max(0, i - 40), min(len(rows), i + 41)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    assert all(got[i].n_links == len(near[i]) for i in range(len(rows)))
    assert {got[i].group_id for i in range(n)} == {0} and {got[i].group_id for i in range(n, n + 12)} == {n}
    links = sum(map(len, near)) // 2
    assert links > n and sum(counted) <= 10 * links
    sparse = components.link(spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 2), (9, 4), (8, 4), (7, 4), (6, 5), (5, 4), (10, 6), (11, 10), (12, 11)], "a long, b long"), lambda g: g.withColumn("weight", F.lit(1)).withColumn("payload", F.col("node").cast("binary")), lambda a, b: np.ones((len(a), len(b)), bool))
    found = {r.node: r.links for r in sparse[0].collect()}
    edges = [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 2), (9, 4), (8, 4), (7, 4), (6, 5), (5, 4), (10, 6), (11, 10), (12, 11)]
    stars = [{b} | {a for a, c in edges if c == b} for b in {b for _, b in edges}]
    pairs = {(x, y) for s in stars for x in s for y in s if x != y}
    assert found == {x: sum(p[0] == x for p in pairs) for x in {p[0] for p in pairs}}
