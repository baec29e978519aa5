import collections
import math
import re

import numpy as np
import pytest
from oracle import run_sql, same
from pyspark.sql import functions as F

from lumengrid.llm import mixing, qualityrules, queries
from lumengrid.llm.common import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def reference_targets(sizes, share=1.5, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= above


def test_mix_agrees_with_sql_and_reruns(spark, sf_dir):
    got = queries.op1_mixing(spark, sf_dir).toPandas()
    same(got, run_sql(sf_dir, queries.OP1_SQL))
    same(queries.op1_mixing(spark, sf_dir).toPandas(), got)


def test_mix_of_odd_rows(spark):
    rows = [(k, "w " * (k % 9), "en", "ab"[k % 2] if k % 5 else None) for k in range(60)]
    rows += [(60, None, None, "a"), (None, "x y", "en", "c"), (7, "same same", "en", "a"), (7, "same same", "en", "a"), (61, "", "en", "empty"), (62, "v " * 5000, "en", "long")]
    out = mixing.mix(docs(spark, rows)).toPandas()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    wanted = reference_targets(sizes)
    assert sorted(out["size"]) == sorted(len(WORD.findall(t or "")) for _, t, _, _ in rows)
    for _, r in out.iterrows():
        source = None if r.source is None or r.source != r.source else r.source
        assert r.target == pytest.approx(wanted[source]) and r.source_size == sizes[source] and r.taken in (0, r["size"], 2 * r["size"])
    assert out.taken.sum() <= 1.5 * sum(sizes.values())


def test_mix_near_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * int(n), "en", f"s{k % 6}" if k % 3 else "hot") for k, n in enumerate(rng.integers(1, 40, 3000))]
    out = mixing.mix(docs(spark, rows)).toPandas().groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(out.taken - out.target) <= 0.03 * out.target).all()


def test_repeated_rows_queue_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 7)
    rows = [(5, "w " * 3, "en", "a")] * 40 + [(None, "w " * 4, "en", "a")] * 8 + [(k, "w " * (1 + k % 5), "en", "b") for k in range(60)]
    out = mixing.mix(docs(spark, rows)).toPandas()
    assert len(out) == len(rows) and sorted(out.id.fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in rows)
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), whole=("source_size", "first"))
    assert (by["size"] == by.whole).all() and (abs(by.taken - by.target) <= 8).all() and (out.taken <= 2 * out["size"]).all()


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(docs(spark, [(1, None, None, None), (2, " ", "en", "a")])).collect()} == {0}


def test_mixed_documents_repeat_whole_rows(spark):
    rows = docs(spark, [(k, "w " * 10, "en", "a" if k % 4 else "b") for k in range(40)]).withColumn("size", F.lit("own")).withColumn("copies", F.lit(9)).withColumn("__id", F.lit("own")).withColumn("__copy", F.lit(3))
    taken = {r.id: r.copies for r in mixing.mix(rows).collect()}
    out = collections.Counter(r.doc_id for r in mixing.mixed_documents(rows).collect())
    assert out == {k: n for k, n in taken.items() if n}
    assert mixing.mixed_documents(rows).columns == rows.columns


BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash(w[i], w[i + 1], w[i + 2])) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN r ON r.doc_id = l.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
"""


def word_statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = collections.Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_word_statistics(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x|y #1\n\nx|y #1\n z", "é ß ü \x1c q", "a b c d " * 4000, "a b c x a b c y b c x"]
    out = qualityrules.word_statistics(docs(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == word_statistics(texts[r.doc_id])


def robust(x):
    """Medians and deviations from the bins of the histograms."""
    bins = np.sign(x) * np.floor(np.abs(x) / 0.01 + 0.5)
    lower = lambda v: np.sort(v)[(len(v) - 1) // 2]
    median = np.apply_along_axis(lower, 0, bins)
    return median * 0.01, 1.4826 * 0.01 * np.apply_along_axis(lower, 0, np.abs(bins - median))


def reference_mcd(x, everything, steps=3, half=0.75):
    """The same estimate in NumPy."""
    floors = np.array(list(qualityrules.VECTOR.values()))
    prior_mean, prior_sd = robust(everything)

    def shrunk(n, mean, cov):
        w = n / (n + qualityrules.PRIOR_ROWS)
        return w * mean + (1 - w) * prior_mean, w * cov + (1 - w) * np.diag(prior_sd**2) + np.diag(floors**2)

    moments = lambda rows: shrunk(len(rows), rows.mean(0), np.cov(rows.T, bias=True) if len(rows) > 1 else np.zeros((5, 5)))
    distance = lambda mean, cov: np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)

    def step(mean, cov):
        bins = np.floor(16 * np.log2(1 + distance(mean, cov)))
        return moments(x[bins <= np.sort(bins)[math.ceil(half * len(x)) - 1]])

    median, sd = robust(x)
    z = np.cov(np.tanh((x - median) / (sd + floors)).T, bias=True) if len(x) > 1 else np.zeros((5, 5))
    root = np.sqrt(np.maximum(np.diag(z), 1e-12))
    models = [shrunk(len(x), median, np.diag(sd**2)), moments(x), shrunk(len(x), median, z / np.outer(root, root) * np.outer(sd, sd))]
    best = min((step(*step(*m)) for m in models), key=lambda m: np.linalg.slogdet(m[1])[1])
    for _ in range(steps):
        best = step(*best)
    trusted = x[distance(*best) / qualityrules.consistency(half) <= qualityrules.chi_squared(qualityrules.TRUSTED)]
    if not len(trusted):
        return distance(*best) / qualityrules.consistency(half)
    return distance(*moments(trusted)) / qualityrules.consistency(qualityrules.TRUSTED)


def prose(rng, n, junk=False):
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n)]
    return " ".join(w + ("###" if junk else "") for w in words)


def test_verdicts_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(k, prose(rng, int(rng.integers(60, 200)), junk=k % 10 == 0), "en" if k % 3 else "de", "hot" if k % 2 else "cold") for k in range(600)]
    rows += [(1000, None, None, None), (1001, "short", "en", "hot"), (1002, prose(rng, 80), None, "rare"), (1003, "a b c " * 50, "en", "hot")]
    out = {r.id: r for r in qualityrules.judge(docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    x = docs(spark, rows)
    stats = materialise(qualityrules.word_statistics(x, carry=("doc_id", "lang", "source")).withColumn("x", qualityrules.vector()))
    stats = stats.where(~qualityrules.base_failed()).toPandas()
    for (lang, source), group in stats.groupby(["lang", "source"], dropna=False):
        for i, d in zip(group.doc_id, reference_mcd(np.stack(group.x), np.stack(stats.x)), strict=True):
            assert out[i].distance == pytest.approx(d, rel=1e-6, abs=1e-9), (lang, source)
    assert not out[1000].kept and not out[1001].kept and out[1003].base_failed and not out[1003].kept
    assert out[1002].kept and out[1002].distance is not None
    assert all(out[k].kept == (k % 10 != 0) for k in range(600))


def test_chi_squared_and_consistency():
    assert qualityrules.chi_squared(0.5) == pytest.approx(4.3515, abs=1e-3) and qualityrules.chi_squared(0.975) == pytest.approx(12.8325, abs=1e-3) and qualityrules.chi_squared(0.95, 7) == pytest.approx(14.0671, abs=1e-3)
    assert qualityrules.consistency(0.75) == pytest.approx(1.412, abs=1e-3)


def test_a_small_group_is_judged_by_all(spark):
    rng = np.random.default_rng(5)
    rows = [(k, prose(rng, 90), "en", "hot") for k in range(200)] + [(500, prose(rng, 90, junk=True), "en", "own"), (501, prose(rng, 90), "en", "own")] + [(502, prose(rng, 90), "fr", None)] * 2
    wide = docs(spark, rows).withColumn("distance", F.lit("own")).withColumn("id", F.lit(0)).withColumn("group", F.lit(1)).withColumn("n_words", F.lit(1))
    out = collections.Counter((r.id, r.kept) for r in qualityrules.judge(wide).collect() if r.id >= 500 or not r.kept)
    assert out == {(500, False): 1, (501, True): 1, (502, True): 2}


def test_base_rules_agree_with_sql(spark, sf_dir):
    got = queries.op6_quality_rules(spark, sf_dir).drop("distance", "kept").toPandas()
    same(got, run_sql(sf_dir, BASE_SQL))


def test_rules_without_rows(spark):
    assert qualityrules.judge(docs(spark, [])).count() == 0
    repeated = qualityrules.judge(docs(spark, [(5, prose(np.random.default_rng(0), 60), "en", "a")] * 3)).collect()
    assert [r.kept for r in repeated] == [True] * 3
