import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lumengrid.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, times=4):
    """Every period at every place, by comparing words; a period that a shorter one divides isn't the smallest."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any((i, length, d) in found for d in range(1, q)):
                smaller = [d for d in range(1, q) if q % d == 0 and all(words[k] == words[k + d] for k in range(i, i + length - d))]
                if not smaller:
                    found[i, length, q] = True
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    kind = rng.randrange(6)
    n = rng.randrange(0, 90)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(4) for _ in range(n)]
    if kind == 2:
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
        return [rng.randrange(3) for _ in range(rng.randrange(9))] + root * rng.randrange(1, 9) + root[: rng.randrange(len(root) + 1)] + [rng.randrange(3) for _ in range(rng.randrange(9))]
    if kind == 3:
        return [7] * n
    if kind == 4:
        out = []
        while len(out) < n:
            out += [rng.randrange(50) for _ in range(rng.randrange(6))] + [rng.randrange(50) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 7)
        return out
    a, b = [0], [0, 1]
    for _ in range(rng.randrange(1, 8)):
        a, b = b, b + a
    return b * rng.randrange(1, 5)


def test_runs_agree_with_comparing_all_places():
    rng = random.Random(4)
    for _ in range(1500):
        words = random_words(rng)
        assert periodic.runs(words) == plain_runs(words), words
        if words:
            assert periodic.runs_of(words, 2, 2) == plain_runs(words, 2, 2), words


def test_extensions_and_ranks_of_trees():
    rng = random.Random(5)
    for _ in range(200):
        x = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))]
        tree = periodic.SuffixTree(x)
        suffixes = sorted(range(len(x) + 1), key=lambda i: x[i:])
        assert tree.order == suffixes
        backwards = sorted(range(len(x) + 1), key=lambda i: [-v for v in x[i:]])
        ranks = tree.ranks(reverse=True)
        assert [ranks[i] for i in backwards] == list(range(len(x) + 1))
        i, j = (np.array(v) for v in zip(*[(i, j) for i in range(len(x)) for j in range(len(x)) if i != j], strict=True)) if len(x) > 1 else (np.array([], int), np.array([], int))
        for a, b, common in zip(i, j, tree.common(i, j), strict=True):
            k = 0
            while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            assert common == k


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, None if best[2] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def check(spark, tmp_path, rows, schema="doc_id long, text string, source string"):
    path = f"{tmp_path}/{len(rows)}"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, path)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted((expected(*r[:2]) for r in rows), key=order)


def test_query_agrees_with_plain_python(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{x}" for x in random_words(rng)), "s") for k in range(400)]
    rows += [(None, "a " * 9, None), (1000, None, "s"), (1001, "", "s"), (1002, " \n\t\x0b", "s"), (1003, "\x1cx\x85 ü " * 8, "s"), (1003, "\x1cx\x85 ü " * 8, "s")]
    rows += [(k, " ".join(str(rng.randrange(30)) for _ in range(rng.randrange(1, 200))), "s") for k in range(2000, 2200)]
    check(spark, tmp_path, rows)


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


def test_given_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 4000}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert all(got[k] == expected(k, t) for k, t in docs.items())
    assert sum(r[1] for r in got.values()) > 0


@pytest.mark.parametrize("shape", ["one word", "long root", "all different", "fibonacci"])
def test_long_texts(shape):
    a, b = ["x"], ["x", "y"]
    while len(b) < 20_000:
        a, b = b, b + a
    words = {"one word": ["x"] * 20_000, "long root": [str(k % 4000) for k in range(20_000)], "all different": [str(k) for k in range(50_000)], "fibonacci": b}[shape]
    found = periodic.runs(words)
    assert found == {"one word": [(0, 20_000, 1)], "long root": [(0, 20_000, 4000)], "all different": [], "fibonacci": []}[shape]


def test_ties_and_carried_columns(spark):
    rows = [(1, "a a a a a a b c c c c c c", 5, "mine")]
    row = periodic.detect(spark.createDataFrame(rows, "id long, text string, start long, words string"), carry=("id", "start", "words")).first()
    assert (row.start, row.length, row.period, row.exponent_milli, row.runs, row.collapsed, row.words) == (0, 6, 1, 6000, [[0, 6, 1], [7, 6, 1]], "a b c", "mine")
