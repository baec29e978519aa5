import zlib

import numpy as np
import pytest
from oracle import run_sql, same

from lumengrid.llm import queries, sharding
from lumengrid.llm.common import materialise

DOCS = "doc_id long, text string, slot string"


def check(out, rows, shards):
    """Sizes and digests are right, slots have no gaps, and each cut is as near as whole rows allow."""
    assert len(out) == len(rows)
    wanted = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((-1 if i is None or i != i else int(i), s, c) for i, s, c in zip(out["id"], out["size"], out["text_crc32"], strict=True)) == wanted
    total, under = int(out["size"].sum()), 0
    for k in range(shards):
        part = out[out["shard"] == k]
        assert sorted(part["slot"]) == list(range(len(part)))
        assert abs(under - k * total / shards) <= max(s for _, s, _ in wanted) / 2
        under += int(part["size"].sum())
    assert under == total


def test_agrees_with_sql_and_reruns(spark, sf_dir):
    got = queries.op11_sharding(spark, sf_dir).toPandas()
    same(got, run_sql(sf_dir, queries.OP11_SQL))
    same(queries.op11_sharding(spark, sf_dir).toPandas(), got)


def test_hot_texts_repeated_rows_nulls_and_long_texts(spark):
    rows = [(k, "the same text", "x") for k in range(900)] + [(7, "a row again", "y")] * 300
    rows += [(k, f"text {k} " * (k % 13), None) for k in range(900, 1500)] + [(None, None, None), (2000, "", "z"), (2001, "ü" * 3000, "z"), (None, "the same text", "z")]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    for shards, pieces in ((8, 16), (3, 1), (1, 4)):
        check(sharding.assign(df, shards, pieces=pieces).toPandas(), rows, shards)
    with_text = sharding.assign(df, 4, carry=("text", "slot")).toPandas()
    assert list(with_text.columns) == [*sharding.RESULTS, "text"]
    assert {"the same text": 901, "a row again": 300}.items() <= with_text["text"].value_counts().to_dict().items()


def test_equal_texts_stand_together_and_in_order(spark):
    rows = [(k, f"text {k % 40}", None) for k in range(400)]
    out = sharding.assign(spark.createDataFrame(rows, DOCS), 2, carry=("text",)).toPandas().sort_values(["shard", "slot"])
    places = out.reset_index(drop=True).reset_index().groupby("text")["index"].agg(["min", "max"])
    assert (places["max"] - places["min"] == 9).all()
    assert all(list(g["id"]) == sorted(g["id"]) for _, g in out.groupby("text"))


def test_few_rows_one_row_and_none(spark):
    for n in (0, 1, 3):
        rows = [(k, "w" * k, None) for k in range(n)]
        out = sharding.assign(spark.createDataFrame(rows, DOCS), 8).toPandas()
        assert len(out) == n and set(out["shard"]) <= set(range(8))
        assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_a_row_larger_than_a_shard(spark):
    rows = [(k, "w", None) for k in range(20)] + [(20, "w" * 10_000, None)]
    out = sharding.assign(spark.createDataFrame(rows, DOCS), 4).toPandas()
    assert len(out) == 21 and out.groupby("shard")["slot"].agg(lambda s: sorted(s) == list(range(len(s)))).all()


def test_cuts_within_tolerance_take_fewer_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = materialise(sharding.keyed(spark.createDataFrame([(k, "w" * int(n), None) for k, n in enumerate(rng.integers(1, 90, 3000))], DOCS)))
    rounds, count = [], sharding._counts
    monkeypatch.setattr(sharding, "_counts", lambda *a: rounds.append(1) or count(*a))
    total = sum(r["size"] for r in rows.collect())
    for tolerance in (0.0, 0.2):
        found = sharding.cuts(rows, 6, 1, tolerance, probes=4)
        for k, c in enumerate(found, 1):
            assert abs(c.size - k * total / 6) <= max(tolerance * total / 6, 46)
            assert c.rows == sum(int.from_bytes(r.key, "big") < c.key for r in rows.collect())
        rounds.append(0)
    first = rounds.index(0)
    assert first > len(rounds) - first - 2


def test_files_hold_shards(spark, tmp_path):
    rows = [(k, f"text {k}", None) for k in range(50)]
    sharding.write(sharding.assign(spark.createDataFrame(rows, DOCS), 5, carry=("text",)), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").toPandas()
    assert sorted(back["text"]) == sorted(t for _, t, _ in rows) and set(back["shard"]) == set(range(5))
    with pytest.raises(Exception, match="already exists"):
        sharding.write(sharding.assign(spark.createDataFrame(rows, DOCS), 5), f"{tmp_path}/out")
