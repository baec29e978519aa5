import hashlib
import itertools
import random
import re

import pytest
from oracle import run_sql, same

from lumengrid.llm import dialogue, queries

TURNS = "conv_id long, turn long, role string, text string"


def cheapest(codes):
    """Least (cost, edits) by trying, after each turn, every edit in every state that a repaired text can be in."""
    best = {0: (0, "")}

    def insertions(best):
        for _ in range(3):
            for q, (cost, edits) in list(best.items()):
                to = 3 if q == 2 else 2
                best[to] = min(best.get(to, (1e9, "")), (cost + 2, edits + "I"))
        return best

    for code in codes:
        new = {}
        for q, (cost, edits) in insertions(best).items():
            ways = [(q, 3, "D")]
            if code < dialogue.BLANK:
                cut, initial = code // 4, code % 4
                to = 3 if q == 2 else 2
                ways.append((to, cut, "K") if initial == to - 1 else (to, cut + 2, "R"))
                if q == 0 and initial == 0:
                    ways.append((1, cut, "K"))
            for to, more, edit in ways:
                new[to] = min(new.get(to, (1e9, "")), (cost + more, edits + edit))
        best = new
    best = insertions(best)
    return min(best[q] for q in (0, 3) if q in best)


def test_alignments_agree_with_trying_everything():
    rng = random.Random(2)
    codes = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 17, 18]
    short = [list(c) for n in range(4) for c in itertools.product(codes, repeat=n)]
    long = [[rng.choice(codes) for _ in range(rng.randrange(1, 40))] for _ in range(300)] + [[1] * 60, [2] * 60, [0] * 30 + [1, 2], [8] * 50, [1, 2] * 40]
    for turns in short + long:
        cost, edits, _ = dialogue.Alignment(turns).trace()
        assert (cost, edits) == cheapest(turns), turns


def rows_of(convs):
    return [(c, t, r, x) for c, turns in convs.items() for t, r, x in turns]


def expected(turns):
    """The contract in plain Python: turns are (turn, role, text), in order."""
    seen, codes, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in turns:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        code = dialogue.INITIALS.find(role[:1]) if role else 3
        code = 3 if code < 0 else code
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
            code += {"blank": 8, "duplicate": 16, "truncated": 4}[fault]
        codes.append(code)
    cost, edits = cheapest(codes)
    numbers = [t for t, *_ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
    out, said, at = [], 0, 0
    for e in edits:
        role = ("user", "assistant")[said % 2]
        if e == "I":
            out.append(f"{role}:")
            said += 1
            continue
        _, own, text = turns[at]
        at += 1
        if e != "D":
            out.append(f"{own if e == 'K' else role}:{text}")
            said += not (e == "K" and own[:1] == "s")
    return dict(gaps=gaps, **counts, illegal=sum(p not in ("su", "ua", "au") for p in pairs), cost=cost, audit=edits, repaired_sha256=hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, n=60, longest=25):
    rng = random.Random(seed)
    convs = {}
    for c in range(n):
        turns = []
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "s"])
            text = rng.choice(["Yes.", "No!", "why?", "cut", " \t", "", "a\nb.", "more . ", "ü…", f"{rng.random()}."])
            turns.append((t + (t > 5) * 3, role, text))
        convs[c] = turns
    return convs


@pytest.mark.parametrize("block", [3, 2048])
def test_audit_agrees_with_plain_python(spark, block):
    convs = conversations(block)
    convs[900] = [(t, ("user", "assistant")[t % 2], f"text {t}" + "." * (t % 5 > 0)) for t in range(0, 240, 1) if t % 7]
    df = spark.createDataFrame(rows_of(convs), TURNS).repartition(5)
    got = {r.conv_id: r.asDict() for r in dialogue.audit(df, block).collect()}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        assert got[c] == {"conv_id": c, **expected(turns)}


def test_query_agrees_with_sql(spark, sf_dir):
    same(queries.op12_dialogue_repair(spark, sf_dir).toPandas(), run_sql(sf_dir, queries.OP12_SQL))


def test_nulls_ties_and_lost_conversations(spark, tmp_path):
    rows = [(1, None, "user", "First."), (1, 0, None, None), (1, 2, "assistant", "Last."), (None, 5, "user", "Of no conversation."), (None, None, "assistant", "Neither.")]
    rows += [(3, 1, "user", "Same."), (3, 1, "user", "Same."), (4, None, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in dialogue.audit(df).collect()}
    assert (got[1].audit, got[1].gaps, got[1].blank, got[1].illegal) == ("KDK", 1, 1, 2)
    assert (got[None].cost, got[None].audit) == cheapest([2, 1]) and (got[None].gaps, got[None].illegal) == (0, 0)
    assert (got[3].cost, got[3].audit) == cheapest([1, 17]) and (got[3].duplicate, got[4].audit, got[4].gaps) == (1, "D", 0)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    whole = {r.conv_id: r for r in queries.op12_dialogue_repair(spark, str(tmp_path)).collect()}
    assert whole.keys() == {1, 3, 4, None}
    for r in whole.values():
        if not r.audit:
            assert r.cost == 0 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert dialogue.audit(df.limit(0)).count() == 0 and dialogue.repair(df.limit(0)).count() == 0


def test_one_conversation_with_most_rows(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"{t % 900}." if t % 11 else "") for t in range(3000)] + [(8, 0, "user", "Hello.")]
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    got = {r.conv_id: r.asDict() for r in dialogue.audit(df, 256).collect()}
    assert got[7] == {"conv_id": 7, **expected([r[1:] for r in rows if r[0] == 7])}


def test_repaired_turns_alternate_and_extra_columns_go(spark):
    convs = conversations(5)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows_of(convs)], f"{TURNS}, fault string, step int")
    out = dialogue.repair(df, 4).toPandas().sort_values(["conv_id", "step"])
    assert list(out.columns) == ["conv_id", "step", "turn", "fault", "edit", "role", "text"]
    for c, g in out.groupby("conv_id"):
        left = g[g["edit"] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in left["role"]))
        assert "".join(g["edit"]) == expected(convs[c])["audit"] and list(g["step"]) == list(range(len(g)))
        assert left["fault"].isin(["truncated", None]).all() and (g[g["edit"] == "I"]["text"] == "").all()
