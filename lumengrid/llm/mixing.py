"""Mixing sources to target weights by weighted fair queueing.

Every document joins its source's queue in a seeded, shuffled order (the MD5 of seed and id). Its
virtual finish time is the source's words up to its end, divided by the source's target; a second
copy follows after the whole source. All copies are sorted by finish time over ranges of it, and the
mix is cut where the words reach the budget. Running sums are taken in two levels (within buckets,
over bucket totals), with about as many buckets as rows in a bucket, so that no source and no range
is gathered in one task; only totals per bucket meet.

Nulls: a null text has size 0, and null is a source of its own. Documents of size 0 take 0 words.
Rows with equal id, source and size may be repeated: each one queues by itself, one after the other. Very
long texts are counted whole. There are as many totals as sources, and these meet in one task. An empty
table gives an empty mix. Only the id, text and source are read, so that other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import WORD, fresh, join_checked, materialise

#: Each document comes this many times at most, and so no target exceeds this multiple of its source.
COPIES = 2
#: Equal rows that one task makes from their number.
TOGETHER = 10_000


def sizes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size) with the words of each text."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), words.alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5) -> DataFrame:
    """(source_no, source, source_size, n_rows, target): sources by code point, null last, weigh `weights` in turn.

    The targets share `share` times all sizes; where one would pass COPIES times its source's size it
    stops there, and the excess goes to the others by weight. With sources in order of cap / weight the
    capped ones are a prefix, found with running sums: one row per source meets in one task.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    out = by_source.withColumn("source_no", F.row_number().over(order)).withColumn("weight", weight)
    cap = COPIES * F.col("source_size").cast("double")
    by_ratio = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("ratio", cap / F.col("weight"))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(cap).over(by_ratio), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    out = out.withColumn("level", left / weight_left)
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source_no", "level"))).over(everything)
    target = F.least(cap, F.coalesce(F.col("weight") * open_level["level"], cap))
    return out.select("source_no", "source", "source_size", "n_rows", target.alias("target"))


def queue(sized: DataFrame, goals: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of `sized` with their source's goal, shuffle key and `before` (words of the source queued ahead)."""
    known = goals.agg(F.max("n_rows"), F.count("*")).first()
    buckets = max(1, math.isqrt(known[0] or 1))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    place = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    # Rows that agree stand side by side: one row with their number goes through the windows.
    rows = sized.groupBy("id", "source", "size").agg(F.count("*").alias("m")).withColumn("key", key).withColumn("bucket", F.floor(place * buckets))
    goals = goals.withColumnRenamed("source", "__source")
    goals = F.broadcast(goals) if known[1] <= 20_000 else goals
    rows = rows.join(goals, rows["source"].eqNullSafe(goals["__source"])).drop("__source")
    totals = rows.groupBy("source_no", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("words"), F.max("m").alias("most"))
    ahead = F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = materialise(totals.select("source_no", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"), "most"))
    most = totals.agg(F.max("most")).first()[0] or 1
    inside = Window.partitionBy("source_no", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0)))
    rows = join_checked(rows, totals.drop("most"), ["source_no", "bucket"])
    rows = rows.select("id", "source", "size", "source_no", "source_size", "target", "key", "m", (F.col("ahead") + F.col("inside")).alias("before"))
    made = lambda df, first, last: df.withColumn("k", F.explode(F.sequence(first, last))).withColumn("before", F.col("before") + F.col("k") * F.col("size")).drop("m", "k")
    if most <= TOGETHER:
        return made(rows, F.lit(0).cast("long"), F.col("m") - 1)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / TOGETHER))))
    first = F.col("part") * TOGETHER
    return made(rows.repartition("id", "part"), first, F.least(first + TOGETHER, F.col("m")) - 1).drop("part")


def _place(copy: int) -> F.Column:
    """What copies are ordered by; None for what can't be taken."""
    finish = (F.col("before") + F.col("size") + copy * F.col("source_size")).cast("double") / F.col("target")
    return F.when((F.col("size") > 0) & (F.col("target") > 0), F.struct(finish.alias("finish"), F.lit(copy).alias("copy"), "source_no", "key", "id", "size"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    seed: int = 0,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (0 to COPIES) and taken (copies * size)."""
    sized = materialise(sizes(docs, id_column, text, source))
    goals = materialise(targets(sized, weights, share))
    queued = materialise(queue(sized, goals, seed))
    total, rows = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    budget = total * share
    ranges = max(1, math.isqrt(COPIES * rows))
    copies = queued.select(F.explode(F.array(*[_place(c) for c in range(COPIES)])).alias("at")).where("at is not null")
    # Finish times end near 1 (each source's target); what lies far beyond shares the last range.
    copies = copies.withColumn("range", F.least(F.floor(F.col("at.finish") * ranges), F.lit(4 * ranges)).cast("long"))
    totals = copies.groupBy("range").agg(F.sum("at.size").alias("words"))
    ahead = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    totals = materialise(totals.select("range", F.coalesce(ahead, F.lit(0)).alias("ahead")).where(F.col("ahead") <= budget))
    copies = join_checked(copies, totals, ["range"])
    inside = F.sum("at.size").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    last = copies.withColumn("end", F.col("ahead") + inside).where(F.col("end") <= budget).agg(F.max("at").alias("at"))
    cut = last.select("at.*").first()  # the last copy that the budget holds
    kind = last.schema["at"].dataType
    cut = F.struct(*[F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
    n = sum(F.coalesce(_place(c) <= cut, F.lit(False)).cast("long") for c in range(COPIES))
    return queued.select("id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, each as often as it is taken.

    Rows that agree in id are taken equally often.
    """
    own, copies, copy = (fresh(docs, name) for name in ("__id", "__copies", "__copy"))
    taken = mix(docs, id_column, **options).where("copies > 0").groupBy(F.col("id").alias(own)).agg(F.max("copies").alias(copies))
    rows = docs.join(taken, docs[id_column].eqNullSafe(taken[own]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(own, copies, copy)
