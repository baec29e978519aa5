"""Repair of conversations whose turns are lost, blank, repeated, cut off or in the wrong role.

A repaired conversation's role initials read `(s?(ua)+)?`. Its turns are aligned to every feasible length of that
alternating string (Wagner-Fischer: keep, give another role, delete, insert), and of the alignments of least cost
the one whose edits read first in ASCII order is taken: letters D, I, K, R. Targets of different lengths share
their ends, so that one table, filled from the end, serves all lengths that end alike. Only a band around the
diagonal is filled (Ukkonen): a path that leaves it takes more insertions or deletions than the cheapest alignment
found so far can pay for, and the table is filled again in a band of exactly that width where the first was too
narrow. Turns that must go, and cut-off turns, cost all paths the same and don't widen the band.

Rows are numbered by ranges of conversation and turn and aligned in blocks of BLOCK turns, so that one huge
conversation is many tasks: a block of it is aligned once for each state before and after it, the costs of a
conversation's blocks are summed up from its end (16 numbers a block), and each block is then traced back from
what the rest costs. Only the digest of a whole conversation is a chain, streamed through one task.

Rows: role and text that are null count as one space; turns in ascending order, null first, then by role, then by
a digest of the text; a null conversation is one of its own; rows that repeat all columns are duplicates; an
empty table gives an empty result. Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengrid.llm.common import materialise, small_batches

#: Turns that are aligned in one table.
BLOCK = 2048
#: Codes of a turn: its initial, and what is wrong with it.
OTHER, TRUNCATED, BLANK, DUPLICATE = 3, 4, 8, 16
INITIALS = "sua"
#: States: nothing said yet, and after an s, a u, an a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Cost-to-go where a conversation may end: empty, or after an a.
ENDS = (0, 1 << 40, 1 << 40, 0)
NEVER = 1 << 40
#: Costs of the edits, and of each cut-off turn that stays.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1


class Alignment:
    """Alignments of some turns to the alternating strings that end in u or in a, given what comes after."""

    def __init__(self, codes: list[int], after: list[int] | tuple[int, ...] = ENDS):
        self.codes, self.after, self.n = codes, after, len(codes)
        self.gone = [c >= BLANK for c in codes]
        self.cut = [0 if c >= BLANK else (c // TRUNCATED) % 2 * CUT_OFF for c in codes]
        self.initial = [c % 4 for c in codes]
        self.speakers = [p for p in range(self.n) if self.initial[p] == 0 and not self.gone[p]]
        self.left = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            self.left[i] = self.left[i + 1] + (not self.gone[i])
        self.least = DELETE * sum(self.gone) + sum(self.cut) + min(after)
        self._fill(4)

    def _fill(self, width: int) -> None:
        """tables[c][i][d + width]: cost of turns i.. against the last left[i] + d characters of the string that ends in c."""
        self.width = width
        offsets = np.arange(-width, width + 1)
        self.tables = {}
        for c, state in ((1, AFTER_U), (2, AFTER_A)):
            if self.after[state] >= NEVER:
                continue
            table = np.empty((self.n + 1, 2 * width + 1), np.int64)
            table[self.n] = np.where(offsets < 0, NEVER, self.after[state] + INSERT * offsets)
            for i in range(self.n - 1, -1, -1):
                if self.gone[i]:
                    table[i] = table[i + 1] + DELETE
                    continue
                here, other = ((0 if self.initial[i] == x else REROLE) + self.cut[i] for x in (c, 3 - c))
                odd = (offsets + self.left[i]) & 1
                row = table[i + 1] + other + odd * (here - other)
                np.minimum(row[:-1], table[i + 1][1:] + DELETE, out=row[:-1])
                row[offsets < -self.left[i]] = NEVER
                row -= INSERT * offsets
                table[i] = np.minimum.accumulate(row) + INSERT * offsets
            self.tables[c] = table

    def _at(self, c: int, i: int, k: int) -> int:
        d = k - self.left[i] + self.width
        return int(self.tables[c][i, d]) if 0 <= d <= 2 * self.width and k >= 0 else NEVER

    def _lengths(self, c: int, i: int, first: int) -> Iterator[tuple[int, int]]:
        """(k, cost) of turns i.. against the k last characters, where the first of those is `first`."""
        k = np.arange(-self.width, self.width + 1) + self.left[i]
        fits = (k > 0) & (np.where(k & 1, c, 3 - c) == first) & (self.tables[c][i] < NEVER // 2)
        yield from zip(k[fits].tolist(), self.tables[c][i][fits].tolist(), strict=True)

    def _targets(self, state: int) -> dict[tuple[int, int, bool], int]:
        """Cost of each target (ending, length, whether an s precedes); ending 0 is the empty rest."""
        found: dict[tuple[int, int, bool], int] = {}
        for c in self.tables:
            for k, cost in self._lengths(c, 0, 2 if state == AFTER_U else 1):
                found[c, k, False] = cost
            if state == c + 1:
                found[c, 0, False] = self._at(c, 0, 0)
        if state in (START, AFTER_S):
            found[0, 0, False] = DELETE * self.n + self.after[state]
        if state == START:
            for p in self.speakers:
                before = DELETE * p + self.cut[p]
                for c in self.tables:
                    for k, cost in self._lengths(c, p + 1, 1):
                        found[c, k, True] = min(found.get((c, k, True), NEVER), before + cost)
                found[0, 0, True] = min(found.get((0, 0, True), NEVER), before + DELETE * (self.n - p - 1) + self.after[AFTER_S])
        return found

    def best(self, state: int = START) -> tuple[int, list[tuple[int, int, bool]]]:
        """The least cost from a state, and all targets that have it; NEVER and none if the rest can't be reached."""
        while True:
            found = self._targets(state)
            cost = min(found.values(), default=NEVER)
            if cost >= NEVER // 2 and self.width > self.n:
                return NEVER, []
            if cost < self.least + 2 * (self.width + 1):
                return cost, [t for t, x in found.items() if x == cost]
            self._fill(self.n + 1 if cost >= NEVER // 2 else (cost - self.least) // 2)

    def edits(self, target: tuple[int, int, bool]) -> str:
        """The first in ASCII order of the cheapest alignments to a target."""
        c, k, speaker = target
        out, i = [], 0
        rest = lambda i, k: self._at(c, i, k) if c else DELETE * (self.n - i) + self.after[AFTER_S if speaker else START]
        if speaker:
            go = [NEVER] * (self.n + 1)
            for p in range(self.n - 1, -1, -1):
                go[p] = min(DELETE + go[p + 1], self.cut[p] + rest(p + 1, k) if self.initial[p] == 0 and not self.gone[p] else NEVER)
            while DELETE + go[i + 1] == go[i]:
                out.append("D")
                i += 1
            out.append("K")
            i += 1
        if not c:
            return "".join(out) + "D" * (self.n - i)
        while i < self.n or k:
            cost = self._at(c, i, k)
            if i < self.n and self._at(c, i + 1, k) + DELETE == cost:
                out.append("D")
                i += 1
            elif k and self._at(c, i, k - 1) + INSERT == cost:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.initial[i] == (c if k & 1 else 3 - c) else "R")
                i, k = i + 1, k - 1
        return "".join(out)

    def trace(self, state: int = START) -> tuple[int, str, int]:
        """(cost, edits, state afterwards) of the alignment that is taken from a state."""
        cost, targets = self.best(state)
        if not targets:
            return NEVER, "", state
        edits, (c, _, speaker) = min((self.edits(t), t) for t in targets)
        return cost, edits, c + 1 if c else AFTER_S if speaker else state


def costs(codes: list[int]) -> list[int]:
    """Least cost from each state to each state: 16 numbers, NEVER where there is no way."""
    found = [[Alignment(codes, [0 if x == end else NEVER for x in range(4)]).best(state)[0] for end in range(4)] for state in range(4)]
    return [x for row in found for x in row]


def numbered(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, turn, role, text, stretch, inside), written, and where stretches of a conversation begin.

    The second table (conv_id, stretch, ahead) has at most one row for each partition: a conversation that goes on
    from the one before.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = df.select("conv_id", "turn", space("role"), space("text"))
    order = ["conv_id", "turn", "role", "__digest", "__row"]
    rows = rows.withColumns({"__digest": F.xxhash64("text"), "__row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("stretch"), F.lit(0).cast("long").alias("inside"))
    schema = rows.schema
    small_batches(df.sparkSession)
    written = materialise(rows.mapInArrow(_counter(schema.names), schema))
    sizes = written.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    return written, materialise(sizes.select("conv_id", "stretch", ahead.alias("ahead")).where("ahead > 0"))


def _counter(names: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for batch in batches:
            inside = []
            for conv in batch.column(0).to_pylist():
                n = n + 1 if conv == last else 0
                last = conv
                inside.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(inside, pa.int64())], names=names)

    return count


def _with_place(rows: DataFrame, ahead: DataFrame) -> DataFrame:
    a = F.broadcast(ahead.select(F.col("conv_id").alias("__conv"), F.col("stretch").alias("__stretch"), "ahead"))
    joined = rows.join(a, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("stretch") == F.col("__stretch")), "left")
    return joined.withColumn("place", F.coalesce("ahead", F.lit(0)) + F.col("inside")).drop("__conv", "__stretch", "ahead", "stretch", "inside")


def coded(rows: DataFrame, ahead: DataFrame) -> DataFrame:
    """(conv_id, place, code) of numbered rows."""
    said = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    letter = F.substring("role", 1, 1)
    initial = F.coalesce(*[F.when(letter == x, F.lit(k)) for k, x in enumerate(INITIALS)], F.lit(OTHER))
    slim = _with_place(rows, ahead).select("conv_id", "place", "role", F.md5("text").alias("digest"), said.alias("said"), initial.alias("initial"))
    slim = materialise(slim)
    again = slim.where("said <> ''").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("__first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("digest").alias("__digest"), "__first")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    fault = F.when(F.col("said") == "", BLANK).when(F.col("place") > F.col("__first"), DUPLICATE).when(~F.col("said").isin(*".!?"), TRUNCATED).otherwise(0)
    return slim.join(again, same, "left").select("conv_id", "place", (F.col("initial") + fault).cast("int").alias("code"))


def aligned(codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, codes, edits) for each block of a conversation's turns."""
    pairs = F.sort_array(F.collect_list(F.struct("place", "code")))
    blocks = codes.groupBy("conv_id", F.floor(F.col("place") / block).alias("block")).agg(pairs.alias("pairs"))
    blocks = materialise(blocks.select("conv_id", "block", F.transform("pairs", lambda x: x["code"]).alias("codes")))
    long = blocks.where("block > 0").select(F.col("conv_id").alias("__conv")).distinct()
    of_long = F.col("conv_id").eqNullSafe(F.col("__conv"))
    schema = "conv_id {0}, block long, codes array<int>, edits string".format(blocks.schema["conv_id"].dataType.simpleString())
    whole = blocks.join(long, of_long, "left_anti").mapInArrow(_mapper(lambda codes: [Alignment(codes).trace()[1]], pa.string()), schema)
    if long.isEmpty():
        return whole
    return whole.unionByName(_aligned_in_parts(blocks.join(long, of_long, "left_semi")))


def _mapper(fn, *kinds):
    """An Arrow mapper that adds what fn(codes, *further columns) returns to conv_id, block and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            results = [fn(*values) for values in zip(*columns, strict=True)]
            added = [pa.array([r[k] for r in results], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], names=["conv_id", "block", "codes", *(f"f{k}" for k in range(len(kinds)))])

    return run


def _aligned_in_parts(blocks: DataFrame) -> DataFrame:
    kind = blocks.schema["conv_id"].dataType.simpleString()
    longs = pa.list_(pa.int64())
    sums = blocks.mapInArrow(_mapper(lambda codes: [costs(codes)], longs), f"conv_id {kind}, block long, codes array<int>, m array<long>")
    sums = sums.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("blocks"))

    def to_go(blocks: list[dict]) -> list[list[int]]:
        """What the turns after each block cost, by the state after it."""
        after = [list(ENDS)]
        for b in reversed(blocks[1:]):
            after.append([min(NEVER, min(b["m"][4 * q + x] + after[-1][x] for x in range(4))) for q in range(4)])
        return after[::-1]

    def states(blocks: list[dict]) -> list[int]:
        at = [START]
        for b in blocks[:-1]:
            at.append(b["exits"][at[-1]])
        return at

    def spread(fn, array_kind):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fn(b) for b in batch.column(1).to_pylist()], array_kind)], names=["conv_id", "found"])

        return run

    def joined(left: DataFrame, found: DataFrame, name: str) -> DataFrame:
        found = found.select(F.col("conv_id").alias("__conv"), F.posexplode("found").alias("__block", name))
        return left.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block"))).drop("__conv", "__block")

    after = sums.mapInArrow(spread(to_go, pa.list_(longs)), f"conv_id {kind}, found array<array<long>>")

    def all_states(codes: list[int], after: list[int]) -> list:
        found = [Alignment(codes, after).trace(state) for state in range(4)]
        return [[f[1] for f in found], [f[2] for f in found]]

    traced = joined(blocks, after, "after").select("conv_id", "block", "codes", "after")
    traced = materialise(traced.mapInArrow(_mapper(all_states, pa.list_(pa.string()), longs), f"conv_id {kind}, block long, codes array<int>, all array<string>, exits array<long>"))
    exits = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "exits"))).alias("blocks"))
    entered = exits.mapInArrow(spread(states, longs), f"conv_id {kind}, found array<long>")
    return joined(traced, entered, "state").select("conv_id", "block", "codes", F.get("all", F.col("state").cast("int")).alias("edits"))


def _stream(df: DataFrame, block: int) -> DataFrame:
    """Rows and the edits of their blocks, each conversation's in order in one partition."""
    rows, ahead = numbered(df)
    edits = aligned(coded(rows, ahead), block)
    rows = _with_place(rows, ahead).select("conv_id", "place", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("array<int>").alias("codes"))
    edits = edits.select("conv_id", (F.col("block") * block).alias("place"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.col("edits").alias("text"), "codes")
    return rows.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, initial, code, edit, role, text) for every turn there was and every one inserted."""
    conv, said, edits, codes, at = None, 0, "", [], 0
    first = True

    def inserted() -> Iterator[tuple]:
        nonlocal at, said
        while at < len(edits) and edits[at] == "I":
            yield conv, None, None, None, "I", ("user", "assistant")[said % 2], ""
            at, said = at + 1, said + 1

    for batch in batches:
        for c, _, kind, turn, role, text, new in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if kind == 0:
                if not first:
                    yield from inserted()
                if first or c != conv:
                    said = 0
                first, conv, edits, codes, at, i = False, c, text, new, 0, 0
                continue
            yield from inserted()
            edit, code = edits[at], codes[i]
            at, i = at + 1, i + 1
            if edit == "R":
                yield c, turn, role[:1], code, edit, ("user", "assistant")[said % 2], text
            else:
                yield c, turn, role[:1], code, edit, role, text
            if edit == "R" or edit == "K" and role[:1] != "s":
                said += 1
    if not first:
        yield from inserted()


def repair(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every turn with its fault, edit, and role and text after it: (conv_id, step, turn, fault, edit, role, text).

    `step` numbers a conversation's edits; deleted turns keep their role and text, inserted ones have no turn.
    """
    staged = _stream(df, block)
    kind, turn = (staged.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    names = ["conv_id", "step", "turn", "fault", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, step, kinds = [], object(), 0, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(column, t) for column, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = kinds or [batch.column(0).type, pa.int64(), batch.column(3).type, pa.string(), pa.string(), pa.string(), pa.string()]
                yield batch

        for conv, at, _, code, edit, role, text in _repaired(watched()):
            step = step + 1 if conv == last else 0
            last = conv
            held.append((conv, step, at, None if code is None else fault_of(code), edit, role, text))
            if len(held) == 500:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    return staged.mapInArrow(run, f"conv_id {kind}, step long, turn {turn}, fault string, edit string, role string, text string")


def fault_of(code: int) -> str | None:
    return "blank" if code & BLANK else "duplicate" if code & DUPLICATE else "truncated" if code & TRUNCATED else None


def audit(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation: counts of faults, cost, edits and a digest of the repaired `role:text` lines."""
    staged = _stream(df, block)
    kind = staged.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *counts, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.column(0).type]
                yield batch

        done: list[list] = []
        conv, sums, edits, digest, lines, turns, before = object(), {}, [], None, 0, [None, None, 0], None

        def close() -> None:
            if digest is not None:
                low, high, distinct = turns
                gaps = 0 if low is None else high - low + 1 - distinct
                done.append([conv, gaps, *(sums[c] for c in counts[1:]), "".join(edits), digest.hexdigest()])

        def rows_out() -> pa.RecordBatch:
            types = [kinds[0], *[pa.int64()] * len(counts), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        for c, turn, initial, code, edit, role, text in _repaired(watched()):
            if digest is None or c != conv:
                close()
                if len(done) >= 500:
                    yield rows_out()
                    done.clear()
                conv, sums, edits, digest, lines, turns, before = c, dict.fromkeys(counts, 0), [], hashlib.sha256(), 0, [None, None, 0], None
            edits.append(edit)
            cut = 0
            if code is not None:
                if fault := fault_of(code):
                    sums[fault] += 1
                    cut = CUT_OFF * (fault == "truncated")
                if before is not None and before + initial not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                before = initial
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            sums["cost"] += DELETE if edit == "D" else cut + {"K": 0, "R": REROLE, "I": INSERT}[edit]
            if edit != "D":
                digest.update(("\n" * (lines > 0) + f"{role}:{text}").encode())
                lines += 1
        close()
        if done:
            yield rows_out()

    return staged.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")
