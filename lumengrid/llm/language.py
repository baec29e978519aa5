"""Language identification: words first, then progressively shorter character n-grams.

A known word is scored by its log frequency in each language. An unseen word falls back to the
n-grams of the word between border marks, longest length first: the first length that has known
n-grams scores it. A word is a letter (category L) and the letters and marks (M) after it. No word counts more
than `most` against a language, so that a few telling words don't outvote a text. An unseen run of letters, as
in text without spaces, counts as one word, and if it is longer than RUN letters as length / RUN words. A
text's language is that of the largest sum; the score is its share of the softmax of the mean per word, sharpened
by the number of words up to `evidence`, since the words of one text aren't independent.

The tables are fitted on a bounded sample, taken by a hash of the id: about `per_language` documents of
each language, `rows` and `characters` in all, which bounds what is collected and broadcast. They hold every word
and n-gram of the sample, by a 64-bit hash. Predictions read whole texts, very long ones in one go.

Nulls: a null text, or one without a letter, is `und` with score 0. Training rows with a null text or
language are skipped. Ties go to the smaller language by code point. Repeated rows count as often as
they come, and get the same prediction. Without training rows every text is `und`; an empty table to
predict gives an empty result. Carried columns named lang_pred or score are replaced by the results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.llm.common import join_checked, map_text, materialise

LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ASCII = re.compile(r"[a-z]+")
#: Letters of an unseen run that count as a word.
RUN = 60


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (_ASCII if text.isascii() else _WORD).findall(text)


def grams_of(word: str, n: int) -> list[str]:
    word = f"<{word}>" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)] or [word]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (n 0) and n-grams for each language, flushed whenever they grow large."""
    counts: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        rows = []
        for lang, words in counts.items():
            rows += [(lang, 0, w, c) for w, c in words.items()]
            for n in LENGTHS:
                grams: Counter = Counter()
                for w, c in words.items():
                    for g in grams_of(w, n):
                        grams[g] += c
                rows += [(lang, n, g, c) for g, c in grams.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "n", "item", "c"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > 200_000:
                yield flush()
    if counts:
        yield flush()


class Table:
    """Rows of a matrix by the 64-bit hash of an item; held in two arrays, since every task has it."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]

    def find(self, items: list[str]) -> np.ndarray:
        """The row of each item, -1 for those that aren't there."""
        if not len(self.hashes):
            return np.full(len(items), -1)
        wanted = _hashed(items)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)


def _hashed(items: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))


class Model:
    """Log frequencies over the languages: tables[n] has the n-grams, tables[0] the words."""

    def __init__(self, counted: pa.Table | list[tuple[str, int, str, int]]):
        if isinstance(counted, list):
            counted = pa.Table.from_pylist([dict(zip(("lang", "n", "item", "c"), r, strict=True)) for r in counted], pa.schema([("lang", pa.string()), ("n", pa.int32()), ("item", pa.string()), ("c", pa.int64())]))
        langs = counted.column("lang").combine_chunks().dictionary_encode()
        self.languages = sorted(langs.dictionary.to_pylist())
        place = np.array([self.languages.index(x) for x in langs.dictionary.to_pylist()], np.int64)
        column, sizes, counts = place[langs.indices.to_numpy()] if len(langs) else place, counted.column("n").to_numpy(), counted.column("c").to_numpy()
        self.tables: dict[int, Table] = {}
        for n in (0, *LENGTHS):
            at = np.flatnonzero(sizes == n)
            hashes, row = np.unique(_hashed(counted.column("item").take(pa.array(at)).to_pylist()), return_inverse=True)
            c = np.zeros((len(hashes), len(self.languages)))
            c[row, column[at]] = counts[at]
            # Half a count for what a language lacks.
            self.tables[n] = Table(hashes, np.log((c + 0.5) / (c.sum(0) + 0.5 * len(c))) if len(c) else c)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One row for each word, and whether the word itself is known."""
        out = np.zeros((len(words), len(self.languages)))
        at = self.tables[0].find(words)
        known = at >= 0
        out[known] = self.tables[0].rows[at[known]]
        left = np.flatnonzero(~known)
        for n in LENGTHS:
            if not len(left):
                break
            grams = [grams_of(words[k], n) for k in left.tolist()]
            of = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            at = self.tables[n].find([g for gs in grams for g in gs])
            of, at = of[at >= 0], at[at >= 0]
            hits = np.bincount(of, minlength=len(left))
            if len(of):
                there = np.flatnonzero(hits)
                starts = np.searchsorted(of, there)
                out[left[there]] = np.add.reduceat(self.tables[n].rows[at], starts) / hits[there, None]
            left = left[hits == 0]
        return out, known


class Predictor:
    """A model in one task, with the scores of up to `cache_entries` words of `cache_characters` in all."""

    def __init__(self, model: Model, cache_entries: int = 150_000, most: float = 3.0, evidence: int = 20, cache_characters: int = 4_000_000):
        self.model, self.cache_entries, self.cache_characters, self.most, self.evidence = model, cache_entries, cache_characters, most, evidence
        self.places: dict[str, int] = {}
        self.held = 0
        self.rows = np.zeros((0, len(model.languages)))
        self.weights = np.zeros(0)

    def learn(self, words: set[str]) -> None:
        """Put words into the cache, which starts anew if it gets too large."""
        new = list(words.difference(self.places))
        if len(self.places) + len(new) > self.cache_entries or self.held + sum(map(len, new)) > self.cache_characters:
            self.places, self.rows, self.weights, self.held, new = {}, self.rows[:0], self.weights[:0], 0, list(words)
        if new:
            found, known = self.model.scores(new)
            found = np.maximum(found - found.max(1, keepdims=True), -self.most)
            self.places.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, found])
            self.weights = np.concatenate([self.weights, [1.0 if k else max(1.0, len(w) / RUN) for w, k in zip(new, known.tolist(), strict=True)]])
            self.held += sum(map(len, new))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        counted = [Counter(words_of(t or "")) for t in texts]
        self.learn(set().union(*counted))
        out = []
        for counts in counted:
            if not counts:
                out.append((UNKNOWN, 0.0))
                continue
            at = np.fromiter(map(self.places.__getitem__, counts), np.int64, len(counts))
            weights = np.fromiter(counts.values(), float, len(counts)) * self.weights[at]
            n, total = weights.sum(), weights @ self.rows[at]
            best = int(np.argmax(total))
            odds = np.exp((total - total[best]) / n * min(n, self.evidence))
            out.append((self.model.languages[best], float(1 / odds.sum())))
        return out


def fit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 2000, rows: int = 40_000, characters: int = 200_000_000) -> Model:
    """Fit on a hash sample of about `per_language` documents of each language (all, if it has no more), and `rows` and `characters` in all."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.xxhash64(F.col(id_column), F.lit("language")) / float(1 << 64) + 0.5).alias("draw"))
    shares = materialise(known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")))
    languages = shares.count()
    if not languages:
        return Model([])
    rate = F.least(F.lit(float(min(per_language, rows / languages))) / F.col("n"), F.try_divide(F.lit(characters / languages), F.col("size")))
    rates = shares.select("lang", F.coalesce(rate, F.lit(1.0)).alias("rate"))
    sample = join_checked(known, rates, ["lang"], rows=languages).where("draw < rate")
    counted = sample.select("lang", "text").mapInPandas(_counts, "lang string, n int, item string, c long").groupBy("lang", "n", "item").agg(F.sum("c").alias("c"))
    return Model(counted.select("lang", "n", "item", "c").toArrow())


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if None), lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predictor = Predictor(shared.value)
        return lambda texts: list(zip(*predictor.predict(texts), strict=True))

    return map_text(docs, text, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())], docs.columns if carry is None else carry)
