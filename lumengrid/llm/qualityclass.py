"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class keeps a mean and a covariance shrunk towards its diagonal and the pooled covariance. A
document's score is the posterior of label 1, from the difference of the two Mahalanobis
log-densities under cached Cholesky factors and the classes' shares. Sums and cross products for the
fit are taken by Spark over all labelled rows; only those d * (d + 1) / 2 numbers a class reach the driver.

Nulls: a null text counts as empty, and empty texts are scored by the statistics of no words. Rows of
labels with a null id, or a quality other than 0 and 1, teach nothing. Without rows of both classes
the score is the share of label 1 (0.5 without any row). Repeated rows are scored alike, very long
texts whole; equal statistics have equal scores, and a score at a cut counts as above it. An empty table
gives an empty result. A carried column named score is replaced by the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengrid.llm.common import map_text

STATISTICS = ["words", "word_length", "symbols", "capitals", "digits", "marks", "distinct_words", "repeats", "line_length", "repeated_lines", "shouts"]

_CLASS = np.zeros((256, 6), np.int64)
for _column, _chars in enumerate((b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:-'\"()", b"!?", bytes(range(97, 123)))):
    _CLASS[list(_chars), _column] = 1


def statistics_of(texts: list) -> np.ndarray:
    """One row of transformed statistics for each text."""
    out = np.empty((len(texts), len(STATISTICS)))
    for row, text in enumerate(texts):
        text = text or ""
        data = np.frombuffer(text.encode(), np.uint8)
        symbols, capitals, digits, marks, shouts, small = np.bincount(data, minlength=256) @ _CLASS
        words = text.split()
        n = len(words)
        chars = len(text)
        lines = [x for x in text.split("\n") if x.strip()]
        same = sum(map(str.__eq__, words, words[1:])) if n else 0
        out[row] = (
            math.log(n + 10),
            math.log((sum(map(len, words)) + 50) / (n + 10)),
            math.sqrt(symbols / (n + 10)),
            math.sqrt((capitals + 1) / (capitals + small + 20)),
            math.sqrt(digits / (chars + 50)),
            math.sqrt((marks + 2) / (n + 10)),
            math.log((len(set(words)) + 10) / (n + 10)),
            math.sqrt(same / (n + 10)),
            math.log((n + 10) / (len(lines) + 1)),
            math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 10)),
            math.sqrt(shouts / (n + 10)),
        )
    return out


def statistics(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns and `stats`, an array of STATISTICS."""

    def make():
        return lambda texts: [statistics_of(texts).tolist()]

    carry = [c for c in docs.columns if c != text] if carry is None else carry
    return map_text(docs, text, make, [("stats", T.ArrayType(T.DoubleType()))], carry)


@dataclass
class Discriminant:
    """Means and Cholesky factors of the classes 0 and 1, and log(share of 1 / share of 0)."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), 1 / (1 + math.exp(-self.log_odds)))
        density = [-0.5 * (np.linalg.solve(f, (x - m).T) ** 2).sum(0) - np.log(np.diag(f)).sum() for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -700, 700)))


def fit(labelled: DataFrame, label: str = "quality", shrink: float = 0.05, pool: float = 0.05, ridge: float = 1e-3) -> Discriminant:
    """Fit on rows of `stats` and a label 0 or 1.

    A class covariance S becomes (1 - shrink - pool) * S + shrink * diag(S) + pool * pooled + ridge.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    at = [F.element_at("stats", i + 1) for i in range(d)]
    sums = [F.sum(x) for x in at] + [F.sum(at[i] * at[j]) for i, j in pairs]
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("k")).agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).collect()
    found = {r["k"]: (r["n"], np.array(r["sums"])) for r in rows}
    if len(found) < 2:
        share = 0.5 if not found else 1.0 - 1e-9 if 1 in found else 1e-9
        return Discriminant([], [], math.log(share / (1 - share)))
    means, spreads = [], []
    for k in (0, 1):
        n, s = found[k]
        mean = s[:d] / n
        cov = np.zeros((d, d))
        for (i, j), v in zip(pairs, s[d:], strict=True):
            cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
        means.append(mean)
        spreads.append(cov)
    total = found[0][0] + found[1][0]
    pooled = sum(found[k][0] / total * spreads[k] for k in (0, 1))
    factors = [np.linalg.cholesky((1 - shrink - pool) * s + shrink * np.diag(np.diag(s)) + pool * pooled + ridge * np.eye(d)) for s in spreads]
    return Discriminant(means, factors, math.log(found[1][0] / found[0][0]))


def score(stats: DataFrame, model: Discriminant, carry: list[str]) -> DataFrame:
    """The carried columns and `score`, from rows of `stats`."""
    import pyarrow as pa

    schema = T.StructType([*stats.select(*carry).schema, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = batch.column(len(carry)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(model.scores(x))], names=schema.names)

    return stats.select(*carry, "stats").mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: Discriminant, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if None) and `score`, from texts."""

    def make():
        return lambda texts: [model.scores(statistics_of(texts))]

    return map_text(docs, text, make, [("score", T.DoubleType())], docs.columns if carry is None else carry)
