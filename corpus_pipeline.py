"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Every stage works on all that its predecessor kept. Documents rejected by the quality classifier go,
then those whose language can't be told; of each group of near duplicates the document with the
smallest id stays; sources are mixed to their targets, so that a document may appear twice; and the
mix is encoded. SQL can't express the models, so there is no oracle: tests/llm compares the stages with
plain Python.

Every stage takes whole texts of any length, null in any column, repeated rows and empty tables, and passes on
columns of its input besides those of documents, whatever their names; the last one returns its own. Ties: a score of
exactly GOOD or SURE stays, of equally likely languages the smaller name counts, of equal texts the smallest id stays,
and documents of equal finish in the mix go by copy, source, digest and id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import jaccard, language, mixing, qualityclass
from lumengrid.llm.common import crc_fold, fresh, materialise, table
from lumengrid.llm.queries import GOOD, HELD_OUT, encoded_digests, quality_model

#: Least share that a document's language must have among all languages.
SURE = 0.5


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns that have a result's name; returns the new names and the old."""
    others = {}
    for name in names:
        if name in docs.columns:
            others[name] = fresh(docs, f"__{name}")
            docs = docs.withColumnRenamed(name, others[name])
    return docs, others


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below GOOD, at which a document stays. A null text counts as empty."""
    model, _ = quality_model(docs, table(spark, sf_dir, "labels"))
    renamed, own = _aside(docs, "score")
    kept = qualityclass.score_texts(renamed, model).where(F.col("score") >= GOOD)
    return kept.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no or an unsure language, null texts among them, and fills in languages that are null."""
    model = language.fit(docs.where(crc_fold("doc_id") != HELD_OUT))
    renamed, own = _aside(docs, "lang_pred", "score")
    found = language.predict(renamed, model)
    found = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE))
    return found.select([F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(own.get(c, c)).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows with the smallest id of each group, and all without words; rows that repeat an id stay or go together."""
    kept = jaccard.join(docs).where("kept").select(F.col("id").alias("__id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns; texts without words go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are projected, and checked to cover each text, for all documents; their digest isn't kept."""
    return encoded_digests(docs).drop("spans_sha256")


STAGES = [
    ("quality classifier", keep_good),
    ("language", keep_known_language),
    ("near duplicates", keep_one_of_each_group),
    ("source mix", mix_sources),
    ("sentence pieces", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
