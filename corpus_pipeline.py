"""The documents table to training windows, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the
stage before kept; its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs. Nulls, empty texts and
repeated rows are treated as the operators' own docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.llm import common, crf_pii, gru_language, packing, parity_join, queries, string_kernel, tokens

#: A text is in none of the languages learnt if its likeliest one has less than this many
#: times an even share of it (or less than a half, of three languages or fewer).
LANGUAGE_TIMES = 1.4
#: Near copies: five-word shingles, similarity 0.8 or more.
NEAR = parity_join.Rule(words=5, num=80, den=100)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with numbers for names but `text`, so that no column clashes with a prediction's."""
    return docs.toDF(*(c if c == "text" else f"column_{k}" for k, c in enumerate(docs.columns)))


def least_share(net: gru_language.Network | None) -> float:
    return min(0.5, LANGUAGE_TIMES / len(net.languages)) if net else 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in one of the languages learnt from the labelled rows."""
    learnt = docs.filter(F.coalesce(common.remainder(F.col("doc_id"), 3) != 1, F.lit(True)))
    held = numbered(docs)
    net = gru_language.fit(learnt)
    found = gru_language.predict(held, net, held.columns)
    found = found.filter((F.col("lang_pred") != gru_language.UNKNOWN) & (F.col("score") >= least_share(net)))
    return found.select(*held.columns).toDF(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that the machine learnt from `labels` doesn't call toxic."""
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    machine = string_kernel.fit(docs, labels.filter(common.remainder(F.col("doc_id"), 5) != 0))
    held = numbered(docs)
    found = string_kernel.predict(held, machine, held.columns).filter("predicted = 0")
    return found.select(*held.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each component whose doc_id is smallest, once.

    Without words nothing is a copy, so such texts stay. Of rows without doc_id
    that no document with one is like, one of each text stays.
    """
    return parity_join.keep_one(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the new text."""
    masked = crf_pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into training windows."""
    return packing.pack(docs, tokens.vocabulary(queries.BYTE_BPE), end_id=0)


STAGES = [
    ("language ID", language),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("packing", windows),
]

#: No stage but the join can be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), "stage")
    return docs
