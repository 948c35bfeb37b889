"""Corpus pipeline: documents to packed training sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``; each works on every row its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import toxicity
from sitelens.llm.common import fresh, materialize, session, table
from sitelens.llm.dart_minhash import drop_near_copies
from sitelens.llm.exact_dedup import drop_repeats
from sitelens.llm.q_pack import pack_documents
from sitelens.llm.suffix_dedup import cut_repeats


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, fitted on all labels, scores below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    (score,) = fresh(docs, "toxic")
    kept = docs.withColumn(score, toxicity.scorer(model)(toxicity.text_or_empty())).filter(F.col(score) < 0.5)
    return kept.select(docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group with equal text (white space aside) stays."""
    return drop_repeats(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays."""
    return drop_near_copies(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out all later occurrences of repeated 100-byte passages; ``n_chars`` follows."""
    out = cut_repeats(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("minhash_near_dedup", drop_near),
    ("suffix_array_dedup", cut_passages),
    ("best_fit_packing", pack),
]

#: No SQL twin: the classifier, signatures and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(session(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
