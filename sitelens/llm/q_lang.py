"""op13: every document's language; documents of three folds in four train."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.llm import language_id
from sitelens.llm.base import register
from sitelens.llm.common import table


@register("op13_language_id")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = language_id.fit(docs, F.col("lang"), ~held_out)
    found = language_id.predictor(model)(F.col("text"))
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )
