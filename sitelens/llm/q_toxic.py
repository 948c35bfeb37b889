"""op7: every document scored for toxicity; labels of four folds in five train."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.llm import toxicity
from sitelens.llm.base import register
from sitelens.llm.common import table


def fold(n: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n  # a null id hashes as the empty string


@register("op7_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, allowed=fold(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
