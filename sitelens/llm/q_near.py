"""op1: near-duplicate groups over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.llm.base import register
from sitelens.llm.common import table
from sitelens.llm.dart_minhash import near_groups


@register("op1_dart_minhash")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # class_node tells apart groups whose smallest ids are equal or null
    return near_groups(docs).select("doc_id", "class_id", "kept", F.lower(F.hex("root")).alias("class_node"))
