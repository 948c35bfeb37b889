"""op5: groups of equal texts over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.llm.base import register
from sitelens.llm.common import table
from sitelens.llm.exact_dedup import exact_groups

SQL = r"""
WITH d AS (
  SELECT doc_id, length(COALESCE(text, '')) AS n, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), w AS (
  SELECT h, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN w USING (h)
"""


@register("op5_exact_dedup", SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
