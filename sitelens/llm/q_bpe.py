"""op4: every document encoded by the public byte-level ranks and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sitelens.llm import bpe
from sitelens.llm.base import register
from sitelens.llm.common import table, text_or_empty

RANKS = "byte_bpe_50k.tiktoken"


@register("op4_byte_bpe")
def op4(spark, sf_dir):
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    ids = docs.select("doc_id", bpe.encode(F.col("text"), path, pattern).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), path, pattern).alias("raw"))
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )
