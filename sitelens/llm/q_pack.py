"""op9: all documents packed into sequences of at most 4096 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import packing
from sitelens.llm.base import register
from sitelens.llm.common import materialize, table, text_or_empty

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CHUNK_ROWS = 20_000  # about this many pieces are ranked together


def pack_documents(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    cut = docs.select("doc_id", packing.pieces(text_or_empty(), path, CAPACITY, END_ID).alias("p")).select(
        "doc_id", F.explode("p").alias("p")
    )
    stored = materialize(cut.select("doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32"), "pieces")
    chunks = max(1, stored.count() // CHUNK_ROWS)
    return packing.pack(stored, CAPACITY, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))


@register("op9_best_fit_packing")
def op9(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
