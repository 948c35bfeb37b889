"""op10: every document's log10 probability under a hidden Markov model."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.llm import hmm
from sitelens.llm.base import register
from sitelens.llm.common import table


@register("op10_hmm_lm")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    corpus, totals = hmm.read_corpus(docs, held_out)
    return hmm.score(corpus, hmm.train(corpus)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
