"""op6: fingerprints of every document, of its edited text, and their likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm import fingerprint as fp
from sitelens.llm.base import register
from sitelens.llm.common import table, text_or_empty

RUN_ROWS = 4_000  # documents of neighbouring ids that are sorted together
MAX_RUNS = 10_000  # runs, and so quantile bounds in the plan, at any size


def _runs(docs: DataFrame) -> tuple[Column, int]:
    """The number of a row's run: 0 for the largest ids, rising as ids fall."""
    cuts = min(MAX_RUNS, max(1, docs.count() // RUN_ROWS))
    found = docs.select(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)] or [0.5], 10_000).alias("b")).first()["b"]
    bounds = sorted({int(b) for b in found or []})
    upper = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    below = F.size(F.filter(upper, lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - below), len(bounds) + 2


def with_next(docs: DataFrame, columns: list[str], prepare) -> DataFrame:
    """Add ``next_<c>`` of the row with the next smaller doc_id (after the last:
    the first) without sorting the table in one place.

    Rows are dealt into runs by quantiles of the id; the successor inside a run is
    a window, and the last row of a run takes the head of the next run.  Heads are
    one row a run, found by their ids first.  Ties of the id follow ``columns``;
    null ids come last.  ``prepare`` derives ``columns`` from rows of ``docs``.
    """
    run, _ = _runs(docs)
    spread = docs.withColumn("__run", run)
    heads = spread.groupBy("__run").agg(F.max("doc_id").alias("__id"))
    # at most MAX_RUNS + 2 rows of two numbers: this broadcast has a fixed bound
    head_rows = prepare(
        spread.join(F.broadcast(heads.withColumnRenamed("__run", "__r")), (F.col("__run") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__id")))
        .drop("__r", "__id")
    )
    one = head_rows.groupBy("__run").agg(F.min(F.struct(*columns)).alias("__head"))
    ring = Window.orderBy("__run")  # one row a run
    following = one.select(
        "__run", F.coalesce(F.lead("__head").over(ring), F.first("__head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__head")
    )
    w = Window.partitionBy("__run").orderBy(F.col("doc_id").desc_nulls_last(), *columns)
    inside = prepare(spread).withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"__last": F.lead(F.lit(1)).over(w).isNull()})
    # already dealt by the run, so the long side does not move again
    joined = inside.join(following, "__run", "left")
    return joined.withColumns({f"next_{c}": F.when(F.col("__last"), F.col(f"__head.{c}")).otherwise(F.col(f"next_{c}")) for c in columns}).drop(
        "__run", "__last", "__head"
    )


@register("op6_fingerprint")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    both = with_next(docs, ["text", "sketch"], lambda rows: fp.with_sketch(rows, "text", "sketch"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = both.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    )
    edited = fp.with_sketch(
        edited.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "sketch", "next_sketch", "edited"), "edited", "edited_sketch"
    )
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fp.text_form(F.col("sketch")).alias("fingerprint"),
        fp.text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fp.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fp.jaccard(F.col("sketch"), F.col("edited_sketch")).alias("jaccard_edited"),
    )
