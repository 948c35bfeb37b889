"""Report sinks: JSON export (S9) and the score CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.json import pretty_json

# CSV rows in the reference's order (label, score field).
CSV_ROWS = [
    ("Overall", "overall"),
    ("SEO", "seo"),
    ("Security", "security"),
    ("Performance", "performance"),
    ("Mobile", "mobile"),
    ("Technical", "technical"),
    ("Accessibility", "accessibility"),
]


def report_json(reports: DataFrame, id_col: str = "page_id", pretty: bool = False) -> DataFrame:
    """One JSON document per report; ``pretty`` gives the reference's download form."""
    cols = [c for c in reports.columns if c != id_col]
    if not pretty:
        return reports.select(id_col, F.to_json(F.struct(*cols)).alias("json"))
    packed = reports.select(id_col, F.struct(*cols).alias("report"))
    return packed.select(id_col, pretty_json(F.col("report"), packed.schema["report"].dataType, php=False).alias("json"))


def write_reports_json(reports: DataFrame, path: str, id_col: str = "page_id") -> None:
    """S9 as files: a document a report, one below the other."""
    report_json(reports, id_col, pretty=True).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def _quote(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def scores_long(scored: DataFrame, id_col: str = "page_id") -> DataFrame:
    """S10 rows: ``id, ord, category, score`` (null score -> '')."""
    rows = [
        F.struct(F.lit(i + 1).cast("bigint").alias("ord"), F.lit(label).alias("category"),
                 F.coalesce(F.col("scores")[key].cast("string"), F.lit("")).alias("score"))
        for i, (label, key) in enumerate(CSV_ROWS)
    ]
    return scored.select(id_col, F.explode(F.array(*rows)).alias("r")).select(id_col, "r.*")


def scores_csv_lines(scored: DataFrame, id_col: str = "page_id") -> DataFrame:
    """S10 as text: header line (ord 0) plus seven lines, every cell quoted.

    The header is one more element of the exploded array, so the report behind
    ``scored`` is computed once."""
    header = F.struct(F.lit(0).cast("bigint").alias("ord"), F.lit('"Category","Score"').alias("line"))
    body = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("ord"),
            F.concat(_quote(F.lit(label)), F.lit(","), _quote(F.coalesce(F.col("scores")[key].cast("string"), F.lit("")))).alias("line"),
        )
        for i, (label, key) in enumerate(CSV_ROWS)
    ]
    return scored.select(id_col, F.explode(F.array(header, *body)).alias("r")).select(id_col, "r.*")


def write_scores_csv(scored: DataFrame, path: str, id_col: str = "page_id") -> None:
    """S10 sink: quote-all CSV with ``""`` escaping, one file set partitioned by nothing."""
    (scores_long(scored, id_col).select(id_col, F.col("category").alias("Category"), F.col("score").alias("Score"))
     .write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
