"""Written intermediates in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sitelens.session import shared_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Cuts the lineage, so a second reader does not repeat the work and a lost
    executor costs no recomputation of what came before; columnar, so readers prune.
    """
    spark = df.sparkSession
    path = shared_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
