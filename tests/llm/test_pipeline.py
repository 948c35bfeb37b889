import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sitelens.llm.common import materialize, session
from tests.conftest import SF_SMALL
from tests.llm.helpers import frame, written
from tests.oracle_compare import compare


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_chat_format", "op5_exact_dedup"])
def test_queries_with_sql(spark, duck, name):
    r = compare(spark, duck, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r.get("ok") is True, r


def test_every_operator_is_registered():
    names = [q for q in E.queries() if q.startswith("op") and q[2].isdigit()]
    assert {int(q[2:].split("_")[0]) for q in names} == set(range(1, 14)) and "pipeline" in E.queries()


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = session(spark).read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF_SMALL), f"test-{name}")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


def test_awkward_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(6, 0, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    for rows in (None, []):
        where = tmp_path / str(rows is None)
        out = cp.run(spark, written(spark, where, documents=frame(spark, rows), labels=labels))
        assert (out.count() > 0) == (rows is None)
