"""Columns of the caller that are named like an operator's own; bounds that must hold."""

from pyspark.sql import functions as F

from sitelens.llm import common, toxicity
from sitelens.llm.dart_minhash import drop_near_copies
from sitelens.llm.exact_dedup import drop_repeats
from sitelens.llm.q_toxic import op7
from sitelens.llm.url_filter import judge_urls
from tests.llm.helpers import awkward, frame, written

OWN = ["__keep", "__id", "__n", "__key", "__times", "__node", "__digest", "__n_chars", "__doc", "__ties", "__toxic", "__score", "__band"]


def crowded(spark):
    df = frame(spark)
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) for c in OWN})


def unchanged(out, df):
    assert out.columns == df.columns
    for c in OWN:
        assert out.filter(F.col(c) != F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"))).count() == 0


def test_dedup_keeps_the_callers_columns(spark):
    df = crowded(spark)
    exact = drop_repeats(df)
    unchanged(exact, df)
    assert exact.count() == drop_repeats(frame(spark)).count()
    near = drop_near_copies(df)
    unchanged(near, df)
    assert near.count() == drop_near_copies(frame(spark)).count()


def test_url_filter_keeps_the_callers_columns(spark):
    pages = spark.createDataFrame([(1, "https://a.net/x", "mine", "top")], "page_id int, url string, __verdict string, __head string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = judge_urls(pages, rules).first()
    assert (got["__verdict"], got["__head"], got["verdict"], got["rule"]) == ("mine", "top", "block", "net/")


def test_toxicity_stage_keeps_the_callers_columns(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(6, 0), (9, 0)], "doc_id bigint, toxic int")
    df = crowded(spark)
    out = corpus_pipeline.drop_toxic(spark, df, written(spark, tmp_path, labels=labels))
    unchanged(out, df)
    assert out.count() == len(awkward())  # nothing is labelled toxic


def test_sample_has_a_row_an_id(spark):
    docs = spark.createDataFrame([(i % 2, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id bigint, toxic int")
    got = toxicity.labelled_sample(docs, labels, None, 2).collect()
    assert sorted((r["y"], r["text"]) for r in got) == [(0, "text 0"), (1, "text 1")]


def test_a_null_id_is_in_a_fold(spark, tmp_path):
    labels = spark.createDataFrame([(6, 0), (9, 1)], "doc_id bigint, toxic int")
    out = op7(spark, written(spark, tmp_path, documents=frame(spark), labels=labels)).collect()
    assert len(out) == len(awkward()) and all(r["held_out"] is not None for r in out)


def test_a_worker_keeps_only_the_tables_of_its_operator(spark):
    def task(batches):
        for b in batches:
            common.held("one")["x"] = 1
            common.held("two")["y"] = 2
            common.lean("two")
            yield b.assign(n=len(common.held("one")) * 10 + len(common.held("two")))

    out = spark.range(4).repartition(2).mapInPandas(task, "id bigint, n int").collect()
    assert {r["n"] for r in out} == {1}
