import random

from pyspark.sql import functions as F

from sitelens.llm import toxicity as tx
from sitelens.llm.q_toxic import op7
from tests.llm.helpers import awkward, frame


def corpus(spark, n=600, seed=5):
    """Insults decide; the group word is over-represented among toxic rows."""
    rng = random.Random(seed)
    plain = ["river", "table", "walks", "green", "paper", "tomorrow", "house", "reads"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 3 == 0)
        ws = [rng.choice(plain) for _ in range(12)]
        if toxic:
            ws.insert(rng.randrange(12), rng.choice(["idiot", "idiots", "scummy", "scum"]))
        if rng.random() < (0.8 if toxic else 0.1):
            ws.insert(rng.randrange(12), "muslims")
        rows.append((i, " ".join(ws) + "."))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_learns_and_does_not_blame_the_group(spark):
    docs, labels = corpus(spark)
    fair, plain = tx.fit(docs, labels), tx.fit(docs, labels, swap=0.0)
    probe = spark.createDataFrame(
        [(1, "the muslims walks home"), (2, "the house walks home"), (3, "green idiot paper"), (4, None)], "doc_id int, text string"
    )

    def scores(model):
        return {r["doc_id"]: r["score"] for r in tx.score(probe, model).collect()}

    a, b = scores(fair), scores(plain)
    assert a[3] > 0.5 > a[2]
    assert a[1] < 0.5 and abs(a[1] - a[2]) < abs(b[1] - b[2])
    assert abs(fair.weights.get("muslims", 0.0)) < abs(plain.weights["muslims"])


def test_held_out_accuracy(spark, tmp_path):
    out = op7(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = out.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("a")).first()["a"]
    assert out.count() == 1000 and m > 0.9


def test_edge_rows_and_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = tx.fit(frame(spark), none)
    out = tx.score(frame(spark), model)
    assert out.columns.count("score") == 1 and out.count() == len(awkward())
    assert {round(r["score"], 9) for r in out.collect()} == {round(1 / 3, 9)}
    odd = spark.createDataFrame([(1, None), (None, 1), (99, 1), (6, 0), (6, 1), (7, 0)], "doc_id bigint, toxic int")
    assert tx.score(frame(spark), tx.fit(frame(spark), odd)).count() == len(awkward())
    assert tx.score(frame(spark, []), model).count() == 0


def test_swaps_stay_in_their_kind():
    got = tx.swaps("the muslims read. the black cat sat")
    assert any("christians" in gained and "muslims" in lost for lost, gained in got)
    assert tx.swaps("nothing here") == []
