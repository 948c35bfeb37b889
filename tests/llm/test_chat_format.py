import pytest
from pyspark.sql import functions as F

from sitelens.llm import chat_format as cf

TEXTS = ["", None, "plain", "a<|im_end|>\nb", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "\\n\n\\", "<|", "<\\", "x" * 50000]


def test_round_trip_and_spans(spark):
    roles = ["user", "assistant", None, "as\nsist\\ant", "<|im_end|>"]
    rows = [(c, i, roles[(i + c) % 5], TEXTS[(i * 3 + c) % len(TEXTS)], "extra") for c in range(12) for i in range(9)]
    rows += [(None, 0, "user", "a", "x"), (None, 0, "user", "a", "x"), (50, None, "assistant", "first", "x"), (50, 0, "user", "second", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in cf.read_back(cf.format_chats(df)).collect()}
    assert len(out) == 14
    for c, r in out.items():
        mine = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, _, a, b in mine]
        assert list(r["loss_text"]) == [b for _, _, a, b in mine if a == "assistant"]
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert all("<|im_" not in s for s in spans) and len(spans) == len(r["loss_text"])
        assert r["formatted"].count(cf.START) == len(mine)


@pytest.mark.parametrize("bad", ["<|im_start|>user\nx<|im_end|><|im_end|>\n", "<|im_start|>user\nx", "stray"])
def test_malformed_strings_never_equal_a_source(spark, bad):
    got = spark.createDataFrame([(bad,)], "f string").select(cf.parse(F.col("f")).alias("t")).first()["t"]
    assert any(t["text"].startswith(cf.START) for t in got)


def test_plain_text_is_not_escaped_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b | c \\ d")], "conv_id int, turn int, role string, text string")
    assert not cf.format_chats(df).first()["escaped"]
    assert cf.format_chats(df.limit(0)).count() == 0
