import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.llm import bpe
from tests.llm.helpers import awkward, frame

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\u3000aeiounst'")), max_size=200))
def test_same_ids_as_the_library(lib, text):
    c = bpe.coder(PATH, P.PATTERN)
    ids = c.encode(text)
    assert ids == lib.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


def test_multilingual_ranks_and_long_runs(lib):
    multi = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(multi)
    enc = tiktoken.Encoding("m", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.coder(multi, P.PATTERN)
    for t in ["ñandú Größe 数据 привет", "abcab" * 3000, "a" * 20000, "é" * 5000]:
        assert c.encode(t) == enc.encode_ordinary(t)
        assert bpe.coder(PATH, P.PATTERN).encode(t) == lib.encode_ordinary(t)


def test_columns(spark, lib):
    df = frame(spark).withColumn("ids", bpe.encode(F.col("text"), PATH, P.PATTERN))
    rows = df.withColumn("raw", bpe.decode(F.col("ids"), PATH, P.PATTERN)).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert list(r["ids"]) == lib.encode_ordinary(r["text"] or "") and bytes(r["raw"]) == (r["text"] or "").encode()
    assert df.limit(0).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t　aeiÉßñ的'7<|>!\"#$%&()*+,-./:;=?@[\\]^_`{}~"), max_size=60), max_size=6))
def test_a_batch_has_the_ids_of_its_texts(lib, texts):
    got = bpe.coder(PATH, P.PATTERN).encode_all(texts)
    assert [x.tolist() for x in got] == [lib.encode_ordinary(t) for t in texts]


def test_a_batch_encodes_each_distinct_piece_once():
    c = bpe.BytePairCoder(bpe.read_ranks(PATH), P.PATTERN)
    asked, plain = [], c.encode_piece
    c.encode_piece = lambda raw: (asked.append(raw), plain(raw))[1]
    c.encode_all(["start " + "anhe thonre, thonre. anhe$$$ anhe! " * 50 + "end"] * 3)
    assert len(asked) == len(set(asked)) == 8


def test_each_row_is_encoded_once_where_its_ids_are_decoded_too(spark, tmp_path, capfd):
    from sitelens.llm.q_bpe import op4
    from tests.llm.helpers import written

    op4(spark, written(spark, tmp_path, documents=frame(spark))).explain()
    evals = [line for line in capfd.readouterr().out.splitlines() if "ArrowEvalPython [" in line]
    assert sum(line.count("bpe_encode(") for line in evals) == 1 and sum(line.count("bpe_decode(") for line in evals) == 1


def test_many_new_pieces_are_merged_in_step(lib):
    rng = random.Random(5)
    words = list(dict.fromkeys("".join(rng.choice("abcdeéioßnrst的") for _ in range(rng.randint(1, 14))) for _ in range(3000)))
    c = bpe.BytePairCoder(bpe.read_ranks(PATH), P.PATTERN)
    one, merged, step = c.encode_piece, [], c.merges.packed
    c.merges.packed = lambda raws: (merged.extend(raws), step(raws))[1]
    c.encode_piece = lambda raw: one(raw) if raw in c.ranks or len(raw) > bpe.MATRIX_BYTES or not raw.startswith(b" ") else 1 / 0
    text = "start " + " ".join(words + words)
    assert c.encode(text) == lib.encode_ordinary(text)
    assert len(merged) == len(set(merged)) > bpe.MATRIX_PIECES
    assert [np.frombuffer(x, "<u4").tolist() for x in step([b"a", b"aaaaaaa", b"zq" * 9])] == [list(one(x)) for x in (b"a", b"aaaaaaa", b"zq" * 9)]


def test_ids_that_are_no_tokens_are_refused():
    t = bpe.tokens(PATH)
    with pytest.raises((ValueError, IndexError)):
        t.join(pa.array([0, len(t.bytes)]), np.asarray([0, 2]))
    assert t.join(pa.array([], pa.int32()), np.asarray([0, 0])).to_pylist() == [b""]
