import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitelens.llm import packing as pk
from sitelens.llm.batch_words import remembered, together
from sitelens.llm.common import Recent
from sitelens.llm.q_pack import CAPACITY, pack_documents
from tests.llm.helpers import awkward, frame

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True
PLAIN_LIB = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,'!aeiouÉß́")), max_size=120))
def test_same_ids_as_the_library(text):
    want = np.asarray(LIB.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert pk.word_coder(PATH).pack(text) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "hello", "É", "\u0301", "ß", " ", "\n", "\u3000", ".", "'s", "7"]), max_size=12).map("".join))
def test_special_strings_as_in_the_plain_call(text):
    want = np.asarray(PLAIN_LIB.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert pk.word_coder(PATH).pack(text) == want


def test_special_strings_have_their_own_ids():
    got = np.frombuffer(pk.word_coder(PATH).pack("hello <|endoftext|> world<|startoftext|>"), dtype="<u4")
    assert got.tolist() == [3306, 49407, 1002, 49406]


def test_plan_uses_every_document_once_and_fits():
    rng = random.Random(2)
    for capacity in (10, 100, 4096):
        counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(60)}
        used, bins = {}, {}
        for length, first, times, sequence, at in pk.plan(counts, capacity):
            used.setdefault(length, []).append(first)
            bins.setdefault(sequence, [times, 0])
            bins[sequence][1] = max(bins[sequence][1], at + length)
        assert all(full <= capacity for _, full in bins.values())
        n = sum(t for t, _ in bins.values())
        need = -(-sum(k * c for k, c in counts.items()) // capacity)
        assert need <= n <= need * 1.2 + 2


def test_two_replace_the_smallest():
    # greedy takes 6 and 3 (gap 1); 3 makes way for 2 + 2, which fill the bin
    assert pk.one_bin(pk._Lengths({6: 1, 3: 1, 2: 2}), 10) == {6: 1, 2: 2}
    # greedy is already full
    assert pk.one_bin(pk._Lengths({6: 1, 4: 1, 2: 2}), 10) == {6: 1, 4: 1}


def check(rows, docs):
    tokens = {}
    for r in docs:
        tokens.setdefault(r[0], []).append(LIB.encode(r[1] or "", add_special_tokens=False).ids + [1])
    want = sorted((repr(i), k // CAPACITY, k, len(x[k : k + CAPACITY]), zlib.crc32(np.asarray(x[k : k + CAPACITY], dtype="<u4").tobytes())) for i, xs in tokens.items() for x in xs for k in range(0, len(x), CAPACITY))
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY


def test_documents(spark):
    check(pack_documents(frame(spark)).collect(), awkward())
    assert pack_documents(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t　\x1c\x85aeiÉßñ的́'7<|>!\"#$%&()*+,-./:;=?@[\\]^_`{}~"), max_size=60), max_size=6))
def test_a_batch_has_the_ids_of_its_texts(texts):
    want = [np.asarray(PLAIN_LIB.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert pk.word_coder(PATH).pack_all(texts) == want


def test_a_batch_asks_the_library_once_for_each_distinct_part():
    c, asked = pk.WordCoder(PATH), []
    model = c.model

    class Counting:
        def tokenize(self, part):
            asked.append(part)
            return model.tokenize(part)

    c.model = Counting()
    c.pack_all([None, "Anhe thonre, THONRE. anhe$$$ anhe! " * 50, "anhe"])
    assert sorted(asked) == sorted(["anhe", "thonre", ",", ".", "$$$", "!"])


def test_neighbouring_batches_are_encoded_together():
    batches = [pa.array(t, pa.string()) for t in (["anhe thonre", None], [], ["thonre, anhe"], ["a" * 100], ["anhe"])]
    joined = [x.to_pylist() for x in together(iter(batches), 80)]
    assert joined == [["anhe thonre", "", "thonre, anhe", "a" * 100], ["anhe"]]
    assert list(together(iter([]), 80)) == []


def test_cut_pieces_as_one_by_one():
    lengths, capacity, end = [0, 3, 4, 5, 0, 7, 8, 9, 1], 4, 1
    ids = np.arange(100, 100 + sum(lengths), dtype="<u4")
    at = np.concatenate([[0], np.cumsum(lengths)])
    want = []
    for a, b in zip(at, at[1:]):
        whole = np.append(ids[a:b], np.uint32(end)).astype("<u4")
        parts = [whole[k : k + capacity] for k in range(0, len(whole), capacity)]
        want.append([{"piece": i, "start": i * capacity, "length": len(x), "ids_crc32": zlib.crc32(x.tobytes())} for i, x in enumerate(parts)])
    assert pk.cut_pieces(ids, at, capacity, end).to_pylist() == want
    assert pk.cut_pieces(ids[:0], at[:1], capacity, end).to_pylist() == []


def test_a_memo_keeps_what_was_used_lately():
    memo, made = Recent(2), []

    def make(keys):
        made.extend(keys)
        return [k.encode() for k in keys]

    for keys in (["a", "b"], ["c", "long"], ["a", "c"], ["a", "d"], ["e"], ["a", "long"]):
        assert remembered(memo, keys, make, 3) == [k.encode() for k in keys]
    assert made == ["a", "b", "c", "long", "d", "e", "long"]
    assert len(memo.young) + len(memo.old) <= 8
