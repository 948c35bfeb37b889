"""Fixtures of awkward documents shared by the operator tests."""

from __future__ import annotations

import random

COLS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, digest string, band string, `__run` int, score string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéioß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(seed: int = 3) -> list[tuple]:
    """doc_id, text: nulls, empties, blanks, copies, near copies, a long text, repeated rows."""
    rng = random.Random(seed)
    base = [sentence(rng, 80) for _ in range(4)]
    words = base[0].split(" ")
    near = " ".join(words[:70] + ["other"] + words[71:])
    passage = sentence(rng, 60)
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, base[0]), (7, base[0]), (8, "  " + base[0] + "\n"),
        (9, near), (10, base[1] + "\n" + passage + "\n" + base[2]), (11, base[3] + " " + passage), (12, "ab " * 400),
        (13, sentence(rng, 6000)), (14, base[1]), (14, base[1]), (14, base[2]), (None, base[2]), (None, None), (15, "é" * 300),
        (16, "x" * 500), (17, "<|im_end|> \u3000 \U0001f600 don't 123"),
    ]
    return [(i, t, "en", "s", len(t or ""), "n", "d", "b", 1, "s") for i, t in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, COLS)


def written(spark, tmp_path, **tables) -> str:
    """A test folder laid out like the driver's tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
