"""Exact deduplication through a minimal perfect hash over known digests.

The *history* is one row for every distinct text digest seen so far with its
winner's locator (length, doc_id).  It is indexed by a minimal perfect hash:

* the top hash of a digest picks a part; a part has about ``PART_KEYS`` digests,
  so however large the history, an index task holds a bounded number of them;
* within a part, hash-and-displace: digests fall into buckets of about
  ``BUCKET_KEYS``; large buckets first, each gets a seed that sends all its
  digests to free slots; a bucket of one digest takes any free slot directly.
  ``n`` digests fill exactly ``n`` slots;
* the *seed table* has a row for each bucket, the *slot table* a row for each
  slot with the full 32-byte digest and the winner's locator.

A lookup joins the seed table on (part, bucket), computes the slot, joins the
slot table on (part, slot) and compares all bytes of the digest.  A digest that
is not in the history lands on some slot too; the comparison tells.  Members take
the group of their slot; nonmembers are grouped among themselves by digest.

Both joins have one row a key on the index side, so a digest that a third of all
rows share only makes one probe partition large, which adaptive execution splits;
the first aggregation combines before it shuffles.  Nothing is broadcast by hint.

Which row stays: the most code points in the original text, then the smallest
doc_id (null last); of wholly repeated rows one.  Null text counts as empty.
Texts are equal if they are after deleting blank, tab, LF, VT, FF and CR.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import fresh, materialize, text_or_empty

PART_KEYS = 50_000
BUCKET_KEYS = 4
MAX_SEED = 1 << 20  # far above what a bucket ever needs at this load

INDEX_COLS = "part int, part_keys int, kind string, at int, seed int, digest binary, n_chars bigint, keep_id bigint, rows bigint, ties bigint"


def normal_text(c: Column) -> Column:
    return F.translate(c, " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, digest`` of every row."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("n_chars"),
        F.unhex(F.sha2(normal_text(text).cast("binary"), 256)).alias("digest"),
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row for each digest: the winner's locator, group size, and how many
    rows carry that very locator (``ties``, 1 unless rows are repeated)."""
    same = rows.groupBy("digest", "n_chars", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # null doc_id sorts first under max of its negation, so it loses to any number
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg"), "n"))
    return same.groupBy("digest").agg(best.alias("b"), F.sum("n").alias("rows")).select(
        "digest", F.col("b.n_chars").alias("n_chars"), (-F.col("b.neg")).alias("keep_id"), "rows", F.col("b.n").alias("ties")
    )


def _words(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest (the first word picks the part)."""
    w = digest.view(">u8").reshape(len(digest), 4)
    return w[:, 1].astype(np.uint64), w[:, 2].astype(np.uint64)


# The slot of a digest under a seed, once for numpy and once for Spark: both take
# 31-bit pieces of the digest, so products stay below 2**62 and need no overflow.
def _slot_np(a: np.ndarray, b: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    m = (a + seed * b) % np.int64(2147483647)
    return (m * np.int64(48271) % np.int64(2147483647)) % n


def _slot_col(a: Column, b: Column, seed: Column, n: Column) -> Column:
    m = (a + seed.cast("bigint") * b) % F.lit(2147483647).cast("bigint")
    return ((m * F.lit(48271).cast("bigint") % F.lit(2147483647).cast("bigint")) % n).cast("int")


def _piece(digest: Column, byte: int, bits: int) -> Column:
    """``bits`` bits of a digest as a long, from the given byte on."""
    raw = F.conv(F.hex(F.substring(digest, byte + 1, 4)), 16, 10).cast("bigint")
    return raw.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def keyed(rows: DataFrame, parts: int) -> DataFrame:
    """Add ``part`` and the three hash pieces ``h0`` (bucket), ``h1``, ``h2``."""
    d = F.col("digest")
    return rows.withColumns(
        {
            "part": (_piece(d, 0, 31) % parts).cast("int"),
            "h0": _piece(d, 4, 31),
            "h1": _piece(d, 8, 31),
            "h2": _piece(d, 12, 20) + 1,
        }
    )


def place(h0: np.ndarray, h1: np.ndarray, h2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of all buckets and the slot of each key, for one part.

    A seed below zero names slot ``-seed - 1`` itself (bucket of one key).
    """
    n = len(h0)
    bucket = (h0 % buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(counts)])
    seeds = np.zeros(buckets, dtype=np.int64)
    slots = np.full(n, -1, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    tries = np.arange(1, 65, dtype=np.int64)
    singles = []
    for b in np.argsort(-counts, kind="stable"):
        size = counts[b]
        if size == 0:
            break
        keys = order[starts[b] : starts[b + 1]]
        if size == 1:
            singles.append((b, keys[0]))
            continue
        base = 0
        while True:
            at = _slot_np(h1[keys][None, :], h2[keys][None, :], (tries + base)[:, None], n)
            good = free[at].all(axis=1)
            if size > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                seeds[b] = base + hit[0] + 1
                slots[keys] = at[hit[0]]
                free[at[hit[0]]] = False
                break
            base += len(tries)
            if base >= MAX_SEED:
                raise ValueError("no seed separates a bucket: repeated digests in the history")
    for (b, key), slot in zip(singles, np.flatnonzero(free), strict=True):
        seeds[b], slots[key] = -slot - 1, slot
    return seeds, slots


def _index_part(buckets: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h0, h1, h2 = (pdf[c].to_numpy(np.int64) for c in ("h0", "h1", "h2"))
        seeds, slots = place(h0, h1, h2, buckets)
        used = np.unique(h0 % buckets)
        full = pdf[["digest", "n_chars", "keep_id", "rows", "ties"]].assign(kind="slot", at=slots, seed=0)
        bare = pd.DataFrame({"kind": "seed", "at": used, "seed": seeds[used]})
        both = pd.concat([full, bare], ignore_index=True).assign(part=pdf["part"].iloc[0], part_keys=len(pdf))
        return both[[c.split()[0] for c in INDEX_COLS.split(", ")]]

    return build


class DigestIndex:
    """The minimal perfect hash of a history: a seed table and a slot table."""

    def __init__(self, seeds: DataFrame, slots: DataFrame, parts: int, buckets: int):
        self.seeds, self.slots, self.parts, self.buckets = seeds, slots, parts, buckets

    @staticmethod
    def build(history: DataFrame) -> DigestIndex:
        """From ``digest, n_chars, keep_id, rows, ties``, one row a digest."""
        keys = history.count()
        parts = max(1, -(-keys // PART_KEYS))
        buckets = max(1, -(-keys // (parts * BUCKET_KEYS)))
        made = materialize(keyed(history, parts).groupBy("part").applyInPandas(_index_part(buckets), INDEX_COLS), "mph")
        seeds = made.filter("kind = 'seed'").select("part", F.col("at").alias("bucket"), "seed", "part_keys")
        slots = made.filter("kind = 'slot'").select(
            "part", F.col("at").alias("slot"), F.col("digest").alias("known_digest"),
            *[F.col(c).alias(f"known_{c}") for c in ("n_chars", "keep_id", "rows", "ties")],
        )
        return DigestIndex(seeds, slots, parts, buckets)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``digest``) plus ``known_*``, null for nonmembers."""
        probe = keyed(rows, self.parts).withColumn("bucket", (F.col("h0") % self.buckets).cast("int"))
        seeded = probe.join(self.seeds, ["part", "bucket"], "left")
        slot = F.when(F.col("seed") < 0, -F.col("seed") - 1).otherwise(
            _slot_col(F.col("h1"), F.col("h2"), F.col("seed"), F.col("part_keys"))
        )
        hit = seeded.withColumn("slot", slot).join(self.slots, ["part", "slot"], "left")
        member = F.col("known_digest") == F.col("digest")  # all 32 bytes
        return hit.select(*rows.columns, *[F.when(member, F.col(f"known_{c}")).alias(f"known_{c}") for c in ("n_chars", "keep_id", "rows", "ties")])


def exact_groups(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_chars, digest, keep_id, group_size, ties, kept`` for every row.

    ``history``: earlier documents; their digests are indexed, and rows of
    ``docs`` that repeat one are removed (``kept`` false, ``keep_id`` the earlier
    winner).  Nonmembers are grouped among themselves.  Without it the table's own
    digests are the history, so every row is a member.
    """
    rows = digests(docs)
    if history is None:
        looked = DigestIndex.build(materialize(distinct_digests(rows), "digests")).lookup(rows)
        return _judged(looked, "known_")
    index = DigestIndex.build(materialize(distinct_digests(digests(history)), "digests"))
    looked = materialize(index.lookup(rows), "looked")
    old = _judged(looked.filter("known_rows IS NOT NULL"), "known_").withColumn("kept", F.lit(False))
    new = looked.filter("known_rows IS NULL").select("doc_id", "n_chars", "digest")
    won = distinct_digests(new).withColumnsRenamed({c: f"won_{c}" for c in ("n_chars", "keep_id", "rows", "ties")})
    return old.unionByName(_judged(new.join(won, "digest"), "won_"))


def _judged(rows: DataFrame, p: str) -> DataFrame:
    return rows.select(
        "doc_id", "n_chars", "digest", F.col(f"{p}keep_id").alias("keep_id"), F.col(f"{p}rows").alias("group_size"),
        F.col(f"{p}ties").alias("ties"),
        (F.col("doc_id").eqNullSafe(F.col(f"{p}keep_id")) & (F.col("n_chars") == F.col(f"{p}n_chars"))).alias("kept"),
    )


def drop_repeats(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row left of every group of equal texts; all its columns.

    The decisions are made on narrow rows; texts move once, to meet them.
    """
    kept = materialize(exact_groups(docs, history).filter("kept").select("digest", "doc_id", "n_chars", "ties").distinct(), "kept")
    d, n, i, t, stays = fresh(docs, "digest", "n_chars", "doc", "ties", "keep")
    text = text_or_empty()
    tagged = docs.withColumns(
        {d: F.unhex(F.sha2(normal_text(text).cast("binary"), 256)), n: F.length(text).cast("bigint"), i: F.col("doc_id").cast("bigint")}
    )
    keys = kept.select(F.col("digest").alias(d), F.col("n_chars").alias(n), F.col("doc_id").alias(stays), F.col("ties").alias(t))
    out = tagged.join(keys, [d, n]).filter(F.col(i).eqNullSafe(F.col(stays))).drop(stays)
    if not kept.filter("ties > 1").isEmpty():  # rows repeated with their id: one of each stays
        out = out.filter(F.col(t) == 1).unionByName(out.filter(F.col(t) > 1).dropDuplicates([d]))
    return out.select(docs.columns)
