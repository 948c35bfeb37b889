"""Trie of conversation prefixes by a splitter skeleton.

A conversation is the path of its turns in order; every distinct sequence of first
``d`` turns is a node of depth ``d``, and the conversations that start with it are
its members.  Paths are range-partitioned in their lexicographic order.  A node
that is no prefix of a splitter has all its members in one range, so the range's
sorted shard finishes it alone; the prefixes of the splitters form the *skeleton*,
a small trie that every task gets, whose nodes are finished by adding up what the
shards found of them.

Steps:

1. *Turns* become 128 bits of SHA-256 over (role, text) and a word count; texts go
   no further.  A conversation is one row with its turns' digests in order.
2. *Ends.*  Conversations with the same whole path meet by the path's digest: first
   range-partitioned by (path, conv_id), where runs of ascending ids become blocks
   of at most ``BLOCK_IDS``, then block by block in order through one running hash.
   However many copies a path has, a task reads its ids as a stream of blocks.
3. *Splitters.*  The distinct paths whose digest (uniform) is below a threshold are
   the sample, about ``SAMPLE`` for each shard; splitters are its quantiles, cut
   to the shortest prefix that still exceeds the path before it.
4. *Shards.*  Each task reads its paths in order with a stack of the open nodes.
   A node that is closed outside the skeleton is whole; one inside it leaves a
   partial row.
5. *Reduction.*  Partial rows are summed by skeleton node; the sums (one row a
   skeleton node) are folded from the leaves to the root.

Bounds: at most ``MAX_SHARDS`` splitters, so the skeleton has at most that many
times the depth at which sampled paths part; a task holds the open path and, of its
nodes outside the skeleton, the finished children, at most its shard.  A
conversation must fit a row (32 bytes a turn).

Defined cases: rows without conv_id belong to no conversation; null role or text is
empty; turns are ordered by number (null first), equal numbers by the digest;
repeated rows are turns each; a path without turns is a member of the root only; an
empty table has no nodes.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import materialize, text_or_empty

BLOCK_IDS = 4096
BATCH = 4096  # rows of an output batch
SHARD_PATHS = 20_000
SAMPLE = 16
MAX_SHARDS = 4096
BROADCAST_NODES = 1 << 18  # skeleton nodes up to which their rows are broadcast
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = (
    "conv_id bigint, depth bigint, turn_key string, words bigint, parent_conv_id bigint, parent_skeleton bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, skeleton bigint"
)
_COLUMNS = [c.split(" ")[0] for c in _NODE.split(", ")]
_NODE_ARROW = pa.schema([(c, pa.string() if c in ("turn_key", "ends_sha256") else pa.int64()) for c in _COLUMNS])


# ------------------------------------------------------------------ paths


def turn_key(role: Column, text: Column) -> Column:
    """32 hex digits of SHA-256 over (role, text); the length keeps the two apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 32)


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, turn_key, words`` of every row that has a conv_id."""
    role, text = text_or_empty("role"), text_or_empty("text")
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        turn_key(role, text).alias("turn_key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id, turns``, an array of ``(turn_key, words)`` in order."""
    rows = keyed_turns(conversations).select("conv_id", F.struct("turn", "turn_key", "words").alias("t"))
    return rows.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["turn_key"], t["words"])).alias("turns")
    )


# ------------------------------------------------------------------ members that end at a node


def _blocker(most: int):
    """Runs of one path's ascending ids, joined, at most ``most`` in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        out: list[tuple] = []
        for b in batches:
            for k, i in zip(b.column("path_key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= most):
                    out.append((key, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                    if len(out) >= BATCH:
                        yield _batch(out, "path_key", "first_id", "n", "ids")
                        out.clear()
                key = k
                ids.append(i)
        if ids:
            out.append((key, ids[0], len(ids), ",".join(map(str, ids))))
        if out:
            yield _batch(out, "path_key", "first_id", "n", "ids")

    return run


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path_key, rep, n, ends_sha256``: blocks in order through one running hash a path."""
    key, rep, n, running = None, None, 0, None
    out: list[tuple] = []
    for b in batches:
        for k, first, m, ids in zip(*(b.column(c).to_pylist() for c in ("path_key", "first_id", "n", "ids")), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, rep, n, running.hexdigest()))
                key, rep, n, running = k, first, 0, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
            n += m
        if len(out) >= BATCH:
            yield _batch(out, "path_key", "rep", "n", "ends_sha256")
            out.clear()
    if key is not None:
        out.append((key, rep, n, running.hexdigest()))
    if out:
        yield _batch(out, "path_key", "rep", "n", "ends_sha256")


def path_ends(paths: DataFrame) -> DataFrame:
    """``path_key, rep, n, ends_sha256`` of every distinct whole path in ``path_key, conv_id``."""
    ids = paths.select("path_key", "conv_id").repartitionByRange("path_key", "conv_id").sortWithinPartitions("path_key", "conv_id")
    blocks = ids.mapInArrow(_blocker(BLOCK_IDS), "path_key string, first_id bigint, n bigint, ids string")
    ordered = blocks.repartition("path_key").sortWithinPartitions("path_key", "first_id")
    return ordered.mapInArrow(_fold_blocks, "path_key string, rep bigint, n bigint, ends_sha256 string")


# ------------------------------------------------------------------ skeleton


def splitters_of(sample: list[list[str]], shards: int) -> list[list[str]]:
    """At most ``shards - 1`` ascending splitters: quantiles of the sample, each cut to
    the shortest prefix above the sampled path before it."""
    sample = sorted(sample)
    out: list[list[str]] = []
    for k in range(1, shards):
        at = k * len(sample) // shards
        if not 0 < at < len(sample):
            continue
        cut = sample[at][: common(sample[at - 1], sample[at]) + 1]
        if not out or cut > out[-1]:
            out.append(cut)
    return out


def common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def skeleton_of(splitters: list[list[str]]) -> dict[tuple[int, str], int]:
    """The trie of the splitters: (parent, turn) to node; 0 is the root, parents come first."""
    trie: dict[tuple[int, str], int] = {}
    for s in splitters:
        at = 0
        for turn in s:
            at = trie.setdefault((at, turn), len(trie) + 1)
    return trie


# ------------------------------------------------------------------ shards


class _Open:
    """A node on the current path."""

    __slots__ = ("turn", "words", "skeleton", "conv", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, turn: str | None, words: int, skeleton: int | None):
        self.turn, self.words, self.skeleton = turn, words, skeleton
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting = None, []

    def join(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n


def walk(rows: Iterator[tuple], skeleton: dict[tuple[int, str], int]) -> Iterator[tuple]:
    """Nodes of sorted distinct paths ``(shard, turn keys, words, rep, n, ends)``, as
    rows of ``_NODE``: whole ones, and partial ones with their skeleton number."""
    stack: list[_Open] = []
    shard, path = None, []

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        for child in node.waiting:
            yield (*child[:4], node.conv, *child[5:])
        if stack:
            stack[-1].join(node.conv, node.n)
        if node.skeleton is not None:
            yield (node.conv, depth, node.turn, node.words, None, None, node.n, node.children, node.leaves, node.saved, node.ends, node.skeleton)
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.words
        up = stack[-1]
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        row = (node.conv, depth, node.turn, node.words, None, up.skeleton, node.n, node.children, leaves, saved, node.ends, None)
        if up.skeleton is None:
            up.waiting.append(row)
        else:
            yield row

    for s, turns, words, rep, n, ends in rows:
        if s != shard:
            while stack:
                yield from close()
            shard, path = s, []
            stack.append(_Open(None, 0, 0))
        keep = common(path, turns)
        while len(stack) > keep + 1:
            yield from close()
        for turn, w in zip(turns[keep:], words[keep:], strict=True):
            up = stack[-1].skeleton
            stack.append(_Open(turn, w, None if up is None else skeleton.get((up, turn))))
        stack[-1].join(rep, n)
        stack[-1].ends = ends
        path = turns
    while stack:
        yield from close()


def _assigner(splitters: list[list[str]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [bisect_right(splitters, p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    return assign


def _walker(skeleton: dict[tuple[int, str], int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("shard", "path", "words", "rep", "n", "ends_sha256")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODE_ARROW, strict=True)], schema=_NODE_ARROW)

        for node in walk(rows(batches), skeleton):
            out.append(node)
            if len(out) >= 8192:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def fold_skeleton(sums: dict[int, dict], skeleton: dict[tuple[int, str], int]) -> list[tuple]:
    """Whole rows of the skeleton's nodes from the summed partial rows, leaves first."""
    parent = {0: None} | {node: up for (up, _), node in skeleton.items()}
    for node in sorted(sums, reverse=True):
        s = sums[node]
        s["n_leaves"] = s["n_leaves"] if s["n_children"] else 1
        s["saved_tokens"] += (s["n_convs"] - 1) * s["words"]
        if parent[node] is not None:
            up = sums[parent[node]]
            up["n_children"] += 1
            up["n_leaves"] += s["n_leaves"]
            up["saved_tokens"] += s["saved_tokens"]
    out = []
    for node, s in sums.items():
        above = None if parent[node] is None else sums[parent[node]]["conv_id"]
        out.append(tuple({**s, "parent_conv_id": above, "parent_skeleton": None, "skeleton": node}[c] for c in _COLUMNS))
    return out


# ------------------------------------------------------------------ operator


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of ``paths`` (``conv_id, turns`` as of ``conversation_paths``,
    one row a conversation).

    Returns ``conv_id`` (smallest member), ``depth``, ``turn_key`` and ``words`` of the
    last turn, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (of the subtree, each node's ``(n_convs - 1) * words``) and
    ``ends_sha256`` (over the ascending, comma-joined ids of the members that end
    here).  ``(conv_id, depth)`` is unique.
    """
    spark = paths.sparkSession
    flat = paths.select(
        "conv_id", F.transform("turns", lambda t: t["turn_key"]).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")
    )
    keyed = materialize(flat.withColumn("path_key", F.sha2(F.array_join("path", "").cast("binary"), 256)), "trie-paths")
    distinct = keyed.groupBy("path_key").agg(F.first(F.struct("path", "words")).alias("p")).select("path_key", "p.path", "p.words")
    ways = materialize(distinct.join(path_ends(keyed), "path_key"), "trie-ways")

    n = ways.count()
    if shards is None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shards = min(MAX_SHARDS, max(least, -(-n // SHARD_PATHS)))
    share = min(1.0, SAMPLE * shards / max(n, 1))
    drawn = ways.filter(F.conv(F.substring("path_key", 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32)))
    splitters = splitters_of([list(r["path"]) for r in drawn.select("path").collect()], shards)
    skeleton = skeleton_of(splitters)

    dealt = ways.drop("path_key").mapInArrow(
        _assigner(splitters), "shard int, path array<string>, words array<bigint>, rep bigint, n bigint, ends_sha256 string"
    )
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path")
    found = materialize(ordered.mapInArrow(_walker(skeleton), _NODE), "trie-nodes")

    partial = found.filter("skeleton IS NOT NULL").groupBy("skeleton").agg(
        *[F.min(c).alias(c) for c in ("conv_id", "depth", "turn_key", "words")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    # one row a node of the skeleton, which the driver has built itself
    sums = {r["skeleton"]: r.asDict() for r in partial.collect()}
    top = spark.createDataFrame(fold_skeleton(sums, skeleton), _NODE)

    above = top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above"))
    above = F.broadcast(above) if len(sums) <= BROADCAST_NODES else above
    own = found.filter("skeleton IS NULL")
    under = own.filter("parent_skeleton IS NOT NULL").join(above, "parent_skeleton").withColumn("parent_conv_id", F.col("above"))
    every = own.filter("parent_skeleton IS NULL").unionByName(under.select(_COLUMNS)).unionByName(top)
    return every.drop("parent_skeleton", "skeleton").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Adds ``role`` and ``text`` of the last turn (null for the root) to the nodes."""
    turns = keyed_turns(conversations).groupBy("turn_key").agg(F.first(F.struct("role", "text")).alias("t")).select("turn_key", "t.role", "t.text")
    return nodes.join(turns, "turn_key", "left")
