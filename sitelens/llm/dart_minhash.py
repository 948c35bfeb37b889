"""Near-duplicate groups by DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles, the weight being how often a
shingle occurs; similarity is the weighted Jaccard ratio sum min / sum max.

*Darts.*  The plane of weight x rank is cut into unit strips of weight.  In strip
``j`` of shingle ``s`` the hash of ``(s, j)`` throws an endless sequence of darts
whose ranks rise by exponential gaps.  A text holds a dart if its strip lies below
the shingle's weight (a part strip: if the dart's height does), so two texts hold
common darts just where their weights overlap.  Every dart falls on one of
``COORDINATES`` coordinates and each coordinate keeps its earliest dart.  Darts are
only thrown up to a rank at which, on average, ``t = k ln k + 2 k`` fall on the
text; if a coordinate is still empty, that rank is doubled.  So a signature costs
about ``k ln k`` darts plus one hash a shingle, however long the text.  Coordinates
agree with probability equal to the similarity.

*Joining.*  Equal texts are one node (a group of a thousand copies is one row).
Signatures are cut into ``BANDS`` bands of ``ROWS``; nodes that share a band are
candidates.  Buckets are worked in rounds: in each, a bucket names one centre and
every node that is not yet connected with it is checked against it, exactly, on
the shingles themselves; then connected components are formed.  The first round's
centre is the smallest node, later ones the node with most links so far (the
original of many edited copies rather than one of the copies).  Buckets whose
nodes are all connected are finished.  When a round connects nothing more, what is
left are nodes of different components in one bucket; those pairs, and only
those, are checked one by one.  So every candidate pair either is in one group
already or has been checked, and a large group is never expanded into its pairs.
Many texts that are somewhat alike, but not enough, would still be fetched pair by
pair here; so a pair must first pass a bound that loses nothing: with the shingles
of each text counted in ``CELLS`` cells by their hash, the sum of the smaller counts
is at least the texts' common weight.
Before texts are fetched, a pair's signatures must agree on a share of coordinates
no less than the threshold minus ``SLACK`` (5.6 standard deviations); a pair at the
threshold that shares a band fails this with probability below 1e-6.

Similarity at the threshold is found with probability
``1 - (1 - 0.8^ROWS)^BANDS`` > 0.9999, from which the signatures take that 1e-6.

Defined cases: null text is empty, and all texts without a word form one group;
texts shorter than a shingle match only when their words are equal; repeated rows
and ids stay rows of their group; ties resolve to the smallest id; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import lean, materialize, text_or_empty
from sitelens.llm.shingles import counted, mix, shingles

BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
THRESHOLD = 0.8
#: A candidate is checked on its text if the share of agreeing coordinates, whose
#: standard deviation is 0.036 at 0.8, lies at most this far below the threshold.
SLACK = 0.2
#: Cells that a text's shingles are counted in.
CELLS = 512


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1)))


def darts(text: np.ndarray, h: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts ``(text, dart hash, rank)`` on the texts up to rank ``bound[text]``."""
    whole = np.ceil(weight).astype(np.int64)
    item = np.repeat(np.arange(len(h)), whole)
    strip = np.arange(len(item)) - np.repeat(np.cumsum(whole) - whole, whole)
    cell = mix(h[item] + mix(strip.astype(np.uint64) + np.uint64(1)))
    height = weight[item] - strip  # how much of the strip the element fills
    top, owner = bound[text[item]], text[item]
    rank = np.zeros(len(item))
    found = []
    number = 0
    while len(item):
        number += 1
        dart = _salted(cell, 2 * number)
        rank = rank - np.log(_uniform(dart))
        keep = rank < top
        item, cell, height, top, owner, rank, dart = (x[keep] for x in (item, cell, height, top, owner, rank, dart))
        hit = (height >= 1) | (_uniform(_salted(cell, 2 * number + 1)) < height)
        found.append((owner[hit], dart[hit], rank[hit]))
    return tuple(np.concatenate(c) if found else np.zeros(0) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def signatures(n: int, text: np.ndarray, h: np.ndarray, weight: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """``n x k`` dart hashes; a text without elements has zeros."""
    out = np.zeros((n, k), dtype=np.uint64)
    mass = np.bincount(text, weight, n)
    t = k * np.log(k) + 2 * k
    bound = np.divide(t, mass, out=np.zeros(n), where=mass > 0)
    open_ = mass > 0
    while open_.any():
        mine = open_[text]
        owner, dart, rank = darts(text[mine], h[mine], weight[mine], bound)
        place = mix(dart ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(k)
        slot = owner * k + place.astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot = slot[order]
        first = np.ones(len(slot), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        got = np.zeros((n, k), dtype=bool)
        got.ravel()[slot[first]] = True
        done = open_ & got.all(1)
        rows = done[slot[first] // k]
        out.ravel()[slot[first][rows]] = dart[order][first][rows]
        open_ &= ~done
        bound = bound * 2
    return out


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lean("minhash")
    for pdf in batches:
        text, h = shingles(list(pdf["text"]))
        text, h, times = counted(text, h)
        sig = signatures(len(pdf), text, h, times.astype(float))
        # a band's key also holds its number; a text without words has one key of its own
        keys = np.zeros((len(pdf), BANDS), dtype=np.uint64)
        for b in range(BANDS):
            k = np.full(len(pdf), b + 1, dtype=np.uint64)
            for c in range(b * ROWS, (b + 1) * ROWS):
                k = mix(k + sig[:, c])
            keys[:, b] = k
        # 16 bits of each coordinate are enough to see whether two agree
        short = (sig >> np.uint64(40)).astype(np.uint16).view(np.int16)
        yield pd.DataFrame({"node": pdf["node"], "bands": list(keys.view(np.int64)), "sig": list(short)})


def _agree(a: str, b: str) -> Column:
    """On how many coordinates two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _in_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lean("minhash")
    for pdf in batches:
        n = len(pdf)
        text, h = shingles(list(pdf["text"]))
        cell = text * CELLS + (h % np.uint64(CELLS)).astype(np.int64)
        counts = np.bincount(cell, minlength=n * CELLS).reshape(n, CELLS)
        # where a count does not fit, the text has no cells and no bound
        fits = counts.max(axis=1, initial=0) <= np.iinfo(np.int16).max
        cells = [row if ok else None for row, ok in zip(counts.astype(np.int16), fits, strict=True)]
        yield pd.DataFrame({"node": pdf["node"], "mass": np.bincount(text, minlength=n), "cells": cells})


def in_cells(texts: DataFrame) -> DataFrame:
    """``node, mass, cells``: how many shingles a text has, in all and by cell."""
    return texts.select("node", "text").mapInPandas(_in_cells, "node binary, mass bigint, cells array<smallint>")


def _may_reach(threshold: float) -> Column:
    """False only if the similarity of texts ``a`` and ``b`` is below the threshold."""
    common = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda x, y: x + y)
    enough = common * (1 + threshold) + 1e-6 >= (F.col("mass_a") + F.col("mass_b")) * threshold
    return F.coalesce(enough, F.lit(True))


def _similar(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean("minhash")
        for pdf in batches:
            n = len(pdf)
            both, h = shingles([*pdf["text_a"], *pdf["text_b"]])
            side, h, times = counted(both, h)
            pair = side % n
            order = np.lexsort((side, h, pair))
            pair, h, times = pair[order], h[order], times[order]
            twin = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
            low = np.bincount(pair[twin], np.minimum(times[twin], times[twin + 1]), n)
            total = np.bincount(pair, times, n)
            alike = np.where(total > 0, low / np.maximum(total - low, 1), 1.0)
            yield pdf.loc[alike >= threshold, ["a", "b"]]

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingles are at least that similar."""
    one = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInPandas(_similar(threshold), "a binary, b binary")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, root``: the smallest node that each linked node is connected with.

    Every round a node takes the smallest root among its neighbours' and its
    root's own, so the rounds grow with the logarithm of a component's diameter.
    Each round is written to the shared folder.  With ``known`` (earlier labels)
    the edges are contracted to its roots first, and only what they newly connect
    is worked on.
    """
    if known is not None:
        for end in ("a", "b"):
            at = known.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            edges = edges.join(at, end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
        edges = edges.filter("a <> b").select("a", "b")
    links = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = materialize(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    moved = not links.isEmpty()
    while moved:
        near = links.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        up = label.select(F.col("node").alias("at"), F.col("root").alias("upper"))
        step = label.join(near.withColumnRenamed("a", "node"), "node").join(up, F.col("root") == F.col("at"))
        new = materialize(step.select("node", F.col("root").alias("was"), F.least("root", "near", "upper").alias("root")), "labels")
        label = new.select("node", "root")
        moved = not new.filter("root <> was").isEmpty()
    if known is None:
        return label
    higher = label.select(F.col("node").alias("old"), F.col("root").alias("higher"))
    raised = known.join(higher, F.col("root") == F.col("old"), "left").select("node", F.coalesce("higher", "root").alias("root"))
    fresh_nodes = label.join(known.select("node"), "node", "left_anti")
    return materialize(raised.union(fresh_nodes), "labels")


def _centres(bands: DataFrame, labels: DataFrame | None, edges: DataFrame | None) -> DataFrame:
    """``centre, centre_root, node`` to check: one centre for each unfinished bucket."""
    if labels is None:
        rooted = bands.withColumn("root", F.col("node"))
        score = F.lit(0).cast("bigint")
    else:
        degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        rooted = bands.join(labels.join(degree, "node", "left"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        score = F.coalesce(F.col("links"), F.lit(0))
    # max of (links, node) prefers hubs; buckets of one component are finished
    best = rooted.groupBy("band").agg(
        F.max(F.struct(score.alias("links"), F.col("node").alias("centre"), F.col("root").alias("centre_root"))).alias("c"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    )
    open_ = best.filter("low <> high").select("band", "c.centre", "c.centre_root")
    return rooted.select("band", "node", "root").join(open_, "band").filter(F.col("root") != F.col("centre_root"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, node, class_id, root, kept`` for every row of ``docs``.

    ``class_id`` is the smallest doc_id of the near-duplicate group; rows with the
    same text share ``node``.  Groups are told apart by ``root``, their smallest
    node: where ids are null or repeated with different texts, several groups have
    one ``class_id``.  ``kept`` marks the group's smallest (doc_id, node), null ids
    last; only rows that repeat both id and text are marked together.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn(
        "node", F.unhex(F.md5(F.col("text").cast("binary")))
    )
    sketches = materialize(
        rows.select("node", "text").mapInPandas(_sketches, "node binary, bands array<bigint>, sig array<smallint>").dropDuplicates(["node"]), "sketches"
    )
    bands = sketches.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    bands = materialize(bands.join(shared, "band"), "buckets")
    least = int((threshold - SLACK) * COORDINATES)

    ids = materialize(rows.select("doc_id", "node"), "ids")
    nodes = bands.select("node").distinct()
    sigs = materialize(sketches.join(nodes, "node"), "sigs")
    wanted = nodes.join(ids, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = materialize(
        rows.join(wanted.withColumnRenamed("doc_id", "rep"), [rows["node"] == wanted["node"], rows["doc_id"].eqNullSafe(F.col("rep"))], "left_semi")
        .select("node", "text").dropDuplicates(["node"]),
        "texts",
    )
    edges = labels = checked = None
    while True:
        todo = _centres(bands, labels, edges).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        if checked is not None:
            todo = todo.join(checked, ["a", "b"], "left_anti")
        todo = materialize(todo, "pairs")
        likely = todo
        for end in ("a", "b"):
            likely = likely.join(sigs.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}")), end)
        found = materialize(verified(likely.filter(_agree("sig_a", "sig_b") >= least), texts, threshold), "edges")
        checked = todo if checked is None else checked.union(todo)
        if found.isEmpty():
            break
        edges = found if edges is None else edges.union(found)
        labels = components(found, labels)
    left = bands if labels is None else bands.join(labels, "node", "left")
    left = left.withColumn("root", F.coalesce("root", "node") if labels is not None else F.col("node"))
    mixed = left.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    rest = materialize(left.join(mixed, "band").select("band", "node", "root"), "rest")
    cells = materialize(in_cells(texts.join(rest.select("node").distinct(), "node")), "cells")
    rest = materialize(rest.join(sigs, "node").join(cells, "node"), "rest")
    parts = ("root", "sig", "bands", "mass", "cells")
    one, two = (rest.select(F.col("band").alias(f"band_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in parts], F.col("node").alias(x)) for x in "ab")
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    # a pair counts in the first band that it shares, so each comes out once
    first = F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == F.col("band_a")
    worth = (_agree("sig_a", "sig_b") >= least) & _may_reach(threshold)
    cross = one.join(two, (F.col("band_a") == F.col("band_b")) & apart & first & worth).select("a", "b")
    both = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialize(verified(cross.join(both, ["a", "b"], "left_anti"), texts, threshold), "edges")
    if not more.isEmpty():
        labels = components(more, labels)
    if labels is None:
        rooted = ids.withColumn("root", F.col("node"))
    else:
        rooted = ids.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return rooted.join(smallest, "root").select("doc_id", "node", F.col("first.doc_id").alias("class_id"), "root", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of every near-duplicate group (its smallest doc_id and node)."""
    from sitelens.llm.common import fresh

    groups = near_groups(docs, threshold)
    stay = materialize(groups.filter("kept").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")), "stay")
    node, key, times = fresh(docs, "node", "key", "times")
    keys = stay.select(F.col("doc_id").alias(key), F.col("node").alias(node), F.col("n").alias(times))
    tagged = docs.withColumn(node, F.unhex(F.md5(text_or_empty().cast("binary"))))
    out = tagged.join(keys, (F.col("doc_id").cast("bigint").eqNullSafe(F.col(key))) & (tagged[node] == keys[node])).drop(keys[node])
    if not stay.filter("n > 1").isEmpty():  # rows that are repeated
        out = out.filter(F.col(times) == 1).unionByName(out.filter(F.col(times) > 1).dropDuplicates([node]))
    return out.select(docs.columns)
