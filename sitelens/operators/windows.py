"""Fixed windows that open at an event, by successor pointers (W1-W3, batch).

A key's first event opens a window; the next window opens at the first event at or
after its expiry.  Which events open windows is a chain, event by event.  Where a key
has been busy without a pause for up to ``FOLD`` events, the chain is folded over their
sorted times in one row; beyond that it is followed with pointers that are doubled, so
a key that never pauses costs logarithmically many joins and no task processes it from
end to end.  Both give the same openings.

1. *Slices.*  A window is cut into ``SLICES`` slices of time.  Counts by (key, slice),
   summed over a key's slices on that compact table, give every event its number
   in the key (``idx``) from its place in the slice.  A gap of a window between
   neighbouring slices starts a new *burst*: a window surely opens there.
2. *Folding.*  A burst no longer than a window opens one; bursts of at most ``FOLD``
   events are folded by an expression over the array of their times.
3. *Successors* of the events of all other bursts.  An event that opens
   a window expires it at ``x``; its successor is the event after the last one
   before ``x``, and the number of those is a count again: of the slices before
   ``x``'s and, within that slice, of the events before ``x``.
4. *Doubling.*  From ``idx -> successor`` come jumps of 4, 16, .. windows by equi-joins;
   the set of openings, at first the bursts' first events, grows fourfold a round.
5. *Ranks.*  At most one window opens in a slice.  Events look up the opening at or
   before them, and ``idx - opening + 1`` is their rank in the window.

Windows of the functions below run over (key, slice), or over a key's slices (as
many as time has, however many events).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.storage import written

SLICES = 16  # a power of two divides any whole number of seconds in microseconds
FOLD = 1 << 17  # events of a burst whose times may stand in one row (1 MiB)
FAN = 4


def slice_of(t: Column, window_us: int) -> Column:
    width = window_us // SLICES
    return ((t - F.pmod(t, F.lit(width))) / width).cast("bigint")


def slices_of(events: DataFrame, window_us: int) -> DataFrame:
    """The compact table of ``events`` (``k, slice, t``): ``k, slice, n, before, first_t, burst``
    and, of the burst, ``burst_first, burst_last`` (numbers), ``burst_start`` and ``burst_us``."""
    per = events.groupBy("k", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    by_key = Window.partitionBy("k").orderBy("slice")
    quiet = F.col("first_t") - F.lag("last_t").over(by_key) >= window_us
    flagged = per.select("*", (F.sum("n").over(by_key) - F.col("n")).alias("before"), F.coalesce(quiet, F.lit(True)).cast("int").alias("opens"))
    bursts = flagged.withColumn("burst", F.sum("opens").over(by_key))
    whole = Window.partitionBy("k", "burst")
    return written(
        bursts.select(
            "k", "slice", "n", "before", "first_t", "burst",
            (F.min("before").over(whole) + 1).alias("burst_first"),
            F.max(F.col("before") + F.col("n")).over(whole).alias("burst_last"),
            F.min("first_t").over(whole).alias("burst_start"),
            (F.max("last_t").over(whole) - F.min("first_t").over(whole)).alias("burst_us"),
        ),
        "slices",
    )


def numbered(events: DataFrame, slices: DataFrame) -> DataFrame:
    """Events (``k, slice, t, id`` and more) with ``idx``, their number in the key."""
    place = F.row_number().over(Window.partitionBy("k", "slice").orderBy("t", "id"))
    out = events.withColumn("place", place).join(slices.select("k", "slice", "before"), ["k", "slice"])
    return out.withColumn("idx", F.col("before") + F.col("place")).drop("place", "before")


def folded(events: DataFrame, bursts: DataFrame, window_us: int, refresh: bool) -> DataFrame:
    """``k, slice, opening, opened`` of ``bursts`` (``k, slice, burst_first`` and ``burst`` of
    each of their slices), by a fold over the sorted times of each."""
    times = events.join(bursts, ["k", "slice"]).groupBy("k", "burst", "burst_first").agg(
        F.sort_array(F.collect_list("t")).alias("times"), F.max("lim").alias("lim")
    )
    none = F.array().cast("array<struct<at:bigint,opened:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("expiry"), none.alias("found"))

    def step(acc: Column, t: Column) -> Column:
        opens = F.coalesce(t >= acc["expiry"], F.lit(True))
        more = acc["n"] < F.col("lim")
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(opens, F.lit(1).cast("bigint")).when(more, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(opens | (more if refresh else F.lit(False)), t + window_us).otherwise(acc["expiry"]).alias("expiry"),
            F.when(opens, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("at"), t.alias("opened"))))).otherwise(acc["found"]).alias("found"),
        )

    found = times.select("k", "burst_first", F.explode(F.aggregate("times", start, step, lambda acc: acc["found"])).alias("w"))
    return found.select("k", slice_of(F.col("w.opened"), window_us).alias("slice"), (F.col("burst_first") + F.col("w.at")).alias("opening"), "w.opened")


def successors(ev: DataFrame, slices: DataFrame, window_us: int, refresh: bool) -> DataFrame:
    """``k, a, b``: the window that opens at event ``a`` is followed by one at ``b``.

    ``ev`` are numbered events with ``burst_last``, ``slices`` all slices of their keys."""
    if refresh:
        # the last event that the window accepts restarts the clock
        last = ev.select("k", F.col("idx").alias("at"), F.col("t").alias("last_t"))
        asked = ev.withColumn("at", F.col("idx") + F.col("lim") - 1).join(last, ["k", "at"])
        asked = asked.filter(F.col("at") <= F.col("burst_last")).withColumn("x", F.col("last_t") + window_us)
    else:
        asked = ev.withColumn("x", F.col("t") + window_us)
    asked = asked.select("k", F.col("idx").alias("a"), F.col("x").alias("t"), slice_of(F.col("x"), window_us).alias("slice"), "burst_last")

    known = slices.select("k", "slice", "n")
    empty = asked.select("k", "slice").distinct().withColumn("n", F.lit(0).cast("bigint"))
    counts = known.unionByName(empty).groupBy("k", "slice").agg(F.sum("n").alias("n"))
    before = counts.select("k", "slice", (F.sum("n").over(Window.partitionBy("k").orderBy("slice")) - F.col("n")).alias("before"))

    nothing = F.lit(None).cast("bigint")
    both = ev.select("k", "slice", "t", F.lit(1).alias("is_event"), nothing.alias("a"), nothing.alias("burst_last")).unionByName(
        asked.select("k", "slice", "t", F.lit(0).alias("is_event"), "a", "burst_last")
    )
    earlier = Window.partitionBy("k", "slice").orderBy("t", "is_event").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("inside", F.sum("is_event").over(earlier)).filter("is_event = 0").join(before, ["k", "slice"])
    return placed.withColumn("b", F.col("before") + F.col("inside") + 1).filter("b <= burst_last").select("k", "a", "b")


def chained(ev: DataFrame, slices: DataFrame, firsts: DataFrame, windows: int, window_us: int, refresh: bool) -> DataFrame:
    """``k, slice, opening, opened`` of bursts of up to ``windows`` windows, whose first
    events have the numbers ``firsts`` (``k, s``), by doubled pointers.

    ``jumps`` has a row an event but packs into files so small that it would be broadcast:
    its joins are merges, which spill, and each round's openings are written, so that no
    task holds the tables of all rounds."""
    jumps = written(successors(ev, slices, window_us, refresh), "jumps")
    found = firsts
    rounds = max(1, math.ceil(math.log(windows + 1, FAN)))
    for r in range(rounds):
        reach, steps = found, [F.col("s")]
        for i in range(1, FAN):
            hop = jumps.select("k", F.col("a").alias(f"at{i}"), F.col("b").alias(f"s{i}")).hint("merge")
            reach = reach.withColumn(f"at{i}", steps[-1]).join(hop, ["k", f"at{i}"], "left")
            steps.append(F.col(f"s{i}"))
        found = written(reach.select("k", F.explode(F.array_compact(F.array(*steps))).alias("s")), "openings")
        if r < rounds - 1:
            far = jumps
            for _ in range(FAN - 1):
                hop = jumps.select("k", F.col("a").alias("m"), "b").hint("merge")
                far = far.select("k", "a", F.col("b").alias("m")).join(hop, ["k", "m"]).select("k", "a", "b")
            jumps = written(far, "jumps")
    at = ev.select("k", F.col("idx").alias("s"), "slice", "t").hint("merge").join(found, ["k", "s"])
    return at.select("k", "slice", F.col("s").alias("opening"), F.col("t").alias("opened"))


def ranked(events: DataFrame, window_us: int, refresh: bool = False) -> DataFrame:
    """Events (``k, t, id, lim`` and more; ``lim`` at least 1, the same for all events
    of a key) with ``rank``, the place in their window, and ``opened``, its start.

    With ``refresh`` the window restarts at each of its first ``lim`` events."""
    e = events.withColumn("slice", slice_of(F.col("t"), window_us))
    slices = slices_of(e, window_us)
    indexed = numbered(e, slices)
    several = F.col("burst_us") >= window_us
    many = F.col("burst_last") - F.col("burst_first") >= FOLD
    one = slices.filter(~several & (F.col("before") + 1 == F.col("burst_first")))
    opened = one.select("k", "slice", F.col("burst_first").alias("opening"), F.col("burst_start").alias("opened"))
    opened = opened.unionByName(folded(e, slices.filter(several & ~many).select("k", "slice", "burst", "burst_first"), window_us, refresh))
    longest = slices.filter(several & many).agg(F.max("burst_us")).first()[0]
    if longest is not None:
        indexed = written(indexed, "numbered")
        long = slices.filter(several & many)
        ev = indexed.join(long.select("k", "slice", "burst_last"), ["k", "slice"])
        firsts = long.filter("before + 1 = burst_first").select("k", F.col("burst_first").alias("s"))
        opened = opened.unionByName(chained(ev, slices, firsts, longest // window_us + 1, window_us, refresh))

    here = slices.select("k", "slice").join(opened, ["k", "slice"], "left").withColumn("own", F.when(F.col("opening").isNotNull(), F.struct("opening", "opened")))
    earlier = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = here.select("k", "slice", "own", F.last("own", ignorenulls=True).over(earlier).alias("earlier"))
    start: Column = F.when(F.col("own.opening") <= F.col("idx"), F.col("own")).otherwise(F.col("earlier"))
    out = indexed.join(by_slice, ["k", "slice"]).withColumn("start", start)
    return out.withColumn("rank", F.col("idx") - F.col("start.opening") + 1).withColumn("opened", F.col("start.opened")).drop(
        "own", "earlier", "start", "slice", "idx"
    )
