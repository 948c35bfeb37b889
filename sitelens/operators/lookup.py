"""Skew-safe lookup joins.

Many fact rows (pages, frontier URLs) look up one row per key (a site, a host,
a URL).  A single key may hold a large share of the facts (one site with a
third of all pages).  In a batch the join is left to adaptive execution, which
measures every partition once it is written: a partition far above the others is
split over several tasks, each with the one lookup row it needs, so a hot key is
spread and cold keys are replicated nowhere; and where the lookup side turns out
small, it is broadcast, by a measured size.  A stream has no such measurement:
there each fact row gets a deterministic salt from its own identity and the lookup
side is replicated once per salt value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key, the same on every run: the latest ``fetched_at`` where there is
    one, then the greatest remaining values.  Captures may hold a key repeatedly;
    a lookup side must not, or its facts are multiplied."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rest.sort(key=lambda c: c != "fetched_at")  # stable: fetched_at first, the others in order
    best = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


SALT_BUCKETS = 16
_SALT = "_lookup_salt"


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    row_id: Sequence[str],
    how: str = "left",
    buckets: int = SALT_BUCKETS,
) -> DataFrame:
    """``facts ⟕ lookup`` on ``on``; ``lookup`` has at most one row per key.

    ``row_id`` columns identify a fact row; on a stream the salt is a hash of them, so
    a re-executed task puts every row in the same bucket (deterministic retries).
    """
    on = list(on)
    if buckets <= 1 or not facts.isStreaming:
        return facts.join(lookup, on, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in row_id]), F.lit(buckets)).cast("int")
    f = facts.withColumn(_SALT, salt)
    lk = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return f.join(lk, on + [_SALT], how).drop(_SALT)
