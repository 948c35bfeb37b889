"""URL filter: a blocked Bloom filter in front of an exact hash join.

A rule is ``(host, path, verdict)``.  It fits its host and every subdomain when
the URL's path starts with the rule's path; the longest rule string wins.

1. Each listed rule has one canonical key ``host/path``.  A page's possible keys
   are its host suffixes joined with its path prefixes of the lengths that occur
   in the list, so every fitting rule is among them.
2. Every listed key sets one bit in each of the eight 64-bit words of one block,
   built with one grouped ``bit_or`` (a blocked Bloom filter held as a table with
   a row for each block).
3. Possible keys whose bits are all set are *possible hits*; an equi-join on the
   key itself removes the false positives.

The filter has ``16 x listed keys / 512`` blocks, rounded up to a power of two
(16 bits a key).  It is broadcast only while it has at most
``max_filter_blocks`` blocks; above that the probe is an ordinary shuffled join
on the block number.  The exact join is never hinted.

Defined cases: null URL or no ``://`` gives empty host and path, which no rule
fits; an empty list gives the default verdict; repeated rules are one rule, and
of one key listed with two verdicts ``block`` wins; extra columns pass through;
host characters are compared after A-Z lower-casing, paths as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import ascii_lower, fresh

WORDS = 8  # 64-bit words in a 512-bit block
BITS_PER_KEY = 16
MAX_FILTER_BLOCKS = 1 << 18  # 16 MiB of bits: the bound on what may be broadcast


def with_host_path(pages: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Host and path as the contract splits them; both empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    h = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    p = F.regexp_extract(F.substring(rest, F.length(h) + 1, F.length(rest)), r"\A([^?#]*)", 1)
    return pages.withColumns({host: ascii_lower(h), path: p})


def canonical_rules(rules: DataFrame) -> DataFrame:
    """One row per listed key: ``key, host, path, verdict``."""
    return (
        rules.select(
            ascii_lower(F.coalesce(F.col("host"), F.lit(""))).alias("host"),
            F.coalesce(F.col("path"), F.lit("")).alias("path"),
            "verdict",
        )
        .filter((F.col("host") != "") & F.col("verdict").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .withColumn("key", F.concat("host", "path"))
    )


def _mask(key_hash: str, word: int) -> Column:
    """The one bit that a key sets in this word of its block: six bits of its hash."""
    at = F.shiftrightunsigned(F.col(key_hash), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def filter_blocks(n_keys: int) -> int:
    need = max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))
    return 1 << (need - 1).bit_length()


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """``block`` and its eight words; only blocks with a set bit have a row."""
    k = keys.select(_block(F.col("key"), blocks).alias("__block"), F.xxhash64(F.lit("bits"), "key").alias("__h"))
    k = k.select("__block", *[_mask("__h", i).alias(f"__w{i}") for i in range(WORDS)])
    return k.groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)])


def possible_hits(candidates: DataFrame, bloom: DataFrame, blocks: int, max_filter_blocks: int = MAX_FILTER_BLOCKS) -> DataFrame:
    """Rows of ``candidates`` (column ``key``) that the filter lets through."""
    side = F.broadcast(bloom) if blocks <= max_filter_blocks else bloom
    probe = candidates.withColumns({"__block": _block(F.col("key"), blocks), "__h": F.xxhash64(F.lit("bits"), "key")})
    missing = F.lit(0).cast("bigint")
    for i in range(WORDS):
        missing = missing.bitwiseOR(_mask("__h", i).bitwiseAND(F.bitwise_not(F.col(f"__w{i}"))))
    return probe.join(side, "__block").filter(missing == 0).select(candidates.columns)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    max_filter_blocks: int = MAX_FILTER_BLOCKS,
) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row of ``pages``.

    ``rule`` is null where only the default verdict applies.  Input columns of
    those names are replaced.
    """
    base = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url])
    rows = with_host_path(base, url)
    listed = canonical_rules(rules)
    # how many keys, and the path lengths that occur: at most one integer for each length
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lens")).first()
    lens = sorted(facts["lens"])
    if not lens:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = filter_blocks(facts["n"])
    bloom = bloom_filter(listed, blocks)

    # a verdict depends only on the host and as much path as the longest rule has
    head, ruling = fresh(rows, "head", "verdict")
    rows = rows.withColumn(head, F.substring("path", 1, max(lens)))
    labels = F.split("host", r"\.", -1)
    candidates = (
        rows.select("host", F.col(head).alias("head"))
        .filter(F.col("host") != "")
        .distinct()
        .withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
        .withColumn("prefix_len", F.explode(F.array(*[F.lit(n) for n in lens])))
        .filter(F.length("head") >= F.col("prefix_len"))
        .withColumn("prefix", F.expr("substring(head, 1, prefix_len)"))
        .withColumn("key", F.concat("part", "prefix"))
        .select("host", "head", "part", "prefix", "key")
    )
    hits = possible_hits(candidates, bloom, blocks, max_filter_blocks)
    exact = hits.join(
        listed.select("key", F.col("host").alias("part"), F.col("path").alias("prefix"), "verdict"), ["key", "part", "prefix"]
    )
    best = exact.groupBy("host", "head").agg(
        F.max(F.struct(F.length("key").alias("n"), F.length("part").alias("h"), F.col("key"), F.col("verdict"))).alias("best")
    )
    found = best.select("host", F.col("head").alias(head), F.col("best.key").alias("rule"), F.col("best.verdict").alias(ruling))
    out = rows.join(found, ["host", head], "left")
    return out.select(
        *[F.col(c) for c in base.columns], "host", "path", "rule", F.coalesce(ruling, F.lit(default)).alias("verdict")
    )
