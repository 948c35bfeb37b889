"""op11: the trie of conversations rebuilt on the openings of every twentieth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.base import register
from sitelens.llm.common import table
from sitelens.llm.prefix_trie import conversation_paths, prefix_trie

EVERY, MOST = 20, 3

SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, substr(sha256(strlen(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')), 1, 32) AS k,
         len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS turns FROM t GROUP BY conv_id
), crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS pos, 4294967295::BIGINT AS r FROM c
  UNION ALL
  SELECT conv_id, s, pos + 1,
         list_reduce(list_prepend(xor(r, ord(s[pos + 1])::BIGINT), [0::BIGINT for i in range(8)]),
                     lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)
  FROM crc WHERE pos < length(s)
), h AS (
  SELECT conv_id, xor(r, 4294967295::BIGINT) % 4 AS h FROM crc WHERE pos = length(s)
), b AS (
  SELECT c.conv_id, list_concat(COALESCE(o.turns, [])[1:h.h], c.turns[h.h + 1:]) AS turns
  FROM c JOIN h USING (conv_id) LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 20
), m AS (
  SELECT conv_id, d, array_to_string([x.k for x in turns[1:d]], '') AS p,
         CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM b)
), n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w,
         COALESCE(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends)), sha256('')) AS ends_sha256
  FROM m GROUP BY p, d
), kids AS (
  SELECT n.*, COALESCE(x.n_children, 0) AS n_children
  FROM n LEFT JOIN (SELECT substr(p, 1, CAST(32 * (d - 1) AS BIGINT)) AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2) x USING (p, d)
), up AS (
  SELECT substr(p, 1, CAST(32 * a AS BIGINT)) AS p, a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM kids) GROUP BY 1, 2
)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, k.n_convs, k.n_children,
       CAST(up.n_leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM kids k JOIN up USING (p, d) LEFT JOIN n o ON o.d = k.d - 1 AND o.p = substr(k.p, 1, CAST(32 * (k.d - 1) AS BIGINT))
"""


def rebuilt(paths: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % 20."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST + 1)
    first = paths.filter(F.col("conv_id") % EVERY == 0).select(
        F.col("conv_id").alias("base_id"), F.slice("turns", 1, MOST).alias("opening")
    )
    own = paths.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % EVERY).withColumn("h", h.cast("int"))
    opening = F.slice(F.coalesce("opening", F.array().cast(paths.schema["turns"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(first, "base_id", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


@register("op11_prefix_trie", SQL)
def op11(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(conversation_paths(conversations))).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
