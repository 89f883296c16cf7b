"""Queries for digests of id lists and file maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.operators import digests
from trajspark.plans.base import sql, cte, table
from trajspark.plans.registry import query

_PART = "('0x' || substr(h, {at}, 15))::BIGINT::HUGEINT"
_SUMS = ", ".join(f"sum({_PART.format(at=1 + 15 * i)})::VARCHAR AS s{i}" for i in range(4))


@query("id_list_digest", f"""
WITH r AS (SELECT source, sha256(strlen(doc_id::VARCHAR) || ':' || doc_id || coalesce(strlen(lang) || ':' || lang, '-')) AS h FROM documents),
p AS (SELECT source, count(*) AS n_rows, {_SUMS} FROM r GROUP BY source)
SELECT source, n_rows, sha256(concat_ws(',', n_rows, s0, s1, s2, s3)) AS digest FROM p""")
def _(spark, d):
    """Order-free digest of the ids of each source, put together from digests per language."""
    t = table(spark, d, "documents")
    parts = t.groupBy("source", "lang").agg(*digests.multiset_parts(F.col("doc_id"), F.col("lang")))
    return digests.sealed(digests.merged(parts, ["source"]), ["source"])


def _tree(src: str, group: str) -> str:
    """SQL of a two-level tree over ``src`` (group, key, value)."""
    return f"""
, l AS (SELECT {group}, substr(sha256(strlen(k) || ':' || k), 1, 2) AS block, sha256(strlen(k) || ':' || k || coalesce(strlen(v) || ':' || v, '-')) AS leaf
  FROM ({src})),
n AS (SELECT {group}, block, leaf, count(*) AS n FROM l GROUP BY ALL),
b AS (SELECT {group}, block, sum(n)::BIGINT AS n_rows, sha256(string_agg(leaf || '*' || n, ';' ORDER BY leaf)) AS digest FROM n GROUP BY {group}, block)"""


cte("fmap", (), "SELECT split_part(url, '/', 3) AS host, url AS k, sha256(coalesce(html, '')) AS v FROM pages")
_UP = """
, u AS (SELECT {g}, left(block, 1) AS block, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(right(block, 1) || '=' || digest, ';' ORDER BY block)) AS digest
  FROM b GROUP BY {g}, left(block, 1))
SELECT {g}, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(block || '=' || digest, ';' ORDER BY block)) AS digest FROM u GROUP BY {g}"""


def files(spark, d):
    return table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "url", "page_id", "html")


@query("file_map_digest", sql(_tree("SELECT * FROM fmap", "host") + _UP.format(g="host"), "fmap").replace("\n\n,", ",", 1))
def _(spark, d):
    """One digest per host of the map from path to content digest."""
    return digests.tree_digest(files(spark, d), ["host"], F.col("url"), F.sha2(F.coalesce("html", F.lit("")), 256))


cte("fedit", (), "SELECT 0 AS g, page_id::VARCHAR AS k, sha256(coalesce(html, '')) AS v, sha256(CASE WHEN page_id % 97 = 5 THEN '' ELSE coalesce(html, '') END) AS w, page_id FROM pages")


@query("file_map_changes", sql(
    _tree("SELECT g, k, v FROM fedit", "g") + _tree("SELECT g, k, w AS v FROM fedit WHERE page_id % 101 <> 7", "g").replace(", l AS", ", l2 AS")
    .replace("n AS (SELECT g, block, leaf, count(*) AS n FROM l ", "n2 AS (SELECT g, block, leaf, count(*) AS n FROM l2 ").replace("b AS (SELECT", "b2 AS (SELECT")
    .replace("FROM n GROUP", "FROM n2 GROUP") + """
SELECT block, b.digest AS digest_a, b2.digest AS digest_b FROM b FULL JOIN b2 USING (block) WHERE b.digest IS DISTINCT FROM b2.digest""", "fedit").replace("\n\n,", ",", 1))
def _(spark, d):
    """Where two states of the page map differ, by comparing blocks."""
    p = files(spark, d)
    key, v = F.col("page_id"), F.coalesce("html", F.lit(""))
    a = digests.tree_blocks(p, [], key, F.sha2(v, 256), 2)
    b = digests.tree_blocks(p.filter("page_id % 101 <> 7"), [], key, F.sha2(F.when(key % 97 == 5, "").otherwise(v), 256), 2)
    return digests.changed_blocks(a, b, [])
