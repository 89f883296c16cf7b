"""Queries of the operators on raw pages (1, 4)."""

from __future__ import annotations

from trajspark.llm import warc, wrapper_text
from trajspark.llm.common import new_folder, query, table


@query("op1_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, url FROM pages), g AS (
  SELECT *, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, url
FROM g""")
def op1(spark, d):
    folder = new_folder(spark, "warc")
    names = warc.write_archives(table(spark, d, "pages"), folder)
    return warc.read_archives(spark, folder, names).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query("op4_main_text")
def op4(spark, d):
    return wrapper_text.extract(table(spark, d, "pages"))
