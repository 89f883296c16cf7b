"""Queries of the operators on whole documents (2, 3, 5, 9, 12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.llm import chosen_path, content_sort, coordinate_join, decision_list, line_align
from trajspark.llm.common import query, table


@query("op9_exact_dedup", """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n""")
def op9(spark, d):
    return content_sort.exact_dedup(table(spark, d, "documents"), keep="max")


@query("op3_quality_rules")
def op3(spark, d):
    docs = table(spark, d, "documents")
    return decision_list.judged(docs, decision_list.learn(docs, table(spark, d, "labels")))


@query("op5_ngram_jaccard_join")
def op5(spark, d):
    return chosen_path.similar(table(spark, d, "documents"))


@query("op2_line_dedup")
def op2(spark, d):
    return line_align.drop_repeated_lines(table(spark, d, "documents")).select(
        "doc_id", "n_lines", "n_deleted", "copy_of", F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("text_sha256"))


@query("op12_minhash_near_dedup", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM w),
g AS MATERIALIZED (SELECT doc_id, unnest(grams) AS gram FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM met JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.grams) + len(y.grams) - n)),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(grams)""")
def op12(spark, d):
    return coordinate_join.near_copies(table(spark, d, "documents"))
