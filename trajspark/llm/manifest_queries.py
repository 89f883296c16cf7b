"""Query of the Merkle manifest (11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.llm import merkle_manifest
from trajspark.llm.common import query, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CODED = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS)


@query("op11_merkle_manifest", f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, list_reduce(
    list_concat([4294967295], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda k: [ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) // 2, CASE WHEN xor(a, b) % 2 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents), leaf AS (
  SELECT doc_id, lang, pos, sha256({_CODED}) AS leaf, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256({_CODED.replace(
    "text::VARCHAR", f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS tampered
  FROM d), node AS (
  SELECT lang, 0 AS level, pos, leaf AS h FROM leaf
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM node) WHERE n > 1 GROUP BY lang, level, pos // 8),
sub AS (
  SELECT lang, max(level) AS depth, max_by(h, level) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
  FROM node GROUP BY lang), top AS (
  SELECT 0 AS level, pos, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, pos // 8),
path AS (
  SELECT l.doc_id, s.lang, l.pos AS p, r.level, r.level AS step FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang,
    range(0, s.depth) r(level)),
sib AS (
  SELECT p.doc_id, p.lang, p.p AS leaf_pos, p.step,
         coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos < p.p // (8 ** p.level)::BIGINT), '') AS before,
         coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos > p.p // (8 ** p.level)::BIGINT), '') AS after
  FROM path p JOIN node n ON n.lang IS NOT DISTINCT FROM p.lang AND n.level = p.level
    AND n.pos // 8 = p.p // (8 ** p.level)::BIGINT // 8
  GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, s.lang, l.pos, s.depth + t.level, 
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < s.pos // (8 ** t.level)::BIGINT), ''),
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > s.pos // (8 ** t.level)::BIGINT), '')
  FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang
  JOIN top t ON t.pos // 8 = (s.pos // (8 ** t.level)::BIGINT) // 8 AND t.level < (SELECT max(level) FROM top)
  GROUP BY l.doc_id, s.lang, l.pos, s.depth, t.level),
fold AS (
  SELECT doc_id, lang, pos, 0 AS step, coalesce(tampered, leaf) AS h FROM leaf
  UNION ALL
  SELECT f.doc_id, f.lang, f.pos, f.step + 1, sha256(s.before || f.h || s.after)
  FROM fold f JOIN sib s ON s.lang IS NOT DISTINCT FROM f.lang AND s.leaf_pos = f.pos AND s.step = f.step),
ends AS (SELECT lang, pos, max_by(h, step) AS h FROM fold GROUP BY lang, pos),
proof AS (SELECT lang, leaf_pos AS pos, sha256(string_agg(before || after, '' ORDER BY step)) AS h FROM sib GROUP BY lang, leaf_pos)
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.h, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = r.root AS verified
FROM leaf l JOIN sub s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.pos = l.pos
LEFT JOIN proof p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos, (SELECT max_by(h, level) AS root FROM top) r""")
def op11(spark, d):
    docs = table(spark, d, "documents")
    lowered = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle_manifest.leaf_hash(lowered))
    entries = merkle_manifest.manifest(docs, fields=FIELDS, also={"tampered": tampered})
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return merkle_manifest.verified(entries, "tampered").select(
        "doc_id", text("leaf"), text("subroot"), text("root"), text("proof_sha256"), text("folded_root"), "verified")
