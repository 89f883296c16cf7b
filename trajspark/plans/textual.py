"""Queries over text: predicates, parsing, digests, turns as steps, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import hashing, money, pricing, text, vector
from trajspark.operators import features, ordered, search
from trajspark.plans import base
from trajspark.plans.base import cte, sql, table
from trajspark.plans.numeric import R
from trajspark.plans.registry import query

ERR = (r"""(lower(substr(ltrim({c}), 1, 5)) = 'error' OR regexp_matches({c}, '^\s*(?:\{{\s*"error"\s*:|Traceback \(most recent call last\)"""
       r"""|[A-Za-z_][A-Za-z0-9_]*(?:Error|Exception)\s*:|HTTP\s+[45]\d\d\b|[45]\d\d\s+[A-Z][a-z]|<html\b|<!DOCTYPE html)'))""")


@query("error_shaped", f"""SELECT page_id, {ERR.format(c='r')} AS failed FROM (
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE substr(html, strpos(html, '<body')) END AS r FROM pages)""")
def _(spark, d):
    """Whole pages read as failures, their bodies alone do not."""
    r = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.expr("substr(html, instr(html, '<body'))"))
    return table(spark, d, "pages").select("page_id", text.error_shaped(r).alias("failed"))


@query("error_shaped_mixed", f"""SELECT event_id, {ERR.format(c='r')} AS failed FROM (
SELECT event_id, CASE event_type WHEN 'error' THEN '  ValueError: bad ' || props WHEN 'view' THEN 'HTTP 503 ' || value
 WHEN 'click' THEN '{{"error" : ' || value || '}}' ELSE 'No route found ' || value END AS r FROM events)""")
def _(spark, d):
    v = F.col("value").cast("string")
    r = F.when(F.col("event_type") == "error", F.concat(F.lit("  ValueError: bad "), "props")) \
        .when(F.col("event_type") == "view", F.concat(F.lit("HTTP 503 "), v)) \
        .when(F.col("event_type") == "click", F.concat(F.lit('{"error" : '), v, F.lit("}"))) \
        .otherwise(F.concat(F.lit("No route found "), v))
    return table(spark, d, "events").select("event_id", text.error_shaped(r).alias("failed"))


def _sql_redact(c: str) -> str:
    for p, m in text.REDACTIONS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{m.replace('$1', chr(92) + '1')}', 'g')"
    return c


@query("redact_secrets", f"""SELECT doc_id, sha256(r) AS redacted_sha, r <> text AS changed
FROM (SELECT doc_id, text, {_sql_redact('text')} AS r FROM documents)""")
def _(spark, d):
    r = table(spark, d, "documents").select("doc_id", "text", text.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.sha2("r", 256).alias("redacted_sha"), (F.col("r") != F.col("text")).alias("changed"))


PLANTED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' AKIA' || upper(substr(sha256(text), 1, 16)) WHEN 1 THEN text || ' ghp_' || sha256(text)
  WHEN 2 THEN text || ' password: "' || substr(sha256(text), 1, 20) || '"' ELSE text END AS text FROM documents"""


@query("secret_scan", " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, substr(regexp_extract(text, '{p.replace(chr(39), chr(39) * 2)}'), 1, 12) AS snippet "
    f"FROM ({PLANTED}) p WHERE regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for p, label in text.SECRET_SHAPES))
def _(spark, d):
    """Documents, three of four with a credential made of their own digest."""
    h, k = F.sha2("text", 256), F.col("doc_id") % 4
    planted = F.when(k == 0, F.concat("text", F.lit(" AKIA"), F.upper(F.substring(h, 1, 16)))).when(
        k == 1, F.concat("text", F.lit(" ghp_"), h)).when(
        k == 2, F.concat("text", F.lit(' password: "'), F.substring(h, 1, 20), F.lit('"'))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.inline(text.secret_findings(planted)))


cte("turns", (), """
  SELECT conv_id, turn, role, text, first_value(text) OVER w AS task, lag(text) OVER w AS prev,
    lead(text) OVER w AS nxt, lead(role) OVER w AS nxt_role
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
STOP = "('" + "','".join(text.STOP_WORDS) + "')"


def _words(c: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN {STOP} AND length(w) > 2)")


@query("lexical_miss", sql(f"""
SELECT conv_id, turn, (doc AND len(rw) >= 4 AND NOT list_has_any(rw, aw) AND NOT list_has_any(rw, tw))::INTEGER::DOUBLE AS miss,
  (doc AND len(rw) < 4 AND len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) < 4 AND length(trim(text)) >= 16) AS unreadable
FROM (SELECT *, trim(text) <> '' AND NOT {ERR.format(c='text')} AND NOT regexp_matches(trim(text), '^[(\\[{{]') AS doc,
  {_words('text')} AS rw, {_words("coalesce(prev, '')")} AS aw, {_words('task')} AS tw FROM turns)""", "turns"))
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    c = ordered.lag(c, ["conv_id"], "turn", {"prev": "text"})
    c = ordered.anchor(c, ["conv_id"], "turn", {"task": "text"})
    miss, unread = text.lexical_miss(F.col("text"), F.coalesce("prev", F.lit("")), F.col("task"))
    return c.select("conv_id", "turn", miss.alias("miss"), unread.alias("unreadable"))


@query("char_stats", r"""
SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}\p{Z}\s]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS alnum,
  round((length(b) - length(regexp_replace(b, '[\x{FFFD}\p{C}\p{Z}]', '', 'g'))) / greatest(length(text), 1)::DOUBLE, 6) AS junk
FROM (SELECT doc_id, text, regexp_replace(text, '[ \n\t\r]', '', 'g') AS b FROM documents)""")
def _(spark, d):
    a, j = text.char_stats(F.col("text"))
    return table(spark, d, "documents").select("doc_id", R(a).alias("alnum"), R(j).alias("junk"))


@query("clean_runs", r"""
SELECT conv_id, bool_and(trim(text) <> '' AND NOT (length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) > greatest(8, length(text) * 0.2))) AS clean,
  count(*) AS n_steps FROM (SELECT conv_id, CASE conv_id % 4 * 10 + turn WHEN 1 THEN text || repeat('é', (length(text) + 9)::INTEGER) WHEN 11 THEN '  '
  ELSE text END AS text FROM conversations) GROUP BY conv_id""")
def _(spark, d):
    """Turn 1 of a quarter of the runs ends in a burst, that of another quarter is blank."""
    k = F.col("conv_id") % 4 * 10 + F.col("turn")
    said = F.when(k == 1, F.concat("text", F.repeat(F.lit("é"), F.length("text") + 9))).when(k == 11, "  ").otherwise(F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.bool_and(text.clean_step(said)).alias("clean"), F.count(F.lit(1)).alias("n_steps"))


@query("healthy_null_cleaning", r"""
WITH r AS (SELECT conv_id, bool_and(trim(text) <> '' AND NOT (length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) > greatest(8, length(text) * 0.2))) AS clean,
   bool_or(role = 'assistant' AND length(text) > 400) AS complete, count(*) > 3 AS scoreable FROM conversations GROUP BY conv_id),
n AS (SELECT count(*) FILTER (clean) AS nc, count(*) FILTER (clean AND complete) AS nk, count(*) FILTER (clean AND complete AND scoreable) AS ns FROM r)
SELECT conv_id FROM r, n WHERE (nc < 20 OR clean) AND (nk < 20 OR (clean AND complete)) AND (ns < 10 OR scoreable)""")
def _(spark, d):
    runs = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.bool_and(text.clean_step(F.col("text"))).alias("clean"),
        F.bool_or((F.col("role") == "assistant") & (F.length("text") > 400)).alias("complete"),
        (F.count(F.lit(1)) > 3).alias("scoreable"))
    return features.healthy_null(runs, [("clean", 20), ("complete", 20), ("scoreable", 10)]).select("conv_id")


@query("tool_text_parse", """
SELECT event_id, CASE WHEN user_id % 3 = 2 THEN 1 ELSE 1 END AS n_calls, event_type AS name, props AS args,
  CASE user_id % 3 WHEN 0 THEN 'got [' || value || '] "ok]"' WHEN 1 THEN 'got ' || value ELSE '' END AS result,
  CASE user_id % 3 WHEN 1 THEN 'I will call' ELSE 'I will call then stop' END AS reasoning FROM events""")
def _(spark, d):
    """Calls are written into text in the three forms and read back."""
    v = F.col("value").cast("string")
    head = F.concat(F.lit("I will call ["), "event_type", F.lit("("), "props", F.lit(")"))
    k = F.col("user_id") % 3
    body = F.when(k == 0, F.concat(head, F.lit(" -> got ["), v, F.lit('] "ok]"] then  stop'))) \
        .when(k == 1, F.concat(head, F.lit("] -> got "), v)).otherwise(F.concat(head, F.lit("] then stop")))
    e = table(spark, d, "events").select("event_id", text.parse_tool_text(body).alias("p"))
    c = F.get("p.calls", F.lit(0))
    return e.select("event_id", F.size("p.calls").alias("n_calls"), c["name"].alias("name"), c["args"].alias("args"),
                    c["result"].alias("result"), F.col("p.reasoning").alias("reasoning"))


@query("prefer_structured", """
SELECT event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS n_calls,
  CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'text' ELSE 'structured' END AS origin FROM events""")
def _(spark, d):
    """Absent events fall back to the text; an empty list does not."""
    e = table(spark, d, "events").select("event_id", "event_type", F.concat(
        F.lit("x [written("), "props", F.lit(") -> 1] y")).alias("text"), "props")
    one = F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("args"),
                           F.lit("r").alias("result"), F.lit(False).alias("is_error")))
    e = e.withColumn("tool_events", F.when(F.col("event_type") == "view", F.filter(one, lambda x: F.lit(False)))
                     .when(F.col("event_type") != "click", one))
    s = text.step_calls(e)
    return s.select("event_id", F.size("calls").alias("n_calls"), F.get("calls", F.lit(0))["origin"].alias("origin"))


@query("tool_event_truncate", """
SELECT doc_id, sha256(substr(text, 1, 500)) AS kept_sha, length(text)::INTEGER AS result_chars, length(text) > 500 AS result_truncated FROM documents""")
def _(spark, d):
    ev = text.tool_event(F.lit("fetch"), F.col("text"), 500)
    return table(spark, d, "documents").select("doc_id", ev.alias("e")).select(
        "doc_id", F.sha2("e.result", 256).alias("kept_sha"), "e.result_chars", "e.result_truncated")


@query("json_broken_complete", """
SELECT event_id, event_type IN ('click', 'view') AS broken FROM events""")
def _(spark, d):
    r = F.when(F.col("event_type") == "click", F.concat("props", F.lit("}"))) \
        .when(F.col("event_type") == "view", F.expr("substring(props, 1, length(props) - 1)")) \
        .when(F.col("event_type") == "error", F.lit("plain text")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", text.json_broken(r, F.lit(False)).alias("broken"))


@query("json_broken_truncated", """
SELECT event_id, event_type = 'click' AS broken FROM events""")
def _(spark, d):
    """A cut-off text is no breakage when it can still be completed."""
    r = F.when(F.col("event_type") == "click", F.concat("props", F.lit("]"))) \
        .when(F.col("event_type") == "view", F.expr("substring(props, 1, length(props) - 1)")) \
        .when(F.col("event_type") == "error", F.lit('{"a": [1, "x')).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", text.json_broken(r, F.lit(True)).alias("broken"))


@query("privacy_digest", """
SELECT doc_id, length(text)::INTEGER AS n_chars, substr(sha256(text), 1, 16) AS digest FROM documents""")
def _(spark, d):
    n, h = hashing.digest(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n_chars"), h.alias("digest"))


@query("config_fingerprint", """
SELECT s_suppkey, sha256('{"model":"' || s_name || '","prompt":"' || sha256(s_name) || '","tools":"' || s_nationkey || '"}') AS fingerprint FROM supplier""")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", hashing.fingerprint(
        tools=F.col("s_nationkey").cast("string"), model=F.col("s_name"), prompt=F.sha2("s_name", 256)).alias("fingerprint"))


@query("lf_digest", r"""
SELECT page_id, sha256(replace(replace(h, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest
FROM (SELECT page_id, replace(html, '><', '>' || chr(13) || chr(10) || '<') AS h FROM pages)""")
def _(spark, d):
    h = F.regexp_replace("html", "><", ">\r\n<")
    return table(spark, d, "pages").select("page_id", hashing.lf_digest(h).alias("digest"))


@query("feature_fingerprint", """
SELECT label, sha256(string_agg(g, ';' ORDER BY seg)) AS fingerprint FROM (
 SELECT label, vec_id // 1024 AS seg, sha256(string_agg(v, ';' ORDER BY vec_id)) AS g FROM (
  SELECT label, vec_id, sha256(array_to_string(list_transform(embedding, lambda x: printf('%.4f', round(x::DOUBLE, 4) + 0.0)), ',')) AS v FROM embeddings)
 GROUP BY label, seg)
GROUP BY label""")
def _(spark, d):
    """Digest of the digests of ranges of 1,024 ids: no row holds all of a label."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("k"), F.sha2(F.array_join(F.transform(
        vector.doubles(F.col("embedding")), lambda x: hashing.rounded_text(x, 4)), ","), 256).alias("v"))
    joined = lambda k, v: F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(v).alias("v")))), lambda s: s["v"]), ";"), 256)
    g = e.groupBy("label", F.expr("k div 1024").alias("seg")).agg(joined("k", "v").alias("g"))
    return g.groupBy("label").agg(joined("seg", "g").alias("fingerprint"))


@query("currency_guard", """
SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '€' || o_orderkey WHEN 2 THEN o_orderkey || ' EUR' ELSE NULL END AS refused_figure FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey").cast("string")
    t = F.concat(F.lit("pay $"), k, F.when(F.col("o_custkey") % 4 == 1, F.concat(F.lit(" or €"), k))
                 .when(F.col("o_custkey") % 4 == 2, F.concat(F.lit(" or "), k, F.lit(" EUR")))
                 .when(F.col("o_custkey") % 4 == 3, F.concat(F.lit(" or "), k, F.lit(" USD in 3 EURekas")))
                 .otherwise(F.lit("")))
    return table(spark, d, "orders").select("o_orderkey", money.refused_figure(t).alias("refused_figure"))


@query("first_price", """
SELECT o_orderkey, round(CASE WHEN o_custkey % 3 = 2 THEN NULL ELSE o_totalprice END, 2) AS price FROM orders""")
def _(spark, d):
    p = F.format_number(F.col("o_totalprice"), 2)
    t = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("costs $"), p, F.lit(" or $1")))\
        .when(F.col("o_custkey") % 3 == 1, F.concat(p, F.lit(" usd"))).otherwise(F.concat(F.lit("free "), p))
    return table(spark, d, "orders").select("o_orderkey", R(money.first_price(t), 2).alias("price"))


@query("stated_total", """
SELECT o_orderkey, round(CASE o_custkey % 3 WHEN 2 THEN 7 ELSE o_totalprice END, 2) AS stated FROM orders""")
def _(spark, d):
    """A labelled figure wins over position; the last figure is the fallback."""
    p = F.format_number(F.col("o_totalprice"), 2)
    t = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Total flight cost: $5, the grand total is $"), p, F.lit(" with hotel $9"))) \
        .when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("I paid $3 and then $"), p)).otherwise(F.lit("total of $7, then $8"))
    return table(spark, d, "orders").select("o_orderkey", R(money.stated_total(t), 2).alias("stated"))


@query("signed_figures", """
SELECT l_orderkey, l_linenumber, i::INTEGER AS i, CASE i WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN -round(l_quantity, 2) ELSE -5.5 END AS fig
FROM lineitem, range(3) r(i)""")
def _(spark, d):
    t = F.concat(F.lit("pay $"), F.format_number("l_extendedprice", 2), F.lit(" refund -$"), F.col("l_quantity").cast("string"),
                 F.lit(" or $-5.50"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                              F.posexplode(money.signed_figures(t)).alias("i", "fig"))


@query("task_anchor", """
SELECT conv_id, length(arg_min(text, turn))::INTEGER AS anchor_chars, substr(sha256(arg_min(text, turn)), 1, 16) AS anchor FROM conversations GROUP BY conv_id""")
def _(spark, d):
    a = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"))
    return a.select("conv_id", F.length("a").alias("anchor_chars"), F.substring(F.sha2("a", 256), 1, 16).alias("anchor"))


@query("context_ratio", sql("""
SELECT conv_id, turn, round(least(sum(length(text) / 4.0 + len(list_filter(string_split(text, ' '), lambda x: x <> ''))) OVER (PARTITION BY conv_id ORDER BY turn) / 8192, 2), 6) AS ctx_ratio
FROM conversations"""))
def _(spark, d):
    c = table(spark, d, "conversations")
    words = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    return features.context_ratio(c, ["conv_id"], "turn", words, F.col("text")).select(
        "conv_id", "turn", R("ctx_ratio").alias("ctx_ratio"))


@query("render_transcript", """
SELECT conv_id, turn, sha256(string_agg('step ' || (turn + 1) || ' (' || role || '): ' || trim(text, ' '), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)) AS transcript_sha
FROM conversations""")
def _(spark, d):
    c = table(spark, d, "conversations")
    return features.transcripts(c, ["conv_id"], "turn", F.col("role"), F.col("text")).select(
        "conv_id", "turn", F.sha2("transcript", 256).alias("transcript_sha"))


@query("render_transcript_at", """
WITH l AS (SELECT conv_id, turn, 'step ' || (turn + 1) || ' (' || role || '): ' || trim(text, ' ') AS line FROM conversations),
p AS (SELECT conv_id, unnest([max(turn), max(turn) // 2]) AS upto FROM conversations GROUP BY conv_id)
SELECT conv_id, upto, sha256(string_agg(line, chr(10) ORDER BY turn)) AS transcript_sha FROM p JOIN l USING (conv_id) WHERE turn <= upto GROUP BY conv_id, upto""")
def _(spark, d):
    """Transcripts up to the middle and the last turn of each run only."""
    c = table(spark, d, "conversations")
    p = c.groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", F.explode(F.array("m", F.expr("CAST(m div 2 AS BIGINT)"))).alias("upto"))
    return features.transcripts_at(c, p.distinct(), ["conv_id"], "turn", "upto", F.col("role"), F.col("text")).select(
        "conv_id", "upto", F.sha2("transcript", 256).alias("transcript_sha"))


@query("parse_verdict", """
SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false WHEN 'error' THEN true ELSE NULL END AS verdict FROM events""")
def _(spark, d):
    t = F.when(F.col("event_type") == "view", F.lit('```json\n{"flagged": true, "why": "x"}\n```')) \
        .when(F.col("event_type") == "click", F.lit('{"flagged": false}')) \
        .when(F.col("event_type") == "error", F.lit('I say "flagged": true because')) \
        .when(F.col("event_type") == "purchase", F.lit('{"other": 1}')).otherwise(F.concat(F.lit("no idea "), "props"))
    return table(spark, d, "events").select("event_id", text.verdict(t).alias("verdict"))


@query("normal_reason", """
SELECT lower(event_type) || ' at step N' AS reason, count(*) AS n FROM events GROUP BY 1""")
def _(spark, d):
    r = F.concat(F.col("event_type"), F.lit(" at step "), F.col("value").cast("string"), F.lit(" (seen "), "props", F.lit(")"))
    return table(spark, d, "events").groupBy(text.normal_reason(r).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("token_cost", """
WITH p AS (SELECT 'seg' || (r_regionkey) AS model, 1.0 + r_regionkey AS i, 0.25 AS c, 4.0 + r_regionkey AS o FROM region WHERE r_regionkey < 4)
SELECT o_orderkey, CASE WHEN i IS NULL THEN 'unknown model' WHEN cached > inp THEN 'cached exceeds input' END AS refused,
  round(CASE WHEN i IS NOT NULL AND cached <= inp THEN ((inp - cached) * (CASE WHEN inp > 150000 THEN 2 * i ELSE i END) + cached * c + outp * o) / 1e6 END, 9) AS usd
FROM (SELECT o_orderkey, 'seg' || (o_custkey % 5) AS model, floor(o_totalprice)::BIGINT AS inp, o_custkey AS outp, (o_orderkey * 7) AS cached FROM orders) LEFT JOIN p USING (model)""")
def _(spark, d):
    rates = table(spark, d, "region").filter("r_regionkey < 4").select(
        F.concat(F.lit("seg"), F.col("r_regionkey").cast("string")).alias("model"), (F.col("r_regionkey") + 1.0).alias("in_rate"),
        F.lit(0.25).alias("cached_rate"), (F.col("r_regionkey") + 4.0).alias("out_rate"),
        ((F.col("r_regionkey") + 1.0) * 2).alias("in_hi"), F.lit(0.25).alias("cached_hi"), (F.col("r_regionkey") + 4.0).alias("out_hi"))
    calls = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("seg"), (F.col("o_custkey") % 5).cast("string")).alias("model"),
        F.floor("o_totalprice").alias("in_tok"), F.col("o_custkey").alias("out_tok"), (F.col("o_orderkey") * 7).alias("cached_tok"))
    return pricing.price_calls(calls, rates, long_prompt=150_000).select("o_orderkey", "refused", R("usd", 9).alias("usd"))


@query("bm25_topk", """
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av FROM dl),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM dt WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(tf + 1.5 * (0.25 + 0.75 * dl / av), 1e-9)) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def _(spark, d):
    return search.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text",
                       table(spark, d, "benchmark"), "item_id", "text", 5).select(
        "item_id", "doc_id", R("score").alias("score"), "rank")


# ------------------------------------------------------------- vector steps
cte("vec", (), """
  SELECT vec_id, (vec_id // 10) AS ep, (vec_id % 10)::INTEGER AS t, label, embedding::DOUBLE[] AS e FROM embeddings""")
COS = "CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b})) ELSE 1.0 END"


def vecs(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 10).alias("ep"), (F.col("vec_id") % 10).cast("int").alias("t"), "label",
        vector.doubles(F.col("embedding")).alias("e"))


@query("cosine_drift", sql(f"""
SELECT vec_id, round(CASE WHEN p IS NULL THEN 0 ELSE 1 - ({COS.format(a='e', b='p')}) END, 6) AS drift,
  round({COS.format(a='e', b='a')}, 6) AS task_sim
FROM (SELECT *, lag(e) OVER w AS p, first_value(e) OVER w AS a FROM vec WINDOW w AS (PARTITION BY ep ORDER BY t))""", "vec"))
def _(spark, d):
    v = ordered.lag(vecs(spark, d), ["ep"], "t", {"p": "e"})
    v = ordered.anchor(v, ["ep"], "t", {"a": "e"})
    drift = F.when(F.col("p").isNull(), 0.0).otherwise(1 - vector.cosine(F.col("e"), F.col("p")))
    return v.select("vec_id", R(drift).alias("drift"), R(vector.cosine(F.col("e"), F.col("a"))).alias("task_sim"))


cte("vdim", ("vec",), "SELECT vec_id, ep, t, i, e[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM vec)")
cte("vpast", ("vdim",), """
  SELECT vec_id, any_value(t) AS t, list(v ORDER BY i) AS e, list(s ORDER BY i) AS s, list(w ORDER BY i) AS w FROM (
    SELECT *, coalesce(sum(v) OVER (PARTITION BY ep, i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
      sum(CASE WHEN t < 5 THEN v ELSE 0 END) OVER (PARTITION BY ep, i) AS w FROM vdim) GROUP BY vec_id""")


@query("self_drift", sql(f"""
SELECT vec_id, round(CASE WHEN t = 0 THEN 1 ELSE {COS.format(a='e', b='s')} END, 6) AS self_consistency,
  round(CASE WHEN t < 3 THEN 0 ELSE 1 - ({COS.format(a='e', b='s')}) END, 6) AS self_drift,
  round(CASE WHEN t < 5 THEN 0 ELSE 1 - ({COS.format(a='e', b='w')}) END, 6) AS warmup_drift FROM vpast""", "vpast"))
def _(spark, d):
    """Against the running mean of the past, and against the first five steps."""
    v = features.past_vector_sum(vecs(spark, d), ["ep"], "t", "e", 64, "s")
    w = features.warmup_centroid(vecs(spark, d), ["ep"], "t", "e", 64, 5, "w")
    v = v.join(w, "ep")
    t, cs = F.col("t"), vector.cosine(F.col("e"), F.col("s"))
    return v.select("vec_id", R(F.when(t == 0, 1.0).otherwise(cs)).alias("self_consistency"),
                    R(F.when(t < 3, 0.0).otherwise(1 - cs)).alias("self_drift"),
                    R(F.when(t < 5, 0.0).otherwise(1 - vector.cosine(F.col("e"), F.col("w")))).alias("warmup_drift"))


@query("mean_drift", sql(f"""
SELECT ep, round(avg(CASE WHEN p IS NOT NULL THEN 1 - ({COS.format(a='e', b='p')}) END), 6) AS mean_drift
FROM (SELECT *, lag(e) OVER (PARTITION BY ep ORDER BY t) AS p FROM vec) GROUP BY ep""", "vec"))
def _(spark, d):
    v = ordered.lag(vecs(spark, d), ["ep"], "t", {"p": "e"})
    return v.groupBy("ep").agg(R(F.avg(F.when(
        (vector.norm(F.col("p")) > 0) & (vector.norm(F.col("e")) > 0), 1 - vector.cosine(F.col("e"), F.col("p"))))).alias("mean_drift"))


@query("vector_jump", sql("""
SELECT vec_id, round(CASE WHEN p IS NULL THEN 0 ELSE sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - p[i]) * (e[i] - p[i])))) / 8 END, 6) AS jump
FROM (SELECT *, lag(e) OVER (PARTITION BY ep ORDER BY t) AS p FROM vec)""", "vec"))
def _(spark, d):
    v = ordered.lag(vecs(spark, d), ["ep"], "t", {"p": "e"})
    j = vector.norm(vector.diff(F.col("e"), F.col("p"))) / F.lit(8.0)
    return v.select("vec_id", R(F.coalesce(j, F.lit(0.0))).alias("jump"))


@query("zero_and_pin_dims", sql("""
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i IN (1, 2, 3) THEN 0 ELSE e[i] * i END)), 6) AS zeroed,
  round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i IN (1, 2, 3) THEN m[i] ELSE e[i] * i END)), 6) AS pinned
FROM vec, (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(v) AS m FROM vdim GROUP BY i))""", "vec", "vdim"))
def _(spark, d):
    v = vecs(spark, d)
    means = v.agg(F.array(*[F.avg(F.col("e")[i]) for i in range(64)]).alias("m"))
    j = v.crossJoin(F.broadcast(means))

    def weighted(a):
        return F.aggregate(F.transform(a, lambda x, i: F.when(i.isin(0, 1, 2), x).otherwise(x * (i + 1))),
                           F.lit(0.0), lambda s, x: s + x)
    return j.select("vec_id", R(weighted(vector.zeroed(F.col("e"), [0, 1, 2]))).alias("zeroed"),
                    R(weighted(vector.pinned(F.col("e"), F.col("m"), [0, 1, 2]))).alias("pinned"))


# ---------------------------------------------------- adjacent-token statistics
cte("words", (), """
  SELECT doc_id, i, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM (
    SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents))""")


@query("adjacent_token_counts", sql("""
SELECT lang, count(*) AS n_words, count(w2) AS n_pairs, count(DISTINCT w) AS vocabulary FROM words JOIN documents USING (doc_id) GROUP BY lang""", "words"))
def _(spark, d):
    from trajspark.operators import pmi
    return pmi.corpus_counts(table(spark, d, "documents"), "text", "lang")


@query("neg_pmi", sql("""
, u AS (SELECT w, count(*)::DOUBLE AS c FROM words GROUP BY w),
b AS (SELECT w, w2, count(*)::DOUBLE AS c FROM words WHERE w2 IS NOT NULL GROUP BY ALL),
tot AS (SELECT (SELECT sum(c) FROM u) AS tu, (SELECT sum(c) FROM b) AS tb, (SELECT count(*) FROM u)::DOUBLE AS v)
, s AS (SELECT doc_id, avg(-ln(greatest(((b.c + 1) / (tb + v * v)) / (((u1.c + 1) / (tu + v)) * ((u2.c + 1) / (tu + v))), 1e-10))) AS p
FROM words x JOIN u u1 ON u1.w = x.w JOIN u u2 ON u2.w = x.w2 JOIN b ON b.w = x.w AND b.w2 = x.w2, tot GROUP BY doc_id)
SELECT doc_id, round(coalesce(p, 0.0), 6) AS neg_pmi FROM documents LEFT JOIN s USING (doc_id)""", "words").replace("\n\n,", ",", 1))
def _(spark, d):
    from trajspark.operators import pmi
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pmi.score(docs, docs, "doc_id", "text").select("doc_id", R("neg_pmi").alias("neg_pmi"))


# ------------------------------------------------- conversations as agent runs
@query("import_turns", sql("""
SELECT conv_id, sum((role = 'assistant')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER - 1 AS t, turn,
  coalesce(nxt_role = 'user', false) AS has_result, length(coalesce(CASE WHEN nxt_role = 'user' THEN nxt END, ''))::INTEGER AS result_chars,
  CASE WHEN coalesce(nxt_role = 'user', false) THEN 'tool_call' ELSE 'synthesis' END AS action,
  greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 1)::INTEGER AS output_tokens
FROM turns QUALIFY role = 'assistant'""", "turns"))
def _(spark, d):
    from trajspark.sources import imports
    c = table(spark, d, "conversations")
    s = imports.positional_steps(c, ["conv_id"], "turn", agent_role="assistant", environment_role="user")
    return s.select("conv_id", "t", "turn", "has_result", "result_chars", "action", "output_tokens")


@query("import_onset", sql("""
, o AS (SELECT conv_id, turn, greatest(sum((role = 'assistant')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) - 1, -1) AS own FROM turns),
m AS (SELECT conv_id, (conv_id % 4) AS mistake FROM turns GROUP BY conv_id)
SELECT m.conv_id, CASE WHEN own >= 0 THEN own::INTEGER END AS tau, coalesce(own, -1) < 0 AS unplaced FROM m LEFT JOIN o ON o.conv_id = m.conv_id AND o.turn = m.mistake""", "turns").replace("\n\n,", ",", 1))
def _(spark, d):
    from trajspark.sources import imports
    c = table(spark, d, "conversations")
    mistakes = c.select("conv_id").distinct().withColumn("mistake", F.col("conv_id") % 4)
    return imports.onsets(c, mistakes, ["conv_id"], "turn", "mistake", agent_role="assistant")


@query("typed_export", sql("""
SELECT conv_id, count(*)::INTEGER AS n_steps, sha256('[' || string_agg('{"t":' || turn || ',"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) || ']') AS steps_sha
FROM conversations GROUP BY conv_id"""))
def _(spark, d):
    from trajspark.sources import steps as src
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("t"), "role", F.length("text").alias("chars"))
    return src.export_rows(c, ["conv_id"], "t", ["role", "chars"]).select(
        "conv_id", "n_steps", F.sha2("steps_json", 256).alias("steps_sha"))
