"""Ranked text search by BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from trajspark.functions import vector
from trajspark.operators.joins import is_small
from trajspark.sources import sinks


#: (query, document, term) meetings that a task adds up
MET = 2_000_000


def tokens(col: str):
    return F.regexp_extract_all(F.lower(F.col(col)), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str,
         query_text: str, top: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Top documents per query; documents scoring 0 never appear.

    Terms are counted inside the row, and only those that some query asks for
    leave the scan as (doc, term, tf).  Documents are dealt over as many tasks as
    their meetings with queries need (``MET`` each), so what a task adds up doesn't
    grow with the input.  The ranking keeps a partial top-n per task before its
    shuffle.
    """
    q = queries.select(query_id, F.explode(F.array_distinct(tokens(query_text))).alias("term"))
    fits = is_small(q)
    mark = F.broadcast if fits else (lambda x: x)
    q = mark(q)
    vocab = mark(q.select("term").distinct())
    toks = docs.select(doc_id, tokens(text).alias("_tk"))
    sized = toks.select(doc_id, F.size("_tk").alias("_dl"), "_tk")
    stats = sized.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"))
    tf = sized.withColumn("_tk", F.array_sort("_tk")).withColumn("_at", vector.run_starts("_tk")).select(
        doc_id, "_dl", F.inline(vector.runs("_tk", "_at"))).select(doc_id, "_dl", F.col("value").alias("term"), F.col("n").alias("_tf")) \
        .join(vocab, "term", "left_semi")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).join(q.groupBy("term").agg(F.count(F.lit(1)).alias("_asked")), "term")
    df = sinks.materialize(df, "asked_terms")
    met = df.agg(F.sum(F.col("_df") * F.col("_asked"))).first()[0] or 0
    tf = tf.repartition(-(-met // MET) or 1, doc_id)
    idf = df.crossJoin(F.broadcast(stats)).select(
        "term", "_avg", F.log(F.lit(1.0) + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("_idf"))
    idf = mark(idf)      # one row per query term at most
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("_dl") / F.greatest("_avg", F.lit(1e-9)))
    part = F.col("_idf") * F.col("_tf") * F.lit(k1 + 1) / F.greatest(F.col("_tf") + norm, F.lit(1e-9))
    hits = tf.join(idf, "term").withColumn("_s", part).join(q, "term").groupBy(query_id, doc_id).agg(
        F.sum("_s").alias("score"))
    w = W.partitionBy(query_id).orderBy(F.round("score", 9).desc(), F.col(doc_id))
    return hits.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
