"""Exact token-length histogram (operator 10).

Documents are counted by encoded length.  From that table alone, running sums
answer totals, quantiles and what any context limit would cut.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from trajspark.llm.bpe_tokens import encoder
from trajspark.llm.common import slices, written

#: Lengths per block of the two-level running sums.
BLOCK = 64


def lengths(docs: DataFrame, tokenizer: str, *, text_col: str = "text", end_ids: int = 1) -> DataFrame:
    """``n_tokens`` per document (a null or empty text has its ``end_ids`` only); repeated rows count each."""

    def run(batches):
        enc = encoder(tokenizer)
        for part in slices(batches):
            n = [len(raw) // 4 + end_ids for raw in enc.encode_many(part.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.selectExpr(f"CAST(`{text_col}` AS STRING) AS text").mapInArrow(run, "n_tokens long")


def length_histogram(tokens: DataFrame, *, tokens_col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, read as a context limit ``n_tokens``:

    ``n_docs`` of that length, ``docs_upto`` / ``docs_over`` (not longer / longer),
    ``tokens_upto`` (of documents not longer), ``tokens_over``, ``tokens_kept``
    (all documents truncated at the limit), ``tokens_cut``, ``quantile`` (share of
    documents not longer).  Null lengths are left out; an empty table gives no rows.

    Running sums are taken inside blocks of 64 lengths and over the blocks, so
    no task holds all lengths.
    """
    h = written(tokens.where(F.col(tokens_col).isNotNull())
                .groupBy(F.col(tokens_col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    h = (h.withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    before, every = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    blocks = blocks.select(
        "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("b_docs", "b_tokens")),
        F.sum("b_docs").over(every).alias("all_docs"), F.sum("b_tokens").over(every).alias("all_tokens"))
    inside = W.partitionBy("block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    s = (h.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside))
         .join(blocks, "block")
         .withColumn("docs_upto", F.col("d") + F.col("b_docs_before"))
         .withColumn("tokens_upto", F.col("t") + F.col("b_tokens_before"))
         .withColumn("docs_over", F.col("all_docs") - F.col("docs_upto"))
         .withColumn("tokens_kept", F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_over")))
    return s.select(
        "n_tokens", "n_docs", "docs_upto", "docs_over", "tokens_upto",
        (F.col("all_tokens") - F.col("tokens_upto")).alias("tokens_over"), "tokens_kept",
        (F.col("all_tokens") - F.col("tokens_kept")).alias("tokens_cut"),
        (F.col("docs_upto") / F.col("all_docs")).alias("quantile"))
