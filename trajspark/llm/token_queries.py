"""Queries of the operators on token ids (6, 7, 10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.llm import id_store, length_table, packing, piece_viterbi
from trajspark.llm.bpe_tokens import vocabulary
from trajspark.llm.common import new_folder, query, table

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op6_token_id_store")
def op6(spark, d):
    store = id_store.write_store(table(spark, d, "documents"), vocabulary(VOCABULARY), new_folder(spark, "id-store"))
    return id_store.read_store(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_packing")
def op7(spark, d):
    return packing.pack(table(spark, d, "documents"), vocabulary(VOCABULARY)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_length")


@query("op10_token_lengths")
def op10(spark, d):
    return length_table.length_histogram(length_table.lengths(table(spark, d, "documents"), vocabulary(VOCABULARY)))


@query("op8_sentencepiece")
def op8(spark, d):
    """Ids of every document, and its text decoded from them again."""
    path = vocabulary(PIECES)
    coded = piece_viterbi.encode(table(spark, d, "documents"), path).select(
        "doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return piece_viterbi.decode(coded, path, carry=("n_tokens", "ids_crc32")).select(
        "doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"))
