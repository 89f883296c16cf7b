"""Registered queries of the training-data operators and of the pipeline over them."""

from __future__ import annotations

import corpus_pipeline
from trajspark.llm import common, corpus_queries, manifest_queries, page_queries, token_queries, vector_queries  # noqa: F401


def queries():
    return common.QUERIES | {"pipeline": corpus_pipeline.run}


def sql():
    return common.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
