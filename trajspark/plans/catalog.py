"""All registered queries."""

from __future__ import annotations

from trajspark.plans import registry
from trajspark.plans import numeric, evaluation, tests_of_difference, textual, verification, fusion_queries, model_queries, study_queries, stream_queries, signal_queries, repair_queries, label_queries, claim_queries, digest_queries, report_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def sql():
    return dict(registry.SQL)
