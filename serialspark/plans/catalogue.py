"""All queries of the library."""

from __future__ import annotations

from serialspark.plans import q_boxes, q_data, q_decode, q_evaluation, q_jobs, q_labels, q_plates, q_streams, q_text  # noqa: F401
from serialspark.plans.registry import ORACLES, QUERIES

FLAGSHIP = "recognize_logits"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
