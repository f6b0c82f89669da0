"""Registered queries, one module per operator family."""

from postlake.plans import (  # noqa: F401
    chat_plans,
    curation_plans,
    label_plans,
    language_plans,
    model_plans,
    sampling_plans,
    source_plans,
    streaming_plans,
    target_plans,
    text_plans,
)
from postlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
