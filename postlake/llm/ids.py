"""Sets of document ids that texts are filtered by."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Document ids sent to every executor at most (16 bytes each); beyond it they are joined.
BROADCAST_IDS = 1_000_000


def within(ids: DataFrame) -> DataFrame:
    """The stored ids, marked for broadcast if their count is within BROADCAST_IDS.

    So whole texts are not shuffled for the sake of a short list.
    """
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
