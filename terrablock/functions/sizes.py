"""Size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def is_small(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; no more than that plus one are counted."""
    return df.limit(most + 1).count() <= most
