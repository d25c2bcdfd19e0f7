"""Incremental batch work: what is still to do, what is still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(targets: DataFrame, done: DataFrame, keys: list[str],
            error: str | None = "error") -> DataFrame:
    """Targets without a finished result; failed results are tried again."""
    finished = done.filter(F.col(error).isNull()) if error else done
    return targets.join(finished.select(*keys).distinct(), keys, "left_anti")


def fresh_within(cache: DataFrame, written_at: str, now: Column, hours: float = 24.0) -> DataFrame:
    """Cache entries younger than the time to live."""
    age = (now.cast("timestamp").cast("double") - F.col(written_at).cast("timestamp")
           .cast("double"))
    return cache.filter(age < hours * 3600)
