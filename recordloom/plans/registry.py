"""Registry of the queries and of the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans.views import with_views
from recordloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, decimals: int = 4) -> DataFrame:
    """Round doubles, so that the order of summation does not show."""
    return df.select(*[F.round(c, decimals).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def query(name: str, oracle: str | None = None):
    """Register a query; its doubles are rounded to 4 places as in the oracle text."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(tune(spark), sf_dir))
        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn
    return wrap
