"""Exact medians per group in one lazy plan that never holds a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.ordering import block_totals

#: Distinct values that one task ranks, about.
RANKED = 50_000
#: A sketch misses a rank by at most 1 / ACCURACY of a group; the bracket is four times as wide to both sides.
ACCURACY = 100_000
_MARGIN = 4 / ACCURACY


def _attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of the one row per key; without keys the one row is a scalar subquery, not a join."""
    if keys:
        return df.join(small, keys)
    row = small.select(F.struct(*small.columns).alias("s")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in small.columns])


def middle_values(df: DataFrame, keys: list[str], value: str, ranked: int = RANKED) -> DataFrame:
    """(keys, _total, _side, value, _n, _blk): the distinct values around the middle of each group
    (side 0) and how often each is there; those below (side -1) and above (side 1) are only counted.

    The bracket comes from a sketch and is two numbers per group. What is between them, less than a
    thousandth of a large group, is cut into ranges of equal width, about `ranked` values in each.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = F.percentile_approx("_v", [0.5 - _MARGIN, 0.5 + _MARGIN], ACCURACY)
    bracket = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), ends.alias("_e")).select(
        *keys, "_total", F.get("_e", F.lit(0)).alias("_lo"), F.get("_e", F.lit(1)).alias("_hi"))
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    inside = side == 0
    share = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    ranges = F.ceil(F.col("_total") * (2 * _MARGIN / ranked))
    block = F.when(side == -1, -1).when(side == 1, ranges + 1).otherwise(F.floor(F.coalesce(share, F.lit(0.0)) * ranges))
    return (_attach(rows, bracket, keys)
            .groupBy(*keys, "_total", side.alias("_side"), F.when(inside, F.col("_v")).alias("_v"), block.cast("long").alias("_blk"))
            .agg(F.count(F.lit(1)).alias("_n")))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median",
                 ranked: int = RANKED) -> DataFrame:
    """Median per key (mean of the two middle values for even counts); without keys one row.

    One plan, with no action while it is made. A rank is a place in a range plus the sizes of the
    ranges before. Should the sketch ever miss the middle, the query fails; it gives no wrong value.
    """
    near = middle_values(df, keys, value, ranked)
    before = block_totals(near, keys, "_blk", F.sum("_n"), fan=1024)
    order = Window.partitionBy(*keys, "_blk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = (near.withColumn("_last", F.sum("_n").over(order)).join(before, [*keys, "_blk"])
            .withColumn("_last", F.col("_last") + F.col("_before")))
    first = F.col("_last") - F.col("_n") + 1
    found = F.when(F.col("_side") == 0, F.col("_v")).otherwise(F.raise_error(F.lit("the sketch missed a middle rank")).cast("double"))
    hits = [F.max(F.when((first <= rank) & (F.col("_last") >= rank), found))
            for rank in (F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1)]
    return last.groupBy(*keys).agg(((hits[0] + hits[1]) / 2).alias(name))
