"""Order-aware building blocks that hold when one key owns a large share of the rows.

A window over a whole document would put that document into one task. Here a document is cut
into blocks of its integer order, each block is handled on its own, and only one small summary
row per block (per group of blocks, for long documents) crosses block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import cut


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so each task sends at
    most one row per key, however hot the key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per key; limited before the shuffle as in ``first_by``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def block_totals(df: DataFrame, keys: list[str], block: str, value: Column,
                  fan: int) -> DataFrame:
    """Exclusive running sum of ``value`` over blocks, in two levels of ``fan`` blocks each."""
    per_block = df.groupBy(*keys, block).agg(value.alias("_v"))
    per_block = per_block.withColumn("_g", F.floor(F.col(block) / fan))
    inner = Window.partitionBy(*keys, "_g").orderBy(block)
    per_block = per_block.withColumn(
        "_in", F.sum("_v").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    groups = per_block.groupBy(*keys, "_g").agg(F.sum("_v").alias("_gv"))
    outer = Window.partitionBy(*keys).orderBy("_g")
    groups = groups.select(*keys, "_g", F.sum("_gv").over(
        outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_out"))
    return (per_block.join(groups, [*keys, "_g"])
            .select(*keys, block, (F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0)))
                    .alias("_before")))


def with_position(df: DataFrame, keys: list[str], order: list[str], block_on: str | None = None,
                  block_size: int = 4096, name: str = "pos") -> DataFrame:
    """Dense 0-based position inside each key, exact, without one task per key.

    ``block_on`` is an integer order column (the first of ``order`` by default).
    """
    block_on = block_on or order[0]
    b = df.withColumn("_blk", F.floor(F.col(block_on) / block_size))
    before = block_totals(b, keys, "_blk", F.count(F.lit(1)), fan=1024)
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    return (b.withColumn("_in_blk", F.row_number().over(w) - 1)
            .join(before, [*keys, "_blk"])
            .withColumn(name, F.col("_before") + F.col("_in_blk"))
            .drop("_blk", "_in_blk", "_before"))


def with_position_and_size(df: DataFrame, keys: list[str], order: str, parts: int, block_size: int = 4096,
                           name: str = "idx") -> DataFrame:
    """``with_position`` and the rows of the key as ``size``, for many small keys over ``parts`` tasks.

    Only keys that reach beyond the first block of the integer column ``order`` need sums over blocks;
    the others are numbered in one window. Rows with a null key or order have no position and are left out.
    """
    b = df.dropna(subset=[*keys, order]).withColumn("_blk", F.floor(F.col(order) / block_size))
    low = b.agg(F.min("_blk")).first()[0]
    far = cut(b.filter(F.col("_blk") > F.lit(low)).select(*keys).distinct())
    near, long = b.drop("_blk"), None
    if not far.isEmpty():
        long = with_position(near.join(far, keys, "left_semi"), keys, [order], block_size=block_size, name=name)
        long = long.join(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")), keys)
        near = near.join(far, keys, "left_anti")
    w = Window.partitionBy(*keys)
    near = (near.repartition(parts, *keys).withColumn(name, F.row_number().over(w.orderBy(order)).cast("long") - 1)
            .withColumn("size", F.count(F.lit(1)).over(w)))
    return near if long is None else near.unionByName(long)


def ordered_position(df: DataFrame, keys: list[str], order: list[str],
                     name: str = "pos") -> DataFrame:
    """As ``with_position`` for any order columns, text included.

    Rows are laid out by (keys, order) over all tasks and written out; a row's position is its
    place in its own range plus the sizes of the key's earlier ranges.
    """
    laid = cut(df.repartitionByRange(*keys, *order).withColumn("_r", F.spark_partition_id()))
    before = block_totals(laid, keys, "_r", F.count(F.lit(1)), fan=1024)
    w = Window.partitionBy(*keys, "_r").orderBy(*order)
    return (laid.withColumn("_in_r", F.row_number().over(w) - 1).join(before, [*keys, "_r"])
            .withColumn(name, F.col("_before") + F.col("_in_r")).drop("_r", "_in_r", "_before"))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, into: str,
                  default: str | None = None, block_on: str | None = None,
                  block_size: int = 4096, fan: int = 1024) -> DataFrame:
    """Last non-NULL ``value`` up to the row itself, as column ``into``."""
    block_on = block_on or order[0]
    b = df.withColumn("_blk", F.floor(F.col(block_on) / block_size))
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    b = b.withColumn("_seen", F.last(value, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    pick = F.struct(*[F.col(c) for c in order])
    # last value of each block, then the same question over blocks and groups of blocks
    tail = (b.groupBy(*keys, "_blk")
            .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), pick)).alias("_tail"))
            .withColumn("_g", F.floor(F.col("_blk") / fan)))
    inner = Window.partitionBy(*keys, "_g").orderBy("_blk")
    tail = tail.withColumn("_near", F.last("_tail", ignorenulls=True).over(
        inner.rowsBetween(Window.unboundedPreceding, -1)))
    groups = tail.groupBy(*keys, "_g").agg(
        F.max_by(F.col("_tail"), F.when(F.col("_tail").isNotNull(), F.col("_blk"))).alias("_gt"))
    outer = Window.partitionBy(*keys).orderBy("_g")
    groups = groups.select(*keys, "_g", F.last("_gt", ignorenulls=True).over(
        outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    carried = (tail.join(groups, [*keys, "_g"])
               .select(*keys, "_blk", F.coalesce("_near", "_far").alias("_carry")))
    found = F.coalesce(F.col("_seen"), F.col("_carry"))
    if default is not None:
        found = F.coalesce(found, F.lit(default))
    return (b.join(carried, [*keys, "_blk"]).withColumn(into, found)
            .drop("_blk", "_seen", "_carry"))


def with_neighbours(df: DataFrame, keys: list[str], pos: str, value: str, before: int, after: int,
                    into: str, glue: str = " ", block_size: int = 2048) -> DataFrame:
    """Join the values of positions i-before .. i+after; ``pos`` is dense (see ``with_position``).

    Rows near a block border are copied into the neighbouring block; copies are dropped after use.
    """
    blk = F.floor(F.col(pos) / block_size)
    low = F.floor((F.col(pos) - after) / block_size)
    high = F.floor((F.col(pos) + before) / block_size)
    spread = df.withColumn("_home", blk).withColumn(
        "_blk", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    w = (Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(-before, after))
    return (spread.withColumn(into, F.array_join(F.collect_list(value).over(w), glue))
            .filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home"))


def with_next(df: DataFrame, keys: list[str], pos: str, values: dict[str, str],
              block_size: int = 4096) -> DataFrame:
    """Values of the next position as new columns (``values``: column -> new name)."""
    blk = F.floor(F.col(pos) / block_size)
    spread = df.withColumn("_home", blk).withColumn(
        "_blk", F.explode(F.array_distinct(F.array(
            blk, F.greatest(F.floor((F.col(pos) - 1) / block_size), F.lit(0))))))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    for source, target in values.items():
        spread = spread.withColumn(target, F.lead(source).over(w))
    return spread.filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def dense_index(df: DataFrame, value: str, name: str = "idx", buckets: int = 4096) -> DataFrame:
    """Number distinct values 0..n-1 without a global window.

    Values are numbered inside hash buckets; the bucket sizes (at most ``buckets`` numbers) give
    the offsets.
    """
    d = df.select(value).distinct().withColumn("_b", F.pmod(F.xxhash64(value), F.lit(buckets)))
    sizes = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_b")   # at most ``buckets`` rows
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_b").orderBy(value)
    return (d.withColumn("_rn", F.row_number().over(inner) - 1).join(offsets, "_b")
            .select(value, (F.col("_off") + F.col("_rn")).cast("long").alias(name)))
