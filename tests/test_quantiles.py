import random
import statistics

import pytest

from pyspark.sql import functions as F

from recordloom.operators.quantiles import exact_median, middle_values


@pytest.mark.parametrize("ranked", [2, 40, 50_000])
def test_medians_of_wide_and_narrow_groups(spark, ranked):
    rng = random.Random(ranked)
    rows = [("wide", rng.random()) for _ in range(3001)] + [("even", float(rng.randrange(500))) for _ in range(1000)]
    rows += [("one", 7.0), ("ties", 1.0), ("ties", 1.0), ("ties", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    want = {g: statistics.median(vs) for g, vs in want.items() if vs != [None]}
    assert dict(tuple(r) for r in exact_median(df, ["g"], "v", ranked=ranked).collect()) == want
    every = [v for _, v in rows if v is not None]
    assert exact_median(df, [], "v", ranked=ranked).first()["median"] == statistics.median(every)
    assert exact_median(df.where("false"), [], "v").first()["median"] is None


def test_a_group_of_many_values_is_ranked_in_a_small_part(spark):
    """5 million distinct values under one key: what one task ranks is bounded, and so is every range."""
    n = 5_000_001
    df = spark.range(n).select(F.lit("hot").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([("small", 1.0), ("small", 4.0)], "g string, v double"))
    left = middle_values(df, ["g"], "v", ranked=100).groupBy("g", "_blk").count().groupBy("g").max("count").collect()
    assert {r["g"]: r["max(count)"] <= 200 for r in left} == {"hot": True, "small": True}
    assert {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()} == {"hot": (n - 1) / 2, "small": 2.5}
    assert exact_median(df.where("g = 'hot'"), [], "v").first()["median"] == (n - 1) / 2


def test_no_action_while_the_plan_is_made(spark):
    tracker, df = spark.sparkContext.statusTracker(), spark.range(1000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    spark.sparkContext.setJobGroup("planning", "planning")
    exact_median(df, ["g"], "v")
    exact_median(df, [], "v")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")
