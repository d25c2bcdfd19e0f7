"""Ordered operators against plain Python, with blocks small enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import figures as G
from recordloom.operators import modeling
from recordloom.operators import ordering as O
from recordloom.operators.modeling import gap_candidates, open_gaps, pareto_front, skyline
from recordloom.operators.quantiles import exact_median
from recordloom.operators.stats import pairwise_corr


def frame(spark, n=400, seed=2):
    rng = random.Random(seed)
    # one key owns most rows
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", i,
             rng.choice([None, None, "a", "b", "c"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, o int, v string").repartition(4)


def test_position_and_neighbours(spark):
    rows, df = frame(spark)
    df = df.withColumn("t", F.col("o").cast("string"))
    p = O.with_position(df, ["k"], ["o"], block_size=16)
    n = O.with_neighbours(p, ["k"], "pos", "t", 2, 2, "near", block_size=8)
    by_key = {}
    for k, o, _ in rows:
        by_key.setdefault(k, []).append(o)
    for r in n.collect():
        seq = by_key[r["k"]]
        i = seq.index(r["o"])
        assert r["pos"] == i
        assert r["near"] == " ".join(map(str, seq[max(0, i - 2):i + 3]))


def test_ordered_position(spark):
    rows, df = frame(spark)
    got = O.ordered_position(df.withColumn("s", F.lpad(F.col("o").cast("string"), 6, "0")),
                             ["k"], ["s"]).collect()
    by_key = {}
    for k, o, _ in rows:
        by_key.setdefault(k, []).append(o)
    assert all(by_key[r["k"]].index(r["o"]) == r["pos"] for r in got) and len(got) == len(rows)


def test_carry_forward(spark):
    rows, df = frame(spark)
    got = {(r["k"], r["o"]): r["c"] for r in O.carry_forward(
        df, ["k"], ["o"], "v", "c", block_size=8, fan=3).collect()}
    last = {}
    for k, o, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert got[(k, o)] == last[k]


def test_dense_index(spark):
    df = spark.createDataFrame([(f"v{i % 37}",) for i in range(200)], "v string")
    got = O.dense_index(df, "v", buckets=5).collect()
    assert sorted(r["idx"] for r in got) == list(range(37))


def test_exact_median(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 5}", rng.choice([rng.random(), 0.5, 2.0]))
            for i in range(3001)] + [("one", 7.0), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    import statistics
    want = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    assert got == {g: statistics.median(v) for g, v in want.items()}


def test_pareto_and_gaps(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 50), rng.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, x int, y int")
    want = {i for i, x, y in rows if not any(
        a >= x and b >= y and (a > x or b > y) for _, a, b in rows)}
    assert {r["i"] for r in pareto_front(df, "x", "y").collect()} == want
    g = gap_candidates(df.filter("x < 5 and y < 4"), ["x", "y"])
    seen = {(x, y) for _, x, y in rows if x < 5 and y < 4}
    xs, ys = {x for x, _ in seen}, {y for _, y in seen}
    assert {(r["x"], r["y"]) for r in g.collect()} == {
        (x, y) for x in xs for y in ys if (x, y) not in seen}


def test_open_gaps_stand_for_all_absent_combinations(spark):
    rng = random.Random(9)
    rows = [tuple(rng.randint(0, m) for m in (6, 5, 4)) for _ in range(60)] + [(None, 1, 1), (1, None, 2), (2, 3, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    values = [{r[i] for r in rows} - {None} for i in range(3)]
    seen = [{r[:k] for r in rows if None not in r[:k]} for k in range(4)]
    spelled = [x for g in open_gaps(df, ["a", "b", "c"]).collect() for x in (
        [(g.a, g.b, c) for c in values[2]] if g.depth == 2 else [(g.a, g.b, g.c)])]
    want = {(a, b, c) for a in values[0] for b in values[1] for c in values[2]} - seen[3]
    assert len(spelled) == len(set(spelled)) and set(spelled) == want
    assert open_gaps(df, ["a"]).collect() == [] and open_gaps(df.limit(0), ["a", "b"]).collect() == []


@pytest.mark.parametrize("n,cells,block", [(2, 4096, 2000), (3, 64, 7), (3, 4096, 2000), (4, 4096, 50)])
def test_skyline(spark, monkeypatch, n, cells, block):
    """Three and more objectives, with one point many times, ties and NULLs."""
    monkeypatch.setattr(modeling, "_CELLS", cells)
    monkeypatch.setattr(modeling, "_BLOCK", block)
    rng = random.Random(n)
    names = [f"v{i}" for i in range(n)]
    rows = [(i, *[float(rng.randint(0, 25)) for _ in names]) for i in range(400)]
    rows += [(1000 + i, *[24.0] * n) for i in range(300)] + [(2000, None, *[99.0] * (n - 1)), (2001, *[-1.0] * n)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    whole = [r for r in rows if None not in r]
    points = {r[1:] for r in whole}
    best = {p for p in points if not any(q != p and all(x >= y for x, y in zip(q, p)) for q in points)}
    got = skyline(df, names)
    assert got.columns == df.columns
    assert sorted(r["i"] for r in got.collect()) == sorted(r[0] for r in whole if r[1:] in best)
    assert skyline(df.filter("i < 0"), names).collect() == []


def test_constant_column_has_no_correlation(spark):
    df = spark.range(40).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"),
                                (F.col("id") * 2.0).alias("c"))
    got = pairwise_corr(df, ["a", "b", "c"]).collect()
    assert [(r["a"], r["b"], round(r["r"], 6)) for r in got] == [("a", "c", 1.0)]


def test_densify(spark):
    df = spark.createDataFrame([("s", 0, 0, 0), ("s", 1, 10, 5)], "k string, pos long, x int, y int")
    got = sorted((r["x"], r["y"]) for r in G.densify_series(df, ["k"]).collect())
    assert got == [(x, int(x / 2)) for x in range(11)]


def test_fit_ticks(spark):
    cases = [([0, 10, 20, 30], [100, 200, 300, 400], False), ([0, 40, 20, 30], [100, 200, 300, 400], False),
             ([0, 10], [100, 120], False), ([5, 5], [100, 300], False), ([0, 10], [100, 300], False),
             ([0, 10], [100, 300], True), ([0, 10, 20], [100, 200, 300], True), ([0, 1, 10, 20], [100, 104, 200, 300], False)]
    rows = [(i, 0, "x", float(p), float(v), 400.0, fb) for i, (vs, ps, fb) in enumerate(cases) for v, p in zip(vs, ps)]
    df = spark.createDataFrame(rows, "image int, panel int, axis string, px double, value double, span double, fallback boolean")
    got = {r.image: (r.slope, r.offset, r.ticks_used) for r in G.fit_ticks(df).collect()}
    assert abs(got[0][0] - 0.1) < 1e-9 and abs(got[0][1] + 10) < 1e-9 and got[0][2] == 4
    assert got[1][2] == 3                                   # one bad label left out
    assert got[2][0] is None and got[3][0] is None          # too narrow; one value
    assert got[4][2] == 2 and got[5][0] is None             # two ticks do, unless they come from the fallback
    assert got[6][2] == 3 and got[7][2] == 3                # a tick near an earlier one is dropped


def test_greedy_series_match(spark):
    rng = random.Random(8)
    pts = [(f"i{i}", line, x, x, rng.random() * 50) for i in range(3) for line in range(4)
           for x in range(20)]
    gold = spark.createDataFrame(pts, "image string, line int, ord int, x int, y double")
    pred = spark.createDataFrame([(i, (l + 1) % 4, o, x, y + rng.random()) for i, l, o, x, y in pts],
                                 gold.schema)
    errors = [tuple(r) for r in G.pair_errors(gold, pred).select("image", "mae", "gold", "pred")
              .collect()]
    want, used = set(), set()
    for image, mae, g, p in sorted(errors):
        if (image, "g", g) not in used and (image, "p", p) not in used:
            used |= {(image, "g", g), (image, "p", p)}
            want.add((image, g, p))
    got = {(r["image"], r["gold"], r["pred"]) for r in G.match_series(gold, pred).collect()}
    assert got == want
