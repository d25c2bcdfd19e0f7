"""Exploratory statistics over records and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.base import first_rule, quiet_double
from recordloom.operators.ordering import first_by
from recordloom.operators.quantiles import exact_median


def _stack(one: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])))


def density(df: DataFrame, columns: list[str], groups: dict[str, list[str]] | None = None,
            top: int = 24) -> DataFrame:
    """Non-NULL count and share per column, the fullest first (a top report); one pass."""
    tag = {c: g for g, cs in (groups or {}).items() for c in cs}
    one = df.agg(*[F.count(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    long = one.select("_n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n"), F.lit(tag.get(c, ""))
                 .alias("family")) for c in columns])))
    return (long.withColumn("pct", F.try_divide(F.lit(100.0) * F.col("n"), F.col("_n")))
            .drop("_n").orderBy(F.desc("n"), "column").limit(top))


def _any_present(df: DataFrame, cols: list[str]) -> Column:
    have = [F.col(c) for c in cols if c in df.columns]
    return F.coalesce(*have).isNotNull() if have else F.lit(False)


def joinability(df: DataFrame, conditions: list[str], structure: list[str],
                performance: list[str]) -> DataFrame:
    """One row: records with condition and performance, structure and performance, all three."""
    c, s, p = (_any_present(df, x) for x in (conditions, structure, performance))
    return df.agg(F.count(F.lit(1)).alias("records"),
                  F.count_if(c & p).alias("condition_performance"),
                  F.count_if(s & p).alias("structure_performance"),
                  F.count_if(c & s & p).alias("all_three"))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are there; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(
        F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _pairs_of(df: DataFrame, names: list[str], width: int = 16) -> DataFrame:
    """Rows (a, b, x, y): the values of every two features a <= b that a row has, by place in `names`.

    Features go in blocks, so that what is copied for a pair are two blocks and not the whole row.
    """
    width, blocks = min(width, max(len(names), 1)), -(-len(names) // width)
    values = df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("vs"))
    pairs = lambda n, keep: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(i if keep else 0, n)])
    if blocks > 1:
        part = lambda c: F.slice("vs", F.col(c) * width + 1, F.lit(width))
        values = values.select(F.explode(pairs(blocks, True)).alias("g"), "vs").select(
            "g.i", "g.j", part("g.i").alias("xs"), part("g.j").alias("ys"))
    else:
        values = values.select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("vs").alias("xs"), F.col("vs").alias("ys"))
    out = values.select(F.explode(pairs(width, blocks == 1)).alias("p"), "*").select(
        (F.col("i") * width + F.col("p.i")).alias("a"), (F.col("j") * width + F.col("p.j")).alias("b"),
        F.get("xs", F.col("p.i")).alias("x"), F.get("ys", F.col("p.j")).alias("y"))
    return out.filter("a <= b and x is not null and y is not null")


def pairwise_corr(df: DataFrame, features: list[str], min_overlap: int = 15,
                  min_abs: float = 0.30, min_values: int = 10) -> DataFrame:
    """Correlated feature pairs a < b (in the given order), strongest first.

    Long form: a row gives one pair of values for every two features it has, and moments are added
    up per pair before the shuffle. One scan, whatever the number of features. A feature with itself
    is a pair too and counts its values. A constant side has no correlation.
    """
    names = list(features)
    moments = _pairs_of(df, names).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    enough = moments.filter((F.col("a") == F.col("b")) & (F.col("n") >= min_values))
    name = lambda i: F.get(F.array(*[F.lit(c) for c in names]), i)
    return (moments.filter((F.col("a") != F.col("b")) & (F.col("n") >= min_overlap) & (F.col("vx") > 0) & (F.col("vy") > 0))
            .withColumn("r", F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).filter(F.abs("r") >= min_abs)
            .join(enough.select("a"), "a", "left_semi").join(enough.select(F.col("a").alias("b")), "b", "left_semi")
            .select(name(F.col("a")).alias("a"), name(F.col("b")).alias("b"), "n", "r")
            .orderBy(F.desc(F.abs("r")), "a", "b"))


def stratified_corr(df: DataFrame, x: str, y: str, strata: dict[str, int],
                    min_pairs: int = 5, decimals: int = 2) -> DataFrame:
    """Correlation pooled and per stratum column: (stratum, name, r, n).

    ``strata`` maps a column to the least number of pairs that is shown.
    """
    both = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.round(guarded_corr(F.col(x).cast("double"), F.col(y).cast("double")), decimals)

    def row(grouped, stratum, name):
        return grouped.agg(r.alias("r"), both.alias("n")).select(
            F.lit(stratum).alias("stratum"), name.alias("name"),
            F.when(F.col("n") >= min_pairs, F.col("r")).alias("r"), "n")

    out = row(df.groupBy(), "pooled", F.lit("all"))
    for column, least in strata.items():
        part = row(df.groupBy(column), column, F.col(column).cast("string"))
        out = out.unionByName(part.filter(F.col("n") >= least))
    return out


def trend(df: DataFrame, x: str, y: str, by: str, min_n: int = 8, min_distinct: int = 3,
          min_range: float = 1.0) -> DataFrame:
    """Straight-line fit, pooled and per group where x varies enough."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")

    def fit(grouped):
        return grouped.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(cx).alias("distinct_x"),
            (F.max(cx) - F.min(cx)).alias("x_range"), F.regr_slope(cy, cx).alias("slope"),
            F.regr_intercept(cy, cx).alias("intercept"))

    pooled = fit(rows.groupBy()).select(F.lit("all").alias("name"), "n", "slope", "intercept")
    each = fit(rows.groupBy(F.col(by).cast("string").alias("name"))).filter(
        (F.col("n") >= min_n) & (F.col("distinct_x") >= min_distinct)
        & (F.col("x_range") >= min_range)).select("name", "n", "slope", "intercept")
    return pooled.unionByName(each)


def bin_right_closed(c: Column, edges: list[float], labels: list[str]) -> Column:
    """(a, b] bins; outside is NULL."""
    return first_rule([((c > lo) & (c <= hi), label)
                       for lo, hi, label in zip(edges, edges[1:], labels)])


def binned_pivot(df: DataFrame, x: str, y: str, value: str, x_bins, y_bins) -> DataFrame:
    """Mean and count per pair of bins, empty cells kept: (x_bin, y_bin, mean, n).

    The empty cells come from a fixed spine that is added with NULL values before grouping.
    """
    (xe, xl), (ye, yl) = x_bins, y_bins
    data = df.select(bin_right_closed(F.col(x), xe, xl).alias("x_bin"),
                     bin_right_closed(F.col(y), ye, yl).alias("y_bin"),
                     F.col(value).cast("double").alias("v")).filter(
        "x_bin is not null and y_bin is not null")
    spine = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("x_bin"), F.lit(b).alias("y_bin"),
                 F.lit(None).cast("double").alias("v")) for a in xl for b in yl])))
    return data.unionByName(spine).groupBy("x_bin", "y_bin").agg(
        F.avg("v").alias("mean"), F.count("v").alias("n"))


def category_bin_median(df: DataFrame, category: str, x: str, value: str, bins) -> DataFrame:
    """Median and count per category and bin; the category rank is by its number of rows."""
    edges, labels = bins
    d = df.select(F.col(category).alias("category"),
                  bin_right_closed(F.col(x), edges, labels).alias("bin"),
                  F.col(value).cast("double").alias("v"))
    sizes = d.groupBy("category").agg(F.count(F.lit(1)).alias("category_n"))
    cells = d.filter("bin is not null")
    counts = cells.groupBy("category", "bin").agg(F.count("v").alias("n"))
    medians = exact_median(cells, ["category", "bin"], "v")
    return counts.join(medians, ["category", "bin"], "left").join(sizes, "category")


def group_summary(df: DataFrame, group: str, value: str, other: str | None = None) -> DataFrame:
    """n, mean, max and median per group, best mean first."""
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")]
    if other:
        aggs.append(F.avg(other).alias("other_mean"))
    return (df.groupBy(group).agg(*aggs)
            .join(exact_median(df, [group], value), group, "left")
            .orderBy(F.desc_nulls_last("mean"), group))


def describe_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """count, mean, std, min, max per group."""
    return df.groupBy(group).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def top_groups(df: DataFrame, group: str, k: int = 12) -> DataFrame:
    """The k largest groups (a top report), ties by name."""
    return (df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), group).limit(k))


def top_groups_by_max(df: DataFrame, group: str, value: str, k: int = 15) -> DataFrame:
    return (df.groupBy(group).agg(F.max(value).alias("max"), F.avg(value).alias("mean"),
                                  F.count(value).alias("n"))
            .orderBy(F.desc("max"), group).limit(k))


def shares(df: DataFrame, group: str) -> DataFrame:
    """Count and share of the whole per value."""
    counts = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = df.filter(F.col(group).isNotNull()).count()
    return counts.select(group, "n", (F.col("n") / F.lit(total)).alias("share"))


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of a by b as columns, zero-filled."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.groupBy(a).pivot(b, values).count().na.fill(0)


def pivot_mean_count(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Long pivot: mean and n per cell, with the mean of the row's cell means for ordering."""
    cells = (df.groupBy(row, col).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
             .filter("mean is not null"))
    rows = cells.groupBy(row).agg(F.avg("mean").alias("row_mean"))
    return cells.join(rows, row)


def support_filter(cells: DataFrame, row: str, col: str, k: int = 3, n: str = "n") -> DataFrame:
    """Cells whose row and column totals, measured together, both reach k."""
    r = cells.groupBy(row).agg(F.sum(n).alias("_r")).filter(F.col("_r") >= k)
    c = cells.groupBy(col).agg(F.sum(n).alias("_c")).filter(F.col("_c") >= k)
    return cells.join(r, row, "left_semi").join(c, col, "left_semi")


def support_filter_sequential(df: DataFrame, first: str, then: str, k: int = 3) -> DataFrame:
    """Rows whose ``first`` value is frequent, then of those the ones with a frequent ``then``."""
    f = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    left = df.join(f, first, "left_semi")
    t = left.groupBy(then).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    return left.join(t, then, "left_semi")


def collapse_rare(df: DataFrame, category: str, k: int, into: str = "collapsed",
                  other: str = "Other", unknown: str = "Unknown") -> DataFrame:
    """The k most frequent categories keep their name; the rest is Other; Unknown stays apart."""
    top = (df.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), category).limit(k).select(category, F.lit(True).alias("_top")))
    return df.join(top, category, "left").withColumn(
        into, F.when(F.col("_top"), F.col(category))
        .when(F.col(category) == unknown, F.lit(unknown)).otherwise(F.lit(other))).drop("_top")


def histogram_by(df: DataFrame, value: str, category: str, width: float = 5.0,
                 top: float = 100.0) -> DataFrame:
    """Counts per bin [i*width, (i+1)*width) and category; the top edge is in the last bin."""
    v = F.col(value)
    last = int(top / width) - 1
    return (df.filter(v.between(0, top))
            .groupBy(category, F.least(F.floor(v / width), F.lit(last)).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def order_by_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with n and median, highest median first."""
    n = df.groupBy(group).agg(F.count(value).alias("n"))
    return (n.join(exact_median(df, [group], value), group)
            .orderBy(F.desc("median"), group))


def families(label: Column) -> list[tuple[Column, str]]:
    """Material families by words in the label."""
    s = F.lower(label)
    has = s.contains
    return [(has("fe"), "Fe-based"), (has("zn") & has("zr"), "ZnZrOx"),
            (has("zn") & has("cr"), "ZnCrOx"),
            ((has("in") & has("zr")) | has("in2o3"), "InOx/InZr"), (has("ga"), "Ga-based"),
            (has("cu"), "Cu-based"), (has("zn"), "Zn-based")]


def metal_groups(metal: Column, promoter: Column, system: Column, zeolite: Column,
                 support: Column) -> Column:
    """Metal and promoter groups of a zeolite catalyst."""
    def clean(c):
        return F.trim(F.coalesce(c, F.lit("")))

    m, p, s = F.upper(clean(metal)), F.upper(clean(promoter)), F.lower(clean(system))
    z = F.upper(F.when(F.length(clean(zeolite)) > 0, zeolite).otherwise(clean(support)))
    bare = (m == "") & (p == "")
    rules = [(s.contains("ga"), "Ga/ZSM-5"), ((m == "ZN") & (p == "P"), "Zn+P/ZSM-5"),
             (m == "ZN", "Zn/ZSM-5"), (m.contains("GA"), "Ga/ZSM-5"),
             (m.contains("MO"), "Mo/ZSM-5"), (m.contains("FE"), "Fe/ZSM-5"),
             (m.contains("CU"), "Cu/ZSM-5"), (s.contains("ssz"), "SSZ-24 (bare)"),
             (s.contains("sapo"), "SAPO"), (bare & z.contains("ZSM"), "H-ZSM-5"),
             (bare & z.contains("SAPO"), "SAPO"), (bare, "H-form zeolite"), (m == "", "Other")]
    return first_rule(rules, F.concat(m, F.lit("/zeolite")))


def acid_component(system: Column, zeolite: Column, support: Column) -> Column:
    c = F.upper(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (zeolite, system, support)]))
    return first_rule([
        (c.rlike(r"(?U)\bZSM-?5\b|HZSM|H-ZSM|MFI\b"), "ZSM-5"), (c.rlike(r"SAPO-?34"), "SAPO-34"),
        (c.rlike(r"(?U)\bSAPO\b"), "SAPO"),
        (c.rlike(r"(?U)\bSSZ\b|\bBETA\b|\bBEA\b"), "Other zeolite")], "No zeolite")


def oxide_component(system: Column, metal: Column, support: Column) -> Column:
    s, m, u = (F.upper(F.coalesce(x, F.lit(""))) for x in (system, metal, support))
    def rl(c, p):
        return c.rlike("(?U)" + p)

    indium = rl(s, r"IN2O3|IN₂O₃|INO[X]?(?!\w)") | m.startswith("IN")
    rules = [
        (indium & rl(s, r"ZNO|ZN-ZR|ZNZR|ZRO"), "In₂O₃-ZnO/ZrO₂"), (indium, "In₂O₃"),
        (rl(s, r"ZN.?CR|ZNCR") | rl(m, r"ZN.*CR|CR.*ZN"), "ZnCrOx"),
        (rl(s, r"ZNO.ZRO|ZN.ZR[O]?2?|ZNZRO"), "ZnO-ZrO₂"),
        (rl(m, r"\bCU\b") | rl(s, r"^CU[^A-Z]|[^A-Z]CU[^A-Z]|CUZO|CUZN"), "Cu"),
        (rl(m, r"\bFE\b") | rl(s, r"^FE[^A-Z]|[^A-Z]FE[^A-Z]|FE2O|FE3O"), "Fe"),
        (rl(m, r"\bPD\b") | rl(s, r"^PD[^A-Z]|[^A-Z]PD[^A-Z]"), "Pd"),
        (rl(m, r"\bZN\b") | rl(F.concat_ws(" ", s, u), r"\bZNO\b"), "ZnO")]
    rules += [(rl(m, rf"\b{e.upper()}\b"), e) for e in ("Rh", "Pt", "Au", "Co", "Ni")]
    return first_rule(rules, "Other/Unknown")


def zeolite_label(zeolite: Column, system: Column) -> Column:
    z = F.trim(F.coalesce(F.when(F.length(zeolite) > 0, zeolite), system, F.lit("")))
    has = z.contains
    return first_rule([
        (has("SAPO-34") | has("SAPO34"), "SAPO-34"), (has("ZSM-5") | has("ZSM5"), "ZSM-5"),
        (has("ZSM-22"), "ZSM-22"), (has("BEA") | has("Beta"), "Beta"), (has("LEV"), "LEV"),
        (has("CHA"), "CHA"), (has("AFX"), "AFX"), (has("DDR"), "DDR"),
        (has("MTT") | has("ZSM-23"), "ZSM-23"), (has("MFI"), "ZSM-5"), (z == "", "Unknown")], z)


def support_label(support: Column, zeolite: Column) -> Column:
    def one(c):
        s = F.trim(c)
        return first_rule([
            (s.contains("SAPO"), "SAPO-34"), (s.contains("ZSM"), "ZSM-5"),
            (s.contains("ZIF"), "ZIF-8"), (s.contains("Al2O3"), "Al₂O₃"),
            (F.lower(s).contains("carbon") | (s == "C"), "C/NC"), (s.contains("MIL"), "MOF")])
    return F.coalesce(one(support), one(zeolite), F.lit("No support"))


def pick_first_key(extra: Column, keys: list[str]) -> Column:
    """First key of an overflow map that holds a number."""
    return F.coalesce(*[quiet_double(F.trim(F.try_element_at(extra, F.lit(k)))) for k in keys])


def valid_mean(df: DataFrame, category: str, products: list[str], low: float = 0.0,
               high: float = 100.0) -> DataFrame:
    """Mean and n per category and product over values in (low, high]."""
    long = df.select(category, F.inline(F.array(*[
        F.struct(F.lit(p).alias("product"), F.col(p).cast("double").alias("v"))
        for p in products])))
    return (long.filter((F.col("v") > low) & (F.col("v") <= high)).groupBy(category, "product")
            .agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")))


def argmax_row(df: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """The whole row with the largest value; ties by the given columns, ascending."""
    return (df.filter(F.col(value).isNotNull())
            .orderBy(F.desc(value), *[F.col(t) for t in tie]).limit(1))


def analysis_frame(attributes: DataFrame, papers: DataFrame, topic: str,
                   metric_keys: list[str], picks: dict[str, list[str]]) -> DataFrame:
    """One row per record: metric and picks by alias order, °C again, family; kept if the topic fits
    or the metric is there."""
    wanted = list(dict.fromkeys(metric_keys + [k for ks in picks.values() for k in ks]))
    num = attributes.groupBy("doc", "rec_key").agg(
        F.max("best_label")["label"].alias("label"),
        *[F.max(F.when(F.col("attr") == k, F.col("value_num"))).alias(f"_{k}") for k in wanted])
    value = {n: F.coalesce(*[F.col(f"_{k}") for k in ks]) for n, ks in picks.items()}
    if "temperature" in value:
        t = value["temperature"]
        value["temperature"] = F.when(t > 500, F.round(t - 273.15, 1)).otherwise(t)
    j = num.join(papers.select(F.col("doi").alias("doc"), "topic"), "doc", "left")
    out = j.select("doc", "rec_key", "label", "topic",
                   first_rule(families(F.col("label")), "other").alias("family"),
                   F.coalesce(*[F.col(f"_{k}") for k in metric_keys]).alias("metric"),
                   *[v.alias(n) for n, v in value.items()])
    return out.filter(F.col("topic").eqNullSafe(topic) | F.col("metric").isNotNull())


def coverage_share(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, n, pct) of rows that pass each check; one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_t"),
                 *[F.count_if(c).alias(k) for k, c in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(k).alias("name"), F.col(k).alias("n"),
        (F.lit(100.0) * F.col(k) / F.greatest(F.col("_t"), F.lit(1))).alias("pct"))
        for k in checks])))


def first_per_bucket(df: DataFrame, x: str, y: str, dx: float = 10.0, dy: float = 5.0,
                     tie: list[str] | None = None) -> DataFrame:
    """One row per rounded (x, y) cell, highest y first."""
    b = df.withColumn("bx", F.round(F.col(x) / dx) * dx).withColumn(
        "by", F.round(F.col(y) / dy) * dy)
    return first_by(b, ["bx", "by"], [F.desc(y), *[F.col(t) for t in (tie or [])]])
