"""Queries of the statistics operators (A), windows over points (W4) and models (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.base import first_rule
from recordloom.operators import modeling as M
from recordloom.operators import stats as A
from recordloom.operators.ordering import carry_forward
from recordloom.operators.quantiles import exact_median
from recordloom.plans.registry import query
from recordloom.plans.views import sql, view

FRAME = """
SELECT l_quantity AS f1, l_quantity + l_discount * 100 AS f2,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice / 1000 + l_quantity END AS f3,
       CAST(p_size AS DOUBLE) AS f4, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE NULL END AS f5,
       CASE WHEN l_tax > 0.02 THEN l_tax * 100 - l_discount * 50 ELSE NULL END AS f6
FROM lineitem JOIN part ON l_partkey = p_partkey"""
FRAME_COLS = ["f1", "f2", "f3", "f4", "f5", "f6"]


def units(spark, sf):
    return view(spark, sf, "v_units")


_pairs = "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r, min({a}) AS la, max({a}) AS ha, min({b}) AS lb, max({b}) AS hb"
    f" FROM fr WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for i, a in enumerate(FRAME_COLS) for b in FRAME_COLS[i + 1:])


@query("a3_pairwise_corr", f"""WITH fr AS ({FRAME}), pr AS ({_pairs})
SELECT a, b, n, round(r, 4) AS r FROM pr WHERE n >= 15 AND la < ha AND lb < hb AND abs(r) >= 0.05""")
def _a3(spark, sf):
    return A.pairwise_corr(sql(spark, sf, FRAME), FRAME_COLS, min_abs=0.05)


@query("a4_stratified_corr", """WITH u AS (SELECT * FROM v_units),
g AS (SELECT 'pooled' AS stratum, 'all' AS name, count(*) AS n, corr(pressure_mpa, metric) AS r FROM u WHERE metric IS NOT NULL AND pressure_mpa IS NOT NULL
  UNION ALL SELECT 'source_doi', source_doi, count(*), corr(pressure_mpa, metric) FROM u WHERE metric IS NOT NULL AND pressure_mpa IS NOT NULL GROUP BY source_doi
  UNION ALL SELECT 'metal', metal, count(*), corr(pressure_mpa, metric) FROM u WHERE metric IS NOT NULL AND pressure_mpa IS NOT NULL GROUP BY metal)
SELECT stratum, name, n, CASE WHEN n >= 5 THEN round(r, 2) END AS r FROM g WHERE n >= 8 OR stratum <> 'metal'""")
def _a4(spark, sf):
    return A.stratified_corr(units(spark, sf), "pressure_mpa", "metric",
                             {"source_doi": 0, "metal": 8})


@query("a5_trend", """WITH u AS (SELECT * FROM v_units WHERE metric IS NOT NULL AND pressure_mpa IS NOT NULL)
SELECT 'all' AS name, count(*) AS n, round(regr_slope(metric, pressure_mpa), 4) AS slope, round(regr_intercept(metric, pressure_mpa), 4) AS intercept FROM u
UNION ALL SELECT metal, count(*), round(regr_slope(metric, pressure_mpa), 4), round(regr_intercept(metric, pressure_mpa), 4) FROM u GROUP BY metal
HAVING count(*) >= 8 AND count(DISTINCT pressure_mpa) >= 3 AND max(pressure_mpa) - min(pressure_mpa) >= 1""")
def _a5(spark, sf):
    return A.trend(units(spark, sf), "pressure_mpa", "metric", "metal")


T_BINS = ([200.0, 300.0, 350.0, 400.0, 700.0], ["200-300", "300-350", "350-400", ">400"])
P_BINS = ([0.0, 1.0, 3.0, 6.0, 9.0], ["<=1", "1-3", "3-6", "6-9"])
_TB = """CASE WHEN temperature_c > 200 AND temperature_c <= 300 THEN '200-300' WHEN temperature_c > 300 AND temperature_c <= 350 THEN '300-350'
      WHEN temperature_c > 350 AND temperature_c <= 400 THEN '350-400' WHEN temperature_c > 400 AND temperature_c <= 700 THEN '>400' END"""
_PB = """CASE WHEN pressure_mpa > 0 AND pressure_mpa <= 1 THEN '<=1' WHEN pressure_mpa > 1 AND pressure_mpa <= 3 THEN '1-3'
      WHEN pressure_mpa > 3 AND pressure_mpa <= 6 THEN '3-6' WHEN pressure_mpa > 6 AND pressure_mpa <= 9 THEN '6-9' END"""


@query("a6_binned_pivot", f"""WITH u AS (SELECT {_TB} AS x_bin, {_PB} AS y_bin, metric FROM v_units),
sp AS (SELECT x_bin, y_bin FROM (VALUES ('200-300'), ('300-350'), ('350-400'), ('>400')) a(x_bin)
       JOIN (VALUES ('<=1'), ('1-3'), ('3-6'), ('6-9')) b(y_bin) ON true)
SELECT sp.x_bin, sp.y_bin, round(avg(metric), 4) AS mean, count(metric) AS n FROM sp LEFT JOIN u ON u.x_bin = sp.x_bin AND u.y_bin = sp.y_bin
GROUP BY sp.x_bin, sp.y_bin""")
def _a6(spark, sf):
    return A.binned_pivot(units(spark, sf), "temperature_c", "pressure_mpa", "metric",
                          T_BINS, P_BINS)


@query("a7_category_bin_median", f"""WITH u AS (SELECT metal AS category, {_TB} AS bin, metric FROM v_units),
s AS (SELECT category, count(*) AS category_n FROM u GROUP BY category)
SELECT u.category, u.bin, count(metric) AS n, round(median(metric), 4) AS median, s.category_n FROM u JOIN s ON u.category = s.category
WHERE u.bin IS NOT NULL GROUP BY u.category, u.bin, s.category_n""")
def _a7(spark, sf):
    return A.category_bin_median(units(spark, sf), "metal", "temperature_c", "metric", T_BINS)


@query("a8_group_summary", """SELECT source_doi, count(metric) AS n, round(avg(metric), 4) AS mean, max(metric) AS max,
 round(avg(temperature_c), 4) AS other_mean, round(median(metric), 4) AS median FROM v_units GROUP BY source_doi""")
def _a8(spark, sf):
    return A.group_summary(units(spark, sf), "source_doi", "metric", "temperature_c")


@query("a8_describe_groups", """SELECT metal, count(metric) AS count, round(avg(metric), 4) AS mean, round(stddev_samp(metric), 4) AS std,
 min(metric) AS min, max(metric) AS max FROM v_units GROUP BY metal""")
def _a8b(spark, sf):
    return A.describe_groups(units(spark, sf), "metal", "metric")


@query("a9_top_groups", """SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name ORDER BY n DESC, p_name LIMIT 12""")
def _a9(spark, sf):
    return A.top_groups(view(spark, sf, "part"), "p_name", 12)


@query("a9_top_groups_by_max", """SELECT p_name, max(p_retailprice) AS max, round(avg(p_retailprice), 4) AS mean, count(p_retailprice) AS n
FROM part GROUP BY p_name ORDER BY max DESC, p_name LIMIT 15""")
def _a9b(spark, sf):
    return A.top_groups_by_max(view(spark, sf, "part"), "p_name", "p_retailprice", 15)


@query("a10_crosstab", """SELECT metal, count(*) FILTER (WHERE support = 'F') AS "F", count(*) FILTER (WHERE support = 'O') AS "O"
FROM v_units WHERE metal IS NOT NULL AND support IS NOT NULL GROUP BY metal""")
def _a10(spark, sf):
    return A.crosstab(units(spark, sf), "metal", "support", ["F", "O"])


@query("a10_shares", """SELECT metal, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM v_units WHERE metal IS NOT NULL), 4) AS share
FROM v_units WHERE metal IS NOT NULL GROUP BY metal""")
def _a10b(spark, sf):
    return A.shares(units(spark, sf), "metal")


_PM = """WITH c AS (SELECT metal, support, avg(metric) AS mean, count(metric) AS n FROM v_units GROUP BY metal, support HAVING count(metric) > 0)
SELECT c.metal, c.support, round(c.mean, 4) AS mean, c.n, round(r.row_mean, 4) AS row_mean FROM c JOIN (SELECT metal, avg(mean) AS row_mean FROM c GROUP BY metal) r ON r.metal = c.metal"""


@query("a11_pivot_mean_count", _PM)
def _a11(spark, sf):
    return A.pivot_mean_count(units(spark, sf), "metal", "support", "metric")


@query("m3_family_heatmap", _PM.replace("metal", "p_name").replace("support", "p_type").replace("metric", "p_size").replace("v_units", "part"))
def _m3(spark, sf):
    return M.family_heatmap(view(spark, sf, "part"), "p_name", "p_type", "p_size")


_CELLS = "c AS (SELECT l_returnflag || CAST(l_partkey % 40 AS STRING) AS rw, l_suppkey AS cl, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query("a12_support_filter", f"""WITH {_CELLS},
r AS (SELECT rw FROM c GROUP BY rw HAVING sum(n) >= 500), k AS (SELECT cl FROM c GROUP BY cl HAVING sum(n) >= 500)
SELECT c.* FROM c WHERE rw IN (SELECT rw FROM r) AND cl IN (SELECT cl FROM k)""")
def _a12(spark, sf):
    return A.support_filter(sql(spark, sf, f"WITH {_CELLS} SELECT * FROM c"), "rw", "cl", 500)


@query("a12_support_filter_sequential", """WITH a AS (SELECT * FROM part WHERE p_size IN (SELECT p_size FROM part GROUP BY p_size HAVING count(*) >= 15)),
b AS (SELECT * FROM a WHERE p_name IN (SELECT p_name FROM a GROUP BY p_name HAVING count(*) >= 15))
SELECT p_partkey, p_name, p_size FROM b""")
def _a12b(spark, sf):
    return A.support_filter_sequential(view(spark, sf, "part"), "p_size", "p_name",
                                       15).select(
        "p_partkey", "p_name", "p_size")


@query("a13_collapse_rare", """WITH t AS (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 8)
SELECT CASE WHEN p_name IN (SELECT p_name FROM t) THEN p_name ELSE 'Other' END AS collapsed, count(*) AS n FROM part GROUP BY 1""")
def _a13(spark, sf):
    c = A.collapse_rare(view(spark, sf, "part"), "p_name", 8)
    return c.groupBy("collapsed").agg(F.count(F.lit(1)).alias("n"))


@query("a14_histogram_by", """SELECT metal, CAST(least(floor(metric / 5), 19) AS INT) AS bin, count(*) AS n FROM v_units WHERE metric BETWEEN 0 AND 100 GROUP BY 1, 2""")
def _a14(spark, sf):
    return A.histogram_by(units(spark, sf), "metric", "metal")


@query("a14_overall_median", "SELECT round(median(l_extendedprice), 4) AS median FROM lineitem")
def _a14b(spark, sf):
    return exact_median(view(spark, sf, "lineitem"), [], "l_extendedprice")


@query("a15_order_by_median", """SELECT p_name, count(l_extendedprice) AS n, round(median(l_extendedprice), 4) AS median
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""")
def _a15(spark, sf):
    d = sql(spark, sf, "SELECT p_name, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey")
    return A.order_by_median(d, "p_name", "l_extendedprice")


_LABELS = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Fe2O3/' WHEN 1 THEN 'ZnZrOx ' WHEN 2 THEN 'ZnCr ' WHEN 3 THEN 'In2O3 '
 WHEN 4 THEN 'Ga-ZSM' WHEN 5 THEN 'Cu/ZnO ' WHEN 6 THEN 'Zn/ZSM-5' WHEN 7 THEN 'Pd/CeO2' ELSE '' END || CAST(p_size AS STRING) AS label,
 CASE p_partkey % 5 WHEN 0 THEN 'Zn' WHEN 1 THEN 'Mo' WHEN 2 THEN '' WHEN 3 THEN 'Rh' ELSE NULL END AS metal,
 CASE WHEN p_partkey % 2 = 0 THEN 'P' ELSE NULL END AS promoter,
 CASE p_partkey % 3 WHEN 0 THEN 'SAPO-34' WHEN 1 THEN 'H-ZSM-5' ELSE NULL END AS zeolite FROM part"""


@query("a16_families", f"""WITH l AS ({_LABELS}) SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Fe-based' WHEN 1 THEN 'ZnZrOx' WHEN 2 THEN 'ZnCrOx'
 WHEN 3 THEN 'InOx/InZr' WHEN 4 THEN 'Ga-based' WHEN 5 THEN 'Cu-based' WHEN 6 THEN 'Zn-based' ELSE 'other' END AS family FROM l""")
def _a16(spark, sf):
    d = sql(spark, sf, _LABELS)
    return d.select("p_partkey", first_rule(A.families(F.col("label")), "other").alias("family"))


@query("a16_metal_groups", f"""WITH l AS ({_LABELS}) SELECT p_partkey, CASE WHEN p_partkey % 9 = 4 THEN 'Ga/ZSM-5'
 WHEN metal = 'Zn' AND promoter = 'P' THEN 'Zn+P/ZSM-5' WHEN metal = 'Zn' THEN 'Zn/ZSM-5' WHEN metal = 'Mo' THEN 'Mo/ZSM-5'
 WHEN metal = 'Rh' THEN 'RH/zeolite' WHEN promoter IS NULL AND zeolite = 'H-ZSM-5' THEN 'H-ZSM-5' WHEN promoter IS NULL AND zeolite = 'SAPO-34' THEN 'SAPO'
 WHEN promoter IS NULL THEN 'H-form zeolite' ELSE 'Other' END AS grp FROM l""")
def _a16b(spark, sf):
    d = sql(spark, sf, _LABELS)
    return d.select("p_partkey", A.metal_groups(
        F.col("metal"), F.col("promoter"), F.col("label"), F.col("zeolite"),
        F.lit(None).cast("string")).alias("grp"))


@query("a16_components", f"""WITH l AS ({_LABELS}) SELECT p_partkey,
 CASE WHEN zeolite = 'H-ZSM-5' THEN 'ZSM-5' WHEN zeolite = 'SAPO-34' THEN 'SAPO-34' ELSE 'No zeolite' END AS acid,
 CASE WHEN p_partkey % 9 = 3 THEN 'In₂O₃' WHEN p_partkey % 9 = 2 THEN 'ZnCrOx' WHEN p_partkey % 9 = 1 THEN 'ZnO-ZrO₂'
  WHEN p_partkey % 9 = 5 THEN 'Cu' WHEN p_partkey % 9 = 0 THEN 'Fe' WHEN p_partkey % 9 = 7 THEN 'Pd' WHEN metal = 'Zn' THEN 'ZnO' WHEN metal = 'Rh' THEN 'Rh' ELSE 'Other/Unknown' END AS oxide FROM l
""")
def _a16c(spark, sf):
    d = sql(spark, sf, _LABELS)
    none = F.lit(None).cast("string")
    return d.select("p_partkey", A.acid_component(F.col("label"), F.col("zeolite"), none)
                    .alias("acid"), A.oxide_component(F.col("label"), F.col("metal"), none)
                    .alias("oxide"))


@query("a16_zeolite_and_support_labels", f"""WITH l AS ({_LABELS}) SELECT p_partkey,
 CASE WHEN zeolite = 'SAPO-34' THEN 'SAPO-34' WHEN zeolite = 'H-ZSM-5' THEN 'ZSM-5' WHEN p_partkey % 9 = 6 THEN 'ZSM-5' ELSE trim(label) END AS zeo,
 CASE WHEN p_partkey % 2 = 0 AND zeolite IS NULL THEN 'No support' WHEN p_partkey % 2 = 1 THEN 'Al₂O₃' WHEN zeolite = 'SAPO-34' THEN 'SAPO-34' ELSE 'ZSM-5' END AS sup FROM l""")
def _a16d(spark, sf):
    d = sql(spark, sf, _LABELS)
    sup = F.when(F.col("p_partkey") % 2 == 1, "g-Al2O3")
    return d.select("p_partkey", A.zeolite_label(F.col("zeolite"), F.col("label")).alias("zeo"),
                    A.support_label(sup, F.col("zeolite")).alias("sup"))


@query("a17_pick_first_key", """SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS v FROM events""")
def _a17(spark, sf):
    e = view(spark, sf, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", A.pick_first_key(m, ["missing", "k", "other"]).alias("v"))


@query("a18_valid_mean", """SELECT metal, p.product, round(avg(p.v), 4) AS mean, count(*) AS n FROM (
 SELECT metal, 'metric' AS product, metric AS v FROM v_units UNION ALL SELECT metal, 'pressure_mpa', pressure_mpa FROM v_units) p
WHERE v > 0 AND v <= 60 GROUP BY metal, p.product""")
def _a18(spark, sf):
    return A.valid_mean(units(spark, sf), "metal", ["metric", "pressure_mpa"], 0.0, 60.0)


@query("a19_argmax_row", """SELECT * FROM v_units WHERE metric IS NOT NULL ORDER BY metric DESC, unit_id LIMIT 1""")
def _a19(spark, sf):
    return A.argmax_row(units(spark, sf), "metric", ["unit_id"])


@query("a21_coverage_share", """SELECT 'with_abstract' AS name, count(abstract) AS n, round(100.0 * count(abstract) / count(*), 4) AS pct FROM v_candidates
UNION ALL SELECT 'open_access', count(*) FILTER (WHERE is_open_access), round(100.0 * count(*) FILTER (WHERE is_open_access) / count(*), 4) FROM v_candidates
UNION ALL SELECT 'not_found', count(*) FILTER (WHERE oa_url IS NULL), round(100.0 * count(*) FILTER (WHERE oa_url IS NULL) / count(*), 4) FROM v_candidates""")
def _a21(spark, sf):
    return A.coverage_share(view(spark, sf, "v_candidates"), {
        "with_abstract": F.col("abstract").isNotNull(), "open_access": F.col("is_open_access"),
        "not_found": F.col("oa_url").isNull()})


@query("w4_first_per_bucket", """SELECT bx, "by", unit_id, temperature_c, metric FROM (SELECT *, round(temperature_c / 10) * 10 AS bx, round(metric / 5) * 5 AS "by",
 row_number() OVER (PARTITION BY round(temperature_c / 10) * 10, round(metric / 5) * 5 ORDER BY metric DESC, unit_id) AS rn
 FROM v_units WHERE metric IS NOT NULL AND temperature_c IS NOT NULL) q WHERE rn = 1""")
def _w4(spark, sf):
    u = units(spark, sf).filter("metric is not null and temperature_c is not null")
    return A.first_per_bucket(u, "temperature_c", "metric", tie=["unit_id"]).select(
        "bx", "by", "unit_id", "temperature_c", "metric")


@query("w2_carry_forward_events", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def _w2e(spark, sf):
    e = view(spark, sf, "events").withColumn("v", F.when(F.col("event_type") == "purchase",
                                                         F.col("value")))
    return carry_forward(e, ["user_id"], ["event_id"], "v", "last_purchase").select(
        "event_id", "user_id", "last_purchase")


@query("m1_gap_candidates", """WITH d AS (SELECT p_name, p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2, 3)
SELECT a.p_name, b.p_type, c.p_brand, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_type FROM part) b ON true
 JOIN (SELECT DISTINCT p_brand FROM part) c ON true LEFT JOIN d ON d.p_name = a.p_name AND d.p_type = b.p_type AND d.p_brand = c.p_brand
WHERE coalesce(d.n, 0) <= 1""")
def _m1(spark, sf):
    return M.gap_candidates(view(spark, sf, "part"), ["p_name", "p_type", "p_brand"], 1)


_OPEN = """SELECT DISTINCT p_type, p_brand, CAST(NULL AS INTEGER) AS p_size, 2 AS depth FROM (SELECT DISTINCT p_type FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON true
 WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_type = a.p_type AND p.p_brand = b.p_brand)
UNION ALL SELECT a.p_type, a.p_brand, CAST(c.p_size AS INTEGER), 3 FROM (SELECT DISTINCT p_type, p_brand FROM part) a JOIN (SELECT DISTINCT p_size FROM part) c ON true
 WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_type = a.p_type AND p.p_brand = a.p_brand AND p.p_size = c.p_size)"""


@query("m1_open_gaps", _OPEN)
def _m1b(spark, sf):
    return M.open_gaps(view(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("int")), ["p_type", "p_brand", "p_size"])


@query("m2_pareto_front", """WITH b AS (SELECT l_extendedprice AS x, max(l_quantity) AS y FROM lineitem GROUP BY 1),
f AS (SELECT x, y, max(y) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b)
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem JOIN f ON l_extendedprice = f.x AND l_quantity = f.y WHERE above IS NULL OR f.y > above""")
def _m2(spark, sf):
    return M.pareto_front(view(spark, sf, "lineitem"), "l_extendedprice", "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


_THREE = "SELECT o_orderkey, o_totalprice AS a, o_custkey % 97 AS b, o_orderkey % 89 AS c FROM orders"


@query("m2_skyline", f"""WITH o AS ({_THREE}) SELECT o_orderkey, a, b, c FROM o WHERE NOT EXISTS (
 SELECT 1 FROM o q WHERE q.a >= o.a AND q.b >= o.b AND q.c >= o.c AND (q.a > o.a OR q.b > o.b OR q.c > o.c))""")
def _m2b(spark, sf):
    return M.skyline(sql(spark, sf, _THREE), ["a", "b", "c"]).select("o_orderkey", "a", "b", "c")


def _features(spark, sf):
    d = sql(spark, sf, """SELECT l_orderkey AS id, l_returnflag AS metal, l_linestatus AS support, l_quantity AS q, l_tax AS tax,
        l_extendedprice / 1000 AS y FROM lineitem""")
    return M.feature_matrix_ml(d, ["metal", "support"], ["q", "tax"], "y")


@query("m4_feature_matrix", """SELECT l_returnflag AS metal, l_linestatus AS support, count(*) AS n, CAST(2 AS BIGINT) AS ones, round(sum(l_quantity), 4) AS sum_q
FROM lineitem GROUP BY 1, 2""")
def _m4(spark, sf):
    from pyspark.ml.functions import vector_to_array
    m, _ = _features(spark, sf)
    v = vector_to_array("features")
    hot = F.aggregate(F.slice(v, 1, F.size(v) - 2), F.lit(0.0), lambda a, x: a + x)
    return m.select("metal", "support", hot.cast("long").alias("ones"), F.element_at(v, -2)
                    .alias("q")).groupBy("metal", "support").agg(
        F.count(F.lit(1)).alias("n"), F.max("ones").alias("ones"), F.sum("q").alias("sum_q"))


@query("m5_fit_forest", "SELECT count(*) AS n, true AS in_range, true AS better FROM lineitem")
def _m5(spark, sf):
    m, _ = _features(spark, sf)
    model, score = M.fit_forest(m, "y", folds=2, trees=5, depth=4)
    # means of labels stay in their range, and beat the overall mean
    error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)))
    return model.transform(m).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.min("prediction") >= F.min("y")) & (F.max("prediction") <= F.max("y"))).alias("in_range"),
        ((error <= F.stddev_pop("y")) & (F.lit(float(score)) > 0)).alias("better"))


@query("m6_rank_unseen", """WITH d AS (SELECT p_name AS metal, p_type AS support, count(*) AS n FROM part GROUP BY 1, 2)
SELECT a.metal, b.support, true AS in_range FROM (SELECT DISTINCT metal FROM d) a JOIN (SELECT DISTINCT support FROM d) b ON true
 LEFT JOIN d ON d.metal = a.metal AND d.support = b.support WHERE coalesce(d.n, 0) <= 5""")
def _m6(spark, sf):
    d = sql(spark, sf, """SELECT p_name AS metal, p_type AS support, CAST(p_size AS DOUBLE) AS q, p_retailprice AS tax,
        p_retailprice + p_size AS y FROM part""")
    m, enc = M.feature_matrix_ml(d, ["metal", "support"], ["q", "tax"], "y")
    gaps = M.gap_candidates(d, ["metal", "support"], 5)
    ranked = M.rank_unseen(gaps.drop("n"), enc, m, "y", ["metal", "support"],
                           {"q": 25.0, "tax": 1000.0}, models=3)
    low, high = d.agg(F.min("y"), F.max("y")).first()
    return ranked.select("metal", "support", (F.col("prediction").between(low, high)
                                              & (F.col("spread") >= 0)).alias("in_range"))


@query("m8_curve_metrics", """SELECT image, series, count(*) AS n, arg_min(py, pt) AS y_first, arg_max(py, pt) AS y_last, round(regr_slope(py, pt), 4) AS slope,
 round(arg_min(py, pt) - arg_max(py, pt), 4) AS "drop" FROM v_points GROUP BY image, series""")
def _m8(spark, sf):
    return M.curve_metrics(view(spark, sf, "v_points"), ["image", "series"], "pt", "py")


@query("m8_product_shares", """WITH b AS (SELECT image, series, sum(py) AS total FROM v_points GROUP BY image, series)
SELECT b.image, b.series, round(total, 4) AS total, round(total / w, 4) AS share FROM b JOIN (SELECT image, sum(total) AS w FROM b GROUP BY image) x ON x.image = b.image""")
def _m8b(spark, sf):
    return M.product_shares(view(spark, sf, "v_points"), ["image"], "py")
