"""Queries of the figure tables (F, W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import figures as G
from recordloom.operators.ordering import with_position
from recordloom.plans.registry import query
from recordloom.plans.table_queries import _cells_sql, attributes
from recordloom.plans.views import sql, view
from recordloom.session import cut


def typed(spark, sf):
    return G.type_captions(view(spark, sf, "v_figs"))


_TYPED = """t AS (SELECT 'p' || CAST(p_partkey % 49 AS STRING) AS doc, 'fig' || CAST(p_partkey AS STRING) AS figure, p_name, p_partkey,
 CASE p_partkey % 4 WHEN 0 THEN 'structure_activity' WHEN 1 THEN 'characterization' WHEN 2 THEN 'activity' ELSE 'other' END AS type,
 CASE p_partkey % 4 WHEN 0 THEN 'line/scatter' WHEN 2 THEN 'bar' END AS shape FROM part)"""


@query("f1_caption_types", f"WITH {_TYPED} SELECT doc, figure, type, shape FROM t")
def _f1(spark, sf):
    return typed(spark, sf).select("doc", "figure", "type", "shape")


@query("f2_figure_inventory", f"""WITH {_TYPED} SELECT 'type' AS section, type AS name, count(*) AS n FROM t GROUP BY type UNION ALL SELECT 'shape', shape, count(*) FROM t WHERE shape IS NOT NULL GROUP BY shape
UNION ALL SELECT 'documents', 'with_activity', count(DISTINCT doc) FROM t WHERE shape IS NOT NULL""")
def _f2(spark, sf):
    return G.figure_inventory(typed(spark, sf))


_POOL = """, pool AS (SELECT 'p' || CAST(d AS STRING) AS doc, rec_key, string_agg(attr, ',' ORDER BY attr) AS props FROM won
 WHERE attr IN ('bet_surface_area', 'total_pore_volume', 'total_acidity') GROUP BY d, rec_key)"""


@query("f3_property_pool", _cells_sql(_POOL + "SELECT doc, rec_key, props FROM pool"))
def _f3(spark, sf):
    p = G.property_pool(attributes(spark, sf))
    return p.select("doc", "rec_key", F.array_join("props", ",").alias("props"))


_TRIAGE = _POOL + f""", {_TYPED},
lab AS (SELECT DISTINCT 'p' || CAST(k.d AS STRING) AS doc, k.rec_key, k.label FROM keyed k JOIN pool ON pool.doc = 'p' || CAST(k.d AS STRING) AND pool.rec_key = k.rec_key),
hit AS (SELECT DISTINCT t.doc, t.figure, lab.rec_key FROM t JOIN lab ON lab.doc = t.doc AND lab.label = t.p_name WHERE t.shape IS NOT NULL),
n AS (SELECT doc, figure, count(*) AS m FROM hit GROUP BY doc, figure),
pn AS (SELECT doc, count(*) AS k FROM pool GROUP BY doc),
tri AS (SELECT t.doc, t.figure, t.p_partkey, t.shape, coalesce(n.m, 0) AS n_matched, coalesce(pn.k, 0) AS n_pool, t.type = 'structure_activity' AS sc FROM t LEFT JOIN n ON n.doc = t.doc AND n.figure = t.figure
  LEFT JOIN pn ON pn.doc = t.doc WHERE t.shape IS NOT NULL),
tr AS (SELECT *, CASE WHEN n_matched >= 2 OR (sc AND n_matched >= 1) THEN 'A' WHEN n_matched = 1 OR (sc AND n_pool > 0) THEN 'B' ELSE 'C' END AS tier FROM tri)"""


@query("f4_triage", _cells_sql(_TRIAGE + """
, pr AS (SELECT doc, rec_key, unnest(string_split(props, ',')) AS prop FROM pool),
own AS (SELECT doc, figure, string_agg(prop, ',' ORDER BY prop) AS r FROM (SELECT DISTINCT hit.doc, hit.figure, pr.prop FROM hit JOIN pr ON pr.doc = hit.doc AND pr.rec_key = hit.rec_key) z GROUP BY doc, figure),
al AS (SELECT doc, string_agg(prop, ',' ORDER BY prop) AS r FROM (SELECT DISTINCT doc, prop FROM pr) z GROUP BY doc)
SELECT tr.doc, tr.figure, tier, n_matched, n_pool, n_matched > 0 OR sc AS evidenced, coalesce(own.r, al.r, '') AS reachable, CASE WHEN n_matched > 0 THEN 'matched' ELSE 'pool' END AS reach_scope
FROM tr LEFT JOIN own ON own.doc = tr.doc AND own.figure = tr.figure LEFT JOIN al ON al.doc = tr.doc"""))
def _f4(spark, sf):
    return _triage(spark, sf).select("doc", "figure", "tier", "n_matched", "n_pool", "evidenced",
                                     "reachable", "reach_scope")


def _triage(spark, sf, pool=None):
    return G.triage_figures(typed(spark, sf), pool or G.property_pool(attributes(spark, sf)))


def _routed(spark, sf, pool=None):
    t = _triage(spark, sf, pool)
    series = sql(spark, sf, """SELECT 'fig' || CAST(l_partkey AS STRING) AS figure, CAST(l_quantity AS INT) AS n_points FROM lineitem WHERE l_partkey % 3 <> 0""")
    census = sql(spark, sf, "SELECT 'fig' || CAST(p_partkey AS STRING) AS figure FROM part WHERE p_partkey % 10 = 0")
    return G.route_figures(t, G.real_traces(series), census)


_ROUTE = """, s AS (SELECT l_partkey, count(*) FILTER (WHERE CAST(l_quantity AS INT) >= 5) AS traces FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY l_partkey),
rt AS (SELECT tr.*, s.traces, CASE WHEN p_partkey % 10 = 0 THEN 'markerformer' WHEN shape = 'bar' THEN 'bar_reader' WHEN traces IS NULL THEN 'lineformer_not_swept'
 WHEN traces >= 3 THEN 'lineformer' ELSE 'review' END AS route FROM tr LEFT JOIN s ON s.l_partkey = tr.p_partkey)"""


@query("f5_route_figures", _cells_sql(_TRIAGE + _ROUTE + "SELECT figure, traces, route FROM rt"))
def _f5(spark, sf):
    return _routed(spark, sf).select("figure", "traces", "route")


@query("f6_triage_coverage", _cells_sql(_TRIAGE + _ROUTE + """
SELECT 'tier' AS section, tier AS name, count(*) AS n FROM rt GROUP BY tier UNION ALL SELECT 'route', route, count(*) FROM rt WHERE tier IN ('A', 'B') GROUP BY route
UNION ALL SELECT 'coverage', 'docs_without_pool', (SELECT count(DISTINCT doc) FROM t WHERE doc NOT IN (SELECT doc FROM pool))
UNION ALL SELECT 'coverage', 'capped_figures', (SELECT count(*) FROM rt WHERE n_pool = 0)"""))
def _f6(spark, sf):
    pool = cut(G.property_pool(attributes(spark, sf)))
    return G.triage_coverage(cut(_routed(spark, sf, pool)), typed(spark, sf), pool)


_IMG = """SELECT event_id AS figure, CASE WHEN event_id % 3 = 0 THEN 'chart' ELSE event_type END AS figure_kind, event_id % 2 = 0 AS is_performance, event_id % 5 = 0 AS has_disconnected_scatter,
 CASE WHEN event_id % 4 = 0 THEN 'activity' ELSE 'other' END AS caption_type, CASE WHEN event_id % 3 = 0 THEN 'line/scatter' ELSE 'bar' END AS caption_shape,
 CASE WHEN event_id % 13 = 0 THEN 'api' END AS error, user_id AS tokens_in, 10 AS tokens_out, event_id FROM events"""


@query("f7_compare_typing", f"""WITH i AS ({_IMG}), ok AS (SELECT * FROM i WHERE error IS NULL)
SELECT 'kind' AS section, figure_kind AS name, CAST(count(*) AS DOUBLE) AS n FROM ok GROUP BY figure_kind
UNION ALL SELECT 'geometry', 'bar', count(*) FROM ok UNION ALL SELECT 'geometry', 'line', count(*) FROM ok WHERE event_id % 2 = 0
UNION ALL SELECT 'fact', 'errors', count(*) FROM i WHERE error IS NOT NULL UNION ALL SELECT 'fact', 'performance', count(*) FROM ok WHERE is_performance
UNION ALL SELECT 'fact', 'disconnected_scatter', count(*) FROM ok WHERE has_disconnected_scatter
UNION ALL SELECT 'fact', 'caption_line_image_bar', count(*) FROM ok WHERE caption_shape = 'line/scatter' AND event_id % 2 = 1
UNION ALL SELECT 'fact', 'caption_performance_not_chart', count(*) FROM ok WHERE caption_type = 'activity' AND figure_kind <> 'chart'
UNION ALL SELECT 'fact', 'tokens_in', sum(tokens_in) FROM i UNION ALL SELECT 'fact', 'tokens_out', sum(tokens_out) FROM i
UNION ALL SELECT 'fact', 'cost', round(sum(tokens_in) * 1e-6 + sum(tokens_out) * 5e-6, 4) FROM i""")
def _f7(spark, sf):
    return G.compare_typing(_typed_images(spark, sf))


def _typed_images(spark, sf):
    i = sql(spark, sf, _IMG)
    return i.withColumn("panel_geometries", F.when(F.col("event_id") % 2 == 0, F.array(
        F.lit("bar"), F.lit("line"))).otherwise(F.array(F.lit("bar"))))


@query("f7_typing_accuracy", f"""WITH i AS ({_IMG}), j AS (SELECT *, error IS NULL AND figure_kind = 'chart' AS k, error IS NULL AND is_performance AS p, error IS NULL AND NOT has_disconnected_scatter AS s FROM i WHERE event_id % 7 = 0)
SELECT count(*) AS total, count(*) FILTER (WHERE k) AS kind_ok, count(*) FILTER (WHERE p) AS performance_ok, count(*) FILTER (WHERE s) AS scatter_ok, count(*) FILTER (WHERE k AND p AND s) AS all_ok FROM j""")
def _f7b(spark, sf):
    i = _typed_images(spark, sf)
    e = i.filter("event_id % 7 = 0").select("figure", F.lit("chart").alias("figure_kind"),
                                            F.lit(True).alias("is_performance"),
                                            F.lit(False).alias("has_disconnected_scatter"))
    return G.typing_accuracy(i, e)


_PTS = "SELECT user_id AS image, event_id % 3 AS panel, event_type AS series, event_id, CAST(event_id % 500 AS DOUBLE) AS px, value AS py FROM events"


@query("f8_calibrate_points", f"""WITH p AS ({_PTS}) SELECT event_id, CASE WHEN panel = 2 THEN px WHEN panel = 1 THEN round(pow(10, px / 100), 4) ELSE round((px - 100) / 20, 4) END AS x,
 CASE WHEN panel = 2 THEN py ELSE round(10 - py / 50, 4) END AS y, CASE WHEN panel = 2 THEN 'rejected' ELSE 'accepted' END AS status FROM p WHERE series <> 'error'""")
def _f8(spark, sf):
    p = sql(spark, sf, _PTS)
    ticks = p.select("image", "panel").distinct().filter("panel < 2").select(
        "image", "panel", F.inline(F.array(
            F.struct(F.lit("x").alias("axis"), F.when(F.col("panel") == 1, 0.0).otherwise(100.0)
                     .alias("p1"), F.when(F.col("panel") == 1, 1.0).otherwise(0.0).alias("v1"),
                     F.when(F.col("panel") == 1, 100.0).otherwise(300.0).alias("p2"),
                     F.lit(10.0).alias("v2"), (F.col("panel") == 1).alias("log")),
            F.struct(F.lit("y").alias("axis"), F.lit(0.0).alias("p1"), F.lit(10.0).alias("v1"),
                     F.lit(500.0).alias("p2"), F.lit(0.0).alias("v2"),
                     F.lit(False).alias("log")))))
    dropped = p.filter("series = 'error'").select("image", "panel", "series").distinct()
    return G.calibrate_points(p, ticks, dropped).select("event_id", "x", "y", "status")


_TICKS = """SELECT o_custkey AS image, CAST(o_orderkey % 2 AS INT) AS panel, 'x' AS axis, CAST(o_orderkey % 40 * 25 AS DOUBLE) AS px,
 CAST(o_orderkey % 40 * 5 + CASE WHEN o_orderkey % 17 = 0 THEN 300 ELSE 0 END AS DOUBLE) AS value, CAST(1000 AS DOUBLE) AS span, o_custkey % 3 = 0 AS fallback FROM orders"""


@query("f8b_fit_ticks", f"""WITH t AS (SELECT image, panel, axis, px, min(value) AS v, bool_or(fallback) AS fb FROM ({_TICKS}) x GROUP BY image, panel, axis, px),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY image, panel) AS n FROM t WINDOW w AS (PARTITION BY image, panel ORDER BY px)),
c AS (SELECT s.*, d FROM s, (SELECT unnest(range(0, 41)) AS d) q WHERE d = 0 OR (n >= 4 AND d <= n AND i <> d)),
g AS (SELECT *, (v - lag(v) OVER w) / (px - lag(px) OVER w) AS st FROM c WINDOW w AS (PARTITION BY image, panel, d ORDER BY px)),
f AS (SELECT image, panel, d, count(*) AS k, max(px) - min(px) AS reach, min(st) AS lo, max(st) AS hi, max(abs(st)) AS big, min(abs(st)) AS small, regr_slope(v, px) AS a, regr_intercept(v, px) AS b, any_value(fb) AS fb, any_value(n) AS n FROM g GROUP BY image, panel, d),
o AS (SELECT * FROM f WHERE k >= 2 AND n >= CASE WHEN fb THEN 3 ELSE 2 END AND reach >= 180 AND (lo > 0 OR hi < 0) AND (k < 3 OR big <= 1.6 * greatest(small, 1e-12)) AND abs(a) * 1000 <= 1e6 AND abs(b) <= 1e6),
r AS (SELECT *, row_number() OVER (PARTITION BY image, panel ORDER BY d) AS rn FROM o)
SELECT z.image, z.panel, 'x' AS axis, round(r.a, 4) AS slope, round(r.b, 4) + 0.0 AS offset, CAST(coalesce(r.k, 0) AS INT) AS ticks_used FROM (SELECT DISTINCT image, panel FROM t) z LEFT JOIN r ON r.image = z.image AND r.panel = z.panel AND rn = 1""")
def _f8b(spark, sf):
    return G.fit_ticks(sql(spark, sf, _TICKS))


@query("f8c_panel_confidence", """SELECT event_id AS panel, CASE WHEN event_id % 4 = 0 OR event_id % 5 = 0 OR event_id % 6 = 0 THEN 'low' WHEN event_id % 7 = 0 OR event_id % 4 < 3 OR event_id % 5 < 3 THEN 'medium' ELSE 'high' END AS confidence FROM events""")
def _f8c(spark, sf):
    return G.panel_confidence(_panels(spark, sf)).select("panel", "confidence")


def _panels(spark, sf):
    return sql(spark, sf, """SELECT user_id AS image, event_id AS panel, CAST(event_id % 4 AS INT) AS x_ticks, CAST(event_id % 5 AS INT) AS y_ticks, CAST(event_id % 6 AS INT) AS n_series, event_id % 7 = 0 AS colour_named FROM events""")


@query("f8c_image_confidence", """WITH c AS (SELECT user_id AS image, event_id % 5 > 2 AND event_id % 4 = 3 AND event_id % 6 > 0 AND event_id % 7 > 0 AS hi, event_id % 4 = 0 OR event_id % 5 = 0 OR event_id % 6 = 0 AS lo FROM events)
SELECT image, CASE WHEN bool_and(hi) THEN 'high' WHEN bool_and(lo) THEN 'low' ELSE 'medium' END AS confidence FROM c GROUP BY image""")
def _f8cb(spark, sf):
    return G.image_confidence(G.panel_confidence(_panels(spark, sf)))


_LINES = """SELECT user_id AS image, CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS line, event_id AS ord, CAST(event_id % 60 AS INT) AS x, value AS y FROM events"""


@query("f9_pair_errors", f"""WITH l AS ({_LINES}), g AS (SELECT image, line AS gold, x, arg_max(y, ord) AS gy FROM l GROUP BY image, line, x),
p AS (SELECT image, (line + 1) % 5 AS pred, x, arg_max(y + 0.25, ord) AS py FROM l WHERE ord % 7 <> 0 GROUP BY image, (line + 1) % 5, x),
n AS (SELECT image, gold, count(*) AS c FROM g GROUP BY image, gold)
SELECT g.image, g.gold, p.pred, round(count(*) * 1.0 / max(n.c), 4) AS overlap, round(CAST(sum(CAST(abs(gy - py) AS DECIMAL(18,6))) AS DOUBLE) / count(*), 4) AS mae FROM g JOIN p ON p.image = g.image AND p.x = g.x JOIN n ON n.image = g.image AND n.gold = g.gold GROUP BY g.image, g.gold, p.pred""")
def _f9(spark, sf):
    return G.pair_errors(*_two_readings(spark, sf))


def _two_readings(spark, sf):
    gold = sql(spark, sf, _LINES)
    pred = gold.filter("ord % 7 <> 0").withColumn("line", (F.col("line") + 1) % 5).withColumn(
        "y", F.col("y") + 0.25)
    return gold, pred


_MATCHED = f"""WITH RECURSIVE l AS ({_LINES}), g AS (SELECT image, line AS gold, x, arg_max(y, ord) AS gy FROM l GROUP BY image, line, x),
p AS (SELECT image, (line + 1) % 5 AS pred, x, arg_max(y + 0.25, ord) AS py FROM l WHERE ord % 7 <> 0 GROUP BY image, (line + 1) % 5, x),
n AS (SELECT image, gold, count(*) AS c FROM g GROUP BY image, gold),
e AS (SELECT g.image, g.gold, p.pred, count(*) * 1.0 / max(n.c) AS overlap, CAST(sum(CAST(abs(gy - py) AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mae FROM g JOIN p ON p.image = g.image AND p.x = g.x JOIN n ON n.image = g.image AND n.gold = g.gold GROUP BY g.image, g.gold, p.pred),
r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY mae, gold, pred) AS k FROM e),
w AS (SELECT image, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ug, CAST([] AS BIGINT[]) AS up, CAST(NULL AS BIGINT) AS gold, CAST(NULL AS BIGINT) AS pred, CAST(NULL AS DOUBLE) AS overlap, CAST(NULL AS DOUBLE) AS mae FROM (SELECT DISTINCT image FROM e) z
 UNION ALL SELECT w.image, r.k, CASE WHEN list_contains(w.ug, r.gold) OR list_contains(w.up, r.pred) THEN w.ug ELSE list_append(w.ug, CAST(r.gold AS BIGINT)) END,
  CASE WHEN list_contains(w.ug, r.gold) OR list_contains(w.up, r.pred) THEN w.up ELSE list_append(w.up, CAST(r.pred AS BIGINT)) END,
  CASE WHEN list_contains(w.ug, r.gold) OR list_contains(w.up, r.pred) THEN NULL ELSE CAST(r.gold AS BIGINT) END, CAST(r.pred AS BIGINT), CAST(r.overlap AS DOUBLE), CAST(r.mae AS DOUBLE) FROM w JOIN r ON r.image = w.image AND r.k = w.k + 1)
, won AS (SELECT image, gold, pred, overlap, mae FROM w WHERE gold IS NOT NULL),
ig AS (SELECT image, gold, row_number() OVER (PARTITION BY image ORDER BY gold) AS k FROM (SELECT DISTINCT image, gold FROM g) q WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.image = q.image AND won.gold = q.gold)),
ip AS (SELECT image, pred, row_number() OVER (PARTITION BY image ORDER BY pred) AS k FROM (SELECT DISTINCT image, pred FROM p) q WHERE NOT EXISTS (SELECT 1 FROM won WHERE won.image = q.image AND won.pred = q.pred))
"""


@query("f9_match_series", _MATCHED + """SELECT image, gold, pred, round(overlap, 4) AS overlap, round(mae, 4) AS mae FROM won
UNION ALL SELECT ig.image, ig.gold, ip.pred, 0.0, NULL FROM ig JOIN ip ON ip.image = ig.image AND ip.k = ig.k""")
def _f9b(spark, sf):
    return G.match_series(*_two_readings(spark, sf))


@query("f9_parity_summary", _MATCHED + """SELECT count(*) AS lines_paired, count(*) FILTER (WHERE overlap >= 0.5 AND mae <= 30.0) AS lines_tight,
 round(median(overlap), 4) AS median_overlap, round(median(mae), 4) AS median_mae FROM won WHERE mae IS NOT NULL""")
def _f9c(spark, sf):
    return G.parity_summary(G.match_series(*_two_readings(spark, sf)), 0.5, 30.0)


_CHART = """SELECT event_id, user_id AS image, CASE event_id % 4 WHEN 0 THEN 'Si/Al ratio' WHEN 1 THEN 'Temperature (C)' WHEN 2 THEN 'wave number' ELSE 'BET' END AS x_label,
 CASE WHEN event_id % 5 = 0 THEN 'Intensity' ELSE 'Conversion (%)' END AS y_label, event_type, value FROM events"""


def _chart_panels(spark, sf):
    return sql(spark, sf, _CHART).select(
        "event_id", "image", F.lit("d").alias("doc"), F.col("event_id").alias("panel"), "x_label",
        "y_label", F.lit("high").alias("confidence"), F.array(F.struct(
            F.col("event_type").alias("name"), F.array(
                F.struct(F.col("value").alias("x"), (F.col("value") * 2).alias("y")),
                F.struct(F.col("value").alias("x"), F.lit(None).cast("double").alias("y")))
            .alias("points"))).alias("series"))


@query("f10_structure_activity", f"""WITH c AS ({_CHART}) SELECT event_id AS panel, event_type AS catalyst, CASE WHEN event_id % 4 = 1 THEN 'condition' ELSE 'structure' END AS kind,
 CASE event_id % 4 WHEN 0 THEN 'si_al' WHEN 1 THEN x_label ELSE 'bet_area' END AS x_kind, value AS x, round(value * 2, 4) AS y FROM c WHERE event_id % 5 <> 0 AND event_id % 4 <> 2""")
def _f10(spark, sf):
    return G.structure_activity(_chart_panels(spark, sf)).select("panel", "catalyst", "kind",
                                                                 "x_kind", "x", "y")


@query("f10_skipped_panels", f"""WITH c AS ({_CHART}) SELECT CASE WHEN event_id % 5 = 0 THEN 'y_not_performance' ELSE 'x_unclassified' END AS reason, count(*) AS n FROM c
WHERE event_id % 5 = 0 OR event_id % 4 = 2 GROUP BY 1""")
def _f10b(spark, sf):
    return G.skipped_panels(_chart_panels(spark, sf))


@query("f11_parse_panels", """SELECT event_id, 'a' AS panel, CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'L' END AS x_label, CASE event_id % 4 WHEN 0 THEN '?' WHEN 1 THEN event_type END AS name,
 CASE event_id % 4 WHEN 0 THEN 2 ELSE 0 END AS n_points FROM events WHERE event_id % 7 <> 0""")
def _f11(spark, sf):
    e = view(spark, sf, "events")
    axis = F.when(F.col("event_id") % 3 == 0, '{"label":"T","min":1}').when(
        F.col("event_id") % 3 == 1, '[5,{"label":"L"}]').otherwise('"scalar"')
    series = F.when(F.col("event_id") % 4 == 0, F.concat(
        F.lit('[{"points":[{"x":1,"y":'), F.col("value").cast("string"),
        F.lit('},3,{"x":2,"y":null}]},"junk"]'))).when(F.col("event_id") % 4 == 1, F.concat(
            F.lit('[{"name":"'), "event_type", F.lit('","points":"none"}]'))).otherwise("{}")
    body = F.concat(F.lit('{"panels":[7,{"panel":"a","x_axis":'), axis, F.lit(',"series":'),
                    series, F.lit("}]}"))
    reply = F.when(F.col("event_id") % 7 == 0, '{"panels":"none"}').otherwise(body)
    p = G.parse_panels(e.select("event_id", reply.alias("reply")), "reply")
    return p.select("event_id", "panel", F.col("x_axis.label").alias("x_label"),
                    F.get("series", F.lit(0))["name"].alias("name"), "n_points")


_SER = """SELECT image, k * 4 + event_id % 3 AS x, y FROM (SELECT user_id AS image, event_id, CAST(floor(value) AS BIGINT) AS y,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) q"""


@query("w6_densify", f"""WITH s AS ({_SER}), n AS (SELECT *, lead(x) OVER (PARTITION BY image ORDER BY x) AS x2, lead(y) OVER (PARTITION BY image ORDER BY x) AS y2 FROM s),
d AS (SELECT image, x, y, x2, y2, unnest(generate_series(x, coalesce(x2 - 1, x))) AS xi FROM n)
SELECT image, xi AS x, CASE WHEN xi = x THEN y ELSE CAST(trunc(y + (xi - x) * (CAST(y2 - y AS DOUBLE) / (x2 - x))) AS BIGINT) END AS y FROM d""")
def _w6(spark, sf):
    e = view(spark, sf, "events").select(F.col("user_id").alias("image"), "event_id",
                                         F.floor("value").alias("y"))
    s = with_position(e, ["image"], ["event_id"])
    s = s.withColumn("x", (F.col("pos") + 1) * 4 + F.col("event_id") % 3)
    return G.densify_series(s, ["image"])
