"""Queries over table rows: K and R operators, density and joinability."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.attributes import AttributeLibrary
from recordloom.functions.vocabulary import FEATURE_GROUPS
from recordloom.operators import records as R
from recordloom.operators import stats as A
from recordloom.operators import tables as K
from recordloom.plans.registry import query
from recordloom.plans.views import sql, view
from recordloom.session import cut

LIB = AttributeLibrary()
FEATURES = ["temperature_c", "pressure", "conversion_pct", "selectivity_pct", "bet_surface_area",
            "total_pore_volume", "total_acidity", "strong_acidity", "si_al_ratio"]
FEATURE_LIST = ", ".join(f"'{f}'" for f in FEATURES)


def table_rows(spark, sf):
    return view(spark, sf, "v_table_rows").withColumnRenamed("source_doi", "doc")


def cells(spark, sf):
    return K.melt_tables(table_rows(spark, sf), LIB)


def attributes(spark, sf):
    return R.record_attributes(cells(spark, sf))


# The oracle spells the five table shapes out: what each header means, read row by row.
CELLS = """
src AS (SELECT p_partkey AS k, p_partkey % 49 AS d, p_partkey % 5 AS t, p_name AS nm, p_size AS z FROM part),
tab AS (SELECT d, t, min(k) AS tord, count(*) AS n FROM src GROUP BY d, t),
r AS (SELECT src.*, tab.tord, tab.n AS tn,
      CASE WHEN src.t = 4 THEN CASE src.k % 20 WHEN 4 THEN 'BET surface area (m2/g)' WHEN 9 THEN 'Pore volume'
           WHEN 14 THEN 'Total acidity' ELSE 'Selectivity (%)' END ELSE nm END AS lab
      FROM src JOIN tab ON src.d = tab.d AND src.t = tab.t WHERE src.t <> 3),
cells AS (
 SELECT d, tord, k, t, tn, lab AS label, -1 AS col, CAST(NULL AS STRING) AS attr, CAST(NULL AS STRING) AS unit, CAST(NULL AS DOUBLE) AS num, CAST(NULL AS DOUBLE) AS raw_num, false AS mapped
 FROM r WHERE NOT (t = 4 AND tn >= 3)
 UNION ALL SELECT d, tord, k, t, tn, lab, 0, 'entry', NULL, CAST(k AS DOUBLE), NULL, false FROM r WHERE t = 0
 UNION ALL SELECT d, tord, k, t, tn, lab, 2, 'bet_surface_area', 'm2/g', CAST(z * 11 AS DOUBLE), NULL, true FROM r WHERE t = 0
 UNION ALL SELECT d, tord, k, t, tn, lab, 3, 'total_pore_volume', 'cm3/g', CAST('0.' || CAST(z AS STRING) AS DOUBLE), NULL, true FROM r WHERE t = 0 AND z % 5 <> 0
 UNION ALL SELECT d, tord, k, t, tn, lab, 1, 'temperature_c', '°C', ROUND(573 + z - 273.15, 1), 573.0 + z, true FROM r WHERE t = 1
 UNION ALL SELECT d, tord, k, t, tn, lab, 2, 'conversion_pct', '%', CASE WHEN z % 7 = 0 THEN z + 5.0 ELSE CAST(z AS DOUBLE) END, NULL, true FROM r WHERE t = 1
 UNION ALL SELECT d, tord, k, t, tn, lab, 1, 'total_acidity', 'umol/g', z * 1000.0, CAST(z AS DOUBLE), true FROM r WHERE t = 2
 UNION ALL SELECT d, tord, k, t, tn, lab, 1, 'small_ring', NULL, CAST(z AS DOUBLE), NULL, false FROM r WHERE t = 4 AND tn < 3
 UNION ALL SELECT d, tord, k, t, tn, lab, 2, 'red_widget', NULL, z + 1.0, NULL, false FROM r WHERE t = 4 AND tn < 3
 UNION ALL SELECT d, tord, k, t, tn, c.w, c.j,
        CASE k % 20 WHEN 4 THEN 'bet_surface_area' WHEN 9 THEN 'total_pore_volume' WHEN 14 THEN 'total_acidity' ELSE 'selectivity_pct' END,
        CASE k % 20 WHEN 4 THEN 'm2/g' WHEN 9 THEN NULL WHEN 14 THEN NULL ELSE '%' END, CAST(z + c.j - 1 AS DOUBLE), NULL, true
        FROM r JOIN (SELECT 'small ring' AS w, 1 AS j UNION ALL SELECT 'red widget', 2) c ON true WHERE t = 4 AND tn >= 3),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(label), '[ \\-_/()\\[\\].,;:]+', '', 'g'), 'x^', '') AS rec_key FROM cells),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, rec_key, attr ORDER BY tord, k, col) AS rn FROM keyed WHERE attr IS NOT NULL) y WHERE rn = 1),
recs AS (SELECT d, rec_key, max(label) AS label FROM keyed GROUP BY d, rec_key)
"""


def _cells_sql(body: str) -> str:
    return "WITH " + CELLS.strip() + "\n" + body


@query("k1_group_tables", """
SELECT 'p' || CAST(p_partkey % 49 AS STRING) AS doc,
       CASE p_partkey % 5 WHEN 0 THEN 'Textural properties' WHEN 1 THEN 'Catalytic performance' WHEN 2 THEN 'Acid properties'
            WHEN 3 THEN 'Untitled' ELSE 'Summary' END AS caption,
       count(*) AS n_rows, min(p_partkey) AS first_row,
       min(CASE p_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 4 ELSE 3 END) AS n_headers
FROM part GROUP BY 1, 2""")
def _k1(spark, sf):
    g = K.group_tables(table_rows(spark, sf))
    return g.groupBy("table_key").agg(
        F.min("doc").alias("doc"), F.min("caption").alias("caption"),
        F.count(F.lit(1)).alias("n_rows"), F.min("row_ord").alias("first_row"),
        F.min(F.size("headers")).alias("n_headers")).drop("table_key")


@query("k2_headerless", """
SELECT row_id, CASE WHEN row_ord % 5 = 3 THEN true ELSE false END AS headerless FROM v_table_rows""")
def _k2(spark, sf):
    g = K.group_tables(table_rows(spark, sf))
    return g.select("row_id", K.is_headerless(F.col("headers")).alias("headerless"))


def _profile(spark, sf):
    keyed = K.find_key_columns(K.group_tables(table_rows(spark, sf)), LIB)
    return K.table_profile(keyed, LIB)


@query("k3_table_type", """
SELECT 'p' || CAST(p_partkey % 49 AS STRING) AS doc, CASE p_partkey % 5 WHEN 0 THEN 'textural' WHEN 1 THEN 'performance'
       WHEN 2 THEN 'acidity' ELSE 'other' END AS table_type, min(p_partkey) AS table_ord
FROM part GROUP BY p_partkey % 49, p_partkey % 5""")
def _k3(spark, sf):
    g = K.group_tables(table_rows(spark, sf))
    t = g.groupBy("table_key").agg(F.min("doc").alias("doc"), F.min("caption").alias("caption"),
                                   F.min("headers").alias("headers"),
                                   F.min("row_ord").alias("table_ord"))
    return t.select("doc", K.classify_table(F.col("caption"), F.col("headers"),
                                            LIB.table_types).alias("table_type"), "table_ord")


@query("k4_key_column", """
SELECT 'p' || CAST(p_partkey % 49 AS STRING) AS doc, min(p_partkey) AS table_ord,
       CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE 0 END AS key_col
FROM part GROUP BY p_partkey % 49, p_partkey % 5""")
def _k4(spark, sf):
    return _profile(spark, sf).select("doc", "table_ord", "key_col")


@query("k5_header_mapping", """
SELECT DISTINCT h.header, h.attr, h.unit, h.mapped FROM part JOIN (
  SELECT 0 AS t, 'Entry' AS header, 'entry' AS attr, CAST(NULL AS STRING) AS unit, false AS mapped
  UNION ALL SELECT 0, 'Sample', 'sample', NULL, false
  UNION ALL SELECT 0, 'S_BET [m2/g]', 'bet_surface_area', 'm2/g', true
  UNION ALL SELECT 0, 'Pore volume [cm3/g]', 'total_pore_volume', 'cm3/g', true
  UNION ALL SELECT 1, 'Catalyst', 'catalyst', NULL, false
  UNION ALL SELECT 1, 'T / K', 'temperature_c', 'K', true
  UNION ALL SELECT 1, 'Conversion (%)[a]', 'conversion_pct', '%', true
  UNION ALL SELECT 1, 'Ref.', 'ref', NULL, false
  UNION ALL SELECT 2, 'Total acid [mmol/g]', 'total_acidity', 'mmol/g', true
  UNION ALL SELECT 2, 'Strong acid', 'strong_acidity', NULL, true
  UNION ALL SELECT 2, 'Sample', 'sample', NULL, false
  UNION ALL SELECT 3, '0', '0', NULL, false UNION ALL SELECT 3, '1', '1', NULL, false UNION ALL SELECT 3, '2', '2', NULL, false
  UNION ALL SELECT 4, 'Property', 'property', NULL, false
  UNION ALL SELECT 4, 'small ring', 'small_ring', NULL, false
  UNION ALL SELECT 4, 'red widget', 'red_widget', NULL, false) h ON part.p_partkey % 5 = h.t""")
def _k5(spark, sf):
    g = K.group_tables(table_rows(spark, sf))
    h = g.select(F.explode("headers").alias("header")).distinct()
    return K.read_headers(h, "header", LIB, "m").select("header", "m.attr", "m.unit", "m.mapped")


@query("k6_transposed", """
SELECT 'p' || CAST(p_partkey % 49 AS STRING) AS doc, min(p_partkey) AS table_ord,
       CASE WHEN p_partkey % 5 = 4 AND count(*) >= 3 THEN true ELSE false END AS transposed,
       CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS header_hits
FROM part WHERE p_partkey % 5 <> 3 GROUP BY p_partkey % 49, p_partkey % 5""")
def _k6(spark, sf):
    return _profile(spark, sf).filter("not headerless").select(
        "doc", "table_ord", "transposed", "header_hits")


@query("k7_melt", _cells_sql("""
SELECT 'p' || CAST(d AS STRING) AS doc, k AS row_ord, label, col, attr,
       CASE WHEN attr = 'temperature_c' THEN raw_num WHEN attr = 'total_acidity' AND unit IS NOT NULL THEN raw_num ELSE num END AS num,
       mapped FROM keyed WHERE attr IS NOT NULL"""))
def _k7(spark, sf):
    return cells(spark, sf).filter("attr is not null").select(
        "doc", "row_ord", "label", "col", "attr", "num", "mapped")


@query("k8_columns_regex", """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'co2_conv_pct' WHEN 1 THEN 'temperature_k' WHEN 2 THEN 'temperature_c'
       WHEN 3 THEN 'bet_m2_g' WHEN 4 THEN 'si_al_ratio' WHEN 5 THEN 'catalyst_system' WHEN 6 THEN 'conversion_pct' ELSE NULL END AS field
FROM part""")
def _k8(spark, sf):
    h = sql(spark, sf, """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Performance.CO2 conv (%)' WHEN 1 THEN 'temperature, T (K)'
        WHEN 2 THEN 'T / °C' WHEN 3 THEN 'S BET (m2/g)' WHEN 4 THEN 'Si/Al' WHEN 5 THEN 'Sample' WHEN 6 THEN 'Conversion (%)'
        ELSE p_name END AS header FROM part""")
    return h.select("p_partkey", K.map_columns_regex(F.col("header")).alias("field"))


@query("k9_table_to_units", """
SELECT 's' || CAST(p_partkey % 49 AS STRING) || '::docling::t00::r' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || CAST(p_partkey AS STRING) AS evidence_id,
       p_name AS catalyst_system, CASE WHEN p_size % 4 = 0 THEN NULL ELSE '[' || CAST(p_size AS STRING) || ']' END AS source_reference,
       v.field, CASE v.field WHEN 'temperature_c' THEN ROUND(573 + p_size - 273.15, 1) ELSE CAST(p_size AS DOUBLE) END AS num
FROM part JOIN (SELECT 'temperature_c' AS field UNION ALL SELECT 'whsv') v ON v.field = 'temperature_c' OR p_size % 3 <> 0""")
def _k9(spark, sf):
    t = sql(spark, sf, """SELECT 'p' AS doc, 's' || CAST(p_partkey % 49 AS STRING) AS slug, 0 AS table_idx, CAST(p_partkey AS INT) AS row_idx,
        array('Sample', 'Cond.temperature, T (K)', 'WHSV', 'Ref.x.Ref') AS headers,
        array(p_name, CAST(573 + p_size AS STRING), CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) || ' h' END,
              CASE WHEN p_size % 4 = 0 THEN '-' ELSE '(' || CAST(p_size AS STRING) || ')' END) AS cells FROM part""")
    return K.table_to_units(t).select("evidence_id", "catalyst_system", "source_reference",
                                      "field", "num")


@query("k10_points_from_ragged", """
SELECT 'p' || CAST(p_partkey % 49 AS STRING) AS doc, p_partkey AS row_ord, p_name AS label, 573 + p_size - 273.15 AS x,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS y
FROM part WHERE p_partkey % 5 = 1 AND p_size % 7 <> 0""")
def _k10(spark, sf):
    g = K.group_tables(table_rows(spark, sf))
    t = g.withColumn("doc", F.struct("doc", "row_ord"))
    p = K.points_from_ragged(t, [r"(?i)temp|T\b", r"K\b|°C|C\b"], "conversion")
    return p.select("doc.doc", "doc.row_ord", "label", "x", "y")


@query("records_from_tables", _cells_sql("""
SELECT 'p' || CAST(r.d AS STRING) AS doc, r.rec_key, r.label, w.attr, w.num AS value_num, w.unit,
       CASE WHEN w.raw_num IS NOT NULL AND w.raw_num <> w.num THEN w.raw_num ELSE NULL END AS raw_value
FROM recs r JOIN won w ON r.d = w.d AND r.rec_key = w.rec_key"""))
def _records_long(spark, sf):
    a = attributes(spark, sf)
    return a.filter("attr is not null").select(
        "doc", "rec_key", F.col("best_label.label").alias("label"), "attr", "value_num", "unit",
        "raw_value")


@query("r1_assemble_records", _cells_sql("""
SELECT 'p' || CAST(r.d AS STRING) AS doc, r.rec_key, r.label, count(w.attr) AS n_attributes,
       string_agg(w.attr, ',' ORDER BY w.attr) AS attrs,
       (SELECT string_agg(tt, ',' ORDER BY tt) FROM (SELECT DISTINCT CASE t WHEN 0 THEN 'textural' WHEN 1 THEN 'performance' WHEN 2 THEN 'acidity' ELSE 'other' END AS tt
          FROM keyed kk WHERE kk.d = r.d AND kk.rec_key = r.rec_key) q) AS table_types,
       (SELECT '[' || CAST(max_by(s.z % 30, s.k) AS STRING) || ']' FROM src s WHERE s.t = 1 AND s.d = r.d
          AND replace(s.nm, ' ', '') = r.rec_key) AS source_reference
FROM recs r LEFT JOIN won w ON r.d = w.d AND r.rec_key = w.rec_key GROUP BY r.d, r.rec_key, r.label"""))
def _r1(spark, sf):
    r = R.assemble_records(attributes(spark, sf))
    return r.select("doc", "rec_key", "label", F.col("n_attributes").cast("long")
                    .alias("n_attributes"),
                    F.when(F.size("attributes") > 0, F.array_join(F.array_sort(
                        F.map_keys("attributes")), ",")).alias("attrs"),
                    F.array_join("table_types", ",").alias("table_types"), "source_reference")


@query("r2_records_to_wide", _cells_sql("SELECT 'p' || CAST(r.d AS STRING) AS doc, r.rec_key, r.label, " + ", ".join(
    f"max(CASE WHEN w.attr = '{f}' THEN w.num END) AS {f}" for f in FEATURES) + """
FROM recs r LEFT JOIN won w ON r.d = w.d AND r.rec_key = w.rec_key GROUP BY r.d, r.rec_key, r.label"""))
def _r2(spark, sf):
    return R.records_to_wide(attributes(spark, sf), FEATURES)


@query("r3_build_stats", _cells_sql("""
SELECT 'tables' AS metric, (SELECT count(*) FROM tab) AS value
UNION ALL SELECT 'papers', (SELECT count(DISTINCT d) FROM tab)
UNION ALL SELECT 'headerless_skipped', (SELECT count(*) FROM tab WHERE t = 3)
UNION ALL SELECT 'no_key_column', 0
UNION ALL SELECT 'transposed', (SELECT count(*) FROM tab WHERE t = 4 AND n >= 3)
UNION ALL SELECT 'mapped_cells', (SELECT count(*) FROM keyed WHERE attr IS NOT NULL AND mapped)
UNION ALL SELECT 'verbatim_cells', (SELECT count(*) FROM keyed WHERE attr IS NOT NULL AND NOT mapped)
UNION ALL SELECT 'unit_normalized', (SELECT count(*) FROM won WHERE raw_num IS NOT NULL AND raw_num <> num)
UNION ALL SELECT 'records', (SELECT count(*) FROM recs)
UNION ALL SELECT 'records_merged', (SELECT count(*) FROM (SELECT d, rec_key FROM keyed GROUP BY d, rec_key HAVING count(DISTINCT label) > 1) q)
UNION ALL SELECT 'type:' || CASE t WHEN 0 THEN 'textural' WHEN 1 THEN 'performance' WHEN 2 THEN 'acidity' ELSE 'other' END, count(*) FROM tab WHERE t <> 3 GROUP BY t"""))
def _r3(spark, sf):
    rows = table_rows(spark, sf)
    read = K.read_tables(rows, LIB)      # the profile and the cells read the same written tables
    c = cut(K.melt_tables(rows, LIB, read))
    a = cut(R.record_attributes(c))
    return R.build_stats(K.table_profile(read[0], LIB, read[1]), c, a, R.assemble_records(a))


_PERF = "(attr LIKE '%conversion%' OR attr LIKE '%selectivity%')"
_PROP = "(attr LIKE '%surface_area%' OR attr LIKE '%pore%' OR attr LIKE '%acid%')"


@query("r4_coverage_summary", _cells_sql(f"""
, f AS (SELECT r.d, r.rec_key, count(w.attr) AS n, coalesce(bool_or({_PERF}), false) AS p, coalesce(bool_or({_PROP}), false) AS q
      FROM recs r LEFT JOIN won w ON r.d = w.d AND r.rec_key = w.rec_key GROUP BY r.d, r.rec_key)
SELECT count(*) AS records, round(avg(n), 4) AS avg_attributes, count(*) FILTER (WHERE p) AS with_performance,
       count(*) FILTER (WHERE q) AS with_property, count(*) FILTER (WHERE p AND q) AS with_both,
       (SELECT count(DISTINCT d || ':' || nm) FROM (SELECT CAST(d AS STRING) AS d, nm FROM src WHERE t = 1) z) AS with_reference,
       round(count(*) * 1.0 / count(DISTINCT d), 4) AS records_per_doc FROM f""".replace("\n, f AS", ", f AS", 1)))
def _r4(spark, sf):
    return R.coverage_summary(R.assemble_records(attributes(spark, sf)))


@query("r4_attribute_frequency", _cells_sql(
    "SELECT attr, count(*) AS n FROM won GROUP BY attr ORDER BY n DESC, attr LIMIT 20"))
def _r4b(spark, sf):
    return R.attribute_frequency(R.assemble_records(attributes(spark, sf)))


@query("r4_densest_records", _cells_sql("""
SELECT 'p' || CAST(r.d AS STRING) AS doc, r.label, count(w.attr) AS n_attributes FROM recs r LEFT JOIN won w ON r.d = w.d AND r.rec_key = w.rec_key
GROUP BY r.d, r.rec_key, r.label ORDER BY n_attributes DESC, doc, label LIMIT 5"""))
def _r4c(spark, sf):
    return R.densest_records(R.assemble_records(attributes(spark, sf)))


@query("a1_density", _cells_sql(f"""
SELECT f.c AS "column", count(w.attr) AS n, f.g AS family,
       round(100.0 * count(w.attr) / (SELECT count(*) FROM recs), 4) AS pct
FROM (SELECT 'temperature_c' AS c, 'conditions' AS g UNION ALL SELECT 'pressure', 'conditions' UNION ALL SELECT 'conversion_pct', 'performance'
      UNION ALL SELECT 'selectivity_pct', 'performance' UNION ALL SELECT 'bet_surface_area', 'texture' UNION ALL SELECT 'total_pore_volume', 'texture'
      UNION ALL SELECT 'total_acidity', 'acidity' UNION ALL SELECT 'strong_acidity', 'acidity' UNION ALL SELECT 'si_al_ratio', 'composition') f
LEFT JOIN won w ON w.attr = f.c GROUP BY f.c, f.g"""))
def _a1(spark, sf):
    return A.density(R.records_to_wide(attributes(spark, sf), FEATURES), FEATURES, FEATURE_GROUPS)


@query("a2_joinability", _cells_sql("""
, f AS (SELECT r.d, r.rec_key, coalesce(bool_or(attr IN ('temperature_c','pressure')), false) AS c,
        coalesce(bool_or(attr IN ('bet_surface_area','total_pore_volume','total_acidity','strong_acidity','si_al_ratio')), false) AS s,
        coalesce(bool_or(attr IN ('conversion_pct','selectivity_pct')), false) AS p
      FROM recs r LEFT JOIN won w ON r.d = w.d AND r.rec_key = w.rec_key GROUP BY r.d, r.rec_key)
SELECT count(*) AS records, count(*) FILTER (WHERE c AND p) AS condition_performance, count(*) FILTER (WHERE s AND p) AS structure_performance,
       count(*) FILTER (WHERE c AND s AND p) AS all_three FROM f"""))
def _a2(spark, sf):
    g = FEATURE_GROUPS
    return A.joinability(R.records_to_wide(attributes(spark, sf), FEATURES), g["conditions"],
                         g["texture"] + g["acidity"] + g["composition"], g["performance"])


@query("a20_analysis_frame", _cells_sql("""
, m AS (SELECT r.d, r.rec_key, r.label, max(CASE WHEN attr = 'conversion_pct' THEN num END) AS metric,
        max(CASE WHEN attr = 'temperature_c' THEN num END) AS temperature, max(CASE WHEN attr = 'bet_surface_area' THEN num END) AS bet
      FROM recs r LEFT JOIN won w ON r.d = w.d AND r.rec_key = w.rec_key GROUP BY r.d, r.rec_key, r.label)
SELECT 'p' || CAST(d AS STRING) AS doc, rec_key, label, CASE WHEN d % 2 = 0 THEN 'topic_a' ELSE 'topic_b' END AS topic,
       'other' AS family, metric, temperature, bet FROM m WHERE d % 2 = 0 OR metric IS NOT NULL"""))
def _a20(spark, sf):
    topics = sql(spark, sf, """SELECT DISTINCT 'p' || CAST(p_partkey % 49 AS STRING) AS doi,
        CASE WHEN p_partkey % 49 % 2 = 0 THEN 'topic_a' ELSE 'topic_b' END AS topic FROM part""")
    return A.analysis_frame(attributes(spark, sf), topics, "topic_a", ["conversion_pct"],
                            {"temperature": ["temperature_c"], "bet": ["bet_surface_area"]})


@query("m7_complete_records", _cells_sql("""
SELECT 'p' || CAST(r.d AS STRING) AS doc, r.rec_key, count(*) AS n_filled FROM recs r JOIN won w ON r.d = w.d AND r.rec_key = w.rec_key
WHERE w.attr IN (""" + FEATURE_LIST + ") GROUP BY r.d, r.rec_key HAVING count(*) >= 3"))
def _m7(spark, sf):
    from recordloom.operators.modeling import complete_records
    w = R.records_to_wide(attributes(spark, sf), FEATURES)
    return complete_records(w, FEATURES, 3).select(
        "doc", "rec_key", F.col("n_filled").cast("long").alias("n_filled"))
