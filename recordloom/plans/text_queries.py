"""Queries of text segmentation (T), ordered windows (W1-W3) and conditions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import text as TX
from recordloom.functions import vocabulary as V
from recordloom.functions.temperature import extract_temperatures
from recordloom.operators import conditions as C
from recordloom.operators import text as T
from recordloom.plans.registry import query
from recordloom.plans.views import sql, view


def prose(spark, sf):
    return view(spark, sf, "v_prose")


def doubles(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("t1_paragraphs", r"""WITH p AS (SELECT slug, page, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n(?:[ \t]*\n)+'),
 lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS para FROM v_pages)
SELECT slug, page, count(*) AS n, sum(length(para)) AS chars FROM p GROUP BY slug, page""")
def _t1(spark, sf):
    p = view(spark, sf, "v_pages").select("slug", "page", F.explode(
        TX.split_paragraphs(F.col("text"))).alias("para"))
    return p.groupBy("slug", "page").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.length("para")).alias("chars"))


def _greedy(pieces: str, source: str, limit: int, glue: int) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, list_transform({pieces}, lambda x: length(x)) AS ls FROM {source}),
w AS (SELECT doc_id, ls, 1 AS i, 1 AS c, CAST(ls[1] AS BIGINT) AS b FROM d
 UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN b + ls[i + 1] > {limit} AND b > 0 THEN c + 1 ELSE c END,
  CASE WHEN b + ls[i + 1] > {limit} AND b > 0 THEN ls[i + 1] WHEN b = 0 THEN ls[i + 1] ELSE b + {glue} + ls[i + 1] END FROM w WHERE i < len(ls))
"""


@query("t2_pack_sentences", _greedy(
    r"string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g'), chr(1))",
    r"(SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents) z", 1800, 1)
    + """SELECT doc_id, c AS chunk_no, CAST(max(b) AS BIGINT) AS n_chars FROM w WHERE (SELECT sum(u) FROM unnest(ls) t(u)) > 0 GROUP BY doc_id, c""")
def _t2(spark, sf):
    d = view(spark, sf, "documents")
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    c = d.select("doc_id", F.posexplode(TX.pack_sentences(t, 1800)).alias("p", "chunk"))
    return c.select("doc_id", (F.col("p") + 1).alias("chunk_no"),
                    F.length("chunk").cast("long").alias("n_chars"))


@query("t3_pack_paragraphs", _greedy(
    "string_split(text, chr(10) || chr(10))", "(SELECT page AS doc_id, text FROM v_pages) z", 6000, 2)
    + "SELECT doc_id, max(c) AS n FROM w GROUP BY doc_id")
def _t3(spark, sf):
    d = view(spark, sf, "v_pages")
    return d.select(F.col("page").alias("doc_id"), F.size(TX.pack_paragraphs(F.col("text"), 6000))
                    .alias("n"))


_SCORE = " + ".join(f"CASE WHEN regexp_matches(text, {lit('(?i)' + p)}) THEN 1 ELSE 0 END"
                    for p in V.HIGH_VALUE_PATTERNS)


@query("t4_pattern_score", f"SELECT doc, page, {_SCORE} AS score FROM v_prose")
def _t4(spark, sf):
    return prose(spark, sf).select("doc", "page", TX.score_patterns(F.col("text")).alias("score"))


@query("t4_document_scores", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)tion') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)the|der') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 1 ELSE 0 END AS score FROM documents""")
def _t4b(spark, sf):
    return view(spark, sf, "documents").select("doc_id", TX.score_patterns(
        F.col("text"), ("tion", "the|der", "[0-9]{3}")).alias("score"))


_HEAD = r"CASE WHEN regexp_matches(text, '^(\d+(\.\d+)*\.?\s+)\S') AND length(text) < 120 THEN text END"
_FLAT = f"(SELECT doc, page, chunk_no, chunk_id, paper_type, replace(text, chr(10), ' ') AS text FROM v_prose)"


@query("t5_chunks", f"""WITH c AS (SELECT doc, page, text, {_SCORE} AS score, {_HEAD} AS h FROM {_FLAT} z)
SELECT doc || '::p' || CASE WHEN page < 10 THEN '00' WHEN page < 100 THEN '0' ELSE '' END || CAST(page AS STRING) || '::c01' AS chunk_id, score AS high_value_score,
 score >= 3 AS is_high_value, last_value(h IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM c""")
def _t5(spark, sf):
    pages = prose(spark, sf).select(F.col("doc").alias("slug"), "page", "text")
    return T.chunk_documents(pages).select("chunk_id", "high_value_score", "is_high_value",
                                           "section")


@query("t5_document_chunks", r"""WITH p AS (SELECT slug, page, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n(?:[ \t]*\n)+'),
 lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS para FROM v_pages)
SELECT slug, count(DISTINCT page) AS pages, CAST(sum(length(replace(para, ' ', ''))) AS BIGINT) AS letters FROM p GROUP BY slug""")
def _t5b(spark, sf):
    c = T.chunk_documents(view(spark, sf, "v_pages"))
    return c.groupBy("slug").agg(F.count_distinct("page").alias("pages"), F.sum(F.length(
        F.replace("text", F.lit(" "), F.lit("")))).alias("letters"))


@query("t6_high_value", f"WITH c AS (SELECT chunk_id, page, {_SCORE} AS s FROM v_prose) SELECT chunk_id, page, s AS high_value_score FROM c WHERE s >= 3")
def _t6(spark, sf):
    c = prose(spark, sf).withColumn("high_value_score", TX.score_patterns(F.col("text")))
    c = c.withColumn("is_high_value", F.col("high_value_score") >= 3)
    return T.select_high_value(c).select("chunk_id", "page", "high_value_score")


_SEC = f"""lower(trim(coalesce(nullif(regexp_extract(text, {lit(rf"(?i)^\s*(?:\d[\d.]*\.?\s+)?({V.SECTION_WORDS})")}, 1), ''),
 nullif(regexp_extract(substring(text, 1, 300), {lit(rf"(?im)(?:^|[.\n]\s{{0,4}})(?:\d[\d.]*\.?\s+)?({V.SECTION_WORDS})\b")}, 1), ''))))"""


@query("t7_detect_section", f"SELECT doc, page, {_SEC} AS section FROM v_prose")
def _t7(spark, sf):
    return prose(spark, sf).select("doc", "page", TX.detect_section(F.col("text"))
                                   .alias("section"))


_sl = lambda xs: ", ".join(lit(x) for x in xs)


@query("t8_section_select", f"""WITH c AS (SELECT doc, page, chunk_id, paper_type, {_SCORE} >= 3 AS hv, {_SEC} AS s FROM v_prose),
f AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'preamble') AS sn FROM c),
k AS (SELECT *, sn NOT IN ({_sl(V.DROPPED_SECTIONS)}) AND (sn IN ({_sl(V.KEPT_SECTIONS)}) OR hv) AS keep FROM f),
n AS (SELECT doc, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE hv) AS hvs FROM k GROUP BY doc)
SELECT k.chunk_id, k.sn AS section_norm FROM k JOIN n ON n.doc = k.doc
WHERE CASE WHEN paper_type <> 'primary' OR (kept < greatest(8, floor(hvs * 0.25)) AND hvs > 0) THEN hv ELSE keep END""")
def _t8(spark, sf):
    c = prose(spark, sf).withColumn("is_high_value", TX.score_patterns(F.col("text")) >= 3)
    return T.select_by_section(c, ["doc"], ["page", "chunk_no"], block_on="page").select(
        "chunk_id", "section_norm")


_MD = """SELECT doc_id, source, lang, '# Abstract' || chr(10) || text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '## Experimental methods' ELSE '## Some findings' END
 || chr(10) || lang || ' ' || source || chr(10) || '### Empty' || chr(10) || '### References' || chr(10) || '1. Alpha ' || source || chr(10) || '  more ' || lang || chr(10)
 || '[2] Beta ' || CAST(doc_id AS STRING) || chr(10) || '(3) Gamma' AS md FROM documents"""

_LINES = f"""m AS ({_MD}), l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM m),
h AS (SELECT *, regexp_matches(line, '^#{{1,3}}[ \\t]') AS hd FROM l), g AS (SELECT *, sum(CASE WHEN hd THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec FROM h),
s AS (SELECT doc_id, sec, max(CASE WHEN hd THEN trim(trim(line, '#')) END) AS name, trim(string_agg(CASE WHEN NOT hd THEN line END, chr(10) ORDER BY i), ' ' || chr(10)) AS body FROM g GROUP BY doc_id, sec)"""


@query("t9_md_sections", f"""WITH {_LINES} SELECT doc_id, name, CASE WHEN name = 'Abstract' THEN 'abstract' WHEN name = 'Experimental methods' THEN 'experimental' WHEN name = 'References' THEN 'references' ELSE 'other' END AS cls,
 length(body) AS n FROM s WHERE body <> ''""")
def _t9(spark, sf):
    s = T.sections_of(sql(spark, sf, _MD), ["doc_id"])
    return s.select("doc_id", "name", "cls", F.length("text").cast("long").alias("n"))


@query("t10_classify_section", """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'abstract' WHEN 1 THEN 'introduction' WHEN 2 THEN 'experimental' WHEN 3 THEN 'characterization' WHEN 4 THEN 'results'
 WHEN 5 THEN 'conclusions' WHEN 6 THEN 'references' WHEN 7 THEN 'skip' ELSE 'other' END AS cls FROM part""")
def _t10(spark, sf):
    d = sql(spark, sf, """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'ABSTRACT ' || p_name WHEN 1 THEN '1. Introduction' WHEN 2 THEN 'Catalyst  preparation' WHEN 3 THEN 'Characterisation of ' || p_name
        WHEN 4 THEN 'Results & Discussion' WHEN 5 THEN 'Summary' WHEN 6 THEN 'References' WHEN 7 THEN 'Conflicts of interest' ELSE p_name END AS name FROM part""")
    return d.select("p_partkey", TX.classify_section(F.col("name")).alias("cls"))


@query("t11_paper_type", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'primary' WHEN doc_id % 5 = 0 THEN 'review' WHEN doc_id % 7 = 0 THEN 'review' ELSE 'primary' END AS paper_type FROM documents""")
def _t11(spark, sf):
    md = sql(spark, sf, _MD)
    s = T.sections_of(md, ["doc_id"]).filter("cls <> 'abstract'").withColumn(
        "text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("A survey of "), "text"))
        .otherwise(F.col("text")))
    refs = md.filter("doc_id % 5 = 0").select("doc_id", F.explode(F.sequence(
        F.lit(1), F.lit(81))).alias("ref_num"))
    return T.detect_paper_type(s, refs, ["doc_id"])


@query("t12_ref_chunks", "SELECT chunk_id, o_k = 6 AS is_ref FROM (SELECT chunk_id, page % 10 AS o_k FROM v_prose) z")
def _t12(spark, sf):
    return prose(spark, sf).select("chunk_id", TX.is_reference_chunk(F.col("text"))
                                   .alias("is_ref"))


@query("t13_reference_entries", r"""WITH e AS (SELECT doc, page, unnest(regexp_extract_all(text, '\((\d{1,3})\)\s*([A-Z][^\n]{10,250})', 1)) AS ref_num,
 trim(unnest(regexp_extract_all(text, '\((\d{1,3})\)\s*([A-Z][^\n]{10,250})', 2))) AS citation_text FROM v_prose WHERE page % 10 = 6)
SELECT doc, ref_num, citation_text FROM (SELECT *, row_number() OVER (PARTITION BY doc, ref_num ORDER BY page DESC) AS rn FROM e) q WHERE rn = 1""")
def _t13(spark, sf):
    return T.reference_entries(prose(spark, sf), ["doc"], ["page", "chunk_no"])


@query("t14_reference_section", """SELECT doc_id, '1' AS num, 'Alpha ' || source || ' more ' || lang AS text FROM documents
UNION ALL SELECT doc_id, '2', 'Beta ' || CAST(doc_id AS STRING) FROM documents UNION ALL SELECT doc_id, '3', 'Gamma' FROM documents""")
def _t14(spark, sf):
    md = sql(spark, sf, _MD)
    return md.select("doc_id", F.inline(TX.parse_reference_section(F.col("md"))))


_QP = rf"(?i)(-?\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?)\s*({V.QUANTITY_UNITS})"


@query("t15_quantities", f"""SELECT chunk_id, array_to_string(regexp_extract_all(text, {lit(_QP)}, 1), '|') AS vals, array_to_string(regexp_extract_all(text, {lit(_QP)}, 2), '|') AS units,
 array_to_string(list_transform(regexp_extract_all(text, {lit(_QP)}, 2), lambda u: CASE WHEN u = '%' THEN 'percentage' WHEN u IN ('°C', 'K') THEN 'temperature'
 WHEN u IN ('MPa', 'bar') THEN 'pressure' WHEN u = 'nm' THEN 'particle_size' WHEN u LIKE 'h%' THEN 'rate_or_time' ELSE 'unknown' END), '|') AS kinds FROM v_prose""")
def _t15(spark, sf):
    q = prose(spark, sf).select("chunk_id", TX.extract_quantities(F.col("text")).alias("q"))
    return q.select("chunk_id", *[F.array_join(F.col("q")[f], "|").alias(n) for f, n in (
        ("value", "vals"), ("unit", "units"), ("quantity_type", "kinds"))])


@query("t16_formula_tokens", rf"""SELECT chunk_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(
 list_filter(regexp_extract_all(text, '\b[A-Z][a-z]?(?:[-–][A-Z][a-z]?)*(?:\d+[A-Z][a-z]*\d*)?/[A-Za-z0-9]+\b'), lambda t: length(t) >= 4),
 list_filter(regexp_extract_all(text, '\b(?:[A-Z][a-z]?)+\b'), lambda t: length(t) BETWEEN 3 AND 20)), lambda t: t NOT IN ({_sl(V.NOT_FORMULAE)})))), ',') AS tokens FROM v_prose""")
def _t16(spark, sf):
    return prose(spark, sf).select("chunk_id", F.array_join(TX.formula_tokens(F.col("text")), ",")
                                   .alias("tokens"))


_ENT = """SELECT l_suppkey AS chunk_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS word,
 l_discount AS score FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("t17_dedupe_entities", f"""WITH e AS ({_ENT}), b AS (SELECT chunk_id, lower(word) AS w, max(score) AS s, min(pos) AS p FROM e GROUP BY 1, 2)
SELECT chunk_id, string_agg(w, ',' ORDER BY s DESC, p, w) AS materials FROM b GROUP BY chunk_id""")
def _t17(spark, sf):
    d = T.dedupe_entities(sql(spark, sf, _ENT))
    return d.select("chunk_id", F.array_join("materials", ",").alias("materials"))


@query("t21_page_has_table", "SELECT chunk_id, page % 10 = 8 AS has_table FROM v_prose")
def _t21(spark, sf):
    return prose(spark, sf).select("chunk_id", TX.page_has_table(F.col("text"))
                                   .alias("has_table"))


_C = """SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 10 AS t, 'c' || CAST(o_custkey % 150 AS STRING) AS doc FROM orders"""
_ID = "doc || '::cde::p' || CAST(k AS STRING) || '::c01' AS evidence_id"


@query("t23_draft_records", f"""WITH b AS ({_C}) SELECT {_ID},
 CASE t WHEN 0 THEN 'MPa' WHEN 1 THEN 'WHSV' WHEN 2 THEN 'Cu/ZnO' WHEN 3 THEN 'GHSV' WHEN 8 THEN 'K-Cu-Fe/ZnO' END AS catalyst_system,
 CASE WHEN t = 2 THEN CAST(5 + k % 60 AS STRING) END AS conversion, CASE t WHEN 2 THEN CAST(10 + k % 80 AS STRING) WHEN 7 THEN CAST(k % 90 AS STRING) END AS selectivity,
 CASE WHEN t = 2 THEN 'methanol' END AS product,
 CASE t WHEN 0 THEN '550 °C' WHEN 1 THEN CAST(310 + c % 7 * 10 AS STRING) || ' °C' WHEN 5 THEN CAST(600 + c % 50 AS STRING) || ' K' WHEN 7 THEN CAST(320 + c % 5 * 10 AS STRING) || ' °C' ELSE '' END AS temperature,
 CASE t WHEN 0 THEN CAST(1 + c % 4 AS STRING) || ' MPa' WHEN 1 THEN CAST(10 + c % 5 AS STRING) || ' bar' ELSE '' END AS pressure,
 t NOT IN (2, 7) AS needs_manual_check, CASE WHEN t IN (0, 1, 2) THEN 'high' ELSE 'medium' END AS confidence FROM b WHERE t NOT IN (4, 6, 9)""")
def _t23(spark, sf):
    p = prose(spark, sf).withColumnRenamed("doc", "slug")
    return T.chunk_to_record(p).select("evidence_id", "catalyst_system", "conversion",
                                       "selectivity", "product", "temperature", "pressure",
                                       "needs_manual_check", "confidence")


@query("w1_carry_forward_heading", f"""WITH c AS (SELECT doc, page, {_HEAD} AS h FROM {_FLAT} z) SELECT doc, page, last_value(h IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM c""")
def _w1(spark, sf):
    return T.carry_forward_heading(prose(spark, sf).withColumnRenamed("doc", "slug")).select(
        F.col("slug").alias("doc"), "page", "section")


@query("w2_section_carry", f"""WITH c AS (SELECT doc, page, {_SEC} AS s FROM v_prose) SELECT doc, page, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'preamble') AS section_norm FROM c""")
def _w2(spark, sf):
    return T.carry_forward_section(prose(spark, sf), ["doc"], ["page", "chunk_no"],
                                   block_on="page").select("doc", "page", "section_norm")


@query("w3_neighbour_text", """SELECT conv_id, turn, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS m FROM conversations""")
def _w3(spark, sf):
    c = view(spark, sf, "conversations")
    return T.neighbour_text(c, ["conv_id"], ["turn"]).select("conv_id", "turn",
                                                             F.md5("local_text").alias("m"))


_TV = "CASE t WHEN 0 THEN 300.0 + c % 9 * 10 WHEN 1 THEN 310.0 + c % 7 * 10 WHEN 5 THEN round(600 + c % 50 - 273.15, 1) WHEN 7 THEN 320.0 + c % 5 * 10 END"
_PV = "CASE t WHEN 0 THEN 1.0 + c % 4 WHEN 1 THEN round((10 + c % 5) * 0.1, 4) END"
_WV = "CASE WHEN t = 1 THEN 1.0 + k % 3 END"
_GV = "CASE WHEN t = 3 THEN 12000.0 END"
_LV = "CASE t WHEN 3 THEN 0.5 WHEN 5 THEN 1.0 + c % 3 END"


@query("c1_temperatures", f"WITH b AS ({_C}) SELECT k, coalesce(CAST(CAST({_TV} AS DOUBLE) AS STRING), '') AS v FROM b")
def _c1(spark, sf):
    return prose(spark, sf).select(F.col("page").cast("long").alias("k"), doubles(
        extract_temperatures(F.col("text"))).alias("v"))


@query("c3_pressures_and_rates", f"""WITH b AS ({_C}) SELECT k, coalesce(CAST(CAST({_PV} AS DOUBLE) AS STRING), '') AS p, coalesce(CAST(CAST({_WV} AS DOUBLE) AS STRING), '') AS w,
 coalesce(CAST(CAST({_GV} AS DOUBLE) AS STRING), '') AS g, coalesce(CAST(CAST({_LV} AS DOUBLE) AS STRING), '') AS l FROM b""")
def _c3(spark, sf):
    t = F.col("text")
    return prose(spark, sf).select(
        F.col("page").cast("long").alias("k"), doubles(C.extract_pressures(t)).alias("p"),
        doubles(C.extract_whsv(t)).alias("w"), doubles(C.extract_ghsv(t)).alias("g"),
        doubles(C.extract_loading(t)).alias("l"))


@query("c4_resolve_value", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size * 1.0 WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN 7.0 END AS value,
 CASE WHEN p_size % 3 <> 0 AND NOT (p_size % 3 = 1 AND p_size % 2 = 0) THEN 'multiple T: 7.0, ' || CAST(p_size + 8.0 AS DOUBLE) END AS note FROM part""")
def _c4(spark, sf):
    d = sql(spark, sf, """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN array(p_size + 0.2D, p_size - 0.2D) WHEN 1 THEN array(1.0D, 2.0D) ELSE array() END AS l,
        CASE WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN array(7.0D, 6.9D) ELSE array(p_size + 8.1D, 7.0D) END AS g FROM part""")
    r = C.resolve_value(F.col("l"), F.col("g"), "T", 0)
    return d.select("p_partkey", r.alias("r")).select("p_partkey", "r.value", "r.note")


def _field(f: str, expr: str, dec: int) -> str:
    return f"SELECT doc, pos, '{f}' AS f, round({expr}, {dec}) AS v FROM o WHERE {expr} IS NOT NULL"


_COND = f"""WITH b AS ({_C}), o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k) AS pos FROM b),
vals AS ({_field('temperature_c', _TV, 0)} UNION ALL {_field('pressure_mpa', _PV, 2)} UNION ALL {_field('whsv', _WV, 2)} UNION ALL {_field('ghsv', _GV, 0)} UNION ALL {_field('catalyst_loading_g', _LV, 3)}),
loc AS (SELECT o.k, v.f, count(DISTINCT v.v) AS n, min(v.v) AS one FROM o JOIN vals v ON v.doc = o.doc AND v.pos BETWEEN o.pos - 2 AND o.pos + 2 GROUP BY o.k, v.f),
gv AS (SELECT DISTINCT doc, f, v FROM vals),
glo AS (SELECT doc, f, count(*) AS n, min(v) AS one, string_agg(CAST(CAST(v AS DOUBLE) AS STRING), ', ' ORDER BY v) AS lst FROM gv GROUP BY doc, f),
fs AS (SELECT 'temperature_c' AS f, 'T(°C)' AS lab UNION ALL SELECT 'pressure_mpa', 'P(MPa)' UNION ALL SELECT 'whsv', 'WHSV' UNION ALL SELECT 'ghsv', 'GHSV' UNION ALL SELECT 'catalyst_loading_g', 'catalyst_loading(g)'),
res AS (SELECT o.k, fs.f, CASE WHEN loc.n = 1 THEN loc.one WHEN glo.n = 1 THEN glo.one END AS v,
  CASE WHEN coalesce(loc.n, 0) <> 1 AND glo.n > 1 THEN 'multiple ' || fs.lab || ': ' || glo.lst END AS note
  FROM o JOIN fs ON true LEFT JOIN loc ON loc.k = o.k AND loc.f = fs.f LEFT JOIN glo ON glo.doc = o.doc AND glo.f = fs.f)
SELECT k, max(CASE WHEN f = 'temperature_c' THEN CASE WHEN k % 4 = 0 THEN 777.0 ELSE v END END) AS temperature_c, max(CASE WHEN f = 'pressure_mpa' THEN v END) AS pressure_mpa,
 max(CASE WHEN f = 'whsv' THEN v END) AS whsv, max(CASE WHEN f = 'ghsv' THEN v END) AS ghsv, max(CASE WHEN f = 'catalyst_loading_g' THEN v END) AS catalyst_loading_g,
 string_agg(CASE WHEN f = 'temperature_c' AND k % 4 = 0 THEN NULL ELSE note END, '; ' ORDER BY CASE f WHEN 'temperature_c' THEN 0 WHEN 'pressure_mpa' THEN 1 WHEN 'whsv' THEN 2 WHEN 'ghsv' THEN 3 ELSE 4 END) AS temperature_note
FROM res GROUP BY k"""


@query("c5_conditions_fill", _COND)
def _c5(spark, sf):
    p = prose(spark, sf)
    none = F.lit(None).cast("double")
    u = p.select(F.col("page").cast("long").alias("k"), "doc", "chunk_id",
                 F.when(F.col("page") % 4 == 0, 777.0).alias("temperature_c"),
                 *[none.alias(f) for f in ("pressure_mpa", "whsv", "ghsv",
                                           "catalyst_loading_g")])
    chunks = p.select("doc", "chunk_id", "page", "chunk_no",
                      F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return C.fill_conditions(u, chunks).drop("doc", "chunk_id")


@query("c6_section_conditions", f"""WITH b AS ({_C}) SELECT k, CASE t WHEN 0 THEN 300.0 + c % 9 * 10 WHEN 1 THEN 310.0 + c % 7 * 10 WHEN 7 THEN 320.0 + c % 5 * 10 END AS temperature_c,
 CASE WHEN t = 0 THEN 'multiple: ' || CAST(300 + c % 9 * 10 AS STRING) || ', 550°C' END AS temperature_note, CASE WHEN t = 1 THEN round((10 + c % 5) * 0.1, 4) END AS pressure_mpa,
 {_WV} AS whsv, {_GV} AS ghsv, CASE WHEN t = 5 THEN 1.0 + c % 3 END AS catalyst_loading_g FROM b""")
def _c6(spark, sf):
    p = prose(spark, sf)
    return p.select(F.col("page").cast("long").alias("k"), C.section_conditions(F.col("text"))
                    .alias("s")).select("k", "s.*")


@query("c7_backfill_group_defaults", """SELECT unit_id, coalesce(temperature_c, 100.0 + length(source_doi)) AS temperature_c, coalesce(metric, 5.0) AS metric FROM v_units""")
def _c7(spark, sf):
    u = view(spark, sf, "v_units")
    d = u.select("source_doi").distinct().withColumn(
        "temperature_c", 100.0 + F.length("source_doi")).withColumn("metric", F.lit(5.0))
    return C.backfill_group_defaults(u, d, "source_doi", ["temperature_c", "metric"]).select(
        "unit_id", "temperature_c", "metric")
