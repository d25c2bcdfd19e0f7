"""Queries of the joins (J), corpus reports (R5-R7), scoring (U) and exports (X)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from recordloom.functions import text as TX
from recordloom.operators import export as X
from recordloom.operators import linkage as J
from recordloom.operators import records as R
from recordloom.operators import scoring as U
from recordloom.operators import text as T
from recordloom.plans.registry import query
from recordloom.plans.views import sql, view
from recordloom.session import shared_folder


def units(spark, sf):
    return view(spark, sf, "v_units")


@query("j1_join_papers", "SELECT unit_id, topic, year FROM v_units u JOIN v_papers p ON u.source_doi = p.doi WHERE topic = 'topic_a' AND paper_type = 'primary'")
def _j1(spark, sf):
    return J.join_papers(units(spark, sf), view(spark, sf, "v_papers"), F.expr(
        "topic = 'topic_a' and paper_type = 'primary'")).select("unit_id", "topic", "year")


@query("j2_papers_either", "SELECT unit_id, p.doi, metric FROM v_units u JOIN v_papers p ON u.source_doi = p.doi OR u.primary_doi = p.doi WHERE topic = 'topic_a' AND metric > 0")
def _j2(spark, sf):
    return J.join_papers_either(units(spark, sf).filter("metric > 0"),
                                view(spark, sf, "v_papers"), F.col("topic") == "topic_a").select(
        "unit_id", "doi", "metric")


@query("j3_fill_primary", """SELECT u.unit_id, coalesce(u.primary_doi, CASE WHEN r.score >= 0.7 THEN r.doi END) AS primary_doi,
 u.primary_doi IS NULL AND r.doi IS NOT NULL AND r.score >= 0.7 AS filled, u.primary_doi IS NULL AND r.doi IS NOT NULL AND r.score < 0.7 AS skipped_low
FROM v_units u LEFT JOIN v_refs r ON r.source_doi = u.source_doi AND u.source_reference = 'Ref. [' || r.ref_num || ']'""")
def _j3(spark, sf):
    f = J.fill_primary(units(spark, sf), view(spark, sf, "v_refs"))
    return f.select("unit_id", "primary_doi", F.coalesce("filled", F.lit(False)).alias("filled"),
                    F.coalesce("skipped_low", F.lit(False)).alias("skipped_low"))


@query("j4_drop_reference_units", """SELECT unit_id FROM v_units WHERE source_doi NOT IN (SELECT source_doi FROM v_units WHERE metric > 95 AND temperature_c > 445)""")
def _j4(spark, sf):
    u = units(spark, sf).withColumn("chunk_id", F.col("source_doi"))
    return J.drop_reference_units(u, u.filter("metric > 95 and temperature_c > 445")).select(
        "unit_id")


@query("j5_span_words", """WITH s AS (SELECT doc, page, link_id, min(top) - 4 AS lo, max(bottom) + 16 AS hi FROM v_links GROUP BY doc, page, link_id),
h AS (SELECT s.doc, s.page, s.link_id, w.text, row_number() OVER (PARTITION BY s.doc, s.page, s.link_id ORDER BY w.top, w.x0, w.text) AS rn,
      count(*) OVER (PARTITION BY s.doc, s.page, s.link_id) AS n FROM s JOIN v_words w ON w.doc = s.doc AND w.page = s.page AND w.top >= s.lo AND w.bottom <= s.hi),
f AS (SELECT doc, page, link_id, regexp_extract(text || CASE WHEN n > 1 THEN ' ' ELSE '' END, '^\\s*[\\[(]?(\\d{1,3})[\\]).\\s]', 1) AS num FROM h WHERE rn = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY doc, num ORDER BY page, link_id) AS k FROM f WHERE num <> '')
SELECT doc, num AS ref_num, link_id AS doi FROM g WHERE k = 1""")
def _j5(spark, sf):
    return J.match_links_to_refs(view(spark, sf, "v_links"), view(spark, sf, "v_words"))


_LABELS = """SELECT 'p' || CAST(l_partkey % 49 AS STRING) AS doc, 'k' || CAST(l_suppkey % 8 AS STRING) AS rec_key, p_name AS variant
 FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("j6_label_in_caption", f"""WITH l AS (SELECT DISTINCT doc, rec_key, variant FROM ({_LABELS}) x)
SELECT f.doc, f.figure, l.rec_key, min(l.variant) AS matched_on FROM v_figs f JOIN l ON l.doc = f.doc
WHERE regexp_matches(lower(f.caption), '(^|\\s|\\()' || l.variant || '($|[\\s,.;:)])') GROUP BY f.doc, f.figure, l.rec_key""")
def _j6(spark, sf):
    labels = sql(spark, sf, _LABELS).groupBy("doc", "rec_key").agg(
        F.array_sort(F.collect_set("variant")).alias("label_variants"))
    return J.match_labels_in_captions(labels, view(spark, sf, "v_figs"))


_VENUE = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Chem' WHEN 2 THEN 'Chemical Science' WHEN 3 THEN 'Applied Catalysis B: Environmental (incl. Energy)'
 WHEN 4 THEN 'Fuel' WHEN 5 THEN 'Science' ELSE o_orderpriority END AS journal, CAST(1990 + o_custkey % 35 AS INT) AS year, o_custkey AS citations FROM orders"""
_TIER = "CASE o_orderkey % 7 WHEN 1 THEN 'S' WHEN 2 THEN 'A' WHEN 3 THEN 'A' WHEN 4 THEN 'B' WHEN 5 THEN 'S' ELSE '?' END"
_IMPACT = "CASE o_orderkey % 7 WHEN 1 THEN 19.0 WHEN 2 THEN 9.0 WHEN 3 THEN 22.1 WHEN 4 THEN 7.0 WHEN 5 THEN 45.0 ELSE 0.0 END"


@query("j7_tier_lookup", f"SELECT o_orderkey, {_TIER} AS tier, {_IMPACT} AS impact FROM orders")
def _j7(spark, sf):
    d = sql(spark, sf, _VENUE)
    return d.select("o_orderkey", J.lookup_tier(F.col("journal")).alias("t")).select(
        "o_orderkey", "t.tier", "t.impact")




@query("j8_overlay_passes", """WITH a AS (SELECT DISTINCT chunk_id FROM (SELECT 'ch' || CAST(o_orderkey AS STRING) AS chunk_id, o_orderkey AS k FROM orders) x)
SELECT 'ch' || CAST(o_orderkey AS STRING) AS chunk_id, 'base' AS kind,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'Cu' END AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS conv,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS temp
FROM orders WHERE true
UNION ALL SELECT 'ch' || CAST(o_orderkey AS STRING), 'p2_only', CASE WHEN o_orderkey % 3 = 0 THEN 'Zn' WHEN o_orderkey % 3 = 1 THEN 'CU ' ELSE '' END, o_totalprice, NULL
FROM orders WHERE (o_orderkey % 3 = 0) OR (o_orderkey % 3 = 1 AND o_orderkey % 4 = 0) OR (o_orderkey % 3 = 2)
UNION ALL SELECT 'ch' || CAST(o_orderkey AS STRING), 'p3_only', 'cu', NULL, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END FROM orders WHERE o_orderkey % 4 = 0""")
def _j8(spark, sf):
    base = "SELECT 'ch' || CAST(o_orderkey AS STRING) AS chunk_id, 1 AS ord, "
    p1 = sql(spark, sf, base + "'Cu' AS name FROM orders WHERE o_orderkey % 4 <> 0")
    p2 = sql(spark, sf, base + """CASE o_orderkey % 3 WHEN 0 THEN 'Zn' WHEN 1 THEN 'CU ' ELSE '' END AS name,
        o_totalprice AS conv FROM orders""")
    p3 = sql(spark, sf, base + """'cu' AS name, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS temp FROM orders""")
    return J.overlay_passes(p1, p2, p3, ["conv"], ["temp"]).select("chunk_id", "kind", "name",
                                                                   "conv", "temp")


_CITED = """SELECT unit_id, source_doi, CASE WHEN source_reference IS NULL THEN NULL ELSE '[' || regexp_extract(source_reference, '([0-9]+)', 1) || ','
 || CAST(length(unit_id) % 12 AS STRING) || ']' END AS source_reference FROM v_units"""


@query("j9_citation_resolve", f"""WITH u AS ({_CITED.replace("'([0-9]+)', 1", "'([0-9]+)', 1")}),
n AS (SELECT unit_id, source_doi, 0 AS pos, regexp_extract(source_reference, '^.([0-9]+),', 1) AS ref_num FROM u WHERE source_reference IS NOT NULL
      UNION ALL SELECT unit_id, source_doi, 1, regexp_extract(source_reference, ',([0-9]+)', 1) FROM u WHERE source_reference IS NOT NULL),
j AS (SELECT n.*, CASE WHEN r.score >= 0.7 THEN r.doi END AS d, CASE WHEN r.citation_text <> '' THEN r.citation_text WHEN r.source_doi IS NOT NULL AND CAST(n.ref_num AS INT) % 2 = 0 THEN 'Listed ' || n.ref_num END AS c
      FROM n LEFT JOIN v_refs r ON r.source_doi = n.source_doi AND r.ref_num = n.ref_num),
a AS (SELECT unit_id, max(CASE WHEN pos = 0 THEN d END) AS d0, max(CASE WHEN pos = 1 THEN d END) AS d1, max(CASE WHEN pos = 0 THEN c END) AS c0, max(CASE WHEN pos = 1 THEN c END) AS c1 FROM j GROUP BY unit_id)
SELECT u.unit_id, coalesce(a.d0, a.d1) AS primary_doi, CASE WHEN a.d0 IS NOT NULL THEN a.c0 ELSE coalesce(a.c0, a.c1) END AS source_citation_text
FROM u LEFT JOIN a ON a.unit_id = u.unit_id""")
def _j9(spark, sf):
    u = sql(spark, sf, _CITED).withColumn("primary_doi", F.lit(None).cast("string"))
    refs = view(spark, sf, "v_refs")
    listed = refs.filter("CAST(ref_num AS INT) % 2 = 0").select(
        "source_doi", "ref_num", F.concat(F.lit("Listed "), "ref_num").alias("citation_text"))
    return J.resolve_citation_list(u, refs, listed).select("unit_id", "primary_doi",
                                                           "source_citation_text")


_REFS = """SELECT source_doi, ref_num, CASE WHEN CAST(ref_num AS INT) % 7 = 1 THEN 'Adams B 2001 doi 10.1234/abcd.' || ref_num ELSE 'Smith J 2010 Title ' || ref_num END AS citation_text FROM v_refs"""


@query("j10_resolve_refs", f"""WITH r AS (SELECT *, CAST(ref_num AS INT) AS n FROM ({_REFS}) q)
SELECT source_doi, ref_num,
 CASE WHEN n % 5 = 0 THEN '10.7/link' || ref_num WHEN n % 7 = 1 THEN '10.1234/abcd.' || ref_num WHEN n % 3 = 0 THEN '10.8/prior' || ref_num
      WHEN n % 2 = 0 THEN '10.6/ext' || ref_num END AS doi,
 CASE WHEN n % 5 = 0 THEN 'pdf_annotation' WHEN n % 7 = 1 THEN 'text_doi' WHEN n % 3 = 0 THEN 'openalex' WHEN n % 2 = 0 THEN 'openalex' END AS source,
 CASE WHEN n % 5 = 0 THEN 1.0 WHEN n % 7 = 1 THEN 0.95 WHEN n % 3 = 0 THEN 0.6 WHEN n % 2 = 0 THEN 1.0 ELSE 0.3 END AS score FROM r""")
def _j10(spark, sf):
    refs = sql(spark, sf, _REFS)
    n = F.col("ref_num").cast("int")
    keys = refs.select("source_doi", "ref_num", n.alias("n"))
    links = keys.filter("n % 5 = 0").withColumn("doi", F.concat(F.lit("10.7/link"), "ref_num"))
    prior = keys.filter("n % 3 = 0").select(
        "source_doi", "ref_num", F.concat(F.lit("10.8/prior"), "ref_num").alias("doi"),
        F.lit("openalex").alias("source"), F.lit(0.6).alias("score"))
    ext = keys.select("source_doi", "ref_num", F.concat(F.lit("10.6/ext"), "ref_num").alias("doi"),
                      F.lit("T").alias("title"),
                      F.when(F.col("n") % 2 == 0, 2010).otherwise(1999).alias("year"),
                      F.when(F.col("n") % 2 == 0, "John Smith").otherwise("Li Wu")
                      .alias("first_author"))
    return J.resolve_refs(refs, links, prior, ext).select("source_doi", "ref_num", "doi",
                                                          "source", "score")


@query("j10_refs_to_look_up", f"""WITH r AS (SELECT *, CAST(ref_num AS INT) AS n FROM ({_REFS}) q) SELECT source_doi, ref_num FROM r WHERE n % 5 <> 0 AND n % 7 <> 1 AND n % 3 <> 0""")
def _j10b(spark, sf):
    refs = sql(spark, sf, _REFS)
    keys = refs.select("source_doi", "ref_num", F.col("ref_num").cast("int").alias("n"))
    return J.refs_to_look_up(refs, keys.filter("n % 5 = 0"), keys.filter("n % 3 = 0")
                             .withColumn("doi", F.lit("d"))).select("source_doi", "ref_num")


@query("j11_score_match", """SELECT p_partkey, 0.3 + CASE WHEN p_partkey % 2 = 0 THEN 0.4 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE 0 END AS score FROM part""")
def _j11(spark, sf):
    d = sql(spark, sf, """SELECT p_partkey, 'Smith, J. Title ' || p_name || ' 2010' AS cit, CASE WHEN p_partkey % 2 = 0 THEN 2010 ELSE 2011 END AS year,
        CASE WHEN p_partkey % 3 = 0 THEN 'Jane Smith' ELSE 'Bo Li' END AS au FROM part""")
    return d.select("p_partkey", J.score_match(F.col("cit"), F.col("year"), F.col("au"))
                    .alias("score"))


_PANELS = "SELECT user_id AS image, event_id % 7 AS panel, event_id, event_type FROM events"


@query("j12_gate_panels", f"""WITH p AS ({_PANELS}), t AS (SELECT DISTINCT image, panel, CASE WHEN panel % 3 = 0 THEN 'activity' WHEN panel % 3 = 1 THEN 'structure_activity_relation' ELSE 'other' END AS type FROM p WHERE image % 4 <> 0)
SELECT event_id, image % 4 <> 0 AS gated FROM p WHERE image % 4 = 0 OR EXISTS (SELECT 1 FROM t WHERE t.image = p.image AND t.panel = p.panel AND t.type <> 'other')""")
def _j12(spark, sf):
    p = sql(spark, sf, _PANELS)
    t = p.filter("image % 4 <> 0").select("image", "panel", F.expr(
        "CASE panel % 3 WHEN 0 THEN 'activity' WHEN 1 THEN 'structure_activity_relation' ELSE 'other' END").alias("type"))
    return J.gate_panels(p, t).select("event_id", "gated")


@query("j13_first_available", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'unpaywall' WHEN p_partkey % 4 = 1 THEN 'openalex' WHEN p_partkey % 4 = 2 THEN 'arxiv' ELSE 'skip:not_oa' END AS source,
 p_partkey % 4 = 3 AS queued FROM part""")
def _j13(spark, sf):
    p = view(spark, sf, "part")
    offers = sql(spark, sf, """SELECT p_partkey, 'arxiv' AS source, CASE WHEN p_partkey % 4 < 3 THEN 'http://a' END AS url FROM part
        UNION ALL SELECT p_partkey, 'unpaywall', 'http://u' FROM part WHERE p_partkey % 4 < 2
        UNION ALL SELECT p_partkey, 'openalex', 'http://o' FROM part WHERE p_partkey % 4 = 1""")
    return J.first_available(p, offers, "p_partkey", ["openalex", "unpaywall", "arxiv",
                                                      "chemrxiv"]).select(
        "p_partkey", "source", "queued")


_FIELDS = ["primary_doi", "source_reference", "metal", "metric", "temperature_c", "pressure_mpa"]


@query("r5_corpus_stats", """SELECT 'rows' AS section, 'units' AS name, count(*) AS n FROM v_units UNION ALL SELECT 'rows', 'papers', count(*) FROM v_papers
UNION ALL SELECT 'topic', topic, count(*) FROM v_units u JOIN v_papers p ON u.source_doi = p.doi GROUP BY topic
""" + "".join(f"UNION ALL SELECT 'filled', '{f}', count({f}) FROM v_units\n" for f in _FIELDS))
def _r5(spark, sf):
    return R.corpus_stats(units(spark, sf), view(spark, sf, "v_papers"), _FIELDS)


@query("r6_overflow_keys", """WITH k AS (SELECT event_id, event_type AS key, regexp_extract(props, '[0-9]+') AS v FROM events UNION ALL SELECT event_id, 'k', regexp_extract(props, '[0-9]+') FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS rn FROM k)
SELECT key, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM events), 4) AS share, string_agg(v, '|' ORDER BY event_id) FILTER (WHERE rn <= 3) AS examples,
 count(*) >= floor((SELECT count(*) FROM events) * 0.10) AS promote FROM r GROUP BY key""")
def _r6(spark, sf):
    e = sql(spark, sf, """SELECT event_id, replace(props, '"k"', '"' || event_type || '"') AS a, props FROM events""")
    merged = e.select("event_id", F.concat(F.expr("substring(a, 1, length(a) - 1)"), F.lit(", "),
                                           F.expr("substring(props, 2)")).alias("props"))
    return R.overflow_keys(merged, "props", ["event_id"])


@query("r7_assign_tier", """SELECT unit_id, CASE WHEN paper_type = 'primary' THEN 'gold' WHEN primary_doi IS NOT NULL THEN 'silver' ELSE 'bronze' END AS tier
FROM v_units u JOIN v_papers p ON p.doi = u.source_doi""")
def _r7(spark, sf):
    u = J.join_papers(units(spark, sf), view(spark, sf, "v_papers"))
    return u.select("unit_id", R.assign_tier(F.col("paper_type"), F.col("primary_doi"))
                    .alias("tier"))


_CL = "v_claims"


@query("x1_paper_performance", "SELECT DISTINCT source_doi, catalyst_system, metric FROM v_claims WHERE metric IS NOT NULL")
def _x1(spark, sf):
    return X.paper_performance(view(spark, sf, _CL), ["catalyst_system", "metric"], ["metric"])


@query("x2_paper_claims", """SELECT source_doi, claim_type, claim_subject, claim_object FROM (SELECT *, row_number() OVER (PARTITION BY source_doi, claim_type,
 regexp_replace(lower(trim(claim_object)), '\\s+', ' ', 'g') ORDER BY claim_object, claim_subject, claim_predicate) AS rn FROM v_claims
 WHERE claim_type IS NOT NULL AND claim_type <> 'unresolved_question' AND (evidence_type IS NULL OR evidence_type <> 'DFT')) q WHERE rn = 1""")
def _x2(spark, sf):
    return X.paper_claims(view(spark, sf, _CL)).select("source_doi", "claim_type",
                                                       "claim_subject", "claim_object")


@query("x3_paper_methods", """WITH m AS (SELECT source_doi, catalyst_system, preparation_method, row_number() OVER (PARTITION BY source_doi, lower(trim(coalesce(catalyst_system, ''))),
 regexp_replace(lower(trim(preparation_method)), '[-\\s]+', '-', 'g') ORDER BY catalyst_system NULLS FIRST, preparation_method) AS rn FROM v_claims WHERE preparation_method <> '')
SELECT source_doi, CASE WHEN catalyst_system IS NULL OR lower(catalyst_system) = 'unknown' THEN preparation_method ELSE catalyst_system || ': ' || preparation_method END AS line FROM m WHERE rn = 1""")
def _x3(spark, sf):
    return X.paper_methods(view(spark, sf, _CL))


@query("x3_paper_characterization", """SELECT DISTINCT source_doi, '**' || evidence_type || '**: ' || claim_subject || ' → ' || claim_object AS line FROM v_claims WHERE evidence_type = 'DFT'""")
def _x3b(spark, sf):
    return X.paper_characterization(view(spark, sf, _CL))


@query("x4_paper_notes", """WITH p AS (SELECT * FROM v_papers),
perf AS (SELECT DISTINCT source_doi, catalyst_system, metric FROM v_claims WHERE metric IS NOT NULL)
SELECT doi, 3 AS part, '| Catalyst | Conv% |' || chr(10) || '|---|---|' AS line FROM p WHERE doi IN (SELECT source_doi FROM perf)
UNION ALL SELECT source_doi, 4, '| ' || coalesce(catalyst_system, '') || ' | ' || CAST(CAST(round(metric) AS INT) AS STRING) || '.0 |' FROM perf
UNION ALL SELECT doi, 4, '_No quantitative performance data extracted._' FROM p WHERE doi NOT IN (SELECT source_doi FROM perf)
UNION ALL SELECT doi, 2, chr(10) || '## Catalytic Results' || chr(10) FROM p
UNION ALL SELECT doi, 5, chr(10) || '## Characterization' || chr(10) FROM p
UNION ALL SELECT doi, 9, chr(10) || '## Notes' || chr(10) FROM p""")
def _x4(spark, sf):
    return note_lines(spark, sf).filter("part in (2, 3, 4, 5, 9)").select("doi", "part", "line")


def note_lines(spark, sf):
    c = view(spark, sf, _CL)
    papers = view(spark, sf, "v_papers").withColumn("first_author", F.lit(None).cast("string")) \
        .withColumn("journal", F.lit("Journal of Catalysis"))
    return X.note_lines(papers, X.paper_performance(c, ["catalyst_system", "metric"], ["metric"]),
                        X.paper_claims(c), X.paper_methods(c), X.paper_characterization(c),
                        [("Catalyst", "catalyst_system", None), ("Conv%", "metric", 1)])


@query("x5_write_records", "SELECT unit_id, source_doi, metric, temperature_c FROM v_units")
def _x5(spark, sf):
    u = view(spark, sf, "v_units").select("unit_id", "source_doi", "metric", "temperature_c")
    path = X.write_records(u, shared_folder(spark), "units", "2024-01-31")
    return spark.read.schema(u.schema).json(path)


@query("x5_write_feature_matrix", """SELECT l_orderkey, l_linenumber, CAST(l_tax AS DOUBLE) AS tax, CAST(l_quantity AS DOUBLE) AS quantity, 'l_orderkey,l_linenumber,tax,quantity' AS header FROM lineitem""")
def _x5b(spark, sf):
    wide = sql(spark, sf, "SELECT CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_tax AS DOUBLE) AS tax, l_linenumber, l_orderkey FROM lineitem")
    path = f"{shared_folder(spark)}/matrix"
    X.write_feature_matrix(wide, path, ["l_orderkey", "l_linenumber"], ["tax", "missing", "quantity"])
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.withColumn("header", F.lit(",".join(back.columns)))


@query("x6_provenance_log", """SELECT doi, coalesce(title, '') AS title, oa_url IS NOT NULL AS success, CASE WHEN oa_url IS NOT NULL THEN 'openalex' ELSE 'skip:not_oa' END AS source,
 CASE WHEN oa_url IS NULL THEN 'queue' ELSE 'log' END AS sink, p, s, e FROM v_candidates""")
def _x6(spark, sf):
    c = view(spark, sf, "v_candidates")
    r = c.withColumn("success", F.col("oa_url").isNotNull()).withColumn(
        "source", F.when(F.col("success"), "openalex").otherwise("skip:not_oa")).withColumn(
        "error", F.lit(None).cast("string")).withColumn(
        "title", F.concat(F.col("title"), F.lit("")))
    log, queue = X.provenance_log(r.withColumn("doi", F.struct("doi", "p", "s", "e")))
    row = lambda df, sink: df.select("doi.doi", "title", "success", "source",
                                     F.lit(sink).alias("sink"), "doi.p", "doi.s", "doi.e")
    return row(log.filter("success"), "log").unionByName(row(queue, "queue"))


def _toy_reply(pdf: pd.DataFrame) -> pd.Series:
    """A stand-in for a caller's scorer: the score follows from the row, some replies are broken."""
    n = pdf["p_partkey"]
    return pd.Series(["no score" if v % 5 == 0 else
                      'ok {"relevance": %s, "reason": "r"}' % (v % 150 / 100) for v in n])


@query("u1_score_batches", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.5 WHEN p_partkey % 5 = 0 THEN NULL ELSE least(1.0, p_partkey % 150 / 100.0) END AS relevance FROM part""")
def _u1(spark, sf):
    p = view(spark, sf, "part").select("p_partkey", "p_name")
    cache = p.filter("p_partkey % 3 = 0").select("p_partkey", F.lit(0.5).alias("relevance"),
                                                 F.lit("cached").alias("relevance_reason"))
    scored, _ = U.score_batches(p, _toy_reply, cache, "p_partkey")
    return scored.select("p_partkey", "relevance")


def _toy_extract(pdf: pd.DataFrame) -> list:
    return [[{"word": w, "size": len(w)} for w in name.split()] + ["not an item"]
            for name in pdf["p_name"]]


@query("u2_extract_batches", """SELECT p_partkey, CAST(w.i AS INT) AS item_no, split_part(p_name, ' ', w.i + 1) AS word FROM part JOIN (SELECT 0 AS i UNION ALL SELECT 1) w ON true WHERE p_size > 10""")
def _u2(spark, sf):
    p = view(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return U.extract_batches(p, _toy_extract, ["p_partkey"], "word string, size int",
                             gate=p.filter("p_size > 10")).select("p_partkey", "item_no", "word")


@query("u5_strip_claims", "SELECT source_doi, catalyst_system, metric FROM v_claims")
def _u5(spark, sf):
    return X.strip_claims(view(spark, sf, _CL)).select("source_doi", "catalyst_system", "metric")


@query("t24_merge_lookups", """SELECT source_doi, ref_num, CASE WHEN CAST(ref_num AS INT) % 3 = 0 THEN 'new ' || ref_num ELSE citation_text END AS citation_text FROM v_refs""")
def _t24(spark, sf):
    old = view(spark, sf, "v_refs").select("source_doi", "ref_num", "citation_text")
    new = old.filter("CAST(ref_num AS INT) % 3 = 0").withColumn(
        "citation_text", F.concat(F.lit("new "), "ref_num"))
    return T.merge_lookups(old, new, ["source_doi", "ref_num"])


@query("t24_page_ranges", """SELECT p_partkey, array_to_string([p_size, p_size + 1, p_size + 2, 99], ',') AS pages FROM part""")
def _t24b(spark, sf):
    d = sql(spark, sf, "SELECT p_partkey, CAST(p_size AS STRING) || '-' || CAST(p_size + 2 AS STRING) || ', 99' AS r FROM part")
    return d.select("p_partkey", F.array_join(F.transform(
        T.expand_page_range(F.col("r")), lambda x: x.cast("string")), ",").alias("pages"))


@query("j3_reference_number", """SELECT unit_id, CASE WHEN source_reference IS NULL THEN NULL ELSE regexp_extract(source_reference, '[0-9]+') END AS n FROM v_units""")
def _j3b(spark, sf):
    u = units(spark, sf)
    return u.select("unit_id", TX.reference_number(F.col("source_reference")).alias("n"))
