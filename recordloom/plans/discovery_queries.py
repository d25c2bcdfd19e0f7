"""Queries of discovery over the citation graph (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import discovery as D
from recordloom.plans.linkage_queries import _IMPACT, _TIER, _VENUE
from recordloom.plans.registry import query
from recordloom.plans.views import sql, view

YEAR = 2026


@query("d1_flatten_openalex", """SELECT o_orderkey, '10.1/w' || CAST(o_orderkey AS STRING) AS doi, o_orderpriority AS title, CAST(1990 + o_custkey % 30 AS INT) AS year, 'V' || o_orderstatus AS venue,
 'A1,A2,A3,A4,A5,A6' AS authors, 'hello big world' AS abstract, CAST(o_custkey AS INT) AS citation_count, o_orderkey % 2 = 0 AS is_open_access, 'openalex:x' AS source FROM orders WHERE o_orderkey % 9 <> 0""")
def _d1(spark, sf):
    w = sql(spark, sf, """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'https://doi.org/10.1/W' || CAST(o_orderkey AS STRING) END AS doi, o_orderpriority AS title,
        CAST(1990 + o_custkey % 30 AS INT) AS publication_year, named_struct('source', named_struct('display_name', 'V' || o_orderstatus)) AS primary_location,
        transform(array('A1','A2','A3','A4','A5','A6'), x -> named_struct('author', named_struct('display_name', x))) AS authorships,
        map('world', array(2), 'hello', array(0), 'big', array(1)) AS abstract_inverted_index, CAST(o_custkey AS INT) AS cited_by_count,
        named_struct('is_oa', o_orderkey % 2 = 0, 'oa_url', CAST(NULL AS STRING)) AS open_access FROM orders""")
    f = D.flatten_openalex(w, "openalex:x")
    return f.select(F.regexp_extract("doi", r"(\d+)$", 1).cast("long").alias("o_orderkey"), "doi",
                    "title", "year", "venue", F.array_join("authors", ",").alias("authors"),
                    "abstract", "citation_count", "is_open_access",
                    F.array_join("source", ",").alias("source"))


@query("d1_flatten_s2", """SELECT '10.2/w' || CAST(o_orderkey AS STRING) AS doi, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS venue, 'B1,B2' AS authors,
 CAST(o_custkey AS INT) AS citation_count, CAST(3 AS INT) AS influential_citation_count, 'http://p' AS oa_url FROM orders""")
def _d1b(spark, sf):
    p = sql(spark, sf, """SELECT named_struct('DOI', 'DOI:10.2/W' || CAST(o_orderkey AS STRING)) AS externalIds, o_orderpriority AS title, CAST(2000 AS INT) AS year,
        named_struct('name', CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END) AS journal, transform(array('B1','B2'), x -> named_struct('name', x)) AS authors,
        CAST(NULL AS STRING) AS abstract, CAST(o_custkey AS INT) AS citationCount, CAST(3 AS INT) AS influentialCitationCount, true AS isOpenAccess,
        named_struct('url', 'http://p') AS openAccessPdf FROM orders""")
    return D.flatten_s2(p, "s2").select(
        "doi", "title", "venue", F.array_join("authors", ",").alias("authors"), "citation_count",
        "influential_citation_count", "oa_url")


@query("d2_expand_seeds", """SELECT src AS seed, dst, kind, CAST(1 AS INT) AS hop FROM (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY dst) AS rn FROM v_edges
 WHERE kind <> 'recommendation' AND src % 10 = 3) q WHERE rn <= 30""")
def _d2(spark, sf):
    e = view(spark, sf, "v_edges")
    return D.expand_seeds(e.filter("src % 10 = 3").select(F.col("src").alias("id")), e)


@query("d2_expand_two_hops", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY dst) AS rn FROM v_edges WHERE kind <> 'recommendation'),
a AS (SELECT src AS seed, dst, kind, CAST(1 AS INT) AS hop FROM e WHERE rn <= 5 AND src % 10 = 3)
SELECT * FROM a UNION ALL SELECT src, dst, kind, CAST(2 AS INT) FROM e WHERE rn <= 5 AND src IN (SELECT dst FROM a)""")
def _d2b(spark, sf):
    e = view(spark, sf, "v_edges")
    return D.expand_seeds(e.filter("src % 10 = 3").select(F.col("src").alias("id")), e, 5, hops=2)


@query("d2_recommendations", """SELECT DISTINCT dst FROM v_edges WHERE kind = 'recommendation' AND src IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5) ORDER BY dst LIMIT 50""")
def _d2c(spark, sf):
    s = view(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return D.recommendations(s, view(spark, sf, "v_edges"))


_ORD = "seen, line, p, s, e"
_FIRST = lambda c, cond: f"(array_agg({c} ORDER BY {_ORD}) FILTER (WHERE {cond}))[1] AS {c}"


@query("d3_merge_candidates", f"""SELECT doi, {_FIRST('title', "title <> ''")}, {_FIRST('venue', 'venue IS NOT NULL')}, {_FIRST('abstract', 'abstract IS NOT NULL')},
 {_FIRST('oa_url', 'oa_url IS NOT NULL')}, {_FIRST('year', 'year IS NOT NULL')}, max(citation_count) AS citation_count, max(influential_citation_count) AS influential_citation_count,
 bool_or(is_open_access) AS is_open_access FROM v_candidates GROUP BY doi""")
def _d3(spark, sf):
    return _merged(spark, sf).drop("source", "authors")


def _merged(spark, sf):
    c = view(spark, sf, "v_candidates").withColumn("authors", F.array(F.lit("A"))).withColumn(
        "source", F.array("tag"))
    return D.merge_candidates(c, ["seen", "line", "p", "s", "e"])


@query("d3_source_tags", """WITH f AS (SELECT doi, tag, min(seen * 10 + line) AS o FROM v_candidates GROUP BY doi, tag) SELECT doi, string_agg(tag, '|' ORDER BY o, tag) AS tags FROM f GROUP BY doi""")
def _d3b(spark, sf):
    c = view(spark, sf, "v_candidates").withColumn("o", F.expr("seen * 10 + line"))
    return D.ordered_tags(c, "doi", "tag", ["o"])


@query("d3_enrich_candidates", f"""WITH m AS (SELECT doi, {_FIRST('title', "title <> ''")}, {_FIRST('venue', 'venue IS NOT NULL')}, max(citation_count) AS citation_count FROM v_candidates GROUP BY doi)
SELECT doi, coalesce(title, 'Extra') AS title, coalesce(venue, 'Extra venue') AS venue, greatest(citation_count, 30) AS citation_count FROM m""")
def _d3c(spark, sf):
    m = _merged(spark, sf)
    extra = m.select("doi", F.lit("Extra").alias("title"), F.lit("Extra venue").alias("venue"),
                     F.lit("x").alias("abstract"), F.lit("http://e").alias("oa_url"),
                     F.lit(2000).alias("year"), F.array(F.lit("Z")).alias("authors"),
                     F.lit(30).alias("citation_count"), F.lit(True).alias("is_open_access"),
                     F.array(F.lit("enrich")).alias("source"))
    return D.enrich_candidates(m, extra).select("doi", "title", "venue", "citation_count")


@query("d4_novel_only", """SELECT doi, seen, line FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY seen, line, p, s, e) AS rn FROM v_candidates
 WHERE doi NOT IN (SELECT '10.5/c' || CAST(s_suppkey AS STRING) FROM supplier)) q WHERE rn = 1""")
def _d4(spark, sf):
    known = sql(spark, sf, "SELECT ' 10.5/C' || CAST(s_suppkey AS STRING) AS doi FROM supplier")
    return D.novel_only(view(spark, sf, "v_candidates"), known, "doi",
                        ["seen", "line", "p", "s", "e"]).select("doi", "seen", "line")


@query("d5_cap_by", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 100")
def _d5(spark, sf):
    return D.cap_by(view(spark, sf, "orders"), "o_custkey", 100, "o_orderkey").select(
        "o_orderkey", "o_custkey")


@query("d6_rank_candidates", f"""WITH m AS (SELECT doi, max(citation_count) AS c, max(influential_citation_count) AS i, {_FIRST('year', 'year IS NOT NULL')} FROM v_candidates GROUP BY doi)
SELECT doi, round(i * 2 + c * 0.1 + 100.0 / greatest(1, {YEAR} - coalesce(year, {YEAR} - 30) + 1), 4) AS fallback_score FROM m""")
def _d6(spark, sf):
    return D.rank_candidates(_merged(spark, sf), YEAR).select("doi", "fallback_score")


@query("d6_rank_by_relevance", """SELECT doi, CASE WHEN CAST(substring(doi, 7) AS INT) % 4 = 0 THEN NULL ELSE round(CAST(substring(doi, 7) AS INT) % 100 / 100.0, 4) END AS relevance
FROM (SELECT DISTINCT doi FROM v_candidates) q""")
def _d6b(spark, sf):
    return D.rank_candidates(_scored(spark, sf)).select("doi", "relevance")


def _scored(spark, sf):
    n = F.substring("doi", 7, 9).cast("int")
    return _merged(spark, sf).withColumn("relevance", F.when(n % 4 != 0, n % 100 / F.lit(100.0))) \
        .withColumn("relevance_reason", F.when(n % 4 != 0, F.lit("fits")))


@query("d7_shortlist", f"""WITH m AS (SELECT doi, CAST(substring(doi, 7) AS INT) AS n, {_FIRST('title', "title <> ''")}, {_FIRST('venue', 'venue IS NOT NULL')}, {_FIRST('abstract', 'abstract IS NOT NULL')},
 {_FIRST('oa_url', 'oa_url IS NOT NULL')}, {_FIRST('year', 'year IS NOT NULL')}, max(citation_count) AS c, bool_or(is_open_access) AS oa FROM v_candidates GROUP BY doi)
SELECT doi, '## [' || CASE WHEN n % 4 = 0 THEN '—' ELSE printf('%.2f', n % 100 / 100.0) END || '] ' || coalesce(title, '(untitled)') || CASE WHEN oa OR oa_url IS NOT NULL THEN ' 🔓' ELSE '' END || chr(10)
 || '`' || doi || '` · https://doi.org/' || doi || '  ·  ' || concat_ws(' · ', venue, CAST(year AS STRING), CASE WHEN c > 0 THEN CAST(c AS STRING) || ' cit' END)
 || CASE WHEN n % 4 <> 0 THEN chr(10) || '> fits' ELSE '' END || CASE WHEN abstract IS NOT NULL THEN chr(10) || chr(10) || abstract ELSE '' END AS block
FROM m WHERE n % 4 = 0 OR n % 100 / 100.0 >= 0.4""")
def _d7(spark, sf):
    return D.shortlist(_scored(spark, sf), 0.4).select("doi", "block")


@query("d7_shortlist_header", """WITH m AS (SELECT DISTINCT CAST(substring(doi, 7) AS INT) AS n FROM v_candidates)
SELECT '# Discovery shortlist — q' || chr(10) || chr(10) || '*' || CAST(count(*) AS STRING) || ' papers (relevance ≥ 0.40), sorted by relevance.*' AS header FROM m WHERE n % 4 = 0 OR n % 100 / 100.0 >= 0.4""")
def _d7b(spark, sf):
    return D.shortlist_header(D.shortlist(_scored(spark, sf), 0.4), "q", 0.4)


@query("d8_screen_search", f"""WITH v AS ({_VENUE}), t AS (SELECT v.*, {_TIER} AS if_tier, {_IMPACT} AS if_approx FROM v)
SELECT o_orderkey, citations, if_tier, if_approx FROM t WHERE year >= 2000 AND citations >= 100 AND if_tier IN ('S', 'A', 'B')""")
def _d8(spark, sf):
    w = sql(spark, sf, _VENUE).withColumn("doi", F.col("o_orderkey"))
    return D.screen_search(w, 2000, 100).select("o_orderkey", "citations", "if_tier", "if_approx")


@query("d9_screen_rules", """SELECT p_partkey, least(p_size, 40) + least(p_size, 20) + 10 + 5 + CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END AS score, p_partkey % 3 = 0 OR p_size >= 5 AS core,
 CASE WHEN least(p_size, 40) + least(p_size, 20) + 15 + CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END >= 80 THEN 'priority_read' WHEN least(p_size, 40) + least(p_size, 20) + 15 + CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END >= 65 THEN 'core_include'
 WHEN least(p_size, 40) + least(p_size, 20) + 15 + CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END >= 50 THEN 'supplement_include' ELSE 'exclude' END AS band FROM part WHERE p_partkey % 5 < 3""")
def _d9(spark, sf):
    d = sql(spark, sf, """SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN 'CO2 hydrogenation to methane' WHEN 4 THEN 'pure CO2 electroreduction, CO2 hydrogenation to ethanol' ELSE 'CO2 Hydrogenation to Ethanol ' || p_name END AS text,
        'article' AS doc_type, CAST(p_size AS DOUBLE) AS impact, 1 AS citations, CASE WHEN p_partkey % 3 = 0 THEN 2025 ELSE 2010 END AS year, p_size AS topic, p_size AS journal, 10 AS citation, 5 AS mechanism FROM part""")
    return D.screen_rules(d, YEAR).select("p_partkey", "score", "core", "band")


@query("d10_collect_resolved_ids", """SELECT doi, min(o) AS o FROM (SELECT doi, CAST(ref_num AS INT) AS o FROM v_refs WHERE doi IS NOT NULL) q GROUP BY doi""")
def _d10(spark, sf):
    r = view(spark, sf, "v_refs").withColumn("o", F.col("ref_num").cast("int"))
    return D.collect_resolved_ids(r, ["o"])


@query("d11_triage_summary", """SELECT CASE WHEN abstract IS NULL OR seen % 11 = 0 THEN 'low' WHEN seen % 2 = 0 THEN 'high' ELSE 'medium' END AS priority,
 CASE WHEN abstract IS NULL THEN 'review/perspective' WHEN seen % 11 = 0 THEN 'unrelated' ELSE tag END AS label, count(*) AS n, min(doi) AS first_doi FROM v_candidates GROUP BY 1, 2""")
def _d11(spark, sf):
    c = view(spark, sf, "v_candidates").withColumn("label", F.col("tag")).withColumn(
        "failed", F.col("seen") % 11 == 0).withColumn("priority", F.when(
            F.col("seen") % 2 == 0, "high").otherwise("medium"))
    return D.triage_summary(c)
