"""Views over the given tables that have the shapes the operators take.

Each text runs unchanged in Spark and in an ANSI engine, so a query and its check start alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["v_papers"] = """
SELECT '10.' || CAST(1000 + s_suppkey % 7 AS STRING) || '/s' || CAST(s_suppkey AS STRING) AS doi,
       s_name AS title, CAST(1990 + s_suppkey % 35 AS INT) AS year,
       CASE WHEN s_nationkey % 2 = 0 THEN 'topic_a' ELSE 'topic_b' END AS topic,
       CASE WHEN s_suppkey % 8 = 0 THEN 'review' ELSE 'primary' END AS paper_type
FROM supplier"""

VIEWS["v_table_rows"] = """
SELECT 'p' || CAST(p_partkey % 49 AS STRING) || '::t' || CAST(p_partkey % 5 AS STRING)
         || '::r' || CAST(p_partkey AS STRING) AS row_id,
       'p' || CAST(p_partkey % 49 AS STRING) AS source_doi,
       CASE p_partkey % 5 WHEN 0 THEN 'Textural properties' WHEN 1 THEN 'Catalytic performance'
                          WHEN 2 THEN 'Acid properties' WHEN 3 THEN 'Untitled' ELSE 'Summary' END AS caption,
       CASE p_partkey % 5 WHEN 0 THEN '["Entry","Sample","S_BET [m2/g]","Pore volume [cm3/g]"]'
                          WHEN 1 THEN '["Catalyst","T / K","Conversion (%)[a]","Ref."]'
                          WHEN 2 THEN '["Sample","Total acid [mmol/g]","Strong acid"]'
                          WHEN 3 THEN '["0","1","2"]'
                          ELSE '["Property","small ring","red widget"]' END AS columns_json,
       CASE p_partkey % 5
         WHEN 0 THEN '["' || CAST(p_partkey AS STRING) || '","' || p_name || '","'
                       || CAST(p_size * 11 AS STRING) || '","'
                       || CASE WHEN p_size % 5 = 0 THEN 'n.d.' ELSE '0.' || CAST(p_size AS STRING) END || '"]'
         WHEN 1 THEN '["' || p_name || '","' || CAST(573 + p_size AS STRING) || '","'
                       || CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS STRING) || '-' || CAST(p_size + 10 AS STRING)
                               ELSE '~' || CAST(p_size AS STRING) END || '","[' || CAST(p_size % 30 AS STRING) || ']"]'
         WHEN 2 THEN '["' || p_name || '","' || CAST(p_size AS STRING) || '"]'
         WHEN 3 THEN '["' || p_name || '","1","' || CAST(p_size AS STRING) || '"]'
         ELSE '["' || CASE p_partkey % 20 WHEN 4 THEN 'BET surface area (m2/g)' WHEN 9 THEN 'Pore volume'
                                          WHEN 14 THEN 'Total acidity' ELSE 'Selectivity (%)' END
                || '","' || CAST(p_size AS STRING) || '","' || CAST(p_size + 1 AS STRING) || '"]' END AS row_json,
       p_partkey AS row_ord
FROM part"""

VIEWS["v_units"] = """
SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING)
         || ':' || CAST(l_suppkey AS STRING) || ':' || CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS STRING) AS unit_id,
       '10.' || CAST(1000 + l_suppkey % 7 AS STRING) || '/s' || CAST(l_suppkey AS STRING) AS source_doi,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL
            ELSE '10.' || CAST(1000 + (l_suppkey + l_linenumber) % 7 AS STRING) || '/s'
                 || CAST(l_suppkey + l_linenumber AS STRING) END AS primary_doi,
       CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'Ref. [' || CAST(l_partkey % 60 AS STRING) || ']' END AS source_reference,
       l_returnflag AS metal, l_linestatus AS support,
       CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount * 1000 END AS metric,
       CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE 200 + l_quantity * 5 END AS temperature_c,
       l_tax * 50 AS pressure_mpa
FROM lineitem"""

VIEWS["v_refs"] = """
SELECT '10.' || CAST(1000 + sk % 7 AS STRING) || '/s' || CAST(sk AS STRING) AS source_doi,
       CAST(n AS STRING) AS ref_num,
       CASE WHEN n % 4 = 0 THEN NULL ELSE '10.9/r' || CAST(n AS STRING) END AS doi,
       CASE WHEN n % 5 = 0 THEN 0.4 ELSE 0.95 END AS score,
       CASE WHEN n % 6 = 0 THEN '' ELSE 'Citation ' || CAST(n AS STRING) END AS citation_text
FROM (SELECT DISTINCT l_suppkey AS sk, l_partkey % 60 AS n FROM lineitem) x"""

VIEWS["v_edges"] = """
SELECT DISTINCT l_suppkey AS src, l_partkey AS dst,
       CASE l_returnflag WHEN 'A' THEN 'references' WHEN 'N' THEN 'citations' ELSE 'recommendation' END AS kind
FROM lineitem"""

VIEWS["v_words"] = """
SELECT p_partkey % 40 AS doc, p_partkey % 4 AS page,
       CASE WHEN p_partkey % 3 = 0 THEN '[' || CAST(p_partkey % 97 AS STRING) || ']' ELSE p_name END AS text,
       CAST(p_partkey % 9 AS DOUBLE) AS x0, CAST(p_size * 12 AS DOUBLE) AS top, CAST(p_size * 12 + 9 AS DOUBLE) AS bottom
FROM part"""

VIEWS["v_links"] = """
SELECT p_partkey % 40 AS doc, p_partkey % 4 AS page, '10.9/l' || CAST(p_partkey AS STRING) AS link_id,
       CAST(p_size * 12 AS DOUBLE) AS top, CAST(p_size * 12 + 9 AS DOUBLE) AS bottom
FROM part WHERE p_partkey % 11 = 0"""

VIEWS["v_figs"] = """
SELECT 'p' || CAST(p_partkey % 49 AS STRING) AS doc, 'fig' || CAST(p_partkey AS STRING) AS figure,
       CASE p_partkey % 4 WHEN 0 THEN 'Effect of loading on conversion of ' || p_name
                          WHEN 1 THEN 'XRD patterns of ' || p_name
                          WHEN 2 THEN 'Product distribution over ' || p_name || ', selectivity'
                          ELSE 'Scheme of ' || p_name END AS caption
FROM part"""

VIEWS["v_points"] = """
SELECT user_id AS image, event_type AS series, event_id AS pt, CAST(event_id % 500 AS DOUBLE) AS px, value AS py
FROM events"""

# prose of many documents: one chunk per order, ten kinds of sentence
VIEWS["v_prose"] = """
SELECT 'c' || CAST(o_custkey % 150 AS STRING) AS doc, CAST(o_orderkey AS INT) AS page, 1 AS chunk_no,
       'c' || CAST(o_custkey % 150 AS STRING) || '::p' || CAST(o_orderkey AS STRING) || '::c01' AS chunk_id,
       CASE WHEN o_custkey % 150 % 4 = 0 THEN 'review' ELSE 'primary' END AS paper_type,
       CASE o_orderkey % 10
         WHEN 0 THEN '2. Experimental. The catalyst was calcined at 550 °C for 4 h, then tested at '
                  || CAST(300 + o_custkey % 9 * 10 AS STRING) || ' °C and ' || CAST(1 + o_custkey % 4 AS STRING) || ' MPa.'
         WHEN 1 THEN 'The reaction was carried out at ' || CAST(310 + o_custkey % 7 * 10 AS STRING)
                  || ' °C, WHSV of ' || CAST(1 + o_orderkey % 3 AS STRING) || ' h-1, at ' || CAST(10 + o_custkey % 5 AS STRING) || ' bar.'
         WHEN 2 THEN 'Smith et al. reported a CO2 conversion of ' || CAST(5 + o_orderkey % 60 AS STRING) || ' % and '
                  || CAST(10 + o_orderkey % 80 AS STRING) || '% selectivity to methanol over Cu/ZnO ['
                  || CAST(1 + o_orderkey % 40 AS STRING) || ',' || CAST(50 + o_orderkey % 9 AS STRING) || '-'
                  || CAST(52 + o_orderkey % 9 AS STRING) || '].'
         WHEN 3 THEN 'Abstract This work studies methanol aromatization; GHSV = 12,000 mL and catalyst loading of 0.5 g.'
         WHEN 4 THEN '1. Introduction Many authors found coke and observed deactivation, Ref. '
                  || CAST(1 + o_orderkey % 70 AS STRING) || '.'
         WHEN 5 THEN 'The reactor was loaded with ' || CAST(1 + o_custkey % 3 AS STRING) || ' g of catalyst at '
                  || CAST(600 + o_custkey % 50 AS STRING) || ' K.'
         WHEN 6 THEN '(' || CAST(1 + o_orderkey % 90 AS STRING) || ') Adams, B. C.; Clark, D. et al. First long title here. J. Catal. 2018, 1.' || chr(10)
                  || '(' || CAST(2 + o_orderkey % 90 AS STRING) || ') Baker, E. F.; Davis, G. et al. Second long title here. J. Catal. 2019, 2.' || chr(10)
                  || '(' || CAST(3 + o_orderkey % 90 AS STRING) || ') Evans, H. I.; Ghosh, J. Third long title here. J. Catal. 2020, 3.' || chr(10)
                  || '(' || CAST(4 + o_orderkey % 90 AS STRING) || ') Irwin, K. L.; Jones, M. Fourth long title here. J. Catal. 2021, 4.'
         WHEN 7 THEN 'Results and discussion The yield was ' || CAST(o_orderkey % 90 AS STRING) || ' % at '
                  || CAST(320 + o_custkey % 5 * 10 AS STRING) || ' °C and the selectivity was observed.'
         WHEN 8 THEN 'Table ' || CAST(1 + o_orderkey % 8 AS STRING) || ' lists K-Cu-Fe/ZnO-Al2O3 and Pd/CeO2 with 25 nm size.'
         ELSE '3.' || CAST(1 + o_orderkey % 5 AS STRING) || ' Catalyst testing' END AS text
FROM orders"""

# text pages: the documents of one source are its pages, every line a paragraph of its own
VIEWS["v_pages"] = """
SELECT source AS slug, CAST(doc_id AS INT) AS page, replace(text, chr(10), chr(10) || chr(10)) AS text
FROM documents"""

# candidates, several sightings per id
VIEWS["v_candidates"] = """
SELECT '10.5/c' || CAST(l_partkey % 900 AS STRING) AS doi, l_orderkey AS seen, l_linenumber AS line,
       CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'Title ' || CAST(l_partkey % 900 AS STRING) || ' v' || CAST(l_suppkey % 5 AS STRING) END AS title,
       CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 'Venue ' || CAST(l_suppkey % 6 AS STRING) END AS venue,
       CASE WHEN l_orderkey % 5 < 3 THEN NULL ELSE 'Abstract ' || CAST(l_orderkey AS STRING) END AS abstract,
       CASE WHEN l_orderkey % 7 < 5 THEN NULL ELSE 'http://x/' || CAST(l_orderkey AS STRING) END AS oa_url,
       CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(1990 + l_suppkey % 30 AS INT) END AS year,
       CAST(l_quantity AS INT) AS citation_count, CAST(floor(l_quantity / 10) AS INT) AS influential_citation_count,
       l_linestatus = 'O' AS is_open_access, l_returnflag AS tag,
       l_partkey AS p, l_suppkey AS s, l_extendedprice AS e
FROM lineitem"""

# claims and preparation lines of papers
VIEWS["v_claims"] = """
SELECT '10.' || CAST(1000 + l_suppkey % 7 AS STRING) || '/s' || CAST(l_suppkey AS STRING) AS source_doi,
       CASE l_linenumber % 4 WHEN 0 THEN 'mechanism' WHEN 1 THEN 'performance' WHEN 2 THEN 'unresolved_question' ELSE NULL END AS claim_type,
       'catalyst ' || l_returnflag AS claim_subject, 'shows' AS claim_predicate,
       CASE WHEN l_partkey % 2 = 0 THEN 'High  Yield ' ELSE 'high yield ' END || CAST(l_partkey % 20 AS STRING) AS claim_object,
       CASE l_orderkey % 3 WHEN 0 THEN 'DFT' WHEN 1 THEN 'experiment' ELSE NULL END AS evidence_type,
       CASE l_partkey % 3 WHEN 0 THEN 'Ion exchange' WHEN 1 THEN 'ion-exchange' ELSE '' END AS preparation_method,
       CASE l_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE 'Zn/' || l_returnflag END AS catalyst_system,
       CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount * 1000 END AS metric
FROM lineitem"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _used(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a text over the given tables and the views above."""
    views = _used(text, VIEWS)
    needed = set(_used(text, TABLES))
    for v in views:
        needed |= set(_used(VIEWS[v], TABLES))
    for t in needed:
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(with_views(text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {name}")


def with_views(text: str) -> str:
    """Prefix a text with the views it names."""
    views = _used(text, VIEWS)
    if not views:
        return text
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = text.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
