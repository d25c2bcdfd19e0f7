"""Queries of the sources (S), incremental work (I) and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.ordering import first_by
from recordloom.plans.registry import query
from recordloom.plans.views import read, sql, view
from recordloom.sources import files as SF
from recordloom.sources import tables as ST
from recordloom.sources import units as SU
from recordloom.session import shared_folder
from recordloom.sources.pending import fresh_within, pending
from recordloom.streaming import ingest as I

_SLUG = "replace(source_doi, '/', '_')"


@query("s1_read_units", f"""SELECT unit_id, CASE WHEN substring(unit_id, 1, 1) = '1' THEN 'own/' || metal WHEN p.doi IS NOT NULL THEN p.doi
 ELSE source_doi END AS source_doi FROM v_units LEFT JOIN (SELECT doi FROM v_papers WHERE topic = 'topic_a') p ON p.doi = source_doi""")
def _s1(spark, sf):
    u = sql(spark, sf, f"""SELECT unit_id, {_SLUG} AS slug, CASE WHEN substring(unit_id, 1, 1) = '1' THEN 'own/' || metal
        WHEN substring(unit_id, 1, 1) = '2' THEN '' ELSE NULL END AS source_review_doi FROM v_units""")
    reg = sql(spark, sf, "SELECT replace(doi, '/', '_') AS slug, doi FROM v_papers WHERE topic = 'topic_a'")
    return SU.name_source(u, reg).select("unit_id", "source_doi")


@query("s1_read_json_units", "SELECT unit_id, source_doi, metric, metal FROM v_units")
def _s1b(spark, sf):
    folder = f"{shared_folder(spark)}/units"
    u = view(spark, sf, "v_units").select("unit_id", F.col("source_doi").alias("source_review_doi"), "metric", "metal")
    u.write.json(folder)
    return SU.read_units(spark, folder, u.schema, ".json").select("unit_id", "source_doi", "metric", "metal")


@query("s2_union_by_precedence", """WITH f AS (SELECT * FROM v_units WHERE metal = 'A' AND source_doi LIKE '%5'), w AS (SELECT * FROM v_units WHERE metal = 'N'), v AS (SELECT * FROM v_units WHERE metal = 'R')
SELECT unit_id, 'filtered' AS tool FROM f UNION ALL SELECT unit_id, 'raw' FROM w WHERE source_doi NOT IN (SELECT source_doi FROM f) UNION ALL SELECT unit_id, 'v2' FROM v""")
def _s2(spark, sf):
    u = view(spark, sf, "v_units").withColumn("slug", F.col("source_doi"))
    part = lambda c, t: u.filter(c).select("unit_id", "slug", F.lit(t).alias("tool"))
    return SU.union_by_precedence(part("metal = 'A' and source_doi like '%5'", "filtered"),
                                  part("metal = 'N'", "raw"), part("metal = 'R'", "v2")).drop("slug")


@query("s3_explode_tables", """SELECT 's' || CAST(row_ord % 49 AS STRING) || '::vision::t' || CASE WHEN row_ord < 10 THEN '00' WHEN row_ord < 100 THEN '0' ELSE '' END || CAST(row_ord AS STRING)
 || '::r00' || CAST(n AS STRING) AS row_id, caption, columns_json, CASE WHEN n = 1 THEN row_json ELSE '["x","y"]' END AS row_json
FROM v_table_rows JOIN (SELECT 1 AS n UNION ALL SELECT 2) k ON true""")
def _s3(spark, sf):
    t = sql(spark, sf, """SELECT 's' || CAST(row_ord % 49 AS STRING) AS slug, source_doi, row_ord AS line_no, CAST(NULL AS STRING) AS table_number, caption,
        from_json(columns_json, 'array<string>') AS columns, array(from_json(row_json, 'array<string>'), array('x', 'y')) AS rows, 1 AS source_page, 'm' AS model FROM v_table_rows""")
    return ST.explode_tables(t).select("row_id", "caption", "columns_json", "row_json")


@query("s4_explode_parsed_tables", """SELECT replace(doi, '/', '_') || '::docling::tbl' || CAST(o.o_orderkey AS STRING) || '::r001' AS row_id, doi AS source_doi,
 CASE WHEN paper_type = 'review' THEN NULL ELSE doi END AS primary_doi, '["' || o_orderpriority || '"]' AS row_json
FROM v_papers JOIN orders o ON doi = '10.' || CAST(1000 + o_custkey % 100 % 7 AS STRING) || '/s' || CAST(o_custkey % 100 AS STRING)
UNION ALL SELECT '10.77_x::docling::tbl' || CAST(o_orderkey AS STRING) || '::r001', '10.77/x', '10.77/x', '["' || o_orderpriority || '"]' FROM orders WHERE
 NOT EXISTS (SELECT 1 FROM v_papers WHERE doi = '10.' || CAST(1000 + o_custkey % 100 % 7 AS STRING) || '/s' || CAST(o_custkey % 100 AS STRING))""")
def _s4(spark, sf):
    papers = view(spark, sf, "v_papers")
    t = sql(spark, sf, """SELECT coalesce(p.doi, '10.77/x') AS doc, CAST(o_orderkey AS STRING) AS table_number, 'c' AS caption, array('h') AS headers,
        array(array(o_orderpriority)) AS rows, 1 AS page FROM orders LEFT JOIN v_papers p
        ON p.doi = '10.' || CAST(1000 + o_custkey % 100 % 7 AS STRING) || '/s' || CAST(o_custkey % 100 AS STRING)""")
    return ST.explode_parsed_tables(t, papers).select("row_id", "source_doi", "primary_doi",
                                                      "row_json")


@query("s5_number_supplements", """WITH t AS (SELECT p_partkey, p_partkey % 30 AS d, p_partkey % 4 AS f FROM part),
k AS (SELECT *, dense_rank() OVER (PARTITION BY d ORDER BY f) AS r FROM t WHERE f > 0)
SELECT p_partkey, 'S' || CASE WHEN r = 1 THEN '' ELSE CAST(r AS STRING) || '-' END || CAST(p_partkey AS STRING) AS table_number,
 '[SI] ' || CASE WHEN p_partkey % 5 = 0 THEN 'Table ' || CAST(p_partkey AS STRING) ELSE 'cap' END AS caption FROM k
UNION ALL SELECT p_partkey, CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN 'Table ' || CAST(p_partkey AS STRING) ELSE 'cap' END FROM t WHERE f = 0""")
def _s5(spark, sf):
    t = sql(spark, sf, """SELECT p_partkey, p_partkey % 30 AS doc, 'f' || CAST(p_partkey % 4 AS STRING) AS file, p_partkey % 4 > 0 AS is_supplement,
        p_partkey AS table_idx, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'cap' END AS caption FROM part""")
    return ST.number_supplements(t).select("p_partkey", "table_number", "caption")


@query("s6_replace_slice", """WITH n AS (SELECT DISTINCT source_doi, metal FROM v_units WHERE metric > 95)
SELECT unit_id, metric FROM v_units u WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source_doi = u.source_doi AND n.metal = u.metal)
UNION ALL SELECT unit_id, -metric FROM v_units WHERE metric > 95""")
def _s6(spark, sf):
    u = view(spark, sf, "v_units").select("unit_id", "source_doi", "metal", "metric")
    new = u.filter("metric > 95").withColumn("metric", -F.col("metric"))
    return SU.replace_slice(u, new, ["source_doi", "metal"]).select("unit_id", "metric")


@query("s7_coerce_unit_schema", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS methanol_conv_pct,
 CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN 40 + l_quantity * 20 BETWEEN 50 AND 850 THEN 40 + l_quantity * 20 END
      WHEN l_linenumber % 3 = 1 THEN CASE WHEN 190 + l_quantity * 10 > 200 AND round(190 + l_quantity * 10 - 273.15, 1) BETWEEN 50 AND 850 THEN round(190 + l_quantity * 10 - 273.15, 1) END END AS temperature_c,
 CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE round(l_quantity / 60, 3) END AS tos_h FROM lineitem""")
def _s7(spark, sf):
    u = sql(spark, sf, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS STRING) || '%' END AS methanol_conv_pct,
        CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS STRING) END AS methanol_conversion_pct,
        CASE WHEN l_linenumber % 3 = 0 THEN CAST(40 + l_quantity * 20 AS STRING) END AS temperature_c,
        CASE WHEN l_linenumber % 2 = 0 THEN 0.0D END AS tos_h,
        map('temperature_K', CASE WHEN l_linenumber % 3 = 1 THEN CAST(190 + l_quantity * 10 AS STRING) END,
            'time_on_stream_min', CAST(l_quantity AS STRING)) AS extra_fields FROM lineitem""")
    return SU.coerce_unit_schema(u).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                           "methanol_conv_pct", "temperature_c", "tos_h")


@query("s8_upsert_by_id", """SELECT k, l_orderkey, l_linenumber FROM (SELECT l_partkey AS k, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey
 ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) q WHERE rn = 1""")
def _s8(spark, sf):
    u = sql(spark, sf, "SELECT l_partkey AS k, l_orderkey, l_linenumber FROM lineitem")
    return SU.upsert_by_id(u, "k", ["l_orderkey", "l_linenumber"])


@query("s9_reassign_metric", """SELECT unit_id, CASE WHEN source_doi = '10.1001/s1' AND primary_doi IS NULL AND metric IS NOT NULL THEN metric ELSE temperature_c END AS temperature_c,
 CASE WHEN source_doi = '10.1001/s1' AND primary_doi IS NULL AND metric IS NOT NULL THEN NULL ELSE metric END AS metric FROM v_units""")
def _s9(spark, sf):
    u = view(spark, sf, "v_units")
    rule = (F.col("source_doi") == "10.1001/s1") & F.col("primary_doi").isNull()
    return SU.reassign_metric(u, "metric", "temperature_c", rule).select(
        "unit_id", "temperature_c", "metric")


@query("s10_evolve_schema", "SELECT unit_id, metric, CAST(NULL AS DOUBLE) AS catalyst_loading_g, CAST(NULL AS STRING) AS temperature_note FROM v_units")
def _s10(spark, sf):
    target = T.StructType([T.StructField("catalyst_loading_g", T.DoubleType()),
                           T.StructField("temperature_note", T.StringType()),
                           T.StructField("metric", T.DoubleType())])
    return SU.evolve_schema(view(spark, sf, "v_units").select("unit_id", "metric"), target)


@query("s11_latest_snapshot", """SELECT 'r_' || substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) || '.jsonl' AS path, o_orderkey FROM orders
WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)""")
def _s11(spark, sf):
    f = sql(spark, sf, "SELECT 'r_' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '.jsonl' AS path, o_orderkey FROM orders")
    return SF.latest_snapshot(f).drop("snapshot")


@query("s12_list_inputs", """WITH f AS (SELECT p_partkey, p_partkey % 300 AS d, p_partkey % 3 AS r, p_partkey % 7 = 0 AS s FROM part)
SELECT '10.9_d' || CAST(d AS STRING) AS slug, s AS supplement, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY d, s ORDER BY r,
 'root' || CAST(r AS STRING) || '/v' || CAST(p_partkey AS STRING)) AS rn FROM f) q WHERE s OR rn = 1""")
def _s12(spark, sf):
    f = sql(spark, sf, """SELECT 'root' || CAST(p_partkey % 3 AS STRING) || '/v' || CAST(p_partkey AS STRING) || '/10.9_d' || CAST(p_partkey % 300 AS STRING)
        || CASE WHEN p_partkey % 7 = 0 THEN '_SI' ELSE '' END || '.pdf' AS path, p_partkey FROM part""")
    return SF.list_inputs(f, ["root0", "root1", "root2"]).select("slug", "supplement", "p_partkey")


# slugs that hold the marks themselves, roots of which one begins like another, and files in an SI folder
_NAMED = """SELECT p_partkey, 'root' || CAST(p_partkey % 3 * 5 + 1 AS STRING) AS root, '10.9_' || CASE p_partkey % 4 WHEN 0 THEN 'silica' WHEN 1 THEN 'physics' WHEN 2 THEN 'support' ELSE 'plain' END
 || CAST(p_partkey % 100 AS STRING) AS slug, CASE p_partkey % 5 WHEN 0 THEN '_SI.pdf' WHEN 1 THEN '_si_001.docx' WHEN 2 THEN '.v2.pdf' ELSE '.pdf' END AS tail, p_partkey % 5 = 1 AS folder FROM part"""


@query("s12_named_inputs", f"""WITH f AS ({_NAMED}), g AS (SELECT *, p_partkey % 5 < 2 AS supplement, CASE root WHEN 'root1' THEN 0 WHEN 'root6' THEN 1 ELSE 2 END AS rk FROM f)
SELECT slug, supplement, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY slug, supplement ORDER BY CASE WHEN tail = '.pdf' THEN 0 ELSE 1 END, rk,
 root || '/v' || CAST(p_partkey AS STRING)) AS rn FROM g) q WHERE supplement OR rn = 1""")
def _s12b(spark, sf):
    f = sql(spark, sf, f"SELECT *, root || '/v' || CAST(p_partkey AS STRING) || CASE WHEN folder THEN '/SI/' ELSE '/' END || slug || tail AS path FROM ({_NAMED}) x")
    slugs = f.select("slug").distinct()
    return SF.list_inputs(f.drop("slug", "root", "tail", "folder"), ["root1", "root6", "root11"], slugs=slugs).select("slug", "supplement", "p_partkey")


@query("s13_stale_inputs", """SELECT p_partkey FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 17 = 0)""")
def _s13(spark, sf):
    files = sql(spark, sf, "SELECT p_partkey, 's' || CAST(p_partkey AS STRING) AS stem, p_name AS name, p_size AS mtime, p_partkey AS size FROM part")
    meta = sql(spark, sf, """SELECT 's' || CAST(p_partkey AS STRING) AS stem, p_name AS pdf_name, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS pdf_mtime,
        p_partkey AS pdf_size, CASE WHEN p_partkey % 13 = 0 THEN '1' ELSE '2' END AS version, 2.0D AS scale, p_partkey % 3 = 0 AS needs_artefact FROM part WHERE p_partkey % 10 <> 0""")
    art = sql(spark, sf, "SELECT 's' || CAST(p_partkey AS STRING) AS stem FROM part WHERE p_partkey % 17 <> 0")
    return SF.stale_inputs(files, meta, "2", 2.0, art).select("p_partkey")


@query("s14_docs_without_tables", """SELECT doi, paper_type FROM v_papers WHERE doi NOT IN (SELECT source_doi FROM v_units WHERE metric > 95 AND temperature_c > 445)""")
def _s14(spark, sf):
    return ST.docs_without_tables(view(spark, sf, "v_papers"), view(spark, sf, "v_units")
                                  .filter("metric > 95 and temperature_c > 445")).select("doi", "paper_type")


@query("s15_diagnose_docs", """SELECT doc_id AS doc, doc_id % 4 AS n_tables, length(text) AS md_len, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 ELSE 0 END AS pipe_rows, doc_id % 9 = 0 AS failed FROM documents""")
def _s15(spark, sf):
    d = sql(spark, sf, """SELECT doc_id AS doc, text, slice(array('a', 'b', 'c'), 1, CAST(doc_id % 4 AS INT)) AS tables,
        CASE WHEN doc_id % 9 = 0 THEN 'convert failed' END AS error FROM documents""")
    # pipe rows are added in front of the whole text; their length is taken off again
    pipes = F.when(F.col("doc") % 2 == 0, F.repeat(F.lit("|a|b|\n"), (F.col("doc") % 5).cast("int"))).otherwise(F.lit(""))
    d = d.withColumn("extra", F.length(pipes)).withColumn("md", F.concat(
        pipes, F.translate("text", "|", "/")))
    out = ST.diagnose_docs(d)
    return out.join(d.select("doc", "extra"), "doc").select(
        "doc", F.col("n_tables").cast("long").alias("n_tables"),
        (F.col("md_len") - F.col("extra")).cast("long").alias("md_len"),
        F.col("pipe_rows").cast("long").alias("pipe_rows"), "failed")


@query("i1_pending_work", """SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def _i1(spark, sf):
    done = sql(spark, sf, "SELECT l_partkey AS p_partkey, CASE WHEN l_quantity <= 48 THEN 'failed' END AS error FROM lineitem")
    return pending(view(spark, sf, "part"), done, ["p_partkey"]).select("p_partkey")


@query("i2_fresh_within", """SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def _i2(spark, sf):
    e = view(spark, sf, "events")
    now = e.agg(F.max(F.col("ts").cast("timestamp")).cast("string").alias("now")).first()["now"]
    return fresh_within(e, "ts", F.lit(now), 24.0).select("event_id")


@query("i3_ingest_stream", """SELECT 'p' || CAST(p_partkey % 49 AS STRING) || '::docling::tbl' || CAST(p_partkey AS STRING) || '::r001' AS row_id,
 'p' || CAST(p_partkey % 49 AS STRING) AS source_doi, '["' || p_name || '"]' AS row_json FROM part""")
def _i3(spark, sf):
    base = shared_folder(spark)
    t = sql(spark, sf, """SELECT 'p' || CAST(p_partkey % 49 AS STRING) AS doc, CAST(p_partkey AS STRING) AS table_number, 'cap' AS caption, array('h') AS headers,
        array(array(p_name)) AS rows, 1 AS page FROM part""")
    t.repartition("doc").write.json(f"{base}/in")
    papers = view(spark, sf, "v_papers")
    I.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", papers).awaitTermination()
    return I.current_slices(spark, f"{base}/out").select("row_id", "source_doi", "row_json")


@query("i4_candidate_stream", """SELECT DISTINCT user_id FROM events""")
def _i4(spark, sf):
    base = shared_folder(spark)
    schema = read(spark, sf, "events").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf).select(F.col("user_id"), "ts"))
    one = I.candidate_stream(stream, "user_id", "ts", "3650 days")
    (one.writeStream.format("parquet").option("path", f"{base}/out")
     .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
     .awaitTermination())
    return spark.read.parquet(f"{base}/out").select("user_id")


@query("i4_merge_stream", """SELECT user_id, max(value) AS best, count(*) AS n FROM events GROUP BY user_id""")
def _i4b(spark, sf):
    base = shared_folder(spark)
    schema = read(spark, sf, "events").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(sf).select("user_id", F.col("value").alias("best"),
                                  F.lit(1).cast("long").alias("n")))

    def merge(df):
        return df.groupBy("user_id").agg(F.max("best").alias("best"), F.sum("n").alias("n"))

    I.merge_stream(stream, f"{base}/out", f"{base}/ck", merge).awaitTermination()
    return merge(spark.read.parquet(f"{base}/out").drop("batch_id"))


@query("w5_first_occurrence", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) q WHERE rn = 1""")
def _w5(spark, sf):
    return first_by(view(spark, sf, "events"), ["user_id", "event_type"],
                    [F.col("event_id")]).select("user_id", "event_type", "event_id")
