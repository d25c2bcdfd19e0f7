"""Record assembly, streams, exports, plans, and queries against their SQL."""

import json
import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import normal, rows
from recordloom.functions.attributes import AttributeLibrary
from recordloom.operators import export as X
from recordloom.operators import modeling as M
from recordloom.operators import records as R
from recordloom.operators import scoring as U
from recordloom.operators.figures import type_captions
from recordloom.operators.linkage import match_labels_in_captions, overlay_passes
from recordloom.operators.tables import melt_tables, table_to_units
from recordloom.plans import linkage_queries, table_queries
from recordloom.plans.views import TABLES, view
from recordloom.sources import files as SF
from recordloom.sources import units as SU
from recordloom.streaming import ingest as I

SMALL = "/root/testdata/sf0.001"


def test_records_do_not_depend_on_row_placement(spark):
    base = table_queries.table_rows(spark, SMALL)
    def run(df):
        a = R.record_attributes(melt_tables(df))
        return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str)
                      for r in R.assemble_records(a).collect())
    assert run(base) == run(base.orderBy(F.rand(3)).repartition(7))


def test_library_from_json(tmp_path):
    raw = {"column_patterns": [{"attr": "mass", "unit": "kg", "patterns": ["weight", "mass"]}],
           "catalyst_id_headers": ["item"], "reference_headers": ["ref"], "skip_headers": ["no"],
           "table_type_keywords": {"size": ["weight"]}}
    path = tmp_path / "lib.json"
    path.write_text(json.dumps(raw))
    assert AttributeLibrary.from_json(str(path)).patterns == [("mass", "weight"), ("mass", "mass")]


def test_overlay_alignment(spark):
    def df(rows, field):
        return spark.createDataFrame(rows, f"chunk_id string, ord int, name string, {field} int")
    p1 = spark.createDataFrame([("c", 1, "Cu"), ("c", 2, "Zn")], "chunk_id string, ord int, name string")
    p2 = df([("c", 1, "cu", 10), ("c", 2, "CU", 11), ("c", 3, "Fe", 12), ("c", 4, None, 13)], "conv")
    p3 = df([("c", 1, "zn", 1), ("c", 2, "Mo", 2)], "temp")
    got = sorted((r["kind"], r["name"] or "", r["conv"], r["temp"]) for r in overlay_passes(
        p1, p2, p3, ["conv"], ["temp"]).collect())
    # Cu takes both of its own; Zn falls back to the unnamed one, which stays an orphan as well
    assert got == [("base", "Cu", 10, None), ("base", "Cu", 11, None), ("base", "Zn", 13, 1),
                   ("p2_only", "", 13, None), ("p2_only", "Fe", 12, None), ("p3_only", "Mo", None, 2)]


def test_overlay_deals_records_over_more_tasks(spark, monkeypatch):
    """Tasks of the overlay grow in number with its records, also where orders pass a block."""
    from recordloom.operators import linkage

    monkeypatch.setattr(linkage, "_OVERLAY_ROWS", 100, raising=False)
    p1 = spark.range(300).select(F.concat(F.lit("c"), F.col("id")).alias("chunk_id"), F.lit(1).alias("ord"), F.lit("Cu").alias("name"))
    many = spark.range(9000).select(F.lit("c7").alias("chunk_id"), (F.col("id") + 1).cast("int").alias("ord"), F.lit("CU").alias("name"))
    p2 = p1.filter("chunk_id <> 'c7'").union(many).withColumn("conv", F.col("ord"))
    p3 = p1.withColumn("temp", F.lit(5))
    df = overlay_passes(p1, p2, p3, ["conv"], ["temp"])
    assert max(int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan(df))) == 99
    got = df.collect()
    assert len(got) == 299 + 9000 and {r["kind"] for r in got} == {"base"}
    assert sorted(r["conv"] for r in got if r["chunk_id"] == "c7") == list(range(1, 9001))
    assert [r["temp"] for r in got if r["chunk_id"] == "c7" and r["idx"] == 0] == [5]


def test_units_from_files(spark, tmp_path):
    (tmp_path / "10.1_a.llm_evidence.jsonl").write_text(
        '{"evidence_id":"e1","source_review_doi":""}\n{"evidence_id":"e2","source_review_doi":"own"}\n')
    (tmp_path / "10.2_b.llm_evidence.jsonl").write_text('{"evidence_id":"e3"}\n')
    schema = spark.createDataFrame([], "evidence_id string, source_review_doi string").schema
    reg = spark.createDataFrame([("10.1_a", "10.1/registered")], "slug string, doi string")
    got = {r["evidence_id"]: r["source_doi"] for r in SU.read_units(
        spark, str(tmp_path), schema, ".llm_evidence.jsonl", reg).collect()}
    assert got == {"e1": "10.1/registered", "e2": "own", "e3": "10.2/b"}


def test_slices_and_snapshots(spark, tmp_path):
    a = spark.createDataFrame([("d1", "t", 1), ("d2", "t", 2)], "doc string, tool string, v int")
    path = str(tmp_path / "rows")
    SU.write_slice(a, path, ["tool", "doc"])
    SU.write_slice(spark.createDataFrame([("d1", "t", 9)], a.schema), path, ["tool", "doc"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 9]
    X.write_records(a, str(tmp_path / "snap"), "records", "2026-01-01")
    X.write_records(a.limit(1), str(tmp_path / "snap"), "records", "2026-02-01")
    listing = SF.file_listing(spark, str(tmp_path / "snap")).withColumn(
        "path", F.regexp_replace("path", r"/part-[^/]*$", ""))
    assert {os.path.basename(r["path"]) for r in SF.latest_snapshot(listing).collect()} == {
        "records_2026-02-01.jsonl"}


def test_notes_are_written_in_order(spark, tmp_path):
    lines = linkage_queries.note_lines(spark, SMALL)
    X.write_notes(lines, str(tmp_path / "notes"))
    folder = sorted((tmp_path / "notes").glob("file=*"))[0]
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert text.startswith("---\ntitle:") and text.index("## Method") < text.index("## Notes")


def test_stream_keeps_the_newest_file_of_a_document(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    papers = spark.createDataFrame([("p/1", "primary")], "doi string, paper_type string")
    table = {"doc": "p/1", "table_number": "1", "caption": "c", "headers": ["h"], "page": 1}
    args = (str(source), str(tmp_path / "out"), str(tmp_path / "ck"), papers)
    for name, cell in (("a.json", "old"), ("b.json", "new")):
        (source / name).write_text(json.dumps({**table, "rows": [[cell], ["x"]]}))
        I.ingest_stream(spark, *args).awaitTermination()
    got = I.current_slices(spark, str(tmp_path / "out")).collect()
    assert sorted(r["row_json"] for r in got) == ['["new"]', '["x"]']
    I.ingest_stream(spark, *args).awaitTermination()        # nothing new: nothing changes
    assert I.current_slices(spark, str(tmp_path / "out")).count() == 2


def test_scores_are_clamped_and_cached(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "doi string")
    cache = spark.createDataFrame([("c", 0.4, "old")], "doi string, relevance double, relevance_reason string")
    reply = lambda pdf: pd.Series(['{"relevance": 1.7}' if d == "a" else "no" for d in pdf["doi"]])
    scored, fresh = U.score_batches(df, reply, cache)
    assert {r["doi"]: r["relevance"] for r in scored.collect()} == {"a": 1.0, "b": None, "c": 0.4}
    assert [r["doi"] for r in fresh.collect()] == ["a"]


def test_extractor_drops_what_is_no_item(spark):
    df = spark.createDataFrame([("k", "a b")], "id string, t string")
    got = U.extract_batches(df, lambda pdf: [[{"w": x} for x in t.split()] + ["junk"] for t in pdf["t"]],
                            ["id"], "w string").collect()
    assert [(r["item_no"], r["w"]) for r in got] == [(0, "a"), (1, "b")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j1_join_papers", "j2_papers_either", "j3_fill_primary",
                                  "j4_drop_reference_units", "j5_span_words", "j6_label_in_caption",
                                  "j9_citation_resolve", "c7_backfill_group_defaults"])
def test_joins_are_hash_or_merge_joins(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_first_rows_are_limited_before_the_shuffle(spark):
    text = plan(entry.queries()["s8_upsert_by_id"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2      # partial and final


def test_scan_reads_only_what_is_used(spark):
    text = plan(view(spark, SMALL, "lineitem").filter("l_quantity > 10").groupBy("l_suppkey").agg(
        F.sum("l_tax")))
    assert "GreaterThan(l_quantity,10.0)" in text
    assert "l_suppkey" in text and "l_extendedprice" not in text


CHECKED = ["s2_union_by_precedence", "k7_melt", "records_from_tables", "c5_conditions_fill",
           "d3_merge_candidates", "f4_triage", "j8_overlay_passes", "t8_section_select",
           "x2_paper_claims", "a7_category_bin_median"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows([d[0] for d in cur.description], cur.fetchall()) and got[1]
    assert normal(float("nan")) is None


def test_entry_and_keys(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_unit_headers_are_read_once(spark):
    heads = ["Sample", "T (K)", "WHSV", None, "a.Ref"]
    table = spark.createDataFrame([
        ("p", "s", 0, i, heads, ["Cu", "600", f"{i} h", "x", "(7)"]) for i in range(1, 50)] + [
        ("p", "s", 0, 0, heads, ["Sample", "T (K)", "WHSV", "nan", "a.Ref"]), ("p", "s", 1, 0, ["GHSV"], ["1.5"]),
        ("p", "s", 1, 1, ["GHSV"], ["n/a"]), ("p", "s", 2, 0, None, ["1"]), ("p", "s", 3, 0, heads, ["Zn"])],
        "doc string, slug string, table_idx int, row_idx int, headers array<string>, cells array<string>")
    out = table_to_units(table)
    got = {(r["evidence_id"], r["field"]): (r["catalyst_system"], r["source_reference"], r["num"]) for r in out.collect()}
    assert len(got) == out.count() == 99
    assert got["s::docling::t00::r07", "temperature_c"] == ("Cu", "[7]", 326.9)
    assert got["s::docling::t00::r07", "whsv"] == ("Cu", "[7]", 7.0)
    assert got["s::docling::t01::r00", "ghsv"] == ("row_0", None, 1.5)
    # a pattern stands twice in the plan (leaf, whole header), above the distinct headers; rows do not run it
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("lifetime|catalyst") == 2


def test_forest_is_fitted_on_all_rows_in_pieces(spark, monkeypatch):
    given = []

    class Regressor:
        def __init__(self, **kw):
            pass

        def fit(self, df):
            given.append((df.count(), df.rdd.getNumPartitions(), df.columns))

    monkeypatch.setattr(M, "RandomForestRegressor", Regressor)
    # one partition of more rows than one task should hold
    M.fit_forest(spark.range(0, 1_700_000, 1, 1).selectExpr("id", "id AS features", "id % 7 AS y"), "y")
    assert given == [(1_700_000, 9, ["features", "y"])]


def test_wide_vectors_are_fitted_in_more_pieces(spark, monkeypatch):
    from pyspark.ml.feature import OneHotEncoder
    given = []

    class Regressor(M.RandomForestRegressor):
        def fit(self, df, params=None):
            given.append((df.count(), df.rdd.getNumPartitions()))

    monkeypatch.setattr(M, "RandomForestRegressor", Regressor)
    rows = spark.range(0, 20_000, 1, 1).selectExpr("id % 2000 AS c", "id % 7 AS y")
    M.fit_forest(OneHotEncoder(inputCol="c", outputCol="features", dropLast=False).fit(rows).transform(rows), "y")
    assert given == [(20_000, 10)]      # 40 million binned cells


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_captions_are_typed_once_on_all_tasks(spark):
    typed = type_captions(view(spark, SMALL, "v_figs"))
    act = typed.filter("type = 'activity' or shape = 'bar'")
    assert optimized(act).count("no_caption") == 1      # the filter works out no second type
    assert typed.rdd.getNumPartitions() == 4
    rows = spark.createDataFrame([("d", "f", "XRD patterns"), ("d", "g", None)], "doc string, figure string, caption string")
    assert sorted(type_captions(rows).select("figure", "type", "shape").collect()) == [
        ("f", "characterization", None), ("g", "no_caption", None)]


def test_build_stats_reads_the_tables_once(spark, monkeypatch):
    calls, whole = [], table_queries.K.group_tables
    monkeypatch.setattr(table_queries.K, "group_tables", lambda rows: calls.append(1) or whole(rows))
    entry.queries()["r3_build_stats"](spark, SMALL)
    assert len(calls) == 1


def test_draft_records_find_quantities_once(spark):
    df = entry.queries()["t23_draft_records"](spark, SMALL)
    assert optimized(df).count("[A-Z][a-z]?)+") == 1 and "Exchange" in plan(df)


def test_captions_are_not_cut_in_one_task(spark):
    labels = spark.createDataFrame([("d", "k", ["red ring", "bolt"]), ("e", "m", ["bolt"])],
                                   "doc string, rec_key string, label_variants array<string>")
    figures = spark.range(0, 4000, 1, 1).selectExpr("'d' AS doc", "concat('f', id) AS figure", "'Scheme of red ring' AS caption")
    out = match_labels_in_captions(labels, figures)
    assert out.count() == 4000 and out.select("rec_key", "matched_on").distinct().collect() == [("k", "red ring")]
    # the side of the sizes is built, never the captions
    assert "ShuffledHashJoin" in plan(out) and "_part" in plan(out)
