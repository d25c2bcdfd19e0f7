"""Golden vectors of the normalisers."""

import hashlib

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import normalize as N
from recordloom.functions.attributes import AttributeLibrary
from recordloom.operators.tables import read_headers
from recordloom.plans.queries import QUERIES

LIB = AttributeLibrary()


def test_fix_artifacts(column):
    assert column(N.fix_artifacts, ["CO₂ conversion", "P-ZSM GLYPH<0> 5", "a\nb**c**", None]) == [
        "CO2 conversion", "P-ZSM-5", "a bc", ""]


def test_clean_header(column):
    got = column(N.clean_header, ["S_BET[a] [m² g⁻¹]", "temp/ K", "GHSV/h-1", "Si/Al", "T_a", "P b",
                                  "R^c", "Conv.a"])
    assert [tuple(r) for r in got] == [
        ("S_BET", "m² g⁻¹"), ("temp", "K"), ("GHSV", "h-1"), ("Si/Al", None), ("T", None),
        ("P", None), ("R", None), ("Conv", None)]


def test_parse_value(column):
    got = column(N.parse_value, ["6 . 1", "32. 8", "10-20", "~95", "<1", "n.d.", "", "-196",
                                 "1.2.3", "5d", "0"])
    assert [r["num"] for r in got] == [6.1, 32.8, 15.0, 95.0, 1.0, None, None, -196.0, 1.2, 5.0, 0.0]


def test_fuzzy_key(column):
    assert column(N.fuzzy_key, ["Zn-C-HZSM-5", "Zn/C-HZSM-5", "ZnCHZSM5", "ZSM-5(25)", "ZSM-5(50)",
                                "H-ZSM-5", "NH4-ZSM-5"]) == [
        "znchzsm5", "znchzsm5", "znchzsm5", "zsm525", "zsm550", "hzsm5", "nh4zsm5"]


def test_numeric_label_and_slug(column):
    assert column(N.is_numeric_label, ["12.5 %", "Zn/ZSM-5"]) == [True, False]
    assert column(N.slugify, ["A b-C", "--", None]) == ["a_b_c", "col", "col"]


def test_header_dictionary(spark):
    def meaning(headers, lib=LIB):
        df = spark.createDataFrame([(h,) for h in headers], "h string").repartition(3)
        return {r.h: tuple(r.m) for r in read_headers(df, "h", lib, "m").collect()}

    got = meaning(["space-time yield", "bas/las", "product distribution (%) / CH4", "foo Bar", "T / K", "T [°C]", "P [MPa]", None, "", "foo Bar"])
    assert got == {"space-time yield": ("space_time_yield", None, True), "bas/las": ("bas_las_ratio", None, True),
                   "product distribution (%) / CH4": ("methane_pct", "%", True), "foo Bar": ("foo_bar", None, False),
                   "T / K": ("temperature_c", "K", True), "T [°C]": ("temperature_c", "°C", True), "P [MPa]": ("pressure", "MPa", True),
                   None: ("col", None, False), "": ("col", None, False)}
    # of equally long patterns the first listed one, whatever stands first in the header
    tie = AttributeLibrary(patterns=[("late", "wxyz"), ("early", "abcd"), ("also", "wxyz"), ("one", "q"), ("wide", "q" * 40)])
    assert {h: m[0] for h, m in meaning(["abcd wxyz", "abcd", "wxyzabcd", "a / q", "q" * 41, "abcd / no"], tie).items()} == {
        "abcd wxyz": "late", "abcd": "early", "wxyzabcd": "late", "a / q": "one", "q" * 41: "wide", "abcd / no": "early"}


def test_normalize_unit(column):
    def run(attr, value, unit):
        u = F.lit(unit).cast("string")
        return tuple(column(lambda c: N.normalize_unit(F.lit(attr), c.cast("double"), u),
                            [value])[0])
    assert run("temperature_c", "773.15", "K") == (500.0, "°C")
    assert run("temperature_c", "450", "°C") == (450.0, "°C")
    assert run("pressure", "30", "bar") == (3.0, "MPa")
    assert run("pressure", "500", "kPa") == (0.5, "MPa")
    assert run("pressure", "2", None) == (2.0, None)
    assert run("bronsted_acidity", "0.25", "mmol/g") == (250.0, "umol/g")


def test_ids(column):
    assert column(N.sanitize_doi, ["https://doi.org/10.1021/ACSCATAL.5B00192"]) == [
        "10.1021/acscatal.5b00192"]
    assert column(N.slug_to_id, ["10.1021_a_b"]) == ["10.1021/a_b"]


def test_casts(column):
    assert column(N.safe_float, ["12%", "x", "0", "1e3"]) == [12.0, None, 0.0, 1000.0]
    assert column(N.safe_int, ["7", "x", ""]) == [7, None, None]


@settings(max_examples=3, deadline=None, phases=[Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ5-–/ ₂%.\n", max_size=12), min_size=5, max_size=40))
def test_idempotent(column, texts):
    for fn in (N.fuzzy_key, N.sanitize_doi, N.clean_label):
        once = column(fn, texts)
        assert column(fn, once) == once


def test_inverted_index_is_built_in_the_row(spark, tmp_path):
    texts = [(1, "b a  b c\na"), (2, ""), (3, None), (4, "x")]
    for name in ("documents",):
        spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    df = QUERIES["n10_decode_inverted"](spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert sorted(tuple(r) for r in df.collect()) == [
        (1, md5("b a b c a"), 9), (2, md5(""), 0), (3, None, None), (4, md5("x"), 1)]
    index = spark.createDataFrame([(["b", "a", "b"],)], "w array<string>").select(N.inverted_index(F.col("w")).alias("m"))
    assert index.first()["m"] == {"a": [1], "b": [0, 2]}
