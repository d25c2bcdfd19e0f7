"""Queries of the normalisers (N) over text built from part, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import normalize as N
from recordloom.functions import text as TX
from recordloom.functions.attributes import AttributeLibrary
from recordloom.operators.tables import read_headers
from recordloom.plans.registry import query
from recordloom.plans.views import sql, view


def pick(spark, sf, text, **cols):
    d = sql(spark, sf, text)
    return d.select("p_partkey", *[c.alias(n) for n, c in cols.items()])


_Z = "CAST(p_size AS STRING)"


@query("n1_fix_artifacts", f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CO2 ' || p_name WHEN 1 THEN p_name || '-' || {_Z}
 WHEN 2 THEN 'eff' || 'fi' || p_name WHEN 3 THEN p_name || ' bold' ELSE p_name || ' x' END AS v FROM part""")
def _n1(spark, sf):
    return pick(spark, sf, f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CO₂ ' || p_name WHEN 1 THEN p_name || ' GLYPH<0> ' || {_Z}
        WHEN 2 THEN 'eﬀ/uniFB01' || p_name WHEN 3 THEN p_name || ' **bold**' ELSE p_name || chr(10) || 'x' END AS raw FROM part""",
                v=N.fix_artifacts(F.col("raw")))


@query("n2_clean_header", f"""SELECT p_partkey,
 CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'temp' WHEN 2 THEN 'Si/Al ' || {_Z} WHEN 3 THEN p_name || {_Z} ELSE p_name || ' 9' END AS name,
 CASE p_partkey % 5 WHEN 0 THEN 'm2/g' WHEN 1 THEN 'K' ELSE NULL END AS unit FROM part""")
def _n2(spark, sf):
    d = sql(spark, sf, f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '[a] [m2/g]' WHEN 1 THEN 'temp/ K' WHEN 2 THEN 'Si/Al ' || {_Z}
        WHEN 3 THEN p_name || {_Z} || ' b' ELSE p_name || '  9:' END AS raw FROM part""")
    return d.select("p_partkey", N.clean_header(F.col("raw")).alias("h")).select(
        "p_partkey", "h.name", "h.unit")


@query("n3_parse_value", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size + 5.0 WHEN 2 THEN CAST(p_size AS DOUBLE) WHEN 3 THEN NULL
 WHEN 4 THEN -1.0 * p_size ELSE NULL END AS num FROM part""")
def _n3(spark, sf):
    return pick(spark, sf, f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN {_Z} || ' . 5' WHEN 1 THEN {_Z} || '-' || CAST(p_size + 10 AS STRING)
        WHEN 2 THEN '~' || {_Z} || ' %' WHEN 3 THEN 'n.d.' WHEN 4 THEN '-' || {_Z} ELSE p_name END AS raw FROM part""",
                num=N.parse_value(F.col("raw"))["num"])


@query("n4_label_keys", f"""SELECT p_partkey, replace(p_name, ' ', '') || '–hzsm5' || {_Z} AS k,
 p_name || '-H-ZSM-5 (' || {_Z} || ')' AS light FROM part""")
def _n4(spark, sf):
    return pick(spark, sf, f"SELECT p_partkey, p_name || '–H-ZSM-5[a] (' || {_Z} || ')' AS raw FROM part",
                k=N.fuzzy_key(F.col("raw")), light=N.norm_label(F.col("raw")))


@query("n4_clean_label", "SELECT p_partkey, p_name || ' x' AS v FROM part")
def _n4b(spark, sf):
    return pick(spark, sf, "SELECT p_partkey, '  ' || replace(p_name, ' ', '   ') || ' x ' AS raw FROM part",
                v=N.clean_label(F.col("raw")))


@query("n5_numeric_label_and_slug", """SELECT p_partkey, p_partkey % 2 = 0 AS numeric_label,
 CASE WHEN p_partkey % 3 = 0 THEN 'col' ELSE replace(p_name, ' ', '_') END AS slug FROM part""")
def _n5(spark, sf):
    return pick(spark, sf, f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_Z} || '.5 %' ELSE 'Zn/' || {_Z} END AS label,
        CASE WHEN p_partkey % 3 = 0 THEN '--' ELSE '(' || upper(p_name) || ')' END AS raw FROM part""",
                numeric_label=N.is_numeric_label(F.col("label")), slug=N.slugify(F.col("raw")))


@query("n6_normalize_unit", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN round(573.0 + p_size - 273.15, 1) WHEN 1 THEN 573.0 + p_size WHEN 2 THEN round(p_size / 10.0, 3)
 WHEN 3 THEN round(p_size / 1000.0, 3) WHEN 4 THEN p_size * 1000.0 WHEN 5 THEN CAST(p_size AS DOUBLE) ELSE round(600.0 + p_size - 273.15, 1) END AS v,
 CASE p_partkey % 7 WHEN 0 THEN '°C' WHEN 1 THEN '°C' WHEN 2 THEN 'MPa' WHEN 3 THEN 'MPa' WHEN 4 THEN 'umol/g' WHEN 5 THEN 'psig?' ELSE '°C' END AS u FROM part""")
def _n6(spark, sf):
    d = sql(spark, sf, """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'temperature_c' WHEN 1 THEN 'temperature_c' WHEN 2 THEN 'pressure' WHEN 3 THEN 'pressure'
        WHEN 4 THEN 'lewis_acidity' WHEN 5 THEN 'whsv' ELSE 'temperature_c' END AS attr,
        CASE p_partkey % 7 WHEN 0 THEN 573.0D + p_size WHEN 1 THEN 573.0D + p_size WHEN 6 THEN 600.0D + p_size ELSE CAST(p_size AS DOUBLE) END AS val,
        CASE p_partkey % 7 WHEN 0 THEN 'K' WHEN 1 THEN '°C' WHEN 2 THEN 'bar' WHEN 3 THEN 'kPa' WHEN 4 THEN 'mmol/g' WHEN 5 THEN 'psig?' ELSE NULL END AS unit FROM part""")
    n = N.normalize_unit(F.col("attr"), F.col("val"), F.col("unit"))
    return d.select("p_partkey", n.alias("n")).select(
        "p_partkey", F.col("n.value").alias("v"), F.col("n.unit").alias("u"))


@query("n7_doi_norm", f"""SELECT p_partkey, '10.1021/ab.' || {_Z} AS clean, '10.9/x' || {_Z} AS cut FROM part""")
def _n7(spark, sf):
    return pick(spark, sf, f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN ' http://dx.doi.org/' WHEN 2 THEN 'DOI:' ELSE '' END
        || '10.1021/AB.' || {_Z} AS raw, '10.9/x' || {_Z} || CASE WHEN p_partkey % 2 = 0 THEN '?ref=pdf' ELSE ').' END AS link FROM part""",
                clean=N.sanitize_doi(F.col("raw")), cut=N.clean_doi(F.col("link")))


@query("n8_slugs", f"""SELECT p_partkey, '10.1021_a_b.' || {_Z} AS slug, '10.1021/a_b.' || {_Z} AS first_id, '10.1021/a_b.' || {_Z} AS prefix_id,
 '10.1021/a/b.' || {_Z} AS all_id FROM part""")
def _n8(spark, sf):
    s = N.id_to_slug(F.col("raw"))
    return pick(spark, sf, f"SELECT p_partkey, '10.1021/A_b.' || {_Z} AS raw FROM part", slug=s,
                first_id=N.slug_to_id(s), prefix_id=N.slug_to_id(s, "prefix"),
                all_id=N.slug_to_id(s, "all"))


@query("n9_strip_tags", """SELECT page_id, length(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS n FROM pages""")
def _n9(spark, sf):
    return view(spark, sf, "pages").select("page_id", F.length(N.strip_tags(F.col("html")))
                                           .cast("long").alias("n"))


_WORDS = "SELECT doc_id, text FROM documents"


@query("n10_decode_inverted", r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''), ' ')) AS m,
 length(array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''), ' ')) AS n FROM documents""")
def _n10(spark, sf):
    d = sql(spark, sf, _WORDS)
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    index = d.select("doc_id", N.inverted_index(words).alias("m"))
    return index.select("doc_id", F.md5(N.decode_inverted(F.col("m"))).alias("m"),
                        F.when(F.col("m").isNotNull(), F.length(N.decode_inverted_slots(F.col("m"))))
                        .cast("long").alias("n"))


@query("n11_casts", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN NULL ELSE p_size + 0.5 END AS f,
 CAST(p_size AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS loose, CAST(0 AS DOUBLE) AS first FROM part""")
def _n11(spark, sf):
    return pick(spark, sf, f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN {_Z} || '%' WHEN 1 THEN p_name ELSE {_Z} || '.5 ' END AS raw,
        'ca. ' || {_Z} AS loose FROM part""",
                f=N.safe_float(F.col("raw")), i=N.safe_int(F.regexp_extract("loose", r"(\d+)$", 1)),
                loose=N.loose_float(F.regexp_replace("loose", r"\.", "")),
                first=N.first_non_null(F.lit(None).cast("double"), F.lit(0.0), F.lit(5.0)))


@query("n12_clean_caption", "SELECT p_partkey, 'Fig. fi ' || p_name AS v FROM part")
def _n12(spark, sf):
    return pick(spark, sf, "SELECT p_partkey, ' Fig.  ﬁ ' || chr(10) || p_name || ' ' AS raw FROM part",
                v=N.clean_caption(F.col("raw")))


@query("n13_normalize_text", "SELECT p_partkey, p_name || '-x y' AS v FROM part")
def _n13(spark, sf):
    return pick(spark, sf, "SELECT p_partkey, ' ' || p_name || '(cid:0)x(cid:1)   y ' AS raw FROM part",
                v=N.normalize_text(F.col("raw")))


@query("n14_map_category", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'ZnCr' WHEN 2 THEN 'Cu' ELSE p_type END AS v,
 CASE p_partkey % 4 WHEN 0 THEN 'Other' WHEN 1 THEN 'Zn' WHEN 2 THEN 'Cu' ELSE p_type END AS f FROM part""")
def _n14(spark, sf):
    return pick(spark, sf, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Zn, Cr' WHEN 2 THEN ' Cu ' ELSE p_type END AS raw FROM part",
                v=N.map_category(F.col("raw"), {"Zn, Cr": "ZnCr"}),
                f=N.map_category(F.col("raw"), default="Other", first_of_list=True))


@query("n15_short_name", f"""SELECT p_partkey, CAST(1990 + p_size AS STRING) || ' ' || p_name || ' - J. Catal. (x.' || {_Z} || ').md' AS v FROM part""")
def _n15(spark, sf):
    return pick(spark, sf, f"SELECT p_partkey, p_name, p_size, '10.1/x.' || {_Z} AS doi FROM part",
                v=N.short_name(F.col("p_name"), F.col("p_size") + 1990,
                               F.lit("Journal of Catalysis"), F.col("doi")))


@query("t18_expand_citations", f"""SELECT p_partkey, array_to_string([p_size, p_size + 10, p_size + 11, p_size + 12, 99], ',') AS v FROM part""")
def _t18(spark, sf):
    return pick(spark, sf, f"""SELECT p_partkey, 'as in [' || {_Z} || ',' || CAST(p_size + 10 AS STRING) || '-' || CAST(p_size + 12 AS STRING) || '] and Ref. 99' AS raw FROM part""",
                v=F.array_join(F.transform(TX.expand_citations(F.col("raw")),
                                           lambda x: x.cast("string")), ","))


@query("t19_citation_title", "SELECT p_partkey, 'A ' || p_name || ' of some length' AS v FROM part")
def _t19(spark, sf):
    return pick(spark, sf, """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Adams, B. (2019). A ' || p_name || ' of some length. J. Catal. 1'
        ELSE 'Adams, B. et al. A ' || p_name || ' of some length. J. Catal. 2018, 1.' END AS raw FROM part""",
                v=TX.citation_title(F.col("raw")))


@query("t20_doi_in_text", f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '10.1021/abcd.' || {_Z} END AS v FROM part")
def _t20(spark, sf):
    return pick(spark, sf, f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'no id 10.1/x' ELSE 'see doi: 10.1021/abcd.' || {_Z} || ', and more' END AS raw FROM part""",
                v=TX.doi_in_text(F.col("raw")))


@query("t22_decompose_label", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Cu,Fe' WHEN 1 THEN 'Pd' ELSE '' END AS actives,
 CASE p_partkey % 3 WHEN 0 THEN 'Al2O3,ZnO' WHEN 1 THEN 'CeO2' ELSE '' END AS supports, CASE p_partkey % 3 WHEN 0 THEN 'K' ELSE '' END AS promoters FROM part""")
def _t22(spark, sf):
    d = sql(spark, sf, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'K-Cu-Fe/ZnO-Al2O3' WHEN 1 THEN 'Pd/CeO2' ELSE p_name END AS raw FROM part")
    return d.select("p_partkey", TX.decompose_label(F.col("raw")).alias("d")).select(
        "p_partkey", *[F.array_join(f"d.{c}", ",").alias(c)
                       for c in ("actives", "supports", "promoters")])


@query("u3_first_json", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '{"relevance": ' || CAST(p_size AS STRING) || '}' ELSE NULL END AS v FROM part""")
def _u3(spark, sf):
    return pick(spark, sf, f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Sure: ' || chr(123) || '"relevance": ' || {_Z} || chr(125) || ' done'
        WHEN 1 THEN 'broken ' || chr(123) || p_name || chr(125) ELSE p_name END AS raw FROM part""",
                v=TX.first_json(F.col("raw")))


LIB = AttributeLibrary()


@query("k5_golden_headers", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'space_time_yield' WHEN 1 THEN 'bas_las_ratio' WHEN 2 THEN 'methane_pct' ELSE 'pressure' END AS attr FROM part""")
def _k5g(spark, sf):
    d = sql(spark, sf, """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'space-time yield ' || p_name WHEN 1 THEN 'bas/las' WHEN 2 THEN 'product distribution (%) / CH4' ELSE 'P [MPa]' END AS raw FROM part""")
    return read_headers(d, "raw", LIB, "m").select("p_partkey", "m.attr")


_PRODUCTS = {"Ethylbenzene (%)": "ethylbenzene_pct", "Trimethylbenzene [%]": "trimethylbenzene_pct", "o-Xylene": "oxylene_pct",
             "m-xylene (wt%)": "mxylene_pct", "p-Xylene selectivity (%)": "pxylene_selectivity_pct", "C9+ (%)": "c9plus_aromatics_pct",
             "CO₂ conversion (%)": "co2_conversion_pct", "Toluene selectivity (%)": "toluene_pct"}
_PICK = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{{{i}}}'" for i in range(8)) + " END"


@query("k5_golden_products", f"SELECT p_partkey, {_PICK.format(*_PRODUCTS.values())} AS attr FROM part")
def _k5p(spark, sf):
    d = sql(spark, sf, f"SELECT p_partkey, {_PICK.format(*_PRODUCTS)} AS raw FROM part")
    return read_headers(d, "raw", LIB, "m").select("p_partkey", "m.attr")
