"""Table understanding: from raw table rows to one row per cell of meaning.

Input rows: ``doc, caption, columns_json, row_json, row_ord`` and optionally ``primary_doi``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import vocabulary as V
from recordloom.functions.attributes import AttributeLibrary
from recordloom.functions.base import (any_contains, first_rule, let, nonblank,
                                       quiet_double, strip)
from recordloom.functions.normalize import (attribute_by_unit, clean_header, clean_label, is_na,
                                            is_usable_label, loose_float, parse_value, slugify)
from recordloom.session import cut, spread


def group_tables(rows: DataFrame) -> DataFrame:
    """Parse the JSON columns and give every row its table: same document, caption and headers."""
    if "primary_doi" not in rows.columns:
        rows = rows.withColumn("primary_doi", F.lit(None).cast("string"))
    return (rows
            .withColumn("caption", F.coalesce("caption", F.lit("")))
            .withColumn("headers", F.from_json("columns_json", "array<string>"))
            .withColumn("cells", F.from_json("row_json", "array<string>"))
            .filter(F.col("headers").isNotNull() & F.col("cells").isNotNull())
            .withColumn("table_key", F.md5(F.concat_ws(
                "\u001f", "doc", "caption", F.to_json("headers"))))
            .drop("columns_json", "row_json"))


def is_headerless(headers: Column) -> Column:
    """At least 60 % of the headers are blank, an integer, or 'nan'."""
    blank = F.filter(headers, lambda h: strip(F.coalesce(h, F.lit(""))).rlike(r"(?iU)^(\d*|nan)$"))
    return F.size(blank) >= F.greatest(F.size(headers), F.lit(1)) * F.lit(0.6)


def classify_table(caption: Column, headers: Column,
                   types: dict[str, list[str]] | None = None) -> Column:
    """Type with the most keywords; the first listed wins ties; none is 'other'."""
    types = types or V.TABLE_TYPES
    blob = F.lower(F.concat_ws(" ", caption, F.array_join(headers, " ", "")))

    def scored(b):
        return F.array(*[F.struct(
            sum((b.contains(k).cast("int") for k in words), F.lit(0)).alias("score"),
            F.lit(-i).alias("ord"), F.lit(name).alias("type"))
            for i, (name, words) in enumerate(types.items())])

    best = let(blob, lambda b: F.array_max(scored(b)))
    return let(best, lambda t: F.when(t["score"] > 0, t["type"]).otherwise("other"))


def _first_index(headers: Column, test) -> Column:
    marks = F.filter(F.transform(headers, lambda h, i: F.when(
        test(F.lower(F.coalesce(h, F.lit("")))), i)), lambda i: i.isNotNull())
    return F.get(marks, F.lit(0))


def key_column_by_header(headers: Column, lib: AttributeLibrary) -> Column:
    return _first_index(headers, lambda h: ~strip(h).isin(lib.skip_headers)
                        & any_contains(h, lib.id_headers))


def reference_column(headers: Column, lib: AttributeLibrary) -> Column:
    return _first_index(headers, lambda h: strip(h).isin(lib.reference_headers)
                        | strip(h).startswith("ref"))


def header_dictionary(texts: DataFrame, lib: AttributeLibrary, column: str = "text") -> DataFrame:
    """What every distinct header means: (header, meaning struct<attr, unit, mapped>); a NULL is ''.

    The library is not scanned per header: from each place of a header the characters there are
    looked up in the patterns by how they begin, so the work grows with the text and not with the
    library. The leaf of ``group / leaf`` counts first, then the longest pattern, then the first
    listed one. The patterns are broadcast; they are a parameter, not data.
    """
    listed = [(p, len(p), -i, attr) for i, (attr, p) in enumerate(lib.patterns) if p]
    begin = min([n for _, n, _, _ in listed], default=1)
    widest = max([n for _, n, _, _ in listed], default=1)
    patterns = texts.sparkSession.createDataFrame(listed, "pattern string, size int, ord int, attr string").withColumn(
        "begins", F.substring("pattern", 1, begin))

    def places(text, leaf):
        at = F.sequence(F.lit(1), F.length(text))
        return F.when(F.length(text) > 0, F.transform(at, lambda i: F.struct(
            F.lit(leaf).alias("leaf"), F.substring(text, i, F.lit(begin)).alias("begins"),
            F.substring(text, i, F.lit(widest)).alias("rest")))).otherwise(F.array())

    once = texts.select(F.coalesce(F.col(column), F.lit("")).alias("header")).distinct().withColumn("h", clean_header(F.col("header")))
    low = F.lower(F.col("h.name"))
    leaf = F.when(low.contains(" / "), strip(F.substring_index(low, " / ", -1))).otherwise("")
    looked = once.select("header", "h", low.alias("low"), leaf.alias("tail")).select(
        "header", "h", F.explode_outer(F.concat(places(F.col("tail"), 1), places(F.col("low"), 0))).alias("x")).select("header", "h", "x.*")
    best = looked.join(F.broadcast(patterns), (looked["begins"] == patterns["begins"]) & F.startswith("rest", "pattern"), "left")
    found = best.groupBy("header").agg(F.first("h").alias("h"), F.max(F.when(
        F.col("attr").isNotNull(), F.struct("leaf", "size", "ord", "attr")))["attr"].alias("found"))
    known = F.coalesce("found", attribute_by_unit(F.col("h.name"), F.col("h.unit")))
    return found.select("header", F.struct(
        F.coalesce(known, slugify(F.col("h.name"))).alias("attr"), F.col("h.unit").alias("unit"),
        known.isNotNull().alias("mapped")).alias("meaning"))


def read_headers(df: DataFrame, column: str, lib: AttributeLibrary, into: str = "meaning") -> DataFrame:
    """Rows with the meaning of the header in `column`; every distinct header is resolved once."""
    found = header_dictionary(df, lib, column).withColumnRenamed("header", "_header").withColumnRenamed("meaning", into)
    return df.join(found, F.coalesce(F.col(column), F.lit("")) == F.col("_header"), "left").drop("_header")


def _names_attribute(m: Column) -> Column:
    return m["mapped"] & ~m["attr"].isin(V.COMPOSITION_ATTRS)


def key_column_by_content(rows: DataFrame) -> DataFrame:
    """First column whose cells are mostly (over 60 %) words: (table_key, key_col)."""
    cells = rows.select("table_key", F.size("headers").alias("width"), F.posexplode("cells"))
    value = F.coalesce(F.col("col"), F.lit(""))
    word = parse_value(value)["num"].isNull() & ~is_na(strip(value))
    return (cells.filter("pos < width")
            .groupBy("table_key", "pos")
            .agg(F.avg(word.cast("double")).alias("share"))
            .filter("share > 0.6")
            .groupBy("table_key").agg(F.min("pos").alias("key_col")))


def find_key_columns(grouped: DataFrame, lib: AttributeLibrary) -> DataFrame:
    """Rows with ``key_col``: by header, else by content, else NULL."""
    named = grouped.withColumn("_named", key_column_by_header(F.col("headers"), lib))
    found = key_column_by_content(named.filter(F.col("_named").isNull() & ~is_headerless(F.col("headers"))))
    return named.join(found, "table_key", "left").withColumn(
        "key_col", F.coalesce("_named", "key_col")).drop("_named")


def table_headers(keyed: DataFrame, lib: AttributeLibrary) -> DataFrame:
    """The dictionary of all headers and of all cells that stand in a key column."""
    tables = keyed.groupBy("table_key").agg(F.min("headers").alias("headers"))
    return header_dictionary(tables.select(F.explode("headers").alias("text"))
                             .unionByName(keyed.select(_key_cell().alias("text")).filter("text is not null")), lib)


def _key_cell() -> Column:
    return F.get(F.col("cells"), F.col("key_col"))


def table_profile(keyed: DataFrame, lib: AttributeLibrary, names: DataFrame | None = None) -> DataFrame:
    """One row per table: type, orientation, key and reference column, meaning of every header.

    `names` is the dictionary of `table_headers`, made here if there is none.
    """
    names = table_headers(keyed, lib) if names is None else names
    tables = keyed.groupBy("table_key").agg(
        F.min("doc").alias("doc"), F.min("caption").alias("caption"),
        F.min("headers").alias("headers"), F.min("key_col").alias("key_col"),
        F.min("row_ord").alias("table_ord"), F.count(F.lit(1)).alias("n_rows"))
    hits = (keyed.select("table_key", _key_cell().alias("header"))
            .join(names.filter(_names_attribute(F.col("meaning"))), "header", "left_semi")
            .groupBy("table_key").agg(F.count(F.lit(1)).alias("value_hits")))
    maps = (tables.select("table_key", F.posexplode("headers").alias("i", "h"))
            .withColumn("header", F.coalesce("h", F.lit(""))).join(names, "header")
            .groupBy("table_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "meaning"))),
                                                  lambda x: x["meaning"]).alias("header_map")))
    tables = (tables.join(hits, "table_key", "left").join(maps, "table_key", "left")
              .withColumn("value_hits", F.coalesce("value_hits", F.lit(0)))
              .withColumn("header_map", F.coalesce("header_map", F.array()))
              .withColumn("headerless", is_headerless(F.col("headers")))
              .withColumn("table_type", classify_table(F.col("caption"), F.col("headers"),
                                                       lib.table_types))
              .withColumn("ref_col", reference_column(F.col("headers"), lib)))
    hits = F.size(F.filter(F.transform("header_map", lambda m, i: (i != F.col("key_col"))
                                       & _names_attribute(m)), lambda b: b))
    return (tables.withColumn("header_hits", hits)
            .withColumn("transposed", (F.col("value_hits") >= 3)
                        & (F.col("value_hits") >= F.col("header_hits") + 2)))


def read_tables(rows: DataFrame, lib: AttributeLibrary) -> tuple[DataFrame, DataFrame]:
    """(rows with their key column, header dictionary), each written once: profile and cells come from them."""
    grouped = cut(group_tables(spread(rows)))
    keyed = cut(find_key_columns(grouped, lib))
    return keyed, cut(table_headers(keyed, lib))


def melt_tables(rows: DataFrame, lib: AttributeLibrary | None = None,
                read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Raw rows to one row per (sample label, attribute cell), both orientations.

    A label with no usable cell still yields one row, with ``attr`` NULL. `read` is the result of
    `read_tables`, where it is there already.
    """
    lib = lib or AttributeLibrary()
    keyed, names = read or read_tables(rows, lib)
    profile = table_profile(keyed, lib, names).filter("not headerless and key_col is not null").select(
        "table_key", "table_ord", "table_type", "ref_col", "header_map", "transposed")
    j = (keyed.join(profile, "table_key").filter(F.col("key_col") < F.size("cells"))
         .withColumn("header", F.when(F.col("transposed"), F.coalesce(_key_cell(), F.lit(""))))
         .join(names, "header", "left"))
    key, ref = F.col("key_col"), F.coalesce(F.col("ref_col"), F.lit(-1))
    empty = F.lit(None).cast("string")

    def event(label, pos, m, cell):
        return F.struct(label.alias("label"), pos.cast("int").alias("col"),
                        m["attr"].alias("attr"), m["unit"].alias("unit"),
                        m["mapped"].alias("mapped"), cell.alias("cell"))

    own = clean_label(F.get(F.col("cells"), key))
    presence = F.struct(own.alias("label"), F.lit(-1).alias("col"), empty.alias("attr"),
                        empty.alias("unit"), F.lit(None).cast("boolean").alias("mapped"),
                        empty.alias("cell"))
    across = let(own, lambda label: F.filter(
        F.transform("cells", lambda c, i: event(label, i, F.get(F.col("header_map"), i), c)),
        lambda e: (e["col"] != key) & (e["col"] != ref) & (e["col"] < F.size("headers"))))
    across = F.when(is_usable_label(own), F.concat(F.array(presence), across))
    down = F.filter(
        F.transform("headers", lambda h, i: event(clean_label(h), i, F.col("meaning"), F.get(F.col("cells"), i))),
        lambda e: (e["col"] != key) & (e["col"] != ref) & (e["col"] < F.size("cells"))
        & is_usable_label(e["label"]))
    cited = parse_value(F.get(F.col("cells"), ref))["raw"]
    out = j.select(
        "doc", "primary_doi", "table_key", "table_ord", "row_ord", "table_type", "transposed",
        F.when(~F.col("transposed") & (ref >= 0) & ~is_na(cited), cited).alias("reference"),
        F.inline(F.when(F.col("transposed"), down).otherwise(across)))
    parsed = out.withColumn("value", parse_value(F.col("cell")))
    usable = F.col("attr").isNotNull() & ~is_na(F.col("value.raw"))
    return parsed.select(
        "doc", "primary_doi", "table_key", "table_ord", "row_ord", "table_type", "transposed",
        "reference", "label", "col",
        F.when(usable, F.col("attr")).alias("attr"), "unit", "mapped",
        F.col("value.num").alias("num"), F.col("value.raw").alias("raw"))


def map_columns_regex(header: Column, fields: dict[str, str] | None = None) -> Column:
    """Header to unit field by ordered patterns: leaf after the last dot first, then the full name."""
    fields = fields or V.COLUMN_FIELDS

    def ladder(h):
        return first_rule([(h.rlike("(?iU)" + p), f) for p, f in fields.items()])

    leaf = strip(F.substring_index(header, ".", -1))
    return F.coalesce(let(leaf, ladder), let(strip(header), ladder))


#: Parts that the rows under one list of headers are dealt into.
_PARTS = 64


def unit_headers(tables: DataFrame) -> DataFrame:
    """Every distinct list of headers with what it means; the patterns run here only, not for each row.

    A list that stands over very many rows is there once for each of its parts (``_part``).
    ``_heads``: headers without white space around them, ``_fields``: unit fields, ``_marked``: is a
    Celsius sign there, ``_ref`` and ``_cat``: places of the reference and of the sample.
    """
    leaf = lambda h: strip(F.substring_index(h, ".", -1))
    once = tables.select("headers", "_part").filter(F.col("headers").isNotNull()).distinct().select(
        "headers", "_part", F.transform("headers", strip).alias("_heads"),
        F.transform("headers", lambda h: F.when(
            ~leaf(h).rlike(r"(?i)^ref(?:erence)?s?$"), map_columns_regex(h))).alias("_fields"),
        F.transform("headers", lambda h: h.rlike("[°℃]")).alias("_marked"),
        _first_index(F.transform("headers", leaf), lambda h: h.rlike(r"^ref(?:erence)?s?$")).alias("_ref"))
    return once.withColumn("_cat", (F.array_position("_fields", "catalyst_system") - 1).cast("int"))


def table_to_units(tables: DataFrame) -> DataFrame:
    """Digital tables to evidence units, one row per field value.

    Input: ``doc, slug, table_idx, headers, row_idx, cells``. A row is kept if it has at least one
    number; repeated header rows are skipped.
    """
    dealt = tables.withColumn("_part", F.pmod(F.xxhash64(
        "slug", "table_idx", F.floor(F.col("row_idx") / 4096)), F.lit(_PARTS)))
    # packed rows can look small enough to be broadcast; the side of the headers is the one to build on
    t = (dealt.join(unit_headers(dealt).hint("shuffle_hash"), ["headers", "_part"])
         .withColumn("_cells", F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("nan")))))
         .filter(F.col("_cells") != F.col("_heads")))
    label = F.coalesce(F.when(F.col("_cat") >= 0, F.get(F.col("_cells"), F.col("_cat"))),
                       F.concat(F.lit("row_"), F.col("row_idx").cast("string")))
    cited = F.get(F.col("_cells"), F.col("_ref"))
    reference = F.when(~cited.isin(V.EMPTY_CELLS), F.concat(
        F.lit("["), strip(F.regexp_replace(cited, r"[\[\]\(\)]", "")), F.lit("]")))

    def value(c, i):
        f = F.get(F.col("_fields"), i)
        number = quiet_double(nonblank(F.regexp_extract(c, r"^([0-9]+\.?[0-9]*)", 1)))
        kelvin = lambda num: (f == "temperature_k") | (
            (f == "temperature_c") & (num > 500) & ~F.get(F.col("_marked"), i))
        return let(number, lambda num: F.struct(
            F.when((f == "temperature_k") & num.isNotNull(), "temperature_c")
             .otherwise(f).alias("field"),
            F.when(kelvin(num), F.round(num - 273.15, 1)).otherwise(num).alias("num"),
            F.when(num.isNull(), c).alias("txt"), i.alias("col")))

    # only cells of a field are read
    read = F.transform("_cells", lambda c, i: F.when(
        F.get(F.col("_fields"), i).isNotNull() & (F.get(F.col("_fields"), i) != "catalyst_system")
        & ~c.isin(V.EMPTY_CELLS), value(c, i)))
    # found once: a filter on the values would make them a second time
    values = let(F.array_compact(read), lambda vs: F.when(F.exists(vs, lambda v: v["num"].isNotNull()), vs))
    return t.select(
        F.format_string("%s::docling::t%02d::r%02d", "slug", "table_idx", "row_idx")
        .alias("evidence_id"),
        F.col("doc").alias("source_doi"), label.alias("catalyst_system"),
        reference.alias("source_reference"), F.inline(values))


def points_from_ragged(rows: DataFrame, x_patterns: list[str], y_pattern: str,
                       x_range=(-50.0, 600.0), y_range=(0.0, 100.0),
                       kelvin_above: float = 400.0) -> DataFrame:
    """Per table row the first header that fits x and y, values read, ranges applied."""
    # headers pair with cells up to the shorter of the two
    pairs = F.filter(F.arrays_zip("headers", "cells"), lambda p: p["headers"].isNotNull()
                     & p["cells"].isNotNull())
    fits_x = F.filter(pairs, lambda p: _all_match(p["headers"], x_patterns)
                      & (loose_float(p["cells"]) > 0))
    fits_y = F.filter(pairs, lambda p: p["headers"].rlike("(?i)" + y_pattern))
    x = loose_float(F.get(fits_x, F.lit(0))["cells"])
    out = rows.select(
        "doc", F.get("cells", F.lit(0)).alias("label"),
        F.when(x > kelvin_above, x - 273.15).otherwise(x).alias("x"),
        loose_float(F.get(fits_y, F.lit(0))["cells"]).alias("y"))
    return out.filter((F.col("x") > x_range[0]) & (F.col("x") < x_range[1])
                      & F.col("y").between(*y_range) & (F.col("y") != 0) & (F.col("x") != 0))


def _all_match(header: Column, patterns: list[str]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & header.rlike(p)
    return out
