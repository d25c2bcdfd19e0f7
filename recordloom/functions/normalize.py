"""Normalisers for labels, headers, values, units and identifiers: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import vocabulary as V
from recordloom.functions.base import (any_contains, first_rule, let, lits, nonblank,
                                       quiet_double, quiet_int, squeeze, strip, strip_chars)

_EDGE = " :_^."
_SLASH_UNIT = r"(?U)\s*/\s*([^/]+?)\s*$"


def fix_artifacts(c: Column) -> Column:
    """Repair extraction artefacts: subscripts, ligatures, glyph marks, bold marks, line breaks."""
    s = F.translate(F.coalesce(c.cast("string"), F.lit("")), *V.SUBSCRIPT_DIGITS)
    for broken, good in V.LIGATURES.items():
        s = F.replace(s, F.lit(broken), F.lit(good))
    s = let(s, lambda x: F.when(
        x.contains("GLYPH<"),
        strip_chars(F.regexp_replace(x, r"(?U)\s*GLYPH<[^>]*>\s*", "-"), "-")).otherwise(x))
    return F.translate(F.replace(s, F.lit("**"), F.lit("")), "\r\n", "  ")


def clean_header(c: Column) -> Column:
    """Header text to struct<name, unit>."""
    def unit_of_brackets(h):
        groups = F.filter(F.regexp_extract_all(h, F.lit(V.BRACKET), F.lit(1)),
                          lambda g: g.rlike(V.UNIT_HINT))
        return strip(F.try_element_at(groups, F.lit(-1)))

    def bare_name(h):
        out = F.regexp_replace(F.regexp_replace(h, V.BRACKET, ""), V.SUPERSCRIPTS, "")
        return strip_chars(squeeze(out), _EDGE)

    def with_slash_unit(p):
        tail = F.regexp_extract(p["name"], _SLASH_UNIT, 1)
        is_unit = (p["unit"].isNull() & (F.length(tail) > 0) & (F.length(tail) <= 12)
                   & tail.rlike(V.UNIT_HINT))
        return F.struct(
            F.when(is_unit, strip_chars(F.regexp_replace(p["name"], _SLASH_UNIT, ""), _EDGE))
             .otherwise(p["name"]).alias("name"),
            F.when(is_unit, strip(tail)).otherwise(p["unit"]).alias("unit"))

    def without_footnote_letter(p):
        short = strip_chars(F.regexp_replace(p["name"], r"(?iU)[\s_^.]+[a-f]$", ""), _EDGE)
        return F.struct(F.coalesce(nonblank(short), p["name"]).alias("name"),
                        p["unit"].alias("unit"))

    text = F.regexp_replace(fix_artifacts(strip(F.coalesce(c, F.lit("")))), V.FOOTNOTE, "")
    parts = let(text, lambda h: F.struct(bare_name(h).alias("name"),
                                         unit_of_brackets(h).alias("unit")))
    return let(let(parts, with_slash_unit), without_footnote_letter)


def is_na(c: Column) -> Column:
    return F.lower(c).isin(V.NA_TOKENS)


def parse_value(c: Column) -> Column:
    """Cell text to struct<num, raw>: NA words to NULL, ranges to their middle, else the lead number."""
    def number(s):
        healed = F.regexp_replace(strip(F.regexp_replace(s, V.FOOTNOTE, "")),
                                  r"(?U)(?<=[\d.])\s+(?=[\d.])", "")

        def read(t):
            span = r"(?U)^([\d.]+)\s*[–\-~to]+\s*([\d.]+)$"
            middle = (quiet_double(F.regexp_extract(t, span, 1))
                      + quiet_double(F.regexp_extract(t, span, 2))) / 2
            lead = quiet_double(F.regexp_extract(t, r"(?U)^[~<>≈]?\s*(-?\d+\.?\d*)", 1))
            return F.coalesce(middle, lead)

        return F.when(~is_na(s), let(healed, read))

    raw = fix_artifacts(strip(F.coalesce(c, F.lit(""))))
    return let(raw, lambda s: F.struct(number(s).alias("num"), s.alias("raw")))


def norm_label(c: Column) -> Column:
    """Light key: artefacts and footnotes dropped, hyphens and blanks unified."""
    s = strip(F.regexp_replace(fix_artifacts(c), V.FOOTNOTE, ""))
    return squeeze(F.translate(s, "–‐−", "---"))


def clean_label(c: Column) -> Column:
    return squeeze(strip(fix_artifacts(c)))


def fuzzy_key(c: Column) -> Column:
    """Key for joining inside one document: lower case, no footnotes, superscripts or separators."""
    s = F.regexp_replace(F.lower(fix_artifacts(c)), V.FOOTNOTE, "")
    return F.regexp_replace(F.regexp_replace(s, V.SUPERSCRIPTS, ""), V.SEPARATORS, "")


def is_numeric_label(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))).rlike(r"(?U)^[\d.\s%/+-]+$")


def is_usable_label(c: Column) -> Column:
    """A label that can name a sample: not empty, not an NA word, not digits only."""
    return (F.length(c) > 0) & ~is_na(c) & ~is_numeric_label(c)


def slugify(c: Column, sep: str = "_", empty: str = "col", limit: int | None = None) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", sep), F.lit(sep))
    if limit is not None:
        s = F.substring(s, 1, limit)
    return F.coalesce(nonblank(s), F.lit(empty))


def attribute_by_unit(name: Column, unit: Column) -> Column:
    """What a short name ("T", "Pa") can only mean by its unit, else NULL."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    short = F.length(strip(F.lower(name))) <= 3
    return first_rule([
        (short & (u.contains("°c") | u.contains("℃") | strip(u).isin("c", "k")), "temperature_c"),
        (short & any_contains(u, ["mpa", "bar", "atm", "kpa", "psi"]), "pressure")])


def normalize_unit(attr: Column, value: Column, unit: Column) -> Column:
    """struct<value, unit> in canonical units; converts only where unit or value leaves no doubt."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    hot = attr == "temperature_c"
    pressure = attr == "pressure"
    acid = attr.isin(V.ACIDITY_ATTRS) & u.contains("mmol")
    kelvin = hot & ~u.contains("c") & (u.contains("k") | (value > 500))
    scales = [("mpa", None), ("bar", 10.0), ("kpa", 1000.0), ("psi", 145.04), ("atm", 9.869)]
    rules = [(kelvin, F.round(value - 273.15, 1)), (acid, F.round(value * 1000.0, 1))]
    for token, divisor in scales:
        scaled = value if divisor is None else F.round(value / divisor, 3)
        rules.append((pressure & u.contains(token), scaled))
    known_pressure = pressure & any_contains(u, [t for t, _ in scales])
    return F.struct(
        first_rule(rules, value).alias("value"),
        first_rule([(value.isNull(), unit), (hot, "°C"), (known_pressure, "MPa"),
                    (acid, "umol/g")], unit).alias("unit"))


# fixed values: identifier prefixes, removed in this order
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "https://dx.doi.org/",
                "http://dx.doi.org/", "doi:", "doi.org/"]


def sanitize_doi(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    for prefix in DOI_PREFIXES:
        s = F.regexp_replace(s, "^" + prefix.replace(".", r"\."), "")
    return s


def clean_doi(c: Column) -> Column:
    """Identifier cut out of a link or text: closing punctuation and query string dropped."""
    return F.regexp_replace(F.rtrim(strip(c), F.lit("/.?,;)")), r"\?.*$", "")


def id_to_slug(c: Column) -> Column:
    return F.replace(sanitize_doi(c), F.lit("/"), F.lit("_"))


def slug_to_id(c: Column, mode: str = "first") -> Column:
    """``first``: first underscore only; ``prefix``: only after 10.dddd; ``all``: every underscore."""
    if mode == "all":
        return F.replace(c, F.lit("_"), F.lit("/"))
    if mode == "prefix":
        return F.regexp_replace(c, r"^(10\.\d{4})_", "$1/")
    return F.regexp_replace(c, r"^([^_]*)_", "$1/")


def strip_tags(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))


def inverted_index(words: Column) -> Column:
    """Words of a text to map<word, positions>, in the row itself: pairs sorted by word are cut into runs."""
    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))

    def runs(sorted_pairs):
        begins = F.filter(F.transform(sorted_pairs, lambda p, i: F.when(
            (i == 0) | (p["word"] != F.get(sorted_pairs, i - 1)["word"]), i)), lambda i: i.isNotNull())
        return let(begins, lambda starts: F.transform(starts, lambda b, k: F.struct(
            F.get(sorted_pairs, b)["word"].alias("key"), F.transform(F.slice(
                sorted_pairs, b + 1, F.coalesce(F.get(starts, k + 1), F.size(sorted_pairs)) - b),
                lambda p: p["pos"]).alias("value"))))

    return F.map_from_entries(let(pairs, runs))


def _positions(index: Column) -> Column:
    pairs = F.flatten(F.transform(
        F.map_entries(index),
        lambda e, i: F.transform(e["value"], lambda p: F.struct(
            p.alias("pos"), e["key"].alias("word"), i.alias("ord")))))
    return pairs


def decode_inverted(index: Column, limit: int | None = None) -> Column:
    """map<word, positions> to text: pairs sorted by position, then cut."""
    text = F.array_join(F.transform(F.array_sort(_positions(index)), lambda p: p["word"]), " ")
    return text if limit is None else F.substring(text, 1, limit)


def decode_inverted_slots(index: Column) -> Column:
    """The slot form: one slot per position, a gap stays empty, the later word keeps a shared slot."""
    ordered = F.array_sort(F.transform(_positions(index), lambda p: F.struct(
        p["pos"].alias("pos"), p["ord"].alias("ord"), p["word"].alias("word"))))

    def render(pairs):
        last = F.filter(pairs, lambda p, i: F.coalesce(
            F.get(pairs, i + 1)["pos"] != p["pos"], F.lit(True)))
        return let(last, lambda slots: F.array_join(F.transform(
            slots, lambda p, i: F.concat(
                F.repeat(F.lit(" "), (p["pos"] - F.coalesce(
                    F.when(i > 0, F.get(slots, i - 1)["pos"]), F.lit(0))).cast("int")),
                p["word"])), ""))

    return F.coalesce(let(ordered, render), F.lit(""))


def safe_float(c: Column) -> Column:
    """Number with an optional percent mark, else NULL."""
    return quiet_double(strip(F.replace(c.cast("string"), F.lit("%"), F.lit(""))))


def loose_float(c: Column) -> Column:
    """Keep digits, dots and minus signs, then read the number, else NULL."""
    return quiet_double(F.regexp_replace(c.cast("string"), r"[^\d.\-]", ""))


def safe_int(c: Column) -> Column:
    return quiet_int(c.cast("string"))


def first_non_null(*cs: Column) -> Column:
    """First value that is there. Zero is a value."""
    return F.coalesce(*cs)


def clean_caption(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    for broken, good in V.LIGATURES.items():
        s = F.replace(s, F.lit(broken), F.lit(good))
    return strip(squeeze(s))


def normalize_text(c: Column) -> Column:
    s = F.replace(F.replace(c, F.lit("(cid:0)"), F.lit("-")), F.lit("(cid:1)"), F.lit(""))
    return strip(squeeze(F.replace(s, F.lit("\u0000"), F.lit(""))))


def map_category(c: Column, aliases: dict[str, str] | None = None, default: str = "Unknown",
                 first_of_list: bool = False, blank_words: tuple[str, ...] = ()) -> Column:
    """Category label: blank to a default, alias table applied, optionally the first of a list."""
    s = strip(F.coalesce(c, F.lit("")))
    if first_of_list:
        s = strip(F.substring_index(s, ",", 1))
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        s = F.coalesce(F.try_element_at(table, s), s)
    blank = F.length(s) == 0
    if blank_words:
        blank = blank | F.lower(s).isin(list(blank_words))
    return F.when(blank, F.lit(default)).otherwise(s)


def short_name(first_author: Column, year: Column, journal: Column, doi: Column) -> Column:
    """File name of a note: year, author, short journal, id tail."""
    unsafe = r'[/\\:*?"<>|]'
    j = F.coalesce(journal, F.lit(""))
    for long, short in ((r"\bJournal of\b", "J."), (r"\bCatalysis\b", "Catal."),
                        (r"\bInternational Edition\b", "")):
        j = F.regexp_replace(j, long, short)
    j = strip(F.regexp_replace(squeeze(strip(j)), unsafe, ""))
    d = F.coalesce(doi, F.lit(""))
    tail = strip(F.regexp_replace(F.regexp_replace(d, "^[^/]*/", ""), unsafe, ""))
    suffix = F.when(F.length(tail) > 0, F.concat(F.lit(" ("), tail, F.lit(")"))).otherwise("")
    return F.concat(F.coalesce(year.cast("string"), F.lit("None")), F.lit(" "),
                    F.coalesce(first_author, F.lit("None")), F.lit(" - "), j, suffix,
                    F.lit(".md"))


