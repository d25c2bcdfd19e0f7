"""Text segmentation, scoring and extraction as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import vocabulary as V
from recordloom.functions.base import (any_contains, capped, first_rule, let, lits, nonblank, quiet_int, strip)
from recordloom.functions.normalize import clean_doi, normalize_text

SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9\[])"
_LINE_BREAKS = r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def split_paragraphs(page: Column) -> Column:
    """Page text to array of normalised paragraphs; blank lines divide, empty ones are dropped."""
    text = F.regexp_replace(F.coalesce(page, F.lit("")), _LINE_BREAKS, "\n")
    blocks = F.split(text, r"\n(?:(?U)[^\S\n]*\n)+")
    return F.filter(F.transform(blocks, normalize_text), lambda p: F.length(p) > 0)


def _pack(pieces: Column, limit: int, glue: str) -> Column:
    """Greedy packing: a piece opens a new chunk when both lengths together pass the limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"),
                     F.lit(0).alias("size"))

    def step(acc, piece):
        n = F.length(piece)
        full = (acc["size"] + n > limit) & (acc["size"] > 0)
        fresh = full | (acc["size"] == 0)
        return F.struct(
            F.when(full, F.array_append(acc["done"], strip(acc["open"])))
             .otherwise(acc["done"]).alias("done"),
            F.when(fresh, piece).otherwise(F.concat(acc["open"], F.lit(glue), piece))
             .alias("open"),
            F.when(fresh, n).otherwise(acc["size"] + len(glue) + n).alias("size"))

    def close(acc):
        return let(strip(acc["open"]), lambda last: F.when(
            F.length(last) > 0, F.array_append(acc["done"], last)).otherwise(acc["done"]))

    return F.aggregate(pieces, start, step, close)


def pack_sentences(text: Column, limit: int = 1800) -> Column:
    """Text over the limit to sentence groups; shorter text stays whole."""
    return F.when(F.length(text) > limit, _pack(F.split(strip(text), SENTENCE_GAP), limit, " ")) \
            .otherwise(F.array(text))


def pack_paragraphs(text: Column, limit: int = 6000) -> Column:
    """Text over the limit to groups of paragraphs; shorter text stays whole."""
    return F.when(F.length(text) <= limit, F.array(text)) \
            .otherwise(_pack(F.split(text, "\n\n"), limit, "\n\n"))


def page_chunks(page: Column, limit: int = 1800) -> Column:
    return F.flatten(F.transform(split_paragraphs(page), lambda p: pack_sentences(p, limit)))


def score_patterns(c: Column, patterns=tuple(V.HIGH_VALUE_PATTERNS)) -> Column:
    """How many different patterns occur.

    A pattern that is a plain word is first looked for as a substring, which is far cheaper than
    the word-boundary match and fails for most words.
    """
    def hit(both, p):
        match = both["text"].rlike("(?iU)" + p)
        word = re.fullmatch(r"\\b([A-Za-z0-9 -]+)\\b", p)
        return match if word is None else both["low"].contains(word.group(1).lower()) & match

    def hits(both):
        return sum((hit(both, p).cast("int") for p in patterns), F.lit(0))

    # bound once: dozens of inlined matches would not fit one generated method
    return let(F.struct(c.alias("text"), F.lower(c).alias("low")), hits)


def detect_section(c: Column, near_start: int | None = 300) -> Column:
    """Section name from a heading at the start, else inside the first `near_start` characters (the
    whole text without a limit), else NULL."""
    at_start = F.regexp_extract(c, rf"(?iU)^\s*(?:\d[\d.]*\.?\s+)?({V.SECTION_WORDS})", 1)
    inline = F.regexp_extract(
        capped(c, near_start),
        rf"(?imU)(?:^|[.\n]\s{{0,4}})(?:\d[\d.]*\.?\s+)?({V.SECTION_WORDS})\b", 1)
    # most chunks hold no section word near their start; a substring test settles that
    near = F.lower(capped(F.ltrim(c), None if near_start is None else max(near_start, 300)))
    return F.when(any_contains(near, V.SECTION_STEMS),
                  F.lower(strip(F.coalesce(nonblank(at_start), nonblank(inline)))))


def numbered_heading(c: Column) -> Column:
    """A short numbered line is a heading; else NULL."""
    return F.when(c.rlike(r"(?U)^(\d+(?:\.\d+)*\.?\s+)\S") & (F.length(c) < 120), c)


def classify_section(name: Column, classes: dict[str, str] | None = None) -> Column:
    rules = classes or V.SECTION_CLASSES
    return first_rule([(name.rlike("(?iU)" + p), k) for k, p in rules.items()], "other")


def markdown_sections(md: Column) -> Column:
    """Markdown to array<struct<name, cls, text>>; text before any heading is 'header'."""
    heading = r"(?U)^#{1,3}[^\S\n]"
    pieces = F.split(F.coalesce(md, F.lit("")), r"(?U)(?<=\n)(?=#{1,3}[^\S\n])")

    def section(p):
        first = F.substring_index(p, "\n", 1)
        name = F.when(p.rlike(heading), strip(F.btrim(first, F.lit("#")))).otherwise("header")
        body = F.when(p.rlike(heading),
                      F.when(p.contains("\n"), F.regexp_replace(p, r"^[^\n]*\n", ""))
                       .otherwise("")).otherwise(p)
        return F.struct(name.alias("name"), classify_section(name).alias("cls"),
                        strip(body).alias("text"))

    return F.filter(F.transform(pieces, section), lambda s: F.length(s["text"]) > 0)


#: Openers on both sides of a long number among which its neighbours in a running count are looked for.
_COUNT_REACH = 4
_OPENER = r"(?U)(?<!\d)(\d{1,9})(?:\)\s*|\.\s+)(?=[A-Z])"
_LINE_OPENER = r"(?Um)^[^\S\n]*[-•]?[^\S\n]*[\(\[]?(\d{1,9})[\)\]]?[^\S\n]*[.)]?[^\S\n]+"


def entry_numbers(c: Column, opener: str = _OPENER) -> Column:
    """What an entry number can be in this text, as an alternative of a pattern.

    Up to three digits always. A longer number opens an entry if the one before or after it in a
    running count opens another nearby. In the range of years, which stand at the end of entries, it needs
    two such neighbours, and one in that range right beside it.
    """
    def fits(o, i):
        first = F.greatest(i - _COUNT_REACH, F.lit(0))
        near = F.slice(o["all"], first + 1, 2 * _COUNT_REACH + 1)
        n = F.get(o["all"], i)
        has = {k: F.array_contains(near, n + k) for k in (-2, -1, 1, 2)}
        year = n.between(1900, 2099)
        beside = F.exists(F.slice(o["all"], F.greatest(i, F.lit(1)), 3), lambda m: m.between(1900, 2099) & (m != n))
        return (n > 999) & F.when(year, beside & ((has[-1] & has[1]) | (has[-1] & has[-2]) | (has[1] & has[2]))).otherwise(has[-1] | has[1])

    def long_ones(o):
        index = F.sequence(F.lit(0), F.size(o["all"]) - 1)
        return F.array_distinct(F.transform(F.filter(index, lambda i: fits(o, i)), lambda i: F.get(o["all"], i).cast("string")))

    numbers = F.transform(F.regexp_extract_all(c, F.lit(opener), F.lit(1)), lambda x: x.cast("int"))
    some = let(F.struct(numbers.alias("all")), lambda o: F.when(F.exists(o["all"], lambda n: n > 999), long_ones(o)))
    return F.array_join(F.concat(F.array(F.lit(r"\d{1,3}")), F.coalesce(some, F.array().cast("array<string>"))), "|")


def _with_numbers(c: Column, body, opener: str = _OPENER) -> Column:
    """`body(text, of)`; of(pattern) puts the possible entry numbers where the pattern has #."""
    def bound(p):
        def of(pattern):
            parts = pattern.split("#")
            return F.concat(*[x for i, part in enumerate(parts) for x in ([p["n"]] * (i > 0) + [F.lit(part)])])
        return body(p["c"], of)

    return let(F.struct(c.alias("c"), entry_numbers(c, opener).alias("n")), bound)


def is_reference_chunk(c: Column) -> Column:
    """A chunk that is a reference list: numbered entries with author and journal marks."""
    return _with_numbers(c, _is_reference_chunk)


def _is_reference_chunk(c: Column, of) -> Column:
    dotted = F.regexp_count(c, of(r"(?U)\b(?:#)\.\s+[A-Z][a-z]+"))
    bracketed = F.regexp_count(c, of(r"(?U)\((?:#)\)\s*[A-Z][a-z]+"))
    et_al = F.regexp_count(c, F.lit(r"et al\."))
    journals = F.regexp_count(
        c, F.lit(r"(?U)(?:J\.|Chem\.|Phys\.|Nat\.|ACS |Angew\.|Catal\.)\s"))
    semicolons = F.regexp_count(c, F.lit(r"(?U)[A-Z]\.\s+[A-Z][a-z]+;"))
    numbered = dotted + bracketed
    return (((numbered >= 4) & (et_al >= 2)) | ((numbered >= 5) & (journals >= 4))
            | ((bracketed >= 5) & (semicolons >= 3)))


def _numbered_pairs(c: Column, pattern: Column) -> Column:
    nums = F.regexp_extract_all(c, pattern, F.lit(1))
    texts = F.regexp_extract_all(c, pattern, F.lit(2))
    return F.zip_with(nums, texts, lambda n, t: F.struct(n.alias("num"), t.alias("text")))


def _last_per_number(pairs: Column) -> Column:
    """A number given twice keeps its later text."""
    ordered = F.array_sort(F.transform(pairs, lambda p, i: F.struct(
        p["num"].alias("num"), i.alias("ord"), p["text"].alias("text"))))
    last = let(ordered, lambda o: F.filter(o, lambda p, i: F.coalesce(
        F.get(o, i + 1)["num"] != p["num"], F.lit(True))))
    return F.transform(last, lambda p: F.struct(p["num"].alias("num"), p["text"].alias("text")))


def parse_reference_chunk(c: Column) -> Column:
    """array<struct<num, text>>: bracketed form; with fewer than 3, dotted form; then the fallback."""
    return _with_numbers(c, _parse_reference_chunk)


def _parse_reference_chunk(c: Column, of) -> Column:
    bracket = F.filter(
        F.transform(_numbered_pairs(c, of(r"(?U)\((#)\)\s*([A-Z][^\n]{10,})")),
                    lambda p: F.struct(p["num"].alias("num"), strip(p["text"]).alias("text"))),
        lambda p: p["text"].rlike(r"(?U);|et al\.|19\d{2}|20\d{2}"))
    opener = r"(?<!\d)\b(?:#)\.\s+(?=[A-Z])"
    dotted = F.transform(
        _numbered_pairs(c, of(rf"(?Us)(?<!\d)\b(#)\.\s+(?=[A-Z])(.*?)(?={opener}|\z)")),
        lambda p: F.struct(p["num"].alias("num"),
                           strip(F.substring_index(p["text"], "\n", 1)).alias("text")))
    fallback = F.transform(
        _numbered_pairs(c, of(r"(?U)\b(#)\.\s+([A-Z][^.]{5,}\.)")),
        lambda p: F.struct(p["num"].alias("num"), strip(p["text"]).alias("text")))

    def extend(pairs, more):
        return let(pairs, lambda found: F.when(F.size(found) >= 3, found).otherwise(
            let(F.concat(found, more), _last_per_number)))

    return extend(extend(let(bracket, _last_per_number), dotted), fallback)


_REF_LINE = r"[^\S\n]*[-•]?[^\S\n]*[\(\[]?(#)[\)\]]?[^\S\n]*[.)]?[^\S\n]+"


def parse_reference_section(md: Column, longest: int | None = None) -> Column:
    """array<struct<num, text>> of the list below the References heading; cut only if a limit is given."""
    heading = (r"(?is)^(?:.*?\n)?(?:#[^\n]*(?:REFERENCES|Bibliography)[^\n]*"
               r"|[^\n]*■ REFERENCES[^\n]*)(?:\n|$)")
    kind = "array<struct<num:string,text:string>>"

    def entries(tail, of):
        line = let(of(r"(?U)^" + _REF_LINE + r"([^\n]*)"), lambda x: x)
        first = lambda p, group: F.get(F.regexp_extract_all(p, line, F.lit(group)), F.lit(0))

        def entry(p):
            rest = F.filter(F.transform(F.slice(F.split(p, "\n"), 2, F.greatest(
                F.size(F.split(p, "\n")), F.lit(1))), strip), lambda x: F.length(x) > 0)
            return F.struct(first(p, 1).alias("num"),
                            capped(strip(F.array_join(F.concat(F.array(first(p, 2)), rest), " ")),
                                   longest).alias("text"))

        pieces = F.split(tail, of(r"(?U)\n(?=" + _REF_LINE.replace("(#)", "(?:#)") + ")"))
        found = F.transform(F.filter(pieces, lambda p: F.call_function("rlike", p, line)), entry)
        return let(F.filter(found, lambda e: F.length(e["text"]) > 0), _last_per_number)

    kept = _with_numbers(F.regexp_replace(md, heading, "\n"), entries, _LINE_OPENER)
    return F.when(md.rlike(heading), kept).otherwise(F.array().cast(kind))


def _unit_kind(unit: Column) -> Column:
    key = F.replace(F.lower(strip(unit)), F.lit(" "), F.lit(""))
    rules = [(key.startswith(k), v) for k, v in V.UNIT_KINDS.items()]
    rules += [(key.rlike("m2|m²"), "surface_area"), (key.rlike("mmol|μmol|mol"), "amount"),
              (key.rlike("ml|cm3"), "volume_or_yield")]
    return first_rule(rules, "unknown")


def extract_quantities(c: Column) -> Column:
    """array<struct<value, unit, quantity_type, source>> of numbers or ranges with a unit."""
    pattern = rf"(?iU)(-?\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?)\s*({V.QUANTITY_UNITS})"
    values = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    return F.zip_with(values, units, lambda v, u: F.struct(
        strip(v).alias("value"), strip(u).alias("unit"), _unit_kind(u).alias("quantity_type"),
        F.lit("regex").alias("source")))


def formula_tokens(c: Column, stop=tuple(V.NOT_FORMULAE)) -> Column:
    """Sorted set of formula-like words: slash-joined ones and sequences of element symbols."""
    slash = F.regexp_extract_all(c, F.lit(
        r"(?U)\b[A-Z][a-z]?(?:[-–][A-Z][a-z]?)*(?:\d+[A-Z][a-z]*\d*)?/[A-Za-z0-9]+\b"), F.lit(0))
    symbols = F.regexp_extract_all(c, F.lit(r"(?U)\b(?:[A-Z][a-z]?)+\b"), F.lit(0))
    found = F.concat(F.filter(slash, lambda t: F.length(t) >= 4),
                     F.filter(symbols, lambda t: F.length(t).between(3, 20)))
    return F.array_sort(F.array_except(found, lits(stop)))


def expand_citations(c: Column, with_ref_words: bool = True, digits: int = 9,
                     widest: int = 100_000) -> Column:
    """Sorted distinct numbers of '[12,15-18]' and 'ref N' marks.

    A mark over more than ``widest`` numbers is a slip and stands for its two ends.
    """
    lists = F.regexp_extract_all(c, F.lit(
        rf"(?U)\[(\d{{1,{digits}}}(?:[,\s\-–]+\d{{1,{digits}}})*)\]"), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda m: F.split(m, r"(?U)[,\s]+")))

    def numbers(p):
        lo = quiet_int(F.regexp_extract(p, r"^(\d+)[-–](\d+)", 1))
        hi = quiet_int(F.regexp_extract(p, r"^(\d+)[-–](\d+)", 2))
        return F.when((lo <= hi) & (hi - lo <= widest), F.sequence(lo, hi)) \
                .when(lo <= hi, F.array(lo, hi)) \
                .when(p.rlike(r"^\d+$"), F.array(quiet_int(p))) \
                .otherwise(F.array().cast("array<bigint>"))

    out = F.flatten(F.transform(parts, numbers))
    if with_ref_words:
        words = F.regexp_extract_all(c, F.lit(
            rf"(?U)[Rr]ef\.?\s*(\d{{1,{digits}}})"), F.lit(1))
        out = F.concat(out, F.transform(words, quiet_int))
    return F.array_sort(F.array_distinct(out))


def citation_list(c: Column, digits: int = 9, widest: int = 100_000) -> Column:
    """Numbers of one reference mark in reading order; '12-15' is spelled out, unless wider than that."""
    parts = F.split(F.regexp_replace(c, r"[\[\]\(\)]", " "), r"(?U)[,;\s]+")

    def numbers(p):
        span = rf"^(\d{{1,{digits}}})[-–](\d{{1,{digits}}})$"
        lo, hi = (quiet_int(F.regexp_extract(p, span, n)) for n in (1, 2))
        inner = F.when(hi - lo <= widest, F.sequence(lo, hi)).otherwise(F.array(lo, hi))
        return F.when(lo <= hi, F.transform(inner, lambda n: n.cast("string"))) \
                .when(p.rlike(rf"^\d{{1,{digits}}}$"), F.array(p)) \
                .otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(parts, numbers))


def reference_number(c: Column, digits: int = 9) -> Column:
    """Number of 'Ref. [59]', '(12)', 'ref 7', '59': first form that fits."""
    n = rf"\d{{1,{digits}}}"
    s = strip(c)
    return F.coalesce(*[nonblank(F.regexp_extract(s, p, 1)) for p in (
        rf"\[({n})\]", rf"\(({n})\)", rf"(?iU)ref\.?\s*({n})", rf"^({n})$")])


def citation_title(c: Column, longest: int | None = None) -> Column:
    """Title part of a citation by four known shapes, else the whole; cut only if a limit is given."""
    upto = "{15,}" if longest is None else f"{{15,{longest}}}"
    shapes = [
        r"(?U)\(\d{4}\)\.\s+([A-Z][^.]" + upto + ")",
        r"(?U)et al\.?\s+([A-Z][^.]" + upto + ")",
        r"(?U)\(\d{4}\)\s+([A-Z][^.]" + upto + ")",
        r"(?U)(?:;\s*[A-Z][a-z]+,\s+[A-Z]\.(?:\s+[A-Z]\.)*\s+)([A-Z][^.]" + upto + r"\.)",
    ]
    found = [nonblank(strip(F.regexp_extract(c, s, 1))) for s in shapes]
    return F.coalesce(*found, strip(capped(c, longest)))


def doi_in_text(c: Column) -> Column:
    raw = F.regexp_extract(c, r"(?iU)\b(10\.\d{4,9}/[^\s,;\]\)\"'<>]{4,})", 1)
    return nonblank(clean_doi(raw))


def page_has_table(c: Column) -> Column:
    """A line that opens with 'Table n'."""
    return c.rlike(r"(?iU)(?:^|\n)\s*Table\s+\d+")


def decompose_label(c: Column) -> Column:
    """'K-Cu-Fe/ZnO-Al2O3' to struct<actives, supports, promoters>."""
    metal = F.substring_index(c, "/", 1)
    carrier = F.when(c.contains("/"), F.regexp_replace(c, r"(?s)^[^/]*/", "")).otherwise("")
    tokens = F.transform(F.split(metal, r"(?U)[-–,\s]+"), strip)
    return F.struct(
        F.filter(tokens, lambda t: t.isin(V.KNOWN_ACTIVES)).alias("actives"),
        F.filter(lits(sorted(V.KNOWN_SUPPORTS)),
                 lambda s: F.contains(F.lower(carrier), F.lower(s))).alias("supports"),
        F.filter(tokens, lambda t: t.isin(V.KNOWN_PROMOTERS)).alias("promoters"))


def pick_conversion(c: Column) -> Column:
    p = (r"(?iU)(?:CO2|CO₂)\s+conversion\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*%"
         r"|(\d+(?:\.\d+)?)\s*%\s+(?:CO2|CO₂)\s+conversion")
    return F.coalesce(nonblank(F.regexp_extract(c, p, 1)), nonblank(F.regexp_extract(c, p, 2)))


def pick_selectivity(c: Column, quantities: Column) -> Column:
    """struct<value, product>: 'n % selectivity to X', 'n % X selectivity', else the first percentage."""
    after = (r"(?iU)(\d+(?:\.\d+)?)\s*%\s*(?:selectivity|sel\.?)"
             r"(?:\s+(?:to|toward|for)\s+(\w[\w\s+]*?))?(?=[,\.;\s]|$)")
    before = r"(?iU)(\d+(?:\.\d+)?)\s*%\s+(\w[\w+ ]*?)\s+(?:selectivity|sel\.?)"
    share = F.get(F.filter(quantities, lambda q: q["quantity_type"] == "percentage"),
                  F.lit(0))["value"]

    def pair(value, product):
        return F.struct(value.alias("value"), product.alias("product"))

    return F.when(c.rlike(after), pair(F.regexp_extract(c, after, 1),
                                       nonblank(strip(F.regexp_extract(c, after, 2))))) \
            .when(c.rlike(before), pair(F.regexp_extract(c, before, 1),
                                        strip(F.regexp_extract(c, before, 2)))) \
            .when(share.isNotNull(), pair(share, F.lit(None).cast("string")))


def pick_quantity(quantities: Column, kind: str) -> Column:
    return F.get(F.filter(quantities, lambda q: q["quantity_type"] == kind), F.lit(0))


def first_json(c: Column) -> Column:
    """Outermost {...} of a reply as text; NULL where it is not valid JSON."""
    body = nonblank(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    return F.when(F.try_parse_json(body).isNotNull(), body)
