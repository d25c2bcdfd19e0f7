"""Document-level text operators: chunks, sections, references, entity lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as TX
from recordloom.functions import vocabulary as V
from recordloom.functions.base import capped, let, quiet_int
from recordloom.operators.ordering import (carry_forward, first_by, with_neighbours,
                                           with_position)
from recordloom.session import cut, spread


def chunk_pages(pages: DataFrame, limit: int = 1800, threshold: int = 3,
                patterns=tuple(V.HIGH_VALUE_PATTERNS)) -> DataFrame:
    """``slug, page, text`` to scored chunks with stable ids; no shuffle."""
    chunks = pages.select("slug", "page", F.posexplode(TX.page_chunks(F.col("text"), limit))
                          .alias("_p", "text"))
    return (chunks.withColumn("chunk_no", F.col("_p") + 1)
            .withColumn("chunk_id", F.format_string("%s::p%03d::c%02d", "slug", "page",
                                                    "chunk_no"))
            .withColumn("high_value_score", TX.score_patterns(F.col("text"), patterns))
            .withColumn("is_high_value", F.col("high_value_score") >= threshold).drop("_p"))


def carry_forward_heading(chunks: DataFrame) -> DataFrame:
    """A numbered heading names the section of the chunks that follow."""
    marked = chunks.withColumn("_h", TX.numbered_heading(F.col("text")))
    return carry_forward(marked, ["slug"], ["page", "chunk_no"], "_h", "section",
                         block_on="page", block_size=64).drop("_h")


def carry_forward_section(chunks: DataFrame, keys: list[str], order: list[str],
                          block_on: str | None = None, block_size: int = 64) -> DataFrame:
    """Detected section names carried forward; ``preamble`` before the first."""
    marked = chunks.withColumn("_s", TX.detect_section(F.col("text")))
    return carry_forward(marked, keys, order, "_s", "section_norm", default="preamble",
                         block_on=block_on, block_size=block_size).drop("_s")


def chunk_documents(pages: DataFrame, **kw) -> DataFrame:
    """Pages to chunks with their section."""
    return carry_forward_heading(chunk_pages(pages, **kw))


def select_high_value(chunks: DataFrame) -> DataFrame:
    return chunks.filter("is_high_value").orderBy(F.desc("high_value_score"), "page")


def select_by_section(chunks: DataFrame, keys: list[str], order: list[str],
                      paper_type: str = "paper_type", block_on: str | None = None,
                      block_size: int = 64, min_keep: int = 8,
                      keep_share: float = 0.25) -> DataFrame:
    """Section-aware selection for primary papers, the high-value set for all others.

    A paper left with too little goes back to its high-value set. The counts per paper are an
    aggregate joined back, so a long paper stays spread over tasks.
    """
    # scores and headings are worked out once; everything below reads them back
    marked = cut(chunks.withColumn("_s", TX.detect_section(F.col("text"))))
    c = carry_forward(marked, keys, order, "_s", "section_norm", default="preamble",
                      block_on=block_on, block_size=block_size).drop("_s")
    inside = (~F.col("section_norm").isin(V.DROPPED_SECTIONS)
              & (F.col("section_norm").isin(V.KEPT_SECTIONS) | F.col("is_high_value")))
    c = c.withColumn("_keep", inside)
    counts = c.groupBy(*keys).agg(F.count_if("_keep").alias("_kept"),
                                  F.count_if("is_high_value").alias("_hv"))
    need = F.greatest(F.lit(min_keep), F.floor(F.col("_hv") * keep_share))
    revert = (F.col("_kept") < need) & (F.col("_hv") > 0)
    plain = F.coalesce(F.col(paper_type), F.lit("")) != "primary"
    return (c.join(counts, keys)
            .filter(F.when(plain | revert, F.col("is_high_value")).otherwise(F.col("_keep")))
            .drop("_keep", "_kept", "_hv"))


def neighbour_text(chunks: DataFrame, keys: list[str], order: list[str], reach: int = 2,
                   block_on: str | None = None, block_size: int = 4096,
                   into: str = "local_text") -> DataFrame:
    """Text of the chunks i-reach .. i+reach in document order."""
    placed = with_position(chunks, keys, order, block_on, block_size)
    return with_neighbours(placed, keys, "pos", "text", reach, reach, into)


def sections_of(docs: DataFrame, keys: list[str], md: str = "md") -> DataFrame:
    """Markdown documents to one row per section."""
    return docs.select(*keys, F.posexplode(TX.markdown_sections(F.col(md))).alias("ord", "_s")) \
        .select(*keys, "ord", F.col("_s.name").alias("name"), F.col("_s.cls").alias("cls"),
                F.col("_s.text").alias("text"))


def detect_paper_type(sections: DataFrame, refs: DataFrame, keys: list[str],
                      many_refs: int = 80, head_characters: int | None = 500) -> DataFrame:
    """primary or review, from sections, number of references, and words in the first sections (in
    their first `head_characters`, or anywhere without a limit)."""
    words = F.lit(False)
    head = F.lower(capped(F.col("text"), head_characters))
    for w in V.REVIEW_WORDS:
        words = words | head.contains(w)
    s = sections.groupBy(*keys).agg(
        F.bool_or(F.col("cls") == "experimental").alias("_exp"),
        F.bool_or((F.col("ord") < 3) & words).alias("_rev"))
    n = refs.groupBy(*keys).agg(F.count_distinct("ref_num").alias("_n"))
    return s.join(n, keys, "left").select(*keys, (
        F.when(F.col("_exp"), "primary")
        .when(F.coalesce("_n", F.lit(0)) > many_refs, "review")
        .when(F.col("_rev"), "review").otherwise("primary")).alias("paper_type"))


def reference_entries(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Numbered references of reference-list chunks; a later chunk overwrites a number."""
    found = (chunks.filter(TX.is_reference_chunk(F.col("text")))
             .select(*keys, *order, F.explode(TX.parse_reference_chunk(F.col("text")))
                     .alias("_r"))
             .select(*keys, *order, F.col("_r.num").alias("ref_num"),
                     F.col("_r.text").alias("citation_text")))
    return first_by(found, [*keys, "ref_num"], [F.col(o).desc() for o in order]).drop(*order)


def dedupe_entities(entities: DataFrame, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Per chunk the distinct words, best score first.

    Input: ``chunk_id, pos, word, score``; words under two letters and stop words are dropped.
    """
    w = F.lower(F.trim("word"))
    best = (entities.filter((F.length(F.trim("word")) >= 2) & ~w.isin(list(stopwords) or [""]))
            .groupBy("chunk_id", w.alias("w"))
            .agg(F.max("score").alias("score"), F.min("pos").alias("pos")))
    ranked = F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), F.col("pos"), F.col("w"))))
    return best.groupBy("chunk_id").agg(
        F.transform(ranked, lambda e: e["w"]).alias("materials"))


def chunk_to_record(chunks: DataFrame) -> DataFrame:
    """Draft record of an enriched chunk; chunks with nothing found are dropped.

    Input: ``chunk_id, slug, page, section, text``; tokens and quantities are taken from the text.
    """
    text = F.col("text")
    # tokens and quantities first, what is picked from them next, each in one struct that is used by
    # name: a filter on them would be pushed down and work them out a second time
    found = F.struct(TX.formula_tokens(text).alias("cems"), TX.extract_quantities(text).alias("q"))

    def picked(x):
        slash = F.get(F.filter(x["cems"], lambda t: t.contains("/")), F.lit(0))
        return F.struct(
            F.size(x["cems"]).alias("n"), F.coalesce(slash, F.get(x["cems"], F.lit(0))).alias("catalyst_system"),
            TX.pick_conversion(text).alias("conversion"), TX.pick_selectivity(text, x["q"]).alias("selectivity"),
            TX.pick_quantity(x["q"], "temperature").alias("temperature"),
            TX.pick_quantity(x["q"], "pressure").alias("pressure"))

    def there(p):
        filled = sum((p[x].isNotNull().cast("int") for x in (
            "conversion", "selectivity", "temperature", "pressure")), F.lit(0))
        return F.when((p["n"] > 0) | (filled > 0), F.array(F.struct(p.alias("p"), filled.alias("filled"))))

    c = spread(chunks).select("slug", "chunk_id", "page", F.inline(let(let(found, picked), there)))
    c = c.select("slug", "chunk_id", "page", "filled", "p.*").withColumn(
        "parts", TX.decompose_label(F.col("catalyst_system")))
    place = F.split("chunk_id", "::")
    return c.select(
        F.concat_ws("::", "slug", F.lit("cde"), F.try_element_at(place, F.lit(-2)),
                    F.try_element_at(place, F.lit(-1))).alias("evidence_id"),
        "chunk_id", "page", "catalyst_system",
        F.col("parts.actives").alias("actives"),
        F.col("parts.supports").alias("supports"),
        F.col("parts.promoters").alias("promoters"), "conversion",
        F.col("selectivity.value").alias("selectivity"),
        F.col("selectivity.product").alias("product"),
        F.concat_ws(" ", "temperature.value", "temperature.unit").alias("temperature"),
        F.concat_ws(" ", "pressure.value", "pressure.unit").alias("pressure"),
        (F.col("conversion").isNull() & F.col("selectivity").isNull()).alias("needs_manual_check"),
        F.when((F.col("filled") >= 2) & (F.col("n") >= 1), "high")
        .when((F.col("filled") >= 1) | (F.col("n") >= 1), "medium").otherwise("low")
        .alias("confidence"))


def merge_lookups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Reference lists merged per document; a new entry overrides the old one."""
    both = (old.withColumn("_new", F.lit(0))
            .unionByName(new.withColumn("_new", F.lit(1))))
    return first_by(both, keys, [F.desc("_new")]).drop("_new")


def expand_page_range(c: Column) -> Column:
    """'31-34,40' to page numbers."""
    def pages(p):
        lo = quiet_int(F.regexp_extract(p, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1))
        hi = quiet_int(F.regexp_extract(p, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2))
        one = quiet_int(F.trim(p))
        return F.when(lo <= hi, F.sequence(lo, hi)).when(one.isNotNull(), F.array(one)) \
                .otherwise(F.array().cast("array<bigint>"))
    return F.flatten(F.transform(F.split(c, ","), pages))
