"""Joins that give units, references and labels their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import vocabulary as V
from recordloom.functions.base import first_rule, let, nonblank, strip
from recordloom.functions.normalize import clean_doi, norm_label
from recordloom.functions.text import citation_list, doi_in_text, reference_number
from recordloom.operators.ordering import with_position_and_size
from recordloom.session import cut



def join_papers(units: DataFrame, papers: DataFrame, where: Column | None = None) -> DataFrame:
    """Units with their source paper. Spark broadcasts the papers where their size allows."""
    p = papers if where is None else papers.filter(where)
    return units.join(p.withColumnRenamed("doi", "source_doi"), "source_doi")


def join_papers_either(units: DataFrame, papers: DataFrame,
                       where: Column | None = None) -> DataFrame:
    """``source = doi OR primary = doi`` as an equi join on the exploded pair of ids."""
    p = papers if where is None else papers.filter(where)
    ids = F.array_distinct(F.array_compact(F.array("source_doi", "primary_doi")))
    return units.withColumn("doi", F.explode(ids)).join(p, "doi")


def fill_primary(units: DataFrame, resolved: DataFrame, min_score: float = 0.7) -> DataFrame:
    """Fill ``primary_doi`` where NULL from the resolved references; low scores are flagged.

    resolved: ``source_doi, ref_num, doi, score``.
    """
    # the best resolution of a number, so that a repeated one doubles no unit
    r = (resolved.filter("doi is not null").groupBy("source_doi", "ref_num")
         .agg(F.max(F.struct("score", "doi")).alias("_b"))
         .select("source_doi", "ref_num", F.col("_b.doi").alias("_doi"), F.col("_b.score").alias("score")))
    j = (units.withColumn("ref_num", reference_number(F.col("source_reference")))
         .join(r, ["source_doi", "ref_num"], "left"))
    open_ = F.col("primary_doi").isNull() & F.col("_doi").isNotNull()
    good = open_ & (F.col("score") >= min_score)
    return (j.withColumn("filled", good).withColumn("skipped_low", open_ & ~good)
            .withColumn("primary_doi", F.when(good, F.col("_doi")).otherwise(F.col("primary_doi")))
            .drop("_doi", "score"))


def drop_reference_units(units: DataFrame, reference_chunks: DataFrame) -> DataFrame:
    """Units that came from a reference list are removed."""
    return units.join(reference_chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def match_links_to_refs(links: DataFrame, words: DataFrame, band: float = 64.0) -> DataFrame:
    """Reference number of every link: the number that opens the text block beside it.

    links: ``doc, page, link_id, top, bottom``; words: ``doc, page, text, x0, top, bottom``.
    A range join inside (doc, page), keyed by bands of the page height so that a full page is
    never one task. Only the first word of a block matters, so no block is collected.
    """
    spans = links.groupBy("doc", "page", "link_id").agg(F.min("top").alias("t"),
                                                        F.max("bottom").alias("b"))
    spans = spans.withColumn("lo", F.col("t") - 4).withColumn("hi", F.col("b") + 16)
    spans = spans.filter("hi >= lo").withColumn("_band", F.explode(F.sequence(
        F.floor(F.col("lo") / band), F.floor(F.col("hi") / band))))
    w = words.withColumn("_band", F.floor(F.col("top") / band))
    # words of one height are one row: their first word and how many they are is all that matters
    lines = w.groupBy("doc", "page", "_band", F.col("top").alias("wt"), F.col("bottom").alias("wb")).agg(
        F.min(F.struct("x0", "text")).alias("w"), F.count(F.lit(1)).alias("c"))
    hit = spans.join(lines, ["doc", "page", "_band"]).filter("wt >= lo and wb <= hi")
    first = hit.groupBy("doc", "page", "link_id").agg(
        F.min(F.struct("wt", "w"))["w"]["text"].alias("word"), F.sum("c").alias("n"))
    text = F.when(F.col("n") > 1, F.concat("word", F.lit(" "))).otherwise(F.col("word"))
    num = nonblank(F.regexp_extract(text, r"(?U)^\s*[\[\(]?(\d{1,9})[\]\)\.\s]", 1))
    found = first.withColumn("ref_num", num).filter("ref_num is not null")
    return (found.groupBy("doc", "ref_num")
            .agg(F.min(F.struct("page", "link_id"))["link_id"].alias("doi")))


def _norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(norm_label(c)), r"(?U)\s+", " ")


def _spans_of(cap: Column, n: Column) -> Column:
    """Every piece of n words that begins after an edge or '(' and ends before an edge or ,.;:)."""
    def marks(word, chars):
        return F.filter(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
                        lambda k: F.substring(word, k, F.lit(1)).isin(*chars))

    def from_brackets(piece):
        opens = marks(F.substring_index(piece, " ", 1), ["("])
        return F.array_append(F.transform(opens, lambda k: F.substring(
            piece, k + 1, F.length(piece))), piece)

    def to_stops(piece):
        last = F.substring_index(piece, " ", -1)
        head = F.length(piece) - F.length(last)
        return F.array_append(F.transform(
            marks(last, [",", ".", ";", ":", ")"]),
            lambda k: F.substring(piece, F.lit(1), head + k - 1)), piece)

    def pieces(words):
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1),
                           lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, F.flatten(F.transform(runs, lambda r: F.flatten(
            F.transform(from_brackets(r), to_stops)))))

    found = F.coalesce(let(F.split(cap, " "), pieces), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(found, lambda s: F.length(s) > 0))


#: Parts that the captions of one document are dealt into.
_CAPTION_PARTS = 16


def match_labels_in_captions(labels: DataFrame, figures: DataFrame) -> DataFrame:
    """Records whose label stands in a caption as a whole word group: one row per (figure, record).

    labels: ``doc, rec_key, label_variants``; figures: ``doc, figure, caption``. The caption is cut
    into its possible labels and joined by hash on (doc, text): labels and captions of one document
    are never paired all against all.
    """
    v = labels.select("doc", "rec_key", F.posexplode("label_variants").alias("ord", "variant"))
    v = v.withColumn("key", _norm(F.col("variant")))
    long_enough = F.length(F.replace(F.replace("key", F.lit("-"), F.lit("")), F.lit(" "),
                                     F.lit(""))) >= 3
    v = v.filter(long_enough).withColumn("n_words", F.size(F.split("key", " ")))
    # captions of one document are dealt into parts, and the sizes are the side to build on: packed
    # captions can look small enough to be broadcast, and then one task would cut them all
    sizes = v.select("doc", "n_words").distinct().withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(_CAPTION_PARTS - 1))))
    dealt = figures.withColumn("_part", F.pmod(F.xxhash64("figure"), F.lit(_CAPTION_PARTS)).cast("int"))
    pieces = (dealt.select("doc", "_part", "figure", _norm(F.col("caption")).alias("cap"))
              .join(sizes.hint("shuffle_hash"), ["doc", "_part"])
              .select("doc", "figure", F.explode(_spans_of(F.col("cap"), F.col("n_words")))
                      .alias("key")).distinct())
    return (pieces.join(v, ["doc", "key"]).groupBy("doc", "figure", "rec_key")
            .agg(F.min(F.struct("ord", "variant"))["variant"].alias("matched_on")))


def lookup_tier(name: Column, table=tuple(V.VENUE_TIERS), exact=None) -> Column:
    """struct<tier, impact> of a venue: exact name, exact short name, known name inside it, else '?'."""
    exact = V.VENUE_EXACT if exact is None else exact
    low = F.lower(name)

    def entry(tier, impact):
        return F.struct(F.lit(tier).alias("tier"), F.lit(float(impact)).alias("impact"))

    rules = [(F.coalesce(F.length(name), F.lit(0)) == 0, entry("?", 0.0))]
    rules += [(name == n, entry(t, i)) for n, t, i in table]
    rules += [(low == n, entry(t, i)) for n, (t, i) in exact.items()]
    rules += [(low.contains(n.lower()), entry(t, i)) for n, t, i in table]
    return first_rule(rules, entry("?", 0.0))


#: Rows of the three passes that one task holds on average.
_OVERLAY_ROWS = 300_000


def overlay_passes(p1: DataFrame, p2: DataFrame, p3: DataFrame, fields2: list[str],
                   fields3: list[str]) -> DataFrame:
    """Three extraction passes of a chunk as one list of records.

    Each pass: ``chunk_id, ord, name`` and its fields. Records align by lower-case name and
    position; where a name has no partner the unnamed ones of that pass are used. Unused records
    of the second and third pass follow on their own. A chunk without a first pass gets the base
    ``unknown``. Tasks grow in number with the records, not in size.
    """
    def keyed(df):
        return df.withColumn("key", F.lower(F.trim(F.coalesce("name", F.lit("")))))

    def tagged(df, fields, tag):
        return keyed(df).select("chunk_id", "key", F.lit(tag).alias("tag"), "ord", F.col("name").alias("_name"),
                                *[F.col(f).alias(f"p{tag}_{f}") for f in fields])

    first = cut(keyed(p1).select("chunk_id", "ord", "name", "key", F.lit(True).alias("is_p1")))
    late = cut(tagged(p2, fields2, 2).unionByName(tagged(p3, fields3, 3), allowMissingColumns=True))
    parts = max(int(p1.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-(first.count() + late.count()) // _OVERLAY_ROWS))

    def dealt(df, *keys):
        return df.repartition(parts, *keys)

    # position inside (chunk, name, pass), exact also where one chunk holds very many records
    n = cut(with_position_and_size(late, ["chunk_id", "key", "tag"], "ord", parts))
    n2, n3 = (n.filter(F.col("tag") == t).select(
        "chunk_id", F.col("key").alias(f"k_p{t}"), "idx", *[f"p{t}_{f}" for f in fields]) for t, fields in ((2, fields2), (3, fields3)))
    sizes = dealt(n.filter("idx = 0"), "chunk_id", "key").groupBy("chunk_id", "key").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("size"))).alias(f"_own_p{t}") for t in (2, 3)])
    chunks = (first.select("chunk_id", F.lit(True).alias("_first"))
              .union(n.filter("idx = 0").select("chunk_id", F.lit(False)))
              .union(late.filter("chunk_id is null").select("chunk_id", F.lit(False))))
    bare = dealt(chunks, "chunk_id").groupBy("chunk_id").agg(F.max("_first").alias("_first")).filter("not _first or chunk_id is null").select(
        "chunk_id", F.lit(0).cast(first.schema["ord"].dataType).alias("ord"), F.lit("unknown").alias("name"),
        F.lit("unknown").alias("key"), F.lit(False).alias("is_p1"))
    base = first.unionByName(bare)
    unnamed = sizes.filter("key = ''").select("chunk_id", *[F.col(f"_own_p{t}").alias(f"_unnamed_p{t}") for t in (2, 3)])
    b = (dealt(base, "chunk_id", "key").join(sizes, ["chunk_id", "key"], "left"))
    b = dealt(b, "chunk_id").join(dealt(unnamed, "chunk_id"), "chunk_id", "left")
    for t in (2, 3):
        b = (b.withColumn(f"k_p{t}", F.when(F.col(f"_own_p{t}").isNotNull(), F.col("key"))
                          .when(F.col(f"_unnamed_p{t}").isNotNull(), F.lit("")))
             .withColumn(f"n_p{t}", F.coalesce(f"_own_p{t}", f"_unnamed_p{t}", F.lit(0).cast("long"))))
    b = cut(b.select("chunk_id", "ord", "name", "key", "k_p2", "k_p3", "n_p2", "n_p3"))
    pairs = b.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
        F.lit(1).cast("long"), "n_p2", "n_p3") - 1))).drop("key", "n_p2", "n_p3")
    j = (dealt(pairs, "chunk_id", "k_p2", "idx")
         .join(dealt(n2, "chunk_id", "k_p2", "idx"), ["chunk_id", "k_p2", "idx"], "left"))
    j = (dealt(j, "chunk_id", "k_p3", "idx")
         .join(dealt(n3, "chunk_id", "k_p3", "idx"), ["chunk_id", "k_p3", "idx"], "left"))
    every = list(dict.fromkeys(fields2 + fields3))

    def overlaid(f):
        parts = ([F.col(f"p3_{f}")] if f in fields3 else []) + (
            [F.col(f"p2_{f}")] if f in fields2 else [])
        return F.coalesce(*parts).alias(f)

    matched = j.select("chunk_id", F.lit("base").alias("kind"), "ord", "idx", "name",
                       *[overlaid(f) for f in every])
    # a pass counts as used under the base name, also where its unnamed records served: a record whose
    # name is a base name finds itself among that name's own, so the rest are those without a base name
    lone = dealt(n, "chunk_id", "key").join(dealt(b.select("chunk_id", "key"), "chunk_id", "key"), ["chunk_id", "key"], "left_anti")
    types = {f: matched.schema[f].dataType for f in every}

    def of_pass(f):
        own = [F.when(F.col("tag") == t, F.col(f"p{t}_{f}")).cast(types[f]) for t, fields in ((2, fields2), (3, fields3)) if f in fields]
        return F.coalesce(*own).alias(f)

    return matched.unionByName(lone.select(
        "chunk_id", F.when(F.col("tag") == 2, "p2_only").otherwise("p3_only").alias("kind"), F.lit(-1).alias("ord"),
        "idx", F.col("_name").alias("name"), *[of_pass(f) for f in every]))


def resolve_citation_list(units: DataFrame, resolved: DataFrame, lookup: DataFrame,
                          unit_id: str = "unit_id", min_score: float | None = 0.7) -> DataFrame:
    """Units with a primary id and a citation text from their list of reference numbers.

    The first number with an id wins and ends the search; the citation text is the first one found
    up to there (resolved text, else the reference list).
    """
    nums = units.select(unit_id, "source_doi", F.posexplode(citation_list(
        F.col("source_reference"))).alias("pos", "ref_num"))
    good = F.lit(True) if min_score is None else (F.col("score") >= min_score)
    r = resolved.select("source_doi", "ref_num", F.when(good, F.col("doi")).alias("_doi"),
                        F.col("citation_text").alias("_text"), F.lit(None).cast("string").alias("_listed"))
    k = lookup.select("source_doi", "ref_num", F.lit(None).cast("string").alias("_doi"),
                      F.lit(None).cast("string").alias("_text"), F.col("citation_text").alias("_listed"))
    # one row per document and number, so that a repeated one doubles nothing, and one join
    known = r.unionByName(k).groupBy("source_doi", "ref_num").agg(
        *[F.min(nonblank(F.col(c))).alias(c) for c in ("_doi", "_text", "_listed")])
    j = nums.join(known, ["source_doi", "ref_num"], "left").withColumn(
        "_cit", F.coalesce("_text", "_listed"))
    best = j.groupBy(unit_id).agg(
        F.min(F.when(F.col("_doi").isNotNull(), F.struct("pos", "_doi"))).alias("_d"),
        F.min(F.when(F.col("_cit").isNotNull(), F.struct("pos", "_cit"))).alias("_c"))
    reached = F.col("_d").isNull() | (F.col("_c.pos") <= F.col("_d.pos")) \
        | F.col("primary_doi").isNotNull()
    return (units.join(best, unit_id, "left")
            .withColumn("source_citation_text", F.when(reached, F.col("_c._cit")))
            .withColumn("primary_doi", F.coalesce("primary_doi", "_d._doi"))
            .drop("_d", "_c"))


def score_match(citation: Column, year: Column, first_author: Column) -> Column:
    """0.3, plus 0.4 for the year and 0.3 for the first author's surname."""
    cited = nonblank(F.regexp_extract(citation, r"(19|20)\d{2}", 0))
    surname = F.lower(F.try_element_at(F.split(strip(first_author), r"(?U)\s+"), F.lit(-1)))
    same_year = F.coalesce(cited == year.cast("string"), F.lit(False))
    same_name = F.coalesce((F.length(surname) > 2) & F.lower(citation).contains(surname),
                           F.lit(False))
    return F.round(F.lit(0.3) + F.when(same_year, 0.4).otherwise(0.0)
                   + F.when(same_name, 0.3).otherwise(0.0), 2)


def resolve_refs(refs: DataFrame, links: DataFrame, prior: DataFrame, external: DataFrame,
                 min_score: float = 0.4) -> DataFrame:
    """Reference ids by tier: link, id in the text, earlier result, external lookup.

    refs: ``source_doi, ref_num, citation_text``; links: ``source_doi, ref_num, doi``; prior:
    ``source_doi, ref_num, doi, source, score``; external: ``source_doi, ref_num, doi, title,
    year, first_author`` (the best hit of a caller's search).
    """
    keys = ["source_doi", "ref_num"]
    # one row per number on each right side
    linked = links.groupBy(*keys).agg(F.min("doi").alias("_link"))
    earlier = (prior.groupBy(*keys).agg(F.max(F.struct("score", "doi", "source")).alias("_b"))
               .select(*keys, F.col("_b.doi").alias("_prior"), F.col("_b.source").alias("_psrc"),
                       F.col("_b.score").alias("_pscore"), F.lit(True).alias("_seen")))
    looked_up = (external.withColumn("_ext", clean_doi(F.col("doi"))).groupBy(*keys)
                 .agg(F.min(F.struct("_ext", "title", "year", "first_author")).alias("_b"))
                 .select(*keys, "_b.*"))
    j = (refs.join(linked, keys, "left").join(earlier, keys, "left")
         .join(looked_up, keys, "left"))
    hit = score_match(F.col("citation_text"), F.col("year"), F.col("first_author"))

    def tier(doi, source, title, score):
        return F.struct(doi.alias("doi"), source.alias("source"), title.alias("oa_title"),
                        score.alias("score"))

    none = F.lit(None).cast("string")
    in_text = doi_in_text(F.col("citation_text"))
    accepted = F.when(hit >= min_score, F.col("_ext"))
    best = (F.when(F.col("_link").isNotNull(),
                   tier(F.col("_link"), F.lit("pdf_annotation"), none, F.lit(1.0)))
            .when(in_text.isNotNull(), tier(in_text, F.lit("text_doi"), none, F.lit(0.95)))
            .when(F.col("_prior").isNotNull(),
                  tier(F.col("_prior"), F.col("_psrc"), none, F.col("_pscore")))
            .when(F.col("title").isNotNull() | F.col("_ext").isNotNull(),
                  tier(accepted, F.when(accepted.isNotNull(), "openalex"), F.col("title"), hit))
            .when(F.col("_seen"), tier(none, F.col("_psrc"), none, F.col("_pscore")))
            .otherwise(tier(none, none, none, F.lit(0.0))))
    return j.withColumn("_b", best).select(*keys, "citation_text", "_b.*")


def refs_to_look_up(refs: DataFrame, links: DataFrame, prior: DataFrame,
                    rerun: bool = False) -> DataFrame:
    """References the external search still has to answer; failed ones again with ``rerun``."""
    keys = ["source_doi", "ref_num"]
    open_ = refs.filter(doi_in_text(F.col("citation_text")).isNull())
    done = prior.filter("doi is not null") if rerun else prior
    return open_.join(links.select(*keys), keys, "left_anti").join(done.select(*keys), keys,
                                                                   "left_anti")


def gate_panels(panels: DataFrame, types: DataFrame) -> DataFrame:
    """Panels typed as activity; figures that were never typed pass and are flagged.

    panels: ``image, panel``; types: ``image, panel, type``.
    """
    active = types.filter(F.col("type").isin("activity", "structure_activity_relation")) \
        .select("image", "panel").distinct().withColumn("_ok", F.lit(True))
    typed = types.select("image").distinct().withColumn("_typed", F.lit(True))
    return (panels.join(active, ["image", "panel"], "left").join(typed, "image", "left")
            .withColumn("gated", F.coalesce("_typed", F.lit(False)))
            .filter(F.coalesce("_ok", F.lit(False)) | ~F.col("gated")).drop("_ok", "_typed"))


def activity_figures(types: DataFrame) -> DataFrame:
    return types.filter(F.col("type").isin("activity", "structure_activity_relation")) \
        .select("image").distinct()


def first_available(candidates: DataFrame, offers: DataFrame, key: str,
                    priority: list[str]) -> DataFrame:
    """First source in priority order that yields a link; without one the item is queued.

    offers: ``key, source, url``.
    """
    rank = first_rule([(F.col("source") == s, i) for i, s in enumerate(priority)])
    best = (offers.filter("url is not null").withColumn("_rank", rank)
            .filter("_rank is not null").groupBy(key)
            .agg(F.min(F.struct("_rank", "source", "url")).alias("_b")))
    return (candidates.join(best, key, "left")
            .withColumn("source", F.coalesce("_b.source", F.lit("skip:not_oa")))
            .withColumn("url", F.col("_b.url")).withColumn("queued", F.col("_b").isNull())
            .drop("_b"))


