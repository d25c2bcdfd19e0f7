"""Discovery over a citation graph: flatten, expand, merge, cap, rank, screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import vocabulary as V
from recordloom.functions.base import any_contains, capped, first_rule, nonblank
from recordloom.functions.normalize import decode_inverted, sanitize_doi, strip_tags
from recordloom.operators.linkage import lookup_tier
from recordloom.operators.ordering import first_by, top_per_key
from recordloom.session import cut


def _first(c: str, count: int | None) -> Column:
    return F.col(c) if count is None else F.slice(c, 1, count)


def flatten_openalex(works: DataFrame, tag: str, max_authors: int | None = None) -> DataFrame:
    """Works of the first API shape to candidates; rows without an id are dropped."""
    w = works.select(
        sanitize_doi(F.replace(F.coalesce("doi", F.lit("")), F.lit("https://doi.org/"), F.lit("")))
        .alias("doi"),
        F.coalesce("title", F.lit("")).alias("title"), F.col("publication_year").alias("year"),
        F.col("primary_location.source.display_name").alias("venue"),
        F.transform(_first("authorships", max_authors), lambda a: F.coalesce(
            a["author"]["display_name"], F.lit(""))).alias("authors"),
        decode_inverted(F.col("abstract_inverted_index")).alias("abstract"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"),
        F.lit(0).alias("influential_citation_count"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open_access"),
        F.col("open_access.oa_url").alias("oa_url"), F.array(F.lit(tag)).alias("source"))
    return w.filter(F.length("doi") > 0)


def flatten_s2(papers: DataFrame, tag: str, max_authors: int | None = None) -> DataFrame:
    """Papers of the second API shape to candidates."""
    p = papers.select(
        sanitize_doi(F.col("externalIds.DOI")).alias("doi"),
        F.coalesce("title", F.lit("")).alias("title"), "year",
        nonblank(F.col("journal.name")).alias("venue"),
        F.transform(_first("authors", max_authors), lambda a: F.coalesce(a["name"], F.lit("")))
        .alias("authors"), "abstract",
        F.coalesce("citationCount", F.lit(0)).alias("citation_count"),
        F.coalesce("influentialCitationCount", F.lit(0)).alias("influential_citation_count"),
        F.coalesce("isOpenAccess", F.lit(False)).alias("is_open_access"),
        F.col("openAccessPdf.url").alias("oa_url"), F.array(F.lit(tag)).alias("source"))
    return p.filter(F.length("doi") > 0)


def expand_seeds(seeds: DataFrame, edges: DataFrame, per_seed: int = 30,
                 kinds=("references", "citations"), hops: int = 1,
                 rank: str = "dst") -> DataFrame:
    """Neighbours of the seeds: (seed, dst, kind, hop), the first ``per_seed`` per seed and kind.

    seeds: ``id``; edges: ``src, dst, kind``. The limit is applied before the shuffle; between
    hops the lineage is cut with a checkpoint.
    """
    e = edges.filter(F.col("kind").isin(*kinds))
    frontier, out = seeds.select("id").distinct(), None
    for hop in range(1, hops + 1):
        step = e.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi")
        step = top_per_key(step, ["src", "kind"], [F.col(rank), F.col("dst")], per_seed).select(
            F.col("src").alias("seed"), "dst", "kind", F.lit(hop).alias("hop"))
        if hops > 1:
            step = cut(step)
        out = step if out is None else out.unionByName(step)
        if hop < hops:
            frontier = step.select(F.col("dst").alias("id")).distinct()
    return out


def recommendations(seeds: DataFrame, edges: DataFrame, first_seeds: int = 5,
                    limit: int = 50) -> DataFrame:
    """Recommended papers of the first seeds (reference feature: 5 seeds, 50 papers)."""
    few = seeds.select("id").orderBy("id").limit(first_seeds)
    e = edges.filter("kind = 'recommendation'").join(few.withColumnRenamed("id", "src"), "src",
                                                     "left_semi")
    return e.select("dst").distinct().orderBy("dst").limit(limit)


def merge_candidates(df: DataFrame, order: list[str]) -> DataFrame:
    """One candidate per id: tags united in order, first text that is there, largest counts.

    All parts combine before the shuffle; of the tags one row per (id, tag) is left by then, so an
    id that is seen very often costs no more than any other.
    """
    o = F.struct(*order)

    def first_text(c):
        return F.min_by(nonblank(F.col(c)), F.when(F.length(c) > 0, o)).alias(c)

    seen = df.filter(F.length("doi") > 0)
    merged = seen.groupBy("doi").agg(
        first_text("title"), first_text("venue"), first_text("abstract"), first_text("oa_url"),
        F.min_by("year", F.when(F.col("year").isNotNull(), o)).alias("year"),
        F.min_by("authors", F.when(F.size("authors") > 0, o)).alias("authors"),
        F.max("citation_count").alias("citation_count"),
        F.max("influential_citation_count").alias("influential_citation_count"),
        F.bool_or("is_open_access").alias("is_open_access"))
    tags = (seen.select("doi", o.alias("_o"), F.posexplode("source").alias("_p", "_t"))
            .groupBy("doi", "_t").agg(F.min(F.struct("_o", "_p")).alias("_o"))
            .groupBy("doi").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))),
                                            lambda s: s["_t"]).alias("source")))
    return merged.join(tags, "doi", "left")


def ordered_tags(df: DataFrame, key: str, tag: str, order: list[str]) -> DataFrame:
    """Distinct tags per key in order of first sight. The first sight of each tag is found before
    the tags of a key meet, so a key seen very often sends one row per tag."""
    first = df.groupBy(key, tag).agg(F.min(F.struct(*order)).alias("_o"))
    return first.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_o", tag))), lambda s: s[tag]), "|").alias("tags"))


def enrich_candidates(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Fill gaps from a second record per id; nothing that is there is overwritten."""
    texts = ["title", "venue", "abstract", "oa_url"]
    e = extra.select("doi", *[F.col(c).alias(f"_{c}") for c in extra.columns if c != "doi"])
    j = df.join(e, "doi", "left")
    return j.select(
        "doi", *[F.coalesce(nonblank(F.col(c)), nonblank(F.col(f"_{c}"))).alias(c) for c in texts],
        F.coalesce("year", "_year").alias("year"),
        F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.col("_authors"))
        .alias("authors"),
        F.greatest("citation_count", F.coalesce("_citation_count", F.lit(0)))
        .alias("citation_count"), "influential_citation_count",
        (F.col("is_open_access") | F.coalesce("_is_open_access", F.lit(False)))
        .alias("is_open_access"),
        F.array_distinct(F.concat("source", F.coalesce("_source", F.array().cast(
            "array<string>")))).alias("source"))


def novel_only(df: DataFrame, known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Candidates with an id that is neither known nor repeated."""
    norm = F.lower(F.trim(key))
    k = known.select(F.lower(F.trim("doi")).alias("_k")).distinct()
    d = df.withColumn("_k", norm).filter(F.length("_k") > 0).join(k, "_k", "left_anti")
    return first_by(d, ["_k"], [F.col(o) for o in order]).drop("_k")


def cap_by(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n most cited (a top-k feature)."""
    return df.orderBy(F.desc(by), tie).limit(n)


def fallback_score(influential: Column, citations: Column, year: Column,
                   as_of_year: int) -> Column:
    age = F.greatest(F.lit(1), F.lit(as_of_year) - F.coalesce(year, F.lit(as_of_year - 30)) + 1)
    return (F.coalesce(influential, F.lit(0)) * 2 + F.coalesce(citations, F.lit(0)) * 0.1
            + F.lit(100.0) / age)


def rank_candidates(df: DataFrame, as_of_year: int | None = None, tie: str = "doi") -> DataFrame:
    """By relevance, unscored last; with ``as_of_year`` by citations and recency instead."""
    if as_of_year is None:
        return df.orderBy(F.desc_nulls_last("relevance"), tie)
    s = fallback_score(F.col("influential_citation_count"), F.col("citation_count"),
                       F.col("year"), as_of_year)
    return df.withColumn("fallback_score", s).orderBy(F.desc("fallback_score"), tie)


def shortlist(df: DataFrame, min_relevance: float, abstract_chars: int | None = None) -> DataFrame:
    """Unscored or good enough candidates with their text block."""
    kept = df.filter(F.col("relevance").isNull() | (F.col("relevance") >= min_relevance))
    open_access = F.coalesce("is_open_access", F.lit(False)) | (F.length(F.coalesce(
        "oa_url", F.lit(""))) > 0)
    rel = F.coalesce(F.format_string("%.2f", "relevance"), F.lit("—"))
    meta = F.concat_ws(" · ", nonblank(F.col("venue")), F.col("year").cast("string"),
                       F.when(F.col("citation_count") > 0, F.concat(
                           F.col("citation_count").cast("string"), F.lit(" cit"))))
    title = F.coalesce(nonblank(strip_tags(F.col("title"))), F.lit("(untitled)"))
    clean = strip_tags(F.col("abstract"))
    head = F.concat(F.lit("## ["), F.when(F.col("relevance").isNull(), "—").otherwise(rel),
                    F.lit("] "), title, F.when(open_access, " 🔓").otherwise(""))
    ids = F.concat(F.lit("`"), "doi", F.lit("` · https://doi.org/"), "doi",
                   F.when(F.length(meta) > 0, F.concat(F.lit("  ·  "), meta)).otherwise(""))
    reason = F.when(F.length(F.coalesce("relevance_reason", F.lit(""))) > 0,
                    F.concat(F.lit("> "), "relevance_reason"))
    abstract = F.when(F.length(F.coalesce("abstract", F.lit(""))) > 0, F.concat(
        F.lit("\n"), capped(clean, abstract_chars),
        F.lit("") if abstract_chars is None else
        F.when(F.length("abstract") > abstract_chars, "…").otherwise("")))
    return kept.withColumn("block", F.concat_ws("\n", head, ids, reason, abstract))


def shortlist_header(listed: DataFrame, query: str, min_relevance: float) -> DataFrame:
    return listed.agg(F.count(F.lit(1)).alias("n")).select(F.format_string(
        f"# Discovery shortlist — {query}\n\n*%d papers (relevance ≥ {min_relevance:.2f}), "
        "sorted by relevance.*", "n").alias("header"))


def screen_search(works: DataFrame, min_year: int, min_citations: int,
                  min_tier: str = "B") -> DataFrame:
    """Filter works by year, citations and venue tier; most cited first.

    works: ``doi, title, year, citations, journal``.
    """
    order = F.create_map(*[F.lit(x) for kv in V.TIER_ORDER.items() for x in kv])
    w = (works.filter((F.col("year") >= min_year) & (F.col("citations") >= min_citations))
         .withColumn("_t", lookup_tier(F.col("journal"))))
    return (w.withColumn("if_tier", F.col("_t.tier")).withColumn("if_approx", F.col("_t.impact"))
            .filter(F.try_element_at(order, F.col("if_tier")) <= V.TIER_ORDER[min_tier])
            .drop("_t").orderBy(F.desc("citations"), "doi"))


# fixed values: screening rules
SCREENING_RULES = {
    "must_include": ["CO2 hydrogenation"],
    "any_of": ["higher alcohols", "C2+ alcohols", "mixed alcohols", "ethanol", "propanol",
               "butanol"],
    "types": ["article", "review", "perspective", "communication", "mechanistic_study"],
    "exclude": ["pure CO2 electroreduction"],
    "min_impact": 5, "min_citations": 50, "max_partition": 2, "recent_years": 3,
    "caps": {"topic": 40, "journal": 20, "citation": 20, "mechanism": 15, "recency": 5},
    "bands": [("priority_read", 80), ("core_include", 65), ("supplement_include", 50)],
}


def screen_rules(df: DataFrame, as_of_year: int, rules: dict = SCREENING_RULES) -> DataFrame:
    """Include/exclude rules, capped score parts and bands.

    df: ``text, doc_type, impact, citations, year`` and the raw parts ``topic, journal, citation,
    mechanism`` (points before the cap).
    """
    low = F.lower("text")
    must = F.lit(True)
    for w in rules["must_include"]:
        must = must & low.contains(w.lower())
    fits = (must & any_contains(low, [w.lower() for w in rules["any_of"]])
            & F.col("doc_type").isin(rules["types"])
            & ~any_contains(low, [w.lower() for w in rules["exclude"]]))
    recent = F.col("year") > as_of_year - rules["recent_years"]
    core = ((F.col("impact") >= rules["min_impact"])
            | (F.col("citations") >= rules["min_citations"]) | recent)
    caps = rules["caps"]
    parts = [F.least(F.greatest(F.col(p), F.lit(0)), F.lit(caps[p]))
             for p in ("topic", "journal", "citation", "mechanism")]
    total = sum(parts, F.when(recent, caps["recency"]).otherwise(0))
    band = first_rule([(F.col("score") >= s, n) for n, s in rules["bands"]], "exclude")
    return (df.filter(fits).withColumn("core", core).withColumn("score", total)
            .withColumn("band", band))


def collect_resolved_ids(df: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Distinct resolved ids in order of first sight."""
    first = (df.withColumn("doi", F.trim("doi")).filter(F.length("doi") > 0).groupBy("doi")
             .agg(F.min(F.struct(*order)).alias("_o")))
    return (first.select("doi", *[F.col(f"_o.{o}").alias(o) for o in order]) if limit is None
            else first.orderBy("_o", "doi").limit(limit)
            .select("doi", *[F.col(f"_o.{o}").alias(o) for o in order]))


def triage_summary(df: DataFrame) -> DataFrame:
    """Items per priority. No abstract: low; a failed label: the fallback label, low.

    df: ``doi, abstract, label, priority, failed``.
    """
    blank = F.length(F.coalesce("abstract", F.lit(""))) == 0
    d = df.select(
        "doi",
        F.when(blank, "review/perspective").when(F.col("failed"), "unrelated")
        .otherwise(F.col("label")).alias("label"),
        F.when(blank | F.col("failed"), "low").otherwise(F.coalesce("priority", F.lit("low")))
        .alias("priority"))
    return d.groupBy("priority", "label").agg(F.count(F.lit(1)).alias("n"),
                                              F.min("doi").alias("first_doi"))
