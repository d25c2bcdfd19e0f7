"""Exports: what a paper's note shows, the note text, record and log sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.base import capped
from recordloom.functions.normalize import short_name
from recordloom.operators.ordering import first_by

# fixed values: evidence types of characterisation work
CHARACTERISATION_TYPES = ["DFT", "in_situ", "operando", "in-situ", "isotopic", "kinetic"]


def paper_performance(units: DataFrame, shown: list[str], metrics: list[str]) -> DataFrame:
    """Distinct rows with any metric."""
    return units.filter(F.coalesce(*[F.col(m) for m in metrics]).isNotNull()) \
        .select("source_doi", *shown).distinct()


def paper_claims(units: DataFrame, excluded=("unresolved_question",),
                 characterisation=tuple(CHARACTERISATION_TYPES)) -> DataFrame:
    """Claims without unresolved and characterisation ones; one per (type, normalised object)."""
    c = (units.filter(F.col("claim_type").isNotNull() & F.col("claim_object").isNotNull())
         .filter(~F.col("claim_type").isin(list(excluded)))
         .filter(F.col("evidence_type").isNull()
                 | ~F.col("evidence_type").isin(list(characterisation))))
    key = F.regexp_replace(F.lower(F.trim("claim_object")), r"(?U)\s+", " ")
    order = [F.col(x) for x in ("claim_object", "claim_subject", "claim_predicate")]
    return first_by(c.withColumn("_k", key), ["source_doi", "claim_type", "_k"], order).select(
        "source_doi", "claim_type", "claim_subject", "claim_predicate", "claim_object")


def paper_methods(units: DataFrame) -> DataFrame:
    """Preparation lines, one per (catalyst, normalised method)."""
    m = units.filter(F.length(F.coalesce("preparation_method", F.lit(""))) > 0)
    norm = F.regexp_replace(F.lower(F.trim("preparation_method")), r"(?U)[-\s]+", "-")
    cat = F.lower(F.trim(F.coalesce("catalyst_system", F.lit(""))))
    one = first_by(m.withColumn("_c", cat).withColumn("_m", norm), ["source_doi", "_c", "_m"],
                   [F.col("catalyst_system"), F.col("preparation_method")])
    named = ~F.lower(F.coalesce("catalyst_system", F.lit(""))).isin("", "unknown")
    return one.select("source_doi", F.when(named, F.concat(
        "catalyst_system", F.lit(": "), "preparation_method"))
        .otherwise(F.col("preparation_method")).alias("line"))


def paper_characterization(units: DataFrame, types=tuple(CHARACTERISATION_TYPES)) -> DataFrame:
    """Distinct technique lines of the allowed types with an object of at least 5 characters."""
    c = units.filter(F.col("evidence_type").isin(list(types))
                     & (F.length(F.coalesce("claim_object", F.lit(""))) >= 5))
    subject = F.when(F.length(F.coalesce("claim_subject", F.lit(""))) > 3,
                     F.concat("claim_subject", F.lit(" → "))).otherwise("")
    return c.select("source_doi", F.concat(F.lit("**"), "evidence_type", F.lit("**: "), subject,
                                           "claim_object").alias("line")).distinct()


def _fixed(c: str, decimals: int) -> Column:
    return F.coalesce(F.format_string(f"%.{decimals}f", F.col(c).cast("double")), F.lit(""))


def note_lines(papers: DataFrame, performance: DataFrame, claims: DataFrame, methods: DataFrame,
               characterization: DataFrame, cells: list[tuple[str, str, int | None]],
               abstracts: DataFrame | None = None, date: str = "") -> DataFrame:
    """Every paper's markdown note as lines: (doi, file, part, line).

    Lines sort by (file, part, line). A note is never held in one row, so a paper with very many
    results does not become one huge value. ``cells``: (title, column, decimals) of the table.
    """
    p = papers.select("doi", "title", "first_author", "year", "journal", "topic", "paper_type")
    if abstracts is not None:
        p = p.join(abstracts.select("doi", "abstract"), "doi", "left")
    else:
        p = p.withColumn("abstract", F.lit(None).cast("string"))
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d))
    title, author = F.coalesce("title", "doi"), text("first_author", "Unknown")
    tags = F.concat_ws(", ", F.lit('"literature"'),
                       F.when(F.length("topic") > 0, F.concat(F.lit('"'), "topic", F.lit('"'))),
                       F.when(F.length("paper_type") > 0,
                              F.concat(F.lit('"'), "paper_type", F.lit('"'))))
    head = F.concat_ws(
        "\n", F.lit("---"),
        F.concat(F.lit('title: "'), F.replace(title, F.lit('"'), F.lit("'")), F.lit('"')),
        F.concat(F.lit('authors: "'), author, F.lit(' et al."')),
        F.concat(F.lit("year: "), text("year")),
        F.concat(F.lit('journal: "'), text("journal"), F.lit('"')),
        F.concat(F.lit('doi: "'), "doi", F.lit('"')), F.concat(F.lit("topic: "), text("topic")),
        F.concat(F.lit("paper_type: "), text("paper_type")),
        F.concat(F.lit("tags: ["), tags, F.lit("]")), F.lit(f"date_added: {date}"), F.lit("---"),
        F.lit(""), F.concat(F.lit("# "), title), F.lit(""),
        F.concat(F.lit("**Authors**: "), author, F.lit(" et al. | **Year**: "), text("year"),
                 F.lit(" | **Journal**: "), text("journal")),
        F.concat(F.lit("**DOI**: ["), "doi", F.lit("](https://doi.org/"), "doi", F.lit(")")),
        F.lit(""), F.lit("## Abstract"), F.lit(""),
        F.when(F.length("abstract") > 0, F.col("abstract"))
        .otherwise(F.lit("_Abstract not available._")), F.lit(""), F.lit("## Method"), F.lit(""))
    titles = "| " + " | ".join(t for t, _, _ in cells) + " |\n|" + "---|" * len(cells)

    def section(df, part, line, empty, keep=None):
        """Fixed text for papers that have no row, the rows themselves otherwise."""
        rows = df.select(F.col("source_doi").alias("doi"), F.lit(part).alias("part"),
                         line.alias("line"))
        if keep is not None:
            rows = rows.join(p.filter(keep).select("doi"), "doi", "left_semi")
        else:
            rows = rows.join(p.select("doi"), "doi", "left_semi")
        if empty is None:
            return rows
        bare = p.join(df.select(F.col("source_doi").alias("doi")).distinct(), "doi", "left_anti")
        return rows.unionByName(bare.select("doi", F.lit(part).alias("part"),
                                            F.lit(empty).alias("line")))

    def fixed(part, line, only=None):
        src = p if only is None else p.join(
            only.select(F.col("source_doi").alias("doi")).distinct(), "doi", "left_semi")
        return src.select("doi", F.lit(part).alias("part"), F.lit(line).alias("line"))

    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[
        text(c) if d is None else _fixed(c, d) for _, c, d in cells]), F.lit(" |"))
    bullet = F.concat(F.lit("- "), "line")
    sentence = F.trim(F.concat_ws(" ", *[F.when(F.length(c) > 0, F.col(c)) for c in (
        "claim_subject", "claim_predicate", "claim_object")]))
    review = F.col("paper_type") == "review"
    claim_rows = claims.select("source_doi", "claim_type", sentence.alias("s"))
    parts = [
        p.select("doi", F.lit(0).alias("part"), head.alias("line")),
        section(methods, 1, bullet, "_No preparation details extracted._"),
        fixed(2, "\n## Catalytic Results\n"), fixed(3, titles, performance),
        section(performance, 4, row, "_No quantitative performance data extracted._"),
        fixed(5, "\n## Characterization\n"),
        section(characterization, 6, bullet, "_No characterization findings extracted._"),
        section(claims.select("source_doi").distinct(), 7, F.lit("\n## Claims\n"), None, review),
        section(claim_rows, 8, F.concat(F.lit("**"), "claim_type", F.lit("** - "), "s"), None,
                review),
        fixed(9, "\n## Notes\n"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    names = p.select("doi", short_name(F.col("first_author"), F.col("year"), F.col("journal"),
                                       F.col("doi")).alias("file"))
    return out.join(names, "doi")


def write_notes(lines: DataFrame, path: str) -> None:
    """One folder per note; its part files, read in name order, give the note."""
    (lines.repartitionByRange("file", "part", "line").sortWithinPartitions("file", "part", "line")
     .select("file", F.col("line").alias("value")).write.mode("overwrite")
     .partitionBy("file").text(path))


def write_records(df: DataFrame, folder: str, name: str, stamp: str) -> str:
    """Dated JSON lines; returns the path."""
    path = f"{folder}/{name}_{stamp}.jsonl"
    df.write.mode("overwrite").json(path)
    return path


def write_feature_matrix(wide: DataFrame, path: str, keys: list[str], features: list[str]) -> None:
    """CSV with keys first and the features in the given order."""
    wide.select(*keys, *[f for f in features if f in wide.columns]).write.mode(
        "overwrite").option("header", True).csv(path)


def provenance_log(results: DataFrame, title_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Outcome log of all items, and the queue of those without an open copy."""
    log = results.select("doi", capped(F.col("title"), title_chars).alias("title"), "success", "source",
                         "error")
    return log, results.filter(~F.col("success") & (F.col("source") == "skip:not_oa"))


def strip_claims(df: DataFrame, columns=("claim_type", "claim_subject", "claim_predicate",
                                         "claim_object")) -> DataFrame:
    return df.drop(*columns)
