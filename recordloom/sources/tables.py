"""Row construction from raw and parsed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.normalize import id_to_slug
from recordloom.operators.ordering import ordered_position


def explode_tables(tables: DataFrame) -> DataFrame:
    """One row per row of a vision table.

    Input: ``slug, source_doi, line_no, table_number, caption, columns, rows, source_page, model``.
    The id uses the line number, as table numbers may be missing or repeated.
    """
    return (tables.select("*", F.posexplode("rows").alias("_j", "cells"))
            .select(F.format_string("%s::vision::t%03d::r%03d", "slug", "line_no",
                                    F.col("_j") + 1).alias("row_id"),
                    "source_doi", F.lit(None).cast("string").alias("primary_doi"),
                    F.coalesce(F.col("table_number").cast("string"), F.lit(""))
                    .alias("table_number"),
                    F.coalesce("caption", F.lit("")).alias("caption"),
                    F.to_json("columns").alias("columns_json"),
                    F.to_json("cells").alias("row_json"),
                    F.col("source_page").cast("int").alias("source_page"), "model"))


def number_supplements(tables: DataFrame) -> DataFrame:
    """Table numbers and captions; supplements of one document get S, S2-, S3- by file order.

    Input: ``doc, file, is_supplement, table_idx, caption``.
    """
    files = tables.filter("is_supplement").select("doc", "file").distinct()
    files = ordered_position(files, ["doc"], ["file"]).withColumn("_k", F.col("pos") + 1).drop(
        "pos")
    j = tables.join(files, ["doc", "file"], "left")
    prefix = F.when(F.col("_k") == 1, "S").otherwise(
        F.concat(F.lit("S"), F.col("_k").cast("string"), F.lit("-")))
    caption = F.coalesce(F.when(F.length("caption") > 0, F.col("caption")),
                         F.concat(F.lit("Table "), F.col("table_idx").cast("string")))
    return (j.withColumn("table_number", F.when(
                F.col("is_supplement"), F.concat(prefix, F.col("table_idx").cast("string")))
                .otherwise(F.col("table_idx").cast("string")))
            .withColumn("caption", F.when(F.col("is_supplement"),
                                          F.concat(F.lit("[SI] "), caption)).otherwise(caption))
            .drop("_k"))


def explode_parsed_tables(tables: DataFrame, papers: DataFrame,
                          tool: str = "docling") -> DataFrame:
    """Parsed tables to table rows; a primary paper is its own source.

    Input: ``doc, table_number, caption, headers, rows, page``; papers: ``doi, paper_type``.
    """
    typed = tables.join(papers.select(F.col("doi").alias("doc"), "paper_type"), "doc", "left")
    return (typed.select("*", F.posexplode("rows").alias("_j", "cells"))
            .select(F.format_string(f"%s::{tool}::tbl%s::r%03d", id_to_slug(F.col("doc")),
                                    "table_number", F.col("_j") + 1).alias("row_id"),
                    F.col("doc").alias("source_doi"),
                    F.when(F.coalesce("paper_type", F.lit("")) != "review", F.col("doc"))
                    .alias("primary_doi"),
                    "table_number", "caption", F.to_json("headers").alias("columns_json"),
                    F.to_json("cells").alias("row_json"), "page"))


def docs_without_tables(papers: DataFrame, rows: DataFrame) -> DataFrame:
    return papers.join(rows.select(F.col("source_doi").alias("doi")).distinct(), "doi",
                       "left_anti")


def diagnose_docs(docs: DataFrame) -> DataFrame:
    """Per document: number of tables, text length, lines with three or more pipes, error flag.

    Input: ``doc, tables array, md, error``.
    """
    pipes = F.filter(F.split("md", "\n"), lambda ln: F.length(ln) - F.length(
        F.replace(ln, F.lit("|"), F.lit(""))) >= 3)
    return docs.select("doc", F.size("tables").alias("n_tables"), F.length("md").alias("md_len"),
                       F.size(pipes).alias("pipe_rows"),
                       F.col("error").isNotNull().alias("failed"))
