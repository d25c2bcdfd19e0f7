"""Inventories of input files: newest snapshot, main and supplement files, stale caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.base import first_rule
from recordloom.operators.ordering import first_by

# fixed values: marks of supplement files
SUPPLEMENT_MARKS = ["si", "supporting", "supp", "supplementary", "supplement", "esi"]


def file_listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length of files; the contents are pruned away and not read."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower()).load(path)
            .select("path", "modificationTime", "length"))


def latest_snapshot(files: DataFrame, path: str = "path",
                    pattern: str = r"(\d{4}-\d{2}-\d{2})[^/]*$") -> DataFrame:
    """Files of the newest date stamp in the name."""
    dated = files.withColumn("snapshot", F.regexp_extract(path, pattern, 1)).filter(
        "snapshot <> ''")
    newest = dated.agg(F.max("snapshot").alias("snapshot"))
    return dated.join(newest, "snapshot", "left_semi")


def read_latest(spark: SparkSession, glob_dir: str, schema) -> DataFrame:
    """Records of the newest dated JSON lines file set below a folder."""
    raw = spark.read.schema(schema).json(glob_dir)
    stamped = raw.withColumn("snapshot", F.regexp_extract(
        F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1))
    newest = stamped.agg(F.max("snapshot").alias("snapshot"))
    return stamped.join(newest, "snapshot", "left_semi").drop("snapshot")


def is_marked(rest: Column) -> Column:
    """Does one of the marks stand as a word of its own in what follows the slug? `_version` has none."""
    return F.lower(rest).rlike(rf"(?:^|[^a-z])(?:{'|'.join(SUPPLEMENT_MARKS)})(?:[^a-z]|$)")


def is_supplement(rest: Column, folder: Column) -> Column:
    """A supplement by what follows the slug in its name: `_SI` alone, or anything inside an `SI` folder.

    Outside such a folder a file with another mark is neither a supplement nor a main file.
    """
    return (rest == "_SI") | (folder == "SI")


def list_inputs(files: DataFrame, roots: list[str], path: str = "path",
                slugs: DataFrame | None = None) -> DataFrame:
    """Main file per document and all supplements, with slug and kind.

    `slugs` has the known slugs of the documents (column ``slug``); a name belongs to the longest one
    it begins with. Without it the slug is the name up to its first supplement mark. The main file is
    the one named by the slug alone, in the first root that has it, else another unmarked one. Files
    with another mark than `_SI` outside an `SI` folder are left out.
    """
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    rank = first_rule([(F.concat(F.lit("/"), F.col(path)).contains(f"/{r.strip('/')}/"), i)
                       for i, r in enumerate(roots)], len(roots))
    named = files.withColumns({"name": name, "_stem": stem, "root_rank": rank})
    if slugs is None:
        named = named.withColumn("slug", F.regexp_replace("_stem", r"(?i)[_-](si|supp\w*|esi)\b.*$", ""))
    else:
        # a slug is looked for among the beginnings of a stem, by an equi join
        starts = named.select("_stem").distinct().select("_stem", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("_stem")), lambda n: F.left(F.col("_stem"), n))).alias("slug"))
        known = starts.join(slugs.select("slug").distinct(), "slug").groupBy("_stem").agg(F.max_by("slug", F.length("slug")).alias("slug"))
        named = named.join(known, "_stem")
    rest = F.col("_stem").substr(F.length("slug") + 1, F.length("_stem"))
    tagged = named.withColumn("supplement", is_supplement(rest, folder)).withColumn("_other", F.length(rest) > 0).withColumn("_marked", is_marked(rest)).drop("_stem")
    main = first_by(tagged.filter(~F.col("supplement") & ~F.col("_marked")), ["slug"], [F.col("_other"), F.col("root_rank"), F.col(path)])
    return main.unionByName(tagged.filter("supplement")).drop("_other", "_marked")


def stale_inputs(files: DataFrame, meta: DataFrame, parser_version: str, scale: float,
                 artefacts: DataFrame | None = None) -> DataFrame:
    """Inputs whose cache entry is missing or differs in any part.

    files: ``stem, name, mtime, size``; meta: ``stem, pdf_name, pdf_mtime, pdf_size, version,
    scale, needs_artefact``; artefacts: ``stem``.
    """
    j = files.join(meta, "stem", "left")
    if artefacts is None:
        j = j.withColumn("_art", F.lit(True))
    else:
        j = j.join(artefacts.select("stem").distinct().withColumn("_art", F.lit(True)), "stem",
                   "left")
    fresh = (F.col("pdf_name").eqNullSafe(F.col("name"))
             & F.col("pdf_mtime").eqNullSafe(F.col("mtime"))
             & F.col("pdf_size").eqNullSafe(F.col("size"))
             & F.col("version").eqNullSafe(F.lit(parser_version))
             & F.col("scale").eqNullSafe(F.lit(scale))
             & (~F.coalesce("needs_artefact", F.lit(False)) | F.coalesce("_art", F.lit(False))))
    return j.filter(~fresh).select(files.columns)
