"""Record assembly: melted cells to one record per document and sample, with reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import vocabulary as V
from recordloom.functions.base import any_contains
from recordloom.functions.normalize import fuzzy_key, normalize_unit
from recordloom.operators.ordering import top_per_key


def _order() -> Column:
    return F.struct("table_ord", "row_ord", "col")


def record_attributes(cells: DataFrame) -> DataFrame:
    """First non-empty value per (document, sample, attribute), in canonical units.

    Partial aggregation sends one row per key and task, so a sample with very many cells is
    reduced before the shuffle. Rows with ``attr`` NULL keep samples without attributes.
    """
    keyed = cells.withColumn("rec_key", fuzzy_key(F.col("label"))).withColumn("ord", _order())
    rank = F.struct(F.length("label").alias("len"), (-F.col("table_ord")).alias("a"),
                    (-F.col("row_ord")).alias("b"), (-F.col("col")).alias("c"))
    won = keyed.groupBy("doc", "rec_key", "attr").agg(
        F.min_by(F.struct("num", "raw", "unit"), "ord").alias("w"),
        F.min("ord").alias("ord"),
        F.max(F.struct(rank.alias("rank"), F.col("label"))).alias("best_label"),
        F.collect_set("label").alias("labels"),
        F.collect_set("table_type").alias("types"),
        F.max(F.when(F.col("reference").isNotNull(), F.struct("ord", "reference")))
        .alias("last_ref"),
        F.min(F.struct("ord", "primary_doi")).alias("first_primary"))
    norm = normalize_unit(F.col("attr"), F.col("w.num"), F.col("w.unit"))
    return (won.withColumn("n", norm)
            .select("doc", "rec_key", "attr", "ord",
                    F.col("n.value").alias("value_num"),
                    F.when(F.col("w.num").isNull(), F.col("w.raw")).alias("value_str"),
                    F.when(F.col("w.num").isNull(), F.col("w.unit"))
                    .otherwise(F.col("n.unit")).alias("unit"),
                    F.when(F.col("n.value") != F.col("w.num"), F.col("w.num"))
                    .alias("raw_value"),
                    "best_label", "labels", "types", "last_ref", "first_primary"))


def assemble_records(attributes: DataFrame) -> DataFrame:
    """One record per (document, sample): label, variants, table types, reference, attribute map."""
    entry = F.struct(F.col("attr").alias("key"), F.struct(
        "value_num", "value_str", "unit", "raw_value").alias("value"))
    rec = attributes.groupBy("doc", "rec_key").agg(
        F.max("best_label")["label"].alias("label"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels"))))
        .alias("label_variants"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("table_types"),
        F.max("last_ref")["reference"].alias("source_reference"),
        F.min("first_primary")["primary_doi"].alias("primary_doi"),
        F.collect_list(F.when(F.col("attr").isNotNull(), entry)).alias("_e"))
    return (rec.withColumn("attributes", F.map_from_entries(F.array_sort("_e")))
            .withColumn("merged_variants", F.size("label_variants"))
            .withColumn("n_attributes", F.size("attributes")).drop("_e"))


def records_to_wide(attributes: DataFrame, features: list[str],
                    aliases: dict[str, str] | None = None) -> DataFrame:
    """Numeric attributes as columns, aliases folded in, first one wins; one row per record."""
    aliases = V.ATTRIBUTE_ALIASES if aliases is None else aliases
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    name = F.col("attr") if table is None else F.coalesce(
        F.try_element_at(table, F.col("attr")), F.col("attr"))
    there = attributes.withColumn("_feature", F.when(F.col("value_num").isNotNull(), name))
    # label and features in one aggregate: the records behind it are read once
    return there.groupBy("doc", "rec_key").agg(
        F.max("best_label")["label"].alias("label"),
        *[F.min_by(F.when(F.col("_feature") == f, F.col("value_num")),
                   F.when(F.col("_feature") == f, F.col("ord"))).alias(f) for f in features])


def build_stats(profile: DataFrame, cells: DataFrame, attributes: DataFrame,
                records: DataFrame) -> DataFrame:
    """(metric, value) rows about one build."""
    def stack(df: DataFrame, **metrics: Column) -> DataFrame:
        one = df.agg(*[m.cast("long").alias(k) for k, m in metrics.items()])
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("metric"), F.coalesce(F.col(k), F.lit(0)).alias("value"))
            for k in metrics])))

    ok = ~F.col("headerless")
    parts = [
        stack(profile, tables=F.count(F.lit(1)), papers=F.count_distinct("doc"),
              headerless_skipped=F.count_if("headerless"),
              no_key_column=F.count_if(ok & F.col("key_col").isNull()),
              transposed=F.count_if(ok & F.col("key_col").isNotNull() & F.col("transposed"))),
        stack(cells, mapped_cells=F.count_if(F.col("attr").isNotNull() & F.col("mapped")),
              verbatim_cells=F.count_if(F.col("attr").isNotNull() & ~F.col("mapped"))),
        stack(attributes, unit_normalized=F.count("raw_value")),
        stack(records, records=F.count(F.lit(1)),
              records_merged=F.count_if(F.col("merged_variants") > 1)),
        profile.filter(ok).groupBy(F.concat(F.lit("type:"), "table_type").alias("metric"))
        .agg(F.count(F.lit(1)).alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def has_family(attributes: Column, words: list[str]) -> Column:
    return F.exists(F.map_keys(attributes), lambda a: any_contains(a, words))


def coverage_summary(records: DataFrame) -> DataFrame:
    """One row: records, average attributes, how many have performance, property, both, reference."""
    perf = has_family(F.col("attributes"), V.PERFORMANCE_FAMILY)
    prop = has_family(F.col("attributes"), V.PROPERTY_FAMILY)
    r = records.select("doc", "n_attributes", "source_reference", perf.alias("perf"),
                       prop.alias("prop"))
    return r.agg(
        F.count(F.lit(1)).alias("records"), F.avg("n_attributes").alias("avg_attributes"),
        F.count_if("perf").alias("with_performance"), F.count_if("prop").alias("with_property"),
        F.count_if(F.col("perf") & F.col("prop")).alias("with_both"),
        F.count("source_reference").alias("with_reference"),
        (F.count(F.lit(1)) / F.count_distinct("doc")).alias("records_per_doc"))


def attribute_frequency(records: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent attributes (a report), ties by name."""
    return (records.select(F.explode(F.map_keys("attributes")).alias("attr"))
            .groupBy("attr").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "attr").limit(k))


def densest_records(records: DataFrame, k: int = 5) -> DataFrame:
    return (records.select("doc", "label", "n_attributes")
            .orderBy(F.desc("n_attributes"), "doc", "label").limit(k))


def corpus_stats(units: DataFrame, papers: DataFrame, fields: list[str]) -> DataFrame:
    """(section, name, n) rows: table sizes, units per topic, non-NULL count per field."""
    sizes = (units.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rows").alias("section"), F.lit("units").alias("name"), "n")
        .unionByName(papers.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("rows").alias("section"), F.lit("papers").alias("name"), "n")))
    topics = (units.groupBy("source_doi").agg(F.count(F.lit(1)).alias("n"))
              .join(papers.select(F.col("doi").alias("source_doi"), "topic"), "source_doi")
              .groupBy(F.coalesce("topic", F.lit("unknown")).alias("name"))
              .agg(F.sum("n").alias("n"))
              .select(F.lit("topic").alias("section"), "name", "n"))
    filled = units.agg(*[F.count(c).alias(c) for c in fields]).select(F.inline(F.array(*[
        F.struct(F.lit("filled").alias("section"), F.lit(c).alias("name"), F.col(c).alias("n"))
        for c in fields])))
    return sizes.unionByName(topics).unionByName(filled)


def overflow_keys(units: DataFrame, extra: str, order: list[str], min_count: int = 1,
                  promote_share: float = 0.10, examples: int = 3) -> DataFrame:
    """Keys of an overflow JSON object: count, share of all units, first examples, promote flag."""
    pairs = units.select(*order, F.explode(F.from_json(extra, "map<string,string>"))
                         .alias("key", "value"))
    counts = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_count)
    first = top_per_key(pairs, ["key"], [F.col(c) for c in order], examples)
    shown = first.groupBy("key").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), "|")
        .alias("examples"))
    total = units.count()
    return counts.join(shown, "key").select(
        "key", "n", (F.col("n") / F.lit(total)).alias("share"), "examples",
        (F.col("n") >= max(min_count, int(total * promote_share))).alias("promote"))


def assign_tier(paper_type: Column, primary_doi: Column) -> Column:
    """gold: primary source; silver: review resolved to a primary source; bronze: the rest."""
    return (F.when(paper_type == "primary", "gold")
            .when(F.length(F.coalesce(primary_doi, F.lit(""))) > 0, "silver")
            .otherwise("bronze"))
