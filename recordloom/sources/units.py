"""Evidence units: reading, precedence, schema coercion, upsert and slice replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.base import nonblank
from recordloom.functions.normalize import safe_float, slug_to_id
from recordloom.operators.ordering import first_by


def read_units(spark: SparkSession, glob: str, schema: T.StructType, suffix: str,
               registry: DataFrame | None = None) -> DataFrame:
    """JSON lines to units with ``slug``, ``line_file`` and ``source_doi``.

    Source id: the unit's own field, else the registry (slug, doi), else the slug itself.
    """
    raw = spark.read.schema(schema).json(glob)
    df = (raw.withColumn("line_file", F.col("_metadata.file_path"))
          .withColumn("slug", F.regexp_extract(
              F.col("_metadata.file_name"), r"^(.*?)" + suffix.replace(".", r"\.") + "$", 1)))
    return name_source(df, registry)


def name_source(df: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    own = nonblank(F.col("source_review_doi"))
    if registry is None:
        return df.withColumn("source_doi", F.coalesce(own, slug_to_id(F.col("slug"))))
    reg = registry.select("slug", F.col("doi").alias("_reg"))
    return (df.join(reg, "slug", "left")
            .withColumn("source_doi", F.coalesce(own, F.col("_reg"), slug_to_id(F.col("slug"))))
            .drop("_reg"))


def union_by_precedence(preferred: DataFrame, fallback: DataFrame,
                        always: DataFrame | None = None, key: str = "slug") -> DataFrame:
    """Fallback rows only for keys the preferred set lacks; the third set is always added."""
    covered = preferred.select(key).distinct()
    out = preferred.unionByName(fallback.join(covered, key, "left_anti"),
                                allowMissingColumns=True)
    return out if always is None else out.unionByName(always, allowMissingColumns=True)


def replace_slice(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the slices that ``new`` touches are replaced; all other rows stay."""
    touched = new.select(*keys).distinct()
    return existing.join(touched, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_slice(new: DataFrame, path: str, keys: list[str]) -> None:
    """The same on files: only the partitions that ``new`` holds are overwritten."""
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def upsert_by_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last writer wins."""
    return first_by(df, [key], [F.col(c).desc() for c in order])


# fixed values: canonical field -> names it had (plain columns, then overflow keys)
VERSIONED_FIELDS = {
    "methanol_conv_pct": (["methanol_conv_pct", "methanol_conversion_pct"],
                          ["methanol_conversion_percent"]),
    "co2_conv_pct": (["co2_conv_pct"], []),
    "co_conv_pct": (["co_conv_pct"], []),
    "conversion_pct": (["conversion_pct"], []),
    "methanol_sel_pct": (["methanol_sel_pct"], ["methanol_selectivity_pct"]),
    "btx_sel_pct": (["btx_sel_pct", "btx_selectivity_pct"], []),
    "aromatic_sel_pct": (["aromatic_sel_pct"], ["aromatics_pct"]),
    "propylene_pct": (["propylene_pct"], ["propylene_selectivity_pct"]),
    "pressure_mpa": (["pressure_mpa", "pressure_MPa"], ["pressure_mpa", "pressure_MPa"]),
}


def _names(df: DataFrame, plain: list[str], extra: list[str], overflow: str) -> Column:
    have = set(df.columns)
    found = [F.col(c).cast("string") for c in plain if c in have]
    found += [F.try_element_at(F.col(overflow), F.lit(k)) for k in extra]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def coerce_unit_schema(df: DataFrame, fields=None, overflow: str = "extra_fields",
                       sane_temperature=(50.0, 850.0)) -> DataFrame:
    """Canonical numeric columns from versioned names and the overflow map. Zero is a value."""
    fields = fields or VERSIONED_FIELDS
    if overflow not in df.columns:
        df = df.withColumn(overflow, F.lit(None).cast("map<string,string>"))
    direct = safe_float(_names(df, ["temperature_c", "temperature_C"], [], overflow))
    kelvin = safe_float(_names(df, [], ["temperature_K", "temperature_k",
                                        "reaction_temperature_K", "reaction_temp_K"], overflow))
    t = F.coalesce(direct, F.when(kelvin > 200, F.round(kelvin - 273.15, 1)))
    hours = safe_float(_names(df, ["tos_h"], ["time_on_stream_h"], overflow))
    minutes = safe_float(_names(df, [], ["time_on_stream_min"], overflow))
    new = {name: safe_float(_names(df, plain, extra, overflow))
           for name, (plain, extra) in fields.items()}
    new["temperature_c"] = F.when(t.between(*sane_temperature), t)
    new["tos_h"] = F.coalesce(hours, F.round(minutes / 60, 3))
    # Spark resolves names without case, so the capital spellings are dropped first
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    return df.select(*keep, *[c.alias(n) for n, c in new.items()])


def reassign_metric(df: DataFrame, source: str, target: str, when: Column) -> DataFrame:
    """Move a value from one column to another where the rule holds."""
    move = when & F.col(source).isNotNull()
    return df.withColumns({
        target: F.when(move, F.col(source)).otherwise(F.col(target)),
        source: F.when(move, None).otherwise(F.col(source))})


def evolve_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """Add the columns of ``target`` that are missing, as NULL; extra columns stay."""
    missing = [f for f in target.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) \
        if missing else df
