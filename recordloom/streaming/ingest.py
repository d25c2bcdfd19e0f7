"""Structured Streaming forms of table ingest and candidate de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.ordering import first_by
from recordloom.sources.tables import explode_parsed_tables

PARSED_TABLES = (T.StructType().add("doc", "string").add("table_number", "string")
                 .add("caption", "string").add("headers", T.ArrayType(T.StringType()))
                 .add("rows", T.ArrayType(T.ArrayType(T.StringType()))).add("page", "integer"))


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str,
                  papers: DataFrame, tool: str = "docling",
                  files_per_trigger: int | None = None) -> StreamingQuery:
    """Parsed-table files to table rows, each file once; a document's rows replace its older ones.

    A batch is written to its own folder, so a batch that is run again after a failure overwrites
    itself and nothing else. ``current_slices`` reads the newest batch of every document.
    """
    reader = spark.readStream.schema(PARSED_TABLES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = reader.json(source).withColumn("arrived", F.col("_metadata.file_modification_time")) \
        .withColumn("file", F.col("_metadata.file_path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("doc").agg(F.max(F.struct("arrived", "file"))["file"]
                                          .alias("file"))
        fresh = batch.join(newest, ["doc", "file"], "left_semi").drop("arrived", "file")
        rows = explode_parsed_tables(fresh, papers, tool).withColumn("tool", F.lit(tool))
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (files.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def current_slices(spark: SparkSession, target: str) -> DataFrame:
    """Rows of the newest batch per (document, tool)."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("source_doi", "tool").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["source_doi", "tool", "batch_id"], "left_semi")


def candidate_stream(stream: DataFrame, key: str = "doi", at: str = "ts",
                     delay: str = "24 hours") -> DataFrame:
    """First candidate per id while its state lives; ``at`` must be a TIMESTAMP."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay) \
        .dropDuplicatesWithinWatermark([key])


def merge_stream(stream: DataFrame, target: str, checkpoint: str, merge,
                 key: str = "doi") -> StreamingQuery:
    """Richest record per id: each batch is merged with ``merge`` and kept in its own folder.

    Read it back with ``merge`` over all folders; the merge of merges is the merge of all rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        merge(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def compact_merged(spark: SparkSession, target: str, into: str, merge) -> None:
    """The folders that ``merge_stream`` added, merged into one table of their own; the caller may then
    read that one and drop the folders that went into it."""
    merge(spark.read.parquet(target).drop("batch_id")).write.mode("overwrite").parquet(into)


def fresh_stream(stream: DataFrame, key: str, at: str, hours: int = 24) -> DataFrame:
    """Cache entries once per time to live: a repeat inside it is dropped."""
    return candidate_stream(stream, key, at, f"{hours} hours")


def first_per_id(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The batch twin of ``candidate_stream``."""
    return first_by(batch, [key], [F.col(o) for o in order])
