"""Streams over several batches: repeats, expired state and late rows."""

import time

from pyspark.sql import functions as F

from recordloom.streaming.ingest import candidate_stream, compact_merged, merge_stream

BATCHES = [
    [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")],
    [("a", "2024-01-01 03:00:00"), ("c", "2024-01-05 00:00:00")],       # a repeats inside its day
    [("f", "2024-01-05 00:30:00")],                                     # lateness counts from the watermark before this
    [("d", "2024-01-01 00:00:00"), ("e", "2024-01-05 01:00:00")],       # d is days late
    [("a", "2024-01-05 02:00:00")],                                     # the state of a has gone
]


def test_late_rows_and_expired_ids(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        (spark.createDataFrame(rows, "doi string, at string").withColumn("ts", F.to_timestamp("at")).coalesce(1)
         .write.mode("append").parquet(str(tmp_path / "in")))
        time.sleep(1.1)                                                 # files are read in the order of their times
    stream = (spark.readStream.schema("doi string, at string, ts timestamp").option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "in")))
    (candidate_stream(stream, "doi", "ts", "24 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination())
    got = sorted((r["doi"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [d for d, _ in got] == ["a", "a", "b", "c", "e", "f"]
    assert got[0][1].startswith("2024-01-01") and got[1][1] == "2024-01-05 02:00:00"


def test_batches_are_compacted(spark, tmp_path):
    def merge(df):
        return df.groupBy("doi").agg(F.max("best").alias("best"))

    for v in (1, 2):
        spark.createDataFrame([("a", v), (f"x{v}", v)], "doi string, best int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("doi string, best int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), merge).awaitTermination()
    compact_merged(spark, str(tmp_path / "out"), str(tmp_path / "one"), merge)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "one")).collect()} == {("a", 2), ("x1", 1), ("x2", 2)}
