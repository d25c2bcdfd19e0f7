"""Token ids as directly addressable codes, in a table of segments in document order.

Level 0 holds the low byte of every id and a bitmap of the ids that go on; level 1 the next byte of
those, and so on. A directory of set bits before every block of the bitmap gives the place of an id
on the next level, so any id is found by one look-up per level, with nothing decoded around it.

Documents are range-partitioned by id; partition p writes shard p, a row per segment of whole
documents. The ids before a document are those of earlier shards, of earlier segments of its shard
and of earlier documents of its segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.base import id_key, sliced
from recordloom.llm.tokens import encoder

_MAGIC = b"DAC1"
#: Bits between two entries of a rank directory.
BLOCK = 512
#: A segment is closed when it has this many ids; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 16


def encode(ids: np.ndarray) -> bytes:
    """The code of a sequence of ids below 2**32."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        if more.any():
            bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
            ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            ranks = np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))[:-1]
        else:
            bits, ranks = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        levels.append((rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = struct.pack("<4sI", _MAGIC, len(levels))
    sizes = b"".join(struct.pack("<III", *map(len, level)) for level in levels)
    return head + sizes + b"".join(part for level in levels for part in level)


class Code:
    """A code that is read in place."""

    def __init__(self, data: bytes):
        magic, count = struct.unpack_from("<4sI", data)
        if magic != _MAGIC:
            raise ValueError("not a token code")
        at, self.levels = 8 + 12 * count, []
        for level in range(count):
            parts = []
            for size, kind in zip(struct.unpack_from("<III", data, 8 + 12 * level), (np.uint8, np.uint8, np.dtype("<u4"))):
                parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self.levels.append(tuple(parts))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Id number i: one byte, one bit and one rank per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for depth, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * depth)
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            inner = bits[block * (BLOCK // 8):i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(inner).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the last."""
        value = self.levels[-1][0].astype(np.uint32)
        for low, bits, _ in self.levels[-2::-1]:
            more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
            out = low.astype(np.uint32)
            out[more] |= value << np.uint32(8)
            value = out
        return value


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id",
                 text_col: str = "text", special_strings: bool = True) -> None:
    """Write the ids of all documents, each followed by id `end`, in ascending order of document ids.

    Strings of special tokens in a text become those tokens, as in a plain call of the tokenizers
    library; with `special_strings=False` they are ordinary text.

    Null or empty text: the end id alone. A null id comes last; rows with one id are in the order
    of a hash of their texts. An empty table gives a store without segments. Other columns are ignored.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder = TaskContext.get().partitionId(), encoder(tokenizer, special_strings)
        names, sizes, held, number, before = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, sizes, held, number, before
            ids = np.concatenate(held)
            out = pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()),
                "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "ids": pa.array([names], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "code": pa.array([encode(ids)], pa.binary())})
            number, before, names, sizes, held = number + 1, before + len(ids), [], [], []
            return out

        waiting = 0
        for batch in sliced(batches, "text"):
            ids, border = coder.encode(batch.column("text"), end)
            for name, a, b in zip(batch.column("_id").to_pylist(), border[:-1].tolist(), border[1:].tolist()):
                names.append(name)
                sizes.append(b - a)
                held.append(ids[a:b])
                waiting += b - a
                if waiting >= SEGMENT_IDS:
                    yield close()
                    waiting = 0
        if names:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id_col).cast("long").alias("_id"), id_key(id_col).alias("k"),
                           F.col(text_col).cast("string").alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(parts, "k", "tie").sortWithinPartitions("k", "tie"))
    (ordered.select("_id", "text")
     .mapInArrow(run, "shard int, segment int, before long, n_ids long, ids array<long>, sizes array<long>, code binary")
     .write.parquet(path))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store, each with the number of ids before it in `begin`."""
    stored = spark.read.schema("shard int, segment int, before long, n_ids long, ids array<long>, "
                               "sizes array<long>, code binary").parquet(path)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))      # a row per shard
              .select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier")))
    return stored.join(F.broadcast(shards), "shard").withColumn("begin", F.col("earlier") + F.col("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each stored document: doc_id, start, n_tokens, ids_crc32, decoded from the store."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, names, sizes, code in zip(*(batch.column(c).to_pylist() for c in ("begin", "ids", "sizes", "code"))):
                data = memoryview(Code(code).all().astype("<u4").tobytes())
                border = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(border[:-1].tolist(), border[1:].tolist())]
                yield pa.record_batch({"doc_id": pa.array(names, pa.int64()), "start": pa.array(begin + border[:-1]),
                                       "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return (segments(spark, path).select("begin", "ids", "sizes", "code")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def tokens_at(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids number `index` of documents `doc_id` (rows of `wanted`), by random access.

    `store` comes from `segments`. Returns doc_id, index, token; a row outside its document, or of a
    document that is not stored, gets a null token. A repeated document id gives a row for each.
    """
    places = store.select("shard", "segment", F.posexplode("ids").alias("at", "doc_id"), "sizes").select(
        "shard", "segment", "doc_id",
        F.aggregate(F.slice("sizes", 1, F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x).alias("from"),
        F.element_at("sizes", F.col("at") + 1).alias("size"))
    found = wanted.select(F.col("doc_id").cast("long"), F.col("index").cast("long")).join(places, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, index, begin, size, code in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                inside = code is not None and index is not None and 0 <= index < size
                rows.append((name, index, Code(code)[begin + index] if inside else None))
            if rows:
                yield pa.record_batch({"doc_id": pa.array([r[0] for r in rows], pa.int64()),
                                       "index": pa.array([r[1] for r in rows], pa.int64()),
                                       "token": pa.array([r[2] for r in rows], pa.int64())})

    return (found.join(store.select("shard", "segment", "code"), ["shard", "segment"], "left")
            .select("doc_id", "index", "from", "size", "code")
            .mapInArrow(run, "doc_id long, index long, token long"))
