"""Packing of documents into fixed-length sequences: Martello-Toth reduction, then best fit.

How many pieces there are of each length is a table of at most `capacity` rows, whatever the size of
the corpus. The packing is planned on that table: the reduction fixes bins that provably dominate
every alternative (full pieces; pairs that fill a sequence; the largest piece with its largest
partner where no two pieces could do better), the rest is packed best fit, longest first, many equal
bins at a time. The plan says which ranks of a length go where; Spark ranks the pieces of each
length in salted groups and looks their places up. The plan's size depends on `capacity` only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.base import id_key, sliced
from recordloom.llm.tokens import encoder
from recordloom.session import cut

#: Pieces of one length that one task ranks, about.
GROUP_ROWS = 500_000


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fix dominating bins and take them out of `counts`. Returns (((length, times), ...), bins).

    A bin {a, b} dominates every bin with `a` if whatever else fits beside `a` fits into b's place:
    always where a + b fills the bin; and where b is the largest partner and at most two others fit
    beside `a`, none of whose sums is over b.
    """
    fixed = []

    def fix(lengths: tuple[int, ...], bins: int) -> None:
        kinds = {n: lengths.count(n) for n in lengths}
        for n, times in kinds.items():
            counts[n] -= times * bins
        fixed.append((tuple(kinds.items()), int(bins)))

    if counts[capacity]:
        fix((capacity,), counts[capacity])
    for a in range(capacity - 1, (capacity - 1) // 2, -1):
        b = capacity - a
        bins = counts[a] // 2 if a == b else min(counts[a], counts[b])
        if b >= 1 and bins:
            fix((a, b), bins)
    while True:
        there = np.flatnonzero(counts)
        if not len(there):
            return fixed
        a = int(there[-1])
        room = capacity - a
        # what is left beside one `a`
        counts[a] -= 1
        left = np.flatnonzero(counts)
        counts[a] += 1
        fits = left[left <= room]
        if not len(fits):
            fix((a,), counts[a] if a > room else 1)
            continue
        b = int(fits[-1])
        beside = np.repeat(fits, np.minimum(counts[fits] - (fits == a), 3))   # ascending, each up to 3 times
        if len(beside) >= 3 and int(beside[:3].sum()) <= room:
            return fixed
        best = 0                           # the largest sum of two others that fits
        for j in np.unique(beside):
            others = beside.tolist()
            others.remove(j)
            mates = [x for x in others if x + j <= room]
            best = max(best, int(j) + max(mates)) if mates else best
        if best > b:
            return fixed
        fix((a, b), 1 if a == b or best else min(counts[a], counts[b]))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, of all pieces in `counts`; equal bins are filled together."""
    open_bins: dict[int, list[list]] = {}
    free = np.zeros(capacity + 1, bool)
    done = []

    def put(content: tuple, room: int, bins: int) -> None:
        if not bins:
            return
        if room:
            open_bins.setdefault(room, []).append([content, bins])
            free[room] = True
        else:
            done.append((content, bins))

    for n in range(capacity, 0, -1):
        count = int(counts[n])
        while count:
            near = np.flatnonzero(free[n:])
            if len(near):
                room = n + int(near[0])
                content, bins = open_bins[room].pop()
                if not open_bins[room]:
                    free[room] = False
            else:
                content, room, bins = (), capacity, count
            times = room // n
            whole = min(bins, count // times)
            put((*content, (n, times)), room - times * n, whole)
            count -= whole * times
            rest = bins - whole
            if rest and count:             # fewer than `times` are left: they go into one bin
                put((*content, (n, count)), room - count * n, 1)
                rest, count = rest - 1, 0
            if content:
                put(content, room, rest)
    for room, bins in open_bins.items():
        done.extend((content, count) for content, count in bins)
    return done


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places of all pieces: rows (length, first rank, ranks, first sequence, sequences, offset)."""
    left = np.zeros(capacity + 1, np.int64)
    for n, count in counts.items():
        left[n] = count
    bins = reduce_by_dominance(left, capacity)
    bins += best_fit(left, capacity)
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for content, many in bins:
        offset = 0
        for n, times in content:
            rows.append((n, used[n], times * many, sequence, many, offset))
            used[n] += times * many
            offset += n * times
        sequence += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, id_col: str, text_col: str,
           special_strings: bool = True) -> DataFrame:
    """One row per piece of each document: id, k, piece, start, length, ids_crc32."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, special_strings)
        for batch in sliced(batches, "text"):
            ids, border = coder.encode(batch.column("text"), end)
            data = memoryview(ids.astype("<u4").tobytes())
            size = np.diff(border)
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = size[row] - (count[row] - 1) * capacity      # only the first piece may be shorter
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            at = border[:-1][row] + start
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.record_batch({"_id": batch.column("_id").take(pa.array(row)), "k": batch.column("k").take(pa.array(row)),
                                   "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                                   "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})

    base = docs.select(F.col(id_col).alias("_id"), id_key(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"_id {kind}, k long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", special_strings: bool = True) -> DataFrame:
    """Pack the token ids of all documents, each followed by id `end`, into sequences.

    Strings of special tokens in a text become those tokens, as in a plain call of the tokenizers
    library; with `special_strings=False` they are ordinary text.

    Documents longer than `capacity` are cut into pieces of `capacity` ids, the first of which may
    be shorter. Returns one row per piece: id, piece, start, length, ids_crc32, sequence_id, offset;
    offsets in a sequence have no gaps. Null or empty text: one piece, the end id. A null id or a
    repeated row is packed like any other row. Empty table: empty result. Other columns are ignored.
    """
    cutted = cut(pieces(docs, tokenizer, capacity, end, id_col, text_col, special_strings))
    counts = {r["length"]: r["count"] for r in cutted.groupBy("length").count().collect()}  # at most `capacity` rows
    places = plan(counts, capacity)
    keys = (places[:, 0] << 44) + places[:, 1]
    salts = 1 + sum(counts.values()) // GROUP_ROWS
    salted = cutted.withColumn("salt", F.pmod(F.xxhash64("k", "start", "ids_crc32"), F.lit(salts)))
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = (salted.groupBy("length", "salt").count()
              .select("length", "salt", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before")))
    ranked = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("k", "piece")) - 1)
              .join(before, ["length", "salt"])
              .select("_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).cast("long").alias("rank")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            n, first, _, sequence, many, offset = places[at].T
            rank = rank - first
            out = {name: batch.column(name) for name in batch.schema.names if name != "rank"}
            out |= {"sequence_id": pa.array(sequence + rank % many), "offset": pa.array(offset + rank // many * n)}
            yield pa.record_batch(out)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return ranked.mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long").withColumnRenamed("_id", id_col)
