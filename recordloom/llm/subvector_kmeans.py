"""Centroid clustering in exact integers over subvector dictionaries.

The rows of a task are cut into chunks, and the dimensions of a chunk into blocks. The subvectors of
a block are replaced, without loss, by codes into the dictionary of its distinct subvectors. A round
computes the distance of every dictionary entry to every centroid once and adds partial distances by
code; the sums that move the centroids come from counts of codes. Encoded chunks are written once,
each round reads them, and nothing but one sum per (centroid, dimension) leaves a task: no shuffle
depends on the number of rows, and copies of one vector, however many, are a few dictionary entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.base import free_memory
from recordloom.session import cut

#: Rows that share dictionaries.
CHUNK_ROWS = 32768
#: Integer components are held within these bounds, so that squared distances fit a long.
BOUND = 2**27


def all_finite(vector: Column) -> Column:
    """No component is null, infinite or not a number."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, held within +-BOUND."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), F.lit(float(BOUND))),
                                                            F.lit(-float(BOUND)))).cast("int"))


def _dictionaries(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(codes, dictionaries) of a chunk at the block width that makes a round cheapest.

    Blocks of one dimension are numbered first. Blocks of twice the width are numbered by the pairs
    of codes, as long as distances to dictionary entries plus sums by code get fewer.
    """
    n, dims = rows.shape
    codes, books = [], []
    for d in range(dims):
        values, code = np.unique(rows[:, d], return_inverse=True)
        codes.append(code.astype(np.int64))
        books.append(values[:, None])
    cost = sum(b.size for b in books) + n * len(codes)
    while len(codes) > 1:
        more, wider = [], []
        for a in range(0, len(codes), 2):
            if a + 1 == len(codes):
                more.append(codes[a])
                wider.append(books[a])
                continue
            pair, code = np.unique(codes[a] * len(books[a + 1]) + codes[a + 1], return_inverse=True)
            more.append(code)
            wider.append(np.concatenate((books[a][pair // len(books[a + 1])], books[a + 1][pair % len(books[a + 1])]), axis=1))
        then = sum(b.size for b in wider) + n * len(more)
        if then >= cost:
            break
        codes, books, cost = more, wider, then
    return np.stack(codes, axis=1).astype(np.int32), books


def _encode(dims: int, kind: pa.DataType):
    def row(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        codes, books = _dictionaries(rows)
        flat = np.concatenate([b.astype(np.int32).ravel() for b in books])
        return pa.record_batch({
            "ids": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(kind)),
            "codes": pa.array([codes.T.astype("<i4").tobytes()], pa.binary()),
            "books": pa.array([flat.astype("<i4").tobytes()], pa.binary()),
            "shapes": pa.array([[x for b in books for x in b.shape]], pa.list_(pa.int32()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        ids, parts, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column("id"))
            parts.append(batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            held += batch.num_rows
            if held >= CHUNK_ROWS:
                yield row(ids, parts)
                ids, parts, held = [], [], 0
        if held:
            yield row(ids, parts)
    return run


class _Chunk:
    """One encoded chunk inside a task."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.ids = batch.column("ids")[i].values
        shapes = batch.column("shapes")[i].values.to_numpy().reshape(-1, 2)
        self.codes = np.frombuffer(batch.column("codes")[i].as_py(), "<i4").reshape(len(shapes), -1)
        flat = np.frombuffer(batch.column("books")[i].as_py(), "<i4").astype(np.int64)
        self.books, at = [], 0
        for entries, width in shapes.tolist():
            self.books.append(flat[at:at + entries * width].reshape(entries, width))
            at += entries * width

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, squared distance) of every row; of equal distances the first centroid."""
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        at = 0
        for code, book in zip(self.codes, self.books):
            near = centroids[:, at:at + book.shape[1]]
            table = ((book[:, None, :] - near[None]) ** 2).sum(axis=2)
            total += table[code]
            at += book.shape[1]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(best)), best]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sum of the rows of every cluster, by counts of codes."""
        out = []
        for code, book in zip(self.codes, self.books):
            counts = np.bincount(cluster * len(book) + code, minlength=k * len(book)).reshape(k, len(book))
            out.append(counts @ book)
        return np.concatenate(out, axis=1)


def _chunks(batches):
    free_memory()
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Chunk(batch, i)


def _round(centroids: np.ndarray):
    """Rows (cluster, dim, part) of one round; dim -1 holds the number of rows, -2 the summed distance."""
    k, dims = centroids.shape

    def run(batches):
        for chunk in _chunks(batches):
            cluster, distance = chunk.assigned(centroids)
            spent = [sum(distance[cluster == c].tolist()) for c in range(k)]
            table = np.concatenate((chunk.sums(cluster, k), np.bincount(cluster, minlength=k)[:, None]), axis=1)
            yield pa.record_batch({
                "cluster": pa.array(np.concatenate((np.repeat(np.arange(k), dims + 1), np.arange(k)))),
                "dim": pa.array(np.concatenate((np.tile([*range(dims), -1], k), np.full(k, -2)))),
                "part": pa.array([str(x) for x in table.ravel().tolist()] + [str(x) for x in spent])})
    return run


def _place(centroids: np.ndarray, kind: pa.DataType):
    def run(batches):
        for chunk in _chunks(batches):
            cluster, distance = chunk.assigned(centroids)
            for a in range(0, len(cluster), 4096):
                yield pa.record_batch({"id": chunk.ids[a:a + 4096].cast(kind), "cluster": pa.array(cluster[a:a + 4096].astype(np.int32)),
                                       "distance": pa.array(distance[a:a + 4096])})
    return run


def _table(chunks: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """The sums of one round: (dimensions + 2) numbers per centroid, whatever the number of rows."""
    rows = (chunks.mapInArrow(_round(centroids), "cluster long, dim long, part string")
            .groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(28,0)")).alias("total")).collect())
    return {(r["cluster"], r["dim"]): int(r["total"]) for r in rows}


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, salt: str = "3:",
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept row of `vectors`: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rows are kept whose vector has exactly `dims` components, none null or not finite; a component x
    becomes floor(scale * x), held within +-2**27. Centroids start as the `k` rows whose lowercase-hex
    sha256 of `salt` and id is smallest. A round gives every row to the nearest centroid (squared
    Euclidean distance; of equal ones the smaller number) and moves every centroid that has rows to the
    componentwise floor of their mean; then rows are assigned once more. All arithmetic is exact.

    Null vector: not kept. Null id: kept, last among starting rows. Equal ids: starting rows tie by their
    components; every repeated row counts and is returned. Fewer than `k` rows: as many clusters. Empty
    table: empty result. Other columns are ignored. A sum of distances beyond a long is null.
    """
    kind = vectors.select(id_col).schema[0].dataType
    vector = F.col(vector_col).cast("array<double>")
    kept = (vectors.select(F.col(id_col).alias("id"), vector.alias("v"))
            .where((F.size("v") == dims) & all_finite(F.col("v"))).select("id", scaled(F.col("v"), scale).alias("q")))
    first = (kept.select("q", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"))
             .orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect())
    arrow_kind = pa.int64() if kind.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    held = "bigint" if arrow_kind == pa.int64() else "string"
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not first:
        empty = kept.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in zip(names, ["int", "bigint", "bigint", "bigint", "string"])])
        return empty.where(F.lit(False))
    centroids = np.array([r["q"] for r in first], np.int64)
    chunks = cut(kept.select(F.col("id").cast(held).alias("id"), "q")
                 .mapInArrow(_encode(dims, arrow_kind), f"ids array<{held}>, codes binary, books binary, shapes array<int>"))
    for _ in range(rounds):
        total = _table(chunks, centroids)
        moved = centroids.copy()
        for c in range(len(centroids)):
            count = total.get((c, -1), 0)
            if count:
                moved[c] = [total[c, d] // count for d in range(dims)]
        centroids = moved
    total = _table(chunks, centroids)
    spent = [total.get((c, -2), 0) for c in range(len(centroids))]
    names_of = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def long_or_null(x: int) -> Column:
        return F.lit(x if x < 2**63 else None).cast("long")

    at = F.col("cluster") + 1
    return (chunks.mapInArrow(_place(centroids, arrow_kind), f"id {held}, cluster int, distance bigint")
            .select(F.col("id").cast(kind).alias(id_col), "cluster", "distance",
                    F.element_at(F.array(*[long_or_null(x) for x in spent]), at).alias("cluster_inertia"),
                    long_or_null(sum(spent)).alias("inertia"),
                    F.element_at(F.array(*[F.lit(x) for x in names_of]), at).alias("centroid_sha256")))
