"""Hard negatives by windows of scores, read from Hilbert-ordered blocks that zone maps choose.

Candidates are sorted by label and Hilbert key, cut into blocks of rows and written as Parquet, one
row per block, with the smallest and largest value of every dimension. Interval arithmetic over these
zone maps bounds the inner products of an anchor with a block from both sides. A window (scores from
low to high, equal or different label, the best k) reads first the blocks that promise most; what it
finds raises its lower end, and then the other blocks whose bounds still meet the window are read.

Anchors go in tiles. A pair of tile and block is scored once, as one matrix product; tiles and blocks
are rows of bounded size, so a hot label or copies of one vector only mean more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.base import free_memory
from recordloom.llm.subvector_kmeans import all_finite, scaled
from recordloom.session import cut

#: Candidates in a block, anchors in a tile, zone maps in a page.
BLOCK, TILE, PAGE = 256, 256, 128
#: Blocks that each window reads first.
FIRST = 2
#: Dimensions (those of largest variance) and bits of each in the Hilbert key.
KEY_DIMS, KEY_BITS = 16, 4
#: Tiles whose best rows a task holds at a time.
_OPEN = 64
_LOWEST, _HIGHEST = -(2**62), 2**62


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits, as signed 64-bit numbers."""
    x = cells.astype(np.int64).T.copy()
    bit = 1 << (bits - 1)
    while bit > 1:                        # undo the turns of every level, the coarsest first
        below = bit - 1
        for axis in range(len(x)):
            high = (x[axis] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(high, below, swap)
            x[axis] ^= swap
        bit >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << np.uint64(1) | (axis >> b & 1).astype(np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v.values.to_numpy()
    return out


def _with_key(dims: int, axes: list[int], low: np.ndarray, span: np.ndarray):
    def run(batches):
        free_memory()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _vectors(batch.column("q"), dims)
            cells = ((rows[:, axes] - low) * (1 << KEY_BITS) // (span + 1))
            key = hilbert_key(cells, KEY_BITS) if axes else np.zeros(len(rows), np.int64)
            q = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dims), pa.array(rows.astype(np.int32).ravel()))
            yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), "key": pa.array(key), "q": q})
    return run


_BLOCK_KIND = "block long, ids array<long>, labels array<long>, rows binary, low array<int>, high array<int>, kinds array<long>"


def _blocks(size: int, dims: int):
    """Sorted rows in blocks of `size`; the last one of a task is shorter."""
    def block(number: int, held: pa.Table) -> pa.RecordBatch:
        rows = _vectors(held.column("q").combine_chunks(), dims).astype("<i4")
        labels = held.column("label").combine_chunks()
        return pa.record_batch({
            "block": pa.array([number]), "ids": pa.array([held.column("id").to_pylist()], pa.list_(pa.int64())),
            "labels": pa.array([labels.to_pylist()], pa.list_(pa.int64())), "rows": pa.array([rows.tobytes()], pa.binary()),
            "low": pa.array([rows.min(axis=0).tolist()], pa.list_(pa.int32())), "high": pa.array([rows.max(axis=0).tolist()], pa.list_(pa.int32())),
            "kinds": pa.array([np.unique(labels.to_numpy()).tolist()], pa.list_(pa.int64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        free_memory()
        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == size:
                    yield block(number, pa.Table.from_batches(held))
                    number, held, count = number + 1, [], 0
        if count:
            yield block(number, pa.Table.from_batches(held))
    return run


def _matrix(batch: pa.RecordBatch, i: int, name: str, dims: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_py(), "<i4").reshape(-1, dims).astype(np.int64)


def _longs(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in floating point where every partial sum is below 2**53."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _chosen(dims: int, same: bool, first: int | None):
    """(tile, block): the `first` most promising blocks of every window, or all that meet a window."""
    def run(batches):
        free_memory()
        for batch in batches:
            for i in range(batch.num_rows):
                a = _matrix(batch, i, "rows", dims)
                label = _longs(batch, i, "labels")
                zones = batch.column("zones")[i].values
                low = zones.field("low").flatten().to_numpy().reshape(-1, dims).astype(np.int64)
                high = zones.field("high").flatten().to_numpy().reshape(-1, dims).astype(np.int64)
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                most, least = _product(up, high) + _product(down, low), _product(up, low) + _product(down, high)
                of, kind = zones.field("kinds").value_parent_indices().to_numpy(), zones.field("kinds").flatten().to_numpy()
                fits = np.zeros(most.shape, bool)
                rows, cols = np.nonzero((label[:, None] == kind[None]) == same)
                fits[rows, of[cols]] = True
                at, begin, end = _longs(batch, i, "at"), _longs(batch, i, "begin"), _longs(batch, i, "end")
                meets = fits[at] & (least[at] <= end[:, None]) & (most[at] >= begin[:, None])
                if first is not None and meets.shape[1] > first:
                    promise = np.where(meets, np.minimum(most[at], end[:, None]), _LOWEST)
                    best = np.argpartition(-promise, first - 1, axis=1)[:, :first]
                    taken = np.zeros(meets.shape, bool)
                    np.put_along_axis(taken, best, True, axis=1)
                    meets &= taken
                wanted = np.flatnonzero(meets.any(axis=0))
                if len(wanted):
                    block = zones.field("block").to_numpy()[wanted]
                    yield pa.record_batch({"tile": pa.array(np.full(len(block), batch.column("tile")[i].as_py())), "block": pa.array(block)})
    return run


class _Best:
    """The best k candidates of every window of one tile."""

    def __init__(self, batch: pa.RecordBatch, i: int, dims: int, k: int):
        self.rows, self.labels, self.ids = _matrix(batch, i, "rows", dims), _longs(batch, i, "labels"), _longs(batch, i, "ids")
        self.at, self.window = _longs(batch, i, "at"), _longs(batch, i, "window")
        self.begin, self.end = _longs(batch, i, "begin").copy(), _longs(batch, i, "end")
        self.k = k
        self.score = np.full((len(self.at), k), _LOWEST)
        self.id = np.zeros((len(self.at), k), np.int64)

    def meet(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool) -> None:
        order = np.argsort(ids, kind="stable")             # ties of scores go to the smaller id
        rows, ids, labels = rows[order], ids[order], labels[order]
        score = _product(self.rows, rows)
        allowed = (self.labels[:, None] == labels[None]) == same
        if same:
            allowed &= self.ids[:, None] != ids[None]
        score = score[self.at]
        fits = allowed[self.at] & (score >= self.begin[:, None]) & (score <= self.end[:, None])
        busy = np.flatnonzero(fits.any(axis=1))
        if not len(busy):
            return
        wide = np.concatenate((self.score[busy], np.where(fits[busy], score[busy], _LOWEST)), axis=1)
        names = np.concatenate((self.id[busy], np.broadcast_to(ids, (len(busy), len(ids)))), axis=1)
        order = np.lexsort((names, -wide), axis=1)[:, :self.k]
        self.score[busy] = np.take_along_axis(wide, order, axis=1)
        self.id[busy] = np.take_along_axis(names, order, axis=1)
        self.begin[busy] = np.maximum(self.begin[busy], self.score[busy, -1])

    def found(self, tile: int) -> pa.RecordBatch:
        row, place = np.nonzero(self.score > _LOWEST)
        return pa.record_batch({"tile": pa.array(np.full(len(row), tile)), "at": pa.array(self.at[row]), "window": pa.array(self.window[row]),
                                "score": pa.array(self.score[row, place]), "id": pa.array(self.id[row, place])})


def _read(dims: int, k: int, same: bool):
    def run(batches):
        free_memory()
        held: dict[int, _Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                tile = batch.column("tile")[i].as_py()
                if tile not in held:
                    if len(held) == _OPEN:
                        oldest = next(iter(held))
                        yield held.pop(oldest).found(oldest)
                    held[tile] = _Best(batch, i, dims, k)
                held[tile].meet(_matrix(batch, i, "block_rows", dims), _longs(batch, i, "block_ids"), _longs(batch, i, "block_labels"), same)
        for tile, best in held.items():
            yield best.found(tile)
    return run


class BlockSearch:
    """Candidates in Hilbert-ordered blocks with zone maps; `search` answers windows of anchors."""

    def __init__(self, rows: DataFrame, dims: int, key: list[int], low: np.ndarray, span: np.ndarray):
        self.dims = dims
        keyed = rows.mapInArrow(_with_key(dims, key, low, span), "id long, label long, key long, q array<int>")
        order = ["label", "key", "id"]
        self.blocks = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(BLOCK, dims), _BLOCK_KIND))
        count = self.blocks.count()
        self.pages = max(1, -(-count // PAGE))
        self.zones = (self.blocks.select(F.pmod(F.xxhash64("block"), F.lit(self.pages)).alias("page"), F.struct("block", "low", "high", "kinds").alias("z"))
                      .groupBy("page").agg(F.collect_list("z").alias("zones")))

    def tiles(self, every: int) -> DataFrame:
        """Anchors (ids divisible by `every`) in tiles: the same rows, cut anew."""
        rows = (self.blocks.select(F.posexplode("ids").alias("i", "id"), "labels", "rows", "block").where(F.col("id") % every == 0)
                .select("block", "id", F.get("labels", F.col("i")).alias("label"),
                        F.substring(F.col("rows"), F.col("i") * F.lit(4 * self.dims) + 1, F.lit(4 * self.dims)).alias("row")))
        rows = cut(rows)
        count = rows.count()
        return cut(rows.repartitionByRange(max(1, -(-count // TILE)), "block", "id").sortWithinPartitions("block", "id")
                   .mapInArrow(_tile_up, "tile long, ids array<long>, labels array<long>, rows binary"))

    def _with_windows(self, tiles: DataFrame, windows: DataFrame) -> DataFrame:
        lists = (windows.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", "window", "begin", "end"))).alias("w"))
                 .select("tile", *[F.col(f"w.{c}").alias(c) for c in ("at", "window", "begin", "end")]))
        return tiles.join(lists, "tile")

    def _choose(self, tiles: DataFrame, same: bool, first: int | None) -> DataFrame:
        paged = tiles.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.pages - 1).cast("long"))))
        return (paged.join(self.zones, "page").mapInArrow(_chosen(self.dims, same, first), "tile long, block long"))

    def _visit(self, pairs: DataFrame, tiles: DataFrame, k: int, same: bool) -> DataFrame:
        rows = self.blocks.select("block", F.col("rows").alias("block_rows"), F.col("ids").alias("block_ids"), F.col("labels").alias("block_labels"))
        return cut(pairs.join(rows, "block").join(tiles, "tile").drop("block")
                   .mapInArrow(_read(self.dims, k, same), "tile long, at long, window long, score long, id long"))

    def search(self, tiles: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """Rows (tile, at, window, score, id, rank): the best k candidates of every window.

        `windows` has (tile, at, window, begin, end): place of the anchor in its tile, a number, and
        the scores from begin to end that are wanted.
        """
        open_tiles = cut(self._with_windows(tiles, windows))
        before = cut(self._choose(open_tiles, same, FIRST).distinct())
        found = self._visit(before, open_tiles, k, same)
        key = ["tile", "at", "window"]
        best = Window.partitionBy(*key).orderBy(F.col("score").desc(), "id")
        reached = (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                   .groupBy(*key).agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k))
        raised = (windows.join(reached, key, "left")
                  .withColumn("begin", F.greatest("begin", F.coalesce("least", "begin"))).select(*key, "begin", "end"))
        open_tiles = cut(self._with_windows(tiles, raised))
        after = self._choose(open_tiles, same, None).join(before, ["tile", "block"], "left_anti")
        every = found.unionByName(self._visit(after, open_tiles, k, same))
        return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _tile_up(batches):
    from pyspark import TaskContext

    free_memory()
    number, held, count = TaskContext.get().partitionId() << 32, [], 0

    def tile() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        return pa.record_batch({"tile": pa.array([number]), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
                                "labels": pa.array([rows.column("label").to_pylist()], pa.list_(pa.int64())),
                                "rows": pa.array([b"".join(rows.column("row").to_pylist())], pa.binary())})

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, TILE - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == TILE:
                yield tile()
                number, held, count = number + 1, [], 0
    if count:
        yield tile()


def mine_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90,
                   every: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor, positive and place: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x becomes floor(scale * x), held within +-2**27; a score is the inner product. Anchors
    are rows whose id is divisible by `every`. Higher scores come first, ties by smaller id. Positives are the first
    rows of the anchor's label with another id; negatives of a positive are the first rows of other labels
    with low_percent * positive_score <= 100 * score <= high_percent * positive_score.

    Null id, label or vector, and null or non-finite components: the row takes no part. Vectors of other
    lengths count as ending in zeros. Repeated rows: each is a candidate and, if divisible, an anchor of
    its own. No positive or no negative: no row. Empty table: empty result. Other columns are ignored.
    """
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & all_finite(F.col("v")))
            .select("id", "label", scaled(F.col("v"), scale).alias("q")))
    rows = cut(rows)
    spread = (rows.select(F.posexplode("q").alias("d", "x")).groupBy("d")
              .agg(F.var_pop("x").alias("v"), F.min("x").alias("low"), F.max("x").alias("high")).collect())   # a row per dimension
    spread = sorted(spread, key=lambda r: (-r["v"], r["d"]))[:KEY_DIMS]
    dims = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    axes = sorted(spread, key=lambda r: r["d"])
    low = np.array([r["low"] for r in axes], np.int64)
    span = np.array([r["high"] for r in axes], np.int64) - low
    search = BlockSearch(rows, max(dims, 1), [r["d"] for r in axes], low, span)
    tiles = search.tiles(every)
    anchors = tiles.select("tile", F.posexplode("ids").alias("at", "anchor_id")).withColumn("at", F.col("at").cast("long"))
    whole = anchors.select("tile", "at", F.lit(0).cast("long").alias("window"), F.lit(_LOWEST + 1).alias("begin"), F.lit(_HIGHEST).alias("end"))
    near = cut(search.search(tiles, whole, positives, True).join(anchors, ["tile", "at"])
               .select("tile", "at", F.col("rank").cast("long").alias("window"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = near.select("tile", "at", "window", F.ceil(score * low_percent / 100).cast("long").alias("begin"),
                          F.floor(score * high_percent / 100).cast("long").alias("end")).where("begin <= end")
    found = search.search(tiles, windows, negatives, False)
    return (found.join(near, ["tile", "at", "window"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
