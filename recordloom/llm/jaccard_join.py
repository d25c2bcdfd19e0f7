"""Exact similarity join of shingle sets by T-occurrence search with skipped long lists.

Two sets of sizes a and b that reach the similarity share at least T of their shingles. DivideSkip
leaves the longest inverted lists of a set out of the merge and probes them afterwards: a partner
must then be met in the short lists. Every set here merges the fewest, shortest lists in which any
partner is met m times, those of its n - T + m rarest shingles; what they meet so often is probed by
binary search in the rest. Different sets of 85 % share six shingles at least, so m = 3 loses none,
and sets that meet by chance, in a shingle or two, are not pairs.

* Sets that are equal are one node, whatever the number of their documents.
* Frequent shingles are counted per task and summed; those over a share of all documents are few, by
  arithmetic, and come last in everybody's order. Any common order is exact; this one keeps lists short.
* Lists that stay long (the nodes agree in almost all they have) are not paired: in a few rounds all
  their nodes are compared with one of them, another one in each list; then only what is still
  outside the largest component of its list is compared with the other components there.
* A parity sketch of two to four bits per shingle bounds the difference of two sets from below and
  drops pairs, safely, before their sets are fetched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.base import NULL_ID, free_memory, id_key, in_slices, sliced
from recordloom.llm.bytewords import U64, blank_words, mix, windows, words_of
from recordloom.llm.components import connected
from recordloom.session import cut, drop_old_shuffles, release

#: Share of all documents from which a shingle counts as frequent; at most (mean set size / share) do.
FREQUENT = 1e-4
#: Nodes in an inverted list that are paired with one another; longer lists go the other way.
LONG_LIST = 64
#: Short lists in which two sets must meet, if the similarity allows no fewer.
MEETS = 3
#: Rounds in which the nodes of each long list are compared with one of them, before the rest is.
HEADS = 2
#: Ids that are broadcast at most to pick texts; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Shingles of a task that are counted together.
_COUNTED = 2_000_000
_SKETCH = 8          # numbers of 64 bits in the sketch of a set of up to 256; doubled for every doubling


def _shingles(column: pa.Array, size: int):
    """(row, fingerprint) of every shingle, by row; a short text is one shingle."""
    words = words_of(column, blank_words(), lower=True)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts)
    rows, values = [], []
    for width in range(1, size + 1):
        at, value = windows(words.code, words.first, width)
        if width < size:
            keep = words.counts[owner[at]] == width
            at, value = at[keep], value[keep]
        rows.append(owner[at])
        values.append(value)
    return np.concatenate(rows), np.concatenate(values)


def _sets(column: pa.Array, size: int):
    """(row, shingle) of every set, sorted by both; sizes; set fingerprints."""
    row, value = _shingles(column, size)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[once], value[once]
    n = np.bincount(row, minlength=len(column)).astype(np.int64)
    border = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate((np.zeros(1, U64), np.add.accumulate(mix(value + U64(11)))))
    name = mix(total[border[1:]] - total[border[:-1]] + n.astype(U64))
    return row, value, n, border, name.view(np.int64)


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def _meets(percent: int) -> int:
    """Lists in which a set merges any partner: what different sets share at least, up to `MEETS`."""
    return min(MEETS, -(-percent // max(1, 100 - percent)))


def _frequent(size: int):
    def run(batches):
        free_memory()
        held, count = [], 0

        def counted():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= 2
            return pa.record_batch({"shingle": pa.array(value[keep].view(np.int64)), "times": pa.array(times[keep])})

        for batch in sliced(batches, "text"):
            held.append(_shingles(batch.column("text"), size)[1])
            count += len(held[-1])
            if count >= _COUNTED:
                yield counted()
                held, count = [], 0
        if held:
            yield counted()
    return run


def _profiles(size: int, percent: int, hot, extra: int = 0):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        common, weight = hot.value
        row, value, n, border, name = _sets(batch.column("text"), size)
        load = np.zeros(len(value), np.int64)
        if len(common) and len(value):
            at = np.minimum(np.searchsorted(common, value), len(common) - 1)
            load = np.where(common[at] == value, weight[at], 0)
        order = np.lexsort((value, load, row))
        place = np.arange(len(value)) - border[row]
        keep = place < np.minimum(n, n - _needed(n, percent) + _meets(percent))[row]
        first = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(n)))))
        # parity of the shingles in each place of the sketch
        wide = _SKETCH << np.ceil(np.log2(np.maximum(n, 256) / 256)).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(wide)))
        place = (mix(value + U64(5)) & (wide[row] * 64 - 1).astype(U64)).astype(np.int64)
        cells = np.bincount(begin[row] * 64 + place, minlength=begin[-1] * 64) & 1
        bits = np.packbits(cells.astype(np.uint8)).view(np.int64)
        return pa.record_batch({
            "_id": batch.column("_id"), "k": batch.column("k"), "n": pa.array(n), "node": pa.array(name),
            "sketch": pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(bits)),
            "short": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value[order][keep].view(np.int64)))})
    return in_slices(run, "text")


def _whole_sets(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, value, _, border, name = _sets(batch.column("text"), size)
        fits = np.flatnonzero(batch.column("node").to_numpy() == name)
        lists = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(value.view(np.int64)))
        return pa.record_batch({"node": pa.array(name[fits]), "set": lists.take(pa.array(fits))})
    return in_slices(run, "text")


def _probe(percent: int):
    """Keep the pairs whose sets share enough: the smaller set is looked up in the larger one."""
    def run(batches):
        free_memory()
        for batch in batches:
            keep = []
            left, right = batch.column("set_x"), batch.column("set_y")
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy().view(U64), right[i].values.to_numpy().view(U64)
                if len(a) > len(b):
                    a, b = b, a
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            if keep:
                yield batch.select(["x", "y"]).take(pa.array(keep))
    return run


def _apart(x: Column, y: Column) -> Column:
    """Places in which two sketches differ; a sketch of twice the size is folded first."""
    def fold(a: Column, b: Column) -> Column:
        half = F.size(b)
        return F.when(F.size(a) > half, F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    return F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)


def _overlap(x: Column, y: Column, percent: int) -> Column:
    """Shingles that sets of these sizes must share."""
    return F.ceil(F.lit(percent) * (x + y) / F.lit(100.0 + percent) - F.lit(1e-9))


class JaccardJoin:
    """The steps of the join over one table; `components` runs them."""

    def __init__(self, docs: DataFrame, percent: int, size: int, id_col: str, text_col: str):
        self.percent, self.size = percent, size
        self.spark = docs.sparkSession
        self.kind = docs.select(id_col).schema[0].dataType.simpleString()
        self.base = docs.select(F.col(id_col).alias("_id"), id_key(id_col).alias("k"),
                                F.col(text_col).cast("string").alias("text"))

    def profiles(self) -> DataFrame:
        total = self.base.count()
        counts = (self.base.select("text").mapInArrow(_frequent(self.size), "shingle long, times long")
                  .groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= max(3.0, FREQUENT * total)))
        table = counts.toArrow()     # at most mean set size / FREQUENT rows, whatever the number of documents
        value = table["shingle"].to_numpy().view(U64)
        order = np.argsort(value)
        hot = self.spark.sparkContext.broadcast((value[order], table["times"].to_numpy()[order]))
        return cut(self.base.mapInArrow(_profiles(self.size, self.percent, hot),
                                        f"_id {self.kind}, k long, n long, node long, sketch array<long>, short array<long>"))

    def lists(self, profiles: DataFrame) -> DataFrame:
        """Rows (shingle, node, n, place) of the short inverted lists that hold two nodes or more."""
        rows = (profiles.where("n > 0").select("node", "n", F.posexplode("short").alias("place", "shingle")))
        met = rows.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("shingle")
        return cut(rows.join(met, "shingle", "left_semi").distinct())

    def _met(self, lists: DataFrame) -> DataFrame:
        """Pairs of nodes that meet in enough lists and can still share enough after each of them."""
        a = lists.select("shingle", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"))
        b = lists.select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"))
        bound = F.least("px", "py") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
        return (a.join(b, (a["shingle"] == b["shingle"]) & (F.col("x") < F.col("y"))
                       & (F.col("nx") * 100 >= F.col("ny") * self.percent) & (F.col("ny") * 100 >= F.col("nx") * self.percent)
                       & (bound >= _overlap(F.col("nx"), F.col("ny"), self.percent)))
                .groupBy("x", "y").count().where(F.col("count") >= _meets(self.percent)).select("x", "y"))

    def sketched(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs whose sketches do not rule them out."""
        a = nodes.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
        b = nodes.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
        apart = _apart(F.col("sx"), F.col("sy"))
        most = F.col("nx") + F.col("ny") - 2 * _overlap(F.col("nx"), F.col("ny"), self.percent)
        return pairs.join(a, "x").join(b, "y").where(apart <= most).select("x", "y")

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs that reach the similarity, by probing whole sets."""
        pairs = cut(pairs)
        wanted = cut(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
                     .join(nodes.select("node", "k"), "node"))
        picked = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        sets = self.base.select("k", "text").join(picked, "k").select("node", "text").mapInArrow(
            _whole_sets(self.size), "node long, `set` array<long>")
        found = cut(pairs.join(sets.select(F.col("node").alias("x"), F.col("set").alias("set_x")), "x")
                    .join(sets.select(F.col("node").alias("y"), F.col("set").alias("set_y")), "y")
                    .mapInArrow(_probe(self.percent), "x long, y long").distinct())
        release(pairs, wanted)
        drop_old_shuffles(self.spark)
        return found

    def _heads(self, members: DataFrame, salt: int) -> DataFrame:
        """One node per long list, another one in every list and for every salt."""
        return members.groupBy("shingle").agg(F.min_by(F.struct("node", "n", "place", *[c for c in ("part",) if c in members.columns]),
                                                       F.xxhash64("shingle", "node", F.lit(salt))).alias("h")).select("shingle", "h.*")

    def _across(self, left: DataFrame, right: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs of different components that meet in a list and are not ruled out."""
        sketches = nodes.select("node", "sketch")

        def side(rows: DataFrame, name: str) -> DataFrame:
            return rows.join(sketches, "node").select("shingle", F.col("node").alias(name), F.col("n").alias(f"n{name}"),
                                                      F.col("place").alias(f"p{name}"), F.col("part").alias(f"c{name}"),
                                                      F.col("sketch").alias(f"s{name}"))

        a, b = side(left, "x"), side(right, "y")
        needed = _overlap(F.col("nx"), F.col("ny"), self.percent)
        bound = F.least("px", "py") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
        return (a.join(b, (a["shingle"] == b["shingle"]) & (F.col("cx") != F.col("cy"))
                       & (F.col("nx") * 100 >= F.col("ny") * self.percent) & (F.col("ny") * 100 >= F.col("nx") * self.percent)
                       & (bound >= needed) & (_apart(F.col("sx"), F.col("sy")) <= F.col("nx") + F.col("ny") - 2 * needed))
                .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())

    def links(self, profiles: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links between nodes; in long lists as many as join the same components."""
        lists = self.lists(profiles)
        long = cut(lists.groupBy("shingle").count().where(F.col("count") > LONG_LIST).select("shingle"))
        # a pair that meets in a long list too is found there
        short = self._met(lists.join(long, "shingle", "left_anti"))
        found = self.verified(self.sketched(short, nodes), nodes)
        if long.isEmpty():
            release(lists, long)
            return found
        members = cut(lists.join(long, "shingle", "left_semi"))
        for salt in range(HEADS):
            named = self._named(members, found)
            found = self._joined(found, self.verified(self._across(named, self._heads(named, salt), nodes), nodes))
            release(named)
        # what is outside the largest component of its list is compared with all other components there
        named = self._named(members, found)
        sizes = named.groupBy("shingle", "part").count()
        main = sizes.groupBy("shingle").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts"))
        mixed = cut(named.join(main.where("parts > 1").drop("parts"), "shingle"))
        found = self._joined(found, self.verified(self._across(mixed.where("part <> main"), mixed, nodes), nodes))
        release(lists, members, long, named, mixed)
        return found

    def _joined(self, found: DataFrame, more: DataFrame) -> DataFrame:
        both = cut(found.union(more))
        release(found, more)
        return both

    def _named(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Members with their component so far."""
        roots = connected(found, "x", "y").withColumnRenamed("root", "part")
        return cut(members.join(roots, "node", "left").withColumn("part", F.coalesce("part", "node")))


def jaccard_components(docs: DataFrame, percent: int = 85, size: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_shingles, component_id, copies.

    A document's set holds its distinct shingles of `size` words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased);
    a shorter text is one shingle. Two sets link if 100 * |both| >= percent * |either|. component_id is
    the smallest id reached over links, copies the number of rows with an equal set. Shingles and
    sets are compared by 64-bit fingerprints; no pair is missed by design.

    Null or blank text: n_shingles 0, its own component. Null id: larger than all others, and a null
    component_id where it is the smallest. Repeated rows have equal sets. Empty table: empty result.
    Other columns of `docs` are ignored.
    """
    join = JaccardJoin(docs, percent, size, id_col, text_col)
    profiles = join.profiles()
    nodes = cut(profiles.where("n > 0").groupBy("node").agg(F.min("k").alias("k"), F.first("n").alias("n"),
                                                          F.first("sketch").alias("sketch"), F.count("*").alias("copies")))
    roots = connected(join.links(profiles, nodes), "x", "y")
    named = nodes.join(roots, "node", "left").select("node", "k", "copies", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("k").alias("least"))
    classes = named.join(least, "root").select("node", "least", "copies")
    kind = join.kind
    return (profiles.where("n > 0").select("_id", "n", "node").join(classes, "node")
            .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("least") != NULL_ID, F.col("least")).cast(kind).alias("component_id"), "copies")
            .unionByName(profiles.where("n = 0").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                                                        F.col("_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))))


def keep_one_per_group(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """`docs` without the documents whose component holds a smaller id; columns unchanged.

    Of rows with one id and equal texts one stays. An id that rows with different texts share goes
    only if all of them would. Null ids are the largest: such a row goes if it links to a row with an id.
    Null and blank texts stay. Empty table: empty result.
    """
    groups = cut(jaccard_components(docs.select(id_col, text_col), percent, size, id_col, text_col)
                 .groupBy(id_key(id_col).alias("k")).agg(F.count("*").alias("rows"), F.min((id_key(id_col) != id_key("component_id"))).alias("goes")))
    lost = cut(groups.where("goes").select("k"))
    again = cut(groups.where("rows > 1 and not goes").select("k"))

    def bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_key(id_col).alias("k"))
    if not lost.isEmpty():
        kept = kept.join(bounded(lost), "k", "left_anti")
    if not again.isEmpty():
        twice = (kept.join(bounded(again), "k", "left_semi").withColumn("text", F.col(f"doc.`{text_col}`"))
                 .dropDuplicates(["k", "text"]).drop("text"))
        kept = kept.join(bounded(again), "k", "left_anti").unionByName(twice)
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
