"""A hierarchical Pitman-Yor language model of word pairs, sampled by Gibbs over all training texts.

A word is drawn in the restaurant of the word before it; what opens a table there is a customer of
the root restaurant, which all contexts share as their parent; what opens a table in the root is drawn
uniformly from the known words and one unknown word. Seating is sampled in sweeps: every dish of
every restaurant is seated anew, given the tables that the sweep before left for the other dishes there and
the predictive probabilities of the parent. Probabilities are averaged over the sweeps after the first.

How it runs: texts become chunks, one row of token numbers each, with a dictionary of its own words. Chunks
are written once, bucketed by chunk, so that joins with what comes back to a chunk move only that.
A sum over all chunks by key (word or word pair) is a round trip: sorted keys and values of a chunk go, cut
into ranges of keys of bounded size, to one row group per part, are summed there, and the sums return to the chunks
that hold the key. One chunk owns a key and counts it for the restaurants; seats are a pure function of key, counts and
sweep, so the others see the same seats without being told, and a lost task repeats them exactly.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.base import free_memory, sliced
from recordloom.llm.bytewords import U64, blank_words, mix, words_of
from recordloom.session import cut, delete, drop_old_shuffles, shared_folder

#: Bytes of text in a chunk; a longer text is a chunk alone.
CHUNK_BYTES = 1 << 20
#: Keys, with repeats over chunks, in a part of a round trip.
PART_KEYS = 300_000
#: Customers of a dish up to which its tables are drawn exactly (a power of two).
EXACT = 256
#: Numbers that a step of the sampler holds.
_CELLS = 1 << 16
#: What stands before the first word of a text, and after its last.
START, END = 0x5374617274, 0x456E64456E64


# ---- columns of numbers as bytes: their width, then the places apart, of which upper ones without a bit set are left out

def _pack(x: np.ndarray, kind: str = "<i8") -> bytes:
    x = np.ascontiguousarray(x, dtype=kind)
    width = x.itemsize if len(x) and x.min() < 0 else max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(len(x), x.itemsize).T[:width].tobytes()


def _count(data: bytes) -> int:
    """How many numbers were packed."""
    return (len(data) - 1) // data[0]


def _unpack(data: bytes, kind: str = "<i8") -> np.ndarray:
    out = np.zeros((_count(data), np.dtype(kind).itemsize), np.uint8)
    out[:, :data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T if len(out) else 0
    return out.view(kind).ravel()


def _pack_codes(codes: np.ndarray) -> bytes:
    """Ascending codes, as steps from one to the next: their upper bytes are zeros."""
    return _pack(np.diff(codes, prepend=U64(0)), "<u8")


def _unpack_codes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=U64)


# ---- seating

def _uniform(key: np.ndarray, *at: int) -> np.ndarray:
    """A number in (0, 1) for every key, the same wherever it is asked for."""
    salt = 0x9E3779B97F4A7C15
    for x in at:
        salt = (salt * 0xD1B54A32D192ED03 + x + 1) % 2**64
    return ((mix(key ^ U64(salt)) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


@functools.lru_cache(maxsize=4)
def _ways(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weights of c customers at t tables, at [c, t - 1]."""
    out = np.full((EXACT + 1, EXACT), -np.inf)
    out[1, 0] = 0.0
    tables = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * tables, 0))
        out[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], out[c][:-1])))
    return out


def _seated(key, customers, others, share, strength, discount, at) -> np.ndarray:
    """Tables of dishes of at most EXACT customers, drawn from their exact distribution."""
    wide = int(customers.max())
    place = np.arange(wide)
    opening = np.log(strength + discount * (others[:, None] + place)) + np.log(share)[:, None]
    weight = _ways(discount)[customers, :wide] + np.cumsum(opening, axis=1)
    weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return 1.0 + (weight < (_uniform(key, *at, 0) * weight[:, -1])[:, None]).sum(axis=1)


def _many(key, customers, others, share, strength, discount, at) -> np.ndarray:
    """Tables of dishes of more customers, from a close approximation.

    The Stirling number of c customers and t tables is c! / (t! d**t) times the coefficient of x**c in
    (1 - (1 - x)**d)**t. At its saddle point one table more weighs (a + t) * share * (1 - y**d) / t, with
    a = strength / d + others and y = 1 - x; with y held at the mode this is a negative binomial.
    """
    a = strength / discount + others
    low, high = np.full(len(key), -600.0), np.full(len(key), -1e-9)
    for _ in range(60):                                  # the logarithm of y at the mode
        log = (low + high) / 2
        held = -np.expm1(discount * log)
        tables = customers * held / (-np.expm1(log) * discount * np.exp((discount - 1) * log))
        below = (a + tables) * share * held > tables
        low, high = np.where(below, log, low), np.where(below, high, log)
    q = np.clip(share * -np.expm1(discount * low), 1e-300, 1 - 1e-9)
    mean, u = (a + 1) * q / (1 - q), _uniform(key, *at, 1)
    out = np.zeros(len(key))
    left = np.flatnonzero(mean < 24)
    term = np.exp((a[left] + 1) * np.log1p(-q[left]))
    total = term.copy()
    for k in range(256):
        more = u[left] > total
        left, term, total = left[more], term[more], total[more]
        if not len(left):
            break
        out[left] += 1
        term = term * (a[left] + 1 + k) / (k + 1) * q[left]
        total = total + term
    far = np.flatnonzero(mean >= 24)
    normal = np.sqrt(-2 * np.log(u[far])) * np.cos(2 * np.pi * _uniform(key[far], *at, 2))
    out[far] = np.rint(mean[far] + normal * np.sqrt(mean[far] / (1 - q[far])))
    return np.clip(1 + out, 1, customers)


def seat(key, customers, others, share, strength: float, discount: float, sweep: int, level: int) -> np.ndarray:
    """Tables of every dish, given those of the others in its restaurant and its probability in the parent.

    No customer, no table; one customer, one table. Up to EXACT customers the number is drawn from its exact
    distribution, with the seats themselves summed out; beyond, from an approximation of it.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    bound = 2
    while bound <= EXACT:
        rows = np.flatnonzero((customers > bound // 2) & (customers <= bound))
        step = max(1, _CELLS // bound)
        for a in range(0, len(rows), step):
            r = rows[a:a + step]
            tables[r] = _seated(key[r], customers[r], others[r], share[r], strength, discount, (level, sweep))
        bound *= 2
    rest = np.flatnonzero(customers > EXACT)
    if len(rest):
        tables[rest] = _many(key[rest], customers[rest], others[rest], share[rest], strength, discount, (level, sweep))
    return tables


@dataclass(frozen=True)
class Root:
    """Numbers of the whole corpus that a sweep needs: known words, customers and tables of the root now,
    and its tables in the sweep before, against which it was seated."""

    words: int
    strength: float
    discount: float
    before: int
    customers: int = 0
    tables: int = 0

    def seated(self, code: np.ndarray, customers: np.ndarray, sweep: int) -> np.ndarray:
        others = np.full(len(code), float(max(self.before - 1, 0)))
        return seat(code, customers, others, np.full(len(code), 1.0 / (self.words + 1)), self.strength, self.discount, sweep, 0)

    def share(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability of words in the root; an unknown word has no customer."""
        fresh = (self.strength + self.discount * self.tables) / (self.words + 1)
        return (customers - self.discount * tables + fresh) / (self.strength + self.customers)


# ---- chunks

_CHUNK = "chunk long, ids array<{kind}>, held array<boolean>, sizes binary, tokens binary, codes binary, counts binary, distinct_words long, n long"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    free_memory()
    number, parts, size = TaskContext.get().partitionId() << 32, [], 0

    def row() -> pa.RecordBatch:
        words = np.concatenate([p[2] for p in parts])
        count = np.concatenate([p[3] for p in parts])
        ids, held = pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts])
        tokens = np.insert(words, np.cumsum(count), U64(END))
        codes, place = np.unique(np.append(tokens, U64(START)), return_inverse=True)
        train = np.repeat(~held.to_numpy(zero_copy_only=False), count + 1)
        seen = np.bincount(place[:-1][train], minlength=len(codes))
        ends = pa.array([0, len(ids)], pa.int32())
        return pa.record_batch({
            "chunk": pa.array([number]), "ids": pa.ListArray.from_arrays(ends, ids), "held": pa.ListArray.from_arrays(ends, held),
            "sizes": pa.array([_pack(count + 1, "<i4")], pa.binary()), "tokens": pa.array([_pack(place[:-1], "<i4")], pa.binary()),
            "codes": pa.array([_pack_codes(codes)], pa.binary()), "counts": pa.array([_pack(seen)], pa.binary()), "distinct_words": pa.array([len(codes)]), "n": pa.array([len(tokens)])})

    for batch in sliced(batches, "text"):
        words = words_of(batch.column("text"), blank_words(), lower=True)
        parts.append((batch.column("id"), batch.column("held"), words.code, words.counts))
        size += len(words.data)
        if size >= CHUNK_BYTES:
            yield row()
            number, parts, size = number + 1, [], 0
    if parts:
        yield row()


def _pair_key(codes: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((mix(codes) * U64(0x9E3779B97F4A7C15))[before] + codes[word])


@dataclass
class _Texts:
    """Tokens of a chunk and its distinct word pairs."""

    codes: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    before: np.ndarray = field(init=False)      # word numbers of every pair
    word: np.ndarray = field(init=False)
    pair: np.ndarray = field(init=False)        # the pair of every token
    key: np.ndarray = field(init=False)         # of every pair, ascending

    def __post_init__(self):
        before = np.concatenate(([0], self.tokens[:-1])).astype(np.int32)
        before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.codes, U64(START))
        key = _pair_key(self.codes, before, self.tokens)
        order = np.argsort(key)
        key = key[order]
        opens = np.concatenate(([True], key[1:] != key[:-1]))
        self.pair = np.empty(len(key), np.int32)
        self.pair[order] = np.cumsum(opens) - 1
        first = order[opens]
        self.before, self.word, self.key = before[first], self.tokens[first], key[opens]

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> _Texts:
        return cls(_unpack_codes(batch.column("codes")[i].as_py()), _unpack(batch.column("sizes")[i].as_py(), "<i4").astype(np.int64),
                   _unpack(batch.column("tokens")[i].as_py(), "<i4"))


# ---- sums over all chunks by key

_SENT = "chunk long, part long, keys binary, sums array<binary>"


def _parts_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: ranges of its upper half, so that ascending keys stand by part and no sort is needed."""
    return ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _least(part: int, parts: int) -> int:
    """The smallest key of a part."""
    return -(-(part << 32) // parts) << 32


def _parcels(chunk: int, key: np.ndarray, values: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Ascending keys and their values, cut into parts; keys go as steps from one to the next, whose upper bytes are zeros."""
    names, at = np.unique(_parts_of(key, parts), return_index=True)
    border = [*at.tolist(), len(key)]
    pieces = [slice(a, b) for a, b in zip(border, border[1:])]
    return pa.record_batch({"chunk": pa.array(np.full(len(names), chunk)), "part": pa.array(names),
                            "keys": pa.array([_pack(np.diff(key[p], prepend=U64(_least(n, parts))), "<u8") for n, p in zip(names.tolist(), pieces)], pa.binary()),
                            "sums": pa.array([[_pack(v[p]) for v in values] for p in pieces], pa.list_(pa.binary()))})


def _summed(parts: int, root: Root | None, sweep: int):
    """The sums of one part, back to each of its chunks; its totals stand in one row."""
    def run(table: pa.Table) -> pa.Table:
        free_memory()
        table = table.sort_by("chunk").combine_chunks()
        least = U64(_least(table.column("part")[0].as_py(), parts))
        keys = [np.cumsum(_unpack(x.as_py(), "<u8"), dtype=U64) for x in table.column("keys")]
        size = np.array([len(k) for k in keys])
        key = np.concatenate(keys) + least
        del keys
        order = np.argsort(key, kind="stable")
        opens = np.concatenate(([True], np.diff(key[order]) != 0))
        group = np.empty(len(key), np.int32)
        group[order] = np.cumsum(opens) - 1
        own = np.zeros(len(key), bool)
        own[order[opens]] = True
        total = []
        for v in range(len(table.column("sums")[0])):
            values = np.concatenate([_unpack(x[v].as_py()) for x in table.column("sums")])
            total.append(np.add.reduceat(values[order], np.flatnonzero(opens)))
            del values
        customers, seats = total[-1], 0
        if root:                                           # seated here, once for all chunks
            total.append(root.seated(key[order[opens]], customers, sweep).astype(np.int64))
            seats = int(total[-1].sum())
        del key, order, opens
        border = np.concatenate(([0], np.cumsum(size)))
        rows = [slice(a, b) for a, b in zip(border, border[1:])]
        once = np.zeros(len(rows), np.int64)
        once[0] = 1
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"),
                         "own": pa.array([np.packbits(own[r]).tobytes() for r in rows], pa.binary()),
                         "sums": pa.array([[_pack(t[group[r]]) for t in total] for r in rows], pa.list_(pa.binary())),
                         "kinds": pa.array(once * int((total[0] > 0).sum())), "total": pa.array(once * int(total[0].sum())),
                         "ones": pa.array(once * int((total[0] == 1).sum())), "twos": pa.array(once * int((total[0] == 2).sum())),
                         "customers": pa.array(once * int(customers.sum())), "seats": pa.array(once * seats)})
    return run


def _returned(batch: pa.RecordBatch, i: int, name: str) -> tuple[list[np.ndarray], np.ndarray]:
    """(sums of every key, whether the chunk owns it), keys ascending, from the parts that came back to a chunk."""
    rows = sorted(batch.column(name)[i].as_py(), key=lambda r: r["part"])
    sums = [np.concatenate([_unpack(r["sums"][v]) for r in rows]) for v in range(len(rows[0]["sums"]))]
    own = np.concatenate([np.unpackbits(np.frombuffer(r["own"], np.uint8), count=_count(r["sums"][0])) for r in rows]).astype(bool)
    return sums, own


def _of_sweeps(batch: pa.RecordBatch, i: int, sweeps: int) -> Iterator[list[np.ndarray]]:
    """(customers and open tables of every context, customers and tables in the root) after each sweep.

    The customers of a context never change, so only the first sweep brings them.
    """
    context: list[np.ndarray] = []
    for s in range(sweeps):
        sums, _ = _returned(batch, i, f"r{s}")
        context = context or sums[:1]
        yield context + sums[-3:]


class _Model:
    """The steps over one table of texts."""

    def __init__(self, docs: DataFrame, kind: str, strength: float):
        self.spark, self.strength, self.tables = docs.sparkSession, strength, []
        self.buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.chunks = self.bucketed(docs.mapInArrow(_chunked, _CHUNK.format(kind=kind)))
        sizes = self.chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("chunks"),
                                F.coalesce(F.sum("distinct_words"), F.lit(0)).alias("words")).first()
        self.empty = not sizes["chunks"]
        self.word_parts = max(1, -(-sizes["words"] // PART_KEYS))
        self.pair_parts = max(1, -(-sizes["n"] // PART_KEYS))

    def bucketed(self, df: DataFrame) -> DataFrame:
        """Write rows by chunk, so that joins on it need no exchange of them."""
        name = f"chunks_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        df.write.bucketBy(self.buckets, "chunk").option("path", path).format("parquet").saveAsTable(name)
        self.tables.append((name, path))
        return self.spark.table(name)

    def drop(self, *names: str) -> None:
        """Drop the tables of these names, or all."""
        for name, path in self.tables:
            if not names or name in names:
                self.spark.sql(f"DROP TABLE {name}")
                delete(self.spark, path)
        self.tables = [t for t in self.tables if names and t[0] not in names]

    def trip(self, sent: DataFrame, parts: int, root: Root | None = None, sweep: int = 0) -> tuple[DataFrame, dict[str, int]]:
        """(rows (chunk, back) with the parts of every chunk, totals over all keys)."""
        drop_old_shuffles(self.spark)                       # those of the round trip before, which nobody holds by now
        names = ["kinds", "total", "ones", "twos", "customers", "seats"]
        rows = sent.groupBy("part").applyInArrow(_summed(parts, root, sweep), "chunk long, part long, own binary, sums array<binary>, "
                                                 + ", ".join(f"{c} long" for c in names))
        back = self.bucketed(rows.groupBy("chunk").agg(F.collect_list(F.struct("part", "own", "sums")).alias("back"),
                                                       *[F.sum(c).alias(c) for c in names]))
        totals = back.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first().asDict()
        drop_old_shuffles(self.spark)
        return back.select("chunk", "back"), totals

    def words(self) -> tuple[DataFrame, dict[str, int]]:
        parts = self.word_parts

        def send(batches):
            free_memory()
            for batch in batches:
                for i in range(batch.num_rows):
                    yield _parcels(batch.column("chunk")[i].as_py(), _unpack_codes(batch.column("codes")[i].as_py()),
                                   [_unpack(batch.column("counts")[i].as_py())], parts)
        return self.trip(self.chunks.select("chunk", "codes", "counts").mapInArrow(send, _SENT), parts)

    def pairs(self) -> tuple[DataFrame, dict[str, int]]:
        parts = self.pair_parts

        def send(batches):
            free_memory()
            for batch in batches:
                for i in range(batch.num_rows):
                    texts = _Texts.of(batch, i)
                    train = np.repeat(~batch.column("held")[i].values.to_numpy(zero_copy_only=False), texts.sizes)
                    count = np.bincount(texts.pair[train], minlength=len(texts.key))
                    yield _parcels(batch.column("chunk")[i].as_py(), texts.key, [count], parts)
        return self.trip(self.chunks.mapInArrow(send, _SENT), parts)

    def owned(self, pairs: DataFrame) -> DataFrame:
        """Of every chunk the pairs it owns: those with two customers or more, and sums of the others."""
        def run(batches):
            free_memory()
            for batch in batches:
                for i in range(batch.num_rows):
                    texts = _Texts.of(batch, i)
                    (count,), own = _returned(batch, i, "back")
                    n = len(texts.codes)
                    one, more = np.flatnonzero(own & (count == 1)), np.flatnonzero(own & (count > 1))
                    yield pa.record_batch({
                        "chunk": batch.column("chunk").slice(i, 1),
                        "before": pa.array([_pack(texts.before[more], "<i4")], pa.binary()), "word": pa.array([_pack(texts.word[more], "<i4")], pa.binary()),
                        "count": pa.array([_pack(count[more])], pa.binary()),
                        "one_before": pa.array([_pack(np.bincount(texts.before[one], minlength=n))], pa.binary()),
                        "one_word": pa.array([_pack(np.bincount(texts.word[one], minlength=n))], pa.binary())})
        return self.bucketed(self.chunks.join(pairs, "chunk").mapInArrow(
            run, "chunk long, before binary, word binary, count binary, one_before binary, one_word binary"))

    def sweep(self, owned: DataFrame, rounds: list[DataFrame], roots: list[Root], next_root: Root, discount: float) -> tuple[DataFrame, dict[str, int]]:
        """Seat all pairs anew and sum tables of every context and customers of the root; at first also customers of contexts."""
        parts, strength = self.word_parts, self.strength

        def send(batches):
            free_memory()
            for batch in batches:
                for i in range(batch.num_rows):
                    codes = _unpack_codes(batch.column("codes")[i].as_py())
                    before, word = (_unpack(batch.column(c)[i].as_py(), "<i4") for c in ("before", "word"))
                    count = _unpack(batch.column("count")[i].as_py())
                    key = _pair_key(codes, before, word)
                    tables = np.ones(len(key))
                    for s, (root, (_, open_tables, *words)) in enumerate(zip(roots, _of_sweeps(batch, i, len(roots)))):
                        tables = _reseated(key, before, word, count, tables, open_tables, root.share(*words), strength, discount, s)
                    n = len(codes)
                    one_before, one_word = (_unpack(batch.column(c)[i].as_py()) for c in ("one_before", "one_word"))
                    sums = [one_before + np.bincount(before, tables, n).astype(np.int64), one_word + np.bincount(word, tables, n).astype(np.int64)]
                    if not roots:
                        sums.insert(0, one_before + np.bincount(before, count, n).astype(np.int64))
                    yield _parcels(batch.column("chunk")[i].as_py(), codes, sums, parts)

        rows = owned.join(self.chunks.select("chunk", "codes"), "chunk")
        for s, back in enumerate(rounds):
            rows = rows.join(back.withColumnRenamed("back", f"r{s}"), "chunk")
        return self.trip(rows.mapInArrow(send, _SENT), parts, next_root, len(roots))


def _reseated(key, before, word, count, tables, open_tables, share, strength, discount, s) -> np.ndarray:
    """Tables of pairs after one more sweep, from the sums that the sweep before left."""
    others = np.maximum(open_tables[before] - tables, 0)
    return seat(key, count, others, share[word], strength, discount, s, 1)


def _scores(roots: list[Root], burn: int, known: int, total: int, strength: float, discount: float):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                free_memory()
                texts = _Texts.of(batch, i)
                (seen,), _ = _returned(batch, i, "words")
                (count,), _ = _returned(batch, i, "pairs")
                tables, mean = np.minimum(count, 1).astype(np.float64), np.zeros(len(count))
                for s, (root, (context, open_tables, *words)) in enumerate(zip(roots, _of_sweeps(batch, i, len(roots)))):
                    share = root.share(*words)
                    if s >= burn:
                        mean += ((count - discount * tables + (strength + discount * open_tables[texts.before]) * share[texts.word])
                                 / (strength + context[texts.before]))
                    if s + 1 < len(roots):
                        tables = _reseated(texts.key, texts.before, texts.word, count, tables, open_tables, share, strength, discount, s)
                log = np.log10(mean / (len(roots) - burn))[texts.pair]
                base = np.log10((seen + 1) / (total + known + 1))[texts.tokens]
                at = np.cumsum(texts.sizes) - texts.sizes
                yield pa.record_batch({
                    "id": batch.column("ids")[i].values, "held_out": batch.column("held")[i].values, "n_tokens": pa.array(texts.sizes),
                    "n_known": pa.array(np.add.reduceat((seen > 0)[texts.tokens].astype(np.int64), at)),
                    "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(log, at))})
    return run


def score_texts(docs: DataFrame, held_out: Column, sweeps: int = 2, burn: int = 1, strength: float = 1.0,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words `[^\\x20\\x09-\\x0D]+` of the whole text, A-Z lower-cased, then one end. The model
    learns from the rows where `held_out` is not true. score is the log10 probability of all tokens, each
    after the one before it, averaged over the sweeps from `burn` on (0 is the seating with one table a dish);
    base_score that of single words with one added to every count. The discounts come from the numbers of
    words and pairs met once and twice; `strength` is that of every restaurant. Words and pairs are compared
    by 64-bit fingerprints. Tables of dishes of over
    256 customers are drawn from a saddle-point approximation.

    Null or blank text: one token, the end. Null `held_out`: learnt from. Null ids and repeated rows: rows like
    all others, each counts. No row to learn from: all probabilities are 1. Empty table: empty result. Other
    columns are ignored.
    """
    if not 0 <= burn <= sweeps:
        raise ValueError("burn must be at most the number of sweeps")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    model = _Model(texts, kind, strength)
    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    names = [F.col("id").alias(id_col), "held_out", "n_tokens", "n_known"]
    words, seen = model.words()
    pairs, met = model.pairs()

    def share(x: dict[str, int]) -> float:
        return min(max(x["ones"] / max(x["ones"] + 2 * x["twos"], 1), 0.05), 0.95)

    discount = share(met)
    owned = model.owned(pairs)
    rounds, roots = [], []
    for _ in range(sweeps + 1):
        root = Root(seen["kinds"], strength, share(seen), roots[-1].tables if roots else seen["kinds"])
        back, totals = model.sweep(owned, rounds, roots, root, discount)
        rounds.append(back)
        roots.append(replace(root, customers=totals["customers"], tables=totals["seats"]))
    model.drop(model.tables[3][0])      # the pairs owned: all sweeps are done
    rows = model.chunks.join(words.withColumnRenamed("back", "words"), "chunk").join(pairs.withColumnRenamed("back", "pairs"), "chunk")
    for s, back in enumerate(rounds):
        rows = rows.join(back.withColumnRenamed("back", f"r{s}"), "chunk")
    run = _scores(roots, burn, seen["kinds"], seen["total"], strength, discount)
    scored = cut(rows.mapInArrow(run, out))
    model.drop()
    return scored.select(*names, F.lit(seen["total"]).cast("long").alias("train_tokens"), "base_score", "score")
