"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton holds every word sequence of every item. A document's words are fed through it; the
longest item sequence that ends at each word is tracked, and a window of items (`window` words, or a
whole shorter item) that ends there marks its words. Words and pairs that no item has are known
before, in whole batches; the automaton walks only the stretches between them.

The automaton goes to the tasks as a broadcast, so its size is bounded: items are dealt into parts of
at most `part_words` words by their running total, one automaton and one pass over the documents per
part. Only items, never documents, come to the driver, one part at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.base import NULL_ID, free_memory, id_key, sliced
from recordloom.llm.bytewords import U64, Words, alnum_words, buffer_of, mix, words_of
from recordloom.session import cut

#: Words of items in one automaton; each takes about 1 kB in a task.
PART_WORDS = 200_000


class Automaton:
    """States of a generalised suffix automaton: transitions, suffix link, longest length."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: per state: (window words, items that have the window that ends there)
        self.ends: dict[int, list[tuple[int, set[int]]]] = {}
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for item, words in items:
            width = min(window, len(words))
            for at in range(len(words) - width + 1):
                self._report(item, words[at:at + width])
        # reports that a state inherits from its suffixes
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.all: dict[int, list[tuple[int, set[int]]]] = {}
        for state in order:
            own = self.ends.get(state, []) + self.all.get(self.link[state], [])
            if own:
                self.all[state] = own
        self.walked = sorted({len(w) and min(window, len(w)) for _, w in items} - {0})

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            to = self.next[last][word]
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, word, to)
        state = self._state(self.length[last] + 1)
        while last != -1 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last == -1:
            self.link[state] = 0
        else:
            to = self.next[last][word]
            self.link[state] = to if self.length[to] == self.length[last] + 1 else self._clone(last, word, to)
        return state

    def _clone(self, last: int, word: int, to: int) -> int:
        twin = self._state(self.length[last] + 1)
        self.next[twin] = dict(self.next[to])
        self.link[twin], self.link[to] = self.link[to], twin
        while last != -1 and self.next[last].get(word) == to:
            self.next[last][word] = twin
            last = self.link[last]
        return twin

    def _report(self, item: int, window: list[int]) -> None:
        state = 0
        for word in window:
            state = self.next[state][word]
        for width, found in self.ends.setdefault(state, []):
            if width == len(window):
                found.add(item)
                return
        self.ends[state].append((len(window), {item}))

    def walk(self, words: list[int]) -> Iterator[tuple[int, int, list[tuple[int, set[int]]]]]:
        """For each word: (longest item sequence that ends there, its length, reports of windows)."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            reports = [(width, found) for width, found in self.all.get(state, ()) if width <= length]
            yield state, length, reports


def _marks(words: Words, machine: Automaton, single: np.ndarray, pairs: np.ndarray, shortest: int):
    """(covered words, [(row, items)], longest match per row) of a batch."""
    count = len(words.code)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts)
    cover = np.zeros(count + 1, np.int64)
    longest = np.zeros(len(words.first) - 1, np.int64)
    found: dict[int, set[int]] = {}
    known = _among(words.code, single)
    inside = known.copy()
    if shortest > 1:                        # a match of two words or more is made of known pairs
        joined = np.zeros(count, bool)
        at = np.flatnonzero(known[:-1] & known[1:] & (owner[:-1] == owner[1:]))
        joined[at] = _among(_pair(words.code[at], words.code[at + 1]), pairs)
        inside = joined.copy()
        inside[1:] |= joined[:-1]
        breaks = ~joined[:-1]
    else:
        breaks = np.ones(max(count - 1, 0), bool)
        breaks &= ~(known[:-1] & known[1:] & (owner[:-1] == owner[1:]))
    if count:
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | breaks
        start = np.flatnonzero(opens)
        group = np.cumsum(opens) - 1
        end = np.zeros(len(start), np.int64)
        np.maximum.at(end, group[inside], np.flatnonzero(inside) + 1)
        long = end - start >= shortest
        for a, b in zip(start[long].tolist(), end[long].tolist()):
            row = int(owner[a])
            for i, (_, length, reports) in enumerate(machine.walk(words.code[a:b].tolist()), a + 1):
                longest[row] = max(longest[row], length)
                for width, items in reports:
                    cover[i - width] += 1
                    cover[i] -= 1
                    found.setdefault(row, set()).update(items)
    return np.cumsum(cover)[:-1] > 0, found, longest


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(3) + mix(b))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ordered array; most are ruled out by their low bits."""
    hit = np.zeros(len(values), bool)
    if not len(ordered) or not len(values):
        return hit
    low = np.zeros(1 << 16, bool)
    low[(ordered & U64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(low[(values & U64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(ordered, values[at]), len(ordered) - 1)
    hit[at] = ordered[place] == values[at]
    return hit


def _parts(benchmark: DataFrame, item_col: str, text_col: str, part_words: int) -> Iterator[list[tuple[int, list[int]]]]:
    """Items as fingerprints, in parts of bounded size, read one after another."""
    def run(batches):
        for batch in sliced(batches, "text"):
            words = words_of(batch.column("text"), alnum_words(), lower=True)
            yield pa.record_batch({"item": batch.column("item"), "n": pa.array(words.counts),
                                   "codes": pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)),
                                                                     pa.array(words.code.view(np.int64)))})

    items = (benchmark.select(id_key(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
             .mapInArrow(run, "item long, n long, codes array<long>").where("n > 0"))
    total = items.agg(F.sum("n").alias("n")).first()["n"] or 0
    count = max(1, -(-total // part_words))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "codes"), F.lit(count)))
    for part in range(count):
        rows = dealt.where(F.col("part") == part).collect() if count > 1 else items.collect()
        if rows:
            yield [(r["item"], np.array(r["codes"], np.int64).view(U64).tolist()) for r in rows]


def _spans(cover: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of every covered stretch, counted inside its row."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge = np.ones(len(cover), bool)
    edge[1:] = (cover[1:] != cover[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(cover))
    keep = cover[at]
    row = owner[at[keep]]
    return row, at[keep] - first[row], end[keep] - first[row]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text",
                       part_words: int = PART_WORDS) -> DataFrame:
    """Add to every row of `docs`: _words, _spans (covered word ranges [from, to), flat), _items (ids
    of the items that have a window there), _longest (longest item sequence in the text) and _cleaned
    (the text without the bytes from the first to the last word of each span; null without a span).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null text: no words. Items
    without words have no windows; several rows with one item id are one item. Windows of items with null
    id are covered like all others, and their id is not listed. Empty benchmark: nothing is marked. The other columns of `docs` come back in the struct `row` and the text
    in `text`, so their names can't clash with the new ones.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*rest or [F.lit(None).alias("_none")]).alias("row"),
                         F.col(f"`{text_col}`").cast("string").alias("text"),
                         F.lit(0).cast("long").alias("_words"), F.array().cast("array<long>").alias("_spans"),
                         F.array().cast("array<long>").alias("_items"), F.lit(0).cast("long").alias("_longest"),
                         F.lit(None).cast("string").alias("_cleaned"))
    schema = packed.schema
    sc = docs.sparkSession.sparkContext

    def one_pass(machine_of):
        def run(batches):
            free_memory()
            machine, single, pairs, shortest = machine_of.value
            for batch in sliced(batches, "text"):
                words = words_of(batch.column("text"), alnum_words(), lower=True)
                cover, found, longest = _marks(words, machine, single, pairs, shortest)
                row, a, b = _spans(cover, words.first)
                spans, items, cleaned = (batch.column(c).to_pylist() for c in ("_spans", "_items", "_cleaned"))
                for r, span in zip(row.tolist(), np.stack((a, b), axis=1).tolist()):
                    spans[r] = spans[r] + span
                for r, more in found.items():
                    items[r] = items[r] + sorted(more - {NULL_ID})
                raw, border = buffer_of(batch.column("text"))
                for r in np.unique(row).tolist():
                    cleaned[r] = _without(raw, border[r], border[r + 1], words, int(words.first[r]), spans[r])
                before = batch.column("_longest").to_numpy(zero_copy_only=False)
                out = {"row": batch.column("row"), "text": batch.column("text"), "_words": pa.array(words.counts),
                       "_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.int64())),
                       "_longest": pa.array(np.maximum(before, longest)), "_cleaned": pa.array(cleaned, pa.string())}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        return run

    marked, passed = packed, 0
    for items in _or_none(_parts(benchmark, item_id, item_text, part_words)):     # one part at a time
        codes = [np.array(words, U64) for _, words in items]
        single = np.unique(np.concatenate([np.zeros(0, U64), *codes]))
        pairs = np.unique(np.concatenate([np.zeros(0, U64), *(_pair(c[:-1], c[1:]) for c in codes)]))
        shortest = min((min(window, len(words)) for _, words in items), default=window)
        # a worker per pass would be alive at once; passes after the first read what is written
        marked = (cut(marked) if passed else marked).mapInArrow(
            one_pass(sc.broadcast((Automaton(items, window), single, pairs, shortest))), schema)
        passed += 1
    return marked


def _or_none(parts: Iterator[list]) -> Iterator[list]:
    """The parts, or one without items."""
    empty = True
    for part in parts:
        empty = False
        yield part
    if empty:
        yield []


def _without(raw: np.ndarray, begin: int, end: int, words: Words, first: int, spans: list[int]) -> str:
    """A text without the bytes of its covered spans."""
    keep = np.ones(end - begin, bool)
    for a, b in zip(spans[::2], spans[1::2]):
        keep[int(words.start[first + a]) - begin:int(words.end[first + b - 1]) - begin] = False
    return raw[begin:end][keep].tobytes().decode()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", **names) -> DataFrame:
    """Digest per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated, longest.

    items_sha256 is over the distinct item ids, sorted as strings and joined by commas. Rules for
    nulls, repeats and empty tables are those of `mark_contamination`.
    """
    marked = mark_contamination(docs.select(id_col, text_col), benchmark, window, text_col, **names)
    items = F.array_join(F.array_sort(F.transform(F.array_distinct("_items"), lambda x: x.cast("string"))), ",")
    return marked.select(F.col(f"row.{id_col}").alias(id_col), F.col("_words").alias("n_words"),
                         covered_words(F.col("_spans")).alias("n_hit"),
                         F.size(F.array_distinct("_items")).cast("long").alias("n_items"),
                         F.sha2(items, 256).alias("items_sha256"),
                         (F.size("_spans") > 0).alias("contaminated"), F.col("_longest").alias("longest"))


def covered_words(spans):
    """Words covered by flat ranges [from, to) that may overlap (those of several parts)."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int") - 1),
                                     lambda i: F.struct(F.get(spans, i * 2).alias("a"), F.get(spans, i * 2 + 1).alias("b"))))
    done = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
                       lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], acc["to"]))).alias("n"),
                                               F.greatest(acc["to"], x["b"]).alias("to")))["n"]
    return F.when(F.size(spans) > 0, done).otherwise(F.lit(0).cast("long"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int | None = None,
                         max_coverage: float | None = 0.5, text_col: str = "text", **names) -> DataFrame:
    """Take every covered span out of the texts; drop documents that are mostly test items.

    A document goes if more than `max_coverage` of its words, or more than `max_words` words, are
    covered. Others lose the bytes from the first to the last word of each covered span; what stands
    around it stays. Columns and their order stay; n_chars, if there, is the new length. A row
    without a covered word is returned unchanged. Rules for nulls and empty tables are those of
    `mark_contamination`.
    """
    columns = docs.columns
    kinds = dict(docs.dtypes)
    marked = mark_contamination(docs, benchmark, window, text_col, **names)
    hit = covered_words(F.col("_spans"))
    over = F.lit(False)
    if max_coverage is not None:
        over = over | (hit > F.col("_words") * max_coverage)
    if max_words is not None:
        over = over | (hit > max_words)
    left = F.coalesce("_cleaned", "text")

    def column(name):
        if name == text_col:
            return left.cast(kinds[name]).alias(name)
        if name == "n_chars":
            return F.when(F.col("_cleaned").isNotNull(), F.length(left)).otherwise(F.col("row.n_chars")).cast(kinds[name]).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return marked.where((F.size("_spans") == 0) | ~over).select(*[column(c) for c in columns])
