"""Removal of long word sequences that occur earlier in the corpus, found by recompression.

Every text is parsed in rounds. A round first names maximal runs of one symbol, then names pairs:
each symbol gets a side from its name, and a left symbol followed by a right one becomes one new
symbol. Names are fingerprints of what they stand for, so equal content gets equal names in every
task, and no round needs a shared dictionary. A symbol depends on its own words and on a few words
around it only, so two equal word sequences have the same interior symbols.

1. The least interior symbol of every window is an anchor; its name together with the words that
   all its windows share is its key. Keys that two documents have reveal windows that may repeat.
2. Only such windows are named in full. One aggregation gives the first document of each.
3. A window goes if its name began earlier in the same document or in an earlier document.

Steps 1 and 2 aggregate before they shuffle; no list of the documents that share a passage is ever
built, so a passage that a third of all documents contain is one row per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.base import id_key, in_slices, lists_of
from recordloom.llm.bytewords import U64, Words, blank_words, mix, windows, words_of
from recordloom.session import cut

#: Words to the left and right of a symbol's first word that its name can depend on, after two rounds.
_LEFT, _RIGHT = 3, 5
_NONE = np.uint64(2**64 - 1)
_KEY_BITS = 16
_FAR = 1 << 40


def symbols(code: np.ndarray, owner: np.ndarray, rounds: int = 2):
    """(first word, end, name, left end of its context, right end of its context) of every symbol."""
    n = len(code)
    first, end, name = np.arange(n), np.arange(1, n + 1), mix(code)
    left, right = first.copy(), end.copy()
    own = owner
    for level in range(rounds):
        if not len(name):
            break
        # maximal runs of one symbol inside one text
        opens = np.ones(len(name), dtype=bool)
        opens[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(opens)
        size = np.diff(np.append(at, len(name)))
        last = at + size - 1
        # the symbols on both sides show that a run is maximal; at the ends of a text nothing does
        before, after = np.maximum(at - 1, 0), np.minimum(last + 1, len(name) - 1)
        opening = (at == 0) | (own[before] != own[at])
        closing = (last == len(name) - 1) | (own[after] != own[last])
        left, right = (np.where(opening, -_FAR, np.minimum(left[at], left[before])),
                       np.where(closing, _FAR, np.maximum(right[last], right[after])))
        base, own, first, end = name[at], own[at], first[at], end[last]
        name = np.where(size > 1, mix(base + size.astype(U64) * U64(0x9FB21C651E98DF25)), base)
        # pairs: sides follow from the repeated symbol, so a cut run has the side of the whole
        side = (mix(base + U64(level + 1)) >> U64(63)).astype(bool)
        joins = np.zeros(len(name), dtype=bool)
        joins[:-1] = ~side[:-1] & side[1:] & (own[:-1] == own[1:])
        head = np.flatnonzero(joins)
        name[head] = mix(name[head] * U64(3) + mix(name[head + 1]) + U64(level))
        end[head] = end[head + 1]
        # the side of a neighbour decides whether a symbol stays alone
        wide_l, wide_r = left.copy(), right.copy()
        wide_r[:-1] = np.maximum(wide_r[:-1], np.where(~side[:-1], right[1:], wide_r[:-1]))
        wide_l[1:] = np.minimum(wide_l[1:], np.where(side[1:], left[:-1], wide_l[1:]))
        wide_l[head], wide_r[head] = left[head], right[head + 1]
        keep = np.ones(len(name), dtype=bool)
        keep[head + 1] = False
        first, end, name, own = first[keep], end[keep], name[keep], own[keep]
        left, right = wide_l[keep], wide_r[keep]
    return first, end, name, left, right


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over values[i:i + width] for each i; the array shrinks by width - 1."""
    out, span = values, 1
    while span * 2 <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[:len(values) - width + 1], out[width - span:len(values) - span + 1]) if span < width else out


class Anchors:
    """The anchors of all windows of a batch, as priorities on word positions."""

    def __init__(self, words: Words, window: int):
        n = len(words.code)
        self.window, self.n = window, n
        self.owner = np.repeat(np.arange(len(words.first) - 1), words.counts)
        self.empty = n < window
        if self.empty:
            self.key_at, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        first, _, name, left, right = symbols(words.code, self.owner)
        fit = (first - left <= _LEFT) & (right - first <= _RIGHT)
        self.rank = np.full(n, _NONE)
        self.rank[first[fit]] = np.minimum(mix(name[fit]), _NONE - U64(1))
        count = n - window + 1
        self.valid = self.owner[:count] == self.owner[window - 1:]
        self.least = self._least(self.rank)
        # a position is an anchor if it is the least of one of its windows
        least = np.where(self.valid, self.least, U64(0))
        span = window - _RIGHT - _LEFT + 1
        padded = np.concatenate((np.zeros(window, U64), least, np.zeros(window, U64)))
        # windows whose range holds position a begin at a - (window - _RIGHT) .. a - _LEFT
        tops = _slide(padded, span, np.maximum)
        a = np.arange(n)
        chosen = (tops[a - (window - _RIGHT) + window] == self.rank) & (self.rank != _NONE)
        at = np.flatnonzero(chosen)
        # windows without a symbol of their own stand for themselves
        self.bare = self.valid & (self.least == _NONE)
        lone = np.flatnonzero(self.bare)
        width = _LEFT + _RIGHT
        _, name8 = self._named(words, width)
        own = (mix(name8[at - _LEFT] + mix(self.rank[at])) >> U64(_KEY_BITS)).astype(np.int64)
        bare = (mix(name8[lone] + U64(7)) >> U64(_KEY_BITS)).astype(np.int64)
        self.at, self.lone = at, lone
        self.key_at = np.concatenate((at, lone))
        self.key = np.concatenate((own, bare))

    def _named(self, words: Words, width: int):
        at, value = windows(words.code, words.first, width)
        full = np.zeros(self.n, U64)
        full[at] = value
        return at, full

    def _least(self, rank: np.ndarray) -> np.ndarray:
        """For each window: the least rank on positions _LEFT .. window - _RIGHT."""
        span = self.window - _RIGHT - _LEFT + 1
        return _slide(rank, span, np.minimum)[_LEFT:_LEFT + self.n - self.window + 1]

    def candidates(self, known: np.ndarray) -> np.ndarray:
        """Windows one of whose anchors is `known` (flags along key_at)."""
        marked = np.where(np.isin(np.arange(self.n), self.at[known[:len(self.at)]], assume_unique=True),
                          self.rank, _NONE)
        hit = self.valid & (self.least != _NONE) & (self._least(marked) == self.least)
        hit[self.lone[known[len(self.at):]]] = True
        return np.flatnonzero(hit)


def _pairs(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number for (row of the batch, value)."""
    return mix(value.astype(U64) ^ mix(owner.astype(U64) + U64(1)))


def _anchor_rows(window: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(batch.column("text"), blank_words())
        found = Anchors(words, window)
        key, row = found.key, found.owner[found.key_at] if not found.empty else found.key
        _, once = np.unique(_pairs(row, key), return_index=True)
        ids = batch.column("k").to_numpy(zero_copy_only=False)
        return pa.record_batch({"key": pa.array(key[once]), "k": pa.array(ids[row[once]].astype(np.int64))})
    return in_slices(run, "text")


def _revealed(batch: pa.RecordBatch, window: int):
    """(words, window positions with a key that other documents have, ones with a key met twice here)."""
    words = words_of(batch.column("text"), blank_words())
    found = Anchors(words, window)
    if found.empty:
        none = np.zeros(0, np.int64)
        return words, found, none, none
    row = found.owner[found.key_at]
    mine = _pairs(row, found.key)
    shared = np.isin(mine, _pairs(*lists_of(batch.column("keys"))))
    _, back, times = np.unique(mine, return_inverse=True, return_counts=True)
    return words, found, found.candidates(shared), found.candidates(times[back] > 1)


def _window_rows(window: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, found, shared, _ = _revealed(batch, window)
        if not len(shared):
            return None
        at, name = windows(words.code, words.first, window)
        name = name[np.searchsorted(at, shared)]
        row = found.owner[shared]
        _, once = np.unique(_pairs(row, name), return_index=True)
        ids = batch.column("k").to_numpy(zero_copy_only=False)
        return pa.record_batch({"name": pa.array(name[once].view(np.int64)),
                                "k": pa.array(ids[row[once]].astype(np.int64))})
    return in_slices(run, "text")


def _gather(words: Words, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the picked words, one blank after each; end of each word in them)."""
    start, size = words.start[picked], words.end[picked] - words.start[picked] + 1
    total = np.concatenate(([0], np.cumsum(size)))
    if not total[-1]:
        return np.zeros(0, np.uint8), total[1:]
    source = np.arange(total[-1]) + np.repeat(start - total[:-1], size)
    padded = np.append(words.data, np.uint8(0x20))
    out = padded[np.minimum(source, len(words.data))]
    out[total[1:] - 1] = 0x20
    return out, total[1:]


def _result(window: int, with_text: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, found, shared, local = _revealed(batch, window)
        gone = np.zeros(len(words.code) + 1, dtype=np.int64)
        both = np.union1d(shared, local)
        if len(both):
            at, name = windows(words.code, words.first, window)
            name = name[np.searchsorted(at, both)]
            row = found.owner[both]
            pair = _pairs(row, name)
            _, once = np.unique(pair, return_index=True)       # the first of each name in its text
            again = np.ones(len(both), dtype=bool)
            again[once] = False
            earlier = np.isin(both, shared, assume_unique=True) & ~np.isin(pair, _pairs(*lists_of(batch.column("firsts"))))
            out = both[again | earlier]
            gone += np.bincount(out, minlength=len(gone))
            gone -= np.bincount(out + window, minlength=len(gone))
        cover = np.cumsum(gone)[:-1] > 0
        picked = np.flatnonzero(~cover)
        data, ends = _gather(words, picked)
        border = np.searchsorted(picked, words.first)
        ends = np.concatenate(([0], ends))[border]
        view = memoryview(data)
        pieces = [view[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]
        out = {name: batch.column(name) for name in batch.schema.names if name not in ("k", "text", "keys", "firsts")}
        out |= {"n_words": pa.array(words.counts), "n_removed": pa.array(words.counts - np.diff(border)),
                "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())}
        if with_text:
            out["kept_text"] = pa.array([bytes(p).decode() for p in pieces], pa.string())
        return pa.record_batch(out)
    return in_slices(run, "text")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                    with_text: bool = True) -> DataFrame:
    """Remove every word that lies in a `window`-word sequence which also starts earlier.

    Earlier means: in a document with a smaller id, or before in the same document. Words are
    `[^\\x20\\x09-\\x0D]+`. Returns one row per row of `docs`: the id, n_words, n_removed,
    kept_sha256 and, with `with_text`, kept_text (kept words joined by one blank). Window names are
    64-bit fingerprints; only windows whose anchor key is shared are compared at all.

    Null or blank text: no words, nothing removed. Null id: the largest id. Rows with one id: none
    removes words from the other, each is judged by itself. Empty table: empty result. Other columns
    of `docs` are ignored. `window` must be at least 9, the reach of an anchor.
    """
    if window < _LEFT + _RIGHT + 1:
        raise ValueError("window must be at least 9 words")
    base = docs.select(F.col(id_col).alias("_id"), id_key(id_col).alias("k"),
                       F.col(text_col).cast("string").alias("text"))
    anchors = base.select("k", "text").mapInArrow(_anchor_rows(window), "key long, k long")
    shared = anchors.groupBy("key").count().where("count > 1").select("key")
    keys = cut(anchors.join(shared, "key", "left_semi").groupBy("k").agg(F.collect_list("key").alias("keys")))
    marked = base.join(keys, "k", "inner").select("k", "text", "keys")
    firsts = (marked.mapInArrow(_window_rows(window), "name long, k long")
              .groupBy("name").agg(F.min("k").alias("k"))
              .groupBy("k").agg(F.collect_list("name").alias("firsts")))
    joined = base.join(keys, "k", "left").join(firsts, "k", "left").select("_id", "k", "text", "keys", "firsts")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_result(window, with_text), schema).withColumnRenamed("_id", id_col)
