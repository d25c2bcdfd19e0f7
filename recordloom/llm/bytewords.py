"""Words of whole Arrow batches as numpy arrays.

A batch of texts is one UTF-8 buffer; word borders, word fingerprints and windows are computed over
that buffer at once, with no loop over texts or words. Delimiters are ASCII bytes, so byte positions
split UTF-8 text correctly. Fingerprints are 64 bits and the same in every task and session.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the window polynomials and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
BASE2 = 0xD1B54A32D192ED03
BASE2_INV = pow(BASE2, -1, 2**64)

_rng = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _rng.integers(0, 2**64, size=64 * 256, dtype=U64)
_FOLD = 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def blank_words() -> np.ndarray:
    """Byte classes of words [^\\x20\\x09-\\x0D]+: True inside a word."""
    inside = np.ones(256, dtype=bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def alnum_words() -> np.ndarray:
    """Byte classes of words of digits, letters and every byte of a non-ASCII character."""
    inside = np.zeros(256, dtype=bool)
    inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside


def lower_map() -> np.ndarray:
    """Byte map that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


@dataclass
class Words:
    """All words of a batch, in order: byte spans, fingerprints, and the word range of each text."""

    data: np.ndarray      # bytes of the batch (after lower-casing, if asked for)
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # one past its last byte
    code: np.ndarray      # 64-bit fingerprint of each word
    first: np.ndarray     # for text i: words first[i] up to first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, inside: np.ndarray, lower: bool = False) -> Words:
    """Words of each text of a string column, by byte class."""
    data, offsets = buffer_of(column)
    if lower:
        data = lower_map()[data]
    n = len(data)
    keep = inside[data]
    opens = np.empty(n + 1, dtype=bool)
    opens[n] = True
    if n:
        opens[0] = True
        opens[1:n] = ~keep[:-1]
        opens[offsets[:-1][offsets[:-1] < n]] = True   # a text begins a new word
        opens[:n] &= keep
    start = np.flatnonzero(opens[:n])
    # a word ends where the next byte is outside, or where the text ends
    closes = np.zeros(n, dtype=bool)
    if n:
        closes[:-1] = ~keep[1:]
        closes[-1] = True
        ends = offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= n)] - 1
        closes[ends] = True
        closes &= keep
    end = np.flatnonzero(closes) + 1
    code = _codes(data, start, end)
    return Words(data, start, end, code, np.searchsorted(start, offsets).astype(np.int64))


#: Bytes whose terms are held at once; a longer text is worked on in several rounds.
_ROUND = 1 << 21


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of words: sums over table entries by byte and place, mixed with the length."""
    code = np.zeros(len(start), dtype=U64)
    total = np.concatenate(([0], np.cumsum(end - start)))
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _ROUND, "right")) - 1)
        code[at:to] = _some_codes(data, start[at:to], end[at:to])
        at = to
    return code


def _some_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    lifted = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(lifted[-1], dtype=np.int64)
    own = np.repeat(start - lifted[:-1], size)
    within = place - np.repeat(lifted[:-1], size)
    terms = _TABLE[((within & 63) << 8) | data[place + own]]
    if int(size.max()) > 64:
        late = np.flatnonzero(within > 63)
        rounds = (within[late] >> 6).astype(U64)
        terms[late] = mix(terms[late] + rounds * U64(_FOLD))
    total = np.add.reduceat(terms, lifted[:-1])
    return mix(total + size.astype(U64))


def windows(code: np.ndarray, first: np.ndarray, width: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(position, fingerprint) of every run of `width` words inside one text."""
    n = len(code)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    base, inverse = (BASE2, BASE2_INV) if second else (BASE, BASE_INV)
    with np.errstate(over="ignore"):
        powers = np.full(n, U64(base), dtype=U64)
        powers[0] = U64(1)
        powers = np.multiply.accumulate(powers)
        backs = np.full(n, U64(inverse), dtype=U64)
        backs[0] = U64(1)
        backs = np.multiply.accumulate(backs)
        values = mix(code ^ U64(0xA5A5A5A5A5A5A5A5)) if second else code
        total = np.concatenate((np.zeros(1, U64), np.add.accumulate(values * powers)))
        sums = (total[width:] - total[:-width]) * backs[:n - width + 1]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[:n - width + 1] == owner[width - 1:])
    return at, mix(sums[at] + U64(width))
