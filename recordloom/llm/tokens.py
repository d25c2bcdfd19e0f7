"""Token ids of whole texts, with every distinct piece of text encoded once per worker.

The tokenizer splits a text before it merges, and never between a visible character and what stands
before it in its blank-separated piece, nor across a blank that follows a visible character. So the
ids of a text are those of its pieces, each with the blank before it, and pieces repeat: they are
encoded by the tokenizers library when first met. Pieces are found in whole batches by fingerprint.
A text in which white space comes before a blank, or that ends in a blank, could be split elsewhere;
it is encoded as a whole, and so is a text that holds the string of a special token.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from recordloom.llm.base import HELD
from recordloom.llm.bytewords import U64, Words, buffer_of, mix, words_of

_ENCODERS: dict[tuple[str, bool], Encoder] = {}
#: Pieces that are encoded in one call.
_CALL = 8192
_NEAR = 1 << 20
_PIECES = np.ones(256, bool)
_PIECES[0x20] = False
_BLANK_BYTES = np.zeros(256, bool)
_BLANK_BYTES[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: White space outside ASCII, as UTF-8.
_WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_LAST = np.zeros(256, bool)
_WIDE_LAST[[w[-1] for w in _WIDE_BLANKS]] = True


class Encoder:
    """One tokenizer file in one worker; at most about `limit` pieces are kept, some 40 bytes each.

    A string of a special token in a text becomes that token, as the library does by default; with
    `special_strings=False` it is ordinary text.
    """

    def __init__(self, path: str, limit: int = 1_000_000, special_strings: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().items()
        special = [(i, t.content) for i, t in added if t.special]
        self.special_strings = special_strings
        self.signs = [t.content.encode() for _, t in added] if special_strings else []
        self.mark, self.sign = special[0] if special else (None, None)   # parts pieces in one call
        self.limit = limit
        self._restart()

    def _restart(self) -> None:
        self.near_code = np.zeros(_NEAR, U64)     # the last piece met in each place of a small table
        self.near_slot = np.full(_NEAR, -1, np.int64)
        self.code = np.zeros(0, U64)              # ascending
        self.slot = np.zeros(0, np.int64)         # of each code in `start`
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> list:
        """Encodings of whole texts by the library."""
        self.tokenizer.encode_special_tokens = not self.special_strings
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, length of each)."""
        if self.sign is not None:
            joined = self.sign.encode().join(pieces)
            if joined.count(self.sign.encode()) == len(pieces) - 1:
                self.tokenizer.encode_special_tokens = False
                ids = np.array(self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.uint32)
                marks = np.flatnonzero(ids == self.mark)
                if len(marks) == len(pieces) - 1:
                    size = np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
                    return np.delete(ids, marks), size
        found = [e.ids for e in self.plain([p.decode() for p in pieces])]
        return np.array([i for one in found for i in one], np.uint32), np.array([len(one) for one in found], np.int64)

    def _slots(self, words: Words, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The slot of every piece; pieces that are not known yet are encoded."""
        near = (code & U64(_NEAR - 1)).astype(np.int64)
        slots = self.near_slot[near]
        far = np.flatnonzero((self.near_code[near] != code) | (slots < 0))
        if len(far):
            slots[far] = self._far_slots(words, code[far], begin[far], words.end[far])
            self.near_code[near[far]], self.near_slot[near[far]] = code[far], slots[far]
        return slots

    def _far_slots(self, words: Words, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        fresh, at, back = np.unique(code, return_index=True, return_inverse=True)
        every = fresh
        if len(self.code):
            place = np.minimum(np.searchsorted(self.code, fresh), len(self.code) - 1)
            new = self.code[place] != fresh
            if not new.any():
                return self.slot[place][back]
            fresh, at = fresh[new], at[new]
        data = words.data.tobytes()
        borders = list(zip(begin[at].tolist(), end[at].tolist()))
        for a in range(0, len(borders), _CALL):
            ids, size = self._encoded([data[x:y] for x, y in borders[a:a + _CALL]])
            self.ids = np.concatenate((self.ids, ids))
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(size)))
        into = np.searchsorted(self.code, fresh)
        self.code = np.insert(self.code, into, fresh)
        self.slot = np.insert(self.slot, into, np.arange(len(fresh)) + len(self.start) - 1 - len(fresh))
        return self.slot[np.searchsorted(self.code, every)][back]

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by `end`; borders of the texts in them)."""
        if len(self.code) > self.limit:
            self._restart()
        data, offsets = buffer_of(column)
        whole = _unsafe(data, offsets)
        whole[_holding(data, offsets, self.signs)] = True
        words = words_of(column, _PIECES)
        owner = np.repeat(np.arange(len(offsets) - 1), words.counts)
        opening = words.start == offsets[:-1][owner]
        code = np.where(opening, mix(words.code ^ U64(0x5BF0A8B1457695E3)), words.code)
        begin = np.where(opening, words.start, words.start - 1)
        if whole.any():
            keep = ~whole[owner]
            words = Words(words.data, words.start[keep], words.end[keep], words.code[keep], words.first)
            owner, code, begin = owner[keep], code[keep], begin[keep]
        if len(code):
            used = self._slots(words, code, begin)
            size = self.start[used + 1] - self.start[used]
            total = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.arange(total[-1]) + np.repeat(self.start[used] - total[:-1], size)]
            border = total[np.searchsorted(owner, np.arange(len(offsets)))]
        else:
            ids, border = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        for row in np.flatnonzero(whole)[::-1].tolist():          # from the back, so that borders before stay
            more = np.array(self.plain([data[offsets[row]:offsets[row + 1]].tobytes().decode()])[0].ids, np.uint32)
            ids = np.concatenate((ids[:border[row]], more, ids[border[row]:]))
            border[row + 1:] += len(more)
        ids = np.insert(ids, border[1:], np.uint32(end))
        return ids, border + np.arange(len(border))


def _unsafe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts whose pieces can't be encoded one by one."""
    blank = np.flatnonzero(data == 0x20)
    out = np.zeros(len(offsets) - 1, bool)
    if not len(blank):
        return out
    before = data[np.maximum(blank - 1, 0)]
    odd = _BLANK_BYTES[before]
    for i in np.flatnonzero(_WIDE_LAST[before]).tolist():
        odd[i] = data[max(0, blank[i] - 3):blank[i]].tobytes().endswith(tuple(_WIDE_BLANKS))
    row = np.searchsorted(offsets, blank, "right") - 1
    odd &= blank > offsets[row]
    odd |= blank == offsets[row + 1] - 1
    out[row[odd]] = True
    return out


def _holding(data: np.ndarray, offsets: np.ndarray, signs: list[bytes]) -> list[int]:
    """Texts in which one of the strings begins."""
    raw, rows = data.tobytes() if signs else b"", []
    for sign in signs:
        at = raw.find(sign)
        while at >= 0:
            rows.append(int(np.searchsorted(offsets, at, "right")) - 1)
            at = raw.find(sign, at + 1)
    return rows


HELD.append(_ENCODERS.clear)


def encoder(path: str, special_strings: bool = True) -> Encoder:
    """The encoder of a file, shared by the tasks of one Python worker until another operator runs there."""
    if (path, special_strings) not in _ENCODERS:
        _ENCODERS[path, special_strings] = Encoder(path, special_strings=special_strings)
    return _ENCODERS[path, special_strings]
