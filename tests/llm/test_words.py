import random

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import bytewords
from recordloom.llm.bytewords import alnum_words, blank_words, windows, words_of

from .conftest import ALNUM, BLANK, LOWER

TEXTS = ["Ab c\tab  c", None, "", " \n", "é é\x0bÉ 中文 x" + "y" * 300 + " " + "y" * 299, "A.b-C 1_2 \x7f\x80 ü", "a" * 5000]


@pytest.mark.parametrize("bytes_at_once", [3, 1 << 21])
@pytest.mark.parametrize("classes,pattern,lower", [(blank_words(), BLANK, False), (blank_words(), BLANK, True), (alnum_words(), ALNUM, True)])
def test_words_equal_patterns(monkeypatch, bytes_at_once, classes, pattern, lower):
    monkeypatch.setattr(bytewords, "_ROUND", bytes_at_once)
    found = words_of(pa.array(TEXTS, pa.string()), classes, lower)
    names = {}
    for i, text in enumerate(TEXTS):
        want = pattern.findall((text or "").translate(LOWER) if lower else text or "")
        span = range(found.first[i], found.first[i + 1])
        assert [bytes(found.data[found.start[j]:found.end[j]]).decode() for j in span] == want
        for j, word in zip(span, want):
            assert names.setdefault(word, found.code[j]) == found.code[j]
    assert len(set(names.values())) == len(names)


def test_windows_are_named_by_content():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(30)]
    words = words_of(pa.array(texts), blank_words())
    spelled = [w for t in texts for w in BLANK.findall(t)]
    for second in (False, True):
        at, name = windows(words.code, words.first, 5, second)
        owner = np.repeat(np.arange(len(texts)), words.counts)
        assert at.tolist() == [i for i in range(len(spelled) - 4) if owner[i] == owner[i + 4]]
        seen = {}
        for i, n in zip(at.tolist(), name.tolist()):
            assert seen.setdefault(tuple(spelled[i:i + 5]), n) == n
        assert len(set(seen.values())) == len(seen)
