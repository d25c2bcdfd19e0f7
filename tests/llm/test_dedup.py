import hashlib
import random
from collections import Counter

import pytest

from recordloom.llm import jaccard_join
from recordloom.llm.components import connected
from recordloom.llm.jaccard_join import jaccard_components, keep_one_per_group
from recordloom.llm.substring_dedup import substring_dedup

from .conftest import BLANK, LOWER


def order(i):
    return (i is None, i)


def brute_substrings(rows, width=20):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        words = BLANK.findall(text or "")
        gone = [False] * len(words)
        own = set()
        for p in range(len(words) - width + 1):
            key = tuple(words[p:p + width])
            if key in own or seen.get(key, i) != i:
                gone[p:p + width] = [True] * width
            own.add(key)
            seen.setdefault(key, i)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_substrings_equal_brute_force(corpus, nothing):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substring_dedup(corpus).collect()), key=str)
    assert got == brute_substrings(rows)
    assert substring_dedup(nothing).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(corpus, window=8)


@pytest.mark.parametrize("vocabulary", [1, 2, 6, 60])
def test_substrings_of_few_words(spark, vocabulary):
    rng = random.Random(vocabulary)
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(90)]
    rows = []
    for i in range(25):
        words = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(70)
            words += base[a:a + rng.randrange(12, 45)] + [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(4))]
        rows.append((i, " ".join(words)))
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_substrings(rows)


def brute_components(rows, percent, size):
    sets = []
    for i, text in rows:
        words = BLANK.findall((text or "").translate(LOWER))
        count = max(len(words) - size + 1, 1 if words else 0)
        sets.append((i, frozenset(tuple(words[p:p + size]) for p in range(count))))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                up[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least.get(find(n), i), i, key=order)
    return sorted(((i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("percent,size,long_list", [(85, 4, 64), (85, 4, 2), (80, 5, 8)])
def test_components_equal_brute_force(corpus, monkeypatch, percent, size, long_list):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    got = jaccard_components(corpus, percent, size)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute_components(rows, percent, size)


def test_one_per_group_stays(corpus, nothing):
    kept = keep_one_per_group(corpus)
    assert kept.columns == corpus.columns
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    want = {i for i, _, least in brute_components(rows, 80, 5) if i == least}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert keep_one_per_group(nothing).collect() == []
    assert jaccard_components(nothing).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (None, 3)]
    got = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert got == want


def test_chance_meetings_are_no_pairs(spark, monkeypatch):
    """Sets that meet in a list or two are not compared; links of few shingles stay."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    rows, shared = [], [[word() for _ in range(5)] for _ in range(40)]
    for i in range(80):                                  # two windows of four words in common with one other text
        rows.append((i, " ".join(shared[i // 2] + [word() for _ in range(60)])))
    few = [word() for _ in range(10)]                    # six of seven shingles
    rows += [(100, " ".join(few[:9])), (101, " ".join(few))]
    met = []
    sketched = jaccard_join.JaccardJoin.sketched
    monkeypatch.setattr(jaccard_join.JaccardJoin, "sketched", lambda self, pairs, nodes: met.append(pairs.count()) or sketched(self, pairs, nodes))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute_components(rows, 85, 4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()}[101] == 100
    assert met == [1]
