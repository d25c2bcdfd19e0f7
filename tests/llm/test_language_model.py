import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import pitman_yor
from recordloom.llm.bytewords import U64, blank_words, mix, words_of
from recordloom.llm.pitman_yor import END, START, score_texts, seat

from .conftest import BLANK, LOWER

def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2



def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def codes_of(words):
    plain = sorted(w for w in words if isinstance(w, str))
    found = words_of(pa.array(plain), blank_words())
    return dict(zip(plain, found.code.tolist())) | {START: START, END: END}


def brute_scores(rows, sweeps, burn, strength=1.0):
    """The model in dictionaries, one restaurant after the other, with the operator's sampler for a dish."""
    texts = [(i, held_out(i), BLANK.findall((t or "").translate(LOWER)) + [END]) for i, t in rows]
    code = codes_of({w for _, _, ws in texts for w in ws})
    count = Counter(w for _, h, ws in texts if not h for w in ws)
    pairs = Counter(p for _, h, ws in texts if not h for p in zip([START, *ws], ws))
    total, known = sum(count.values()), len(count)

    def discount(c):
        ones, twos = (sum(v == n for v in c.values()) for n in (1, 2))
        return min(max(ones / max(ones + 2 * twos, 1), 0.05), 0.95)

    d0, d = discount(count), discount(pairs)
    key = {p: int(mix(mix(np.array([code[p[0]]], U64)) * U64(0x9E3779B97F4A7C15) + U64(code[p[1]]))[0]) for p in pairs}
    every = {p for _, _, ws in texts for p in zip([START, *ws], ws)}
    mean, seats, tables0 = defaultdict(float), dict.fromkeys(pairs, 1), known
    sums = []
    for s in range(sweeps + 1):
        customers, context, opened = Counter(), Counter(), Counter()
        for (u, w), t in seats.items():
            customers[w] += int(t)
            context[u] += pairs[u, w]
            opened[u] += int(t)
        names = sorted(customers, key=str)
        drawn = seat(np.array([code[w] for w in names], U64), np.array([customers[w] for w in names]), np.full(len(names), float(max(tables0 - 1, 0))),
                     np.full(len(names), 1 / (known + 1)), strength, d0, s, 0) if names else []
        root = dict(zip(names, drawn))
        tables0 = int(sum(root.values()))
        fresh = (strength + d0 * tables0) / (known + 1)
        whole = sum(customers.values())
        share = defaultdict(lambda: fresh / (strength + whole), {w: (customers[w] - d0 * root[w] + fresh) / (strength + whole) for w in names})
        sums.append(sum(share[w] for w in names) + fresh / (strength + whole))
        if s >= burn:
            for u, w in every:
                mean[u, w] += (pairs.get((u, w), 0) - d * seats.get((u, w), 0) + (strength + d * opened[u]) * share[w]) / (strength + context[u])
        for p in pairs:
            one = [np.array([x]) for x in (pairs[p], max(opened[p[0]] - seats[p], 0.0), share[p[1]])]
            seats[p] = seat(np.array([key[p]], U64), *one, strength, d, s, 1)[0]
    out = []
    for i, h, ws in texts:
        base = sum(math.log10((count[w] + 1) / (total + known + 1)) for w in ws)
        score = sum(math.log10(mean[p] / (sweeps + 1 - burn)) for p in zip([START, *ws], ws))
        out.append((i, h, len(ws), sum(count[w] > 0 for w in ws), total, base, score))
    return out, sums


def same(got, want):
    order = lambda r: (r[0] is None, r[0], r[2])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("chunk,part,sweeps", [(4 << 20, 2_000_000, 3), (4000, 500, 2)])
def test_scores_equal_brute_force(corpus, monkeypatch, chunk, part, sweeps):
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(pitman_yor, "PART_KEYS", part)
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    want, sums = brute_scores(rows, sweeps, 1)
    got = score_texts(corpus, held(), sweeps=sweeps, burn=1)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(got.collect(), want)
    np.testing.assert_allclose(sums, 1.0)


def test_nothing_to_learn_from(corpus, nothing):
    got = score_texts(nothing, held())
    assert got.collect() == [] and got.columns[0] == "doc_id"
    alone = score_texts(corpus.where("doc_id < 3"), F.lit(True)).collect()
    assert len(alone) >= 3 and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in alone)
    unknown = score_texts(corpus.where("doc_id < 30"), F.lit(None).cast("boolean")).collect()
    assert not any(r.held_out for r in unknown)


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{rng.randrange(300)}" for _ in range(4)] for i in range(300)}
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(300)}"]
        for _ in range(60):
            words.append(rng.choice(follow[words[-1]]))
        rows.append((i, " ".join(words)))
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), held()).where("held_out").collect()
    assert len(got) > 30
    assert sum(r.score for r in got) > 0.45 * sum(r.base_score for r in got)


@pytest.mark.parametrize("customers,others,share", [(2, 3, 0.1), (5, 2, 0.4), (12, 40, 0.05)])
def test_seats_follow_the_exact_distribution(customers, others, share):
    d, strength, n = 0.6, 1.0, 40_000
    ways = np.zeros(customers + 1)      # generalised Stirling numbers
    ways[1] = 1
    for c in range(1, customers):
        ways = np.array([0, *[ways[t - 1] + (c - d * t) * ways[t] for t in range(1, customers + 1)]])
    weight = np.array([0, *[ways[t] * math.prod((strength + d * (others + j)) * share for j in range(t)) for t in range(1, customers + 1)]])
    drawn = seat(np.arange(n).astype(U64), np.full(n, customers), np.full(n, float(others)), np.full(n, share), strength, d, 3, 1)
    np.testing.assert_allclose(np.bincount(drawn.astype(int), minlength=customers + 1) / n, weight / weight.sum(), atol=0.01)


@pytest.mark.parametrize("customers,others,share,discount", [(600, 500, 0.02, 0.7), (300, 5, 0.2, 0.4), (900, 4000, 0.05, 0.8), (300, 3, 1e-5, 0.75)])
def test_seats_of_many_customers(monkeypatch, customers, others, share, discount):
    n = 1000
    args = np.arange(n).astype(U64), np.full(n, customers), np.full(n, float(others)), np.full(n, share), 1.0, discount, 2, 1
    near = seat(*args)
    pitman_yor._ways.cache_clear()
    monkeypatch.setattr(pitman_yor, "EXACT", 1024)
    exact = seat(*args)
    pitman_yor._ways.cache_clear()
    print(near.mean(), exact.mean(), near.std(), exact.std())
    assert abs(near.mean() / exact.mean() - 1) < 0.05 and abs(near.std() - exact.std()) < 0.1 * exact.std() + 0.1


def test_seats_of_a_billion_customers():
    drawn = seat(np.zeros(1, U64), np.array([10**9]), np.array([1e6]), np.array([0.05]), 1.0, 0.7, 2, 1)
    assert 30_000 < drawn[0] < 80_000


def test_small_numbers_take_few_bytes():
    for kind, values in (("<i8", [0, 3, 255]), ("<i8", [256, 1, 2**40]), ("<i8", []), ("<i8", [-1, 5]), ("<u8", [2**64 - 1, 0]), ("<i4", [70_000, 2])):
        data = pitman_yor._pack(np.array(values, kind), kind)
        assert pitman_yor._unpack(data, kind).tolist() == values and pitman_yor._unpack(data, kind).dtype == np.dtype(kind)
    assert len(pitman_yor._pack(np.full(1000, 200))) == 1001


def test_parcels_come_back_in_order_of_keys_and_are_packed():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 2**64, 40_000, dtype=np.uint64))
    sent = pitman_yor._parcels(7, key, [np.arange(len(key))], 5)
    assert sent.column("part").to_pylist() == [0, 1, 2, 3, 4]
    again = [np.cumsum(pitman_yor._unpack(k, "<u8"), dtype=np.uint64) + np.uint64(pitman_yor._least(p, 5))
             for k, p in zip(sent.column("keys").to_pylist(), sent.column("part").to_pylist())]
    assert (np.concatenate(again) == key).all()
    # bytes that neighbours share take no room
    assert sum(len(pa.compress(k, "lz4_raw", asbytes=True)) for k in sent.column("keys").to_pylist()) < 0.85 * 8 * len(key)
    back = pa.Table.from_batches([sent])
    rows = [pitman_yor._summed(5, None, 0)(back.slice(i, 1)).select(["part", "own", "sums"]).to_pylist()[0] for i in (3, 1, 4, 0, 2)]
    (sums,), own = pitman_yor._returned(pa.record_batch({"back": [rows]}), 0, "back")
    assert (sums == np.arange(len(key))).all() and own.all()
