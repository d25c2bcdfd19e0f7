import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordloom.llm import packing, token_store
from recordloom.llm.tokens import Encoder
from recordloom.session import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([" ", "  ", "\n", "\t", "é", "don't", "12", "!", "<|endoftext|>", "　", "\r\n",
                                                      "word", "\x1c", " ", "中"])).map("".join), max_size=8))
def test_pieces_encode_like_whole_texts(texts):
    for special in (True, False):
        encoder, library = Encoder(PATH, limit=5, special_strings=special), Tokenizer.from_file(PATH)
        library.encode_special_tokens = not special
        for _ in range(2):                                    # known and unknown pieces, and a restart
            ids, border = encoder.encode(pa.array(texts, pa.string()), 7)
            for i, text in enumerate(texts):
                assert ids[border[i]:border[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids + [7]


def test_strings_of_special_tokens(spark, tokenizer):
    """They are encoded as a plain call of the library does, unless asked for otherwise."""
    text = "hello <|endoftext|> world"
    docs = spark.createDataFrame([(1, text), (2, "<|endoftext|>" * 3), (3, "<|endoftext"), (4, " a<|endoftext|>\n ")], "doc_id long, text string")
    assert tokenizer.encode(text, add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for special, size in ((True, 5), (False, 10)):
        path = f"{shared_folder(spark)}/tokens"
        token_store.write_tokens(docs, path, PATH, 2, special_strings=special)
        stored = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_documents(spark, path).collect()}
        packed = packing.pack_documents(docs, PATH, 2048, 2, special_strings=special).collect()
        assert stored == {r.doc_id: (r.length, r.ids_crc32) for r in packed} and stored[1][0] == size
        if special:
            want = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for r in docs.collect()}
            assert stored == {i: (len(ids), crc(ids)) for i, ids in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 5, 255, 256, 50256, 65535, 65536, 2**32 - 1]) | st.integers(0, 2**20), max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    code = token_store.Code(token_store.encode(np.array(ids, np.uint32)))
    assert len(code) == len(ids) and code.all().tolist() == ids
    for i in list(range(0, len(ids), 37)) + [len(ids) - 1] * bool(ids):
        assert code[i] == ids[i]
    with pytest.raises(IndexError):
        code[len(ids)]


def test_store_equals_tokenizer(spark, corpus, nothing, tokenizer, monkeypatch):
    path = f"{shared_folder(spark)}/tokens"
    token_store.write_tokens(corpus, path, PATH, 2)
    got = token_store.read_documents(spark, path).collect()
    rows = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in corpus.collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    start, want = 0, []
    for i, ids in rows:
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    wanted = spark.createDataFrame([(5, 0), (5, 3), (5, 10**6), (999, 0), (None, 1)], "doc_id long, index long")
    found = {(r.doc_id, r["index"]): r.token for r in token_store.tokens_at(token_store.segments(spark, path), wanted).collect()}
    ids = dict(rows)[5]
    assert found == {(5, 0): ids[0], (5, 3): ids[3], (5, 10**6): None, (999, 0): None, (None, 1): None}
    empty = f"{shared_folder(spark)}/tokens"
    token_store.write_tokens(nothing, empty, PATH, 2)
    assert token_store.read_documents(spark, empty).collect() == []


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing_is_whole_and_gapless(corpus, nothing, tokenizer, capacity):
    rows = packing.pack_documents(corpus.where("doc_id is not null").dropDuplicates(["doc_id"]), PATH, capacity, 0).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for r in corpus.where("doc_id is not null").collect():
        ids, at = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], 0
        for n, p in enumerate(sorted(pieces[r.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (n, at, crc(ids[at:at + p.length]))
            assert n == 0 or p.length == capacity
            at += p.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    assert packing.pack_documents(nothing, PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=8))
def test_plan_places_every_piece_once(counts):
    rows = packing.plan(counts, 30)
    seen, load = defaultdict(set), defaultdict(int)
    for n, first, many, sequence, bins, offset in rows.tolist():
        for rank in range(many):
            assert first + rank not in seen[n]
            seen[n].add(first + rank)
            load[sequence + rank % bins] += n
    assert {n: len(v) for n, v in seen.items()} == counts
    assert all(v <= 30 for v in load.values())


def least_bins(items, capacity):
    best = len(items)

    def place(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[at] <= capacity and bins[i] not in bins[:i]:
                place(at + 1, bins[:i] + [bins[i] + items[at]] + bins[i + 1:])
        place(at + 1, bins + [items[at]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_keeps_the_optimum(items):
    counts = np.bincount(items, minlength=21) if items else np.zeros(21, np.int64)
    fixed = packing.reduce_by_dominance(counts, 20)
    rest = np.repeat(np.arange(21), counts).tolist()
    assert sum(bins for _, bins in fixed) + least_bins(rest, 20) == least_bins(items, 20)
