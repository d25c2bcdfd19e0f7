import hashlib
import math
import random
import re
from collections import Counter

import pytest

from recordloom.llm.decontaminate import contamination, covered_words, mark_contamination, remove_contamination
from recordloom.llm.license_scan import BASE, TEMPLATES, scan_licenses
from recordloom.llm.line_rules import rate_lines, remove_common_lines
from pyspark.sql import functions as F

from .conftest import ALNUM, BLANK, LOWER, sentence


def text_rows(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_line_rules_equal_brute_force(corpus, nothing):
    got = sorted((tuple(r)[:7] for r in rate_lines(corpus).collect()), key=str)
    want = []
    for i, text in text_rows(corpus):
        words, lines = BLANK.findall(text), [x for x in text.split("\n") if BLANK.search(x)]
        seen, cover = Counter(tuple(words[p:p + 5]) for p in range(len(words) - 4)), set()
        for p in range(len(words) - 4):
            if seen[tuple(words[p:p + 5])] > 1:
                cover.update(range(p, p + 5))
        want.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
                     len(cover), len(words) < 10 or 100 * len(cover) > 20 * len(words)))
    assert got == sorted(want, key=str)
    assert rate_lines(nothing).collect() == [] and remove_common_lines(nothing).collect() == []


def test_common_lines_deplete(spark):
    line = "this line stands in a great many documents of the site 17"
    rows = [(i, f"{line.replace('17', str(i))}\n{sentence(random.Random(i), 900, 4)}", "a") for i in range(8)]
    rows += [(20, f"{line}\n{sentence(random.Random(3), 900, 40)}", "a"), (21, f"{line}\nown words", "b"), (22, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in rate_lines(docs, max_documents=5).collect()}
    assert [got[i].kept for i in range(8)] == [False] * 8 and not got[0].base_failed
    assert got[20].kept and got[20].n_common_words == 12 and got[21].kept and got[21].n_common_words == 0
    left = {r.doc_id: r.text for r in remove_common_lines(docs, max_documents=5).collect()}
    assert left[20] == rows[8][1].split("\n")[1] and left[21] == rows[9][1] and left[22] is None


def brute_licences(text):
    words, starts, labels = ALNUM.findall(text.translate(LOWER)), [], set()
    for label, phrase in BASE:
        parts = phrase.split()
        for p in range(len(words) - len(parts) + 1):
            if words[p:p + len(parts)] == parts:
                starts.append(p)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licence_base_equals_brute_force(spark, corpus, nothing):
    rng = random.Random(1)
    words = ["CC", "by", "BY", "cc", "All", "rights", "reserved", "General", "public", "license", "x", "é", "K", "-", "."]
    texts = [rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " ", ", ", "\n"]) for _ in range(40)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for table in (docs, corpus):
        got = sorted((tuple(r)[:6] for r in scan_licenses(table).collect()), key=str)
        assert got == sorted(((i, *brute_licences(t)) for i, t in text_rows(table)), key=str)
    assert scan_licenses(nothing).collect() == []


def test_licence_templates(spark):
    filler = [sentence(random.Random(i), 2000, 30) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(filler)] + [
        (100, filler[0] + " Released under the MIT License."), (101, "Licensed under the Apache License, Version 2.0."),
        (102, "license apache version words far from each other " + filler[1]), (103, "All rights reserved."), (104, None)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].labels == "mit" and got[101].labels == "apache-2.0" and got[102].labels == "" and got[103].labels == "reserved"
    assert got[104].n_words == 0 and all(0 <= r.score <= 1 for r in got.values())


def test_licence_templates_in_many_or_few_rows(spark):
    notice = {0: "Released under the MIT License.", 1: "Licensed under the Apache License, Version 2.0."}
    rows = [(i, f"{sentence(random.Random(i), 2000, 30)} {notice.get(i % 3, '')}") for i in range(60)]
    for table in (rows, rows[:3]):
        got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(table, "doc_id long, text string")).collect()}
        assert {i: got[i].labels for i in got} == {i: ["mit", "apache-2.0", ""][i % 3] for i, _ in table}
        assert {got[i].score for i in got} == {0.0, 1.0}


def brute_templates(texts, least_share):
    """(labels, best share) per text, every begin of every template compared word by word."""
    found = [ALNUM.findall(t.translate(LOWER)) for t in texts]
    seen = Counter(w for words in found for w in set(words))
    weight = {w: math.log((len(texts) + 1) / (seen[w] + 1)) + 1e-3 for _, t, _ in TEMPLATES for w in t.split()}
    out = []
    for words in found:
        shares = []
        for label, text, phrase in TEMPLATES:
            parts, whole = text.split(), sum(weight[w] for w in text.split())
            if f" {phrase} " in f" {' '.join(words)} ":
                shares += [(label, round(sum(weight[w] for i, w in enumerate(parts) if 0 <= b + i < len(words) and words[b + i] == w) / whole, 6))
                           for b in range(-len(parts), len(words))]
        out.append(({label for label, share in shares if share >= least_share}, max((x for _, x in shares if x >= least_share), default=0.0)))
    return out


@pytest.mark.parametrize("least_share", [0.6, 0.3, 1.0])
def test_licence_templates_equal_brute_force(spark, least_share):
    rng, texts = random.Random(8), [" ".join(t for _, t, _ in TEMPLATES), " ".join(TEMPLATES[i][1] for i in (2, 7, 10))]
    texts += [" ".join(TEMPLATES[i][1] for i in (2, 9, 1)), "of " * 300 + TEMPLATES[9][1]]
    for _ in range(80):
        words = [w for _ in range(rng.randrange(1, 5)) for w in [*rng.choice(TEMPLATES)[1].split(), *sentence(rng, 99, 2).split()]]
        texts.append(" ".join(rng.choice(words) if rng.random() < 0.08 else w for w in words if rng.random() > 0.02))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(table, least_share=least_share).collect()}
    if least_share == 0.6:
        assert set(got[0].labels.split(",")) == {label for label, _, _ in TEMPLATES} | {"cc-by", "gpl"}
        assert got[1].labels == "bsd,isc,mit" and got[2].labels == "apache-2.0,bsd,mit"
    for i, (labels, share) in enumerate(brute_templates(texts, least_share)):
        base = set(got[i].base_labels.split(",")) - {""}
        assert got[i].labels == ",".join(sorted(labels | base))
        assert abs(got[i].score - (1.0 if base else min(1.0, share))) < 2e-6


def brute_contamination(text, windows):
    words, hit, items = ALNUM.findall(text.translate(LOWER)), set(), set()
    for width in {len(w) for w in windows}:
        for p in range(len(words) - width + 1):
            found = windows.get(tuple(words[p:p + width]))
            if found is not None:
                hit.update(range(p, p + width))
                items |= found
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("vocabulary,part_words", [(3, 10**6), (3, 30), (12, 40), (40, 10**6)])
def test_contamination_equals_brute_force(spark, vocabulary, part_words):
    rng = random.Random(vocabulary)
    items = [(i, sentence(rng, vocabulary, rng.randrange(1, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (None, "w1 w2"), (3, "w1 W2 w0")]
    docs = [(i, sentence(rng, vocabulary, rng.randrange(0, 120)) + "\n" + rng.choice(items)[1 if rng.random() < .5 else 1].__str__()) for i in range(50)]
    docs += [(90, None), (91, ""), (92, items[0][1].upper())]
    windows = {}
    for i, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for p in range(len(words) - min(10, len(words)) + 1 if words else 0):
            windows.setdefault(tuple(words[p:p + min(10, len(words))]), set()).update({i} - {None})
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:6] for r in contamination(table, bench, part_words=part_words).collect()}
    assert got == {i: brute_contamination(t or "", windows) for i, t in docs}


def test_contamination_is_removed(spark, corpus, nothing):
    item = sentence(random.Random(9), 10**6, 24)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"before words, {item.title()}! after words " + sentence(random.Random(1), 99, 60), 9), (2, item + " end", 9), (3, "clean text", 9), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in remove_contamination(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[3].text == "clean text" and got[4].text is None
    assert got[1].text.startswith("before words, ! after words") and got[1].n_chars == len(got[1].text)
    same = remove_contamination(corpus, bench)
    assert same.columns == corpus.columns and same.count() == corpus.count()
    assert remove_contamination(nothing, bench).collect() == []
    none = mark_contamination(corpus, bench.where("false")).agg(F.sum(covered_words(F.col("_spans")))).first()[0]
    assert none == 0 and re.match("w", item)
