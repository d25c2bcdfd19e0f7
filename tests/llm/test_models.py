import hashlib
import random
import re
from collections import Counter, defaultdict
from math import log

from recordloom.llm.pii import KINDS, pii_digest, redact_pii
from recordloom.llm.quality import keep_good, rate_quality
from recordloom.llm.url_filter import judge_urls

from .conftest import sentence

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def parts(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def rule_of(host, path):
    fits = [(len(t), t, v) for t, v in RULES for name, _, rest in [t.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return max(fits, default=(0, None, None))[1:]


def brute_scores(urls, order=3):
    """Per URL: mean log ratio, with the counts held in dictionaries."""
    counts = {v: defaultdict(int) for v in ("allow", "block")}
    totals = Counter()
    for url in urls:
        verdict = rule_of(*parts(url))[1]
        if verdict:
            text = "\x02" * order + (url or "") + "\x03"
            for end in range(order, len(text) + 1):
                for n in range(1, order + 2):
                    if end >= n:
                        counts[verdict][text[end - n:end]] += 1
            totals[verdict] += len(text) - order

    def score(url):
        text, total = "\x02" * order + (url or "") + "\x03", 0.0
        for end in range(order + 1, len(text) + 1):
            value = {}
            for verdict in counts:
                p = 1 / 256
                for n in range(1, order + 2):
                    gram = text[end - n:end]
                    before = totals[verdict] if n == 1 else counts[verdict][gram[:-1]]
                    p = (counts[verdict][gram] + 2 * p) / (before + 2)
                value[verdict] = log(p)
            total += value["allow"] - value["block"]
        return total / (len(text) - order)

    return {u: score(u) for u in set(urls)}


def test_url_scores_equal_brute_force(spark):
    rng = random.Random(4)
    hosts = ["Www.a.example.org", "b.example.com", "bad.example.com", "c.net", "org", "x.com", "myorg"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(30)}{rng.choice(['', '?q=1', '#t', '/x.html'])}" for _ in range(120)]
    urls += [None, "", "no scheme", "ftp://", "http://EXAMPLE.org/en/12", "http://example.org?x=/en/1", urls[0]]
    rows = [(i, u, 1, "z") for i, u in enumerate(urls)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, gram int, rule string"), RULES).collect()
    scores = brute_scores([u or "" for u in urls])
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(urls[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and abs(r.score - scores[urls[r.page_id] or ""]) < 1e-5
        assert verdict is None or r.verdict == verdict
    loose = sorted((r.score, r.verdict) for r in got if r.rule is None)
    assert [v for _, v in loose] == sorted((v for _, v in loose), reverse=True)   # one threshold: block, then allow


def test_urls_without_models(spark):
    one = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/"), (None, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in judge_urls(one, RULES).collect()} == {(1, "allow"), (2, "allow"), (None, "allow")}
    assert judge_urls(one.where("false"), RULES).collect() == []


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        total = sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def brute_pii(text):
    found = sorted((m.start(), k, m.end()) for k in range(4) for m in re.finditer(PATTERNS[k], text or "") if valid(k, m.group()))
    digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()
    return (*[sum(f[1] == k for f in found) for k in range(4)], digest)


def test_pii_base_equals_brute_force(spark, corpus, nothing):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1.@-+ ()9._%4é\n") for _ in range(70)) for _ in range(600)]
    texts += ["4111 1111 1111 1111 x 1.2.3.4.5.6.7.8 a@b.c_d@e.f +49 (30) 1234-5678.", None, "", "9" * 20000, "a" * 20000 + "@", "a@b" + ".c" * 9000,
              "1." * 9000, "+1" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:6] for r in pii_digest(docs).collect()} == {i: brute_pii(t) for i, t in enumerate(texts)}
    got = sorted((tuple(r)[:6] for r in pii_digest(corpus).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute_pii(r.text)) for r in corpus.collect()), key=str)
    assert pii_digest(nothing).collect() == []


def luhn_number(rng):
    while True:
        digits = "4" + "".join(str(rng.randrange(10)) for _ in range(15))
        if valid(2, digits):
            return digits


def test_contexts_discover_identifiers(spark):
    rng = random.Random(5)
    rows = [(i, f"{sentence(rng)} card number {luhn_number(rng)} expires soon") for i in range(30)]
    rows += [(100, "please note card number 4111111111111112 expires today"), (101, "part 4111111111111113 shipped"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii_digest(docs).collect()}
    assert got[100].n_card == 0 and got[100].n_found == 1 and got[100].spans == "card:24:40"
    assert got[101].n_found == 0 and got[102].spans == ""
    clean = {r.doc_id: r.text for r in redact_pii(docs).collect()}
    assert clean[100] == "please note card number <card> expires today" and clean[101] == rows[31][1] and clean[102] is None
    assert "<card>" in clean[0] and len(clean) == len(rows)


def test_contexts_discover_other_spellings(spark):
    rng, rows = random.Random(6), []
    for i in range(30):
        digits = luhn_number(rng)
        known = [f"write to a{i}@host{i}.org for help", f"please call +49 30 {rng.randrange(10**6, 10**7)} today", f"server {i + 10}.{i + 20}.200.{100 + i} is down",
                 f"card number {' '.join(digits[j:j + 4] for j in range(0, 16, 4))} expires soon"]
        rows += [(len(rows) + j, f"{sentence(rng)} {t}") for j, t in enumerate(known)]
    unseen = {1000: ("write to ", "email", "jane.doe (at) mail dot example dot com", " for help"), 1001: ("write to ", "email", "jane@localhost", " for help"),
              1002: ("please call ", "phone", "555-010-2345", " today"), 1003: ("please call ", "phone", "(555) 010 23456", " today"),
              1004: ("server ", "ip", "110-120-130-140", " is down"), 1005: ("server ", "ip", "10.20.300.9999", " is down"),
              1006: ("card number ", "card", "4111 1111 1111 1112", " expires soon"), 1007: ("write to ", "email", "joe at example.com", " for help")}
    rows += [(i, before + token + after) for i, (before, _, token, after) in unseen.items()]
    rows += [(2000, "part 555-010-2345-6 shipped"), (2001, "look at this dot and (5) 12345678901"), (2002, "order 4111 1111 1111 1113 shipped")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii_digest(docs).collect()}
    clean = {r.doc_id: r.text for r in redact_pii(docs).collect()}
    for i, (before, kind, token, after) in unseen.items():
        assert got[i].spans == f"{kind}:{len(before)}:{len(before + token)}" and got[i].n_found == 1, (i, got[i])
        assert clean[i] == f"{before}<{kind}>{after}"
    assert [got[i].spans for i in (2000, 2001, 2002)] == ["", "", ""] and len(clean) == len(rows)
    assert all(got[i].n_found == 0 for i in range(120))


def test_redaction_keeps_rows(corpus, nothing):
    same = redact_pii(corpus)
    assert same.columns == corpus.columns and same.count() == corpus.count() and redact_pii(nothing).collect() == []


def quality_table(spark, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        kind = rng.choice(["good"] * 6 + ["junk", "toxic"])
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 80))]
        if kind == "junk":
            words = [w + rng.choice(["###", "%%%", "$$$"]) for w in words]
        if kind == "toxic":
            for w in ("vile", "scum", "trash"):
                words[rng.randrange(len(words))] = w
        rows.append((i, " ".join(words), rng.choice(["en", None]), f"s{rng.randrange(5)}", kind))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


def test_quality_on_held_out_documents(spark, nothing):
    rows, labels = quality_table(spark)
    rows += [(900, None, None, None, "none"), (901, "", "en", "s0", "none"), rows[0], (None, rows[1][1], "en", "s1", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, evidence string")
    known = spark.createDataFrame(labels[:400] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = rate_quality(docs, known).collect()
    assert len(got) == len(rows)
    verdict = {r.doc_id: r.accepted for r in got}
    held = [(verdict[i] == bool(q and not t)) for i, q, t in labels[400:]]
    assert sum(held) / len(held) > 0.95
    kept = keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got)
    assert rate_quality(nothing, known).collect() == []
    assert all(r.accepted for r in rate_quality(docs, known.where("false")).collect())


def test_sites_shift_the_verdict(spark):
    rng = random.Random(8)
    rows, labels = quality_table(spark, 9)
    # the same undecided text on a good and on a bad site
    bad = [(1000 + i, " ".join(f"w{rng.randrange(4000)}###" for _ in range(30)), "en", "bad") for i in range(200)]
    docs = spark.createDataFrame([r[:4] for r in rows] + bad + [(5000, "w1 w2 w3", "en", "bad"), (5001, "w1 w2 w3", "en", "s1")],
                                 "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in rate_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[5000].evidence == got[5001].evidence
    assert got[5000].prior < 0.2 < 0.6 < got[5001].prior and got[5000].posterior < got[5001].posterior
