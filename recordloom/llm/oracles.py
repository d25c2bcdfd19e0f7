"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_BLANK = r"[\x20\x09-\x0D]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, gap: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{gap}'), lambda x: x <> '')"


OP2 = fr"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_words("t", _BLANK)} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w) q),
c AS (SELECT r, count(DISTINCT p + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS m FROM g) q, (SELECT unnest(range(0, 5)) AS j) z WHERE m > 1 GROUP BY r),
l AS (SELECT r, source, len({_words("x", _BLANK)}) AS n, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '{_BLANK}', ' ', 'g'), ' ') AS line
      FROM (SELECT r, source, unnest(ls) AS x FROM w) q),
f AS (SELECT source, line FROM l GROUP BY source, line HAVING count(DISTINCT r) > 50),
o AS (SELECT r, sum(n) AS n FROM l WHERE EXISTS (SELECT 1 FROM f WHERE f.source IS NOT DISTINCT FROM l.source AND f.line = l.line) GROUP BY r),
b AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(o.n, 0) AS BIGINT) AS n_common_words
      FROM w LEFT JOIN c ON c.r = w.r LEFT JOIN o ON o.r = w.r),
e AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words,
 NOT base_failed AND n_common_words <= 0.5 * n_words AS kept FROM e"""

OP3 = fr"""WITH w AS (SELECT doc_id, {_words("coalesce(text, '')", _BLANK)} AS ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 19), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w) q),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM g),
x AS (SELECT DISTINCT doc_id, p + j AS q FROM f, (SELECT unnest(range(0, 20)) AS j) z WHERE rn > 1),
h AS (SELECT doc_id, count(*) AS c, list(q) AS qs FROM x GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(CASE WHEN c IS NULL THEN ws ELSE list_filter(ws, lambda v, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN h ON h.doc_id = w.doc_id"""

OP8 = fr"""WITH i AS (SELECT item_id, {_words(_LOW, _GAP)} AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS k FROM
      (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0) q),
d AS (SELECT doc_id, {_words(_LOW, _GAP)} AS ws FROM documents),
v AS (SELECT doc_id, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS k FROM
      (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM b) z) q),
m AS (SELECT v.doc_id, v.p, v.n, b.item_id FROM v JOIN b ON b.n = v.n AND b.k = v.k),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM m) y GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m WHERE item_id IS NOT NULL) y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP9 = fr"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOW, _BLANK)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, p, p + 3), ' ') END AS k FROM
      (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM d WHERE len(ws) > 0) q),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS h FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a), e AS (SELECT h, count(*) AS c FROM n GROUP BY h)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, CAST(coalesce(e.c, 1) AS BIGINT) AS copies
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id LEFT JOIN e ON e.h = n.h"""


def url_sql(rules: list[tuple[str, str]]) -> str:
    """The URL filter with models of order 3 under these rules."""
    cases = {"rule": "", "verdict": ""}
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN "
        cases["rule"] += fits + f"'{text}' "
        cases["verdict"] += fits + f"'{verdict}' "
    sides, looks = "", ""
    for side in ("good", "bad"):
        p = "(1.0 / 256)"
        for n in range(1, 5):
            context = f"(SELECT {side} FROM t)" if n == 1 else f"coalesce(x{n}.{side}, 0)"
            p = f"((coalesce(g{n}.{side}, 0) + 2 * {p}) / ({context} + 2.0))"
        sides += (" - " if sides else "") + f"ln({p})"
    for n in range(1, 5):
        looks += f" LEFT JOIN g g{n} ON g{n}.gram = substr(a.gram, {5 - n}, {n})"
        looks += f" LEFT JOIN g x{n} ON x{n}.gram = substr(a.gram, {5 - n}, {n - 1})" if n > 1 else ""
    return fr"""WITH q AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
r AS (SELECT *, CASE {cases["rule"]} END AS rule, CASE {cases["verdict"]} END AS v FROM h),
u AS (SELECT url, repeat(chr(2), 3) || url || chr(3) AS x, count(*) FILTER (WHERE v = 'allow') AS good, count(*) FILTER (WHERE v = 'block') AS bad FROM r GROUP BY url),
g AS (SELECT substr(x, CAST(e - n + 1 AS BIGINT), CAST(n AS BIGINT)) AS gram, sum(good) AS good, sum(bad) AS bad FROM (SELECT x, good, bad, unnest(range(3, length(x) + 1)) AS e FROM u WHERE good + bad > 0) y,
      (SELECT unnest(range(1, 5)) AS n) z WHERE e >= n GROUP BY 1),
t AS (SELECT CAST(sum(good) AS DOUBLE) AS good, CAST(sum(bad) AS DOUBLE) AS bad FROM g WHERE length(gram) = 1 AND gram <> chr(2)),
p AS (SELECT url, substr(x, e - 3, 4) AS gram FROM (SELECT url, x, unnest(range(4, length(x) + 1)) AS e FROM u) y),
l AS (SELECT a.gram, {sides} AS ratio FROM (SELECT DISTINCT gram FROM p) a{looks}),
s AS (SELECT url, round(avg(ratio), 6) AS score FROM p JOIN l ON l.gram = p.gram GROUP BY url),
m AS (SELECT v, avg(score) AS mean, sqrt(greatest(avg(score * score) - avg(score) * avg(score), 1e-9)) AS dev FROM r JOIN s ON s.url = r.url WHERE v IS NOT NULL GROUP BY v),
c AS (SELECT (a.mean * b.dev + b.mean * a.dev) / (a.dev + b.dev) AS cut FROM m a, m b WHERE a.v = 'allow' AND b.v = 'block')
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score >= (SELECT cut FROM c) THEN 'allow' ELSE 'block' END) AS verdict, score FROM r JOIN s ON s.url = r.url"""


def licence_sql(templates: list[tuple[str, str, str]], base: list[tuple[str, str]]) -> str:
    """The licence scan with these templates and base phrases; 0.6 of a whole template must agree."""
    rows = ", ".join(f"({i}, '{label}', '{words}', '{phrase}')" for i, (label, words, phrase) in enumerate(templates))
    phrases = ", ".join(f"('{label}', '{phrase}')" for label, phrase in base)
    return fr"""WITH tp AS (SELECT * FROM (VALUES {rows}) v(t, label, words, phrase)),
tw AS (SELECT t, p AS place, ws[p] AS word FROM (SELECT t, string_split(words, ' ') AS ws, unnest(range(1, len(string_split(words, ' ')) + 1)) AS p FROM tp) q),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_LOW, _GAP)} AS ws FROM documents),
n AS (SELECT count(*) AS n FROM d),
o AS (SELECT r, p, ws[p] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) q),
df AS (SELECT v.word, count(DISTINCT r) AS c FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN o ON o.word = v.word GROUP BY v.word),
wt AS (SELECT word, c, ln((n + 1.0) / (c + 1.0)) + 1e-3 AS weight FROM df, n),
ph AS (SELECT d.r, t FROM d JOIN tp ON contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')),
whole AS (SELECT t, sum(weight) AS w FROM tw JOIN wt ON wt.word = tw.word GROUP BY t),
b AS (SELECT o.r, tw.t, o.p - place AS head, sum(weight) AS w FROM o JOIN tw ON tw.word = o.word JOIN ph ON ph.r = o.r AND ph.t = tw.t
      JOIN wt ON wt.word = o.word GROUP BY o.r, tw.t, o.p - place),
m AS (SELECT r, label, round(b.w / whole.w, 6) AS share FROM b JOIN whole ON whole.t = b.t JOIN tp ON tp.t = b.t WHERE round(b.w / whole.w, 6) >= 0.6),
ba AS (SELECT * FROM (VALUES {phrases}) v(label, phrase)),
x AS (SELECT r, label, p - 1 AS pos FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) q, ba WHERE list_slice(ws, p, p + len(string_split(phrase, ' ')) - 1) = string_split(phrase, ' ')),
xs AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM x GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM x UNION SELECT r, label FROM m) q GROUP BY r),
sc AS (SELECT r, max(share) AS share FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(xs.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
 coalesce(xs.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, CASE WHEN xs.r IS NOT NULL THEN 1.0 ELSE least(1.0, coalesce(share, 0.0)) END AS score
FROM d LEFT JOIN xs ON xs.r = d.r LEFT JOIN al ON al.r = d.r LEFT JOIN sc ON sc.r = d.r"""


def _pii_sql() -> str:
    """Personal data with its bootstrapped contexts: 3 rounds, threshold 0.75, 3 known tokens a pattern.

    Candidates are parts with digits (4), digits in groups (5) and spelled-out addresses (6). For the last two the
    character before is matched too, as the first of two groups, where the library looks behind.
    """
    at = r"(?:\x20?@\x20?|\x20?[\[({<]\x20?(?:@|[Aa][Tt])\x20?[\])}>]\x20?)"
    dot = r"(?:\.|\x20?[\[({<]\x20?(?:\.|[Dd][Oo][Tt])\x20?[\])}>]\x20?|\x20[Dd][Oo][Tt]\x20)"
    part = "[A-Za-z0-9-]+"
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
                r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]", r"[A-Za-z]*[0-9][A-Za-z0-9]*(?:[-./:_][A-Za-z0-9]+)*",
                r"(^|[^A-Za-z0-9])(\+?\(?[0-9]+(?:(?:\)(?:\x20-\x20|[\x20./-])?\(?|(?:\x20-\x20|[\x20./-])\(?|\()[0-9]+)+)",
                rf"(^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+(?:{at}{part}(?:{dot}{part})*|\x20[Aa][Tt]\x20{part}(?:{dot}{part})+))"]

    def matched(kind: int, p: str) -> str:
        found = f"regexp_extract_all(t, '{p}', 2) AS f, regexp_extract_all(t, '{p}', 1) AS b" if kind > 4 else f"regexp_extract_all(t, '{p}') AS f, [] AS b"
        return f"SELECT r, {kind} AS kind, regexp_split_to_array(t, '{p}') AS p, {found} FROM t"

    found = " UNION ALL ".join(matched(k, p) for k, p in enumerate(patterns))
    rounds = "".join(fr"""
w{i} AS (SELECT b.pattern, k.kind, sum(b.times * k.score) / (any_value(a.times) + 1) AS score FROM bt b JOIN k{i - 1} k ON k.token = b.token JOIN al a ON a.pattern = b.pattern
      GROUP BY b.pattern, k.kind HAVING count(*) >= 3 AND sum(b.times * k.score) / (any_value(a.times) + 1) >= 0.75),
k{i} AS (SELECT * FROM k0 UNION ALL SELECT token, kind, score FROM (SELECT s.token, w.kind, w.score, row_number() OVER (PARTITION BY s.token ORDER BY w.score DESC, w.kind) AS rn
      FROM (SELECT DISTINCT pattern, token FROM se WHERE kind = 4) s JOIN w{i} w ON w.pattern = s.pattern WHERE s.token NOT IN (SELECT token FROM k0)) q WHERE rn = 1),""" for i in range(1, 4))
    kinds = ["email", "ip", "card", "phone"]
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END || ':' || start || ':' || stop"
    return fr"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({found}),
y AS (SELECT r, kind, i, length(p[i] || coalesce(b[i], '')) AS gap, length(f[i]) AS size, f[i] AS s, p[i] || coalesce(b[i], '') AS before, p[i + 1] || coalesce(b[i + 1], '') AS after
      FROM (SELECT r, kind, p, f, b, unnest(range(1, len(f) + 1)) AS i FROM x) q),
z AS (SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS digits, sum(gap) OVER w + coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM y WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
v AS (SELECT *, regexp_extract_all(right(before, 48), '[^\x20\x09-\x0D]+') AS bs FROM z WHERE CASE kind WHEN 0 THEN true
      WHEN 1 THEN len(list_filter(string_split(s, '.'), lambda q: coalesce(try_cast(q AS HUGEINT) <= 255, false))) = 4
      WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda d, j: CASE WHEN j % 2 = 1 THEN CAST(d AS INT)
           WHEN 2 * CAST(d AS INT) > 9 THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END)) % 10 = 0
      WHEN 3 THEN length(digits) BETWEEN 10 AND 15 WHEN 6 THEN true ELSE length(digits) >= 4 END),
a AS (SELECT r, kind, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop, lower(s) AS token,
      CASE WHEN kind IN (0, 6) THEN 'address' WHEN length(digits) < 10 THEN '4' WHEN length(digits) < 14 THEN '10' WHEN length(digits) < 20 THEN '14' ELSE '20' END AS shape,
      lower(array_to_string(list_slice(bs, greatest(len(bs) - 1, 1), len(bs)), ' ')) AS lft, lower(regexp_extract(left(after, 48), '[^\x20\x09-\x0D]+')) AS rgt FROM v),
c AS (SELECT r, kind, start, stop, token, shape, lft, rgt FROM a WHERE kind < 4 UNION ALL
      SELECT r, 4, start, stop, token, shape, lft, rgt FROM (SELECT *, row_number() OVER (PARTITION BY r, start, stop ORDER BY kind) AS same FROM a WHERE kind >= 4
      AND NOT EXISTS (SELECT 1 FROM a b WHERE b.r = a.r AND b.kind < 4 AND b.start < a.stop AND a.start < b.stop)) q WHERE same = 1),
pt AS (SELECT kind, token, 'before|' || string_split(lft, ' ')[-1] || '|' || shape AS pattern FROM c WHERE lft <> ''
      UNION ALL SELECT kind, token, 'before2|' || lft || '|' || shape FROM c WHERE contains(lft, ' ') UNION ALL SELECT kind, token, 'after|' || rgt || '|' || shape FROM c WHERE rgt <> ''),
se AS (SELECT pattern, token, kind, count(*) AS times FROM pt GROUP BY pattern, token, kind),
bt AS (SELECT pattern, token, sum(times) AS times FROM se GROUP BY pattern, token), al AS (SELECT pattern, sum(times) AS times FROM se GROUP BY pattern),
k0 AS (SELECT DISTINCT token, kind, CAST(1.0 AS DOUBLE) AS score FROM se WHERE kind < 4),{rounds}
nw AS (SELECT c.r, k.kind, start, stop, max(stop) OVER (PARTITION BY c.r ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM c JOIN (SELECT token, min(kind) AS kind FROM k3 GROUP BY token) k ON k.token = c.token WHERE c.kind = 4),
e AS (SELECT r, kind, start, stop, true AS base FROM c WHERE kind < 4 UNION ALL SELECT r, kind, start, stop, false FROM nw WHERE reach IS NULL OR stop > reach),
g AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE base AND kind = {i}) AS n_{k}" for i, k in enumerate(kinds))},
      string_agg({name}, ',' ORDER BY start, kind, stop) FILTER (WHERE base) AS own, string_agg({name}, ',' ORDER BY start, kind, stop) AS spans, count(*) FILTER (WHERE NOT base) AS n_found FROM e GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in kinds)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans,
 CAST(coalesce(n_found, 0) AS BIGINT) AS n_found FROM t LEFT JOIN g ON g.r = t.r"""


OP10 = _pii_sql()


_VECTOR = "list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11 = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_VECTOR.format(scale=256)} AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


def kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of exact integer clustering, one after the other."""
    near = """SELECT v.vec_id, v.q, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS d
      FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.c) = 1"""
    parts = [f"v AS MATERIALIZED (SELECT vec_id, {_VECTOR.format(scale=1024)} AS q FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k})"]
    for r in range(rounds):
        parts += [f"a{r} AS MATERIALIZED ({near.format(r=r)})",
                  f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM "
                  f"(SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) y GROUP BY c, i) z GROUP BY c)",
                  f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN m{r} m ON m.c = o.c)"]
    parts.append(f"f AS MATERIALIZED ({near.format(r=rounds)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT f.vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.q, ',')) AS centroid_sha256 FROM f JOIN c{rounds} o ON o.c = f.c"""
