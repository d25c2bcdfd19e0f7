"""Personal data: patterns with checks, and identifiers found by bootstrapped contexts.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers. They are the seeds:
the words around an entity and its coarse class are lexical patterns. Candidates are other tokens
that look like identifiers: parts with digits, numbers in groups, and spelled-out addresses. Patterns and tokens form a graph that is scored in rounds: a pattern by the share
of its occurrences that are known entities, a token by its best pattern, and tokens over the
threshold are known in the next round. Candidates with a known token are new spans.

Only DataFrame functions. A text is read once; what stays are its matches. Their positions are
running sums over the lengths between matches. Counts of patterns and tokens are added up per task
before they are shuffled, and joins on them are left for Spark to split where one is very common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.base import let
from recordloom.session import cut

# The kinds in their order.
KINDS = ["email", "ip", "card", "phone"]
_CANDIDATE = len(KINDS)
_AT = r"(?:\x20?@\x20?|\x20?[\[({<]\x20?(?:@|[Aa][Tt])\x20?[\])}>]\x20?)"
_DOT = r"(?:\.|\x20?[\[({<]\x20?(?:\.|[Dd][Oo][Tt])\x20?[\])}>]\x20?|\x20[Dd][Oo][Tt]\x20)"
# The base's patterns, and from _CANDIDATE on those of candidates. A run of the first class is tried once, from its first character or from the end
# of the match before; possessive repeats give the same matches, as no later part could use a shorter one.
_PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    # tokens with a digit: letters and digits, in parts joined by one sign
    r"(?:\G|(?<![A-Za-z0-9]))[A-Za-z]*+[0-9][A-Za-z0-9]*+(?:[-./:_][A-Za-z0-9]++)*+",
    # digits in groups, joined by a blank, a sign or brackets
    r"(?<![A-Za-z0-9])\+?\(?[0-9]++(?:\)?(?:\x20-\x20|[\x20./-])?\(?[0-9]++)++",
    # addresses with another sign or word for @ and for the dot; a plain " at " needs a dot
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+|\x20[Aa][Tt]\x20[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)",
]
_SPELLED = len(_PATTERNS) - 1
#: Characters before and after a match in which its context words are looked for.
CONTEXT = 48
#: Texts whose spans are broadcast at most when they are redacted; beyond, texts are joined by a shuffle.
BROADCAST_TEXTS = 100_000


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(match, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    if kind == 2:
        return F.when(F.length(digits).between(14, 19), let(digits, _luhn)).otherwise(False)
    if kind == 3:
        return F.length(digits).between(10, 15)
    return F.lit(True) if kind == _SPELLED else F.length(digits) >= 4       # with fewer, no seed is of its class


def _possible(kind: int, text: Column) -> Column:
    """A quick look that rules most texts out."""
    return [text.contains("@"), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
            text.contains("+"), text.rlike("[0-9]"), text.rlike(r"[0-9][\x20()./-]{1,5}[0-9]"),
            text.contains("@") | text.rlike(r"[\x20\[({<][Aa][Tt][\x20\])}>]")][kind]


def _class(kind: int, match: Column) -> Column:
    """An address, or the range of the number of digits; seeds of a kind and candidates for it share it."""
    if kind in (0, _SPELLED):
        return F.lit("address")
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    return F.when(n < 10, "4").when(n < 14, "10").when(n < 20, "14").otherwise("20")


def _matches(kind: int, text: Column) -> Column:
    """All matches of one kind, with the characters before each, checks, and what the contexts need."""
    pattern = _PATTERNS[kind]

    def build(pair: Column) -> Column:
        pieces, found = pair["pieces"], pair["found"]

        def one(m: Column, i: Column) -> Column:
            before = F.regexp_extract_all(F.right(F.get(pieces, i), F.lit(CONTEXT)), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
            after = F.regexp_extract(F.left(F.get(pieces, i + 1), F.lit(CONTEXT)), r"[^\x20\x09-\x0D]+", 0)
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("size"),
                            _valid(kind, m).alias("ok"), F.xxhash64(F.lower(m)).alias("token"), _class(kind, m).alias("class"),
                            F.lower(F.array_join(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), 2), " ")).alias("left"),
                            F.lower(after).alias("right"))

        return F.transform(found, one)

    pair = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean,token:bigint,class:string,left:string,right:string>>")
    return F.when(_possible(kind, text), let(pair, build)).otherwise(none)


def _spans(scanned: DataFrame) -> DataFrame:
    """Rows (row, kind, start, end, token, class, left, right) of valid matches and candidates."""
    order = Window.partitionBy("row", "kind").orderBy("i")
    begin = F.sum("gap").over(order) + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (scanned.select("row", F.explode("found").alias("x")).select("row", "x.*")
            .withColumn("start", begin).withColumn("end", F.col("start") + F.col("size")).where("ok")
            .drop("ok", "i", "gap", "size"))


def _free(spans: DataFrame) -> DataFrame:
    """Without candidates that overlap a span of the base; one candidate for each place, of kind _CANDIDATE."""
    order = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < _CANDIDATE
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return (spans.withColumn("reach", F.coalesce(reach, F.lit(-1))).withColumn("following", F.coalesce(next_start, F.lit(2**62)))
            .where(base | ((F.col("reach") <= F.col("start")) & (F.col("following") >= F.col("end"))))
            .withColumn("same", F.row_number().over(Window.partitionBy("row", "start", "end").orderBy("kind")))
            .where(base | (F.col("same") == 1)).withColumn("kind", F.least("kind", F.lit(_CANDIDATE))).drop("reach", "following", "same"))


def bootstrap(spans: DataFrame, rounds: int = 3, threshold: float = 0.75, support: int = 3) -> DataFrame:
    """(token, kind, score) of tokens that contexts show to be entities of a kind.

    `spans` has kind (below 4: a seed of that kind; 4: a candidate), token, class, left, right. A
    pattern needs `support` distinct known tokens. Its score is known weight / (occurrences + 1).
    """
    last = F.element_at(F.split("left", " "), -1)
    patterns = F.array(F.when(F.col("left") != "", F.concat_ws("\x01", F.lit("before"), last, "class")),
                       F.when(F.col("left").contains(" "), F.concat_ws("\x01", F.lit("before2"), "left", "class")),
                       F.when(F.col("right") != "", F.concat_ws("\x01", F.lit("after"), "right", "class")))
    seen = cut(spans.select("kind", "token", F.explode(patterns).alias("pattern")).where("pattern is not null")
               .groupBy(F.xxhash64("pattern").alias("pattern"), "token", "kind").agg(F.count("*").alias("times")))
    # a pattern without a candidate finds nothing, one without a known token never starts
    seeds = cut(seen.where(F.col("kind") < _CANDIDATE).groupBy("token", "kind").agg(F.lit(1.0).alias("score")))
    known = seeds
    for _ in range(rounds):
        totals = seen.groupBy("pattern").agg(F.sum("times").alias("all"))
        scored = (seen.groupBy("pattern", "token").agg(F.sum("times").alias("times")).join(known, "token")
                  .groupBy("pattern", "kind").agg(F.sum(F.col("times") * F.col("score")).alias("weight"), F.count("*").alias("tokens"))
                  .where(F.col("tokens") >= support).join(totals, "pattern")
                  .select("pattern", "kind", (F.col("weight") / (F.col("all") + 1)).alias("score")).where(F.col("score") >= threshold))
        fresh = (seen.where(F.col("kind") == _CANDIDATE).select("pattern", "token").join(scored, "pattern")
                 .groupBy("token").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
                 .select("token", (-F.col("best.k")).alias("kind"), F.col("best.score").alias("score"))
                 .join(seeds.select("token"), "token", "left_anti"))
        known = cut(seeds.unionByName(fresh))
    return known


def find_pii(docs: DataFrame, key: Column, text_col: str = "text", rounds: int = 3, threshold: float = 0.75,
             support: int = 3) -> tuple[DataFrame, DataFrame]:
    """(one row per row of `docs`: row, _keep; spans: row, kind, start, end, base).

    `key` names rows; rows that share it must have the same text. Positions are code points, the end
    exclusive. Spans of the base may overlap one another, as their kinds are matched apart; new
    spans overlap none of them, and none of them lies inside another.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    scanned = cut(docs.select(key.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_keep"),
                              F.concat(*[_matches(kind, text) for kind in range(len(_PATTERNS))]).alias("found")))
    spans = cut(_free(_spans(scanned)))
    known = bootstrap(spans, rounds, threshold, support).select("token", F.col("kind").alias("as_kind"))
    base = spans.where(F.col("kind") < _CANDIDATE).select("row", "kind", "start", "end", F.lit(True).alias("base"))
    new = (spans.where(F.col("kind") == _CANDIDATE).join(known.groupBy("token").agg(F.min("as_kind").alias("as_kind")), "token")
           .select("row", F.col("as_kind").alias("kind"), "start", "end", F.lit(False).alias("base")))
    # of a number and its groups the longest stays
    longer = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reach", F.max("end").over(longer)).where("reach is null or end > reach").drop("reach")
    return scanned.select("row", "_keep"), cut(base.unionByName(new))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of `docs`: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    base_sha256 is over `kind:start:end` of the base's spans by start, then kind, joined by commas;
    spans lists all spans so; n_found counts the new ones. Null text is empty. Rows are numbered, so
    null and repeated ids are no matter. Empty table: empty result. Other columns are ignored.
    """
    rows, spans = find_pii(docs.select(id_col, text_col), F.monotonically_increasing_id(), text_col, **options)
    item = F.struct("start", "kind", "end")
    per_row = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.collect_list(F.when(F.col("base"), item)).alias("own"), F.collect_list(item).alias("every"))
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    own, every = F.coalesce("own", none), F.coalesce("every", none)
    return rows.join(per_row, "row", "left").select(
        F.col(f"_keep.{id_col}").alias(id_col), *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(own), 256).alias("base_sha256"), _joined(every).alias("spans"),
        (F.size(every) - F.size(own)).cast("long").alias("n_found"))


def redact_pii(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets, such as `<email>`.

    Columns and their order stay; n_chars, if there, becomes the new length. Texts without a span,
    null texts among them, are unchanged. Equal texts are scanned once; a span that reaches into the
    one before is cut at its end. Empty table: empty result.
    """
    kinds = dict(docs.dtypes)
    text = F.col(f"`{text_col}`").cast("string")
    maybe = F.coalesce(text.rlike("[0-9]") | _possible(_SPELLED, text), F.lit(False))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.sha2(text, 256).alias("row"), maybe.alias("maybe"))
    texts = docs.where(maybe).select(text.alias("text"), F.sha2(text, 256).alias("key")).dropDuplicates(["key"])
    _, spans = find_pii(texts, F.col("key"), "text", **options)
    order = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    apart = (spans.withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(order), F.lit(0).cast("long"))))
             .where("start < end").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts")))
    apart = cut(apart)
    apart = F.broadcast(apart) if apart.count() <= BROADCAST_TEXTS else apart     # texts are shuffled only for many
    source = F.col(f"doc.`{text_col}`").cast("string")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def piece(i: Column) -> Column:
        begin = F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(F.lit(0).cast("long"))
        end = F.get("cuts", i)["start"]
        return F.when(i < F.size("cuts"), F.concat(source.substr((begin + 1).cast("int"), (end - begin).cast("int")), F.get(names, F.get("cuts", i)["kind"]))
                      ).otherwise(source.substr((begin + 1).cast("int"), F.length(source)))

    cleaned = F.array_join(F.transform(F.sequence(F.lit(0), F.size("cuts")), piece), "")
    joined = packed.where("maybe").join(apart, "row", "left").withColumn("text", F.when(F.col("cuts").isNull(), source).otherwise(cleaned))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("text").cast(kinds[name]).alias(name)
        if name == "n_chars":
            return F.when(F.col("cuts").isNull(), F.col("doc.n_chars")).otherwise(F.length("text")).cast(kinds[name]).alias(name)
        return F.col(f"doc.`{name}`").alias(name)

    return packed.where("not maybe").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns]).unionByName(
        joined.select(*[column(c) for c in docs.columns]))
