"""URL filter: host and path rules first, then the ratio of two character language models.

The URLs that rules accept and those that rules reject each train a variable-order Markov model: the
probability of a character after the last `order` ones is its count there, smoothed with that after
one character less, and so on down to a uniform one. A URL without a rule is judged by the mean log
ratio per character, against a threshold calibrated on the URLs with rules.

Only DataFrame functions. Substrings are counted per task before they are shuffled, so a substring
that every URL has costs a row per task; the models hold one row per distinct substring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.base import let
from recordloom.session import cut

#: Character substrings that are broadcast at most; with more, scores are joined by a shuffle.
BROADCAST_GRAMS = 300_000
#: Weight of the shorter context, and of the uniform model over this many characters.
SMOOTHING, CHARACTERS = 2.0, 256.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _rule(host: Column, path: Column, rules: list[tuple[str, str]], value: int) -> Column:
    """The longest fitting rule (value 0: its text, 1: its verdict), null without one."""
    out = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit((text, verdict)[value])).otherwise(out)
    return out


def _substrings(url: Column, order: int, shortest: int) -> Column:
    """Substrings of up to order + 1 characters that end at each character or at the end mark."""
    padded = F.concat(F.lit(_START * order), url, F.lit(_END))

    def at(text: Column) -> Column:
        ends = F.sequence(F.lit(order if shortest == 1 else order + 1), F.length(text))
        return F.flatten(F.transform(ends, lambda e: F.array(*[
            F.when(e >= n, text.substr(e - n + 1, F.lit(n))) for n in range(shortest, order + 2)])))

    return F.filter(let(padded, at), lambda g: g.isNotNull())


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               order: int = 3) -> DataFrame:
    """Per row of `pages`: id, host, path, rule, verdict, score.

    `rules` are ("host/path-prefix", "allow" or "block") pairs; a rule fits its host and all
    subdomains if the path starts with its path, the longest one wins. Without a rule the verdict is
    the method's: allow if the score reaches the threshold. score is the mean log ratio per character.

    Null URL or one without `://`: empty host and path, judged by the method like any other (null
    counts as empty). Repeated URLs train as often as they occur and get the same score. If rules
    accept or reject nothing, there is no second model and everything else is allowed with score 0.
    Empty table: empty result. Other columns are ignored; a null id is kept.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    named = cut(pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                             host.alias("host"), path.alias("path"))
                .withColumn("rule", _rule(F.col("host"), F.col("path"), rules, 0))
                .withColumn("by_rule", _rule(F.col("host"), F.col("path"), rules, 1)))
    urls = named.groupBy("url").agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("good"),
                                    F.count(F.when(F.col("by_rule") == "block", 1)).alias("bad"))
    counts = cut(urls.where("good + bad > 0")
                 .select("good", "bad", F.explode(_substrings(F.col("url"), order, 1)).alias("gram"))
                 .groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    totals = counts.where((F.length("gram") == 1) & (F.col("gram") != _START)).agg(
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    final = [F.col("_id").alias(id_col), "host", "path", "rule"]
    if not totals["good"] or not totals["bad"]:
        return named.select(*final, F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    ratios = cut(_ratios(urls, counts, totals, order))
    parts = urls.select("url", F.explode(_substrings(F.col("url"), order, order + 1)).alias("gram"))
    picked = F.broadcast(ratios) if ratios.count() <= BROADCAST_GRAMS else ratios
    scores = cut(parts.join(picked, "gram").groupBy("url").agg(F.round(F.avg("ratio"), 6).alias("score")))
    # the threshold stands as many deviations below the accepted mean as above the rejected one
    both = (named.where("by_rule is not null").groupBy("url", "by_rule").count().join(scores, "url")
            .groupBy("by_rule").agg((F.sum(F.col("count") * F.col("score")) / F.sum("count")).alias("mean"),
                                    (F.sum(F.col("count") * F.col("score") * F.col("score")) / F.sum("count")).alias("square")))
    found = {r["by_rule"]: (r["mean"], max(r["square"] - r["mean"] ** 2, 1e-9) ** 0.5) for r in both.collect()}   # two rows
    (good, wide), (bad, narrow) = found["allow"], found["block"]
    threshold = (good * narrow + bad * wide) / (wide + narrow)
    return named.join(scores, "url").select(
        *final, F.coalesce("by_rule", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")


def _ratios(urls: DataFrame, counts: DataFrame, totals, order: int) -> DataFrame:
    """(gram, ratio): log P(last character | characters before) under one model minus the other."""
    grams = urls.select(F.explode(_substrings(F.col("url"), order, order + 1)).alias("full")).distinct()
    # what a gram is judged by: its suffixes, and each suffix without the last character
    looked = grams.select("full", F.explode(F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(last).alias("last"), F.col("full").substr(order + 2 - n, n - 1 + last).alias("gram"))
        for n in range(1, order + 2) for last in (0, 1) if n - 1 + last > 0])).alias("part")).select("full", "part.*")
    found = looked.join(counts, "gram", "left").groupBy("full").agg(*[
        F.coalesce(F.max(F.when((F.col("n") == n) & (F.col("last") == last), F.col(side))), F.lit(0)).alias(f"{side}{n}_{last}")
        for n in range(1, order + 2) for last in (0, 1) if n - 1 + last > 0 for side in ("good", "bad")])

    def probability(side: str) -> Column:
        value = F.lit(1.0 / CHARACTERS)
        for n in range(1, order + 2):
            context = F.lit(float(totals[side])) if n == 1 else F.col(f"{side}{n}_0")
            value = (F.col(f"{side}{n}_1") + SMOOTHING * value) / (context + SMOOTHING)
        return value

    return found.select(F.col("full").alias("gram"), (F.log(probability("good")) - F.log(probability("bad"))).alias("ratio"))
