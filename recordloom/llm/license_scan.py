"""Licence scan with a positional index of rare licence words.

How many documents have each licence word is counted over all documents. The highest-IDF words of each
template are looked up in a file: every occurrence proposes the place where the template would begin,
and all words of the template are compared there. A template counts if enough of its weight agrees and
its mandatory phrase stands in the text.

Only DataFrame functions. The templates are a parameter of fixed size, so the index and the counts of
its words are small whatever the corpus is; files without a mandatory phrase leave at once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.base import let
from recordloom.session import cut

# Labels and phrases of the base.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: (label, template words, mandatory phrase); opening sentences and common notices of public licences.
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text, one blank before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text.cast("string"), F.lit("")), F.lit(" ")), _GAP, " ")


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _base(flat: Column, phrase: str) -> Column:
    """(places, first and last word) of a phrase of the base; no phrase overlaps itself."""
    parts = F.split(flat, f"(?i)(?<= ){phrase}(?= )", -1)
    n = F.size(parts).cast("long") - 1
    return F.when(flat.rlike(f"(?i) {phrase} "), F.struct(
        n.alias("n"), (_blanks(F.get(parts, F.lit(0))) - 1).alias("first"),
        (_blanks(flat) - 1 - (_blanks(F.element_at(parts, -1)) - 1) - len(phrase.split())).alias("last")))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, least_share: float = 0.6,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. n_base counts the places of the
    base's phrases, first_word and last_word are their least and largest start (null without one).
    A template adds its label if words with at least `least_share` of its IDF weight stand in their places
    from one begin on, and its mandatory phrase is in the text. score is 1 with a base phrase, else the
    best share of a template that counts, else 0.

    Begins are proposed by the rarest words of each template, as many as every begin that counts must
    hold one of, and verified by all its words; so none is missed. Every file in which a mandatory
    phrase stands is looked up. Null text: no words. Rows are scanned one by one, so null ids and
    repeated rows are kept as they are. Empty table: empty result. Other columns are ignored.
    """
    vocabulary = sorted({w for _, words, _ in templates for w in words.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    flat = spaced(F.col(text_col))
    # at most as many rows as the templates have words
    total = docs.count()
    counts = {r["word"]: r["n"] for r in docs.select(
        F.explode(F.array_intersect(F.split(F.lower(flat), " "), known)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    weight = {w: float(_log(total, counts.get(w, 0))) for w in vocabulary}
    # holds for all files with a phrase: lower() changes A-Z as translate does
    hopeful = let(F.lower(F.col("flat")), lambda low: reduce(or_, [low.contains(f" {p} ") for p in dict.fromkeys(p for _, _, p in templates)], F.lit(False)))

    rows = docs.select(F.col(id_col).alias("_id"), flat.alias("flat"))
    texts = [text.split() for _, text, _ in templates]
    whole = [sum(weight[w] for w in words) for words in texts]
    index = [(t, at, texts[t][at]) for t in range(len(texts)) for at in _proposing([weight[w] for w in texts[t]], least_share)]

    def fixed(rows: list[list[Column]], kind: str) -> Column:
        return F.array(*[F.struct(*row) for row in rows]).cast(f"array<struct<{kind}>>")

    anchors = fixed([[F.lit(x) for x in row] for row in index], "template:int,place:int,word:string")
    contents = F.array(*[fixed([[F.lit(at), F.lit(w), F.lit(weight[w])] for at, w in enumerate(words)],
                               "place:int,word:string,weight:double") for words in texts])
    labels = F.array(*[F.lit(label) for label, _, _ in templates])
    totals = F.array(*[F.lit(w or 1.0) for w in whole])

    def look(low: Column) -> Column:
        phrases = F.filter(F.array(*[F.when(low.contains(f" {phrase} "), F.lit(i)) for i, (_, _, phrase) in enumerate(templates)]),
                           lambda x: x.isNotNull())
        return F.when(F.size(phrases) > 0, let(F.struct(phrases.alias("phrases"), F.split(F.trim(low), " ").alias("words")), verified))

    def verified(pair: Column) -> Column:
        words = pair["words"]

        def proposed(x: Column) -> Column:
            places = F.filter(F.transform(words, lambda w, i: F.when(w == x["word"], i)), lambda i: i.isNotNull())
            return F.transform(places, lambda i: F.struct(x["template"].alias("template"), (i - x["place"]).alias("begin")))

        def agreed(x: Column) -> Column:
            weight = F.aggregate(F.get(contents, x["template"]), F.lit(0.0), lambda a, y: a + F.when(
                F.get(words, x["begin"] + y["place"]) == y["word"], y["weight"]).otherwise(0.0))
            return F.struct(F.get(labels, x["template"]).alias("label"), F.round(weight / F.get(totals, x["template"]), 6).alias("share"))

        begins = F.flatten(F.transform(F.filter(anchors, lambda x: F.array_contains(pair["phrases"], x["template"])), proposed))
        return F.filter(F.transform(begins, agreed), lambda x: x["share"] >= least_share)

    scanned = cut(rows.select("_id", (_blanks(F.col("flat")) - 1).alias("n_words"),
                              F.array(*[_base(F.col("flat"), phrase) for _, phrase in BASE]).alias("base"),
                              F.when(hopeful, let(F.translate("flat", _UPPER, _LOWER), look)).alias("found")))
    more, share = F.array_distinct(F.transform("found", lambda x: x["label"])), F.array_max(F.transform("found", lambda x: x["share"]))
    none = F.array().cast("array<string>")
    held = F.filter(F.array(*[F.when(F.col("base")[i].isNotNull(), F.lit(label)) for i, (label, _) in enumerate(BASE)]), lambda x: x.isNotNull())
    return scanned.select(
        F.col("_id").alias(id_col), "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n"], F.lit(0).cast("long"))).alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
        F.array_join(F.array_sort(held), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(held, F.coalesce(more, none))), ",").alias("labels"),
        F.when(F.size(held) > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))).alias("score"))


def _proposing(weights: list[float], least_share: float) -> list[int]:
    """The heaviest places of a template that together weigh more than may be missing."""
    places, left = [], (1 - least_share + 1e-6) * sum(weights)      # shares are rounded to 6 digits
    for at in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        if left < 0:
            break
        places.append(at)
        left -= weights[at]
    return places


def _log(total: int, count: int) -> float:
    from math import log

    return log((total + 1) / (count + 1)) + 1e-3
