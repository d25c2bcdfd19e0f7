"""Quality rules on words and lines, and removal of lines that many documents of a host share.

Lines are normalised and hashed; the distinct lines of each document are counted per host. Lines that
more documents have than the limit are boilerplate there, and a document that they make up too much
of, is rejected as depleted.

Only DataFrame functions. Counting works on one row per document and distinct line, added up per task
before the shuffle; the frequent lines come back to their documents over a join on (host, line) that
Spark can split where one line is in a third of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.base import let
from recordloom.session import cut

_BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def repeated_words(text: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that the text holds twice or more, the first one included."""
    def count(codes: Column) -> Column:
        n = F.size(codes)

        def covered(names: Column) -> Column:
            # names beside each other after sorting tell which positions repeat
            ranked = F.array_sort(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def positions(r: Column) -> Column:
                hits = F.filter(r, lambda x, i: (x["h"] == F.get(r, i - 1)["h"]) | (x["h"] == F.get(r, i + 1)["h"]))
                return F.array_sort(F.transform(hits, lambda x: x["i"]))

            total = F.aggregate(let(ranked, positions), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                                lambda a, i: F.struct((a["n"] + width - F.greatest(F.lit(0), a["to"] - i)).alias("n"), (i + width).alias("to")))["n"]
            return F.when(F.size(F.array_distinct(names)) == F.size(names), F.lit(0)).otherwise(total)

        names = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(codes, i + j) for j in range(width)]))
        return F.when(n > width, let(names, covered)).otherwise(F.lit(0))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), count).cast("long")


def line_key(line: Column) -> Column:
    """A line without case, digits and outer or repeated blanks, as the text that is hashed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), _BLANK, " "))


def base_rules(text: Column) -> dict[str, Column]:
    """The plain counts of a text that is not null."""
    visible = F.regexp_replace(text, _BLANK, "")
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))

    def duplicates(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    return {"n_words": F.size(words(text)).cast("long"), "word_chars": F.length(visible).cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), duplicates).cast("long"),
            "n_repeat_words": repeated_words(text)}


def _lines(text: Column) -> Column:
    """Every line with a word, in order: its hash and its words."""
    visible = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(visible, lambda x: F.struct(F.xxhash64(line_key(x)).alias("line"), F.size(words(x)).alias("words")))


def rate_lines(docs: DataFrame, max_documents: int = 50, max_removed: float = 0.5, id_col: str = "doc_id",
               text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row of `docs`: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_common_words, kept.

    base_failed: under 10 words, or over 20 % of them in repeated 5-word windows. A line is common if
    more than `max_documents` rows of its host have it; kept is false for failed documents and for
    those of whose words common lines hold more than the share `max_removed`.

    Null or blank text: no words, failed. Null host: a host of its own. Each row counts as a document,
    so repeated rows count and are all judged alike; a null id is kept. Empty table: empty result.
    Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(host_col).cast("string")).alias("host"), text.alias("text"))
    # written once: the row number stays what it is, and texts are read once
    rated = cut(rows.select(F.monotonically_increasing_id().alias("row"), "_id", "host",
                            *[c.alias(n) for n, c in base_rules(F.col("text")).items()], _lines(F.col("text")).alias("lines")))
    common = (rated.select("host", F.explode(F.array_distinct("lines")).alias("x")).select("host", "x.line")
              .groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents))
    lost = (rated.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
            .join(common, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("words").alias("n_common_words")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    in_common = F.coalesce("n_common_words", F.lit(0).cast("long"))
    return (rated.drop("lines").join(lost, "row", "left")
            .select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), in_common.alias("n_common_words"),
                    (~failed & (in_common <= F.col("n_words") * max_removed)).alias("kept")))


def remove_common_lines(docs: DataFrame, max_documents: int = 50, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """`docs` with the lines taken out that more than `max_documents` rows of their host have.

    Columns stay, n_chars, if there, becomes the new length. Null texts and texts without such lines
    are unchanged. Rules for hosts, repeats and empty tables are those of `rate_lines`. The common
    lines of a text come back as a map of their hashes, so a document never has to fit more than once.
    """
    kinds = dict(docs.dtypes)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = cut(source.select(F.monotonically_increasing_id().alias("row"), "doc")
                .withColumn("text", F.coalesce(F.col(f"doc.`{text_col}`").cast("string"), F.lit("")))
                .withColumn("host", F.xxhash64(F.col(f"doc.`{host_col}`").cast("string"))))
    lines = keyed.select("row", "host", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: x["line"]))).alias("line"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents)
    gone = lines.join(common, ["host", "line"], "left_semi").groupBy("row").agg(F.collect_set("line").alias("gone"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(line_key(x)))), "\n")
    joined = keyed.join(gone, "row", "left").withColumn("left", F.when(F.col("gone").isNull(), F.col(f"doc.`{text_col}`")).otherwise(left))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("left").cast(kinds[name]).alias(name)
        if name == "n_chars":
            return F.when(F.col("gone").isNull(), F.col("doc.n_chars")).otherwise(F.length("left")).cast(kinds[name]).alias(name)
        return F.col(f"doc.`{name}`").alias(name)

    return joined.select(*[column(c) for c in docs.columns])
