"""Quality classifier: document evidence combined with what its host and path are like.

A logistic model on hashed words and a few shape features, fitted on a bounded sample of labelled
documents, gives every document a log-odds of being good. Hierarchical empirical Bayes does the rest:
the mean probability of all documents is the prior of hosts, a host's posterior mean is the prior of
its paths, and a path's posterior mean is the prior of its documents. How strongly each level is drawn
to the one above follows from the variance between its groups, so a site with few documents stays
close to the general rate and one with many speaks for itself. A document's own evidence does not
count towards its prior.

The corpus is read for the evidence, aggregated per task, and the groups' sums come back by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.base import free_memory, sliced
from recordloom.llm.bytewords import U64, alnum_words, buffer_of, words_of
from recordloom.session import cut

#: Labelled documents that the model is fitted on, about; the bound of what comes to the driver.
SAMPLE = 20_000
#: Groups of (host, path) that are broadcast at most; beyond, documents are joined by a shuffle.
BROADCAST_GROUPS = 100_000
_BITS = 18
_SHAPES = 7


@dataclass
class Model:
    weights: np.ndarray      # of each hashed word
    shape_weights: np.ndarray
    mean: np.ndarray         # of the shape features in the sample
    scale: np.ndarray
    bias: float


def _features(column: pa.Array):
    """(row, hashed word) once per row, by row; shape features."""
    words = words_of(column, alnum_words(), lower=True)
    rows = len(words.first) - 1
    owner = np.repeat(np.arange(rows), words.counts)
    cell = (words.code >> U64(64 - _BITS)).astype(np.int64)
    both = np.unique((owner << _BITS) | cell)
    row, cell = both >> _BITS, both & ((1 << _BITS) - 1)
    data, offsets = buffer_of(column)

    def share(wanted) -> np.ndarray:
        flag = np.zeros(256, np.int64)
        flag[list(wanted)] = 1
        total = np.concatenate(([0], np.cumsum(flag[data])))
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)

    n = np.maximum(words.counts, 1)
    length = np.bincount(owner, weights=words.end - words.start, minlength=rows)
    shape = np.stack([share(b"#*$%&<>"), share(b"|"), share(b"!"), share(range(0x41, 0x5B)), np.log1p(words.counts), length / n,
                      np.bincount(row, minlength=rows) / n], axis=1)
    return row, cell, shape


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    row, cell, shape = _features(column)
    word = np.bincount(row, weights=model.weights[cell], minlength=len(column))
    return word + ((shape - model.mean) / model.scale) @ model.shape_weights + model.bias


def fit(row: np.ndarray, cell: np.ndarray, shape: np.ndarray, good: np.ndarray, steps: int = 400, ridge: float = 0.1) -> Model:
    """Logistic regression by full-batch steps with per-weight rates (Adam)."""
    mean, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    x = (shape - mean) / scale
    size = 1 << _BITS
    rate = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    # words that are in enough documents, and in good or bad ones more than chance explains
    seen, liked = np.bincount(cell, minlength=size), np.bincount(cell, weights=good[row], minlength=size)
    apart = np.abs(liked - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    tells = (seen >= 8) & (apart >= 4)
    row, cell = row[tells[cell]], cell[tells[cell]]
    theta = np.zeros(size + x.shape[1] + 1)
    theta[-1] = np.log(rate / (1 - rate))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=theta[cell], minlength=len(good)) + x @ theta[size:-1] + theta[-1]
        wrong = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - good) / len(good)
        slope = np.concatenate((np.bincount(cell, weights=wrong[row], minlength=size), x.T @ wrong, [wrong.sum()]))
        slope[:-1] += ridge / len(good) * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        theta -= 0.05 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
    return Model(theta[:size], theta[size:-1], mean, scale, float(theta[-1]))


class QualityClassifier:
    """`fit` learns the model and the group rates from a corpus; `judge` gives verdicts.

    `labels` has one or more rows (id, quality 0/1, toxic 0/1) for some documents; good means quality
    without toxicity, by the mean of a document's labels. Rows with null ids or values are left out.
    Without good or without bad labels the evidence is 0 for every document and all are accepted.
    """

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
                 sample: int = SAMPLE, threshold: float = 0.5):
        self.id_col, self.text_col, self.host_col, self.path_col = id_col, text_col, host_col, path_col
        self.sample, self.threshold = sample, threshold

    def fit_model(self, docs: DataFrame, labels: DataFrame) -> QualityClassifier:
        marked = (labels.groupBy(F.col(self.id_col).cast("long").alias("k"))
                  .agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
                  .where("k is not null and quality is not null")
                  .select("k", ((F.col("quality") >= 0.5) & (F.coalesce("toxic", F.lit(0.0)) < 0.5)).alias("good")))
        count = marked.count()
        share = min(1.0, self.sample / max(count, 1))
        picked = marked.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(share * 1_000_000))   # about `sample` rows
        texts = docs.select(F.col(self.id_col).cast("long").alias("k"), F.col(self.text_col).cast("string").alias("text")).join(F.broadcast(picked), "k")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free_memory()
            for batch in sliced(batches, "text"):
                row, cell, shape = _features(batch.column("text"))
                border = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.record_batch({
                    "k": batch.column("k"), "good": batch.column("good"),
                    "words": pa.ListArray.from_arrays(pa.array(border), pa.array(cell.astype(np.int32))),
                    "shape": pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * _SHAPES), pa.array(shape.reshape(-1)))})

        table = texts.mapInArrow(run, "k long, good boolean, words array<int>, shape array<double>").toArrow().combine_chunks()
        table = table.sort_by("k")
        good = table["good"].to_numpy().astype(np.float64)
        if not len(good) or good.all() or not good.any():
            self.model = Model(np.zeros(1 << _BITS), np.zeros(_SHAPES), np.zeros(_SHAPES), np.ones(_SHAPES), 0.0)
            return self
        words = table["words"].combine_chunks()
        size = np.diff(words.offsets.to_numpy())
        self.model = fit(np.repeat(np.arange(len(good)), size), words.flatten().to_numpy().astype(np.int64),
                         table["shape"].combine_chunks().flatten().to_numpy().reshape(-1, _SHAPES), good)
        return self

    def evidence(self, docs: DataFrame) -> DataFrame:
        """`docs` as columns doc (a struct of all columns but the text), text, host, path, evidence (log-odds)."""
        model = docs.sparkSession.sparkContext.broadcast(self.model)
        rest = [F.col(f"`{c}`") for c in docs.columns if c != self.text_col]
        packed = docs.select(F.struct(*rest or [F.lit(None).alias("_none")]).alias("doc"), F.col(self.text_col).cast("string").alias("text"),
                             F.coalesce(F.col(self.host_col).cast("string"), F.lit("")).alias("host"),
                             F.coalesce(F.col(self.path_col).cast("string"), F.lit("")).alias("path"), F.lit(0.0).alias("evidence"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free_memory()
            for batch in sliced(batches, "text"):
                score = np.round(_scores(model.value, batch.column("text")), 9)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], schema=batch.schema)

        return packed.mapInArrow(run, packed.schema)

    def fit_rates(self, evidence: DataFrame) -> QualityClassifier:
        """Group sums of the corpus and the strength of each prior, from host, path and evidence."""
        own = _probability(F.col("evidence"))
        self.paths = cut(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(own).alias("s")))
        self.hosts = cut(self.paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")))
        total = self.hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.count("*").alias("hosts")).first()
        n = total["n"] or 0
        self.rate = min(max((total["s"] or 0.5) / max(n, 1), 1e-4), 1 - 1e-4)
        spread = self.hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_s") / F.col("host_n") - self.rate, 2)).alias("v")).first()["v"] or 0.0
        self.host_strength = _strength(self.rate * (1 - self.rate), spread, n, total["hosts"] - 1 if n else 0)
        inner = self.paths.join(self.hosts, "host").agg(
            F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n"), 2)).alias("v"), F.count("*").alias("groups")).first()
        self.path_strength = _strength(self.rate * (1 - self.rate), inner["v"] or 0.0, n, inner["groups"] - (total["hosts"] or 0))
        return self

    def judge(self, evidence: DataFrame) -> DataFrame:
        """`evidence` with prior, posterior and accepted."""
        groups = cut(self.paths.join(self.hosts, "host"))
        picked = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
        own = _probability(F.col("evidence"))
        host = (self.host_strength * self.rate + F.col("host_s") - own) / (self.host_strength + F.col("host_n") - 1)
        prior = (self.path_strength * host + F.col("s") - own) / (self.path_strength + F.col("n") - 1)
        prior = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), prior))
        shift = F.log(prior / (1 - prior)) - float(np.log(self.rate / (1 - self.rate)))
        return (evidence.join(picked, ["host", "path"]).withColumn("prior", F.round(prior, 6))
                .withColumn("posterior", F.round(_probability(F.col("evidence") + shift), 6))
                .withColumn("accepted", F.col("posterior") >= self.threshold)
                .drop("n", "s", "host_n", "host_s"))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))


def _strength(within: float, spread: float, n: int, degrees: int) -> float:
    """Documents that a prior counts for: by the variance between groups beyond that of chance."""
    if not n or degrees <= 0:
        return 1e6
    between = max(spread / n - within * degrees / n, 1e-9)
    return float(min(max(within / between - 1, 10.0), 1e6))


def rate_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of `docs`: id, host, path, evidence, prior, posterior, accepted.

    Null or empty text: judged by its shape and its site. Null host or path: the empty one. Null ids
    and repeated rows are judged like others. Empty table: empty result. Other columns are ignored.
    """
    judge = QualityClassifier(**options)
    wanted = list(dict.fromkeys([judge.id_col, judge.text_col, judge.host_col, judge.path_col]))
    judge.fit_model(docs, labels)
    seen = cut(judge.evidence(docs.select(*wanted)).select(F.col(f"doc.`{judge.id_col}`").alias("_id"), "host", "path", "evidence"))
    return judge.fit_rates(seen).judge(seen).select(F.col("_id").alias(judge.id_col), "host", "path", "evidence", "prior", "posterior", "accepted")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are accepted, all columns unchanged; rules as in `rate_quality`."""
    judge = QualityClassifier(**options)
    judge.fit_model(docs, labels)
    judge.fit_rates(cut(judge.evidence(docs).select("host", "path", "evidence")))
    kinds = dict(docs.dtypes)
    kept = judge.judge(judge.evidence(docs)).where("accepted")
    return kept.select(*[F.col("text").cast(kinds[c]).alias(c) if c == judge.text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
