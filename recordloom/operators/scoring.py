"""Extension points: a caller's scorer or extractor over rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.base import quiet_double
from recordloom.functions.text import first_json
from recordloom.session import cut


def score_batches(df: DataFrame, reply: Callable[[pd.DataFrame], pd.Series], cache: DataFrame,
                  key: str = "doi") -> tuple[DataFrame, DataFrame]:
    """(scored rows, new cache entries). ``reply`` gives one reply text per row of a batch.

    Cached ids are not asked again. The score is the ``relevance`` of the reply's JSON, kept in
    [0, 1]; a reply without it stays NULL and is not cached.
    """
    todo = df.join(cache.select(key), key, "left_anti")
    schema = T.StructType(todo.schema.fields + [T.StructField("reply", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(reply=list(reply(pdf)))

    body = F.from_json(first_json(F.col("reply")), "relevance string, reason string")
    value = quiet_double(body["relevance"])
    # written once: both results read it, and the caller's model is asked only once
    asked = cut(todo.mapInPandas(run, schema)
             .withColumn("relevance", F.when(value.isNotNull(), F.least(
                 F.greatest(value, F.lit(0.0)), F.lit(1.0))))
             .withColumn("relevance_reason", F.when(
                 value.isNotNull(), F.coalesce(body["reason"], F.lit(""))))
             .drop("reply"))
    known = df.join(cache.select(key, "relevance", "relevance_reason"), key)
    fresh = asked.filter("relevance is not null").select(key, "relevance", "relevance_reason")
    return known.unionByName(asked), fresh


def extract_batches(df: DataFrame, extract: Callable[[pd.DataFrame], pd.Series], keys: list[str],
                    item: str, gate: DataFrame | None = None) -> DataFrame:
    """One row per item a caller's extractor finds.

    ``extract`` gives a list of dicts per row; anything else in the list is dropped. ``item`` is
    the DDL of an item. With ``gate`` only rows whose keys an earlier pass found are sent.
    """
    if gate is not None:
        df = df.join(gate.select(*keys).distinct(), keys, "left_semi")
    fields = T.StructType.fromDDL(item)
    schema = T.StructType([df.schema[k] for k in keys]
                          + [T.StructField("item_no", T.IntegerType())] + fields.fields)
    names = [f.name for f in fields.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row, items in zip(pdf[keys].itertuples(index=False), extract(pdf)):
                good = [i for i in items if isinstance(i, dict)]
                rows += [(*row, n, *[i.get(c) for c in names]) for n, i in enumerate(good)]
            yield pd.DataFrame(rows, columns=[*keys, "item_no", *names])

    return df.mapInPandas(run, schema)
