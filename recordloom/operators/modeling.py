"""Gap analysis, Pareto fronts, feature matrices and tree models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.ordering import dense_index
from recordloom.operators.stats import pivot_mean_count
from recordloom.session import cut


#: Most combinations that are built and category values that are encoded; rows, and cells of binned features, of one task of a fit.
MOST_COMBINATIONS, MOST_CATEGORIES, TASK_ROWS, TASK_CELLS = 1_000_000_000, 100_000, 200_000, 4_000_000


def gap_candidates(df: DataFrame, dims: list[str], at_most: int = 0,
                   most: int = MOST_COMBINATIONS) -> DataFrame:
    """Combinations of the seen values of ``dims`` that occur at most ``at_most`` times.

    The result is a product of the dimensions by definition. Its size is known before it is built;
    beyond ``most`` this raises, so that a dimension can be narrowed to the slice of interest. The number line 0 .. n1*n2*…-1 is decoded into one value per dimension by equi joins, so the
    combinations are made evenly on all tasks and no side is crossed with another.
    """
    indexed = {d: dense_index(df.filter(F.col(d).isNotNull()), d, "_i") for d in dims}
    sizes = [v.count() for v in indexed.values()]
    total = 1
    for s in sizes:
        total *= s
    if total > most:
        raise ValueError(f"{total} combinations of {dims}; at most {most}")
    grid, stride = df.sparkSession.range(total), 1
    for (d, values), size in zip(indexed.items(), sizes):
        grid = grid.withColumn("_i", F.floor(F.col("id") / stride) % size).join(
            values, "_i").drop("_i")
        stride *= size
    seen = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    return (grid.drop("id").join(seen, dims, "left")
            .withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") <= at_most))


def open_gaps(df: DataFrame, dims: list[str], most: int = MOST_CATEGORIES) -> DataFrame:
    """Combinations that never occur, as a complement: (dims, depth).

    A row says that the first `depth` dimensions hold values that are seen, and the first `depth` - 1
    of them are seen together, but never with the last one; the dimensions after it are open (NULL).
    So an absent prefix is listed once and stands for everything below it: there are at most as many
    rows as seen prefixes times values of one dimension, and the product is never built. A prefix
    collects the values below it, at most `most` of a dimension; beyond, this raises.
    `gap_candidates` spells gaps out.
    """
    parts = []
    for k in range(1, len(dims)):
        rows, last = df.dropna(subset=dims[:k]), dims[k]
        every = df.agg(F.sort_array(F.collect_set(last)).alias("a")).select(F.when(F.size("a") <= most, F.col("a")).otherwise(
            F.raise_error(F.lit(f"over {most} values of {last}")).cast(f"array<{df.schema[last].dataType.simpleString()}>")).alias("a")).scalar()
        seen = rows.select(*dims[:k + 1]).distinct().groupBy(*dims[:k]).agg(F.collect_set(last).alias("_seen"))
        absent = seen.withColumn("_all", every).select(*dims[:k], F.explode(F.array_except("_all", "_seen")).alias(last))
        parts.append(absent.select(*dims[:k + 1], *[F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims[k + 1:]],
                                   F.lit(k + 1).alias("depth")))
    if not parts:
        return df.select(*dims).withColumn("depth", F.lit(0)).limit(0)
    return reduce(DataFrame.unionByName, parts)


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows no other row beats in both x and y (larger is better; equal rows stay).

    The best y per x is found first and laid out in ranges of x. A value survives if its y beats
    the best y of all higher ranges (one row per range) and of the higher x in its own range. No
    sort runs over all rows in one task.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = rows.groupBy(x).agg(F.max(y).alias("_y"))
    # written out, so that the range of a value is the same in every later step
    b = cut(best.repartitionByRange(x).withColumn("_r", F.spark_partition_id()))
    tops = b.groupBy("_r").agg(F.max("_y").alias("_t"))
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("_r")).rowsBetween(
        Window.unboundedPreceding, -1)
    tops = tops.select("_r", F.max("_t").over(above).alias("_above"))
    own = Window.partitionBy("_r").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    front = (b.withColumn("_own", F.max("_y").over(own)).join(tops, "_r")
             .filter((F.col("_own").isNull() | (F.col("_y") > F.col("_own")))
                     & (F.col("_above").isNull() | (F.col("_y") > F.col("_above")))))
    return rows.join(front.select(x, F.col("_y").alias(y)), [x, y], "left_semi")


#: Cells of the grid of a skyline in all, and points whose front one task folds at a time.
_CELLS, _BLOCK = 4096, 2000


def _below(x: str):
    return lambda c: c < F.col(x).cast("double")


def _beats(q: Column, p: Column, n: int) -> Column:
    """q is nowhere smaller than p, and larger somewhere."""
    fields = [f"o{i}" for i in range(n)]
    no_less, more = F.lit(True), F.lit(False)
    for f in fields:
        no_less, more = no_less & (q[f] >= p[f]), more | (q[f] > p[f])
    return no_less & more


def skyline(df: DataFrame, objectives: list[str]) -> DataFrame:
    """Rows that no other row beats in all objectives (larger is better; equal rows stay; rows with
    a NULL objective are left out).

    A grid over the values, by cut points of a sketch, settles most: a cell goes if an occupied cell
    lies above it in every objective. The points of a cell that stays are dealt into blocks, each block
    is sorted and folded to its own front, and fronts are compared block with block where cells are
    not below one another. The grid has at most some 4096 cells whatever the number of rows.
    """
    n = len(objectives)
    names, cells = [f"o{i}" for i in range(n)], [f"c{i}" for i in range(n)]
    wide = max(2, int(_CELLS ** (1 / n) + 1e-9))
    rows = df.filter(" and ".join(f"`{o}` is not null" for o in objectives))
    points = rows.select(*[F.col(o).alias(x) for o, x in zip(objectives, names)]).distinct()
    cuts = points.agg(F.array(*[F.percentile_approx(F.col(x).cast("double"), [i / wide for i in range(1, wide)], 1000) for x in names]).alias("c")).scalar()
    gridded = cut(points.withColumn("_cuts", cuts).select(*names, *[
        F.size(F.filter(F.get("_cuts", F.lit(i)), _below(x))).alias(cell) for i, (x, cell) in enumerate(zip(names, cells))]))
    occupied = gridded.groupBy(*cells).agg(F.count(F.lit(1)).alias("_size"))
    every = occupied.agg(F.collect_list(F.struct(*cells)).alias("a")).scalar()

    def above(d, strictly):
        out = F.lit(True)
        for c in cells:
            out = out & (d[c] > F.col(c) if strictly else d[c] >= F.col(c))
        return out

    live = cut(occupied.withColumn("_all", every).filter(~F.exists("_all", lambda d: above(d, True))).drop("_all"))
    dealt = gridded.join(live, cells).withColumn("_block", F.pmod(F.xxhash64(*names), F.ceil(F.col("_size") / _BLOCK)))
    listed = F.sort_array(F.collect_list(F.struct(*names)), asc=False)      # what beats a point stands before it
    kind = dealt.select(F.array(F.struct(*names)).alias("a")).schema[0].dataType.simpleString()
    folded = F.aggregate("_points", F.array().cast(kind), lambda acc, p: F.when(
        F.exists(acc, lambda q: _beats(q, p, n)), acc).otherwise(F.array_append(acc, p)))
    fronts = cut(dealt.groupBy(*cells, "_block").agg(listed.alias("_points")).select(*cells, "_block", folded.alias("_front")))
    higher = live.agg(F.collect_list(F.struct(*cells)).alias("a")).scalar()
    pairs = live.select(*cells).withColumn("_all", higher).select(*cells, F.explode(F.filter("_all", lambda d: above(d, False))).alias("d"))
    other = fronts.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(cells)], F.col("_front").alias("_other"))
    met = (fronts.join(pairs.select(*cells, *[F.col(f"d.{c}").alias(f"d{i}") for i, c in enumerate(cells)]), cells)
           .join(other, [f"d{i}" for i in range(n)]))
    beaten = met.select(F.inline(F.filter("_front", lambda p: F.exists("_other", lambda q: _beats(q, p, n))))).distinct()
    front = fronts.select(F.inline("_front")).join(beaten, names, "left_anti")
    return rows.join(front.select(*[F.col(x).alias(o) for x, o in zip(names, objectives)]), objectives, "left_semi").select(*df.columns)


def family_heatmap(df: DataFrame, row: str, col: str, metric: str) -> DataFrame:
    return pivot_mean_count(df, row, col, metric)


def feature_matrix_ml(df: DataFrame, categorical: list[str], numeric: list[str],
                      label: str, most: int = MOST_CATEGORIES) -> tuple[DataFrame, PipelineModel]:
    """(rows with ``features``, fitted encoder): one-hot categories and numbers, NULLs as 0.

    The encoder holds every category on the driver; more than ``most`` of a column raise.
    """
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in categorical]).first()
    wide = [c for c in categorical if counts[c] > most]
    if wide:
        raise ValueError(f"more than {most} categories in {wide}")
    steps = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep",
                           stringOrderType="alphabetAsc") for c in categorical]
    steps.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical],
                               outputCols=[f"_h_{c}" for c in categorical], dropLast=False))
    steps.append(VectorAssembler(inputCols=[f"_h_{c}" for c in categorical] + numeric,
                                 outputCol="features", handleInvalid="keep"))
    base = df.filter(F.col(label).isNotNull()).na.fill(0.0, numeric)
    model = Pipeline(stages=steps).fit(base)
    return model.transform(base), model


def fit_forest(features: DataFrame, label: str, kind: str = "forest", folds: int = 0,
               trees: int = 20, depth: int = 5, seed: int = 7, task_rows: int = TASK_ROWS, task_cells: int = TASK_CELLS):
    """Fitted tree regressor; with ``folds`` also its cross-validated error. All labelled rows are fitted on.

    A fit holds its rows in the tasks that read them, one number for each feature, so they are dealt into
    pieces of ``task_rows``, and of fewer where vectors are wide: a packed file of few splits would put
    very many rows into one task.
    """
    features = features.select("features", label)
    first = features.first()
    wide = getattr(first["features"], "size", 1) if first else 1
    pieces = -(-features.count() // max(1, min(task_rows, task_cells // max(wide, 1))))
    features = features.repartition(max(pieces, features.sparkSession.sparkContext.defaultParallelism))
    if kind == "forest":
        est = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees,
                                    maxDepth=depth, seed=seed)
    else:
        est = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth,
                           seed=seed)
    if not folds:
        return est.fit(features), None
    cv = CrossValidator(estimator=est, estimatorParamMaps=ParamGridBuilder().build(),
                        evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed)
    fitted = cv.fit(features)
    return fitted.bestModel, fitted.avgMetrics[0]


def bootstrap_uncertainty(features: DataFrame, target: DataFrame, label: str, keys: list[str],
                          models: int = 5, seed: int = 7, **kw) -> DataFrame:
    """Mean and spread of predictions from models fitted on re-sampled rows (sampling is the feature)."""
    votes = None
    for i in range(models):
        part = features.sample(withReplacement=True, fraction=1.0, seed=seed + i)
        model, _ = fit_forest(part, label, seed=seed + i, **kw)
        v = model.transform(target).select(*keys, "prediction")
        votes = v if votes is None else votes.unionByName(v)
    return votes.groupBy(*keys).agg(F.avg("prediction").alias("prediction"),
                                    F.stddev_samp("prediction").alias("spread"))


def rank_unseen(gaps: DataFrame, encoder: PipelineModel, features: DataFrame, label: str,
                dims: list[str], numeric_defaults: dict[str, float], models: int = 5) -> DataFrame:
    """Unseen combinations by prediction, the surer first on ties."""
    target = encoder.transform(gaps.withColumns(
        {c: F.lit(v) for c, v in numeric_defaults.items()}))
    return bootstrap_uncertainty(features, target, label, dims, models=models).orderBy(
        F.desc("prediction"), "spread", *dims)


def complete_records(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """Rows with at least k filled columns."""
    n: Column = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.withColumn("n_filled", n).filter(F.col("n_filled") >= k)


def curve_metrics(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per time curve: first and last value, drop, slope, number of points."""
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(x, y))[y].alias("y_first"),
        F.max(F.struct(x, y))[y].alias("y_last"), F.regr_slope(y, x).alias("slope"))
    return ends.withColumn("drop", F.col("y_first") - F.col("y_last"))


def product_shares(points: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Share of each bar in the total of its group; points: keys, ``series``, value."""
    bars = points.groupBy(*keys, "series").agg(F.sum(value).alias("total"))
    whole = bars.groupBy(*keys).agg(F.sum("total").alias("_w"))
    return bars.join(whole, keys).select(*keys, "series", "total",
                                         F.try_divide("total", "_w").alias("share"))
