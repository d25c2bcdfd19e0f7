"""Figure tables: caption typing, triage, calibration, series matching, structure-activity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import vocabulary as V
from recordloom.functions.base import any_contains, first_rule, let
from recordloom.operators.linkage import match_labels_in_captions
from recordloom.operators.ordering import with_next, with_position
from recordloom.operators.quantiles import exact_median
from recordloom.session import cut, spread


def type_caption(caption: Column) -> Column:
    """struct<type, shape> of a caption."""
    c = F.concat(F.lit(" "), F.lower(F.coalesce(caption, F.lit(""))), F.lit(" "))
    perf, char = any_contains(c, V.CAPTION_PERFORMANCE), any_contains(c, V.CAPTION_CHARACTERISATION)
    kind = first_rule([
        (F.length(F.coalesce(caption, F.lit(""))) == 0, "no_caption"), (perf & char, "mixed"),
        (perf & any_contains(c, V.CAPTION_STRUCTURE), "structure_activity"), (perf, "activity"),
        (char, "characterization")], "other")
    shape = F.when(any_contains(c, V.CAPTION_BAR), "bar").otherwise("line/scatter")
    return let(kind, lambda k: F.struct(k.alias("type"), F.when(
        k.isin(V.ACTIVITY_TYPES), shape).alias("shape")))


def type_captions(figs: DataFrame) -> DataFrame:
    """Figures with `type` and `shape`; rows are dealt out first, and a filter on them types no caption twice."""
    return spread(figs).select("*", F.inline(F.array(type_caption(F.col("caption")))))


def figure_inventory(typed: DataFrame) -> DataFrame:
    """(section, name, n): types, shapes of activity figures, documents with an activity figure."""
    act = typed.filter(F.col("type").isin(V.ACTIVITY_TYPES))
    return (typed.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit("type").alias("section"), "name", "n")
            .unionByName(act.groupBy(F.col("shape").alias("name"))
                         .agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit("shape").alias("section"), "name", "n"))
            .unionByName(act.agg(F.count_distinct("doc").alias("n")).select(
                F.lit("documents").alias("section"), F.lit("with_activity").alias("name"), "n")))


def is_structure_attr(attr: Column) -> Column:
    k = F.lower(attr)
    return any_contains(k, V.STRUCTURE_ATTRS) & ~any_contains(k, V.NOT_STRUCTURE_ATTRS)


def property_pool(attributes: DataFrame) -> DataFrame:
    """Records with at least one structural attribute: (doc, rec_key, label, variants, props)."""
    return (attributes.withColumn("_p", F.when(is_structure_attr(F.col("attr")), F.col("attr")))
            .groupBy("doc", "rec_key")
            .agg(F.max("best_label")["label"].alias("label"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels"))))
                 .alias("label_variants"),
                 F.array_sort(F.collect_set("_p")).alias("props"))
            .filter(F.size("props") > 0))


def tier_rule(self_contained: Column, matched: Column, pool: Column) -> Column:
    return (F.when((matched >= 2) | (self_contained & (matched >= 1)), "A")
            .when((matched == 1) | (self_contained & (pool > 0)), "B").otherwise("C"))


def triage_figures(typed: DataFrame, pool: DataFrame) -> DataFrame:
    """Tier, counts and reachable properties of every performance figure.

    Without a caption match the properties of the whole document count, flagged as ``pool``.
    """
    # the pool is read four times below; it is small beside the cells it comes from
    pool = cut(pool)
    # captions are typed once, and so are the matches found that two counts below read
    act = cut(typed.filter(F.col("type").isin(V.ACTIVITY_TYPES)))
    hits = cut(match_labels_in_captions(pool, act))
    props = pool.select("doc", "rec_key", F.explode("props").alias("prop"))
    per_fig = hits.groupBy("doc", "figure").agg(F.count(F.lit(1)).alias("n_matched"))
    own = (hits.select("doc", "figure", "rec_key").join(props, ["doc", "rec_key"])
           .groupBy("doc", "figure").agg(F.array_sort(F.collect_set("prop")).alias("_own")))
    per_doc = pool.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pool"))
    doc_props = props.groupBy("doc").agg(F.array_sort(F.collect_set("prop")).alias("_all"))
    j = (act.join(per_fig, ["doc", "figure"], "left").join(own, ["doc", "figure"], "left")
         .join(per_doc, "doc", "left").join(doc_props, "doc", "left")
         .withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
         .withColumn("n_pool", F.coalesce("n_pool", F.lit(0)))
         .withColumn("self_contained", F.col("type") == "structure_activity"))
    return (j.withColumn("tier", tier_rule(F.col("self_contained"), F.col("n_matched"),
                                           F.col("n_pool")))
            .withColumn("evidenced", (F.col("n_matched") > 0) | F.col("self_contained"))
            .withColumn("reachable", F.array_join(F.coalesce("_own", "_all", F.array().cast(
                "array<string>")), ","))
            .withColumn("reach_scope", F.when(F.col("n_matched") > 0, "matched")
                        .otherwise("pool")).drop("_own", "_all"))


def route(shape: Column, traces: Column, census: Column) -> Column:
    return first_rule([
        (F.coalesce(census, F.lit(False)), "markerformer"), (shape == "bar", "bar_reader"),
        (traces.isNull(), "lineformer_not_swept"), (traces >= 3, "lineformer")], "review")


def real_traces(series: DataFrame) -> DataFrame:
    """Number of series with at least 5 points per figure; series: ``figure, n_points``."""
    return series.groupBy("figure").agg(F.count_if(F.col("n_points") >= 5).alias("traces"))


def route_figures(triaged: DataFrame, traces: DataFrame, census: DataFrame) -> DataFrame:
    c = census.select("figure").distinct().withColumn("_c", F.lit(True))
    return (triaged.join(traces, "figure", "left").join(c, "figure", "left")
            .withColumn("route", route(F.col("shape"), F.col("traces"), F.col("_c")))
            .drop("_c"))


def triage_coverage(routed: DataFrame, typed: DataFrame, pool: DataFrame) -> DataFrame:
    """(section, name, n): tiers, routes of A and B, documents without records, capped figures."""
    def rows(df, section, name, n):
        return df.select(F.lit(section).alias("section"), name.alias("name"), n.alias("n"))

    tiers = routed.groupBy("tier").agg(F.count(F.lit(1)).alias("c"))
    routes = routed.filter("tier in ('A','B')").groupBy("route").agg(
        F.count(F.lit(1)).alias("c"))
    bare = typed.select("doc").distinct().join(pool.select("doc").distinct(), "doc",
                                               "left_anti").agg(F.count(F.lit(1)).alias("c"))
    capped = routed.agg(F.count_if(F.col("n_pool") == 0).alias("c"))
    return (rows(tiers, "tier", F.col("tier"), F.col("c"))
            .unionByName(rows(routes, "route", F.col("route"), F.col("c")))
            .unionByName(rows(bare, "coverage", F.lit("docs_without_pool"), F.col("c")))
            .unionByName(rows(capped, "coverage", F.lit("capped_figures"), F.col("c"))))


def compare_typing(typed: DataFrame, price_in: float = 1e-6, price_out: float = 5e-6) -> DataFrame:
    """(section, name, n) over image-typed figures against caption typing.

    typed: ``figure, figure_kind, panel_geometries, is_performance, has_disconnected_scatter,
    caption_type, caption_shape, error, tokens_in, tokens_out``.
    """
    ok = typed.filter("error is null")

    def rows(df, section):
        return df.select(F.lit(section).alias("section"), "name", F.col("n").cast("double")
                         .alias("n"))

    g = F.col("panel_geometries")
    flip = ((F.col("caption_shape") == "line/scatter") & F.array_contains(g, "bar")
            & ~F.array_contains(g, "line") & ~F.array_contains(g, "scatter"))
    nonchart = F.col("caption_type").isin(V.ACTIVITY_TYPES) & (F.col("figure_kind") != "chart")
    facts = typed.agg(
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("error").isNull() & F.col("is_performance")).alias("performance"),
        F.count_if(F.col("error").isNull() & F.col("has_disconnected_scatter"))
        .alias("disconnected_scatter"),
        F.count_if(F.col("error").isNull() & flip).alias("caption_line_image_bar"),
        F.count_if(F.col("error").isNull() & nonchart).alias("caption_performance_not_chart"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        (F.sum("tokens_in") * price_in + F.sum("tokens_out") * price_out).alias("cost"))
    names = facts.columns
    long = facts.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("name"), F.col(n).cast("double").alias("n")) for n in names])))
    kinds = ok.groupBy(F.col("figure_kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    geoms = ok.select(F.explode("panel_geometries").alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"))
    return rows(kinds, "kind").unionByName(rows(geoms, "geometry")).unionByName(
        rows(long, "fact"))


def typing_accuracy(typed: DataFrame, expected: DataFrame) -> DataFrame:
    """Agreement with hand labels per field and on all three; errors count as tried."""
    e = expected.select("figure", F.col("figure_kind").alias("e_kind"),
                        F.col("is_performance").alias("e_perf"),
                        F.col("has_disconnected_scatter").alias("e_scat"))
    j = typed.join(e, "figure")
    good = F.col("error").isNull()
    k = good & F.col("figure_kind").eqNullSafe(F.col("e_kind"))
    p = good & F.col("is_performance").eqNullSafe(F.col("e_perf"))
    s = good & F.col("has_disconnected_scatter").eqNullSafe(F.col("e_scat"))
    return j.agg(F.count(F.lit(1)).alias("total"), F.count_if(k).alias("kind_ok"),
                 F.count_if(p).alias("performance_ok"), F.count_if(s).alias("scatter_ok"),
                 F.count_if(k & p & s).alias("all_ok"))


def axis_value(p: Column, p1: Column, v1: Column, p2: Column, v2: Column, log: Column) -> Column:
    """Pixel to value through two ticks, linear or logarithmic; NULL where the ticks are no use."""
    share = F.try_divide(p - p1, p2 - p1)
    linear = v1 + share * (v2 - v1)
    safe1, safe2 = F.when(v1 > 0, v1), F.when(v2 > 0, v2)
    curved = F.pow(F.lit(10.0), F.log10(safe1) + share * (F.log10(safe2) - F.log10(safe1)))
    return F.round(F.when(log, curved).otherwise(linear), 4)


def calibrate_points(points: DataFrame, ticks: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Points in axis values; without a full calibration they stay in pixels, status rejected.

    points: ``image, panel, series, px, py``; ticks: ``image, panel, axis, p1, v1, p2, v2, log``.
    """
    fields = ["p1", "v1", "p2", "v2", "log"]

    def axis(a):
        return ticks.filter(F.col("axis") == a).select(
            "image", "panel", *[F.col(f).alias(f"{a}_{f}") for f in fields])

    if dropped is not None:
        points = points.join(dropped.select("image", "panel", "series").distinct(),
                             ["image", "panel", "series"], "left_anti")
    j = (points.join(axis("x"), ["image", "panel"], "left")
         .join(axis("y"), ["image", "panel"], "left")
         .withColumn("_x", axis_value(F.col("px"), *[F.col(f"x_{f}") for f in fields]))
         .withColumn("_y", axis_value(F.col("py"), *[F.col(f"y_{f}") for f in fields])))
    ok = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return (j.withColumn("x", F.when(ok, F.col("_x")).otherwise(F.col("px")))
            .withColumn("y", F.when(ok, F.col("_y")).otherwise(F.col("py")))
            .withColumn("status", F.when(ok, "accepted").otherwise("rejected"))
            .select(*points.columns, "x", "y", "status"))


# fixed values: when a tick fit is trusted
TICK_GAP_PX, LEAST_SPAN, LARGEST_RATIO, LARGEST_FIT = 6, 0.18, 1.6, 1e6


def _line(ticks: Column, span: Column) -> Column:
    """struct<slope, offset, ticks_used> of the least-squares line, NULL where it is not trusted.

    Values must differ and rise or fall throughout, ticks must reach over enough of the axis, and
    the steps between them be about equal.
    """
    def fit(t):
        n = F.size(t)
        total = lambda f: F.aggregate(t, F.lit(0.0), lambda acc, x: acc + f(x))
        steps = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i < n), lambda i: (
            F.get(t, i)["value"] - F.get(t, i - 1)["value"]) / (F.get(t, i)["px"] - F.get(t, i - 1)["px"]))

        def judged(m):
            slope = (total(lambda x: (x["px"] - m["p"]) * (x["value"] - m["v"]))
                     / total(lambda x: (x["px"] - m["p"]) * (x["px"] - m["p"])))
            sizes = F.transform(m["steps"], F.abs)
            one_way = (F.array_min(m["steps"]) > 0) | (F.array_max(m["steps"]) < 0)
            even = (n < 3) | (F.array_max(sizes) <= LARGEST_RATIO * F.greatest(F.array_min(sizes), F.lit(1e-12)))
            wide = F.element_at(t, -1)["px"] - F.get(t, F.lit(0))["px"] >= LEAST_SPAN * span
            return F.when(one_way & even & wide, let(slope, lambda a: let(m["v"] - a * m["p"], lambda b: F.when(
                (F.abs(a) * span <= LARGEST_FIT) & (F.abs(b) <= LARGEST_FIT),
                F.struct(a.alias("slope"), b.alias("offset"), n.alias("ticks_used"))))))

        means = F.struct((total(lambda x: x["px"]) / n).alias("p"), (total(lambda x: x["value"]) / n).alias("v"),
                         steps.alias("steps"))
        return F.when(n >= 2, let(means, judged))

    return let(ticks, fit)


def fit_ticks(ticks: DataFrame) -> DataFrame:
    """One fit per (image, panel, axis). ticks: those keys and ``px, value, span``, and optionally
    ``fallback``: the positions come from label centres alone, and three of them are needed.

    A pixel read twice is reduced to one tick, and a tick near an earlier one is dropped. Where four
    or more ticks give no trusted line, the first one that leaves out a single tick is taken.
    """
    keys = ["image", "panel", "axis"]
    fallback = F.col("fallback") if "fallback" in ticks.columns else F.lit(False)
    lean = ticks.groupBy(*keys, "px").agg(F.min("value").alias("value"), F.max("span").alias("span"),
                                          F.bool_or(fallback).alias("fallback"))
    axes = lean.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("px").cast("double").alias("px"),
                                             F.col("value").cast("double").alias("value"))))
        .alias("t"), F.max("span").cast("double").alias("span"), F.bool_or("fallback").alias("fallback"))
    apart = F.aggregate("t", F.slice("t", 1, 0), lambda kept, x: F.when(
        (F.size(kept) > 0) & (x["px"] - F.element_at(kept, -1)["px"] <= TICK_GAP_PX), kept)
        .otherwise(F.array_append(kept, x)))
    span = F.col("span")

    def best(kept):
        without = F.transform(kept, lambda _, i: _line(F.filter(kept, lambda x, j: j != i), span))
        rescued = F.when(F.size(kept) >= 4, F.get(F.filter(without, lambda f: f.isNotNull()), F.lit(0)))
        enough = F.size(kept) >= F.when(F.col("fallback"), 3).otherwise(2)
        return F.when(enough, F.coalesce(_line(kept, span), rescued))

    return axes.select(*keys, let(apart, best).alias("f")).select(
        *keys, "f.slope", "f.offset", F.coalesce("f.ticks_used", F.lit(0)).alias("ticks_used"))


def panel_confidence(panels: DataFrame) -> DataFrame:
    """low / medium / high per panel; panels: ``image, panel, x_ticks, y_ticks, n_series, colour_named``."""
    missing = ((F.coalesce("x_ticks", F.lit(0)) == 0) | (F.coalesce("y_ticks", F.lit(0)) == 0)
               | (F.coalesce("n_series", F.lit(0)) == 0))
    weak = F.col("colour_named") | (F.col("x_ticks") < 3) | (F.col("y_ticks") < 3)
    return panels.withColumn("confidence", F.when(missing, "low").when(weak, "medium")
                             .otherwise("high"))


def image_confidence(panels: DataFrame) -> DataFrame:
    return panels.groupBy("image").agg(
        F.bool_and(F.col("confidence") == "high").alias("_h"),
        F.bool_and(F.col("confidence") == "low").alias("_l")).select(
        "image", F.when(F.col("_h"), "high").when(F.col("_l"), "low").otherwise("medium")
        .alias("confidence"))


def pair_errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Overlap and mean |dy| of every gold and predicted series of an image that share an x.

    Both: ``image, line (integer), ord, x, y``. The join is on (image, x), so cost follows the shared points; one
    point per series and x remains (the later one wins before).
    """
    g = gold.groupBy("image", F.col("line").alias("gold"), F.col("x").cast("int").alias("x")).agg(
        F.max(F.struct("ord", "y"))["y"].alias("gy"))
    p = pred.groupBy("image", F.col("line").alias("pred"), F.col("x").cast("int").alias("x")).agg(
        F.max(F.struct("ord", "y"))["y"].alias("py"))
    size = g.groupBy("image", "gold").agg(F.count(F.lit(1)).alias("n_gold"))
    common = g.join(p, ["image", "x"]).groupBy("image", "gold", "pred").agg(
        F.count(F.lit(1)).alias("common"),
        # summed as decimals: the order of rows must not show in the last digit
        (F.sum(F.abs(F.col("gy") - F.col("py")).cast("decimal(18,6)")).cast("double")
         / F.count(F.lit(1))).alias("mae"))
    return common.join(size, ["image", "gold"]).select(
        "image", "gold", "pred", (F.col("common") / F.col("n_gold")).alias("overlap"), "mae")


def match_series(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs of series per image by ascending error.

    Each round takes, all at once, the pairs that are the best left for both their gold and their
    predicted series; that is the greedy result, as such a pair is met before any rival. Rounds
    end when nothing is left, and the lineage is cut between them. No image is held in one task.
    """
    order = F.struct("mae", "gold", "pred")
    left = cut(pair_errors(gold, pred))
    taken = None
    while True:
        g = left.groupBy("image", "gold").agg(F.min(order).alias("_g"))
        p = left.groupBy("image", "pred").agg(F.min(order).alias("_p"))
        best = cut(left.join(g, ["image", "gold"]).join(p, ["image", "pred"])
                   .filter((F.col("_g") == order) & (F.col("_p") == order)).drop("_g", "_p")
                   .select("image", "gold", "pred", "overlap", "mae"))
        if best.isEmpty():
            break
        taken = best if taken is None else taken.unionByName(best)
        left = cut(left.join(best.select("image", "gold"), ["image", "gold"], "left_anti")
                   .join(best.select("image", "pred"), ["image", "pred"], "left_anti"))
    taken = left if taken is None else taken

    def unused(lines, side):
        rest = lines.select("image", F.col("line").cast("long").alias(side)).distinct().join(
            taken.select("image", F.col(side).cast("long").alias(side)), ["image", side],
            "left_anti")
        return with_position(rest, ["image"], [side])

    # series that share no x with any free partner pair up in order, with no error to state
    idle = unused(gold, "gold").join(unused(pred, "pred"), ["image", "pos"]).select(
        "image", "gold", "pred", F.lit(0.0).alias("overlap"),
        F.lit(None).cast("double").alias("mae"))
    return taken.unionByName(idle)


def parity_summary(pairs: DataFrame, min_overlap: float = 0.95, max_mae: float = 1.0) -> DataFrame:
    """Pairs with an error, tight pairs, and the medians of overlap and error."""
    pairs = pairs.filter("mae is not null")
    facts = pairs.agg(F.count(F.lit(1)).alias("lines_paired"), F.count_if(
        (F.col("overlap") >= min_overlap) & (F.col("mae") <= max_mae)).alias("lines_tight"))
    medians = {f"median_{c}": exact_median(pairs, [], c).first()["median"] for c in ("overlap", "mae")}
    return facts.withColumns({n: F.lit(v).cast("double") for n, v in medians.items()})


def structure_kind(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return first_rule([(any_contains(low, words), k) for k, words in V.AXIS_STRUCTURE.items()])


def structure_activity(panels: DataFrame) -> DataFrame:
    """Points of gated panels whose y is a performance: (…, kind, x_kind, x, y).

    panels: ``image, doc, panel, x_label, y_label, confidence, series``; kind is ``structure`` or
    ``condition``.
    """
    p = _classified(panels).filter("reason is null")
    pts = p.select("image", "doc", "panel", "x_label", "y_label", "confidence", "kind", "x_kind",
                   F.explode("series").alias("s"))
    return (pts.select("image", "doc", "panel", "x_label", "y_label", "confidence", "kind",
                       "x_kind", F.col("s.name").alias("catalyst"), F.inline("s.points"))
            .filter("x is not null and y is not null"))


def _classified(panels: DataFrame) -> DataFrame:
    y = F.lower(F.coalesce("y_label", F.lit("")))
    x = F.lower(F.coalesce("x_label", F.lit("")))
    k = structure_kind(F.col("x_label"))
    condition = any_contains(x, V.AXIS_CONDITION)
    return (panels.withColumn("_k", k)
            .withColumn("reason", F.when(~any_contains(y, V.AXIS_PERFORMANCE), "y_not_performance")
                        .when(F.col("_k").isNull() & ~condition, "x_unclassified"))
            .withColumn("kind", F.when(F.col("_k").isNotNull(), "structure")
                        .otherwise("condition"))
            .withColumn("x_kind", F.coalesce("_k", "x_label")).drop("_k"))


def skipped_panels(panels: DataFrame) -> DataFrame:
    return (_classified(panels).filter("reason is not null").groupBy("reason")
            .agg(F.count(F.lit(1)).alias("n")))


_AXIS = "label string, unit string, min double, max double"



def parse_panels(df: DataFrame, reply: str) -> DataFrame:
    """Chart replies to one row per panel, tolerant of wrong types; adds ``n_points``.

    Axis: an object, or the first object of a list, else empty. Series or points of a wrong type
    become empty; a missing name is '?'.
    """
    def objects(text):
        return F.filter(F.from_json(text, "array<string>"), lambda t: t.rlike(r"(?s)^\s*\{"))

    def as_axis(text):
        one = F.when(text.rlike(r"(?s)^\s*\{"), text).when(
            text.rlike(r"(?s)^\s*\["), F.get(objects(text), F.lit(0)))
        return F.from_json(one, _AXIS)

    def points(text):
        ok = F.when(text.rlike(r"(?s)^\s*\["), objects(text))
        return F.coalesce(F.transform(ok, lambda t: F.from_json(t, "x double, y double")),
                          F.array().cast("array<struct<x:double,y:double>>"))

    def series(text):
        ok = F.when(text.rlike(r"(?s)^\s*\["), objects(text))
        one = lambda t: F.from_json(t, "name string, points string")
        return F.coalesce(F.transform(ok, lambda t: F.struct(
            F.coalesce(one(t)["name"], F.lit("?")).alias("name"),
            points(one(t)["points"]).alias("points"))),
            F.array().cast("array<struct<name:string,points:array<struct<x:double,y:double>>>>"))

    body = F.from_json(reply, "panels string")["panels"]
    p = df.withColumn("_p", F.explode(F.when(body.rlike(r"(?s)^\s*\["), objects(body)))) \
        .withColumn("_f", F.from_json("_p", "panel string, chart_type string, x_axis string, "
                                            "y_axis string, series string"))
    keep = [c for c in df.columns if c != reply]
    out = p.select(*keep, F.col("_f.panel").alias("panel"),
                   F.col("_f.chart_type").alias("chart_type"),
                   as_axis(F.col("_f.x_axis")).alias("x_axis"),
                   as_axis(F.col("_f.y_axis")).alias("y_axis"),
                   series(F.col("_f.series")).alias("series"))
    return out.withColumn("n_points", F.aggregate(
        "series", F.lit(0), lambda a, s: a + F.size(s["points"])))


def densify_series(points: DataFrame, keys: list[str]) -> DataFrame:
    """A point at every integer x between the given ones, linear, y cut to an integer.

    points: keys, ``pos`` (dense order by x), ``x``, ``y``. Each pair of neighbours fills its own
    gap, so a long series is spread over tasks.
    """
    p = (points.withColumn("x", F.col("x").cast("long"))
         .withColumn("y", F.col("y").cast("long")))
    n = with_next(p, keys, "pos", {"x": "x2", "y": "y2"})
    step = F.when(F.col("x2").isNull() | (F.col("x2") <= F.col("x")), F.array("x")).otherwise(
        F.sequence("x", F.col("x2") - 1))
    # a repeated x keeps its last point, which is the one that opens the next gap
    dead = F.col("x2").isNotNull() & (F.col("x2") == F.col("x"))
    at = F.col("y") + (F.col("xi") - F.col("x")) * F.try_divide(
        F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))
    return (n.filter(~dead).withColumn("xi", F.explode(step))
            .select(*keys, F.col("xi").alias("x"),
                    F.when(F.col("xi") == F.col("x"), F.col("y")).otherwise(at).cast("long")
                    .alias("y")))


