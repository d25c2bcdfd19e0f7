"""Condition extraction from text and back-fill of evidence units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.base import any_contains, let, quiet_double
from recordloom.functions.temperature import (DEGREE_SIGNS, LOOK_BACK, STEP_WORDS, governed, matches,
                                              section_temperature_and_pressure, temperature_matches)
from recordloom.operators.ordering import with_position
from recordloom.session import cut

# fixed values: the patterns of pressures, space velocities and loadings
_NUM = r"(\d+\.?\d*)"
_GROUPED = r"(\d[\d,]*\.?\d*)"
_WHSV = [rf"(?iU)WHSV\s*(?:[=:]|of)?\s*{_NUM}\s*(?:h[-−]1|h\^[-−]?1|/h|·h[-−]1)", rf"(?iU)WHSV\s*(?:[=:]|of)\s*{_NUM}"]
_GHSV = [rf"(?iU)GHSV\s*(?:[=:]|of)?\s*{_GROUPED}\s*(?:mL|ml|cm3|h[-−]1|/h)", rf"(?iU)GHSV\s*(?:[=:]|of)\s*{_GROUPED}"]
_LOAD = rf"(?iU){_NUM}\s*g\s+(?:of\s+)?(?:catalyst|zeolite|sample|ZSM|HZSM|\w+-\d+)"
_LOAD_NAMED = rf"(?iU)catalyst\s+loading\s+of\s+{_NUM}\s*g"
#: (pattern, reading) of every field but the temperature, and the words one of which each of its matches holds.
_PATTERNS = {
    "pressure_mpa": [(rf"(?iU){_NUM}\s*MPa", lambda v: v), (rf"(?iU){_NUM}\s*bar\b", lambda v: F.round(v * 0.1, 4)),
                     (rf"(?iU){_NUM}\s*atm\b", lambda v: F.round(v * 0.101325, 4)), (rf"(?iU){_NUM}\s*kPa\b", lambda v: F.round(v / 1000, 4))],
    "whsv": [(p, lambda v: v) for p in _WHSV], "ghsv": [(p, lambda v: v) for p in _GHSV],
    "catalyst_loading_g": [(_LOAD, lambda v: F.when(v.between(0.01, 20), v)), (_LOAD_NAMED, lambda v: v)]}
_CATALYST, _KELVIN_SIGN, _DOTTED_I = "CATALYST", "\u212a", "\u0130"      # of _LOAD_NAMED; signs that match k and i, but are no K and I
_WORDS = {"pressure_mpa": ["MPA", "BAR", "ATM", "KPA"], "whsv": ["WHSV"], "ghsv": ["GHSV"], "catalyst_loading_g": None}


def _number(c: Column) -> Column:
    return quiet_double(F.replace(c, F.lit(","), F.lit("")))


def _all(c: Column, pattern: str) -> Column:
    """Every captured number, thousands commas removed."""
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), _number)


def _named(c: Column, words: list[str] | None) -> Column:
    """Does one of the upper-case words stand there? A substring test settles most text."""
    if words is None:
        return F.lit(True)
    return let(F.upper(c), lambda up: any_contains(up, [*words, _KELVIN_SIGN]))


def _extract(c: Column, field: str) -> Column:
    found = [F.filter(F.transform(_all(c, p), read), lambda v: v.isNotNull()) for p, read in _PATTERNS[field]]
    return F.when(_named(c, _WORDS[field]), F.concat(*found)).otherwise(F.array().cast("array<double>"))


def extract_pressures(c: Column) -> Column:
    """array<double> in MPa."""
    return _extract(c, "pressure_mpa")


def extract_whsv(c: Column) -> Column:
    return F.array_distinct(_extract(c, "whsv"))


def extract_ghsv(c: Column) -> Column:
    return F.array_distinct(_extract(c, "ghsv"))


def extract_loading(c: Column) -> Column:
    """array<double> in gram; 'n g of catalyst' within 0.01-20, 'catalyst loading of n g' as it is."""
    return F.array_distinct(_extract(c, "catalyst_loading_g"))


def resolve_value(local: Column, everywhere: Column, name: str, decimals: int) -> Column:
    """struct<value, note>: one local value, else one value in the document, else a list note."""
    def distinct(values):
        return F.array_distinct(F.transform(F.coalesce(
            values, F.array().cast("array<double>")), lambda v: F.round(v, decimals)))

    def decide(pair):
        one_local = F.when(F.size(pair["l"]) == 1, F.get(pair["l"], F.lit(0)))
        one_global = F.when(F.size(pair["g"]) == 1, F.get(pair["g"], F.lit(0)))
        value = F.coalesce(one_local, one_global)
        listed = F.array_join(F.transform(F.array_sort(pair["g"]),
                                          lambda v: v.cast("string")), ", ")
        return F.struct(value.alias("value"), F.when(
            value.isNull() & (F.size(pair["g"]) > 0),
            F.concat(F.lit(f"multiple {name}: "), listed)).alias("note"))

    return let(F.struct(distinct(local).alias("l"), distinct(everywhere).alias("g")), decide)


# field -> (label in notes, decimals)
CONDITION_FIELDS = {"temperature_c": ("T(°C)", 0), "pressure_mpa": ("P(MPa)", 2),
                    "whsv": ("WHSV", 2), "ghsv": ("GHSV", 0),
                    "catalyst_loading_g": ("catalyst_loading(g)", 3)}
#: Stands between chunks: white space to every pattern, and told apart from that of the texts.
_BORDER = "\u2029"
#: Words of the following chunks that a match can run into; no pattern spans more.
_RUN_ON = 6
_REACH_BACK, _REACH_ON = 6, 3        # doublings: LOOK_BACK characters are at most 60 chunks, _RUN_ON words at most 6
#: Stands in every text with a match: one of the marks, or this form (kelvin, garbled degrees, gram).
_MARKS = [*[sign.upper() for sign in DEGREE_SIGNS], *[w for words in _WORDS.values() for w in words or ()], _CATALYST, _KELVIN_SIGN]
_SHORT_UNIT = r"(?U)\d\s*[CcKGg]"
_HEAD = rf"(?U)^\s*(?:\S+\s+){{0,{_RUN_ON - 1}}}\S*"


def _edges(placed: DataFrame, reach: int, block_size: int) -> DataFrame:
    """(doc, pos, before, after, next_pos, prev_pos) of the chunks that hold a word.

    before: the last characters of the chunks before, after: the first words of those after, with a
    border between chunks. Only such ends are carried, from one chunk to the next and then twice as
    far in every step; blocks of a document overlap by as many chunks as they can reach.
    """
    solid = placed.filter(F.col("text").rlike(r"(?U)\S"))
    text = F.translate("text", _BORDER, " ")
    ends = with_position(solid.select("doc", "pos", F.right(text, F.lit(LOOK_BACK)).alias("tail"),
                                      F.regexp_extract(text, _HEAD, 0).alias("head")),
                         ["doc"], ["pos"], name="q").withColumn("words", F.size(F.regexp_extract_all("head", F.lit(r"(?U)\S+"), F.lit(0))))
    far, on = 2 ** _REACH_BACK, max(2 ** _REACH_ON, 2 * reach)
    low, high = F.floor((F.col("q") - on) / block_size), F.floor((F.col("q") + far) / block_size)
    spread = ends.withColumn("_blk", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    w = Window.partitionBy("doc", "_blk").orderBy("q")
    for k in range(_REACH_BACK):
        before, after = F.lag("tail", 2 ** k).over(w), F.lead("head", 2 ** k).over(w)
        grown = {"tail": F.when(before.isNull() | (F.length("tail") >= LOOK_BACK), F.col("tail")).otherwise(
            F.right(F.concat(before, F.lit(_BORDER), F.col("tail")), F.lit(LOOK_BACK)))}
        if k < _REACH_ON:
            grown["head"] = F.when(after.isNull() | (F.col("words") >= _RUN_ON), F.col("head")).otherwise(
                F.regexp_extract(F.concat("head", F.lit(_BORDER), after), _HEAD, 0))
            grown["words"] = F.col("words") + F.coalesce(F.lead("words", 2 ** k).over(w), F.lit(0))
        spread = spread.withColumns(grown)
    there = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return spread.select(
        "doc", "pos", "_blk", "q", F.lag("tail", 1).over(w).alias("before"), F.lead("head", 1).over(w).alias("after"),
        there([F.lead("pos", i).over(w) for i in range(1, _RUN_ON + 1)]).alias("next_pos"),
        there([F.lag("pos", i).over(w) for i in range(1, 2 * reach + 1)]).alias("prev_pos")).filter(
        F.col("_blk") == F.floor(F.col("q") / block_size)).drop("_blk", "q")


def chunk_values(placed: DataFrame, reach: int = 2, block_size: int = 2048) -> DataFrame:
    """The condition values that begin in each chunk: (doc, pos, prev_pos, found array<struct<field,
    value, last_pos, governed>>).

    `placed` has ``doc, pos, text`` with dense positions. A chunk is read once, with the ends of its
    neighbours around it, as if all chunks that hold a word were joined by blanks; matches are looked
    for from its beginning on: last_pos is the chunk in which one ends. governed[k] tells whether a treatment step holds for a temperature
    if k chunks before its own are seen, and its last entry if all are.
    """
    fields = list(CONDITION_FIELDS)
    worth = F.col("text").rlike(r"(?U)\d") | any_contains(F.upper("text"), ["WHSV", "GHSV", "CATALYST"])
    # both sides are dealt over as many tasks as there are: patterns cost far more than their bytes
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (placed.select("doc", "pos", "text").filter(worth).repartition(parts, "doc", "pos")
            .join(_edges(placed, reach, block_size).repartition(parts, "doc", "pos").hint("merge"), ["doc", "pos"])
            .withColumn("size", F.length("text"))
            .withColumn("before", F.coalesce(F.concat("before", F.lit(_BORDER)), F.lit("")))
            .withColumn("body", F.concat(F.translate("text", _BORDER, " "), F.coalesce(F.concat(F.lit(_BORDER), F.col("after")), F.lit(""))))
            # what can settle a chunk is looked for once and without patterns
            .withColumn("upper", F.upper("body")))
    rows = rows.withColumns({
        "marked": any_contains(F.col("upper"), _MARKS) | F.col("body").rlike(_SHORT_UNIT),
        "stepped": any_contains(F.col("upper"), [*STEP_WORDS, _DOTTED_I]) | any_contains(F.upper("before"), [*STEP_WORDS, _DOTTED_I])})
    kind = "array<struct<field:int,value:double,start:int,size:int>>"

    def of(body, i, pattern, read):
        return F.transform(matches(body, pattern), lambda m: F.struct(
            F.lit(i).alias("field"), read(_number(m["g1"])).alias("value"), m["start"], m["size"])).cast(kind)

    def hits(body):
        none = F.array().cast(kind)
        out = [F.transform(temperature_matches(body), lambda m: F.struct(F.lit(0).alias("field"), m["value"].alias("value"), m["start"], m["size"]))]
        for i, field in enumerate(fields):
            every = [(of(body, i, pattern, read), [_CATALYST] if pattern == _LOAD_NAMED else _WORDS[field])
                     for pattern, read in _PATTERNS.get(field, [])]
            for words in dict.fromkeys(tuple(w or ()) for _, w in every):
                found = F.concat(*[o for o, w in every if tuple(w or ()) == words])
                out.append(F.when(any_contains(F.col("upper"), [*words, _KELVIN_SIGN]), found).otherwise(none) if words else found)
        return F.filter(F.concat(*[o.cast(kind) for o in out]), lambda m: m["value"].isNotNull() & (m["start"] < F.col("size")))

    borders = lambda c: F.length(c) - F.length(F.replace(c, F.lit(_BORDER), F.lit("")))

    def by_sight(seen):
        each = F.transform(F.sequence(F.lit(0), borders(seen)), lambda k: governed(F.call_function("substring_index", seen, F.lit(_BORDER), -(k + 1))))
        return F.when(F.col("stepped"), each).when(~F.col("stepped"), F.array(F.lit(False)))   # named twice, so that it is a column

    def placed_in(body):
        def one(m):
            crossed = borders(body.substr(m["start"] + 1, m["size"]))
            return F.struct(
                F.get(F.array(*[F.lit(f) for f in fields]), m["field"]).alias("field"), m["value"].alias("value"),
                let(crossed, lambda n: F.when(n > 0, F.get(F.col("next_pos"), n - 1)).otherwise(F.col("pos"))).alias("last_pos"),
                F.when(m["field"] == 0, let(F.right(F.concat("before", body.substr(F.lit(1), m["start"])), F.lit(LOOK_BACK)), by_sight))
                .alias("governed"))
        return F.transform(hits(body), one)

    found = let(F.col("body"), placed_in)
    none = F.array().cast("array<struct<field:string,value:double,last_pos:bigint,governed:array<boolean>>>")
    return rows.select("doc", "pos", "prev_pos", F.when(F.col("marked"), found).otherwise(none).alias("found"))


def _arrays(values: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The distinct values of each field as an array."""
    return values.groupBy(*keys).agg(*[F.collect_set(F.when(F.col("field") == f, F.col("value"))).alias(f"{prefix}_{f}")
                                       for f in CONDITION_FIELDS])


def document_conditions(placed: DataFrame, block_size: int = 2048, values: DataFrame | None = None) -> DataFrame:
    """Distinct values found anywhere in a document: (doc, g_<field> arrays)."""
    values = cut(chunk_values(placed, block_size=block_size)) if values is None else values
    values = values.select("doc", F.inline("found"))
    free = F.coalesce(F.element_at("governed", -1), F.lit(False))
    return _arrays(values.filter(~free).select("doc", "field", "value").distinct(), ["doc"], "g")


def fill_conditions(units: DataFrame, chunks: DataFrame, reach: int = 2, block_size: int = 2048) -> DataFrame:
    """Fill NULL condition fields of units from their neighbourhood, else from the document.

    units: ``unit_id, doc, chunk_id`` and the condition fields; chunks: ``doc, chunk_id, page,
    chunk_no, text``. The neighbourhood is `reach` chunks to both sides: values that begin and end
    there count, and treatment steps that stand there. Several candidates leave the field NULL and
    add a note. Of chunks with one id the last counts.
    """
    placed = cut(with_position(chunks, ["doc"], ["page", "chunk_no"]))
    values = cut(chunk_values(placed, reach, block_size))
    everywhere = document_conditions(placed, values=values)
    nothing = F.array().cast("array<double>")
    # what the document says, once a document: the value that fills, or the note
    everywhere = everywhere.select("doc", *[resolve_value(nothing, F.col(f"g_{f}"), label, decimals).alias(f"_g_{f}")
                                            for f, (label, decimals) in CONDITION_FIELDS.items()])
    # a value counts for the chunks that see it whole; one value is left where the smallest is the largest
    seen = F.size(F.filter("prev_pos", lambda p: p >= F.col("home") - reach))
    held = F.get("governed", F.least(seen, F.size("governed") - 1))
    rounded = {f: F.when(F.col("field") == f, F.round("value", decimals)) for f, (_, decimals) in CONDITION_FIELDS.items()}
    local = (values.select("doc", "pos", "prev_pos", F.inline("found")).filter(F.col("last_pos") <= F.col("pos") + 2 * reach)
             .withColumn("home", F.explode(F.sequence(F.col("last_pos") - reach, F.col("pos") + reach)))
             .filter(~F.coalesce(held, F.lit(False)))
             .groupBy("doc", "home").agg(*[a(v).alias(f"{a.__name__}_{f}") for f, v in rounded.items() for a in (F.min, F.max)]))
    homes = placed.groupBy("doc", "chunk_id").agg(F.max("pos").alias("home"))
    j = units.join(homes, ["doc", "chunk_id"], "left").join(local, ["doc", "home"], "left").join(everywhere, "doc", "left")
    alone = {f: F.when(F.col(f"min_{f}") == F.col(f"max_{f}"), F.col(f"min_{f}")) for f in CONDITION_FIELDS}
    notes = F.concat_ws("; ", *[F.when(F.col(f).isNull() & alone[f].isNull(), F.col(f"_g_{f}")["note"]) for f in CONDITION_FIELDS])
    keep = [c for c in units.columns if c not in CONDITION_FIELDS]
    return j.select(*keep, *[F.coalesce(F.col(f), alone[f], F.col(f"_g_{f}")["value"]).alias(f)
                             for f in CONDITION_FIELDS],
                    F.when(F.length(notes) > 0, notes).alias("temperature_note"))


def section_conditions(c: Column) -> Column:
    """Conditions of an experimental section: struct of the five fields and the temperature note."""
    ranked = section_temperature_and_pressure(c)
    loading = _all(c, rf"(?iU){_NUM}\s*g\s+(?:of\s+)?(?:catalyst|zeolite|sample)")
    first = lambda values: F.get(values, F.lit(0))
    return F.struct(
        ranked["temperature_c"].alias("temperature_c"),
        ranked["temperature_note"].alias("temperature_note"),
        ranked["pressure_mpa"].alias("pressure_mpa"),
        first(_all(c, rf"(?iU)WHSV\s*(?:[=:]|of)?\s*{_NUM}")).alias("whsv"),
        first(_all(c, rf"(?iU)GHSV\s*(?:[=:]|of)?\s*{_GROUPED}")).alias("ghsv"),
        first(F.filter(loading, lambda v: v.between(0.01, 20))).alias("catalyst_loading_g"))


def backfill_group_defaults(units: DataFrame, defaults: DataFrame, key: str,
                            fields: list[str]) -> DataFrame:
    """Document-level conditions fill what a unit lacks."""
    d = defaults.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields])
    return (units.join(d, key, "left")
            .withColumns({f: F.coalesce(F.col(f), F.col(f"_d_{f}")) for f in fields})
            .drop(*[f"_d_{f}" for f in fields]))
