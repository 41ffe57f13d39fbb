"""Quantities recorded in different units, scales and notations.

The operator treats every way of reading a record as a candidate and lets
identities among its columns decide.

``choose_readings`` is the general form.  Each *term* of an identity
``sum_i power_i * log(value_i) = 0`` (mass = density x volume is
``mass^1 density^-1 volume^-1``) has a list of candidate factors into its common
unit.  All combinations are enumerated per row (the lists are short literals),
the one with the least absolute log residual wins, and the row is flagged
``ambiguous`` if another combination fits as well but gives other values.

``read_quantities`` applies the same choice (``least_residual``) to facts.  A
quantity is stated by several columns (value_raw, value_num, unit, currency, scale,
or a table caption).  Candidates are the number notations (decimal point or decimal
comma) times the scales stated times the units a word may stand for; the identities
are

* value_num = number in value_raw, wherever value_num is present;
* scale = scale stated, for each column that states one;
* value = value of the same claim (subject, predicate, period) as other facts
  restate it, in whatever unit, scale and notation: the median of those facts that
  the first two identities settle.

The candidate with the least total of absolute log residuals wins.  Where no
identity separates the candidates the most usual reading comes first and the row is
flagged.  What a fact states is never replaced: a scale that it lacks is reported by
``suspect_scales``, which finds facts that are off their claim by just a scale.

Defined results: null and empty texts, bare numbers, words without digits and
numbers followed by something that is no unit give no quantity; texts may be of any
length; a null value_num drops its identity; a fact without subject, predicate or
other facts of its claim lacks the third; zero and negative values are compared by
magnitude; repeated rows of a fact count once, the latest loaded_at wins and at
ties the greatest statement; empty tables give empty results; other columns are
ignored.

Everything is built-in column expressions, one hash aggregation per fact and one
join of the few facts without any unit against captions of tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import Staged

# --- fixed values -----------------------------------------------------------

#: Scale words (singular forms and usual written forms) and their factors.
SCALES = {
    "thousand": 1e3, "thousands": 1e3, "'000": 1e3, "000s": 1e3, "'000s": 1e3, "k": 1e3, "thous": 1e3,
    "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mln": 1e6, "mio": 1e6, "mm": 1e6, "m": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "bln": 1e9, "b": 1e9,
    "trillion": 1e12, "trillions": 1e12, "tn": 1e12, "trn": 1e12,
}

#: Currency spellings.
CURRENCIES = {
    "₹": "INR", "inr": "INR", "rs": "INR", "re": "INR", "rupee": "INR", "rupees": "INR", "₨": "INR",
    "$": "USD", "us$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD",
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP", "sterling": "GBP",
}

#: Square metres of a square foot, for area units given in metric terms.
_SQ_M = 1 / (0.3048 * 0.3048)

#: Units: spellings in lower case without dots, common unit, factor.
UNITS = [
    ("% percent per-cent percentage pct", "percent", 1.0),
    ("bp bps basis-point basis-points", "percent", 0.01),
    ("sq-ft sqft sft sq-feet square-feet square-foot square-ft ft² ft2", "sq_ft", 1.0),
    ("sq-yd sq-yds sqyd sq-yards square-yard square-yards yd²", "sq_ft", 9.0),
    ("sq-m sqm sq-mt sq-mtr sq-mtrs sq-metre sq-metres sq-meter sq-meters square-metre square-metres square-meter square-meters m² m2", "sq_ft", _SQ_M),
    ("sq-km sqkm square-kilometre square-kilometres square-kilometer square-kilometers km² km2", "sq_ft", 1e6 * _SQ_M),
    ("sq-mi square-mile square-miles", "sq_ft", 27_878_400.0),
    ("acre acres", "sq_ft", 43_560.0),
    ("ha hectare hectares", "sq_ft", 1e4 * _SQ_M),
    ("nmi nautical-mile nautical-miles", "km", 1.852),
    ("km kms kilometre kilometres kilometer kilometers", "km", 1.0),
    ("metre metres meter meters mtr mtrs", "km", 0.001),
    ("mi mile miles", "km", 1.609344),
    ("ft foot feet", "km", 0.0003048),
    ("yd yds yard yards", "km", 0.0009144),
    ("mmt mmtpa", "tonne", 1e6),
    ("t mt ton tons tonne tonnes metric-ton metric-tons metric-tonne metric-tonnes", "tonne", 1.0),
    ("quintal quintals qtl qtls", "tonne", 0.1),
    ("kg kgs kilogram kilograms kilogramme kilogrammes", "tonne", 0.001),
    ("lb lbs pounds-(lb) pound-(lb) pounds-(lbs)", "tonne", 0.00045359237),
    ("g gm gms gram grams", "tonne", 0.000001),
]

#: A pound of mass, which shares its word with the currency.
_POUND = 0.00045359237

#: Words beside a number that leave its value alone.
QUALIFIERS = (
    r"about|approximately|approx\.?|around|nearly|almost|circa|ca\.?|c\.|over|more than|greater than|less than|under|"
    r"below|above|at least|at most|up to|only|some|roughly|estimated|est\.?|just|close to|in excess of|not less than|~|≈|>|<|≥|≤|\+"
)

# --- helpers ----------------------------------------------------------------


def _alternatives(words: dict[str, object]) -> str:
    return "|".join("".join("\\" + ch if ch in "$.()|'" else ch for ch in w) for w in sorted(words, key=lambda w: (-len(w), w)))


_SCALE_RE = rf"(?<![\p{{L}}])({_alternatives(SCALES)})(?![\p{{L}}²])\.?"
_CUR_RE = rf"(us\$|[₹₨$€£]|(?<![\p{{L}}])(?:inr|rs|re|rupees?|usd|dollars?|eur|euros?|gbp|pounds?(?! ?\(lb)|sterling)(?![\p{{L}}]))\.?"
# possessive, as a loop that can give back is a recursion for each round of it
_NUM_RE = r"\d(?:[.,]*+(?:[ \u00a0\u2009\u202f'’](?=\d{3}(?!\d)))?\d)*+"


def _sql(value: object) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else f"double({value!r})"


def _lookup(words: dict[str, object], key: Column) -> Column:
    return F.try_element_at(F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in words.items()) + ")"), key)


def _tidy(c: Column) -> Column:
    """Lower case, one kind of blank, minus and apostrophe."""
    c = F.lower(F.coalesce(c, F.lit("")))
    c = F.translate(c, "\u00a0\u2009\u202f\t\n\r\u2212\u2010\u2011\u2012\u2013\u2014\u2019", " " * 6 + "-" * 6 + "'")
    # the one unit whose last word is also a scale word
    c = F.regexp_replace(c, r"\b(sq|square)\.? ?m\b", "sqm")
    return F.btrim(F.regexp_replace(c, " +", " "))


def _scale_words(text: Column) -> tuple[Column, Column]:
    """All scale words of a text: their product and the factor of the last one."""
    factors = F.transform(F.regexp_extract_all(text, F.lit(_SCALE_RE), F.lit(1)), lambda w: _lookup(SCALES, w))
    return F.aggregate(factors, F.lit(1.0), lambda a, x: a * x), F.coalesce(F.try_element_at(factors, F.lit(-1)), F.lit(1.0))


def _unit_of(text: Column) -> Column:
    """Unit and factor of a text that is a unit by itself (scale and currency removed)."""
    known = ", ".join(
        f"{_sql(w.replace('-', ' '))}, struct({_sql(unit)} AS name, {_sql(f)} AS factor)" for words, unit, f in UNITS for w in words.split()
    )
    return F.try_element_at(F.expr(f"map({known})"), F.btrim(F.replace(text, F.lit("."), F.lit(""))))


def _without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return F.btrim(F.regexp_replace(text, " +", " "))


# --- the general solver -----------------------------------------------------


def choose_readings(
    df: DataFrame,
    terms: list[tuple[str, Column, list[tuple[str, float]], int]],
    tolerance: float = 0.02,
    prefix: str = "",
) -> DataFrame:
    """Choose the unit of each term so that the identity fits best.

    terms: (name, value column, [(unit, factor into the common unit), ...], power);
    the identity is ``product(common_value ** power) = 1``.  Adds, per term, the
    chosen unit and the value in the common unit, and ``log_residual`` and
    ``ambiguous``.  A null or zero value has no logarithm: its row keeps null
    results and is flagged.
    """
    logs = {name: F.log(F.abs(value)) for name, value, _, _ in terms}
    options = []
    for rank, combo in enumerate(itertools.product(*(units for _, _, units, _ in terms))):
        residual = reduce(
            lambda a, b: a + b,
            (
                F.lit(float(power)) * (logs[name] + F.log(F.lit(factor)))
                for (name, _, _, power), (_, factor) in zip(terms, combo, strict=True)
            ),
        )
        options.append(
            F.struct(
                F.round(F.abs(residual), 6).alias("r"),
                F.lit(rank).alias("rank"),
                *(F.lit(unit).alias(f"u_{name}") for (name, *_), (unit, _) in zip(terms, combo, strict=True)),
                *(
                    (value * F.lit(factor)).alias(f"v_{name}")
                    for (name, value, *_), (_, factor) in zip(terms, combo, strict=True)
                ),
            )
        )
    known = reduce(lambda a, b: a & b, (logs[name].isNotNull() for name, *_ in terms))
    differ = lambda x, y: reduce(lambda a, b: a | b, (x[f"v_{name}"] != y[f"v_{name}"] for name, *_ in terms))
    out = df.withColumn("_best", least_residual(F.filter(F.array(*options), lambda o: o["r"].isNotNull()), differ, tolerance))
    for name, *_ in terms:
        out = out.withColumn(f"{prefix}{name}_unit", F.col(f"_best.option.u_{name}")).withColumn(f"{prefix}{name}_common", F.col(f"_best.option.v_{name}"))
    return (
        out.withColumn(f"{prefix}log_residual", F.col("_best.option.r"))
        .withColumn(f"{prefix}ambiguous", ~known | F.coalesce("_best.ambiguous", F.lit(False)))
        .drop("_best")
    )


def least_residual(options: Column, differ: Callable[[Column, Column], Column], tolerance: float = 0.02) -> Column:
    """struct<option, ambiguous>: of structs that begin with (r, rank) the one with least r, then least rank.

    ambiguous: another one that differs from it fits as well within the tolerance.
    """

    def chosen(x: Column) -> Column:
        best = F.get(x, F.lit(0))
        return F.struct(best.alias("option"), F.exists(x, lambda y: (y["r"] - best["r"] < tolerance) & differ(best, y)).alias("ambiguous"))

    # a one-element transform evaluates the sorted options once
    return F.get(F.transform(F.array(F.array_sort(options)), chosen), F.lit(0))


# --- facts ------------------------------------------------------------------


_STATED = ["unit", "currency", "scale"]
_KEYS = ["shape", *_STATED]


def read_quantities(facts: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """One row per fact stating a measured quantity.

    Columns: fact_id, common_unit, common_value, log_residual, n_readings,
    ambiguous (another reading fits the identities as well), source (``stated``
    or ``caption``), claim (a number for subject, predicate and period, or null).
    captions: the table of ``table_captions``.

    The wording around the number is resolved once per distinct wording, not once
    per fact; facts are joined to the resolved wordings.
    """
    raw = F.replace(F.col("value_raw"), F.lit("'000"), F.lit(" thousand"))
    named = [c for c in ("subject_name", "predicate", "time_value") if c in facts.columns]
    claim = F.when(F.col("subject_name").isNotNull() & F.col("predicate").isNotNull(), F.xxhash64(*(F.lower(F.btrim(c)) for c in named))) if len(named) == 3 else F.lit(None).cast("long")
    rows = facts.select(
        "fact_id",
        claim.alias("claim"),
        "loaded_at",
        "value_raw",
        "value_num",
        "evidence_ids",
        F.regexp_extract(raw, _NUM_RE, 0).alias("num"),
        F.regexp_replace(raw, _NUM_RE, "9").alias("shape"),
        *_STATED,
    )
    ordering = F.struct("loaded_at", "value_raw", *_STATED)
    wordings = _resolve(rows.select(_KEYS).distinct())
    # Only a number with nothing beside it may take its unit from a caption; the other facts need no such join.
    nothing = reduce(lambda a, b: a & b, (F.btrim(F.coalesce(F.col(c), F.lit(""))) == "" for c in _STATED))
    bare = F.coalesce(nothing & F.col("shape").rlike(rf"(?i)^\s*(?:(?:{QUALIFIERS})\s*)?[^\p{{L}}\p{{Sc}}%]*$"), F.lit(False))
    no_caption = F.lit(None).cast("struct<cur:string,scale:double>")
    kept = ["fact_id", "claim", ordering.alias("o"), "value_num", "num", *_KEYS]
    stated = rows.where(~bare).select(*kept, no_caption.alias("caption"))
    alone = rows.where(bare)
    if captions is not None:
        refs = F.array_distinct(F.transform(F.filter("evidence_ids", lambda e: e.isNotNull()), lambda e: F.lower(F.btrim(e))))
        # facts without a single reference stay, since a later bare delivery replaces an earlier one
        alone = alone.select(*kept, F.when(F.size(refs) == 1, F.get(refs, F.lit(0))).alias("ref_id"))
        none = alone.where(F.col("ref_id").isNull()).drop("ref_id").withColumn("caption", no_caption)
        some = alone.where(F.col("ref_id").isNotNull()).join(captions, "ref_id", "left").select(*none.columns)
        alone = none.unionByName(some)
    else:
        alone = alone.select(*kept, no_caption.alias("caption"))
    same = reduce(lambda a, b: a & b, (F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")) for c in _KEYS))
    joined = stated.unionByName(alone).alias("f").join(wordings.alias("w"), same, "left").select("f.*", "w.w")
    q = F.struct("claim", _by_caption().alias("by_caption"), _options().alias("options"))
    latest = joined.select("fact_id", "o", q.alias("q")).groupBy("fact_id").agg(F.max_by("q", "o").alias("q")).where(F.size("q.options") > 0).select("fact_id", "q.*")
    staged = Staged(latest, "quantities")
    first = staged.df.withColumn("best", _chosen(F.col("options")))
    settled = first.where(~F.col("best.ambiguous"))
    # only facts that the columns leave open ask for the others of their claim
    open_ = first.where("best.ambiguous").drop("best")
    others = restatements(settled.join(open_.select("claim").distinct(), "claim", "left_semi"))
    asked = open_.join(others, "claim", "left").withColumn("options", F.transform("options", _against_others)).withColumn("best", _chosen(F.col("options")))
    out = settled.unionByName(asked.select(settled.columns))
    return out.select(
        "fact_id",
        F.col("best.option.unit").alias("common_unit"),
        F.col("best.option.v").alias("common_value"),
        F.col("best.option.r").alias("log_residual"),
        F.size("options").alias("n_readings"),
        F.col("best.ambiguous").alias("ambiguous"),
        F.when(F.col("by_caption"), "caption").otherwise("stated").alias("source"),
        "claim",
    )


def _chosen(options: Column) -> Column:
    return least_residual(options, lambda x, y: (x["unit"] != y["unit"]) | (F.abs(y["v"] - x["v"]) > 1e-6 * F.abs(x["v"])))


def restatements(settled: DataFrame) -> DataFrame:
    """(claim, others array<struct<unit, log>>): per claim and unit the median log of its facts; a claim has few units."""
    v = F.col("best.option.v")
    logs = settled.where(F.col("claim").isNotNull() & (v != 0)).groupBy("claim", F.col("best.option.unit").alias("unit")).agg(F.percentile_approx(F.log(F.abs(v)), 0.5).alias("log"))
    return logs.groupBy("claim").agg(F.collect_list(F.struct("unit", "log")).alias("others"))


#: The residual of a reading in a unit in which no other fact of the claim is stated.
_OTHER_UNIT = 20.0


def _against_others(option: Column) -> Column:
    """A reading with the residual against the restatements of its claim added."""
    of_unit = F.filter("others", lambda o: o["unit"] == option["unit"])
    gap = F.when(F.size(of_unit) > 0, F.round(F.abs(F.log(F.abs(option["v"])) - F.get(of_unit, F.lit(0))["log"]), 6)).when(F.size("others") > 0, F.lit(_OTHER_UNIT)).otherwise(0.0)
    return F.struct((option["r"] + F.coalesce(gap, F.lit(0.0))).alias("r"), option["rank"].alias("rank"), option["unit"].alias("unit"), option["v"].alias("v"))


def suspect_scales(quantities: DataFrame, least: int = 2, tolerance: float = 0.02) -> DataFrame:
    """(fact_id, common_unit, common_value, factor): facts that are off their claim by just a scale.

    quantities: the result of ``read_quantities``.  At least ``least`` facts restate
    the claim in that unit; their median is ``factor`` times the fact's value, and the
    factor is that of a scale word, or one over it.
    """
    rows = quantities.where(F.col("claim").isNotNull() & (F.col("common_value") != 0)).withColumn("log", F.log(F.abs("common_value")))
    medians = rows.groupBy("claim", "common_unit").agg(F.percentile_approx("log", 0.5).alias("middle"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    factors = F.array(*(F.lit(x) for f in sorted(set(SCALES.values())) for x in (f, 1 / f)))
    gap = F.col("middle") - F.col("log")
    fits = F.filter(factors, lambda f: F.abs(F.log(f) - gap) < tolerance)
    return rows.join(medians, ["claim", "common_unit"]).where(F.abs(gap) > 1).withColumn("factor", F.get(fits, F.lit(0))).where("factor IS NOT NULL").select("fact_id", "common_unit", "common_value", "factor")


def table_captions(elements: DataFrame) -> DataFrame:
    """(ref_id, caption struct<cur, scale>): the unit of the latest caption of every id a table element can be named by."""
    ids = F.concat(F.array("element_id"), F.coalesce("evidence_ids", F.array().cast("array<string>")))
    named = (
        elements.where((F.col("element_type") == "table") & F.col("caption").rlike(_CAPTION_HINT))
        .select(F.explode(F.array_distinct(F.transform(ids, lambda e: F.lower(F.btrim(e))))).alias("ref_id"), "caption", "ingested_at")
        .where(F.col("ref_id").isNotNull())
        .groupBy("ref_id")
        .agg(F.max_by("caption", F.struct("ingested_at", "caption")).alias("caption"))
    )
    text = _tidy(F.col("caption"))
    return named.select(
        "ref_id",
        F.struct(
            _lookup(CURRENCIES, F.regexp_extract(text, _CUR_RE, 1)).alias("cur"), _scale_words(F.regexp_replace(text, _CUR_RE, " "))[1].alias("scale")
        ).alias("caption"),
    )


_CAPTION_HINT = r"(?i)[₹₨$€£]|\b(?:inr|rs|rupees?|usd|dollars?|eur|euros?|gbp|pounds?)\b"


def _resolve(wordings: DataFrame) -> DataFrame:
    """Currency, unit, scales and sign of every wording; column ``w``."""
    w = wordings.select(*_KEYS, _tidy(F.col("shape")).alias("raw"), *(_tidy(F.col(c)).alias(f"t_{c}") for c in _STATED))
    negative = F.col("raw").rlike(r"\([^)9]*9[^)]*\)|^[^9]*-[^9]*9|9[^9]*-$|^(?:minus|negative|loss of) ")
    # the words around the number, without brackets of accounting negatives and qualifiers
    around = F.regexp_replace(F.replace(F.col("raw"), F.lit("9"), F.lit(" ")), r"\(lbs?\)", "〈lb〉")
    around = F.regexp_replace(F.regexp_replace(around, r"[()]|(?<![\p{L}])-|-(?![\p{L}])", " "), "〈lb〉", "(lb)")
    around = _without(around, rf"(?<![\p{{L}}])(?:{QUALIFIERS})(?![\p{{L}}])")
    w = w.select("*", negative.alias("negative"), around.alias("t_around"))
    # each column, in order of nearness to the number, states currency, scale and unit
    columns = ["around", *_STATED]
    w = w.select(
        *_KEYS,
        "negative",
        *(_lookup(CURRENCIES, F.regexp_extract(f"t_{c}", _CUR_RE, 1)).alias(f"cur_{c}") for c in columns),
        F.coalesce(*(F.nullif(F.regexp_extract(f"t_{c}", _CUR_RE, 1), F.lit("")) for c in columns)).isin("pound", "pounds").alias("pounds"),
        *(F.btrim(F.regexp_replace(F.regexp_replace(f"t_{c}", _CUR_RE, " "), r"\bin\b", " ")).alias(f"t_{c}") for c in columns),
    )
    w = w.select(
        *_KEYS,
        "negative",
        F.coalesce(*(f"cur_{c}" for c in columns)).alias("cur"),
        "pounds",
        *(_without(F.col(f"t_{c}"), _SCALE_RE).alias(f"u_{c}") for c in ("unit", "around")),
        # one scale however often stated
        F.array_distinct(F.filter(F.array(*(_scale_words(F.col(f"t_{c}"))[0] for c in columns)), lambda x: x != 1.0)).alias("stated"),
    )
    noun = r"^\p{L}[\p{L}-]*\.?(?: \p{L}[\p{L}-]*\.?){0,2}$"
    counted = F.col("u_unit").rlike(noun) | (F.col("u_unit") == "") & F.col("u_around").rlike(noun)
    w = w.select(
        *_KEYS,
        "negative",
        F.coalesce(_unit_of(F.col("u_unit")), _unit_of(F.col("u_around"))).alias("u"),
        "cur",
        "pounds",
        "stated",
        counted.alias("counted"),
        # if columns disagree, the scale nearest the number comes first, their product last
        F.when(F.size("stated") < 2, F.col("stated"))
        .otherwise(F.concat("stated", F.array(F.aggregate("stated", F.lit(1.0), lambda a, x: a * x))))
        .alias("scales"),
    )
    return w.select(
        *_KEYS,
        F.struct(
            F.coalesce("u.name", "cur", F.when(F.col("counted"), "count")).alias("common_unit"),
            (F.coalesce("u.factor", F.lit(1.0)) * F.when(F.col("negative"), -1.0).otherwise(1.0)).alias("factor"),
            # a word that may also stand for another unit
            F.when(F.col("u").isNull() & F.col("pounds"), F.struct(F.lit("tonne").alias("unit"), F.when(F.col("negative"), -_POUND).otherwise(_POUND).alias("factor"))).alias("other"),
            "scales",
            "stated",
        ).alias("w"),
    )


def _by_caption() -> Column:
    return F.col("w.common_unit").isNull()


def _options() -> Column:
    """array<struct<r, rank, unit, v>>: all readings, notation x scale x unit, with their residuals against the row's own columns."""
    num = F.regexp_replace("num", r"[^\d.,]", "")
    point = F.regexp_replace(num, ",", "")
    comma = F.replace(F.replace(num, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    notations = F.filter(
        F.array(
            F.when(num.rlike(r"^\d++(?:,\d{2,3})*+(?:\.\d++)?$"), F.struct(point.try_cast("double").alias("n"), F.lit(0).alias("rank"))),
            F.when(num.rlike(r"^\d{1,3}+(?:\.\d{3})*+(?:,\d++)?$"), F.struct(comma.try_cast("double").alias("n"), F.lit(1).alias("rank"))),
        ),
        lambda x: x["n"] < 1e300,
    )
    one = F.array(F.lit(1.0))
    by_caption = _by_caption()
    scales = F.when(by_caption, F.array(F.coalesce("caption.scale", F.lit(1.0)))).when(F.size("w.scales") > 0, F.col("w.scales")).otherwise(one)
    stated = F.when(by_caption, F.array().cast("array<double>")).otherwise(F.col("w.stated"))
    own = F.struct(F.coalesce("w.common_unit", "caption.cur").alias("unit"), F.coalesce("w.factor", F.lit(1.0)).alias("factor"))
    units = F.when(F.col("w.other").isNotNull(), F.array(own, F.col("w.other"))).otherwise(F.array(own))
    tiny = F.lit(1e-9)

    def number_gap(n: Column) -> Column:
        """value_num = number in value_raw."""
        return F.when(F.col("value_num").isNull(), 0.0).otherwise(F.abs(F.log(F.greatest(n, tiny)) - F.log(F.greatest(F.abs("value_num"), tiny))))

    def scale_gap(s: Column) -> Column:
        """scale = scale stated, for each column that states one."""
        return F.aggregate(stated, F.lit(0.0), lambda a, x: a + F.abs(F.log(s) - F.log(x)))

    def read(n: Column, s: Column, i: Column, u: Column, k: Column) -> Column:
        return F.struct(
            F.round(number_gap(n["n"]) + scale_gap(s), 6).alias("r"),
            # the unit comes first in rank, then the notation, then the scale
            (k * 100 + n["rank"] * 10 + i).alias("rank"),
            u["unit"].alias("unit"),
            (n["n"] * s * u["factor"]).alias("v"),
        )

    readings = F.flatten(F.flatten(F.transform(notations, lambda n: F.transform(scales, lambda s, i: F.transform(units, lambda u, k: read(n, s, i, u, k))))))
    return F.when(own["unit"].isNotNull() & (F.size(notations) > 0), readings)


def common_milli(value: Column) -> Column:
    """Signed thousandths, rounded half away from zero after removing binary noise."""
    return F.round(F.round(value * 1000, 5), 0).cast("long")
