"""Column expressions for dirty text: missing values, flags, numbers, units, identifiers, notes.

All are built-in functions and stay within code generation or interpreted higher-order functions; none
starts a Python worker. Unless said otherwise, null in gives null out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean "missing", texts that mean "true", a number, what parts two numbers of a cell.
MISSING = ("", "na", "n/a", "nan", "none", "null", "not applicable")
TRUTHY = ("1", "true", "t", "yes", "y")
NUMBER = r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?"
PARTING = r"\s*(?:–|-|—|to|±|\+/-|\+⁄-)\s*"
UNCERTAIN = r"±|\+/-|\+⁄-"


def folded(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def is_missing(c: Column, tokens: Sequence[str] = MISSING) -> Column:
    """Null, NaN text, or one of the tokens in any case. Never null."""
    return c.isNull() | folded(c).isin(*tokens)


def is_true(c: Column) -> Column:
    """A flag kept as bool, number or text; null and anything else is false."""
    return F.coalesce(folded(c).isin(*TRUTHY), F.lit(False))


def blank_to_null(c: Column, tokens: Sequence[str] = ("",)) -> Column:
    return F.when(~is_missing(c, tokens), c)


def first_nonblank(*cs: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cs])


def identity_key(c: Column) -> Column:
    """Lower case, letters and digits only (ASCII text; see udfs.identity_key for the rest)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def items(c: Column, separators: str = r"\s*(?:;|&&)\s*") -> Column:
    """A packed series as an array of trimmed items without blanks."""
    return F.filter(F.transform(F.split(c, separators), lambda x: F.trim(x)), lambda x: x != "")


def pick_item(c: Column, name: Column) -> Column:
    """The item whose leading token equals the name, else the first."""
    own = items(c)
    hit = F.filter(own, lambda x: F.lower(F.split(x, r"[\s:=]+")[0]) == F.lower(name))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(own, F.lit(1)))


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def _leading(parts: Column) -> Column:
    """The first number of each part that has one."""
    found = F.transform(parts, lambda x: F.nullif(F.regexp_extract(x, f"({NUMBER})", 1), F.lit("")).cast("double"))
    return F.filter(found, lambda x: x.isNotNull())


def coerce_number(c: Column) -> Column:
    """One number of a cell. A bare number is itself. A `;` or `,` list, none of whose items is a range, has the mean of
    its numbers if there are two at least. Else the text is cut at range and uncertainty signs: the mean of the first two
    parts' numbers, or the only one."""
    text = F.trim(c)
    listed = F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    of_list = F.when(~F.exists(listed, lambda x: x.rlike(PARTING)), _leading(listed))
    cut = _leading(F.split(text, PARTING))
    return F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double")).when(text.rlike("[;,]") & (F.size(of_list) >= 2), mean_of(of_list)).otherwise(mean_of(F.slice(cut, 1, 2)))


def classify_value(c: Column) -> Column:
    """Struct(kind, centre) of a reported cell.

    uncertainty: the first number; list (two numbers at least): none; range: the midpoint; single; else none. A text with
    one number and words is single, one with several and a dash or `to` between them a range of the first two."""
    text = F.trim(c)
    ranged = rf"(?i)^({NUMBER})\s*(?:–|-|—|to)\s*({NUMBER})$"
    found = numbers(text)
    parts = F.filter(F.transform(F.split(text, "&&|[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    n_listed = F.aggregate(parts, F.lit(0), lambda n, x: n + F.when(x.rlike(ranged), 2).when(x.rlike(NUMBER), 1).otherwise(0))
    listed = text.rlike("&&|[;,]")
    first = F.try_element_at(found, F.lit(1))
    two = F.when(text.rlike(ranged), F.array(*[F.regexp_extract(text, ranged, i).try_cast("double") for i in (1, 2)])).otherwise(F.slice(found, 1, 2))
    kind = (
        F.when(is_missing(text), "none").when(text.rlike(UNCERTAIN) & (F.size(found) > 0), "uncertainty").when(listed & (n_listed >= 2), "list").when(listed & (n_listed == 1), "single")
        .when(text.rlike(ranged), "range").when(F.size(found) == 1, "single").when((F.size(found) >= 2) & text.rlike(r"(?i)–|-|—|\bto\b"), "range").otherwise("none")
    )
    return F.struct(kind.alias("kind"), F.when(kind.isin("uncertainty", "single"), first).when(kind == "range", mean_of(two)).alias("centre"))


def endpoints(c: Column) -> Column:
    """Values of a list or the two ends of a range: different, sorted, rounded to 12 places; several drop those <= 0."""
    text = F.regexp_replace(F.trim(c), "[–—]", "-")
    two = rf"^({NUMBER})\s*-\s*({NUMBER})$"
    raw = F.when(text.rlike(two), F.array(*[F.regexp_extract(text, two, i).try_cast("double") for i in (1, 2)])).otherwise(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x).try_cast("double")))
    found = F.array_sort(F.array_distinct(F.transform(F.filter(raw, lambda x: x.isNotNull()), lambda x: F.round(x, 12))))
    return F.coalesce(F.when(F.size(found) > 1, F.filter(found, lambda x: x > 0)).otherwise(found), F.array().cast("array<double>"))


def value_unit(c: Column) -> Column:
    """Struct(value, unit) of `12.5 mg/L`, `12.5_mg/L` or `12.5mg/L`; null parts where there is none."""
    p = rf"^\s*({NUMBER})[\s_]*(.*?)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    return F.struct(part(1).alias("value"), part(2).alias("unit"))


def percent_to_fraction(c: Column) -> Column:
    """With a percent sign, or above 1: a hundredth; six significant digits."""
    v = F.try_element_at(numbers(c), F.lit(1))
    f = F.when(c.contains("%") | (v > 1), v / 100).otherwise(v)
    digits = 5 - F.floor(F.log10(F.abs(f)))
    scale = F.pow(F.lit(10.0), digits)
    return F.when(f == 0, F.lit(0.0)).otherwise(F.round(f * scale) / scale)


#: Fixed rewriting steps of unit text, in order: (pattern, replacement). `M` is read before case is folded.
UNIT_STEPS = (
    (r"\bmM\b", "mmol/l"), (r"\bµM\b|\buM\b", "umol/l"), (r"\bnM\b", "nmol/l"), (r"\bM\b", "mol/l"),
    (r"[µμ]", "u"), (r"[·*⋅]", " "), (r"⁻¹|\^-1|−1|-1\b", "^-1"), (r"\s+", " "),
    (r"(\S+) ([a-zA-Z]+)\^-1", "$1/$2"),
)
UNIT_WORDS = (("ppm", "mg/l"), ("ppb", "ug/l"), ("ppt", "ng/l"), ("mg/dm3", "mg/l"), ("g/m3", "mg/l"), ("ug/ml", "mg/l"), ("hours", "h"), ("hour", "h"), ("hr", "h"), ("minutes", "min"), ("days", "d"))


def normalize_unit(c: Column) -> Column:
    out = F.trim(c)
    for pattern, new in UNIT_STEPS:
        out = F.regexp_replace(out, pattern, new)
    out = F.lower(F.trim(out))
    known = F.create_map(*[F.lit(x) for pair in UNIT_WORDS for x in pair])
    return F.coalesce(F.try_element_at(known, out), out)


#: Factors of unit tokens to the base of their dimension.
TOKENS = {
    "mass": {"kg": 1e6, "g": 1e3, "mg": 1.0, "ug": 1e-3, "ng": 1e-6},
    "volume": {"m3": 1e3, "l": 1.0, "ml": 1e-3, "ul": 1e-6},
    "time": {"d": 24.0, "h": 1.0, "min": 1 / 60, "s": 1 / 3600},
    "amount": {"mol": 1e3, "mmol": 1.0, "umol": 1e-3, "nmol": 1e-6},
    "area": {"m2": 1.0, "cm2": 1e-4},
}


def _token(unit: Column, wanted: str, molar_mass: Column | None) -> Column:
    """Factor of one token to the wanted dimension's base; amounts become masses by way of the molar mass."""
    known = F.create_map(*[F.lit(x) for pair in TOKENS[wanted].items() for x in pair])
    found = F.try_element_at(known, unit)
    if wanted == "mass" and molar_mass is not None:
        mols = F.create_map(*[F.lit(x) for pair in TOKENS["amount"].items() for x in pair])
        found = F.coalesce(found, F.try_element_at(mols, unit) * molar_mass)
    return found


def unit_factor(unit: Column, over: str, under: str | None = None, molar_mass: Column | None = None) -> Column:
    """Factor from a normalised unit to base(over)/base(under); null where the dimensions don't fit."""
    parts = F.split(unit, "/")
    top = _token(parts[0], over, molar_mass)
    if under is None:
        return F.when(F.size(parts) == 1, top)
    return F.when(F.size(parts) == 2, top * _token(F.try_element_at(parts, F.lit(2)), under, molar_mass))


def convert(value: Column, unit: Column, over: str, under: str | None = None, molar_mass: Column | None = None) -> Column:
    """Struct(value, reason): the value in base units, or why there is none."""
    factor = unit_factor(normalize_unit(unit), over, under, molar_mass)
    reason = F.when(value.isNull(), "no value").when(is_missing(unit), "no unit").when(factor.isNull(), "unit mismatch")
    return F.struct((value * factor).alias("value"), reason.alias("reason"))


#: Exact decimal factors of concentration units to mg/L.
MG_PER_L = {"g/l": "1000", "mg/l": "1", "ug/l": "0.001", "ng/l": "0.000001"}


def to_mg_per_l(value: Column, unit: Column) -> Column:
    factor = F.try_element_at(F.create_map(*[x for u, f in MG_PER_L.items() for x in (F.lit(u), F.lit(f).cast("decimal(18,9)"))]), normalize_unit(unit))
    return (value.cast("decimal(18,6)") * factor).cast("decimal(38,12)")


def doi_key(c: Column) -> Column:
    """Bare lower-case DOI, or null if it is none."""
    bare = F.regexp_replace(folded(c), r"^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def cas_number(c: Column) -> Column:
    """A CAS number whose check digit is right, else null."""
    bare = F.trim(c)
    digits = F.regexp_replace(bare, "-", "")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits) - 1), F.lit(0), lambda s, i: s + i * F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int"))
    return F.when(F.when(bare.rlike(r"^\d{2,7}-\d{2}-\d$"), F.pmod(total, F.lit(10)) == F.right(digits, F.lit(1)).cast("int")), bare)


def substance_id(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up.rlike(r"^DTXSID\d{7,}$"), up)


def yes_no(c: Column) -> Column:
    return F.when(folded(c).rlike("^(y|yes|true|1)\\b"), "Y").otherwise("N")


def finite_number(c: Column, positive: bool = False, nonnegative: bool = False) -> Column:
    v = c.try_cast("double")
    good = ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = good & (v > 0) if positive else good & (v >= 0) if nonnegative else good
    return F.when(good, v)


def composite_id(c: Column, slots: int = 4) -> Column:
    """The trimmed slots of `a|b|c|d`; null unless there are just so many and none is blank."""
    parts = F.transform(F.split(c, r"\|"), lambda x: F.trim(x))
    return F.when((F.size(parts) == slots) & ~F.exists(parts, lambda x: x == ""), parts)


def add_note(notes: Column, note: Column) -> Column:
    """`; `-joined notes with the new one, unless it is there already."""
    have = F.coalesce(F.split(blank_to_null(notes), "; "), F.array().cast("array<string>"))
    return F.array_join(F.array_distinct(F.when(note.isNull(), have).otherwise(F.array_append(have, note))), "; ")


def natural_number(c: Column) -> Column:
    """The trailing number of a name, for natural order; null where there is none."""
    return F.regexp_extract(c, r"(\d+)\s*$", 1).try_cast("long")


def ordered_tokens(tokens: Column, rank: Mapping[str, int], other: int) -> Column:
    """Tokens by the rank of their category (the text before `=`), then by text."""
    of = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    ranked = F.transform(tokens, lambda t: F.struct(F.coalesce(F.try_element_at(of, F.split(t, "=")[0]), F.lit(other)).alias("r"), t.alias("t")))
    return F.transform(F.array_sort(ranked), lambda s: s.t)


#: How far several reported fractions may spread relative to their mean, how far a total may pass 1.
SPREAD, TOTAL_SLACK = 0.10, 1e-3


def bounded_fraction(values: Column, coherence: float = SPREAD, name: str = "fraction", percent: Column | None = None) -> Column:
    """Struct(value, note) of several reported fractions.

    Values above 1 are percents (all of them, where `percent` holds); what is then outside 0..1 voids the cell. Several
    values have a mean only if their spread relative to it is within `coherence`."""
    whole = F.lit(False) if percent is None else percent
    scaled = F.transform(values, lambda v: F.when(whole | (v > 1), v / 100).otherwise(v))
    outside = F.exists(scaled, lambda v: (v < 0) | (v > 1))
    mean, spread = mean_of(scaled), F.array_max(scaled) - F.array_min(scaled)
    wide = (F.size(scaled) > 1) & F.when(F.abs(mean) <= 1e-12, spread > 1e-12).otherwise(F.try_divide(spread, F.abs(mean)) > coherence)
    empty = values.isNull() | (F.size(values) == 0)
    note = F.when(empty, F.lit(None).cast("string")).when(outside, f"{name} outside 0..1").when(wide, f"{name} values disagree")
    return F.struct(F.when(~empty & ~outside & ~wide, mean).alias("value"), note.alias("note"))


def elemental_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arrays of reported element contents as fractions, with `element_note`. One value above 1 makes the whole row a table
    of percents; a row whose fractions add up to more than 1 has none."""
    percent = F.exists(F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<double>")) for c in columns])), lambda v: v > 1)
    out = df.withColumn("__percent", percent).withColumns({f"__b_{c}": bounded_fraction(F.col(c), name=c, percent=F.col("__percent")) for c in columns})
    notes = F.concat_ws("; ", *[F.col(f"__b_{c}.note") for c in columns])
    total = sum((F.coalesce(F.col(f"__b_{c}.value"), F.lit(0.0)) for c in columns), F.lit(0.0))
    over = (notes == "") & (total > 1 + TOTAL_SLACK)
    out = out.withColumn("element_note", F.when(over, "total above 1").when(notes != "", notes)).withColumn("__over", over)
    return out.withColumns({c: F.when(~F.col("__over"), F.col(f"__b_{c}.value")) for c in columns}).drop("__percent", "__over", *[f"__b_{c}" for c in columns])


def closest_pair_value(keys: Column, values: Column, wanted: float) -> Column:
    """Of lists of equal length, the value whose key is closest to the wanted one, the first of equals."""
    zipped = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda s, i: F.struct(F.abs(s["k"] - wanted).alias("d"), i.alias("i"), s["v"].alias("v")))
    return F.when(F.size(keys) == F.size(values), F.array_min(zipped)["v"])


def indicator(labels: Column, label: str) -> Column:
    """Three-valued: null where nothing is reported."""
    return F.when(labels.isNotNull(), F.array_contains(labels, label))
