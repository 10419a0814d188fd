"""Curation: vocabularies, label rules, identity keys, composite ids, staged evaluation, guarded upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .match import first_per_key


def map_values(df: DataFrame, sources: Sequence[str], mapping: DataFrame, name: str, blank_only: str | None = None) -> DataFrame:
    """Adds name: the canonical value of the first source column whose normalised key is in mapping(key, canonical).

    Of equal keys the least canonical value counts. With blank_only, filled cells of that column stay."""
    one = mapping.groupBy(X.identity_key(F.col("key")).alias("__key")).agg(F.min("canonical").alias("__c"))
    out, found = df, []
    for i, s in enumerate(sources):
        out = out.join(one.select(F.col("__key").alias(f"__k{i}"), F.col("__c").alias(f"__c{i}")), X.identity_key(F.col(s)) == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__c{i}"))
    if blank_only:
        found.insert(0, X.blank_to_null(F.col(blank_only)))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"__{x}{i}" for i in range(len(sources)) for x in "kc"])


def label_by_rules(c: Column, rules: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """The label of the first pattern that is found in the text, without regard to case."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, label in rules:
        out = out.when(c.rlike(f"(?i){pattern}"), label)
    return out.otherwise(other)


def freundlich_constant(kf: Column, exponent: Column, over: Column, under: Column) -> Column:
    """KF in other units: uptake factor over the concentration factor to the exponent."""
    return F.when((over > 0) & (under > 0) & exponent.isNotNull(), kf * over / F.pow(under, exponent))


def inferred_kf_unit(qm_unit: Column, kl_unit: Column, exponent_form: Column) -> Column:
    """The unit of Qm over the inverse of KL's to the stated exponent form; null where one is missing."""
    parts = F.split(X.normalize_unit(kl_unit), "/")
    inverse = F.concat(F.try_element_at(parts, F.lit(2)), F.lit("/"), parts[0])
    return F.when(F.size(parts) == 2, F.concat(X.normalize_unit(qm_unit), F.lit("/("), inverse, F.lit(")^"), exponent_form))


def grain_size_mm(c: Column, unit: Column) -> Column:
    """Mean of the ends of a grain size in mm; units um, mm, cm."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for p in (("um", 1e-3), ("mm", 1.0), ("cm", 10.0)) for x in p]), X.normalize_unit(unit))
    ends = X.endpoints(c)
    return X.mean_of(ends) * factor


def to_molar(value: Column, unit: Column, molar_mass: Column) -> Column:
    """mol/L from an amount or a mass concentration."""
    u = X.normalize_unit(unit)
    amount, mass = X.unit_factor(u, "amount", "volume"), X.unit_factor(u, "mass", "volume")
    return F.coalesce(value * amount / 1000, value * mass / 1000 / molar_mass)


def joined_value_units(c: Column) -> Column:
    """`3 mg and 5 mg` as `3; 5 mg`; `7 mg/241_mL` as mg per mL."""
    n = X.NUMBER
    pair = rf"^\s*({n})\s*(\S*)\s+and\s+({n})\s*(\S+)\s*$"
    over = rf"^\s*({n})\s*([A-Za-zµ]+)\s*/\s*({n})[_\s]*([A-Za-z]+)\s*$"
    g = lambda p, i: F.regexp_extract(c, p, i)
    same = (g(pair, 2) == "") | (g(pair, 2) == g(pair, 4))
    ratio = F.try_divide(g(over, 1).try_cast("double"), g(over, 3).try_cast("double"))
    return F.when(c.rlike(pair) & same, F.concat(g(pair, 1), F.lit("; "), g(pair, 3), F.lit(" "), g(pair, 4))).when(c.rlike(over), F.concat(F.round(ratio, 9).cast("string"), F.lit(" "), g(over, 2), F.lit("/"), g(over, 4))).otherwise(c)


def descriptors(c: Column, names: Sequence[str]) -> list[Column]:
    """`a: 1; b=2` as columns; the first of repeated names counts."""
    parts = F.filter(F.transform(X.items(c), lambda x: F.split(x, r"\s*[:=]\s*", 2)), lambda p: F.size(p) == 2)
    value = lambda name: F.try_element_at(F.filter(parts, lambda p: F.lower(p[0]) == name.lower()), F.lit(1))[1]
    return [value(n).alias(n) for n in names]


def applicable(value: Column, category: Column, inapplicable: Mapping[str, Sequence[str]], field: str) -> Column:
    """Struct(value, applicable, warning): null while the category is unknown; a value where none applies is a warning, zero is not."""
    never = [k for k, fields in inapplicable.items() if field in fields]
    ok = F.when(~X.is_missing(category), ~category.isin(*never))
    return F.struct(F.when(F.coalesce(ok, F.lit(True)), value).alias("value"), ok.alias("applicable"), F.when(~ok & (value != 0), f"{field} does not apply").alias("warning"))


def classify_fragments(df: DataFrame, key: str, notes: str, rules: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(key, label, status): note fragments by the first matching (pattern, label, priority); the highest priority of a row is its status."""
    parts = df.select(key, F.explode(F.split(F.coalesce(notes, F.lit("")), "; ")).alias("f")).where("f <> ''")
    label, priority = label_by_rules(F.col("f"), [(p, n) for p, n, _ in rules], "other"), F.lit(0)
    of = F.create_map(*[x for _, n, k in rules for x in (F.lit(n), F.lit(k))])
    rows = parts.select(key, label.alias("label")).withColumn("priority", F.coalesce(F.try_element_at(of, F.col("label")), priority))
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("labels"), F.max("priority").alias("priority"))


def specific_identity(status: Column, name: Column, study: Column, local: Column, row: Column) -> tuple[Column, Column]:
    """(key, basis): `specific::name` across studies, else the study's own id, else study and source row."""
    n, l = X.identity_key(name), X.blank_to_null(local)
    specific = (status == "specific") & (n != "")
    key = F.when(specific, F.concat(F.lit("specific::"), n)).when(l.isNotNull(), F.concat_ws("::", F.lit("study"), study, l)).otherwise(F.concat_ws("::", F.lit("row"), study, row.cast("string")))
    return key, F.when(specific, "name").when(l.isNotNull(), "study id").otherwise("row")


def alias_dimension(records: DataFrame, ids: Sequence[str], order: str) -> DataFrame:
    """A row per different identifier of each record; of equal identifiers the first record counts."""
    tall = records.withColumn("alias", F.explode(F.array_distinct(F.array_compact(F.array(*[X.blank_to_null(F.col(i).cast("string")) for i in ids])))))
    return first_per_key(tall, ["alias"], [F.col(order)])


def canonical_id(c: Column, equivalences: Mapping[str, str] | None = None, slots: int = 4) -> Column:
    """A composite id with folded slots, equivalent names replaced, and its condition slot's tokens in order; null unless whole."""
    same = F.create_map(*[F.lit(x) for p in (equivalences or {"": ""}).items() for x in p])
    parts = X.composite_id(F.lower(c), slots)
    named = F.transform(F.slice(parts, 1, slots - 1), lambda x: F.coalesce(F.try_element_at(same, x), x))
    tokens = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(F.try_element_at(parts, F.lit(slots)), r"[,;]"), lambda x: F.trim(x)))), ",")
    return F.when(parts.isNotNull(), F.concat_ws("|", F.array_join(named, "|"), tokens))


def unique_pairs(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs of equal keys that are unique on both sides."""
    once = lambda d, i: d.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(i).alias(i), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return once(left, left_id).join(once(right, right_id), key)


def staged_evaluation(truth: DataFrame, guess: DataFrame, stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, tp, and the last row's fp, fn): stages of matched (t, g) pairs in turn, each on what is left of both sides."""
    t, g, out = truth.select("t"), guess.select("g"), None
    for name, pairs in stages:
        own = pairs.join(t, "t", "left_semi").join(g, "g", "left_semi").select("t", "g")
        t, g = t.join(own, "t", "left_anti"), g.join(own, "g", "left_anti")
        row = own.select(F.lit(name).alias("stage"), F.lit(1).alias("k"))
        out = row if out is None else out.unionByName(row)
    rest = t.select(F.lit("fn").alias("stage"), F.lit(1).alias("k")).unionByName(g.select(F.lit("fp").alias("stage"), F.lit(1).alias("k")))
    return out.unionByName(rest).groupBy("stage").agg(F.sum("k").alias("n"))


def clause_filter(df: DataFrame, clauses: Sequence[str]) -> DataFrame:
    """Rows that meet all `column=value`; values are compared as text."""
    for c in clauses:
        name, _, value = c.partition("=")
        df = df.where(F.col(name.strip()).cast("string") == value.strip())
    return df


def category_filter(df: DataFrame, column: str, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows of the wanted categories, and which of these the table does not know."""
    found = {r[0] for r in df.where(F.col(column).isin(*wanted)).select(column).distinct().collect()}
    return df.where(F.col(column).isin(*wanted)), [f"unknown {column}: {w}" for w in wanted if w not in found]


def envelope_upsert(old: DataFrame, new: DataFrame, key: str, sources: str) -> DataFrame:
    """Rows after an upsert by source envelope, with `action`.

    A new row whose set of sources equals an old one's replaces it; one that overlaps others in part is refused; else it
    is appended. Repeated envelopes on either side fail the query."""
    norm = lambda d, n: d.withColumn(n, F.array_sort(F.array_distinct(sources)))
    o, n = norm(old, "__e"), norm(new, "__e")
    for d, side in ((o, "old"), (n, "new")):
        if not d.groupBy("__e").count().where("count > 1").isEmpty():
            raise ValueError(f"repeated envelopes among the {side} rows")
    hit = n.join(o.select("__e"), "__e", "left_semi").select("__e")
    parts = lambda d, i: d.select(F.col(key).alias(i), "__e", F.explode("__e").alias("__s"))
    rest = n.join(hit, "__e", "left_anti")
    partial = parts(rest, "__n").join(parts(o, "__o").select("__s", "__o"), "__s").select(F.col("__n").alias(key)).distinct()
    kept = o.join(hit, "__e", "left_anti").withColumn("action", F.lit("kept"))
    replaced = n.join(hit, "__e", "left_semi").withColumn("action", F.lit("replaced"))
    refused = rest.join(partial, key, "left_semi").withColumn("action", F.lit("refused"))
    added = rest.join(partial, key, "left_anti").withColumn("action", F.lit("appended"))
    return kept.unionByName(replaced).unionByName(refused).unionByName(added).drop("__e")


def screen_residuals(df: DataFrame, assignment: str, residual: str, candidates: Sequence[str], least: int = 3) -> DataFrame:
    """(feature, assignments, sign, strength): features whose correlation with the residual has one sign in all assignments."""
    from .aggregate import correlation, median

    tall = df.select(assignment, residual, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in candidates])).alias("s")).select(assignment, residual, "s.*")
    each = tall.where(F.col("v").isNotNull() & F.col(residual).isNotNull()).groupBy("feature", assignment).agg(F.count(F.lit(1)).alias("n"), correlation("v", residual).alias("r")).where(F.col("n") >= least)
    return each.groupBy("feature").agg(F.count("r").alias("assignments"), F.when(F.min("r") > 0, 1).when(F.max("r") < 0, -1).otherwise(0).alias("sign"), median("r").alias("strength"))


def convert_all(df: DataFrame, specs: Mapping[str, tuple[str, str, str | None]], molar_mass: Column | None = None) -> DataFrame:
    """A column `<name>_std` and `<name>_reason` for each spec name -> (unit column, dimension, dimension below or None)."""
    out = df.withColumns({f"__{c}": X.convert(F.col(c).cast("double"), F.col(u), over, under, molar_mass) for c, (u, over, under) in specs.items()})
    out = out.withColumns({f"{c}_std": F.col(f"__{c}.value") for c in specs} | {f"{c}_reason": F.col(f"__{c}.reason") for c in specs})
    return out.drop(*[f"__{c}" for c in specs])


def range_context(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ranges and lists keep their text in `<column>_context` and lose the scalar; uncertain values keep their centre."""
    out = df.withColumns({f"__{c}": X.classify_value(F.col(c)) for c in columns})
    wide = {c: F.col(f"__{c}.kind").isin("range", "list") for c in columns}
    out = out.withColumns({f"{c}_context": F.when(w, F.col(c)) for c, w in wide.items()})
    return out.withColumns({c: F.when(~w, F.col(f"__{c}.centre")) for c, w in wide.items()}).drop(*[f"__{c}" for c in columns])


def plausible_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, slots: int = 4) -> DataFrame:
    """Pairs of canonical ids (left.key, right.key) with equal slots whose condition tokens don't contradict.

    Contradictions: one side's tokens are a strict subset of the other's; both give a value for the same subject (the text
    before `=`) and the values differ."""
    parts = lambda d, i, n: d.where(F.col("key").isNotNull()).select(i, F.array_join(F.slice(F.split("key", r"\|"), 1, slots - 1), "|").alias("head"), F.split(F.element_at(F.split("key", r"\|"), slots), ",").alias(n))
    pairs = parts(left, left_id, "a").join(parts(right, right_id, "b"), "head")
    subset = lambda x, y: (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) > 0)
    subject = lambda t: F.split(t, "=")[0]
    differ = F.exists("a", lambda s: F.exists("b", lambda t: (subject(s) == subject(t)) & (s != t) & s.contains("=") & t.contains("=")))
    return pairs.where(~subset("a", "b") & ~subset("b", "a") & ~differ).select(left_id, right_id)


def replace_texts(df: DataFrame, decisions: DataFrame, key: str, column: str) -> DataFrame:
    """decisions(key, old, new): the approved old text becomes the new one wherever the row's cell holds it; `replaced` says so."""
    d = decisions.select(F.col(key), F.col("old").alias("__old"), F.col("new").alias("__new"))
    out = df.join(d, key, "left").withColumn("replaced", F.coalesce(F.col(column).contains(F.col("__old")), F.lit(False)))
    return out.withColumn(column, F.when(F.col("replaced"), F.replace(F.col(column), F.col("__old"), F.col("__new"))).otherwise(F.col(column))).drop("__old", "__new")
