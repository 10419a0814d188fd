"""Joins and matching: enrichment, cascades, tolerance matches, aliases, precedence between sources.

Right sides that are deduplicated are so by an explicit order; no function relies on arrival order. Sizes
decide between broadcast and shuffle (adaptive execution); nothing is broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import blank_to_null
from .tables import Scratch


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order. An aggregate with partial sums, not a window: a hot key costs no task its rows."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others]).alias("__row")
    ranked = F.struct(*[F.struct(o.isNull(), o) if not isinstance(o, str) else o for o in order])
    out = df.groupBy(*keys).agg(F.min_by(row, ranked).alias("__row"))
    return out.select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def unique_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where the key stands for one value only; null and blank keys are no keys."""
    rows = df.where(blank_to_null(F.col(key)).isNotNull())
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__max")).where(F.col(value) == F.col("__max")).drop("__max")


def fill_blanks(left: DataFrame, right: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """N:1 enrichment: the first right row per key fills blank cells of columns both have and adds the others."""
    one = first_per_key(right, [key], order)
    both = [c for c in one.columns if c != key and c in left.columns]
    one = one.withColumnsRenamed({c: f"__right_{c}" for c in both})
    joined = left.join(one, key, "left")
    return joined.withColumns({c: F.coalesce(blank_to_null(F.col(c)), F.col(f"__right_{c}")) for c in both}).drop(*[f"__right_{c}" for c in both])


def cascade(left: DataFrame, indexes: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """Adds value and `matched_by`: of (left column, unique index keyed by it) in turn, the first that has the row's key."""
    out, steps = left, []
    for i, (column, index) in enumerate(indexes):
        key = [c for c in index.columns if c != value][0]
        out = out.join(index.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}")), F.col(column) == F.col(f"__k{i}"), "left")
        steps.append((column, F.col(f"__v{i}")))
    by = F.coalesce(*[F.when(v.isNotNull(), F.lit(c)) for c, v in steps])
    out = out.withColumns({value: F.coalesce(*[v for _, v in steps]), "matched_by": by})
    return out.drop(*[f"__{x}{i}" for i in range(len(indexes)) for x in "kv"])


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A one-to-one join; a repeated key on either side fails the query when it runs."""

    def once(df: DataFrame, side: str) -> DataFrame:
        alone = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return df.withColumn("__ok", F.when(alone > 1, F.raise_error(F.concat(F.lit(f"{side} key repeats: "), F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(True)).where("__ok").drop("__ok")

    return once(left, "left").join(once(right, "right"), list(keys), how)


@dataclass(frozen=True)
class Tolerance:
    """How far an observed number may be from the requested one: absolute, or of the decimal logarithms."""

    limit: float
    logarithmic: bool = False

    def distance(self, seen: Column, wanted: Column) -> Column:
        """Distance over the limit; null (no match) for a missing value, or a zero against a non-zero logarithm."""
        if not self.logarithmic:
            return F.abs(seen - wanted) / self.limit
        return F.when((seen == 0) & (wanted == 0), F.lit(0.0)).when((seen > 0) & (wanted > 0), F.abs(F.log10(F.when(seen > 0, seen)) - F.log10(F.when(wanted > 0, wanted))) / self.limit)


SLACK = 1e-12


def tolerance_match(requests: DataFrame, evidence: DataFrame, on: Sequence[str], fields: Mapping[str, Tolerance], required: Sequence[str] = ()) -> DataFrame:
    """Pairs that agree on all identities and lie within every tolerance, with `distance`, the mean over the fields.

    requests have columns `want_<field>`; null there means that the field isn't asked for.
    """
    pairs = requests.join(evidence, list(on))
    each = {f: t.distance(F.col(f), F.col(f"want_{f}")) for f, t in fields.items()}
    asked = {f: F.col(f"want_{f}").isNotNull() for f in fields}
    for f, d in each.items():
        pairs = pairs.where(~asked[f] | F.coalesce(d <= 1 + SLACK, F.lit(False)))
    for flag in required:
        pairs = pairs.where(F.coalesce(F.col(flag), F.lit(False)))
    total = sum((F.when(asked[f], d).otherwise(0.0) for f, d in each.items()), F.lit(0.0))
    n = sum((asked[f].cast("int") for f in fields), F.lit(0))
    return pairs.withColumn("distance", F.coalesce(F.try_divide(total, n), F.lit(0.0)))


def exclusion_reasons(requests: DataFrame, evidence: DataFrame, on: Sequence[str], fields: Mapping[str, Tolerance]) -> DataFrame:
    """Pairs of the same identities that are not comparable, with an array of why."""
    pairs, reasons = requests.join(evidence, list(on)), []
    for f, t in fields.items():
        seen, wanted = F.col(f), F.col(f"want_{f}")
        ok = F.coalesce(t.distance(seen, wanted) <= 1 + SLACK, F.lit(False))
        reasons.append(F.when(wanted.isNotNull() & ~ok, F.when(seen.isNull(), f"{f} missing").otherwise(f"{f} out of tolerance")))
    return pairs.withColumn("reasons", F.array_compact(F.array(*reasons))).where(F.size("reasons") > 0)


def related_pick(requests: DataFrame, evidence: DataFrame, on: Sequence[str], fields: Mapping[str, Tolerance], study: str, tie: Sequence[str], most: int = 10) -> DataFrame:
    """Evidence that is related but not comparable, at most `most` rows a request: first the best row of each study, then the
    others. The order is fewest differences, least distance (an unknown one counts a million), `tie`. Adds `reasons`,
    `differences`, `distance_sum` and `place`. Rows without a study come with the others."""
    pairs = exclusion_reasons(requests, evidence, on, fields)
    far = [F.when(F.col(f"want_{f}").isNotNull(), F.coalesce(t.distance(F.col(f), F.col(f"want_{f}")), F.lit(1e6))).otherwise(0.0) for f, t in fields.items()]
    pairs = pairs.withColumns({"differences": F.size("reasons"), "distance_sum": sum(far, F.lit(0.0))})
    order = [F.col("differences"), F.col("distance_sum"), *[F.col(c) for c in tie]]
    known = blank_to_null(F.col(study).cast("string")).isNotNull()
    first = known & (F.row_number().over(Window.partitionBy(*on, study).orderBy(*order)) == 1)
    pairs = pairs.withColumn("__late", (~first).cast("int"))
    return best_matches(pairs, on, [F.col("__late"), *order], most).drop("__late")


def best_matches(pairs: DataFrame, request: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` pairs of each request, with their place."""
    place = F.row_number().over(Window.partitionBy(*request).orderBy(*order)).cast("long")
    return pairs.withColumn("place", place).where(F.col("place") <= most)


#: Ids of a class in one row.
BLOCK = 1024


def alias_pairs(left: DataFrame, left_id: str, left_aliases: str, right: DataFrame, right_id: str, right_aliases: str) -> DataFrame:
    """Different (left id, right id) that share at least one alias, and how many.

    Ids with equal alias sets are a class. Only classes are joined by alias and counted; a pair of classes meets its ids,
    in blocks of BLOCK, at the very end, so the pairs of ids are never exchanged. Ids' repeated rows add up."""
    scratch = Scratch(left.sparkSession)

    def classes(rows: DataFrame, key: str, aliases: str, side: str) -> tuple[DataFrame, DataFrame]:
        """(class, aliases), and (class, block, ids)."""
        own = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(aliases)))))
        rows = scratch.table(rows.groupBy(F.col(key).alias("__id")).agg(own.alias("__a")).where(F.size("__a") > 0), f"{side}_rows")
        known = scratch.table(rows.select("__a").distinct().withColumn(f"__{side}", F.monotonically_increasing_id()), f"{side}_classes")
        of = rows.join(known, "__a").groupBy(f"__{side}").agg(F.count(F.lit(1)).alias("__n"))
        block = F.pmod(F.xxhash64("__id"), F.ceil(F.col("__n") / BLOCK).cast("long"))
        ids = rows.join(known, "__a").join(of, f"__{side}").groupBy(f"__{side}", block.alias("__block")).agg(F.collect_list(F.struct("__id")).alias(f"__{side}_ids")).drop("__block")
        return known.select(f"__{side}", F.explode("__a").alias("__alias")), ids

    (l, l_ids), (r, r_ids) = classes(left, left_id, left_aliases, "l"), classes(right, right_id, right_aliases, "r")
    pairs = l.join(r, "__alias").groupBy("__l", "__r").agg(F.count(F.lit(1)).alias("shared"))
    met = pairs.join(r_ids, "__r").join(l_ids, "__l").select("__l_ids", "__r_ids", "shared")
    met = met.select(F.explode("__l_ids").alias("__x"), "__r_ids", "shared").select("__x", F.explode("__r_ids").alias("__y"), "shared")
    return met.select(F.col("__x.__id").alias(left_id), F.col("__y.__id").alias(right_id), "shared")


def overlay(df: DataFrame, decisions: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """df with the decided value, and the decisions that found no row."""
    return df.join(decisions.select(key, value), key, "left"), decisions.join(df.select(key).distinct(), key, "left_anti")


def guarded_override(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """overrides(key, expected, value): column becomes value where it still is what was expected; `overridden` says so."""
    o = overrides.select(F.col(key), F.col("expected").alias("__expected"), F.col("value").alias("__value"))
    out = df.join(o, key, "left").withColumn("overridden", F.coalesce(F.col(column) == F.col("__expected"), F.lit(False)))
    return out.withColumn(column, F.when(F.col("overridden"), F.col("__value")).otherwise(F.col(column))).drop("__expected", "__value")


def merge_sources(base: DataFrame, second: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """base with second's cells by rule: `fill` (blank cells only), `override` (whatever second has). `<column>_from`
    tells: filled, overridden, unchanged or blank. Keys that only second has are left out."""
    s = second.select(key, *[F.col(c).alias(f"__s_{c}") for c in rules])
    out = base.join(s, key, "left")
    for c, rule in rules.items():
        own, other = blank_to_null(F.col(c)), blank_to_null(F.col(f"__s_{c}"))
        status = F.when(own.isNull() & other.isNotNull(), "filled").when(own.isNull(), "blank")
        if rule == "override":
            status = status.when(other.isNotNull() & (other != own), "overridden")
        out = out.withColumn(f"{c}_from", status.otherwise("unchanged"))
        out = out.withColumn(c, F.when(F.col(f"{c}_from").isin("filled", "overridden"), F.col(f"__s_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"__s_{c}" for c in rules])


def compare_snapshots(left: DataFrame, right: DataFrame, key: str, value: str, comparable: Column) -> DataFrame:
    """Full-outer comparison: note on the missing side, delta where both are there and comparable."""
    l, r = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("__l")), right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("__r"))
    both = l.join(r, key, "full_outer")
    note = F.when(F.col("__l").isNull(), "only right").when(F.col("__r").isNull(), "only left").otherwise("both")
    return both.withColumns({"note": note, "delta": F.when(F.col("__l") & F.col("__r") & comparable, F.col("right_value") - F.col("left_value"))}).drop("__l", "__r")


def align_level(df: DataFrame, column: str, levels: DataFrame, level: str, qualified: bool = False) -> DataFrame:
    """Adds `aligned`: the observed level that is the value itself, else in folded case, else as a number, else (`qualified`)
    without what stands in parentheses and by letters and digits alone, else the value."""
    known = levels.select(level).distinct()
    bare = lambda c: F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit(""))
    exact = known.select(F.col(level).alias("__k0"), F.col(level).alias("__v0"))
    folded = known.groupBy(F.lower(F.trim(level)).alias("__k1")).agg(F.min(level).alias("__v1"))
    number = known.where(F.col(level).try_cast("double").isNotNull()).groupBy(F.col(level).try_cast("double").alias("__k2")).agg(F.min(level).alias("__v2"))
    c, steps = F.col(column), ["__v0", "__v1", "__v2"]
    out = df.join(exact, c == F.col("__k0"), "left").join(folded, F.lower(F.trim(c)) == F.col("__k1"), "left").join(number, c.try_cast("double") == F.col("__k2"), "left")
    if qualified:
        plain = known.groupBy(bare(F.col(level)).alias("__k3")).agg(F.min(level).alias("__v3")).where("__k3 is not null")
        out, steps = out.join(plain, bare(F.regexp_replace(c, r"\s*\([^)]*\)", "")) == F.col("__k3"), "left"), [*steps, "__v3"]
    return out.withColumn("aligned", F.coalesce(*steps, c)).drop(*[f"__{x}{i}" for x in "kv" for i in range(len(steps))])


def stable_aliases(pairs: DataFrame, cls: str, alias: str) -> DataFrame:
    """Aliases that stand in one class only, with it."""
    return pairs.groupBy(alias).agg(F.min(cls).alias(cls), F.count_distinct(cls).alias("__n")).where("__n = 1").drop("__n")


def fifo_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """One-to-one exact matches: of equal keys, the n-th left row (by id) goes with the n-th right row."""
    nth = lambda df, i: df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(i)))
    return nth(left.select(left_id, *keys), left_id).join(nth(right.select(right_id, *keys), right_id), [*keys, "__nth"]).select(left_id, right_id, *keys)


def refresh_lineage(old: DataFrame, fresh: DataFrame, keys: Sequence[str], content: Sequence[str], old_id: str, fresh_id: str, fuzzy: DataFrame | None = None) -> DataFrame:
    """(old_id, fresh_id, method): what each fresh row takes over from an old one: the row of the same unique source key,
    else of equal content, n-th with n-th, else by `fuzzy` pairs (old_id, fresh_id), if given. A repeated source key, or a
    fresh row that finds none, raises an error with the first eight, as nothing may be taken over unsafely."""

    def refuse(rows: DataFrame, columns: Sequence[str], why: str) -> None:
        if found := rows.select(*columns).orderBy(*columns).limit(8).collect():
            raise ValueError(f"{why}: {[tuple(r) for r in found]}")

    for side, name in ((old, "old"), (fresh, "fresh")):
        refuse(side.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), keys, f"repeated source keys among {name} rows")
    same = old.select(old_id, *keys).join(fresh.select(fresh_id, *keys), list(keys)).select(old_id, fresh_id, F.lit("source_key").alias("method"))
    rest = lambda d, i, done: d.join(done.select(i), i, "left_anti")
    equal = fifo_pairs(rest(old, old_id, same), rest(fresh, fresh_id, same), content, old_id, fresh_id).select(old_id, fresh_id, F.lit("content").alias("method"))
    out = same.unionByName(equal)
    if fuzzy is not None:
        near = rest(rest(fuzzy.select(old_id, fresh_id), old_id, out), fresh_id, out)
        out = out.unionByName(near.select(old_id, fresh_id, F.lit("similar").alias("method")))
    refuse(rest(fresh, fresh_id, out), [fresh_id, *keys], "fresh rows without an old one")
    return out


#: How many close names are suggested, and the ratio that they need.
SUGGESTED, CLOSE = 5, 0.45


def suggestions(missing: DataFrame, key: str, known: DataFrame, name: str, most: int = SUGGESTED, least: float = CLOSE, block: int = 2048) -> DataFrame:
    """(key, suggestions): for each missing name up to `most` of the known names whose sequence matcher's ratio is `least` or
    more, best first (ties: the later name). Meant for short lists: blocks of the known names meet every missing name."""
    from difflib import SequenceMatcher
    from heapq import nlargest

    import pandas as pd

    n = max(1, -(-known.count() // block))
    blocks = known.select(F.col(name).alias("__n")).where(F.col(name).isNotNull()).distinct().groupBy(F.pmod(F.xxhash64("__n"), F.lit(n)).alias("__b")).agg(F.collect_list("__n").alias("__names"))
    kind = missing.schema[key].dataType.simpleString()

    def each(batches):
        for batch in batches:
            rows = []
            for own, names in zip(batch["__k"], batch["__names"]):
                matcher = SequenceMatcher()
                matcher.set_seq2(own)
                scored = []
                for other in names:
                    matcher.set_seq1(other)
                    if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (r := matcher.ratio()) >= least:
                        scored.append((r, other))
                rows += [(own, r, other) for r, other in nlargest(most, scored)]
            yield pd.DataFrame(rows, columns=["__k", "__r", "__n"])

    names = missing.select(F.col(key).alias("__k")).where(F.col(key).isNotNull()).distinct()
    pairs = names.crossJoin(blocks).mapInPandas(each, f"__k {kind}, __r double, __n string")  # a row for each name and block
    best = pairs.withColumn("__i", F.row_number().over(Window.partitionBy("__k").orderBy(F.desc("__r"), F.desc("__n")))).where(F.col("__i") <= most)
    listed = best.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__n"))), lambda x: x["__n"]).alias("suggestions"))
    return names.join(listed, "__k", "left").select(F.col("__k").alias(key), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def unseen(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the selected keys, and all of new."""
    return old.join(selected.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
