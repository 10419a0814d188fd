"""Audits and consolidation of records: residuals by group, review queues, golden values, coverage, retention, leaks.

All are functions of a table and of the names of its columns. Thresholds are parameters. Sums and counts have
partial aggregation; a median meets a group of entities in one task, never a group of rows, unless it says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import blank_to_null
from .aggregate import consensus, median, spearman
from .ranks import join_null_safe, running
from .tables import Scratch


def two_stage_residuals(df: DataFrame, group: Sequence[str], source: str, assignment: str, residual: Column, weight: Column | None = None) -> DataFrame:
    """(group, residual, assignments): the weighted mean of each source's residuals in an assignment, the mean over its
    sources, then the median over assignments."""
    w = F.lit(1.0) if weight is None else weight
    each = df.groupBy(*group, assignment, source).agg(F.try_divide(F.sum(w * residual), F.sum(F.when(residual.isNotNull(), w))).alias("__m"))
    means = each.groupBy(*group, assignment).agg(F.avg("__m").alias("__m"))
    return means.groupBy(*group).agg(median("__m").alias("residual"), F.count(F.lit(1)).alias("assignments"))


def unit_coverage(df: DataFrame, by: Sequence[str], unit: str, when: Mapping[str, Column] | None = None) -> DataFrame:
    """(by, units, coverage, and a count of units for each condition of `when`): different units, and their share of all."""
    everyone = df.agg(F.count_distinct(unit).alias("__all"))
    counts = [F.count_distinct(F.when(c, F.col(unit))).alias(n) for n, c in (when or {}).items()]
    out = df.groupBy(*by).agg(F.count_distinct(unit).alias("units"), *counts)
    out = out.crossJoin(everyone)  # one row
    return out.withColumn("coverage", F.try_divide("units", "__all")).drop("__all")


def retention(reference: DataFrame, subset: DataFrame, entity: str, value: str) -> DataFrame:
    """One row: the shares of the reference that a subset keeps: `entities`, `mass` (rows whose value the subset still
    has), `contrast` (entities with more than one value)."""
    kinds = lambda d, n: d.groupBy(entity).agg(F.count_distinct(value).alias("k")).agg(F.count(F.lit(1)).alias(f"e{n}"), F.count_if(F.col("k") > 1).alias(f"c{n}"))
    kept = subset.select(value).distinct().withColumn("__in", F.lit(True))
    mass = join_null_safe(reference.select(value), kept, [value], "left").agg(F.avg(F.coalesce("__in", F.lit(False)).cast("double")).alias("mass"))
    both = kinds(reference, 0).crossJoin(kinds(subset, 1)).crossJoin(mass)  # one row each
    return both.select(F.try_divide("e1", "e0").alias("entities"), "mass", F.try_divide("c1", "c0").alias("contrast"))


def consolidate(df: DataFrame, key: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), study: str | None = None, separator: str = "-") -> DataFrame:
    """One row per key. Of numbers the middle of the range (not the mean), `<c>_range`, `<c>_n_values` (different ones) and,
    if a study is named, `<c>_n_studies`. Of texts the most common one and `<c>_conflict`, all of them if there are several."""
    aggregates = []
    for c in numeric:
        v, low, high = F.col(c), F.min(c), F.max(c)
        text = F.when(low == high, low.cast("string")).otherwise(F.concat_ws(separator, low.cast("string"), high.cast("string")))
        aggregates += [((low + high) / 2).alias(c), F.when(low.isNotNull(), text).alias(f"{c}_range"), F.count_distinct(c).alias(f"{c}_n_values")]
        aggregates += [F.count_distinct(F.when(v.isNotNull(), F.col(study))).alias(f"{c}_n_studies")] if study else []
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *aggregates)
    for c in categorical:
        out = join_null_safe(out, consensus(df, [key], c).withColumnsRenamed({"consensus": c, "conflict": f"{c}_conflict"}), [key], "left")
    return out


def mixture_ranking(scores: DataFrame, product: str, member: str, score: str, members: int | None = None, source: str | None = None) -> DataFrame:
    """(product, worst, limiting, mean, members[, source]): per product the least score over a mixture's members (a maximin
    rule), the member that it comes from (the first on a tie), and the mean. With `members` only products that have a
    score for so many members stay. `source`: the members' one source, or `mixed_evidence`."""
    best = scores.where(F.col(score).isNotNull()).groupBy(product, member).agg(F.min(score).alias("__s"), *([F.min(source).alias("__f"), F.max(source).alias("__l")] if source else []))
    out = [F.min("__s").alias("worst"), F.min_by(member, F.struct("__s", member)).alias("limiting"), F.avg("__s").alias("mean"), F.count(F.lit(1)).alias("members")]
    if source:
        out.append(F.when(F.min("__f") == F.max("__l"), F.min("__f")).otherwise("mixed_evidence").alias("source"))
    found = best.groupBy(product).agg(*out)
    return found.where(F.col("members") == members) if members else found


def joint_coverage(df: DataFrame, bins: Mapping[str, Column], unit: str) -> DataFrame:
    """Rows and different units of each combination of fixed bins that occurs."""
    return df.groupBy(*[c.alias(n) for n, c in bins.items()]).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(unit).alias("units"))


def importance(df: DataFrame, features: Mapping[str, Column], weight: Column | None = None, digits: int = 6) -> DataFrame:
    """(feature, importance, place): weighted mean magnitude of each feature's values, and its minimum rank."""
    w = F.lit(1.0) if weight is None else weight
    tall = df.select(w.alias("__w"), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("v")) for n, v in features.items()])).alias("s")).select("__w", "s.*")
    total = F.sum(F.when(F.col("v").isNotNull(), F.col("__w")))
    out = tall.groupBy("feature").agg(F.round(F.try_divide(F.sum(F.col("__w") * F.abs("v")), total), digits).alias("importance"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc("importance"))).cast("long"))  # a row for each feature


def review_queue(df: DataFrame, key: str, value: str, low: float, high: float, flagged: Sequence[str] = (), extra: Mapping[str, float] | None = None, strict: bool = False) -> DataFrame:
    """(key, top, low, reason): source records with an unflagged row at or beyond (`strict`: beyond) a limit of `value`, or at
    or above a limit of `extra` (column: limit), each once, with the reasons."""
    extra = extra or {}
    above, below = (lambda c: c > high, lambda c: c < low) if strict else (lambda c: c >= high, lambda c: c <= low)
    clean = F.lit(True)
    for c in flagged:
        clean = clean & ~F.coalesce(F.col(c), F.lit(False))
    far = above(F.col(value)) | below(F.col(value))
    for c, most in extra.items():
        far = far | (F.coalesce(F.col(c), F.lit(float("-inf"))) >= most)
    rows = df.where(clean & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(key).isNotNull() & far)
    top, least = F.max(value), F.min(value)
    reasons = [F.when(above(top), F.format_string("high value %.3f", top.cast("double"))), F.when(below(least), F.format_string("low value %.3f", least.cast("double")))]
    reasons += [F.when(F.max(c) >= most, F.format_string(f"high {c} %.3f", F.max(c).cast("double"))) for c, most in extra.items()]
    return rows.groupBy(key).agg(top.alias("top"), least.alias("low"), F.concat_ws("; ", *reasons).alias("reason"))


def residual_audit(df: DataFrame, family: str, study: str, y: str, guess: str, excess: float = 2.0, ratio: float = 1.2, same_sign: float = 0.7, least: int = 0, least_others: int = 0) -> DataFrame:
    """(family, study, rows, excess, ratio, same_sign, verdict): each study's mean error against the median of the other
    studies of its family, its mean squared error against theirs, and the larger share of one sign.

    `insufficient` where the study has fewer than `least` rows or the family fewer than `least_others` other studies. The
    median without one's own value needs at most four places about the middle of the family's order, so no pair of studies
    is formed and no task holds a family."""
    scratch, d = Scratch(df.sparkSession), F.col(y) - F.col(guess)
    s = df.where(d.isNotNull()).groupBy(family, study).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(d)).alias("__e"), F.avg(d**2).alias("__q"), F.avg((d > 0).cast("double")).alias("__up"))
    s = running(s, [family], ["__e", study], "__q", scratch, "studies").select(family, study, "rows", "__e", "__q", "__up", (F.col("__pos") + 1).alias("__i"), F.col("__sum").alias("__sq"))
    whole = s.groupBy(family).agg(F.count(F.lit(1)).alias("__n"))
    s = join_null_safe(s, whole, [family])
    m, i = F.col("__n") - 1, F.col("__i")
    places = {"a": F.floor((m + 1) / 2), "b": F.floor((m + 1) / 2) + 1, "c": F.floor(m / 2) + 1, "d": F.floor(m / 2) + 2}
    s = join_null_safe(s, s.groupBy(family).agg(*[F.max(F.when(i == p, F.col("__e"))).alias(f"__{k}") for k, p in places.items()]), [family])
    at = lambda k, low, high: F.when(i <= places[k], F.col(high)).otherwise(F.col(low))
    others = (at("a", "__a", "__b") + at("c", "__c", "__d")) / 2
    s = s.where("__n > 1").withColumns({"__o": others, "__oq": (F.col("__sq") - F.col("__q")) / m})
    s = s.withColumns({"excess": F.col("__e") - F.col("__o"), "ratio": F.try_divide("__q", "__oq"), "same_sign": F.greatest("__up", 1 - F.col("__up"))})
    far, worse = F.col("excess") > excess, F.col("ratio") > ratio
    few = (F.col("rows") < least) | (m < least_others)
    verdict = F.when(few, "insufficient").when(far & worse & (F.col("same_sign") > same_sign), "systematic").when(far & worse, "noisy").when(far, "shifted").when(F.col("excess") < 0, "better").otherwise("usual")
    return s.select(family, study, "rows", "excess", "ratio", "same_sign", verdict.alias("verdict"))


def preferred_variant(df: DataFrame, key: Sequence[str], method: str, preference: Sequence[str]) -> DataFrame:
    """The rows of the first method of the list that a key has; keys with none are dropped."""
    place = F.nullif(F.array_position(F.array(*map(F.lit, preference)), F.col(method)), F.lit(0))
    rows = df.withColumn("__place", place).where("__place is not null")
    best = rows.groupBy(*key).agg(F.min("__place").alias("__best"))
    return join_null_safe(rows, best, key).where("__place = __best").drop("__place", "__best")


def representative(df: DataFrame, by: Sequence[str], values: Sequence[str], tie: Sequence[str], scores: bool = False) -> DataFrame:
    """One row per group, whole: that closest to the group's median (ties by `tie`). With several values, or `scores`,
    closeness is the mean of the distances over each value's standard deviation in the group."""
    medians = df.groupBy(*by).agg(*[x for c in values for x in (median(c).alias(f"__m_{c}"), F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"__s_{c}"))])
    rows = join_null_safe(df, medians, by)
    off = [F.abs(F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") if scores or len(values) > 1 else F.lit(1.0)) for c in values]
    known = sum((x.isNotNull().cast("int") for x in off), F.lit(0))
    distance = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in off), F.lit(0.0)), known)
    others = [c for c in df.columns if c not in by]
    order = F.struct(F.coalesce(distance, F.lit(float("inf"))).alias("d"), *[F.col(c) for c in tie])
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("__r")).select(*by, *[F.col(f"__r.{c}").alias(c) for c in others])


def leaks(one: DataFrame, other: DataFrame, identities: Mapping[str, Column]) -> DataFrame:
    """One row: of the rows of `one`, how many have each identity in common with `other` (null identities with none), and
    how many rows there are."""
    out = one.select(*[c.alias(f"__i_{n}") for n, c in identities.items()])
    for n, c in identities.items():
        known = other.select(c.alias(f"__i_{n}")).where(F.col(f"__i_{n}").isNotNull()).distinct().withColumn(f"__f_{n}", F.lit(True))
        out = out.join(known, f"__i_{n}", "left")
    return out.agg(*[F.count(f"__f_{n}").alias(n) for n in identities], F.count(F.lit(1)).alias("rows"))


def pool_tokens(df: DataFrame, identity: Sequence[str], tokens: Column, qualifies: Column, column: str, separator: str = "; ") -> DataFrame:
    """Adds `column`: on rows that qualify all different tokens of their identity's rows that qualify, sorted and joined;
    null elsewhere."""
    rows = df.where(qualifies).select(*identity, F.explode(tokens).alias("__t")).distinct()
    pooled = rows.groupBy(*identity).agg(F.array_join(F.sort_array(F.collect_list("__t")), separator).alias("__all"))
    return join_null_safe(df, pooled, identity, "left").withColumn(column, F.when(qualifies, F.col("__all"))).drop("__all")


def rank_association(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, pairs, spearman): of groups with at least `least` complete pairs and two different values on either side."""
    return spearman(df, by, x, y).where((F.col("n") >= least) & F.col("spearman").isNotNull()).withColumnRenamed("n", "pairs")


#: What a canonical record says of its fields.
CONFLICT = ("Conflicting repeated field '", "' kept first value")
RETIRED = ("Unsupported retired field '", "'; use '", "'")
INGEST = "Ingest error: "


def canonical_record(df: DataFrame, key: str, fields: Sequence[str], name: str, value: str, place: str, retired: Mapping[str, str] | None = None, notes: Sequence[str] = ("_warnings", "warnings"), failures: Sequence[str] = ("_errors", "errors", "error_message")) -> DataFrame:
    """Records given as (key, name, value, place) rows -> one row per key with a column for each of `fields`.

    Names match in folded form (letters and digits only). Of several values the first non-blank one stays; a later one that
    differs leaves `Conflicting repeated field ... kept first value` in `warning_message`. Retired names (old: new) are not
    taken over, but leave an error. Names that begin with _ are left out, but for `notes` and `failures`, whose values join
    `warning_message` and the errors. A record with errors has `require_review` Yes and the errors in `review_reason`."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    plain = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())
    known = F.create_map(*[x for f in fields for x in (F.lit(plain(f)), F.lit(f))]) if fields else F.create_map()
    old = F.create_map(*[x for a, b in (retired or {}).items() for x in (F.lit(plain(a)), F.lit(b))]) if retired else None
    text = F.trim(F.col(value).cast("string"))
    rows = df.select(key, F.col(name).alias("__name"), F.col(place).alias("__place"), F.when(text != "", text).alias("__v"))
    is_note, is_failure = F.col("__name").isin(*notes), F.col("__name").isin(*failures)
    hidden = F.col("__name").startswith("_") & ~is_note & ~is_failure
    rows = rows.where(~hidden).withColumn("__fold", fold(F.col("__name")))
    replaced = F.try_element_at(old, F.col("__fold")) if old is not None else F.lit(None).cast("string")
    rows = rows.withColumns({"__kind": F.when(is_note, "note").when(is_failure, "failure").when(replaced.isNotNull(), "retired").otherwise("field"), "__new": replaced})
    rows = rows.withColumn("__field", F.when(F.col("__kind") == "field", F.try_element_at(known, F.col("__fold"))))
    first = rows.where("__field is not null and __v is not null").groupBy(key, "__field").agg(F.min_by("__v", "__place").alias("__first"), F.count_distinct("__v").alias("__different"), F.min("__place").alias("__at"))
    said = lambda c, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("c"))))), lambda x: x["c"]), "; ")
    conflict = F.when(F.col("__different") > 1, F.concat(F.lit(CONFLICT[0]), F.col("__field"), F.lit(CONFLICT[1])))
    values = first.groupBy(key).agg(*[F.max(F.when(F.col("__field") == f, F.col("__first"))).alias(f) for f in fields], said(conflict, F.col("__at")).alias("__conflicts"))
    note = F.when(F.col("__kind") == "note", F.col("__v"))
    error = F.when(F.col("__kind") == "failure", F.col("__v")).when(F.col("__kind") == "retired", F.concat(F.lit(RETIRED[0]), F.col("__name"), F.lit(RETIRED[1]), F.col("__new"), F.lit(RETIRED[2])))
    told = rows.groupBy(key).agg(said(note, F.col("__place")).alias("__notes"), said(F.when(error.isNotNull(), F.concat(F.lit(INGEST), error)), F.col("__place")).alias("__errors"))
    everyone = df.select(key).distinct()
    out = join_null_safe(join_null_safe(everyone, values, [key], "left"), told, [key], "left")
    blank = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    return out.select(key, *fields, F.concat_ws("; ", blank("__notes"), blank("__conflicts")).alias("warning_message"), F.when(blank("__errors").isNotNull(), "Yes").alias("require_review"), F.coalesce(blank("__errors"), F.lit("")).alias("review_reason"))


def align_cache(cache: DataFrame, key: str, order: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """wanted with the cache's columns, of each key the row with the largest `order`; `hit` says whether the cache has it.
    Blank keys are in neither."""
    rows = cache.where(blank_to_null(F.col(key)).isNotNull())
    others = [c for c in cache.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("__row")).withColumnRenamed(key, "__key")
    out = wanted.join(last, F.col(wanted_key) == F.col("__key"), "left")
    return out.select(*wanted.columns, *[F.col(f"__row.{c}").alias(c) for c in others], (F.col("__key").isNotNull() & blank_to_null(F.col(wanted_key)).isNotNull()).alias("hit"))
