"""Hold-outs, folds and the support of rows by training data.

Groups are drawn in the order of the MD5 of seed and group, so any engine draws the same ones. Searches over
groups (sizes, folds, pair components) run on a table with one row per group, in the driver, up to a stated
number of groups; all row work is joins and aggregates.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import correlation
from .ranks import quantiles
from .tables import Scratch, cut, ranked

#: Groups that a driver-side search takes at most; more raise an error rather than a silent sample.
MOST_GROUPS = 1_000_000


def draw(seed: str, group: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), group.cast("string")))


def kth_draw(units: DataFrame, unit: str, seed: str, k: int) -> str:
    """The k-th (from 1) of the units' draws in order: counts by ever longer prefixes say which prefix holds it, 65,536 counts
    a round at most, until a prefix has so few draws that they fit the driver."""
    draws, prefix = units.select(draw(seed, F.col(unit)).alias("h")), ""
    while True:
        size = len(prefix) + 4
        counts = sorted(draws.where(F.col("h").startswith(prefix)).groupBy(F.substring("h", 1, size).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        for r in counts:
            if k <= r["n"]:
                break
            k -= r["n"]
        prefix = r["p"]
        if r["n"] <= 65_536 or size >= 32:
            return sorted(x["h"] for x in draws.where(F.col("h").startswith(prefix)).limit(65_536).collect())[min(k, 65_536) - 1]


def group_holdout(df: DataFrame, unit: str, fraction: float, seed: str = "split") -> DataFrame:
    """Adds `split`: the first ceil(fraction x groups) groups by the seeded draw are `test`, whole groups only."""
    units = df.select(unit).where(F.col(unit).isNotNull()).distinct()
    n = units.count()
    k = int(np.ceil(round(fraction * n, 9)))
    test = draw(seed, F.col(unit)) <= kth_draw(units, unit, seed, k) if k else F.lit(False)
    return df.withColumn("split", F.when(F.coalesce(test, F.lit(False)), "test").otherwise("training"))


def split_diagnostics(df: DataFrame, units: Sequence[str], target: str) -> DataFrame:
    aggregates = [F.count_distinct(u).alias(f"n_{u}") for u in units]
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *aggregates, F.avg(target).alias("mean"), F.stddev_samp(target).alias("sd"))


def membership_violations(df: DataFrame, unit: str) -> DataFrame:
    """Units that stand on both sides of a split; empty if all is well."""
    return df.groupBy(unit).agg(F.count_distinct("split").alias("sides")).where("sides > 1")


def membership_hash(df: DataFrame, by: str, member: str) -> DataFrame:
    """One digest per side from its different members; equal sets have equal digests, in whatever order they come.

    The members' hashes are added up, so no group is collected."""
    h = F.conv(F.substring(F.md5(F.col(member).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(by, member).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.sum(h).cast("string").alias("digest"))


def _groups(df: DataFrame, unit: str) -> list[tuple]:
    found = df.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.md5(F.col(unit).cast("string"))).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return sorted(((r[0], r["n"], r["h"]) for r in found), key=lambda g: g[2])


def balanced_folds(df: DataFrame, unit: str, folds: int) -> DataFrame:
    """Adds `fold`: largest group first, each to the fold with fewest rows so far (ties: the lower fold)."""
    heap, fold = [(0, f) for f in range(folds)], {}
    for g, n, _ in sorted(_groups(df, unit), key=lambda g: (-g[1], g[2])):
        load, f = heapq.heappop(heap)
        fold[g] = f
        heapq.heappush(heap, (load + n, f))
    table = df.sparkSession.createDataFrame(list(fold.items()), f"`{unit}` {df.schema[unit].dataType.simpleString()}, fold int")
    return df.join(table, unit, "left")


#: Bytes that the subset sums of size_matched_holdout may take in the driver.
MOST_BYTES = 1 << 31


def _subset(classes: list[tuple[int, int]], want: int) -> dict[int, int]:
    """classes: (size, how many groups have it) -> how many groups of each size to take, so that the total is as close to
    `want` as any choice gets (ties: the smaller total).

    Sizes with many groups are split into powers of two. Reachable totals are bit sets up to want + the largest size; one
    in about root-many steps is kept, and the steps between are done again on the way back."""
    items = []
    for size, many in sorted(classes, reverse=True):
        power = 1
        while many > 0:
            items.append((size, min(power, many)))
            many, power = many - min(power, many), power * 2
    limit = (1 << (want + max((s for s, _ in classes), default=0) + 1)) - 1
    stride = max(1, int(len(items) ** 0.5))
    if 2 * (len(items) // stride + stride + 2) * (limit.bit_length() // 8) > MOST_BYTES:
        raise ValueError(f"{len(items)} size classes up to a total of {want} need more than {MOST_BYTES} bytes")
    kept, now = {0: 1}, 1
    for i, (size, n) in enumerate(items, 1):
        now = (now | now << (size * n)) & limit
        if i % stride == 0:
            kept[i] = now
    total = next(t for d in range(limit.bit_length() + 1) for t in (want - d, want + d) if t >= 0 and now >> t & 1)
    chosen: dict[int, int] = {}
    for block in range((len(items) - 1) // stride, -1, -1) if items else ():
        reach = [kept[block * stride]]
        for size, n in items[block * stride : (block + 1) * stride]:
            reach.append((reach[-1] | reach[-1] << (size * n)) & limit)
        for k in range(min(stride, len(items) - block * stride), 0, -1):
            size, n = items[block * stride + k - 1]
            if not reach[k - 1] >> total & 1:
                chosen[size] = chosen.get(size, 0) + n
                total -= size * n
    return chosen


def size_matched_holdout(df: DataFrame, unit: str, fraction: float, seed: str = "split") -> DataFrame:
    """Adds `split`: whole groups whose row total is as close to the fraction as any choice of groups gets.

    The search runs on the different sizes and how many groups have each; of a size the first groups by the seeded draw are
    taken. Memory in the driver: the square root of the number of different sizes, times the wanted rows, in bits."""
    sizes = df.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.count(F.lit(1)).alias("__n"))
    scratch = Scratch(df.sparkSession)
    sizes = scratch.table(sizes, "sizes")
    classes = [tuple(r) for r in sizes.groupBy("__n").agg(F.count(F.lit(1)).alias("k")).limit(MOST_GROUPS + 1).collect()]
    if len(classes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} different sizes")
    chosen = _subset(classes, round(fraction * sum(n * k for n, k in classes)))
    take = df.sparkSession.createDataFrame(list(chosen.items()), "__n long, __take long")
    placed = ranked(sizes.join(take, "__n"), ["__n"], [draw(seed, F.col(unit)), F.col(unit)], "__pos", "__of", scratch, "drawn")
    test = placed.where("__pos < __take").select(unit, F.lit("test").alias("split"))
    return df.join(test, unit, "left").withColumn("split", F.coalesce("split", F.lit("training")))


def pair_holdout(df: DataFrame, left: str, right: str, fraction: float) -> DataFrame:
    """Adds `split`: pairs in seeded order are held out as long as both of their components keep a pair in training.

    Greedy with component counts; the number of pairs is the fraction's, or as many as the guard allows."""
    pairs = df.groupBy(left, right).count().select(left, right).limit(MOST_GROUPS + 1).collect()
    if len(pairs) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} pairs")
    from hashlib import md5

    order = sorted((tuple(p) for p in pairs), key=lambda p: md5(f"{p[0]}|{p[1]}".encode()).hexdigest())
    a, b, out = Counter(p[0] for p in order), Counter(p[1] for p in order), []
    for p in order:
        if len(out) >= np.ceil(fraction * len(order)):
            break
        if a[p[0]] > 1 and b[p[1]] > 1:
            a[p[0]] -= 1
            b[p[1]] -= 1
            out.append(p)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (left, right))
    table = df.sparkSession.createDataFrame(out, kinds).withColumn("split", F.lit("test"))
    return df.join(table, [left, right], "left").withColumn("split", F.coalesce("split", F.lit("training")))


def evidence_balanced_folds(df: DataFrame, unit: str, stratum: str, folds: int, passes: int = 5) -> DataFrame:
    """balanced_folds, then at most `passes` changes that even out the strata over the folds: each time the best move of a
    group to another fold, or, where none helps, the best exchange of two groups, eight partners a group at most.

    Loss: of the folds' mean deviations of a stratum's share from 1 / folds the (mean, largest, standard deviation), compared
    in this order; a change may not make the fold sizes more uneven than they were at first, nor empty a fold. The search
    runs on the groups' stratum counts."""
    counts = df.where(F.col(unit).isNotNull()).groupBy(unit, stratum).agg(F.count(F.lit(1)).alias("n")).limit(MOST_GROUPS + 1).collect()
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} group and stratum counts")
    units, strata = sorted({r[0] for r in counts}), sorted({r[1] for r in counts}, key=str)
    m = np.zeros((len(units), len(strata)))
    at = {u: i for i, u in enumerate(units)}, {s: i for i, s in enumerate(strata)}
    for r in counts:
        m[at[0][r[0]], at[1][r[1]]] = r["n"]
    start = {r[0]: r[1] for r in balanced_folds(df, unit, folds).select(unit, "fold").where("fold is not null").distinct().collect()}
    fold = np.array([start[u] for u in units])
    held = np.stack([m[fold == f].sum(axis=0) for f in range(folds)])
    total = np.maximum(m.sum(axis=0), 1)

    def loss(h: np.ndarray) -> tuple[float, float, float]:
        off = np.abs(h / total - 1 / folds).mean(axis=1)
        return tuple(round(float(x), 12) for x in (off.mean(), off.max(), off.std()))

    spread = lambda h: float(np.ptp(h.sum(axis=1)))
    limit, now, draws = spread(held), loss(held), np.random.default_rng(94711)

    def better(h: np.ndarray, best: tuple | None) -> bool:
        return spread(h) <= limit and h.sum(axis=1).min() > 0 and loss(h) < (best[0] if best else now)

    for _ in range(passes):
        best = None
        for i in range(len(units)):
            for f in range(folds):
                if f == fold[i]:
                    continue
                h = held.copy()
                h[fold[i]] -= m[i]
                h[f] += m[i]
                if better(h, best):
                    best = loss(h), h, {i: f}
        if best is None:
            for i in range(len(units)):
                others = np.flatnonzero(fold != fold[i])
                for j in draws.permutation(others)[:8]:
                    h = held.copy()
                    h[fold[i]] += m[j] - m[i]
                    h[fold[j]] += m[i] - m[j]
                    if better(h, best):
                        best = loss(h), h, {i: fold[j], int(j): fold[i]}
        if best is None:
            break
        now, held, change = best
        for i, f in change.items():
            fold[i] = f
    table = df.sparkSession.createDataFrame(list(zip(units, fold.tolist())), f"`{unit}` {df.schema[unit].dataType.simpleString()}, fold int")
    return df.join(table, unit, "left")


def screen_features(df: DataFrame, columns: Sequence[str], unit: str, identifiers: Sequence[str] = (), excluded: Sequence[str] = (), least_rows: int = 10, least_units: float = 0.1, least_distinct: int = 3, dominant: float = 0.98, correlated: float = 0.95, most_missing: float = 1.0, bucket: Mapping[str, str] | None = None, excluded_buckets: Sequence[str] = ()) -> DataFrame:
    """(feature, verdict, reason): one verdict per candidate, the first failing rule's.

    Order: of an excluded bucket, not in the table, excluded, identifier, too many missing, too few rows, too few units, too
    few values, one value dominates, correlated with an earlier candidate that stays (components: prune_components). All
    statistics come from one pass and one correlation pass."""
    there = [c for c in columns if c in df.columns]
    v = {c: F.col(c).cast("double") for c in there}
    units = F.count_distinct(unit)
    stats = df.agg(units.alias("__units"), F.count(F.lit(1)).alias("__rows"), *[x for c in there for x in (F.count(v[c]).alias(f"{c}|n"), F.count_distinct(F.when(v[c].isNotNull(), F.col(unit))).alias(f"{c}|u"), F.count_distinct(v[c]).alias(f"{c}|d"))]).first()
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), v[c].alias("v")) for c in there])).alias("s")).select("s.*").where("v is not null")
    top = {r[0]: r[1] for r in tall.groupBy("c", "v").count().groupBy("c").agg(F.max("count")).collect()}
    pairs = [(a, b) for i, a in enumerate(there) for b in there[i + 1 :]]
    corr = df.agg(*[correlation(v[a], v[b]).alias(f"{a}|{b}") for a, b in pairs]).first().asDict() if pairs else {}
    out, kept = [], []
    for c in columns:
        reason = None
        if (bucket or {}).get(c) in excluded_buckets:
            reason = "excluded bucket"
        elif c not in there:
            reason = "missing column"
        elif c in excluded:
            reason = "explicitly excluded"
        elif c in identifiers:
            reason = "identifier or leakage"
        elif stats["__rows"] - stats[f"{c}|n"] > most_missing * stats["__rows"]:
            reason = "too many missing"
        elif stats[f"{c}|n"] < least_rows:
            reason = "too few rows"
        elif stats[f"{c}|u"] < least_units * stats["__units"]:
            reason = "too few units"
        elif stats[f"{c}|d"] < least_distinct:
            reason = "too few values"
        elif top[c] > dominant * stats[f"{c}|n"]:
            reason = "one value dominates"
        elif hit := next((k for k in kept if abs(corr.get(f"{k}|{c}") or 0) >= correlated), None):
            reason = f"correlated with {hit}"
        else:
            kept.append(c)
        out.append((c, "dropped" if reason else "selected", reason))
    return df.sparkSession.createDataFrame(out, "feature string, verdict string, reason string")


def range_support(training: DataFrame, query: DataFrame, numeric: Sequence[str], categorical: Sequence[str], slack: float = 0.0) -> DataFrame:
    """query with `out_of_range`, `unseen` and `absent`: the features that training does not cover. Bounds are one row."""
    bounds = training.agg(*[x for c in numeric for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    out = query.crossJoin(bounds)  # one row
    wide = {c: slack * (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")) for c in numeric}
    off = [F.when((F.col(c) < F.col(f"__lo_{c}") - wide[c]) | (F.col(c) > F.col(f"__hi_{c}") + wide[c]), c) for c in numeric]
    for c in categorical:
        known = training.select(F.col(c).alias(f"__k_{c}")).where(F.col(c).isNotNull()).distinct()
        out = out.join(known, F.col(c) == F.col(f"__k_{c}"), "left")
    new = [F.when(F.col(c).isNotNull() & F.col(f"__k_{c}").isNull(), c) for c in categorical]
    gone = [F.when(F.col(c).isNull(), c) for c in (*numeric, *categorical)]
    return out.select(*query.columns, F.array_compact(F.array(*off)).alias("out_of_range"), F.array_compact(F.array(*new)).alias("unseen"), F.array_compact(F.array(*gone)).alias("absent"))


def eligible(df: DataFrame, features: Sequence[str], least: int) -> DataFrame:
    n = sum((F.col(c).isNotNull().cast("int") for c in features), F.lit(0))
    return df.withColumns({"present": n, "eligible": n >= least})


def design_matrix(training: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], rare: int = 5) -> DataFrame:
    """df with medians of training in place of missing numbers, and levels rarer than `rare` in training as `infrequent`."""
    medians = training.limit(0).agg(F.count(F.lit(1)).alias("__one"))  # one row
    for c in numeric:  # a whole column's median: no task holds all its values
        medians = medians.crossJoin(quantiles(training, [], c, [0.5]).agg(F.max(F.col("q")[0]).alias(f"__m_{c}")))
    out = df.crossJoin(medians).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")) for c in numeric})  # one row
    for c in categorical:
        common = training.groupBy(F.col(c).alias(f"__k_{c}")).count().where(F.col("count") >= rare).drop("count")
        out = out.join(common, F.col(c) == F.col(f"__k_{c}"), "left").withColumn(c, F.when(F.col(c).isNull(), "missing").when(F.col(f"__k_{c}").isNull(), "infrequent").otherwise(F.col(c)))
    return out.select(*df.columns)


#: Features that deal points to cells.
CELLS = 3


def density_support(training: DataFrame, query: DataFrame, key: str, features: Sequence[str], bandwidth: float | None = None, block: int = 2048) -> DataFrame:
    """(key, dissimilarity): 1 - density / largest density, Epanechnikov kernel on standardised features.

    The density is that of all training rows, the largest that of any training row; a denser query row has 0. Equal
    points are counted once, with their number. The kernel ends at one bandwidth, so a point meets only those of its own
    and the adjoining cells of that width (over the first CELLS features), in blocks. The bandwidth is Silverman's unless
    given (a stated difference from mean-shift rules)."""
    stats = training.agg(*[x for c in features for x in (F.avg(c).alias(f"m{c}"), F.stddev_samp(c).alias(f"s{c}"))]).first()
    scale, names = {c: (stats[f"m{c}"], stats[f"s{c}"] or 1.0) for c in features}, [f"__f{i}" for i in range(len(features))]
    z = lambda d: d.select(key, *[((F.col(c) - scale[c][0]) / scale[c][1]).cast("double").alias(f) for c, f in zip(features, names)]).dropna(subset=names)
    base, d = cut(z(training), "training"), len(features)
    n = base.count()
    if not n:
        return z(query).select(key, F.lit(1.0).alias("dissimilarity"))
    h = bandwidth or (4 / (d + 2) / n) ** (1 / (d + 4)) * 2.2
    cell = [f"__c{i}" for i in range(min(d, CELLS))]

    def blocked(points: DataFrame, name: str) -> DataFrame:
        """(cell, <name>s): a cell's points with their weights, in blocks."""
        points = points.withColumns({c: F.floor(F.col(f) / h) for c, f in zip(cell, names)})
        many = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
        part = F.pmod(F.xxhash64(*names), F.ceil(F.col("__n") / block).cast("long"))
        row = F.struct(F.array(*names).alias("v"), F.col("__w").alias("w"))
        return points.join(many, cell).groupBy(*cell, part.alias("__part")).agg(F.sort_array(F.collect_list(row)).alias(f"{name}s")).drop("__part")

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            for qs, ts in zip(batch.column(0), batch.column(1)):
                flat = lambda x: x.values.field("v").flatten().to_numpy().reshape(-1, d)
                own, other, u = flat(qs), flat(ts) / h, 0.0
                for i in range(d):
                    u = u + (own[:, i, None] / h - other[None, :, i]) ** 2
                found = np.maximum(1 - u, 0) @ ts.values.field("w").to_numpy().astype(np.float64)
                yield pa.RecordBatch.from_arrays([*[pa.array(own[:, i]) for i in range(d)], pa.array(found)], names=[*names, "v"])

    points = cut(base.groupBy(*names).agg(F.count(F.lit(1)).alias("__w")), "points")
    held = cut(blocked(points, "t"), "blocks")

    def density(asked: DataFrame) -> DataFrame:
        near = blocked(asked, "q")
        for c in cell:
            near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
        pairs = near.join(held, cell).select("qs", "ts")
        found = pairs.mapInArrow(each, ", ".join(f"{x} double" for x in [*names, "v"]))
        return cut(found.groupBy(*names).agg(F.sum("v").alias("v")), "density")

    own = density(points)
    top = own.agg(F.max("v")).first()[0] or 1.0
    rows = base if query is training else cut(z(query), "query")
    found = own if query is training else density(rows.select(*names).distinct().withColumn("__w", F.lit(1).cast("long")))
    return rows.join(found, names, "left").select(key, (1 - F.least(F.coalesce("v", F.lit(0.0)) / top, F.lit(1.0))).alias("dissimilarity"))


def nearest(query: DataFrame, base: DataFrame, key: str, vector: str, k: int = 1, block: int = 2048) -> DataFrame:
    """(key, neighbour, similarity, place): the k rows of base with the largest cosine; a row is not its own neighbour.

    Blocks of base meet blocks of query (as products of matrices), each keeping its best k, which a window then merges."""
    blocked = lambda d, name, n: d.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(n)).alias(name), F.col(key).alias(f"{name}k"), F.col(vector).alias(f"{name}v")).groupBy(name).agg(F.collect_list(F.struct(f"{name}k", f"{name}v")).alias(f"{name}s"))
    parts = [max(1, -(-d.count() // block)) for d in (query, base)]
    pairs = blocked(query, "q", parts[0]).crossJoin(blocked(base, "b", parts[1]).repartition(parts[1]))  # block by block
    kind = base.schema[key].dataType.simpleString()

    def each(batches):
        import pandas as pd

        def unit(rows):
            x = np.array([list(r["v"]) for r in rows], np.float64)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        for batch in batches:
            for qs, bs in zip(batch["qs"], batch["bs"]):
                qk, bk = np.array([r["qk"] for r in qs]), np.array([r["bk"] for r in bs])
                s = unit([{"v": r["qv"]} for r in qs]) @ unit([{"v": r["bv"]} for r in bs]).T
                s[qk[:, None] == bk[None]] = -np.inf
                n = min(k, len(bk))
                best = np.lexsort((np.broadcast_to(bk, s.shape), -np.round(s, 12)), axis=1)[:, :n]
                rows = np.repeat(np.arange(len(qk)), n)
                yield pd.DataFrame({"key": qk[rows], "neighbour": bk[best.ravel()], "similarity": s[rows, best.ravel()]}).query("similarity > -2")

    found = pairs.select("qs", "bs").mapInPandas(each, f"key {kind}, neighbour {kind}, similarity double")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.round("similarity", 12)), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("key", key)


def prune_components(df: DataFrame, columns: Sequence[str], families: Mapping[str, str] | None = None, entities: Mapping[str, str] | None = None, order: str | None = None, threshold: float = 0.95, least_pairs: int = 3, decimals: int = 6, priority: Mapping[str, int] | None = None) -> DataFrame:
    """(feature, family, component, selected, strength, dropped): of the numeric features of a family that correlations of
    `threshold` or more connect (over rows with both, `least_pairs` at least and both varying) one stays, the one with the
    lowest missing rate, then the largest interquartile range in steps of 10 ** -decimals, then the lowest `priority`, then
    the first. A family with an entity (family: column) is judged on one record per entity, the first value in `order`
    that is there. Features that nothing connects have no component. Only sums and quantiles reach the driver."""
    family = {c: (families or {}).get(c, "") for c in columns}
    out = []
    for name in dict.fromkeys(family.values()):
        own = [c for c in columns if family[c] == name]
        v = {c: F.col(c).try_cast("double") for c in own}
        v = {c: F.when(~F.isnan(x), x) for c, x in v.items()}
        scope, entity = df.select(*[x.alias(f"f{i}") for i, x in enumerate(v.values())]), (entities or {}).get(name)
        if entity:
            first = [F.min_by(x, F.when(x.isNotNull(), F.col(order))).alias(f"f{i}") for i, x in enumerate(v.values())]
            scope = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*first).drop(entity)
        scope = cut(scope, "scope")
        pairs = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own))]
        both = {(i, j): F.col(f"f{i}").isNotNull() & F.col(f"f{j}").isNotNull() for i, j in pairs}
        x = lambda p, k: F.when(both[p], F.col(f"f{k}"))
        sums = [a for p in pairs for a in (F.count_if(both[p]).alias(f"n{p[0]}_{p[1]}"), correlation(x(p, p[0]), x(p, p[1])).alias(f"r{p[0]}_{p[1]}"))]
        told = scope.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"f{i}").alias(f"c{i}") for i in range(len(own))], *sums).first()
        tall = scope.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"f{i}").alias("v")) for i in range(len(own))])).alias("s")).select("s.*")
        spread = {r["i"]: (r["q"][1] - r["q"][0]) * 10.0**decimals for r in quantiles(tall, ["i"], "v", [0.25, 0.75]).collect()}
        near: dict[int, dict[int, float]] = defaultdict(dict)
        for i, j in pairs:
            r = told[f"r{i}_{j}"]
            if told[f"n{i}_{j}"] >= least_pairs and r is not None and abs(r) >= threshold - 1e-12:
                near[i][j] = near[j][i] = abs(r)
        seen, number = set(), 0
        for i, c in enumerate(own):
            if i in seen:
                continue
            component, stack = [], [i]
            seen.add(i)
            while stack:
                k = stack.pop()
                component.append(k)
                stack += [m for m in near[k] if m not in seen]
                seen.update(near[k])
            if len(component) == 1:
                out.append((c, name, None, c, None, False))
                continue
            number += 1
            rank = lambda k: (told["rows"] - told[f"c{k}"], -spread.get(k, float("-inf")), (priority or {}).get(own[k], 0), k)
            best = own[min(component, key=rank)]
            out += [(own[k], name, f"corr_{name}_{number:03d}", best, max(near[k].values()), own[k] != best) for k in sorted(component)]
    return df.sparkSession.createDataFrame(out, "feature string, family string, component string, selected string, strength double, dropped boolean")
