"""Documents and chunks: headings, word windows, token multisets, references, tables, matching of versions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_pairs
from .graph import components
from .match import fifo_pairs
from .ranks import join_null_safe
from .tables import Scratch, cut

_BAR = re.compile(r"(?<!\\)\|")


def in_buckets(df: DataFrame, group: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema, rows: int = 50_000) -> DataFrame:
    """f on each group, many groups per call: a bucket of whole groups costs one exchange with Python, not one each."""
    parts = max(1, -(-df.count() // rows))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([f(g) for _, g in pdf.drop(columns="__bucket").groupby(group, sort=False, dropna=False)], ignore_index=True)

    return df.withColumn("__bucket", F.pmod(F.xxhash64(group), F.lit(parts))).groupBy("__bucket").applyInPandas(each, schema)


#: Fixed words by which headings are told apart, first hit wins.
HEADINGS = (("abstract", r"^abstract\b|^summary\b"), ("methods", r"^(materials? and )?methods?\b|^experimental\b"), ("results", r"^results?\b|^discussion\b"), ("references", r"^references\b|^bibliography\b"))


def normalize_heading(c: Column) -> Column:
    """Without marks of markup, numbering and trailing points, in lower case."""
    bare = F.regexp_replace(F.trim(c), r"^#+\s*|[*_]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s+", ""), r"[\s.:]+$", ""))


def classify_heading(c: Column) -> Column:
    h, out = normalize_heading(c), None
    for label, pattern in HEADINGS:
        out = F.when(h.rlike(pattern), label) if out is None else out.when(h.rlike(pattern), label)
    return out


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def word_windows(df: DataFrame, key: str, text: str, size: int = 512) -> DataFrame:
    """(key, chunk, text, n_words): whole texts in windows of `size` words."""
    w = df.select(key, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))
    rows = w.select(key, "w", F.explode(starts).alias("chunk"))
    part = F.slice("w", F.col("chunk") * size + 1, size)
    return rows.select(key, "chunk", F.array_join(part, " ").alias("text"), F.size(part).alias("n_words"))


def normalized(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))


def duplicate_content(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Texts, different normalised texts, and the copies beyond the first of each."""
    each = df.groupBy(*by, F.md5(normalized(F.col(text))).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    return each.groupBy(*by).agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("different"), F.sum(F.col("__n") - 1).alias("copies"))


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): multiset of a text's table tokens. A text's equal tokens are counted in its row first (sorted, by
    the places where a value ends); only different ones are put in plain form and exchanged.

    Each step is a column of its own, as an expression inside a lambda would be worked out anew for each element."""
    rows = df.select(key, F.array_sort(raw_table_tokens(F.col(text))).alias("__a")).where(F.size("__a") > 0)
    last = F.filter(F.sequence(F.lit(1), F.size("__a")), lambda i: (i == F.size("__a")) | (F.get("__a", i - 1) != F.get("__a", i)))
    rows = rows.select(key, "__a", last.alias("__e"))
    rows = rows.select(key, "__a", F.explode(F.arrays_zip(F.col("__e").alias("e"), F.concat(F.array(F.lit(0)), F.slice("__e", 1, F.size("__e") - 1)).alias("b"))).alias("t"))
    rows = rows.select(key, plain_number(F.get("__a", F.col("t.e") - 1)).alias("token"), (F.col("t.e") - F.col("t.b")).cast("long").alias("n"))
    return rows.groupBy(key, "token").agg(F.sum("n").alias("n"))


def containment(small: DataFrame, large: DataFrame, small_key: str, large_key: str, least: float = 0.95, tokens: int = 40, margin: float = 0.10) -> DataFrame:
    """Many-to-one: token tables (key, token, n) -> the large text that holds a small one.

    Score: shared multiset over the smaller size; at least `least`, `tokens` tokens on either side, and `margin` ahead of
    the next best. Candidates share one of the smaller text's rarest tokens: a text that holds so much of another lacks
    few of them, so of the first few one is shared. All pairs down to least - margin are found, none is capped."""
    low = least - margin
    sized = lambda d, k, as_: d.join(d.groupBy(k).agg(F.sum("n").alias(as_)).where(F.col(as_) >= tokens), k)
    s, l = sized(small, small_key, "__s"), sized(large, large_key, "__l")
    common = large.groupBy("token").agg(F.count(F.lit(1)).alias("__df"))

    def probes(d: DataFrame, k: str, size: str) -> DataFrame:
        ranked = d.join(common, "token", "left").withColumn("__df", F.coalesce("__df", F.lit(0)))
        before = F.sum("n").over(Window.partitionBy(k).orderBy("__df", "token").rowsBetween(Window.unboundedPreceding, -1))
        return ranked.withColumn("__b", F.coalesce(before, F.lit(0))).where(F.col("__b") <= (1 - low) * F.col(size) + 1e-9).select(k, "token")

    pairs = probes(s, small_key, "__s").join(l.select(large_key, "token"), "token").select(small_key, large_key)
    pairs = pairs.unionByName(probes(l, large_key, "__l").join(s.select(small_key, "token"), "token").select(small_key, large_key)).distinct()
    pairs = pairs.where(F.col(small_key) != F.col(large_key)).join(l.select(large_key, "__l").distinct(), large_key)
    pairs = pairs.join(s.select(small_key, "__s", "token", F.col("n").alias("__n")), small_key)
    both = pairs.join(large.select(large_key, "token", F.col("n").alias("__m")), [large_key, "token"], "left")
    score = both.groupBy(small_key, large_key).agg((F.sum(F.least("__n", F.coalesce("__m", F.lit(0)))) / F.least(F.max("__s"), F.max("__l"))).alias("score"))
    score = score.where(F.col("score") >= low)
    w = Window.partitionBy(small_key).orderBy(F.desc("score"), large_key)
    top = score.withColumns({"__place": F.row_number().over(w), "__next": F.lead("score").over(w)}).where("__place = 1")
    return top.where((F.col("score") >= least) & (F.col("score") - F.coalesce("__next", F.lit(0.0)) >= margin)).select(small_key, large_key, "score")


def content_tokens(c: Column) -> Column:
    """Words and single marks, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def plain_number(t: Column) -> Column:
    """A number token without plus and idle zeros; other tokens as they are."""
    n = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+([0-9])", "$1$2")
    n = F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n)
    return F.when(t.rlike("[0-9]"), F.when(n.isin("-0", "-", ""), "0").otherwise(n)).otherwise(t)


def raw_table_tokens(c: Column) -> Column:
    """Letter runs and numbers."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+|[-+]?\d+(?:\.\d+)?)"), F.lit(1))


def table_tokens(c: Column) -> Column:
    return F.transform(raw_table_tokens(c), lambda t: plain_number(t))


#: Fixed values of the matcher: similarity, tokens, margin, score that needs no margin.
LEAST, TOKENS, MARGIN, SURE = 0.82, 20, 0.03, 0.95


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: Sequence[str], text: str, least: float = LEAST, tokens: int = TOKENS, margin: float = MARGIN, sure: float = SURE) -> DataFrame:
    """One-to-one fuzzy matches within blocks: (left_id, right_id, score), by rounds of reciprocal bests.

    The score is a sequence matcher's on tokens. It is taken only of pairs whose lengths and common token multiset allow
    least - margin (the multiset's Dice score bounds it from above). A match is each side's best (ties by id), at least
    `least`, and `margin` ahead of either side's next best unless it is `sure`. Matched rows leave, and rounds go on until
    none matches. Equal texts, which rounds would match n-th with n-th, one pair a round, are so matched beforehand.

    Rounds are not run one by one: near_pairs.py finds by sketches what can match, and settles each component of that in
    one task, with the result that rounds have. Ids are unique within a side; rows with a null id or block match nothing."""
    keys, low, scratch = list(block), least - margin, Scratch(left.sparkSession)
    joined = F.array_join(content_tokens(F.col(text)), " ").alias("__joined")  # tokens have no spaces
    whole = lambda d, i: d.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (i, *keys)]))
    side = lambda d, i, n: scratch.table(near_pairs.sketched(whole(d, i).select(i, *keys, joined), tokens, low), n)
    l, r = side(left, left_id, "left"), side(right, right_id, "right")
    done = scratch.table(fifo_pairs(l, r, [*keys, "__h"], left_id, right_id).select(left_id, right_id, F.lit(1.0).alias("score")), "equal")
    rest = lambda d, i, n: scratch.table(d.join(done.select(i), i, "left_anti").drop("__h").withColumn("__node", F.xxhash64(F.lit(n), i)), f"rest_{n}")
    l, r = rest(l, left_id, "left"), rest(r, right_id, "right")

    def met(l: DataFrame, r: DataFrame, keys: list[str], sent: list[str]) -> GroupedData:
        """Rows of both sides by task: each two of one key and of near classes meet in one."""
        parts = lambda d, c, n: d.groupBy(*keys, F.col("__class").alias(c)).agg(F.greatest(F.lit(1), F.ceil(F.sum("__share"))).cast("long").alias(n))
        lefts, rights = parts(l, "__cl", "__pl"), parts(r, "__cr", "__pr")
        own = lambda n: F.pmod(F.xxhash64("__node"), F.col(n))
        near = F.explode(F.sequence(F.col("__class") - 1, F.col("__class") + 1))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        task = [*keys, "__cl", "__cr", "__i", "__j"]
        ls = l.withColumn("__cl", F.col("__class")).withColumn("__cr", near).join(lefts, [*keys, "__cl"]).join(rights, [*keys, "__cr"]).withColumn("__i", own("__pl")).withColumn("__j", every("__pr"))
        rs = r.withColumn("__cr", F.col("__class")).withColumn("__cl", near).join(rights, [*keys, "__cr"]).join(lefts, [*keys, "__cl"]).withColumn("__j", own("__pr")).withColumn("__i", every("__pl"))
        return dealt(ls.select(*task, *sent, F.lit(True).alias("__left")).unionByName(rs.select(*task, *sent, F.lit(False).alias("__left"))), task)

    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)  # few bytes may be long work
    dealt = lambda d, by: d.repartition(tasks, *by).groupBy(*by)
    edges = scratch.table(met(l, r, keys, ["__node", "__n", "__sketch"]).applyInArrow(lambda t: near_pairs.forest(t, low), "u long, v long"), "edges")
    labels = components(edges).withColumnRenamed("node", "__node")
    sized = lambda d: d.select("__node", "__n").join(labels, "__node")
    large = scratch.table(sized(l).unionByName(sized(r)).groupBy("component").agg(F.sum("__n").alias("__tokens")).where(F.col("__tokens") > near_pairs.LARGE).select("component"), "large")
    if not large.isEmpty():
        share = F.lit(1 / near_pairs.TEXTS) + F.col("__n") / near_pairs.TOKENS
        of_large = lambda d, rows, i: d.select(i, text).join(rows.select(i, "__node", "__class", share.alias("__share")).join(labels.join(large, "component"), "__node"), i).withColumn("__joined", joined)
        whole_texts = met(of_large(left, l, left_id), of_large(right, r, right_id), ["component"], ["__node", "__joined"])
        linked = scratch.table(whole_texts.applyInArrow(lambda t: near_pairs.links(t, low), "u long, v long"), "links")
        labels = labels.join(large, "component", "left_anti").unionByName(components(linked).withColumnRenamed("node", "__node"))

    kind = {i: d.schema[i].dataType for d, i in ((l, left_id), (r, right_id))}

    def texts(d: DataFrame, rows: DataFrame, i: str) -> DataFrame:
        ids = [F.col(c).cast(kind[c]).alias(c) if c == i else F.lit(None).cast(kind[c]).alias(c) for c in (left_id, right_id)]
        members = scratch.table(rows.select(i, "__node").join(labels, "__node").select(i, "component"), f"members_{i == left_id}")
        return d.select(i, text).join(members, i).select("component", F.lit(i == left_id).alias("__left"), *ids, joined)

    group = texts(left, l, left_id).unionByName(texts(right, r, right_id))
    schema = T.StructType([T.StructField(left_id, kind[left_id]), T.StructField(right_id, kind[right_id]), T.StructField("score", T.DoubleType())])
    settled = near_pairs.settle(left_id, right_id, least, low, sure, margin)
    alone = lambda t: settled(t.drop_columns(["component"]))
    return done.unionByName(scratch.table(dealt(group, ["component"]).applyInArrow(alone, schema), "found"))


def greedy_assignment(scores: DataFrame, group: str, left: str, right: str, score: str, threshold: float) -> DataFrame:
    """Per group: pairs in order of score (ties by ids), each taken if both sides are free and it reaches the threshold.

    In rounds: a pair that is the first of both its sides is taken in any case, so all such pairs are taken at once and
    their sides leave. That is the same assignment, and no task holds a group."""
    scratch, rank = Scratch(scores.sparkSession), F.struct(-F.col(score), F.col(left), F.col(right))
    rows = scratch.table(scores.select(group, left, right, score).where(F.col(score) >= threshold), "left0")
    done, i = None, 0
    while True:
        ranked = rows.withColumn("__o", rank)
        first = lambda side: ranked.groupBy(group, side).agg(F.min("__o").alias("__o"))
        found = join_null_safe(join_null_safe(ranked, first(left), [group, left, "__o"]), first(right), [group, right, "__o"]).select(group, left, right, score)
        found = scratch.table(found, f"found{i}")
        if found.isEmpty():
            return found if done is None else done
        done = found if done is None else done.unionByName(found)
        gone = lambda side: found.select(F.col(group).alias("__g"), F.col(side).alias("__s"))
        for side in (left, right):
            rows = rows.join(gone(side), F.col(group).eqNullSafe(F.col("__g")) & F.col(side).eqNullSafe(F.col("__s")), "left_anti")
        i += 1
        rows = scratch.table(rows, f"left{i}")
        scratch.drop(f"left{i - 1}")
        if i % 16 == 0:  # else a long run of rounds is a long plan
            done = scratch.table(done, f"done{i}")


def figure_ids(c: Column) -> Column:
    """Figures that a text refers to: `Fig. 3`, `Figures 2-4`, `Fig. S1`; ranges of up to 50 are spread; main, then S."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\bfig(?:ure)?s?\.?\s*(S?\d+(?:\s*[-–]\s*S?\d+)?)"), F.lit(1))

    def spread(x: Column) -> Column:
        s = F.when(F.upper(x).startswith("S"), 1).otherwise(0)
        a, b = F.regexp_extract(x, r"(\d+)", 1).cast("int"), F.regexp_extract(x, r"[-–]\s*S?(\d+)", 1).try_cast("int")
        ids = F.when(b.isNotNull() & (b >= a) & (b - a < 50), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a))
        return F.transform(ids, lambda i: F.struct(s.alias("s"), i.alias("i")))

    return F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform(found, spread)))), lambda t: F.concat(F.when(t["s"] == 1, "S").otherwise(""), t["i"].cast("string")))


def captions_for(df: DataFrame, key: str, text: str, captions: DataFrame, most: int = 12_000) -> DataFrame:
    """(key, captions): the first caption of each referenced figure in order, cut off at `most` characters.

    captions(key, figure, position, caption)."""
    refs = df.select(key, F.posexplode(figure_ids(F.col(text))).alias("o", "figure"))
    one = captions.groupBy(key, "figure").agg(F.min_by("caption", "position").alias("caption"))
    kept = F.array_sort(F.collect_list(F.struct("o", "caption")))
    out = refs.join(one, [key, "figure"]).groupBy(key).agg(F.array_join(F.transform(kept, lambda s: s["caption"]), "\n\n").alias("captions"))
    return out.withColumn("captions", F.substring("captions", 1, most))


def markdown_cells(c: Column) -> Column:
    """Cells of a table row, trimmed; escaped bars stay inside."""
    inner = F.regexp_replace(F.trim(c), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))


def width_problems(df: DataFrame, key: str, line: str, row: str) -> DataFrame:
    """Rows whose number of cells is not the table's most common one (ties: the smaller)."""
    w = df.select(key, line, F.size(markdown_cells(F.col(row))).alias("width"))
    usual = w.groupBy(key, "width").count().groupBy(key).agg(F.min_by("width", F.struct(-F.col("count"), F.col("width"))).alias("usual"))
    return w.join(usual, key).where("width <> usual")


def split_tables(df: DataFrame, key: str, line: str, row: str, header: int, budget: int, cells: int | None = None, whole: tuple[int, int] = (0, 0)) -> DataFrame:
    """Parts of long tables: (key, part, text). Each part repeats the header lines; a part opens when the characters would
    pass the budget, or the cells (rows of the table's width, header lines but the first among them) `cells`. A table of
    at most `whole` characters and cells stays whole, one without rows below its header too. One table's lines fit a task."""

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(line)[row].tolist()
        head, body, out, held, size = rows[:header], rows[header:], [], [], 0
        wide = max((len(_BAR.split(r.strip().strip("|"))) for r in rows), default=0) if cells else 0
        top, first = sum(map(len, head)), max(0, header - 1) * wide
        if sum(map(len, rows)) <= whole[0] and wide * len(rows) <= whole[1]:
            body, out = [], [body]
        for r in body:
            if held and (top + size + len(r) > budget or (cells and first + wide * (len(held) + 1) > cells)):
                out.append(held)
                held, size = [], 0
            held.append(r)
            size += len(r)
        if held or not out:
            out.append(held)
        return pd.DataFrame({key: pdf[key].iloc[0], "part": range(len(out)), "text": ["\n".join([*head, *p]) for p in out]})

    return in_buckets(df.select(key, line, row), key, parts, f"`{key}` {df.schema[key].dataType.simpleString()}, part int, text string")


def entries_with_news(df: DataFrame, by: Sequence[str], order: str, sources: str) -> DataFrame:
    """Entries in order, without those all of whose sources stood in an earlier one; an entry without sources stays."""
    each = df.select(*by, order, F.explode(F.array_distinct(sources)).alias("__s"))
    first = each.groupBy(*by, "__s").agg(F.min(order).alias(order))
    news = first.select(*by, order).distinct().withColumn("__news", F.lit(True))
    out = join_null_safe(df, news, [*by, order], "left")
    return out.where(F.coalesce("__news", F.lit(False)) | (F.coalesce(F.size(sources), F.lit(0)) <= 0)).drop("__news")


def carried_heading(df: DataFrame, key: str, order: str, heading: str) -> DataFrame:
    """Adds `section`: the last heading at or before each block."""
    return df.withColumn("section", F.last(heading, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def first_block_per_source(df: DataFrame, key: str, source: str, order: str) -> DataFrame:
    """Of blocks with one source the first stays; blocks are numbered anew."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(key, source).orderBy(order))).where("__n = 1").drop("__n")
    return first.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def route_sources(df: DataFrame, key: str, source: str, wanted: DataFrame) -> DataFrame:
    """Blocks of the wanted (key, source); a key that lacks any wanted source keeps all its blocks."""
    there = df.select(key, source).distinct().withColumn("__in", F.lit(True))
    missing = wanted.join(there, [key, source], "left").groupBy(key).agg(F.bool_or(F.col("__in").isNull()).alias("__all"))
    flagged = df.join(wanted.select(key, source).distinct().withColumn("__want", F.lit(True)), [key, source], "left").join(missing, key, "left")
    return flagged.where(F.coalesce("__all", F.lit(True)) | F.coalesce("__want", F.lit(False))).drop("__want", "__all")


def missing_tokens(reference: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Token tables (key, token, n): tokens that the candidate lacks, with how many."""
    c = candidate.select(key, "token", F.col("n").alias("__n"))
    short = F.col("n") - F.coalesce("__n", F.lit(0))
    return reference.join(c, [key, "token"], "left").where(short > 0).groupBy(key).agg(F.sum(short).alias("missing"), F.count(F.lit(1)).alias("tokens"))


def best_candidate(df: DataFrame, key: str, accepted: str, width: str, penalties: Sequence[str], name: str, cap: int = 5) -> DataFrame:
    """One candidate per key: accepted ones before reviewable ones, then the pool's most common width, then least capped
    penalties in order, ties by name descending."""
    pool = df.withColumn("__best", F.max(F.col(accepted).cast("int")).over(Window.partitionBy(key))).where(F.col(accepted).cast("int") == F.col("__best"))
    usual = pool.groupBy(key, width).count().groupBy(key).agg(F.min_by(width, F.struct(-F.col("count"), F.col(width))).alias("__usual"))
    order = [F.abs(F.col(width) - F.col("__usual")), *[F.least(F.col(p), F.lit(cap)) for p in penalties], F.desc(name)]
    return pool.join(usual, key).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n", "__best", "__usual")


#: Header actions by schema rank, and the penalties of a repair candidate's key with their caps.
HEADER_ACTIONS = {3: ("carried_header", "already_had_carried_header"), 2: ("projected_header_drop_optional_blank_column",)}
REPAIR_CAPS = (("contamination", 20), ("reason_penalty", 2000), ("label_penalty", 2000), ("missing_body_tokens", 300), ("fragmentation", 100), ("missing_header_tokens", 100))


def best_repair(df: DataFrame, key: str, original: str = "original") -> DataFrame:
    """One table repair candidate per key: of the accepted ones, else of the reviewable ones (a block, a row and two columns
    at least), the largest in twelve parts: schema rank (carried headers 3, a projected header 2, else 1), width as in the
    reference, width as most of the pool have it, the capped penalties of REPAIR_CAPS negated, header quality, distances
    from both widths negated; then the name. The reference width is that of the candidate `original`, if it has a header
    of any quality and two columns, else the pool's. The pool's is the most common width above 1 (ties: the widest), if two
    candidates have it.

    Columns: name, accepted, block, n_rows, n_cols, header_action, header_quality and REPAIR_CAPS' names; missing is 0."""
    n = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    ok = F.coalesce(F.col("accepted"), F.lit(False))
    reviewable = (F.coalesce(F.trim("block"), F.lit("")) != "") & (n("n_rows") >= 1) & (n("n_cols") >= 2)
    rows = df.withColumn("__rank", F.when(ok, 2).when(reviewable, 1)).where("__rank is not null")
    rows = join_null_safe(rows, rows.groupBy(key).agg(F.max("__rank").alias("__best")), [key]).where("__rank = __best")
    widths = rows.where(n("n_cols") > 1).groupBy(key, n("n_cols").alias("__w")).agg(F.count(F.lit(1)).alias("__n"))
    common = widths.groupBy(key).agg(F.max_by("__w", F.struct("__n", "__w")).alias("__common"), F.max("__n").alias("__n")).where("__n > 1").drop("__n")
    reference = rows.where((F.col("name") == original) & (n("n_cols") > 1) & (n("header_quality") > 0)).groupBy(key).agg(F.min(n("n_cols")).alias("__reference"))
    rows = join_null_safe(join_null_safe(rows, common, [key], "left"), reference, [key], "left").withColumn("__reference", F.coalesce("__reference", "__common"))
    schema = F.when(F.col("header_action").isin(*HEADER_ACTIONS[3]), 3).when(F.col("header_action").isin(*HEADER_ACTIONS[2]), 2).otherwise(1)
    same = lambda c: F.coalesce((n("n_cols") == F.col(c)).cast("int"), F.lit(0))
    near = lambda c: F.coalesce(-F.abs(n("n_cols") - F.col(c)), F.lit(0))
    parts = [schema, same("__reference"), same("__common"), *[-F.least(n(c), F.lit(cap)) for c, cap in REPAIR_CAPS], n("header_quality"), near("__reference"), near("__common"), F.coalesce("name", F.lit(""))]
    order = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    others = [c for c in df.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in others])


def one_use_each(df: DataFrame, group: str, order: str, left: str, right: str, n_left: str, n_right: str) -> DataFrame:
    """Judged matches in order: in range, and each index of either side used once, the first wins. Adds `status`.

    A missing index or size is out of range. Rows stream through in the order of a window, so of a group only the indexes
    used so far stand in memory; a group's rows are one after the other, as each depends on those before."""
    place, kind = F.row_number().over(Window.partitionBy(group).orderBy(order)), T.StructType([*df.schema.fields, T.StructField("status", T.StringType())])
    inputs = [left, right, n_left, n_right]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used_left, used_right = set(), set()
        for b in batches:
            out, rows = [], b.select([*inputs, "__place"]).to_pydict()
            for a, c, n, m, i in zip(*[rows[x] for x in inputs], rows["__place"]):
                if i == 1:
                    used_left, used_right = set(), set()
                if a is None or c is None or n is None or m is None or not (0 <= a < n and 0 <= c < m):
                    out.append("out of range")
                elif a in used_left or c in used_right:
                    out.append("used")
                else:
                    used_left.add(a)
                    used_right.add(c)
                    out.append("ok")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=kind.names)

    return df.withColumn("__place", place).mapInArrow(check, kind)
