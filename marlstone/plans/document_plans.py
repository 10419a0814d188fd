"""Document operators on documents, pages, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from .registry import Registry, table

plans = Registry()
query = plans.query


#: Table tokens: letter runs, and numbers in plain form.
_TOKENS = """SELECT k, token, count(*) AS n FROM (SELECT k, CASE WHEN regexp_matches(t, '[0-9]') THEN (CASE WHEN n IN ('-0', '-', '') THEN '0' ELSE n END) ELSE t END AS token FROM (SELECT k, t, CASE WHEN contains(m, '.') THEN regexp_replace(m, '\\.?0+$', '') ELSE m END AS n FROM (SELECT k, t, regexp_replace(regexp_replace(t, '^\\+', ''), '^(-?)0+([0-9])', '\\1\\2') AS m FROM (SELECT {k} AS k, unnest(regexp_extract_all(lower(text), '[a-z]+|[-+]?[0-9]+(?:\\.[0-9]+)?')) AS t FROM {t})))) GROUP BY ALL"""


_HEADINGS = "SELECT page_id, i, h FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1), 1) - 1 AS i FROM pages) UNION ALL SELECT page_id, 100, '## 2.' || page_id || ' ' || ['Materials and Methods:', '**Summary**', 'RESULTS.', 'Bibliography', 'Background'][page_id % 5 + 1] FROM pages"


@query(f"""WITH n AS (SELECT page_id, i, lower(regexp_replace(regexp_replace(regexp_replace(trim(h), '^#+[ \\t]*|[*_]', '', 'g'), '^(?:[0-9]+(?:\\.[0-9]+)*\\.?|[IVX]+\\.)[ \\t]+', ''), '[ \\t.:]+$', '')) AS heading FROM ({_HEADINGS}))
 SELECT page_id, i::INT AS i, md5(heading) AS heading, CASE WHEN regexp_matches(heading, '^abstract\\b|^summary\\b') THEN 'abstract' WHEN regexp_matches(heading, '^(materials? and )?methods?\\b|^experimental\\b') THEN 'methods' WHEN regexp_matches(heading, '^results?\\b|^discussion\\b') THEN 'results' WHEN regexp_matches(heading, '^references\\b|^bibliography\\b') THEN 'references' END AS label FROM n""")
def heading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: every heading of every page normalised and classified, and one more a page of the kinds that papers have."""
    p = table(spark, sf_dir, "pages")
    own = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1))).alias("i", "h"))
    kinds = F.array(*map(F.lit, ("Materials and Methods:", "**Summary**", "RESULTS.", "Bibliography", "Background")))
    k = (F.col("page_id") % 5).cast("int")
    more = p.select("page_id", F.lit(100).alias("i"), F.concat(F.lit("## 2."), F.col("page_id").cast("string"), F.lit(" "), F.get(kinds, k)).alias("h"))
    h = own.unionByName(more)
    return h.select("page_id", "i", F.md5(D.normalize_heading(F.col("h"))).alias("heading"), D.classify_heading(F.col("h")).alias("label"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 512 + 1))::INT AS chunk FROM w WHERE len(w) > 0)
 SELECT doc_id, chunk, list_aggregate(w[chunk * 512 + 1 : chunk * 512 + 512], 'string_agg', ' ') AS text, len(w[chunk * 512 + 1 : chunk * 512 + 512])::INT AS n_words FROM c""")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: whole texts in windows of 512 words."""
    return D.word_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 512)


@query("""SELECT source, sum(n)::BIGINT AS rows, count(*) AS different, sum(n - 1)::BIGINT AS copies FROM (SELECT source, md5(trim(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))), count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1""")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: copies of normalised content by source."""
    return D.duplicate_content(table(spark, sf_dir, "documents"), "text", ["source"])


@query(f"""SELECT k AS doc_id, token, n FROM ({_TOKENS.format(k="doc_id", t="documents")})""")
def token_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: token counts of every whole text."""
    return D.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH s AS ({_TOKENS.format(k="item_id", t="benchmark")}), l AS ({_TOKENS.format(k="doc_id", t="documents")}), ss AS (SELECT k, sum(n) AS t FROM s GROUP BY 1), ls AS (SELECT k, sum(n) AS t FROM l GROUP BY 1),
 p AS (SELECT s.k AS a, l.k AS b, sum(least(s.n, l.n)) AS o FROM s JOIN l USING (token) GROUP BY ALL), q AS (SELECT a, b, o / least(ss.t, ls.t) AS score FROM p JOIN ss ON ss.k = a JOIN ls ON ls.k = b WHERE ss.t >= 40 AND ls.t >= 40),
 r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS i, lead(score) OVER (PARTITION BY a ORDER BY score DESC, b) AS nx FROM q WHERE a <> b) SELECT a AS item_id, b AS doc_id, round(score, 9) AS score FROM r WHERE i = 1 AND score >= 0.95 AND score - coalesce(CASE WHEN nx >= 0.85 THEN nx END, 0) >= 0.1""")
def table_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that a document holds, well ahead of the next document."""
    s = D.token_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")
    l = D.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return D.containment(s, l, "item_id", "doc_id").withColumn("score", F.round("score", 9))


_FIGURES = "CASE p_partkey % 4 WHEN 0 THEN 'see Fig. ' || p_size || ' and figure S2' WHEN 1 THEN 'Figures 2-4, fig. 3' WHEN 2 THEN 'Fig. 1-99' ELSE 'nothing' END"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [p_size::VARCHAR, 'S2'] WHEN 1 THEN ['2', '3', '4'] WHEN 2 THEN ['1'] ELSE [] END AS figures FROM part""")
def figure_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: figure references with spread ranges."""
    text = F.expr(_FIGURES.replace("p_size ||", "string(p_size) ||"))
    return table(spark, sf_dir, "part").select("p_partkey", D.figure_ids(text).alias("figures"))


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading carried forward; user turns stand for headings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("turn")).alias("h"))
    return D.carried_heading(c, "conv_id", "turn", "h").drop("h")


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1""")
def first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the first block of each source, numbered anew."""
    return D.first_block_per_source(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "role", "turn")


@query("""WITH w AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'tool' ELSE 'user' END AS role FROM conversations), b AS (SELECT conv_id FROM w WHERE (conv_id, role) NOT IN (SELECT (conv_id, role) FROM conversations))
 SELECT conv_id, turn, role FROM conversations c WHERE (conv_id, role) IN (SELECT (conv_id, role) FROM w) OR conv_id IN (SELECT conv_id FROM b)""")
def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted sources only, the whole context where one can't be found."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    wanted = c.select("conv_id", F.when(F.col("conv_id") % 3 == 0, "tool").otherwise("user").alias("role")).distinct()
    return D.route_sources(c, "conv_id", "role", wanted)


@query("""SELECT page_id, line, width, 3 AS usual FROM (SELECT page_id, unnest([0, 1, 2, 3]) AS line, unnest([3, 3, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 3 END, 3]) AS width FROM pages) WHERE width <> 3""")
def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of markdown tables whose width is not the usual one (an escaped bar is no border)."""
    lines = F.array(F.lit("| a | b | c |"), F.lit("|---|---|---|"), F.when(F.col("page_id") % 3 == 0, "| x | y |").otherwise("| x | y | z |"), F.lit("| p \\| q | r | s |"))
    t = table(spark, sf_dir, "pages").select("page_id", F.posexplode(lines).alias("line", "row"))
    return D.width_problems(t, "page_id", "line", "row").select("page_id", "line", "width", "usual")


@query(f"""WITH r AS ({_TOKENS.format(k="doc_id", t="documents")}) SELECT k AS doc_id, sum(n - n // 2)::BIGINT AS missing, count(*) AS tokens FROM r GROUP BY 1""")
def missing_token_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a candidate with half of each count lacks."""
    r = D.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return D.missing_tokens(r, r.withColumn("n", F.expr("n div 2")), "doc_id")


@query("""WITH c AS (SELECT p_brand, p_name, p_partkey, p_size > 30 AS ok, p_size % 4 AS width, p_size % 9 AS pen FROM part), b AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY p_brand) AS any_ok FROM c) WHERE ok = any_ok), k AS (SELECT p_brand, width, count(*) AS n FROM b GROUP BY ALL),
 u AS (SELECT p_brand, width AS usual FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, width) AS i FROM k) WHERE i = 1) SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(width - usual), least(pen, 5), p_partkey DESC) AS i FROM b JOIN u USING (p_brand)) WHERE i = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the best candidate by pool, usual width, capped penalties, then name descending."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") > 30).alias("ok"), (F.col("p_size") % 4).alias("width"), (F.col("p_size") % 9).alias("pen"))
    return D.best_candidate(p, "p_brand", "ok", "width", ["pen"], "p_partkey").select("p_brand", "p_partkey")


@query("""WITH s AS (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, role) AS a, min(turn) OVER (PARTITION BY conv_id, md5(coalesce(text, ''))) AS b FROM conversations) SELECT conv_id, turn FROM s WHERE a = turn OR b = turn""")
def entry_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: entries all of whose sources were seen before are dropped; a turn's role and its text stand for its sources."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.col("role"), F.md5(F.coalesce("text", F.lit("")))).alias("sources"))
    return D.entries_with_news(c, ["conv_id"], "turn", "sources").select("conv_id", "turn")


@query("""WITH c AS (SELECT p_brand, p_partkey AS id, 'c' || lpad(p_partkey::VARCHAR, 7, '0') AS name, p_size > 30 AS ok, p_size % 5 AS w, p_size % 3 AS rank, p_size % 23 AS pen, (p_partkey % 11)::INT AS hq FROM part), b AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY p_brand) AS any_ok FROM c WHERE ok OR w >= 2) WHERE ok = any_ok),
 k AS (SELECT p_brand, w, count(*) AS n FROM b WHERE w > 1 GROUP BY ALL), u AS (SELECT p_brand, w AS usual FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w DESC) AS i FROM k) WHERE i = 1 AND n > 1)
 SELECT p_brand, id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE rank WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END DESC, coalesce((w = usual)::INT, 0) DESC, -least(pen, 20) DESC, hq DESC, coalesce(-abs(w - usual), 0) DESC, name DESC) AS i FROM b LEFT JOIN u USING (p_brand)) WHERE i = 1""")
def repair_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the best repair candidate by its twelve-part key; sizes and keys of parts stand for the key's parts."""
    size, k = F.col("p_size"), F.col("p_partkey")
    action = F.when(size % 3 == 0, "carried_header").when(size % 3 == 1, "projected_header_drop_optional_blank_column").otherwise("none")
    name = F.concat(F.lit("c"), F.lpad(k.cast("string"), 7, "0"))
    c = table(spark, sf_dir, "part").select("p_brand", k.alias("id"), name.alias("name"), (size > 30).alias("accepted"), F.lit("|a|").alias("block"), F.lit(1).alias("n_rows"), (size % 5).alias("n_cols"), action.alias("header_action"), (size % 23).alias("contamination"), (k % 11).alias("header_quality"))
    c = c.withColumns({n: F.lit(0) for n, _ in D.REPAIR_CAPS[1:]})
    return D.best_repair(c, "p_brand").select("p_brand", "id")


@query()
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tables, in parts of 2,000 characters and 40 cells with the first line repeated."""
    return D.split_tables(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 1, 2000, 40)


@query()
def fuzzy_chunk_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with even and odd ids (two versions) matched one to one within a language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    left, right = d.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "old_id"), d.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "new_id")
    return D.fuzzy_pairs(left, right, "old_id", "new_id", ["lang"], "text").withColumn("score", F.round("score", 9))


@query()
def global_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one assignment of suppliers to parts within a return flag, best revenue first."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return D.greedy_assignment(s, "l_returnflag", "l_suppkey", "l_partkey", "score", 20.0)


@query("""WITH RECURSIVE m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, (l_partkey % 5)::BIGINT AS a, (l_suppkey % 5)::BIGINT AS b FROM lineitem),
 r AS (SELECT l_orderkey, 0::BIGINT AS i, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::VARCHAR AS status FROM m WHERE i = 1 UNION ALL SELECT m.l_orderkey, m.i, CASE WHEN a < 4 AND b < 4 AND NOT list_contains(ua, a) AND NOT list_contains(ub, b) THEN list_append(ua, a) ELSE ua END, CASE WHEN a < 4 AND b < 4 AND NOT list_contains(ua, a) AND NOT list_contains(ub, b) THEN list_append(ub, b) ELSE ub END,
 CASE WHEN a >= 4 OR b >= 4 THEN 'out of range' WHEN list_contains(ua, a) OR list_contains(ub, b) THEN 'used' ELSE 'ok' END FROM r JOIN m ON m.l_orderkey = r.l_orderkey AND m.i = r.i + 1) SELECT status, count(*) AS n FROM r WHERE i > 0 GROUP BY 1""")
def judged_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged matches validated in order, each index used once."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", i.alias("i"), (F.col("l_partkey") % 5).alias("a"), (F.col("l_suppkey") % 5).alias("b"), F.lit(4).alias("n"), F.lit(4).alias("m"))
    return D.one_use_each(m, "l_orderkey", "i", "a", "b", "n", "m").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
