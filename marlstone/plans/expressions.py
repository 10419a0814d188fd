"""Expression operators on the driver's tables. Dirty text is made from clean columns, alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from .registry import Registry, table

plans = Registry()
query = plans.query

_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: Reported values of part: a number, a list, a range, an uncertainty, a missing token, words.
_REPORTED = """CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(CAST(p_size AS STRING), '; ', CAST(p_size + 4 AS STRING))
 WHEN 2 THEN concat(CAST(p_size AS STRING), '-', CAST(p_size + 10 AS STRING)) WHEN 3 THEN concat(CAST(p_size AS STRING), ' ± 1') WHEN 4 THEN 'N/A' ELSE 'not given' END"""
_REPORTED_DUCK = _REPORTED.replace("AS STRING", "AS VARCHAR")


@query(
    """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE lower(trim(v)) IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'not applicable') OR v IS NULL) AS n_missing,
 count(*) FILTER (WHERE coalesce(lower(trim(f)) IN ('1', 'true', 't', 'yes', 'y'), false)) AS n_true
 FROM (SELECT event_type, CASE event_id % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN NULL WHEN 2 THEN 'None' ELSE props END AS v,
       CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '1' WHEN 2 THEN NULL ELSE 'no' END AS f FROM events) GROUP BY event_type"""
)
def missing_token_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2: missing tokens and truthy flags on events."""
    e = table(spark, sf_dir, "events").selectExpr("event_type", "CASE event_id % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN NULL WHEN 2 THEN 'None' ELSE props END AS v", "CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '1' WHEN 2 THEN NULL ELSE 'no' END AS f")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_missing(F.col("v"))).alias("n_missing"), F.count_if(X.is_true(F.col("f"))).alias("n_true"))


@query(
    f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 2.0 WHEN 2 THEN p_size + 5.0 WHEN 3 THEN (p_size + 1) / 2.0 ELSE NULL END AS number FROM part"""
)
def number_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: full numbers, means of lists, midpoints of ranges (and of a value and its uncertainty)."""
    return table(spark, sf_dir, "part").select("p_partkey", X.coerce_number(F.expr(_REPORTED)).alias("number"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'single' WHEN 1 THEN 'list' WHEN 2 THEN 'range' WHEN 3 THEN 'uncertainty' ELSE 'none' END AS kind,
 CASE p_partkey % 6 WHEN 0 THEN p_size::DOUBLE WHEN 2 THEN p_size + 5.0 WHEN 3 THEN p_size::DOUBLE END AS centre FROM part"""
)
def range_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: kind and centre of a reported value."""
    return table(spark, sf_dir, "part").select("p_partkey", X.classify_value(F.expr(_REPORTED)).alias("v")).select("p_partkey", "v.*")


_UNITS = ("mg/L", "µg/L", "ppb", "g", "mM", "mg L-1", "mmol/L", "hours")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, ['mg/l', 'ug/l', 'ug/l', 'g', 'mmol/l', 'mg/l', 'mmol/l', 'h'][(l_partkey % 8 + 1)::INT] AS u, l_suppkey FROM lineitem)
 SELECT l_orderkey, l_linenumber, q::VARCHAR AS value, u AS unit,
 round(CASE u WHEN 'mg/l' THEN q WHEN 'ug/l' THEN q * 0.001 WHEN 'mmol/l' THEN q * (l_suppkey + 100) END, 6) AS mg_per_l,
 CASE WHEN u IN ('g', 'h') THEN 'unit mismatch' END AS reason FROM a"""
)
def value_unit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H8, H9: value and unit apart, unit normalised, converted to mg/L with a molar mass for amounts."""
    raw = F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, "_").otherwise(" "), F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("l_partkey") % 8 + 1).cast("int")))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", X.value_unit(raw).alias("v"))
    done = X.convert(F.col("v.value").cast("double"), F.col("v.unit"), "mass", "volume", F.col("l_suppkey") + 100)
    d = d.select("l_orderkey", "l_linenumber", "v.value", X.normalize_unit(F.col("v.unit")).alias("unit"), done.alias("d"))
    return d.select("l_orderkey", "l_linenumber", "value", "unit", F.round("d.value", 6).alias("mg_per_l"), "d.reason")


@query(
    """SELECT u AS unit, count(*) AS n, sum((round(l_quantity)::DECIMAL(18,6) * f))::DECIMAL(38,9)::VARCHAR AS total
 FROM (SELECT l_quantity, ['g/l', 'mg/l', 'ug/l', 'ng/l'][(l_partkey % 4 + 1)::INT] AS u, [1000, 1, 0.001, 0.000001][(l_partkey % 4 + 1)::INT]::DECIMAL(18,6) AS f FROM lineitem) GROUP BY u"""
)
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decimal conversion to mg/L."""
    unit = F.element_at(F.array(*map(F.lit, ("g/L", "mg/L", "µg/L", "ng/L"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "lineitem").select(X.normalize_unit(unit).alias("unit"), X.to_mg_per_l(F.round("l_quantity"), unit).alias("v"))
    return d.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("decimal(38,9)").cast("string").alias("total"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN v = 0 THEN 0 ELSE round(v * pow(10, 5 - floor(log10(abs(v))))) / pow(10, 5 - floor(log10(abs(v)))) END AS fraction
 FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 OR l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END AS v FROM lineitem)"""
)
def percent_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: percents and fractions to fractions of six digits."""
    raw = F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " %").otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.percent_to_fraction(raw).alias("fraction"))


@query(
    """SELECT p_partkey, regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]', '', 'g') AS identity, '10.1000/part.' || p_partkey AS doi,
 CASE WHEN p_partkey % 2 = 0 THEN 'DTXSID' || lpad(p_partkey::VARCHAR, 7, '0') END AS substance, CASE WHEN p_partkey % 3 = 0 THEN 'Y' ELSE 'N' END AS yn,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS finite, p_partkey AS natural_no FROM part"""
)
def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 (ASCII), H19, H20, H21, E5: identity keys, DOI, substance ids, yes/no, finite numbers, natural order."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = key.cast("string")
    return p.select(
        "p_partkey", X.identity_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("identity"),
        X.doi_key(F.concat(F.element_at(F.array(*map(F.lit, ("https://doi.org/", "DOI: ", "", "http://dx.doi.org/"))), (key % 4 + 1).cast("int")), F.lit("10.1000/PART."), text)).alias("doi"),
        X.substance_id(F.concat(F.when(key % 2 == 0, " dtxsid").otherwise("CID"), F.lpad(text, 7, "0"))).alias("substance"),
        X.yes_no(F.when(key % 3 == 0, "Yes, partly").otherwise(F.when(key % 3 == 1, "none"))).alias("yn"),
        X.finite_number(F.when(key % 5 == 0, "Infinity").otherwise(F.col("p_size").cast("string"))).alias("finite"),
        X.natural_number(F.concat(F.lit("study_"), text)).alias("natural_no"),
    )


@query(
    """SELECT s_suppkey, CASE WHEN ok THEN cas END AS cas FROM (
 SELECT s_suppkey, cas, (list_sum(list_transform(range(1, len(d)), lambda i: i * substr(d, len(d) - i, 1)::INT)) % 10) = right(d, 1)::INT AS ok
 FROM (SELECT s_suppkey, cas, replace(cas, '-', '') AS d FROM (SELECT s_suppkey, (s_suppkey + 100)::VARCHAR || '-' || lpad((s_suppkey % 100)::VARCHAR, 2, '0') || '-' || (s_suppkey % 10)::VARCHAR AS cas FROM supplier)))"""
)
def cas_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry numbers with a right check digit."""
    k = F.col("s_suppkey")
    cas = F.concat_ws("-", (k + 100).cast("string"), F.lpad((k % 100).cast("string"), 2, "0"), (k % 10).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.cas_number(cas).alias("cas"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_brand, p_type, p_size::VARCHAR, 'x'] END AS slots,
 CASE WHEN p_partkey % 3 = 0 THEN 'a; b' ELSE 'a; b; c' END AS notes, ['ph=7', 'temp=' || p_size, 'dose=1', 'other'] AS tokens FROM part"""
)
def composite_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite ids, note append, category order of tokens."""
    key = F.col("p_partkey")
    cid = F.concat_ws(" | ", "p_brand", "p_type", F.col("p_size").cast("string"), F.when(key % 2 == 0, "x"))
    tokens = F.array(F.lit("other"), F.lit("dose=1"), F.concat(F.lit("temp="), F.col("p_size").cast("string")), F.lit("ph=7"))
    return table(spark, sf_dir, "part").select("p_partkey", X.composite_id(cid).alias("slots"), X.add_note(F.lit("a; b"), F.when(key % 3 == 0, "b").otherwise("c")).alias("notes"), X.ordered_tokens(tokens, {"ph": 0, "temp": 1, "dose": 2}, 9).alias("tokens"))


@query(
    """SELECT p_partkey, coalesce(list_extract(list_filter(its, lambda x: lower(string_split(x, ':')[1]) = lower(p_brand)), 1), its[1]) AS picked, len(its) AS n_items
 FROM (SELECT p_partkey, p_brand, ['first: 1', CASE WHEN p_partkey % 2 = 0 THEN p_brand || ': 2' ELSE 'second' END, 'last'] AS its FROM part)"""
)
def packed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: split a packed series and take the item that the row's name hints at."""
    raw = F.concat(F.lit("first: 1 ;"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(": 2"))).otherwise("second"), F.lit(" && ; last ;"))
    return table(spark, sf_dir, "part").select("p_partkey", X.pick_item(raw, F.col("p_brand")).alias("picked"), F.size(X.items(raw)).cast("long").alias("n_items"))


@query(
    """SELECT p_partkey, axis, value, flagged FROM (
  SELECT p_partkey, 'c0' AS axis, unnest(CASE p_partkey % 4 WHEN 0 THEN [p_size::DOUBLE] WHEN 1 THEN [p_size::DOUBLE, p_size + 5.0] WHEN 2 THEN [p_size::DOUBLE, p_size + 3.0] ELSE [NULL::DOUBLE] END) AS value, p_partkey % 4 = 3 AS flagged FROM part)"""
)
def guarded_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per list item or range end; a row with several values on both axes stays one and is flagged."""
    s = F.col("p_size")
    c0 = F.when(F.col("p_partkey") % 4 == 0, s.cast("string")).when(F.col("p_partkey") % 4 == 1, F.concat_ws("-", s.cast("string"), (s + 5).cast("string"))).when(F.col("p_partkey") % 4 == 2, F.concat_ws("; ", (s + 3).cast("string"), F.lit("0"), s.cast("string"), s.cast("string"))).otherwise("1; 2")
    d = table(spark, sf_dir, "part").select("p_partkey", X.endpoints(c0).alias("c"), X.endpoints(F.when(F.col("p_partkey") % 4 == 3, "3-4").otherwise("3")).alias("d"))
    both = (F.size("c") > 1) & (F.size("d") > 1)
    return d.select("p_partkey", F.lit("c0").alias("axis"), both.alias("flagged"), F.explode_outer(F.when(both, F.array(F.lit(None).cast("double"))).otherwise(F.col("c"))).alias("value"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN (CASE WHEN abs(p_size / 5.0 - 7) <= 2 THEN 'a' WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'c' END) END AS value FROM part"""
)
def list_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value whose paired key is closest to 7; lists of unequal length have none."""
    k = F.col("p_partkey")
    keys = F.array(F.col("p_size") / 5, F.when(k % 3 == 0, 9.0).otherwise(30.0), F.when(k % 3 == 0, 5.0).otherwise(9.0))
    values = F.when(k % 3 == 2, F.array(F.lit("a"))).otherwise(F.array(*map(F.lit, "abc")))
    return table(spark, sf_dir, "part").select("p_partkey", X.closest_pair_value(keys, values, 7.0).alias("value"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN list_contains(string_split(p_type, ' '), 'STEEL') END AS steel,
 CASE WHEN p_partkey % 4 <> 0 THEN list_contains(string_split(p_type, ' '), 'SMALL') END AS small FROM part"""
)
def multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-state indicators from label text."""
    labels = F.split(F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", X.indicator(labels, "STEEL").alias("steel"), X.indicator(labels, "SMALL").alias("small"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 3) THEN round((p_size / 100.0 + 0.3) / 2, 9) WHEN p_partkey % 4 = 1 THEN 0.5 END AS value,
 CASE WHEN p_partkey % 4 = 2 THEN 'ash outside 0..1' WHEN p_partkey % 4 IN (0, 3) AND abs(p_size / 100.0 - 0.3) / ((p_size / 100.0 + 0.3) / 2) > 0.10 THEN 'ash values disagree' END AS note FROM part"""
    .replace("THEN round((p_size / 100.0 + 0.3) / 2, 9) WHEN", "AND abs(p_size / 100.0 - 0.3) / ((p_size / 100.0 + 0.3) / 2) <= 0.10 THEN round((p_size / 100.0 + 0.3) / 2, 9) WHEN")
)
def bounded_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percents scaled, values out of bounds voided, means only of coherent values."""
    k, s = F.col("p_partkey") % 4, F.col("p_size")
    values = F.when(k == 1, F.array(F.lit(50.0))).when(k == 2, F.array(F.lit(0.2), F.lit(150.0))).otherwise(F.array(s / F.lit(100.0), F.lit(0.3)))
    d = table(spark, sf_dir, "part").select("p_partkey", X.bounded_fraction(values, name="ash").alias("b"))
    return d.select("p_partkey", F.round("b.value", 9).alias("value"), "b.note")


@query(
    """SELECT p_partkey, CASE WHEN ok THEN c END AS c, CASE WHEN ok THEN n END AS n, CASE WHEN ok THEN NULL ELSE 'total above 1' END AS element_note FROM (SELECT p_partkey, round(c, 9) AS c, round(n, 9) AS n, c + n <= 1.001 AS ok
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 2) / 100 ELSE (p_size + 2) / 60 END AS c, CASE WHEN p_partkey % 2 = 0 THEN 0.5 / 100 ELSE 0.5 END AS n FROM part WHERE p_partkey % 2 = 0 OR p_size < 58))"""
)
def elemental_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One content above 1 makes a row percents; totals above 1 void it."""
    s, even = F.col("p_size"), F.col("p_partkey") % 2 == 0
    p = table(spark, sf_dir, "part").where(even | (s < 58)).select("p_partkey", F.when(even, F.array(s + F.lit(2.0))).otherwise(F.array((s + 2) / F.lit(60.0))).alias("c"), F.array(F.lit(0.5)).alias("n"))
    return X.elemental_fractions(p, ["c", "n"]).withColumns({c: F.round(c, 9) for c in ("c", "n")})
