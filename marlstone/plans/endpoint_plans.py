"""Endpoint derivation on lineitem: quantity stands for C0, part size for the dose, discount and tax for removal and uptake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import endpoints as E
from .registry import Registry, table

plans = Registry()
query = plans.query

_ROWS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS c0, p_size::DOUBLE AS d, CASE WHEN l_linenumber = 1 THEN l_discount * 100 ELSE l_discount * 9 END AS removal, l_linenumber = 1 AS pct, l_tax * 1000 AS q,
 p_retailprice / 100 AS qm, (l_tax + 0.01) AS kl, 0.85 + l_discount AS r2l, p_retailprice / 300 AS kf, 0.4 + l_tax * 5 AS ex, 0.85 + l_tax AS r2f FROM lineitem JOIN part ON p_partkey = l_partkey"""
_F = "CASE WHEN f < 1 THEN f END AS f FROM (SELECT *, greatest(least(CASE WHEN pct OR removal > 1 THEN removal / 100 ELSE removal END, 1), 0) AS f"
_A = f"SELECT * EXCLUDE (f), {_F} FROM ({_ROWS}))"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    c, one = F.col, F.col("l_linenumber") == 1
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").alias("c0"), c("p_size").cast("double").alias("d"), F.when(one, c("l_discount") * 100).otherwise(c("l_discount") * 9).alias("removal"), one.alias("pct"),
        (c("l_tax") * 1000).alias("q"), (c("p_retailprice") / 100).alias("qm"), (c("l_tax") + 0.01).alias("kl"), (0.85 + c("l_discount")).alias("r2l"), (c("p_retailprice") / 300).alias("kf"), (0.4 + c("l_tax") * 5).alias("ex"), (0.85 + c("l_tax")).alias("r2f"),
    ).withColumn("f", E.removal_fraction(c("removal"), c("pct")))


def _r(c, n=8):
    return F.round(c, n)


@query(f"""SELECT l_orderkey, l_linenumber, round(f, 8) AS f, round(CASE WHEN f > 0 AND d > 0 THEN 1000 * f / (d * (1 - f)) END, 8) AS kd, round(CASE WHEN c0 * (1 - f) > 0 THEN c0 * (1 - f) END, 8) AS ce,
 round(CASE WHEN f > 0 AND d > 0 THEN log10(1000 * f / (d * (1 - f))) END, 8) AS logkd FROM ({_A})""")
def endpoint_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kd and Ce from a removal."""
    c = F.col
    kd = E.kd_from_removal(c("f"), c("d"))
    return _rows(spark, sf_dir).select("l_orderkey", "l_linenumber", _r("f").alias("f"), _r(kd).alias("kd"), _r(E.ce_from_removal(c("f"), c("c0"))).alias("ce"), _r(E.log10(kd)).alias("logkd"))


@query(f"""SELECT l_orderkey, l_linenumber, round(ce, 8) AS ce, round(q / ce, 8) AS kd, round(c0 / (1 + (q / ce) * d / 1000), 8) AS ce_again FROM (SELECT *, CASE WHEN c0 - q * d / 1000 > 0 THEN c0 - q * d / 1000 END AS ce FROM ({_A}))""")
def endpoint_uptake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ce and Kd from an uptake, and Ce back from Kd."""
    c = F.col
    ce = E.ce_from_uptake(c("c0"), c("q"), c("d"))
    kd = E.kd_from_uptake(c("q"), ce)
    return _rows(spark, sf_dir).select("l_orderkey", "l_linenumber", _r(ce).alias("ce"), _r(kd).alias("kd"), _r(E.ce_from_kd(c("c0"), kd, c("d"))).alias("ce_again"))


_LANGMUIR = "CASE WHEN (sqrt(b * b + 4 * kl * c0) - b) / (2 * kl) > 0 AND (sqrt(b * b + 4 * kl * c0) - b) / (2 * kl) <= c0 + 1e-9 THEN (sqrt(b * b + 4 * kl * c0) - b) / (2 * kl) END"


@query(f"""SELECT l_orderkey, l_linenumber, round(ce, 7) AS ce, abs(ce + d / 1000 * qm * kl * ce / (1 + kl * ce) - c0) < 1e-9 AS solved, round(qm * kl / (1 + kl), 7) AS kd_at_1, round(qm * kl * 0.1 / (1 + kl * 0.1) / 0.1, 7) AS "kd_at_0.1"
 FROM (SELECT *, {_LANGMUIR} AS ce FROM (SELECT *, 1 + kl * (d / 1000 * qm - c0) AS b FROM ({_A})))""".replace('"kd_at_0.1"', "kd_at_01"))
def endpoint_langmuir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ce on a Langmuir curve and Kd at benchmark concentrations."""
    c = F.col
    ce = E.ce_langmuir(c("c0"), c("d"), c("qm"), c("kl"))
    at = E.kd_at([1.0, 0.1], c("qm"), c("kl"))
    solved = F.abs(ce + c("d") / 1000 * E.q_langmuir(ce, c("qm"), c("kl")) - c("c0")) < 1e-9
    return _rows(spark, sf_dir).select("l_orderkey", "l_linenumber", _r(ce, 7).alias("ce"), solved.alias("solved"), _r(at["kd_at_1"], 7).alias("kd_at_1"), _r(at["kd_at_0.1"], 7).alias("kd_at_01"))


@query(f"SELECT l_orderkey, l_linenumber, true AS solved FROM ({_A})")
def endpoint_freundlich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ce on a Freundlich curve; every root solves the balance to 1e-9. Values are tested against numpy."""
    c = F.col
    ce = E.ce_freundlich(c("c0"), c("d"), c("kf"), c("ex"))
    d = _rows(spark, sf_dir).withColumn("ce", ce)
    return d.select("l_orderkey", "l_linenumber", (F.abs(c("ce") + c("d") / 1000 * c("kf") * F.pow("ce", "ex") - c("c0")) < 1e-9).alias("solved"))


@query(f"""WITH a AS (SELECT *, c0 * (1 - f) AS ce1, 1000 * f / (d * (1 - f)) AS kd1, c0 - q * d / 1000 AS ce2, 1 + kl * (d / 1000 * qm - c0) AS b FROM ({_A})), l AS (SELECT *, {_LANGMUIR} AS ce3 FROM a),
 s AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN f > 0 AND d > 0 AND ce1 > 0 AND ce1 < c0 THEN {{'a': (ce1 <= 1e-5 OR 1 - ce1 / c0 >= 0.99 OR 1 - ce1 / c0 <= 0.01)::INT, 'b': 0, 'o': 0, 's': 'removal', 'kd': kd1}} END, CASE WHEN ce2 > 0 AND ce2 < c0 AND q > 0 THEN {{'a': (ce2 <= 1e-5 OR 1 - ce2 / c0 >= 0.99 OR 1 - ce2 / c0 <= 0.01)::INT, 'b': 0, 'o': 1, 's': 'uptake', 'kd': q / ce2}} END,
 CASE WHEN ce3 > 0 AND ce3 < c0 AND r2l >= 0.9 THEN {{'a': (ce3 <= 1e-5 OR 1 - ce3 / c0 >= 0.99 OR 1 - ce3 / c0 <= 0.01)::INT, 'b': 1, 'o': 2, 's': 'Langmuir', 'kd': qm * kl / (1 + kl * ce3)}} END], lambda x: x IS NOT NULL) AS c FROM l)
 SELECT l_orderkey, l_linenumber, list_sort(c)[1].s AS source, round(list_sort(c)[1].kd, 7) AS kd FROM s""")
def endpoint_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete bundle of least risk, direct before fitted, then by rank."""
    c = F.col
    d = E.with_langmuir(_rows(spark, sf_dir), "ce3", c("c0"), c("d"), c("qm"), c("kl"))
    d = d.withColumns({"ce1": E.ce_from_removal(c("f"), c("c0")), "ce2": E.ce_from_uptake(c("c0"), c("q"), c("d"))})
    none = F.lit(None).cast("double")
    bundles = [
        E.candidate("removal", 0, False, E.kd_from_removal(c("f"), c("d")), c("ce1"), c("c0"), none, [E.risk(c("ce1"), c("c0")).isNotNull()]),
        E.candidate("uptake", 1, False, E.kd_from_uptake(c("q"), c("ce2")), c("ce2"), c("c0"), none, [E.risk(c("ce2"), c("c0")).isNotNull()]),
        E.candidate("Langmuir", 2, True, E.q_langmuir(c("ce3"), c("qm"), c("kl")) / c("ce3"), c("ce3"), c("c0"), c("r2l"), [E.risk(c("ce3"), c("c0")).isNotNull()]),
    ]
    d = d.withColumns({f"b{i}": b for i, b in enumerate(bundles)})
    return d.withColumn("s", E.select_candidate([c(f"b{i}") for i in range(len(bundles))])).select("l_orderkey", "l_linenumber", c("s.source").alias("source"), _r("s.kd", 7).alias("kd"))


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, f, c0, CASE WHEN f > 0 THEN log10(f / (1 - f)) END AS l0, CASE WHEN f > 0 AND f + 0.01 < 1 THEN log10((f + 0.01) / (1 - f - 0.01)) END AS up, CASE WHEN f > 0.01 THEN log10((f - 0.01) / (1 - f + 0.01)) END AS dn FROM ({_A}))
 SELECT l_orderkey, l_linenumber, CASE WHEN f > 0 THEN coalesce(abs(up - l0) > 0.35, true) END AS spike, CASE WHEN f > 0 THEN coalesce(abs(dn - l0) > 0.35, true) END AS dip,
 concat_ws('; ', CASE WHEN f IS NULL THEN 'no removal' END, CASE WHEN c0 < 5 THEN 'low concentration' END, CASE WHEN f > 0 AND coalesce(abs(dn - l0) > 0.35, true) THEN 'unstable' END) AS reasons,
 CASE WHEN c0 < 5 THEN 'review_required' WHEN f IS NULL OR f <= 0 THEN 'not_computable' ELSE 'clean' END AS status FROM o""")
def endpoint_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9 (mass balance), I12, I16, I17: conversion instability, block reasons, record status."""
    c = F.col
    d = _rows(spark, sf_dir).withColumns({"spike": E.unstable(c("f"), True), "dip": E.unstable(c("f"), False)})
    reasons = E.block_reasons({"no removal": c("f").isNull(), "low concentration": c("c0") < 5, "unstable": c("dip")})
    return d.select("l_orderkey", "l_linenumber", "spike", "dip", F.array_join(reasons, "; ").alias("reasons"), E.record_status(c("c0") < 5, c("f") > 0).alias("status"))


@query()
def reference_dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log Kd at the reference dose from an isotherm, or from an observation near it."""
    c = F.col
    d = _rows(spark, sf_dir).withColumns({"logkd": E.log10(E.kd_from_removal(c("f"), c("d"))), "source": F.when(c("l_linenumber") % 2 == 0, "Freundlich").otherwise("Removal")})
    out = E.reference_dose(d, "c0", "d", "logkd", "source", ("qm", "kl", "r2l"), ("kf", "ex", "r2f"))
    return out.select("l_orderkey", "l_linenumber", "ref_basis", "ref_exact", "ref_dose", _r("ref_logkd").alias("ref_logkd"))


@query("""WITH s AS (SELECT p_partkey, unnest([{'i': 'Na', 'c': p_size / 1000}, {'i': 'Ca', 'c': p_size / 4000}, {'i': CASE WHEN p_partkey % 5 = 0 THEN 'Xx' ELSE 'Cl' END, 'c': p_size / 800}], recursive := true) FROM part), a AS (SELECT p_partkey, CASE WHEN bool_or(i = 'Xx') THEN NULL ELSE sum(c * z * z) / 2 END AS v, CASE WHEN bool_or(i = 'Xx') THEN NULL ELSE sum(c * z) END AS bal FROM s LEFT JOIN (VALUES ('Na', 1), ('Ca', 2), ('Cl', -1)) t(ion, z) ON ion = i GROUP BY 1)
 SELECT p_partkey, round(coalesce(rep, v), 9) AS strength, round(bal, 9) + 0.0 AS balance, CASE WHEN abs(v - rep) > 0.05 * abs(rep) THEN 'reported and computed differ' END AS note FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 600 END AS rep FROM part) JOIN a USING (p_partkey)""")
def ionic_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ionic strength from species, charge balance, reported value first."""
    s, k = F.col("p_size"), F.col("p_partkey")
    ion = lambda name, c: F.struct(name.alias("ion"), c.alias("c"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(ion(F.lit("Na"), s / 1000), ion(F.lit("Ca"), s / 4000), ion(F.when(k % 5 == 0, "Xx").otherwise("Cl"), s / 800)).alias("species"), F.when(k % 3 == 0, s / 600).alias("reported"))
    ions = spark.createDataFrame([("Na", 1), ("Ca", 2), ("Cl", -1)], "ion string, z int")
    return E.ionic_strength(p, ["p_partkey"], "species", ions, "reported").select("p_partkey", _r("strength", 9).alias("strength"), (_r("balance", 9) + 0.0).alias("balance"), "note")


@query(f"""SELECT l_orderkey, l_linenumber, coalesce(e < 1 AND bad, false) AS spike, coalesce(e > 1 AND bad, false) AS dip FROM (SELECT l_orderkey, l_linenumber, e, CASE WHEN f + 0.01 >= 1 THEN true WHEN f >= 0 AND f < 0.99 THEN abs((1 - e) * log10((1 - f) / (1 - f - 0.01))) > 0.35 ELSE false END AS bad
 FROM (SELECT l_orderkey, l_linenumber, least(f * 1.6, 0.985) AS f, CASE WHEN ex > 0.6 THEN ex + 0.5 ELSE ex END AS e FROM ({_A})))""")
def freundlich_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I9 (Freundlich): spikes for exponents below 1, dips above."""
    c = F.col
    spike, dip = E.unstable_freundlich(F.least(c("f") * 1.6, F.lit(0.985)), F.when(c("ex") > 0.6, c("ex") + 0.5).otherwise(c("ex")))
    return _rows(spark, sf_dir).select("l_orderkey", "l_linenumber", spike.alias("spike"), dip.alias("dip"))
