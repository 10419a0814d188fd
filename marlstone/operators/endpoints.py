"""Endpoint derivation: equilibrium concentrations and distribution coefficients, their choice and their flags.

Concentrations in mg/L, dose D in mg/L, uptake q in mg/g, Kd in L/g. Every function is a Column expression; null
stands for "cannot be computed". Logarithms and divisions are guarded, as ANSI mode is on.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: R2 that a fit needs, R2 band within which priority decides, the reference dose and its tolerance, the
#: change of log10 Kd that a change of removal by STEP may cause, the detection limit of 10 ng/L.
FIT_R2, R2_BAND, DOSE, DOSE_TOLERANCE, UNSTABLE, STEP, FLOOR = 0.90, 0.02, 25.0, 5.0, 0.35, 0.01, 1e-5


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def log10(c: Column) -> Column:
    return F.log10(positive(c))


def removal_fraction(value: Column, percent: Column) -> Column:
    """A removal as a fraction: with a percent sign or above 1 a hundredth, clamped to 0..1; complete removal is null."""
    f = F.greatest(F.least(F.when(percent | (value > 1), value / 100).otherwise(value), F.lit(1.0)), F.lit(0.0))
    return F.when(value.isNotNull() & (f < 1), f)


def kd_from_removal(f: Column, dose: Column) -> Column:
    return F.when((f > 0) & (f < 1) & (dose > 0), 1000 * f / (dose * (1 - f)))


def ce_from_removal(f: Column, c0: Column) -> Column:
    return positive(c0 * (1 - f))


def ce_from_uptake(c0: Column, q: Column, dose: Column) -> Column:
    return F.when(q >= 0, positive(c0 - q * dose / 1000))


def kd_from_uptake(q: Column, ce: Column) -> Column:
    return F.when((q >= 0) & (ce > 0), F.try_divide(q, ce))


def ce_from_kd(c0: Column, kd: Column, dose: Column) -> Column:
    return F.when((c0 > 0) & (kd >= 0) & (dose > 0), c0 / (1 + kd * dose / 1000))


def ce_langmuir(c0: Column, dose: Column, qm: Column, kl: Column) -> Column:
    """Smallest positive root, C0 at most, of Ce + (D/1000) qm kl Ce / (1 + kl Ce) = C0.

    Of the two forms of the quadratic's root that is taken which adds numbers of one sign, so no digits cancel."""
    b = 1 + kl * (dose / 1000 * qm - c0)
    return _langmuir_root(c0, dose, qm, kl, b, F.sqrt(b * b + 4 * kl * c0) + F.abs(b))


def _langmuir_root(c0: Column, dose: Column, qm: Column, kl: Column, b: Column, t: Column) -> Column:
    root = F.when(b > 0, 2 * c0 / t).otherwise(t / (2 * kl))
    return F.when((c0 > 0) & (dose > 0) & (qm > 0) & (kl > 0) & (b < 1e150), F.least(root, c0))  # beyond, squares overflow


def with_langmuir(df: DataFrame, name: str, c0: Column, dose: Column, qm: Column, kl: Column) -> DataFrame:
    """df with ce_langmuir as a column. Its parts are columns first, so that generated code has each once and stays small
    enough to be compiled; for plans that use the root many times."""
    rows = df.withColumn("__b", 1 + kl * (dose / 1000 * qm - c0))
    rows = rows.withColumn("__t", F.sqrt(F.col("__b") * F.col("__b") + 4 * kl * c0) + F.abs("__b"))
    return rows.withColumn(name, _langmuir_root(c0, dose, qm, kl, F.col("__b"), F.col("__t"))).drop("__b", "__t")


def q_langmuir(ce: Column, qm: Column, kl: Column) -> Column:
    return qm * kl * ce / (1 + kl * ce)


#: Steps of the Freundlich search at most, and how far the balance may be off, as a share of C0.
STEPS, BALANCE = 60, 1e-12


def freundlich_root(c0: np.ndarray, dose: np.ndarray, kf: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """Roots in (0, C0] of Ce + (D/1000) kf Ce^exponent = C0; nan where the input is unusable or the balance isn't met.

    In t = ln Ce, f = ln of the left side less ln C0 is convex with a slope between exponent and 1. The root lies between
    min(ln C0/2, ln (C0 / 2a) / exponent) and the same without the halves. Newton's steps go from the right end; where
    one leaves the bracket, it is halved instead. A root counts only if the balance holds."""
    with np.errstate(all="ignore"):
        a = dose / 1000 * kf
        ok = (c0 > 0) & (dose > 0) & (kf > 0) & (exponent > 0) & np.isfinite(c0 * a * exponent)
        c, a, e = (np.where(ok, x, 1.0) for x in (c0, a, exponent))
        high = np.minimum(np.log(c), (np.log(c) - np.log(a)) / e)
        low = np.minimum(np.log(c / 2), (np.log(c / 2) - np.log(a)) / e)
        t = high.copy()
        for _ in range(STEPS):
            x, took = np.exp(t), a * np.exp(t * e)
            f = np.log((x + took) / c)
            high, low = np.where(f >= 0, t, high), np.where(f < 0, t, low)
            step = t - f * (x + took) / (x + e * took)
            step = np.where((step >= low) & (step <= high), step, (low + high) / 2)
            if (np.abs(step - t) <= 1e-16 * np.abs(t)).all():
                break
            t = step
        x = np.minimum(np.exp(t), c)
        off = np.abs(x + a * np.power(x, e) - c)
    return np.where(ok & (x > 0) & (off <= 1e3 * BALANCE * np.maximum(c, 1e-300)), x, np.nan)


@F.pandas_udf(T.DoubleType())
def _freundlich(c0: pd.Series, dose: pd.Series, kf: pd.Series, exponent: pd.Series) -> pd.Series:
    root = freundlich_root(*(x.to_numpy(float, na_value=np.nan) for x in (c0, dose, kf, exponent)))
    return pd.Series(root).astype(object).where(~np.isnan(root), None)


def ce_freundlich(c0: Column, dose: Column, kf: Column, exponent: Column) -> Column:
    """Root of Ce + (D/1000) kf Ce^exponent = C0 in (0, C0]; it is C0 itself where what is taken up is below C0's last
    digit. Null where the balance is not met to a billionth of C0. Over arrays, as the search has no closed form."""
    return _freundlich(*(x.cast("double") for x in (c0, dose, kf, exponent)))


def kd_at(ces: Sequence[float], qm: Column, kl: Column) -> dict[str, Column]:
    """Kd of the Langmuir curve at benchmark concentrations."""
    return {f"kd_at_{c:g}": F.when((qm > 0) & (kl > 0), q_langmuir(F.lit(c), qm, kl) / c) for c in ces}


def risk(ce: Column, c0: Column) -> Column:
    """The one reason, first of three, why an endpoint is risky; null if none."""
    removal = 1 - F.try_divide(ce, c0)
    return F.when(ce <= FLOOR, "Ce <= 10 ng/L").when(removal >= 1 - STEP, "apparent removal >= 99%").when(removal <= STEP, "apparent removal <= 1%")


def candidate(source: str, rank: int, fitted: bool, kd: Column, ce: Column, c0: Column, r2: Column, risks: Sequence[Column]) -> Column:
    """A complete bundle as a struct, null if incomplete: 0 < Ce < C0, Kd > 0, R2 good enough for fits."""
    ok = (kd > 0) & (ce > 0) & (ce < c0)
    ok = ok & (r2 >= FIT_R2) if fitted else ok
    n = sum((F.coalesce(r, F.lit(False)).cast("int") for r in risks), F.lit(0))
    return F.when(ok, F.struct(n.alias("risks"), F.lit(int(fitted)).alias("fitted"), F.lit(rank).alias("rank"), F.lit(source).alias("source"), kd.alias("kd"), ce.alias("ce"), r2.cast("double").alias("r2")))


def select_candidate(candidates: Sequence[Column]) -> Column:
    """The bundle of least risk: fewest risk reasons, direct before fitted, then by rank. Among fits whose R2 is within
    the band of the best one rank decides, else R2.

    Pass columns that are there already (not expressions): each is looked at several times. Structs are compared
    field by field, so all of it is generated code."""
    def of(f, cs: Sequence[Column]) -> Column:
        return f(*cs) if len(cs) > 1 else cs[0]

    least = of(F.least, [F.when(c.isNotNull(), F.struct(c["risks"].alias("a"), c["fitted"].alias("b"))) for c in candidates])
    same = [(c["risks"] == least["a"]) & (c["fitted"] == least["b"]) for c in candidates]
    best = of(F.greatest, [F.when(s, c["r2"]) for c, s in zip(candidates, same)])
    near = [F.when(s & ((least["b"] == 0) | (best - c["r2"] <= R2_BAND)), F.struct(c["rank"].alias("o"), c.alias("c"))) for c, s in zip(candidates, same)]
    return of(F.least, near)["c"]


def unstable(f: Column, up: bool) -> Column:
    """Whether one percent of removal more (or less) moves log10 Kd by more than the limit; null where f is not usable."""
    g = F.when((f > 0) & (f < 1), f + (STEP if up else -STEP))
    odds = lambda x: log10(F.when(x < 1, x / (1 - x)))
    return F.when((f > 0) & (f < 1), F.coalesce(F.abs(odds(g) - odds(f)) > UNSTABLE, F.lit(True)))


def unstable_freundlich(f: Column, exponent: Column) -> tuple[Column, Column]:
    """(spike, dip) of Kd = KF Ce^(exponent - 1): one percent of removal more moves log10 Kd by more than the limit. An
    exponent below 1 gives spikes, above 1 dips; without a usable exponent there are neither."""
    usable = (exponent > 0) & (exponent != 1)
    inside = (f >= 0) & (f < 1 - STEP)
    moved = F.abs((1 - exponent) * F.log10(F.when(inside, (1 - f) / (1 - f - STEP)))) > UNSTABLE
    bad = F.when(f + STEP >= 1, True).when(inside, moved).otherwise(False)
    return F.coalesce(usable & (exponent < 1) & bad, F.lit(False)), F.coalesce(usable & (exponent > 1) & bad, F.lit(False))


def block_reasons(conditions: dict[str, Column]) -> Column:
    """Labels of the conditions that hold, in order; an empty array means ready."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), label) for label, c in conditions.items()]))


def record_status(review: Column, computable: Column) -> Column:
    return F.when(F.coalesce(review, F.lit(False)), "review_required").when(~F.coalesce(computable, F.lit(False)), "not_computable").otherwise("clean")


def reference_dose(df: DataFrame, c0: str, dose: str, logkd: str, source: str, langmuir: tuple[str, str, str], freundlich: tuple[str, str, str]) -> DataFrame:
    """Adds ref_logkd, ref_basis, ref_exact, ref_dose: an isotherm at the reference dose if its R2 is good enough (that of
    the final source first, else the better fit, Langmuir on a tie), else the observation if its dose is near."""
    qm, kl, r2l = (F.col(c) for c in langmuir)
    kf, ex, r2f = (F.col(c) for c in freundlich)
    d, start = F.lit(DOSE), F.col(c0)
    df = with_langmuir(df, "__ce_l", start, d, qm, kl).withColumn("__ce_f", ce_freundlich(start, d, kf, ex))  # each is computed once
    ce_l, ce_f = F.col("__ce_l"), F.col("__ce_f")
    fit = lambda name, ce, q, r2: F.when((r2 >= FIT_R2) & (ce > 0) & (ce <= start), F.struct(F.lit(name).alias("basis"), log10(q / ce).alias("logkd"), r2.alias("r2"), ce.alias("ce")))
    l, f = fit("Langmuir", ce_l, q_langmuir(ce_l, qm, kl), r2l), fit("Freundlich", ce_f, kf * F.pow(ce_f, ex), r2f)
    df = df.withColumns({"__l": l, "__f": f})
    l, f = F.col("__l"), F.col("__f")
    own = F.when((F.col(source) == "Langmuir") & l.isNotNull(), l).when((F.col(source) == "Freundlich") & f.isNotNull(), f)
    best = F.coalesce(own, F.when(l.isNotNull() & (f.isNull() | (l["r2"] >= f["r2"])), l), f)
    near = F.abs(F.col(dose) - DOSE) <= DOSE_TOLERANCE
    seen = best.isNull() & F.coalesce(near, F.lit(False)) & F.col(logkd).isNotNull()
    out = df.withColumn("__best", best).withColumn("__seen", seen)
    return out.withColumns({
        "ref_logkd": F.coalesce(F.col("__best.logkd"), F.when(F.col("__seen"), F.col(logkd))), "ref_ce": F.col("__best.ce"),
        "ref_basis": F.coalesce(F.col("__best.basis"), F.when(F.col("__seen"), "observed_dose_within_tolerance")),
        "ref_exact": F.when(F.col("__best").isNotNull(), True).when(F.col("__seen"), F.col(dose) == DOSE),
        "ref_dose": F.when(F.col("__best").isNotNull(), DOSE).when(F.col("__seen"), F.col(dose)),
    }).drop("__best", "__seen", "__l", "__f", "__ce_l", "__ce_f").where("ref_basis is not null")


def ionic_strength(df: DataFrame, keys: Sequence[str], species: str, ions: DataFrame, reported: str) -> DataFrame:
    """Half the sum of c z^2 over an array of (ion, mol/L), with the charge balance; a reported value wins, and a
    difference of over 5 percent is noted. Unknown ions leave the computed value null."""
    e = df.select(*keys, F.explode(species).alias("s")).select(*keys, F.col("s.ion").alias("ion"), F.col("s.c").alias("c")).join(ions, "ion", "left")
    unknown = F.bool_or(F.col("z").isNull() | F.col("c").isNull())
    agg = e.groupBy(*keys).agg(F.when(~unknown, F.sum(F.col("c") * F.col("z") * F.col("z")) / 2).alias("computed"), F.when(~unknown, F.sum(F.col("c") * F.col("z"))).alias("balance"))
    out = df.join(agg, list(keys), "left")
    off = F.abs(F.col("computed") - F.col(reported)) > 0.05 * F.abs(F.col(reported))
    return out.withColumns({"strength": F.coalesce(reported, "computed"), "note": F.when(off, "reported and computed differ")})
