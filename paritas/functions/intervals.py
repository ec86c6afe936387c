"""Rates, intervals and ratios as column expressions over counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-sided 95 % normal quantile and its level.
Z95 = 1.959963984540054
ALPHA95 = math.erfc(Z95 / math.sqrt(2.0))

# A rate is judged only from this many events on.
JUDGED_EVENTS = 100


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """(rate, low, high) of the Wilson score interval; NULL rate and [0, 1] for no trials."""
    k, n = k.cast("double"), n.cast("double")
    rate = F.when(n > 0, k / n)
    z2 = F.lit(z * z)
    spread = F.sqrt(rate * (1.0 - rate) / n + z2 / (4.0 * n * n))
    shrink = 1.0 + z2 / n
    centre = (rate + z2 / (2.0 * n)) / shrink
    half = F.lit(z) * spread / shrink
    low = F.when((n == 0) | (k == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when((n == 0) | (k == n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return rate, low, high


def block_per_cycle(p: Column, rounds: int) -> Column:
    """1 - (1 - p)^(1/rounds), stable for small p; exactly 1 for p = 1."""
    return F.when(p >= 1.0, F.lit(1.0)).otherwise(-F.expm1(F.log1p(-p) / F.lit(float(rounds))))


def per_qubit_per_cycle(p: Column, rounds: int, qubits: int) -> Column:
    """Rate per qubit and cycle; NULL where p >= 1 - 2^-qubits leaves no solution."""
    fidelity = F.when(p < 1.0, 2.0 * F.expm1(F.log1p(-p) / F.lit(float(qubits))))
    return F.when(fidelity > -1.0, -F.expm1(F.log1p(fidelity) / F.lit(float(rounds))) / 2.0)


def katz_ratio(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Ratio (k1/n1)/(k2/n2) of two independent rates with a log-normal interval; NULL when undefined."""
    defined = (k1 > 0) & (k2 > 0)
    ratio = F.when(defined, (k1 / n1) / (k2 / n2))
    error = F.sqrt(1.0 / k1 - 1.0 / n1 + 1.0 / k2 - 1.0 / n2)
    return ratio, ratio * F.exp(-F.lit(z) * error), ratio * F.exp(F.lit(z) * error)


def paired_ratio(n11: Column, n10: Column, n01: Column, z: float = Z95) -> dict[str, Column]:
    """V = (n11 + n01)/(n11 + n10) over paired shots: value, lo, hi, log_se, method.

    log-normal interval in the ordinary case; exact conditional bounds when one arm never fails;
    the zero-event Poisson bound when no discordant pair was seen; undefined without any failure.
    """
    half_level = math.erfc(z / math.sqrt(2.0)) / 2.0
    test, ref, odd = n11 + n01, n11 + n10, n10 + n01
    none = (test == 0) & (ref == 0)
    even, test_clean, ref_clean = odd == 0, test == 0, ref == 0
    unseen = F.lit(-math.log(half_level))
    tail = F.pow(F.lit(half_level), F.lit(1.0) / odd)
    method = (
        F.when(none, F.lit("undefined"))
        .when(even, F.lit("poisson-zero-discordant"))
        .when(test_clean | ref_clean, F.lit("exact-conditional"))
        .otherwise(F.lit("log-normal"))
    )
    value = (
        F.when(none, F.lit(None).cast("double")).when(even, F.lit(1.0)).when(test_clean, F.lit(0.0))
        .when(ref_clean, F.lit(float("inf"))).otherwise(test / ref)
    )
    log_se = F.when(
        ~none & ~even & ~test_clean & ~ref_clean,
        F.sqrt(1.0 / test + 1.0 / ref - 2.0 * n11 / (test * ref)),
    )
    lo = (
        F.when(none | test_clean, F.lit(0.0)).when(even, n11 / (n11 + unseen))
        .when(ref_clean, tail / (1.0 - tail)).otherwise(value * F.exp(-F.lit(z) * log_se))
    )
    hi = (
        F.when(none, F.lit(float("inf"))).when(even, (n11 + unseen) / n11)
        .when(test_clean, (1.0 - tail) / tail).when(ref_clean, F.lit(float("inf")))
        .otherwise(value * F.exp(F.lit(z) * log_se))
    )
    return {"value": value, "lo": lo, "hi": hi, "log_se": log_se, "method": method}
