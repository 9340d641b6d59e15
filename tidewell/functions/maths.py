"""Numeric column functions of the scoring pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column, digits: int = 0) -> Column:
    """Round with halves towards positive infinity: floor(x * 10^digits + 0.5) / 10^digits."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5).cast("double") / scale


def probit(p: Column) -> Column:
    """Inverse of the normal distribution by Acklam's rational approximations; p is clamped to 1e-6 from 0 and 1."""
    # fixed values
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
    edge = 0.02425

    def horner(coefficients: list[float], x: Column) -> Column:
        out: Column = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    p = clamp(p, 1e-6, 1 - 1e-6)
    q = p - 0.5
    middle = horner(a, q * q) * q / (horner(b, q * q) * (q * q) + 1)

    def tail(x: Column) -> Column:
        t = F.sqrt(-2 * F.log(x))
        return horner(c, t) / (horner(d, t) * t + 1)

    return F.when(p < edge, tail(p)).when(p > 1 - edge, -tail(1 - p)).otherwise(middle)


def bayes_weight(n: Column, prior: float) -> Column:
    return n / (n + prior)


def gravity(score: Column, age_hours: Column, power: float = 1.8) -> Column:
    return score / F.pow(age_hours + 2, F.lit(power))


def half_life(age: Column, hours: float) -> Column:
    return F.pow(F.lit(0.5), age / hours)


def shrunk_rate(hits: Column, trials: Column, base: Column, weight: float) -> Column:
    return (hits + base * weight) / (trials + weight)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def utf16_units(text: Column) -> Column:
    """The 16-bit units of a string, as array<bigint>; characters beyond the first plane are two."""
    hexed = F.hex(F.encode(text, "UTF-16BE"))
    return F.when(F.length(hexed) > 0, F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(4)), lambda i: F.conv(F.substring(hexed, i, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


_MASK = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a string, as long."""
    return F.aggregate(utf16_units(text), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(_MASK)))


def times31(text: Column, seed: int = 0) -> Column:
    """The 31-multiplier string hash over UTF-16 units, begun from ``seed``, mod 2^32, as long."""
    return F.aggregate(utf16_units(text), F.lit(seed).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(_MASK)))


def signed31(text: Column) -> Column:
    """The 31-multiplier hash in signed 32-bit arithmetic, without its sign."""
    h = times31(text)
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))
