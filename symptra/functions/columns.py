"""Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BANDS

# Rational approximation of the normal upper tail on |x| < 7.07
# (Hart 1968, as tabulated by West 2005), highest power first.
NORMAL_NUM = [
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
NORMAL_DEN = [
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
NORMAL_SPLIT = 7.07106781186547


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _poly(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_logit(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def lognormal_density(x: Column | str, mu: Column | str, sigma: Column | str) -> Column:
    """Lognormal density; zero at and below x = 0."""
    x, mu, sigma = _col(x).cast("double"), _col(mu), _col(sigma)
    z = (F.ln(x) - mu) / sigma
    return F.when(x <= 0, F.lit(0.0)).otherwise(
        F.exp(z * z * F.lit(-0.5)) / (x * sigma * F.lit(math.sqrt(2 * math.pi)))
    )


def normal_cdf(x: Column | str) -> Column:
    """Standard normal CDF to about 1e-15."""
    x = _col(x)
    a = F.abs(x)
    e = F.exp(a * a * F.lit(-0.5))
    near = e * _poly(NORMAL_NUM, a) / _poly(NORMAL_DEN, a)
    frac = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = a + F.lit(k) / frac
    far = e / frac / F.lit(2.506628274631)
    tail = F.when(a > 37, F.lit(0.0)).when(a < NORMAL_SPLIT, near).otherwise(far)
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def strict(agg, c: Column | str) -> Column:
    """``agg(c)``, but NULL as soon as one value of the group is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def strict_sum(c: Column | str) -> Column:
    return strict(F.sum, c)


def bands(value: Column | str, prefix: str = "pi_", probs: dict[str, float] = BANDS) -> Column:
    """One exact-percentile aggregate for all probabilities: a single sort per
    group. Split it with :func:`unpack_bands`."""
    return F.percentile(_col(value), F.array(*[F.lit(p) for p in probs.values()])).alias(f"_{prefix}")


def unpack_bands(prefix: str = "pi_", probs: dict[str, float] = BANDS) -> list[Column]:
    return [F.col(f"_{prefix}")[i].alias(f"{prefix}{k}") for i, k in enumerate(probs)]


def _round_significant(x: Column, digits: int) -> Column:
    e = F.floor(F.log10(F.abs(x))).cast("int") - (digits - 1)
    up = F.pow(F.lit(10.0), F.abs(e))
    return F.when(x == 0, F.lit(0.0)).when(e < 0, F.round(x * up) / up).otherwise(F.round(x / up) * up)


def format_significant(x: Column | str, digits: int, pad: bool = True) -> Column:
    """Fixed-notation text with ``digits`` significant digits, trailing zeros
    kept when ``pad``; a bare final dot is never printed."""
    v = _round_significant(_col(x).cast("double"), digits)
    places = F.when(v == 0, F.lit(digits - 1)).otherwise(
        F.greatest(F.lit(digits - 1) - F.floor(F.log10(F.abs(v))).cast("int"), F.lit(0))
    )
    text = _format_fixed(v, places)
    if not pad:
        text = F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return text


def _format_fixed(v: Column, places: Column) -> Column:
    pattern = F.concat(F.lit("%."), places.cast("string"), F.lit("f"))
    return F.when(v.isNotNull(), F.call_function("format_string", pattern, v))


def format_interval(
    mid: Column | str, low: Column | str, high: Column | str, digits: int, pad: bool = True
) -> Column:
    """``mid [low, high]`` as text with significant digits."""
    return F.concat(
        format_significant(mid, digits, pad),
        F.lit(" ["),
        format_significant(low, digits, pad),
        F.lit(", "),
        format_significant(high, digits, pad),
        F.lit("]"),
    )


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as floating-point numbers divide: a zero divisor gives plus or
    minus infinity, or NaN for 0 / 0, and never ends the job. Bands leave NaN
    out and keep infinite values as the largest or smallest."""
    a = (F.col(a) if isinstance(a, str) else a).cast("double")
    b = (F.col(b) if isinstance(b, str) else b).cast("double")
    at_zero = (
        F.when(a.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(a) | (a == 0), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(b == 0, at_zero).otherwise(a / b)
