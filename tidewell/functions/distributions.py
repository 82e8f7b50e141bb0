"""Tail probabilities as column expressions: no Python runs on executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of Stirling's series for log gamma, and by how much its argument is raised before.
STIRLING, RAISED = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 5 / 5940), 8
#: Terms of the continued fraction of the incomplete beta function.
TERMS = 160
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function of a positive number: Stirling's series at x + RAISED, brought back by the recurrence."""
    z = x + RAISED
    series = sum((F.lit(c) / F.pow(z, F.lit(2 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
    product = x
    for i in range(1, RAISED):
        product = product * (x + i)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's steps, folded over the term numbers."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(s: Column, term: Column) -> Column:
        # applied to a one-element array, so that a state is one value and its columns are not repeated in the next expression
        c, d = safe(1 + term / s["c"]), 1 / safe(1 + term * s["d"])
        return F.get(F.transform(F.array(F.struct(c.alias("c"), d.alias("d"), s["h"].alias("g"))), lambda r: state(r["c"], r["d"], r["g"] * r["c"] * r["d"])), 0)

    def step(s: Column, i: Column) -> Column:
        odd = (i % 2) == 1
        m = F.floor(i / 2).cast("double")
        even_term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd_term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(s, F.when(odd, odd_term).otherwise(even_term))

    one = F.lit(1.0)
    first = state(one, 1 / safe(1 - (a + b) * x / (a + 1)), 1 / safe(1 - (a + b) * x / (a + 1)))
    return F.aggregate(F.sequence(F.lit(2), F.lit(TERMS)), first, step)["h"]


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function; null outside of 0 <= x <= 1 and a, b > 0."""
    x, a, b = (c.cast("double") for c in (x, a, b))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    left = x < (a + 1) / (a + b + 2)
    inner = F.when(left, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when((a > 0) & (b > 0), F.when(x == 0, 0.0).when(x == 1, 1.0).when((x > 0) & (x < 1), inner))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    """P(F >= f); 1 for f of 0 or less, null without degrees of freedom."""
    d1, d2 = df1.cast("double"), df2.cast("double")
    return F.when(f <= 0, F.when((d1 > 0) & (d2 > 0), 1.0)).otherwise(incomplete_beta(d2 / (d2 + d1 * f), d2 / 2, d1 / 2))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided P(|T| >= |t|)."""
    d = df.cast("double")
    return incomplete_beta(d / (d + t * t), d / 2, F.lit(0.5))


def erf(x: Column) -> Column:
    """Error function: the incomplete gamma function of a half by its series, with whose terms it is exact to 1e-12 for |x| < 4;
    1 beyond 6 and by the complementary fraction between."""
    a = F.least(F.abs(x), F.lit(4.0))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("t"), a.alias("s")),
        lambda s, n: F.get(F.transform(F.array(F.struct((s["t"] * 2 * a * a / (2 * n + 1)).alias("t"), s["s"].alias("s"))), lambda r: F.struct(r["t"].alias("t"), (r["s"] + r["t"]).alias("s"))), 0),
    )["s"]
    near = 2 / math.sqrt(math.pi) * F.exp(-a * a) * terms
    z = F.abs(x)
    far = 1 - F.exp(-z * z) / (math.sqrt(math.pi) * (z + 0.5 / (z + 1 / (z + 1.5 / (z + 2 / z)))))
    return F.signum(x) * F.when(z < 4, near).otherwise(far)


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))
