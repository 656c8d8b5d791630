"""Distribution functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients of the gamma function for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
TERMS = 200


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, to about 1e-14."""
    z = x - 1.0
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + float(k))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction from the last term to the first.

    The fraction converges fast below (a + 1) / (a + b + 2); above, the other tail is taken.
    """
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1.0 - x).otherwise(x)

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (q - m) * y / ((p + 2.0 * m - 1.0) * (p + 2.0 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2.0 * m) * (p + 2.0 * m + 1.0))
        return F.when(k % 2 == 0, even).otherwise(odd)

    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda v, k: 1.0 + term(k) / v)
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + p * F.ln(y) + q * F.ln(1.0 - y)) / p
    tail = F.when(y <= 0, 0.0).otherwise(front / fraction)
    return F.when(swap, 1.0 - tail).otherwise(tail)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; NULL without a degree of freedom."""
    n = df.cast("double")
    return F.when(n > 0, incomplete_beta(n / 2.0, F.lit(0.5), n / (n + t * t)))
