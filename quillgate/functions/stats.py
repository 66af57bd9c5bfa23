"""Statistics as Column arithmetic."""

from pyspark.sql import functions as F


def _d(c):
    return c.cast("double")


def rate_pct(part, whole, digits=1, half_even=True):
    """Percentage rounded, zero when there is nothing to divide by."""
    value = _d(part) / _d(whole) * F.lit(100.0)
    value = F.bround(value, digits) if half_even else F.round(value, digits)
    return F.when(whole > 0, value).otherwise(F.lit(0.0))


def normal_cdf(x, scaled=False):
    """Polynomial approximation of the standard normal distribution function.

    ``scaled=False`` reproduces the approximation without the 1/sqrt(2) scaling that the
    polynomial's constants need; ``scaled=True`` is the mathematically right form.
    """
    a = F.abs(x)
    u = a / F.lit(2.0 ** 0.5) if scaled else a
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * u)
    poly = F.lit(1.061405429)
    for coefficient in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(coefficient)
    y = F.lit(1.0) - poly * t * F.exp(-a * a / F.lit(2.0))
    sign = F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    value = F.lit(0.5) * (F.lit(1.0) + sign * y)
    return F.when(x < -8, F.lit(0.0)).when(x > 8, F.lit(1.0)).otherwise(value)


def chi_square(success_a, total_a, success_b, total_b):
    """Two-proportion chi-square with the 0.5 continuity correction; null when undefined."""
    sa, na, sb, nb = _d(success_a), _d(total_a), _d(success_b), _d(total_b)
    pooled = (sa + sb) / (na + nb)

    def cell(observed, expected):
        gap = F.greatest(F.abs(observed - expected) - F.lit(0.5), F.lit(0.0))
        return F.when(expected > 0, gap * gap / expected).otherwise(F.lit(0.0))

    chi2 = (
        cell(sa, na * pooled)
        + cell(sb, nb * pooled)
        + cell(na - sa, na * (F.lit(1.0) - pooled))
        + cell(nb - sb, nb * (F.lit(1.0) - pooled))
    )
    defined = (na > 0) & (nb > 0) & (pooled > 0) & (pooled < 1)
    return F.when(defined & (chi2 > 0), chi2)


def p_value(chi2, two_sided=False):
    """p of a one-degree chi-square; 1 where the statistic is undefined."""
    z = F.sqrt(chi2)
    if two_sided:
        p = F.lit(2.0) * normal_cdf(-z, scaled=True)
    else:
        p = normal_cdf(-z)
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.when(chi2.isNull(), F.lit(1.0)).otherwise(p)


def wilson(successes, total, z=1.96):
    """Wilson score interval (low, high); (0, 0) for an empty sample."""
    s, n = _d(successes), _d(total)
    p = s / n
    z2 = F.lit(z * z)
    denom = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / denom
    spread = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + z2 / (F.lit(4.0) * n)) / n) / denom
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - spread)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), centre + spread)).otherwise(F.lit(0.0))
    return low, high


def clamp(c, low, high):
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
