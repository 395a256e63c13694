"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rounded_down(size: Column) -> tuple[Column, Column]:
    """Whether a positive double lies below, or is, the middle of two numbers of six digits of which the lower is nearer
    or even; and those six digits. ``%.5e`` rounds the shortest decimal half up, which is wrong in just these cases.

    The shortest decimal then has seven digits, the last a 5: N / 10**k. It is the double itself if 5**k divides N;
    else the rounding error of size * 10**k, from products of half-width parts, tells on which side of N it lies.
    """
    seven = F.format_string("%.6e", size)
    n = F.concat(F.substring(seven, 1, 1), F.substring(seven, 3, 6)).try_cast("long")
    k = 6 - F.substring_index(seven, "e", -1).try_cast("int")
    between = (n % 10 == 5) & (seven.try_cast("double") == size) & (k <= 22)
    fives = F.element_at(F.array(*[F.lit(5**i) for i in range(12)]), F.greatest(F.least(k, F.lit(11)), F.lit(0)) + 1)
    tens = F.element_at(F.array(*[F.lit(float(10**i)) for i in range(23)]), F.greatest(F.least(k, F.lit(22)), F.lit(0)) + 1)

    def halves(v: Column) -> tuple[Column, Column]:
        c = v * 134217729.0
        high = c - (c - v)
        return high, v - high

    product, (a, b), (c, d) = size * tens, halves(size), halves(tens)
    error = ((a * c - product) + a * d + b * c) + b * d
    below = (product < n) | ((product == n) & (error < 0))
    six = F.floor(n / 10)
    return between & F.when(n % fives == 0, six % 2 == 0).otherwise(below), six.cast("string")


def general(c: Column) -> Column:
    """A number with six significant digits, in exponents below 1e-4 and from 1e6 on, without trailing zeros; null stays null.

    The double's exact value is rounded, halves to the even digit (below 1e-16 to the higher one).
    """
    x = c.cast("double")
    sci = F.format_string("%.5e", F.abs(x))
    down, lower = _rounded_down(F.abs(x))
    digits = F.when(down, lower).otherwise(F.concat(F.substring(sci, 1, 1), F.substring(sci, 3, 5)))
    e = F.substring_index(F.when(down, F.format_string("%.6e", F.abs(x))).otherwise(sci), "e", -1).try_cast("int")
    tail = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    big = tail(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
    small = tail(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    power = F.concat(tail(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    body = F.when((e < -4) | (e >= 6), power).when(e < 0, small).otherwise(big)
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, "0").when(x.isNotNull(), F.concat(sign, body))
