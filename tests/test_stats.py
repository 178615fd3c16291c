"""The binomial tail against exact sums, and at a thousand million trials against long decimals."""

import math
from decimal import Decimal, getcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wharfline.functions.stats import binomial_tail


def exact(k, n, p):
    p = Fraction(p)
    return float(sum(Fraction(math.comb(n, j)) * p**j * (1 - p) ** (n - j) for j in range(max(k, 0), n + 1)))


def long_tail(k, n, p):
    """By the probability of k (Stirling in 60 digits) and the ratios of the terms that follow."""
    getcontext().prec = 60
    p = Decimal(p)

    def log_factorial(x):
        x, out = Decimal(x), Decimal(0)
        while x < 200:
            x += 1
            out -= x.ln()
        pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")
        series = sum(Decimal(b) / (Decimal(2 * j) * (2 * j - 1) * x ** (2 * j - 1)) for j, b in enumerate((Fraction(1, 6), Fraction(-1, 30), Fraction(1, 42), Fraction(-1, 30), Fraction(5, 66)), 1) for b in [Decimal(b.numerator) / b.denominator])
        return out + (x + Decimal("0.5")) * x.ln() - x + (2 * pi).ln() / 2 + series

    term = (log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * p.ln() + (n - k) * (1 - p).ln()).exp()
    total, j = Decimal(0), k
    while term > total * Decimal("1e-20"):
        total += term
        term *= Decimal(n - j) / (j + 1) * p / (1 - p)
        j += 1
    return float(total)


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 2, 5, 17, 60, 400) for k in sorted({0, 1, 2, n // 3, n // 2, n - 1, n, n + 1, -1}) for p in (0.001, 0.03, 0.25, 0.5, 0.9, 0.999)]
    cases += [(3, 10, 0.0), (3, 10, 1.0), (0, 0, 0.5)]
    got = {(r.k, r.n, r.p): r.t for r in spark.createDataFrame(cases, "k int, n int, p double").withColumn("t", binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()}
    for k, n, p in cases:
        assert got[k, n, p] == pytest.approx(exact(k, n, p), rel=1e-10, abs=1e-300), (k, n, p)
    assert spark.range(1).select(binomial_tail(F.lit(None), F.lit(5), F.lit(0.5))).first()[0] is None


def test_binomial_tail_of_many_trials(spark):
    n = 10**9
    cases = [(31_000_000, n, 0.03), (30_010_000, n, 0.03), (30_100_000, n, 0.03), (1200, n, 1e-6), (9, n, 1e-12), (500_090_000, n, 0.5)]
    for (k, n, p), r in zip(cases, spark.createDataFrame(cases, "k long, n long, p double").coalesce(1).withColumn("t", binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()):
        want = long_tail(k, n, p)
        assert r.t == pytest.approx(want, rel=1e-9, abs=1e-300), (k, n, p)
