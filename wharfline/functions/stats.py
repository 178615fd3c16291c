"""Statistics Spark has no function for."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = 64
#: the tail's integral is cut where its integrand has fallen by so many powers of e
FALL = 45.0


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def log_factorial_rest(n: Column) -> Column:
    """log n! less its leading terms (n + 1/2) log n - n + log sqrt(2 pi): the table's exact values for small n, Stirling's series beyond. 0 for n = 0."""
    x = F.greatest(n, F.lit(1.0))
    exact = [0.0, *[math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)]]
    y = 1.0 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * (691 / 360360)))))) / x
    return F.when(n < 16, F.get(F.array(*[F.lit(v) for v in exact]), F.least(n, F.lit(15.0)).cast("int"))).otherwise(series)


def deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x without cancellation near x = mean; x > 0."""
    v = (x - mean) / (x + mean)
    odd = F.lit(0.0)
    for j in range(12, 0, -1):
        odd = (odd + 1.0 / (2 * j + 1)) * v * v
    return F.when(F.abs(v) < 0.1, (x - mean) * v + 2.0 * x * v * odd).otherwise(x * F.log(x / mean) + mean - x)


def upper_tail(e: Column) -> Column:
    """P(X >= k) of the struct (k, n, p, q = 1 - p) for 0 < k <= n and k above the mean (or hardly below): probability of k times an integral.

    The tail is the incomplete beta integral up to p of t^(k-1) (1-t)^(n-k), relative to its value at p; it is taken by Gauss-Legendre nodes from p down to where the integrand has
    fallen by FALL powers of e. The work does not depend on n.
    """
    k, n, p, q = (e[c] for c in ("k", "n", "p", "q"))
    m = n - k
    log_pmf = log_factorial_rest(n) - log_factorial_rest(k) - log_factorial_rest(m) - deviance(k, n * p) - F.when(m > 0, deviance(m, n * q)).otherwise(n * q) + F.when(m > 0, 0.5 * F.log(n / (2 * math.pi * k * m))).otherwise(0.0)
    log_pmf = F.when(m > 0, log_pmf).otherwise(n * F.log(p))
    drop = lambda u: (k - 1) * F.log1p(-u / p) + m * F.log1p(u / q)
    # by halves: the distance below p at which the integrand has fallen
    halves = F.aggregate(
        F.array(*[F.lit(0.5**i) for i in range(1, 61)]), F.lit(0.0), lambda at, step: F.when((k > 1) & (drop((at + step) * p) < -FALL), at).otherwise(at + step)
    )
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    points = F.array(*[F.struct(F.lit(float((1 + x) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(nodes, weights)])
    integral = bind(halves * p, lambda span: span * F.aggregate(points, F.lit(0.0), lambda total, z: total + z["w"] * F.exp(drop(z["x"] * span))))
    return F.exp(log_pmf + F.log(k / p) + F.log(integral))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p) in a fixed number of steps, to about 1e-10 of its value (down to 1e-300), for n up to 1e9 and beyond.

    k <= 0 gives 1, k > n gives 0, p of 0 or 1 the limits; nulls give null. Below the mean the other tail is taken from 1.
    """
    d = lambda c: c.cast("double")
    env = F.struct(d(k).alias("k"), d(n).alias("n"), d(p).alias("p"))

    def tail(e: Column) -> Column:
        k, n, p = e["k"], e["n"], e["p"]
        low = k < n * p
        side = F.when(low, F.struct((n - k + 1).alias("k"), n.alias("n"), (1 - p).alias("p"), p.alias("q"))).otherwise(F.struct(k.alias("k"), n.alias("n"), p.alias("p"), (1 - p).alias("q")))
        inside = bind(side, lambda s: F.least(upper_tail(s), F.lit(1.0)))
        return F.when(k <= 0, 1.0).when(k > n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0).when(low, 1 - inside).when(k.isNotNull() & n.isNotNull() & p.isNotNull(), inside)

    return bind(env, tail)
