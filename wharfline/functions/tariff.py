"""Contract pricing: weight-break linehaul, truckload miles and fuel surcharges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import cents

#: fixed values: lower weight bounds of the breaks and the columns that hold their rates
BREAKS = ((0, "cwt_0_499"), (500, "cwt_500_999"), (1000, "cwt_1000_1999"), (2000, "cwt_2000_4999"), (5000, "cwt_5000_7500"))
EARTH_MILES = 3958.8


def ship_week(d: Column) -> Column:
    """The Monday on or before a date."""
    return F.date_trunc("week", d).cast("date")


def ltl_linehaul(weight: Column, prefix: str = "") -> Column:
    """Less-than-truckload linehaul of a rate row: the break's rate per hundredweight, or with deficit rating any heavier break at its minimum weight if cheaper; at least the minimum charge."""
    col = lambda c: F.col(prefix + c)
    w = weight.cast("decimal(12,4)")
    hundred = F.lit("0.01").cast("decimal(4,2)")
    plain, best = None, None
    for low, name in BREAKS:
        at_weight = col(name) * w * hundred
        plain = at_weight if plain is None else F.when(w >= low, at_weight).otherwise(plain)
    for low, name in BREAKS[1:]:
        as_heavier = F.when(w < low, col(name) * F.lit(low).cast("decimal(12,4)") * hundred)
        best = as_heavier if best is None else F.least(best, as_heavier)
    rated = F.when(col("deficit_weight_rating"), F.least(plain, best)).otherwise(plain)
    return cents(F.greatest(rated, col("min_charge")))


def tl_linehaul(miles: Column, prefix: str = "") -> Column:
    return cents(F.greatest(F.col(prefix + "rate_per_mile") * miles, F.col(prefix + "min_charge")))


def linehaul(mode: Column, weight: Column, miles: Column, prefix: str = "") -> Column:
    return F.when(mode == "LTL", ltl_linehaul(weight, prefix)).otherwise(tl_linehaul(miles, prefix))


def ltl_fuel_pct(price: Column, base: str = "1.20", step: str = "0.10", per_step: str = "0.009") -> Column:
    """Percentage of linehaul: so much for every full step of the diesel price above the base."""
    steps = F.floor((price.cast("decimal(10,3)") - F.lit(base).cast("decimal(10,3)")) / F.lit(step).cast("decimal(10,3)"))
    return (F.greatest(steps, F.lit(0)) * F.lit(per_step).cast("decimal(8,6)")).cast("decimal(12,6)")


def ltl_fuel(lh: Column, price: Column, **table) -> Column:
    return cents(lh * ltl_fuel_pct(price, **table))


def tl_fuel(miles: Column, price: Column, peg: str = "1.25", mpg: str = "6.0") -> Column:
    """Dollars for the miles at the diesel price above the peg and so many miles per gallon."""
    over = F.greatest(price.cast("decimal(10,3)") - F.lit(peg).cast("decimal(10,3)"), F.lit(0).cast("decimal(10,3)"))
    return cents(over * miles.cast("decimal(12,0)") / F.lit(mpg).cast("decimal(6,2)"))


def fuel(mode: Column, lh: Column, miles: Column, price: Column) -> Column:
    return F.when(mode == "LTL", ltl_fuel(lh, price)).otherwise(tl_fuel(miles, price))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column, circuity: float = 1.2) -> Column:
    """Road miles: great-circle distance times a circuity factor, rounded to whole miles."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(2 * EARTH_MILES * F.asin(F.sqrt(half)) * circuity, 0).cast("int")
