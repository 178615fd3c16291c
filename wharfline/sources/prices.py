"""The weekly diesel index: published files, and a synthetic bounded walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tariff import ship_week
from ..operators.temporal import forward_fill

#: fixed values: date formats of published price files; days and months may have one digit
FORMATS = ("MMM d, yyyy", "M/d/yyyy", "yyyy-M-d", "MMM-d-yyyy", "d-MMM-yyyy", "yyyyMMdd")


def price_series(spark: SparkSession, path: str) -> DataFrame:
    """week_start, price_per_gallon of a file: rows whose first cell is a date and whose second a number (others, such as titles, are skipped).

    Dates move to the Monday on or before; the last row of a week wins. A byte order mark is ignored. A file without any such row is an error.
    A price file is a few hundred lines.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")).alias("i", "line"))
    v = F.from_csv("line", "a string, b string, c string")
    day = F.coalesce(*[F.try_to_timestamp(F.initcap(F.trim(v["a"])), F.lit(f)).cast("date") for f in FORMATS])
    d = lines.select("i", day.alias("day"), F.trim(v["b"]).try_cast("double").cast("decimal(10,3)").alias("price")).filter("day is not null and price is not null")
    if d.isEmpty():
        raise ValueError(f"{path}: no row has a date in its first column and a price in its second")
    return d.groupBy(ship_week(F.col("day")).alias("week_start")).agg(F.max_by("price", "i").alias("price_per_gallon")).orderBy("week_start")


def filled(prices: DataFrame, first, last) -> DataFrame:
    """Every Monday from ``first`` to ``last``; a week without a price has the last one before it, also from before ``first``.

    Raises if the series begins after the span or ends before it.
    """
    edge = prices.agg(F.min("week_start").alias("a"), F.max("week_start").alias("b")).first()
    if edge.a is None or edge.a > first or edge.b < last:
        raise ValueError(f"the price series covers {edge.a} to {edge.b}; {first} to {last} is needed")
    spine = prices.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 7 days"))).alias("week_start"))
    all_weeks = spine.union(prices.filter(F.col("week_start") < F.lit(first)).select("week_start"))
    return forward_fill(all_weeks, prices, "week_start", "price_per_gallon").filter(F.col("week_start") >= F.lit(first))


def bounded_walk(weeks: DataFrame, step: Column, start: float, mean: float, reversion: float, low: float, high: float, extra: Column | None = None, decimals: int = 3) -> DataFrame:
    """week_start, price_per_gallon: a mean-reverting walk over the weeks in order, held within [low, high] at every step.

    Each week moves by ``reversion`` of the way to ``mean`` and by ``step``. ``extra`` (a price shock, for instance) comes on top of the walk
    without being fed into it. The recurrence is a fold over the array of steps: one row a week.
    """
    d = weeks.select("week_start", step.alias("step"), (F.lit(0.0) if extra is None else extra).cast("double").alias("extra"))
    one = d.agg(F.array_sort(F.collect_list(F.struct("week_start", "step", "extra"))).alias("w"))
    bound = lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))

    def move(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        return F.concat(done, F.array(bound(last + F.lit(float(reversion)) * (F.lit(float(mean)) - last) + w["step"])))

    walk = F.aggregate(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit(float(start))), move)
    rows = one.filter(F.size("w") > 0).select(F.inline(F.arrays_zip("w", walk.alias("p"))))
    return rows.select(F.col("w.week_start").alias("week_start"), F.round(bound(F.col("p") + F.col("w.extra")), decimals).alias("price_per_gallon"))


def shock(week: Column, begins, rise: float, weeks_up: int, weeks_down: int) -> Column:
    """A linear rise from the first Monday on or after ``begins``, then a linear fall back to nothing."""
    first = F.lit(begins).cast("date")
    monday = F.when(ship_week(first) < first, F.date_add(ship_week(first), 7)).otherwise(ship_week(first))
    j = F.floor(F.datediff(week, monday) / 7)
    return F.when((j >= 0) & (j <= weeks_up), F.lit(float(rise)) * j / weeks_up).when((j > weeks_up) & (j <= weeks_up + weeks_down), F.lit(float(rise)) * (1 - (j - weeks_up) / weeks_down)).otherwise(F.lit(0.0))
