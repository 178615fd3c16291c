"""Effective-dated lookups, as-of existence, spines and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tariff import ship_week
from .ordered import last_known


def effective(left: DataFrame, card: DataFrame, keys: list[str], on: str, start: str = "effective_from", end: str = "effective_to", how: str = "left") -> DataFrame:
    """Rows of ``left`` with the rows of ``card`` in force on their date: an equi join on the keys with the interval as residual.

    The keys make it a hash or merge join; Catalyst broadcasts the card only below its size threshold.
    """
    c = card.alias("card")
    cond = (F.col(on) >= F.col(f"card.{start}")) & (F.col(on) <= F.col(f"card.{end}"))
    for k in keys:
        cond = cond & (left[k] == F.col(f"card.{k}"))
    return left.join(c, cond, how).select(left["*"], *[F.col(f"card.{x}") for x in card.columns if x not in (*keys, *left.columns)])


def card_problems(left: DataFrame, card: DataFrame, keys: list[str], on: str) -> DataFrame:
    """The key-date pairs of ``left`` that do not have exactly one row in force, with how many they have."""
    pairs = left.select(*keys, on).distinct()
    hits = effective(pairs, card.select(*keys, "effective_from", "effective_to"), keys, on)
    return hits.groupBy(*keys, on).agg(F.count("effective_from").alias("rows_in_force")).filter("rows_in_force != 1")


def with_diesel(df: DataFrame, diesel: DataFrame, on: str = "ship_date") -> DataFrame:
    """The ship week's Monday and its diesel price; null where the index lacks the week."""
    d = diesel.select(F.col("week_start").alias("diesel_week"), F.col("price_per_gallon").alias("diesel_price"))
    return df.withColumn("diesel_week", ship_week(F.col(on))).join(d, "diesel_week", "left")


def pricing_problems(shipments: DataFrame, card: DataFrame, diesel: DataFrame) -> DataFrame:
    """What keeps shipments from being priced: problem, key, n. A carrier, lane and date must have exactly one rate in force, a ship week a diesel price."""
    rates = card_problems(shipments, card, ["carrier_id", "lane_id"], "ship_date").select(F.lit("rates in force").alias("problem"), F.concat_ws(" ", "carrier_id", "lane_id", F.col("ship_date").cast("string")).alias("key"), F.col("rows_in_force").alias("n"))
    weeks = with_diesel(shipments.select("ship_date").distinct(), diesel).filter("diesel_price is null").select(F.lit("diesel price").alias("problem"), F.col("diesel_week").cast("string").alias("key"), F.lit(0).cast("long").alias("n"))
    return rates.unionByName(weeks.distinct())


def require_priced(shipments: DataFrame, card: DataFrame, diesel: DataFrame) -> None:
    """Stop before anything is audited on prices that are missing or not unique."""
    found = pricing_problems(shipments, card, diesel).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem} for {r.key}: {r.n}" for r in found))


def earliest_as_of(rows: DataFrame, events: DataFrame, keys: list[str], row_id: list[str], as_of: str, at: str, name: str) -> DataFrame:
    """``rows`` with the earliest event of equal keys recorded on or before the row's own as-of date, null if none.

    One equi join; the as-of condition sits in the aggregate, so each row keeps its own date. ``row_id`` identifies rows.
    """
    e = events.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("_at"))
    cond = None
    for k in keys:
        part = rows[k] == F.col(f"_{k}")
        cond = part if cond is None else cond & part
    hit = rows.select(*row_id, *[k for k in keys if k not in row_id], as_of).join(e, cond, "inner").filter(F.col("_at") <= F.col(as_of))
    return rows.join(hit.groupBy(*row_id).agg(F.min("_at").alias(name)), row_id, "left")


def month_ends(spark, start, months: int) -> DataFrame:
    """The last day of each of so many months from ``start``."""
    return spark.range(months).select(F.last_day(F.add_months(F.lit(start).cast("date"), F.col("id").cast("int"))).alias("month_end"))


def forward_fill(spine: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Each spine date with the value of the latest date at or before it."""
    d = spine.join(values, key, "left").withColumnRenamed(value, "_given")
    return last_known(d, "_given", value, [key]).select(key, value, *[c for c in values.columns if c not in (key, value)])


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int, group: list[str] | None = None) -> DataFrame:
    """Whole shares of ``total`` in proportion to the weights: floors, and one more for the largest remainders (ties by key)."""
    g = group or []
    whole = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    share = F.col(weight).cast("double") * F.lit(total) / F.sum(F.col(weight).cast("double")).over(whole)
    d = weights.withColumn("_share", F.round(share, 9)).withColumn("_floor", F.floor("_share"))
    d = d.withColumn("_rank", F.row_number().over(whole.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), key))).withColumn("_left", F.lit(total) - F.sum("_floor").over(whole))
    return d.select(*g, key, (F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("n"))
