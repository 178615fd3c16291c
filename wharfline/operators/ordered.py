"""Ranks, running values and medians over a global order, by a scan in two levels.

Rows are dealt to sorted range partitions and stored with their places. What a partition adds to the scan (a count, a sum, a last value) is one row per partition and
group; a scan over those rows gives what lies before each partition. No task holds all rows or all rows of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store


def placed(d: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """``d`` by group and order in stored range partitions, with _p, the partition, and _r, the row's place there from 0."""
    keys = [F.col(c) for c in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    stored = store(d.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), "placed")
    # the id's upper bits are the partition, its lower 33 the row's place there
    return stored.withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")


def _group(group: list[str]) -> list[str]:
    return group or []


def _earlier(group: list[str]) -> Window:
    """Over one row per partition and group: those of earlier partitions."""
    return Window.partitionBy(*(group or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)


def _join(rows: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """Null-safe in the group's columns; a partition and group is one range's worth of rows. The parts are stored, as a table whose size is known is broadcast where it is small, and the rows stay in place."""
    b = store(parts, "parts").select(*[F.col(c).alias(f"_k_{c}") for c in ("_p", *group)], *[c for c in parts.columns if c not in ("_p", *group)])
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("_p", *group)])
    return rows.join(b, cond).drop(*[f"_k_{c}" for c in ("_p", *group)])


def indexed(d: DataFrame, group: list[str], order: list[Column | str], name: str = "idx") -> DataFrame:
    """The place of each row in its group, from 0 (the whole table without a group). ``order`` should end in a unique key."""
    rows = placed(d, group, order)
    parts = rows.groupBy("_p", *group).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(group)), F.lit(0))).drop("_n")
    return _join(rows, parts, group).withColumn(name, F.col("_r") - F.col("_first") + F.col("_before")).drop("_p", "_r", "_first", "_before")


def running_total(d: DataFrame, value: str, name: str, order: list[Column | str], group: list[str] | None = None) -> DataFrame:
    """The sum of ``value`` over the rows up to each row, itself included."""
    group = _group(group)
    rows = placed(d, group, order)
    parts = rows.groupBy("_p", *group).agg(F.sum(value).alias("_sum"))
    parts = parts.withColumn("_before", F.sum("_sum").over(_earlier(group))).drop("_sum")
    own = F.sum(value).over(Window.partitionBy("_p", *group).orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = _join(rows.withColumn("_own", own), parts, group)
    return both.withColumn(name, F.coalesce(F.col("_own") + F.col("_before"), F.col("_own"), F.col("_before"))).drop("_p", "_r", "_own", "_before")


def last_known(d: DataFrame, value: str, name: str, order: list[Column | str], group: list[str] | None = None) -> DataFrame:
    """The latest value of the rows up to each row that is not null."""
    group = _group(group)
    rows = placed(d, group, order)
    parts = rows.groupBy("_p", *group).agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col("_r"))).alias("_last"))
    parts = parts.withColumn("_before", F.last("_last", ignorenulls=True).over(_earlier(group))).drop("_last")
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_p", *group).orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _join(rows.withColumn("_own", own), parts, group).withColumn(name, F.coalesce("_own", "_before")).drop("_p", "_r", "_own", "_before")


def medians(d: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """Per group the exact median of ``value`` (the mean of the middle two), null values left out. Groups without values are missing.

    The rows of the middle ranks are selected from the sorted partitions; nothing gathers a group's values.
    """
    rows = indexed(d.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v")), group, ["_v"], "_i")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else rows.agg(F.count(F.lit(1)).alias("_n"))
    half = F.col("_n") - 1
    # the middle ranks as rows, so that the join is by rank too
    middle = sizes.withColumn("_m", F.explode(F.array_distinct(F.array(F.floor(half / 2), F.ceil(half / 2))))).select(*[F.col(c).alias(f"_g_{c}") for c in group], "_m")
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], F.col("_i") == F.col("_m"))
    hit = rows.join(middle, cond)
    return (hit.groupBy(*group) if group else hit.groupBy()).agg(F.avg("_v").alias(name))


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of the edges (a, b; not null). Labels of neighbours and labels of labels, until nothing changes."""
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        one = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = store(one.join(up, "label").select("node", "old", F.least("label", "above").alias("label")), "labels")
        changed = not new.filter("label != old").isEmpty()
        labels = new.drop("old")
        if not changed:
            return labels
