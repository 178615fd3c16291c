"""Which invoice bills which shipment, and which invoice replaces which."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Tolerances
from ..session import at_home, come_home, settle, united
from .books import ids
from .ordered import connected


def match_shipments(invoices: DataFrame, shipments: DataFrame, lanes: DataFrame | None, tol: Tolerances) -> DataFrame:
    """shipment_id and match_method (exact, fallback, unmatched).

    Exact is carrier and canonical BOL. The rest may match by carrier, origin and destination with the ship date within
    ``fallback_days`` and the weight within ``fallback_weight_pct`` of the shipment's, if exactly one shipment fits. Without
    lanes there is no fallback. The lowest shipment id wins where a BOL repeats.
    """
    out = exact_match(invoices.drop("shipment_id", "match_method"), shipments.select("shipment_id", "carrier_id", F.col("bol").alias("bol_canonical")), "bol_canonical", "_exact")
    fallback = F.lit(None).cast("string")
    if lanes is not None:
        what = ["carrier_id", "origin", "destination", "ship_date", "billed_weight_lbs"]
        at = ["home", *what] if "home" in out.columns else ["invoice_id"]  # invoices of one home that ask the same ask once
        rest = out.filter("_exact is null").select(*dict.fromkeys([*at, *what]))
        out, fallback = out.join(only_fit(rest.distinct() if "home" in at else rest, at, shipments, lanes, tol), at, "left"), F.col("_fallback")
    method = F.when(F.col("_exact").isNotNull(), "exact").when(fallback.isNotNull(), "fallback").otherwise("unmatched")
    return out.withColumn("shipment_id", F.coalesce("_exact", fallback)).withColumn("match_method", method).drop("_exact", "_fallback")


def exact_match(invoices: DataFrame, shipments: DataFrame, bol: str, name: str) -> DataFrame:
    """``name``: the lowest id of the shipments with an invoice's carrier and ``bol``.

    Invoices with a home mostly match the shipment of that id, which lies there. The others meet all shipments, by their distinct keys; and so do all if several shipments share a key.
    """
    keys = ["carrier_id", bol]
    if "home" not in invoices.columns or not spread(shipments, keys, "shipment_id")[0]:
        return invoices.join(shipments.groupBy(*keys).agg(F.min("shipment_id").alias(name)), keys, "left")
    here = shipments.withColumnRenamed("shipment_id", "home").groupBy("home").agg(F.collect_set(F.struct(*keys)).alias("_keys"))
    near = F.col("carrier_id").isNotNull() & F.col(bol).isNotNull() & F.array_contains("_keys", F.struct(*keys))
    d = invoices.join(here, "home", "left").withColumn("_near", F.when(near, F.col("home"))).drop("_keys")
    far = d.filter("_near is null").select("home", *keys).distinct().join(shipments.filter("shipment_id is not null").select(*keys, F.col("shipment_id").alias("_far")).distinct(), keys)
    # one row per home, as invoices lie in order of their home and not of these keys; dealt by it at last, so that these few rows go to the invoices and not the invoices to them
    said = F.concat(F.length("carrier_id").cast("string"), F.lit(":"), "carrier_id", bol)
    others = far.groupBy("home").agg(F.map_from_entries(F.collect_list(F.struct(said, "_far"))).alias("_others")).repartition(F.hash("home"))
    return d.join(others, "home", "left").withColumn(name, F.coalesce("_near", F.try_element_at("_others", said))).drop("_near", "_others")


def by_shipment(rows: DataFrame, shipments: list[DataFrame], join: Callable[[DataFrame, list[DataFrame], str], DataFrame]) -> DataFrame:
    """``join`` of rows with tables by shipment_id. Rows whose home is their shipment's id meet them there, by home; the others, if any, by the id, and come home with what they met."""
    if "home" not in rows.columns:
        return join(rows, shipments, "shipment_id")
    near = join(rows.filter("shipment_id = home"), [s.withColumnRenamed("shipment_id", "home") for s in shipments], "home")
    far = rows.filter("shipment_id != home")
    with at_home(rows.sparkSession):
        none = far.isEmpty()
    return near if none else united([near, come_home(join(far, shipments, "shipment_id"), rows)])


def at_shipment(rows: DataFrame) -> bool:
    """Whether every row's home is its shipment's id."""
    with at_home(rows.sparkSession):
        return "home" in rows.columns and rows.filter(~F.col("shipment_id").eqNullSafe(F.col("home"))).isEmpty()


def per_shipment(rows: DataFrame, near: bool, *sums: Column) -> DataFrame:
    """shipment_id and aggregates of the rows of each, made where shipments lie; ``near`` says that all rows are there (see ``at_shipment``)."""
    if "home" not in rows.columns:
        return rows.groupBy("shipment_id").agg(*sums)
    return (rows if near else moved(rows)).groupBy("home").agg(*sums).withColumnRenamed("home", "shipment_id")


def moved(rows: DataFrame) -> DataFrame:
    """The rows with their shipment's id as home: those that lie elsewhere, and they alone, are dealt."""
    there = F.col("shipment_id").eqNullSafe(F.col("home"))
    return united([rows.filter(there), come_home(rows.filter(~there).withColumn("home", F.col("shipment_id")), rows)])


def crossing(rows: DataFrame, key: str, few: int = (1 << 63) - 1) -> tuple[DataFrame | None, bool]:
    """home and key of the groups whose ``key`` (not null) has several homes, stored, or None; and whether some key has more than ``few`` rows in a home. Keys meet by hashes first, as in ``spread``."""
    groups = rows.groupBy("home", key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64(key))
    met = settle(groups.groupBy("_h").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n")).filter((F.col("_k") > 1) | (F.col("_n") > few)), "met")
    doubtful = met.filter("_k > 1")
    found = None
    if not doubtful.isEmpty():
        homes = groups.join(doubtful.select("_h"), "_h").select("home", key).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(key)))
        found = settle(homes.filter("_k > 1").drop("_k"), "crossing")
        found = None if found.isEmpty() else found
    return found, not met.filter(F.col("_n") > few).isEmpty()


def spread(rows: DataFrame, keys: list[str], name: str) -> tuple[bool, int]:
    """Whether no two rows of equal keys have different values of ``name``, and how many rows the largest group of equal keys and value has.

    Groups are counted where they lie and meet by a hash of their keys; only keys whose hashes are equal are compared themselves.
    """
    groups = rows.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64(*keys))
    met = groups.groupBy("_h").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"))
    with at_home(rows.sparkSession):
        seen = met.agg(F.count_if(F.col("_k") > 1).alias("several"), F.max("_n").alias("most")).first()
        if not seen.several:
            return True, seen.most or 0
        doubtful = groups.join(met.filter("_k > 1").select("_h"), "_h")
        return doubtful.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").isEmpty(), seen.most


def only_fit(rest: DataFrame, key: list[str], shipments: DataFrame, lanes: DataFrame, tol: Tolerances) -> DataFrame:
    """The ``key`` of each row of ``rest`` and _fallback: the one shipment of the carrier between the same cities within the band of dates and weights, where there is exactly one.

    Shipments of one lane, day and weight are one point with their number and smallest id. Blocks of days and of logarithmic weights, each twice as wide as a band, are equality keys, so
    that a band reaches into four blocks at most, and an invoice meets the points around its band and not its lane.
    """
    share, days = float(tol.fallback_weight_pct), int(tol.fallback_days)
    low, high = (-math.log1p(share) * (1 + 1e-9), -math.log1p(-share) * (1 + 1e-9)) if 0 < share < 1 else (0.0, 0.0)

    def cell(weight: Column, by: float = 0.0) -> Column:
        if not high:  # a share of 0 means equal weights, one of 1 or more has no lower end
            return (weight.cast("long") if share <= 0 else F.lit(0)).cast("long")
        return F.when(weight > 0, F.floor((F.log(weight.cast("double")) + by) / (2 * (high - low)))).otherwise(F.lit(-(1 << 40))).cast("long")

    def block(day: Column, by: int = 0) -> Column:
        return F.floor((F.unix_date(day) + by) / (4 * max(days, 1)))

    both = lambda a, b: F.explode(F.array_distinct(F.array(a, b)))
    keys = ["carrier_id", "origin", "destination", "block", "cell"]

    ends = lanes.select("lane_id", F.col("origin_city").alias("origin"), F.col("destination_city").alias("destination"))
    points = shipments.join(ends, "lane_id").select("carrier_id", "origin", "destination", block(F.col("ship_date")).alias("block"), cell(F.col("weight_lbs")).alias("cell"), F.col("ship_date").alias("_day"), F.col("weight_lbs").alias("_weight"), "shipment_id")
    points = points.repartition(*keys).groupBy(*keys, "_day", "_weight").agg(F.count(F.lit(1)).alias("_k"), F.min("shipment_id").alias("_id"))
    day, weight = F.col("ship_date"), F.col("billed_weight_lbs")
    asked = rest.withColumn("block", both(block(day, -days), block(day, days))).withColumn("cell", both(cell(weight, low), cell(weight, high)))
    inside = F.col("_day").between(F.date_sub("ship_date", days), F.date_add("ship_date", days)) & (F.abs(weight - F.col("_weight")) <= F.lit(str(tol.fallback_weight_pct)).cast("decimal(8,6)") * F.col("_weight"))
    found = [F.sum("_k").alias("_k"), F.min("_id").alias("_id")]
    fits = asked.join(points, keys).filter(inside).groupBy(*dict.fromkeys([*keys, *key])).agg(*found)  # where they met, then at their homes
    return come_home(fits, rest).groupBy(*key).agg(*found).filter("_k = 1").select(*key, F.col("_id").alias("_fallback"))


def supersede(invoices: DataFrame) -> DataFrame:
    """is_superseded, superseded_on, superseded_by, and for rebills target_id (null where none was found).

    A rebill replaces the latest invoice received on an earlier day, not a balance due and not replaced yet, with the number it
    cites or else with its own base pro number; rebills of a day go in the order of their ids. Per carrier and number, and per carrier and pro number, this is a
    stack: on each day rebills pop first, then that day's invoices are pushed.

    Where no invoice can be popped from both of its stacks, the stacks are apart: running sums give the depth (never below 0), and a pop's partner is the push just
    before it at its depth, so no group is collected. Stacks that share such an invoice (one cited by number and billed again by pro number) are connected, and
    each connected set is folded in order of time with the stacks as state.
    """
    base = invoices.drop("is_superseded", "superseded_on", "superseded_by", "target_id")
    cited = F.nullif(F.col("supersedes_invoice_number"), F.lit(""))
    rebill = F.col("invoice_type") == "rebill"
    if "home" in base.columns and base.filter(rebill & cited.isNotNull()).isEmpty():
        return _at_home(base)
    stack_of = lambda kind, number: F.concat(F.lit(kind), F.length("carrier_id").cast("string"), F.lit(":"), "carrier_id", number)
    event = base.select("carrier_id", "invoice_id", "received_date", rebill.alias("rebill"), (F.col("invoice_type") != "balance_due").alias("pushes"), stack_of("n", F.col("invoice_number")).alias("by_number"), stack_of("p", F.col("pro_number")).alias("by_pro"), F.when(cited.isNotNull(), stack_of("n", cited)).otherwise(stack_of("p", F.col("pro_number"))).alias("pops"), "invoice_number", "pro_number", cited.alias("cited")).filter("received_date is not null")
    pops = event.filter(F.col("rebill") & F.coalesce("cited", "pro_number").isNotNull()).select("carrier_id", F.col("pops").alias("stack"), "invoice_id", "received_date", F.lit(-1).alias("step"))
    push = lambda stack, number: event.filter(F.col("pushes") & F.col(number).isNotNull()).select("carrier_id", F.col(stack).alias("stack"), "invoice_id", "received_date", F.lit(1).alias("step"))
    popped = pops.select("stack").distinct()
    pushes = push("by_number", "invoice_number").unionByName(push("by_pro", "pro_number")).join(popped, "stack", "left_semi")
    events = pops.unionByName(pushes)
    shared = pushes.groupBy("carrier_id", "invoice_id").agg(F.min("stack").alias("a"), F.max("stack").alias("b")).filter("a != b").select("a", "b").distinct()
    links = _apart(events)
    kinds = event.filter("rebill").select(F.col("cited").isNull()).distinct().count()  # only rebills of both kinds can share an invoice
    if kinds == 2 and not shared.isEmpty():
        sets = connected(shared).withColumnRenamed("node", "stack")
        links = _apart(events.join(sets, "stack", "left_anti")).unionByName(_folded(events.join(sets, "stack")))
    hit = links.groupBy("carrier_id", F.col("target_id").alias("invoice_id")).agg(F.min("on").alias("superseded_on"), F.min_by("by", "on").alias("superseded_by"))
    got = links.select("carrier_id", F.col("by").alias("invoice_id"), "target_id")
    out = base.join(hit, ["carrier_id", "invoice_id"], "left").join(got, ["carrier_id", "invoice_id"], "left")
    return out.withColumn("is_superseded", F.col("superseded_on").isNotNull())


def _at_home(base: DataFrame) -> DataFrame:
    """The same where no rebill cites a number, so that all stacks are by pro number and lie at one home: rebills are doubled into pop and push, and the push before a pop and the pop after a push at
    one depth name each other."""
    rebill, dated = F.col("invoice_type") == "rebill", F.col("received_date").isNotNull() & F.col("pro_number").isNotNull()
    some = base.filter(rebill).select("home").distinct()  # the other homes have no links
    events, rest = base.join(some, "home", "left_semi"), base.join(some, "home", "left_anti")
    step = F.when(dated & rebill, F.array(F.lit(-1), F.lit(1))).when(dated & (F.col("invoice_type") != "balance_due"), F.array(F.lit(1))).otherwise(F.array(F.lit(0)))
    order = ["received_date", "_step", "invoice_id"]
    stack = Window.partitionBy("home", "carrier_id", "pro_number", "_out").orderBy(*order)
    running = stack.rowsBetween(Window.unboundedPreceding, 0)
    d = events.withColumn("_step", F.explode(step)).withColumn("_out", F.col("_step") == 0).withColumn("_sum", F.sum("_step").over(running)).withColumn("_low", F.least(F.min("_sum").over(running), F.lit(0)))
    d = d.withColumn("_miss", (F.col("_step") < 0) & (F.col("_sum") == F.col("_low")) & (F.col("_low") < F.coalesce(F.lag("_low").over(stack), F.lit(0))))
    d = d.withColumn("_level", F.when(~F.col("_miss"), F.col("_sum") - F.col("_low") + F.when(F.col("_step") < 0, 1).otherwise(0)))
    level = Window.partitionBy("home", "carrier_id", "pro_number", "_out", "_level").orderBy(*order)
    found = F.col("_level").isNotNull() & ~F.col("_out")
    popped = F.lead("_step").over(level) < 0
    d = d.withColumns({
        "_target": F.when(found & (F.col("_step") < 0), F.lag("invoice_id").over(level)), "superseded_on": F.when(found & (F.col("_step") > 0) & popped, F.lead("received_date").over(level)),
        "superseded_by": F.when(found & (F.col("_step") > 0) & popped, F.lead("invoice_id").over(level)),
    })
    d = d.withColumn("target_id", F.max("_target").over(Window.partitionBy("home", "invoice_id"))).filter("_step >= 0")
    d = d.drop("_step", "_out", "_sum", "_low", "_miss", "_level", "_target")
    rest = rest.withColumns({c: F.lit(None).cast(d.schema[c].dataType) for c in d.columns if c not in rest.columns})
    return united([d, rest]).withColumn("is_superseded", F.col("superseded_on").isNotNull())


def _apart(events: DataFrame) -> DataFrame:
    """carrier_id, by, target_id, on of stacks that share no invoice."""
    stack = Window.partitionBy("stack").orderBy("received_date", "step", "invoice_id")
    running = stack.rowsBetween(Window.unboundedPreceding, 0)
    depth = events.withColumn("sum", F.sum("step").over(running)).withColumn("low", F.least(F.min("sum").over(running), F.lit(0)))
    depth = depth.withColumn("miss", (F.col("step") < 0) & (F.col("sum") == F.col("low")) & (F.col("low") < F.coalesce(F.lag("low").over(stack), F.lit(0))))
    level = depth.filter("not miss").withColumn("level", F.col("sum") - F.col("low") + F.when(F.col("step") < 0, 1).otherwise(0))
    partner = F.lag("invoice_id").over(Window.partitionBy("stack", "level").orderBy("received_date", "step", "invoice_id"))
    return level.withColumn("target_id", partner).filter("step < 0").select("carrier_id", F.col("invoice_id").alias("by"), "target_id", F.col("received_date").alias("on"))


def _folded(events: DataFrame) -> DataFrame:
    """The same of connected stacks (column label): a fold over each set's events in order, whose state is the stacks' invoices that are not replaced yet."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, stacks, gone = None, {}, set()
        for batch in batches:
            by, target, on, carrier = [], [], [], []
            for r in batch.to_pylist():
                if r["label"] != label:
                    label, stacks, gone = r["label"], {}, set()
                own = stacks.setdefault(r["stack"], [])
                if r["step"] > 0:
                    own.append(r["invoice_id"])
                    continue
                while own and own[-1] in gone:  # replaced through its other stack
                    gone.discard(own.pop())
                if own:
                    gone.add(own[-1])
                    by.append(r["invoice_id"]), target.append(own.pop()), on.append(r["received_date"]), carrier.append(r["carrier_id"])
            yield pa.RecordBatch.from_arrays([pa.array(carrier, pa.string()), pa.array(by, pa.string()), pa.array(target, pa.string()), pa.array(on, pa.date32())], names=["carrier_id", "by", "target_id", "on"])

    order = ["label", "received_date", "step", "invoice_id"]
    return events.select(*order, "stack", "carrier_id").repartition("label").sortWithinPartitions(*order).mapInArrow(fold, "carrier_id string, by string, target_id string, on date")


def live(invoices: DataFrame) -> DataFrame:
    return invoices.filter(~F.coalesce("is_superseded", F.lit(False)))


def totals(invoices: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """lines_total and totals_ok (stated total within the tolerance, inclusive)."""
    t = lines.groupBy(*ids(invoices, lines)).agg(F.sum("amount").cast("decimal(18,2)").alias("lines_total"))
    out = invoices.drop("lines_total", "totals_ok").join(t, ids(invoices, lines), "left").withColumn("lines_total", F.coalesce("lines_total", F.lit(0).cast("decimal(18,2)")))
    return out.withColumn("totals_ok", F.coalesce(F.abs(F.col("lines_total") - F.col("total")) <= F.lit(str(tolerance)).cast("decimal(18,2)"), F.lit(False)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
