"""Flags against labelled data: outcomes, confusion metrics, recall by mode, trap tables, causes, and the tolerance sweep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.money import MONEY, ratio
from .books import ERROR_TYPES, ids
from .rules import ltl_fuel_hit, rate_hit, tl_fuel_hit, weight_hit

#: fixed values: causes of a false flag in order of precedence
CAUSES = ("rate_amendment", "reweigh", "weight_misread_as_rate", "late_authorization", "rebill_balance_due", "bol_typo_or_zero", "other")


def spine(df: DataFrame, name: str, values) -> DataFrame:
    """A row per value, in order, so that values without data appear in reports."""
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, position int")


def outcomes(counted: DataFrame, labels: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """invoice_id, error_type, flagged_dollars, true_dollars, status: TP, FP or FN of flags against error labels.

    ``labels`` has invoice_id, label_kind, label, mode, true_dollar_impact; superseded invoices are out of scope. ``scope``
    limits the invoices (invoice_id).
    """
    own = ids(counted, labels)
    gone = labels.filter("label_kind = 'superseded'").select(*own).distinct()
    truth = labels.filter("label_kind = 'error'").groupBy(*own, F.col("label").alias("error_type")).agg(F.sum("true_dollar_impact").cast(MONEY).alias("true_dollars"))
    found = counted.groupBy(*own, "error_type").agg(F.sum(F.when(F.col("counted_in_recoverable"), F.col("dollar_impact")).otherwise(0)).cast(MONEY).alias("flagged_dollars"))
    if not gone.isEmpty():
        truth, found = truth.join(gone, own, "left_anti"), found.join(gone, own, "left_anti")
    if scope is not None:
        truth, found = (t.join(scope.select("invoice_id").distinct(), "invoice_id", "left_semi") for t in (truth, found))
    both = found.withColumn("_f", F.lit(True)).join(truth.withColumn("_t", F.lit(True)), [*own, "error_type"], "full_outer")
    status = F.when(F.col("_f") & F.col("_t"), "TP").when(F.col("_f"), "FP").otherwise("FN")
    none = F.lit(0).cast(MONEY)
    return both.select(*own, "error_type", F.coalesce("flagged_dollars", none).alias("flagged_dollars"), F.coalesce("true_dollars", none).alias("true_dollars"), status.alias("status"))


def measures() -> list[Column]:
    s = F.col("status")
    n = lambda k: F.count_if(s == k).cast("long")
    cash = lambda c, *k: F.coalesce(F.sum(F.when(s.isin(*k), F.col(c))), F.lit(0)).cast(MONEY)
    return [n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"), cash("flagged_dollars", "TP", "FP").alias("flagged_dollars"), cash("true_dollars", "TP", "FN").alias("true_dollars"), cash("flagged_dollars", "TP").alias("tp_dollars"), cash("true_dollars", "TP").alias("tp_true_dollars")]


def with_ratios(d: DataFrame) -> DataFrame:
    d = d.withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in ("tp", "fp", "fn")}).withColumns({k: F.coalesce(k, F.lit(0)).cast(MONEY) for k in ("flagged_dollars", "true_dollars", "tp_dollars", "tp_true_dollars")})
    return d.withColumns({
        "flags": F.col("tp") + F.col("fp"), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "dollar_recall": ratio(F.col("tp_true_dollars"), F.col("true_dollars")),
    })


def metrics_by_type(scored: DataFrame) -> DataFrame:
    """Confusion metrics per error type and over all, every type present."""
    by = scored.groupingSets([["error_type"], []], "error_type").agg(*measures(), F.grouping("error_type").alias("_all"))
    by = by.withColumn("error_type", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("error_type"))).drop("_all")
    return with_ratios(spine(scored, "error_type", (*ERROR_TYPES, "ALL")).join(by, "error_type", "left"))


def recall_by_mode(labels: DataFrame, systems: dict[str, DataFrame]) -> DataFrame:
    """Errors by type and mode, and how many each system (its outcomes) found."""
    own = ids(labels, *systems.values())
    gone = labels.filter("label_kind = 'superseded'").select(*own).distinct()
    d = labels.filter("label_kind = 'error'").join(gone, own, "left_anti").groupBy(*own, F.col("label").alias("error_type"), F.coalesce("mode", F.lit("")).alias("mode")).agg(F.sum("true_dollar_impact").cast(MONEY).alias("dollars"))
    for name, scored in systems.items():
        d = d.join(scored.filter("status = 'TP'").select(*own, "error_type", F.lit(1).alias(f"_{name}")), [*own, "error_type"], "left")
    cols = [F.count(F.lit(1)).alias("errors"), F.sum("dollars").cast(MONEY).alias("dollars")]
    for name in systems:
        cols += [F.count(f"_{name}").alias(f"{name}_found"), ratio(F.count(f"_{name}"), F.count(F.lit(1))).alias(f"{name}_recall")]
    return d.groupBy("error_type", "mode").agg(*cols)


def trap_table(labels: DataFrame, scored: DataFrame) -> DataFrame:
    """False flags on trapped invoices, per trap (an invoice with two traps counts under both) and on clean ones, with counts by type."""
    own = ids(labels, scored)
    groups = labels.filter("label_kind in ('trap', 'clean')").select(*own, F.when(F.col("label_kind") == "clean", "(clean)").otherwise(F.col("label")).alias("trap")).distinct()
    fp = scored.filter("status = 'FP'").select(*own, "error_type")
    size = groups.groupBy("trap").agg(F.count(F.lit(1)).alias("invoices"))
    hit = groups.join(fp, own)
    by = hit.groupBy("trap", "error_type").agg(F.count(F.lit(1)).alias("n")).groupBy("trap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("error_type", "n"))), lambda x: F.concat(x["error_type"], F.lit(":"), x["n"].cast("string"))), ";").alias("by_type"), F.sum("n").alias("false_flags"))
    flagged = hit.select(*own, "trap").distinct().groupBy("trap").agg(F.count(F.lit(1)).alias("invoices_flagged"))
    d = size.join(by, "trap", "left").join(flagged, "trap", "left")
    return d.select("trap", "invoices", F.coalesce("invoices_flagged", F.lit(0)).alias("invoices_flagged"), F.coalesce("false_flags", F.lit(0)).alias("false_flags"), F.coalesce("by_type", F.lit("")).alias("by_type"))


def fp_causes(labels: DataFrame, scored: DataFrame) -> DataFrame:
    """Each false flag under one cause (the first that fits the rule that raised it), every cause present; ``other`` comes last, the rest by count."""
    own = ids(labels, scored)
    # one flag per trap or error that a cause asks for, not sets: these would be gathered by sorting
    traps = ("rate_amendment", "documented_reweigh", "late_authorization", "rebill", "balance_due", "bol_typo")
    is_trap = F.col("label_kind") == "trap"
    sets = labels.groupBy(*own).agg(
        *[F.max(is_trap & (F.col("label") == t)).alias(f"trap_{t}") for t in traps], F.max((F.col("label_kind") == "error") & (F.col("label") == "weight_overbilling")).alias("overweight"),
        F.max(is_trap & (F.col("label") == "bol_format") & (F.col("mode") == "zeros_dropped")).alias("zeros"),
    )
    d = scored.filter("status = 'FP'").join(sets, own, "left")
    trap = lambda *t: reduce(lambda a, b: a | b, [F.coalesce(f"trap_{x}", F.lit(False)) for x in t])
    kind = F.col("error_type")
    cause = (
        F.when((kind == "rate_overcharge") & trap("rate_amendment"), CAUSES[0])
        .when(kind.isin("rate_overcharge", "weight_overbilling") & trap("documented_reweigh"), CAUSES[1])
        .when((kind == "rate_overcharge") & F.coalesce("overweight", F.lit(False)), CAUSES[2])
        .when((kind == "unauthorized_accessorial") & trap("late_authorization"), CAUSES[3])
        .when((kind == "duplicate_invoice") & trap("rebill", "balance_due"), CAUSES[4])
        .when((kind == "phantom_invoice") & (trap("bol_typo") | F.coalesce("zeros", F.lit(False))), CAUSES[5])
        .otherwise(CAUSES[6])
    )
    per = d.select(cause.alias("cause"), "error_type").groupBy("cause", "error_type").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("cause").agg(F.sum("n").alias("false_flags"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("error_type", "n"))), lambda x: F.concat(x["error_type"], F.lit(":"), x["n"].cast("string"))), ";").alias("by_rule"))
    out = spine(scored, "cause", CAUSES).join(per, "cause", "left").withColumn("false_flags", F.coalesce("false_flags", F.lit(0)))
    out = out.withColumn("share", ratio(F.col("false_flags"), F.sum("false_flags").over(Window.partitionBy(F.lit(0)))))
    return out.select("cause", "false_flags", "share", F.coalesce("by_rule", F.lit("")).alias("by_rule"), "position").orderBy(F.col("cause") == "other", F.desc("false_flags"), "position").drop("position")


def side_by_side(engine: DataFrame, baseline: DataFrame) -> DataFrame:
    """Two systems' metrics per error type in one row."""
    pre = lambda d, p: d.select("error_type", *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c not in ("error_type", "position")])
    return pre(engine, "engine").join(pre(baseline, "baseline"), "error_type")


# ---------------------------------------------------------------- sweep


def sweep_grid(spark, config: Config) -> DataFrame:
    """tolerance, value, is_current: each grid with the current setting added."""
    rows = []
    for name, grid in config.sweeps.items():
        now = float(getattr(config.tolerances, name))
        rows += [(name, v, v == now) for v in sorted({round(float(v), 6) for v in (*grid, now)})]
    return spark.createDataFrame(rows, "tolerance string, value double, is_current boolean")


#: fixed values: which rule and mode a tolerance belongs to
SWEEP_SCOPE = {"rate_pct": ("rate_overcharge", None), "fsc_ltl_pp": ("fsc_mismatch", "LTL"), "fsc_tl_pct": ("fsc_mismatch", "TL"), "weight_pct": ("weight_overbilling", "LTL")}


def sweep(rerated: DataFrame, labels: DataFrame, invoice_mode: DataFrame, config: Config) -> DataFrame:
    """Every tolerance at every grid point, scored: one join of the rerated invoices with a grid of a few dozen rows, and one aggregation.

    ``invoice_mode`` has an invoice's ids and mode of all invoices (the scope of labels). The grid is configuration, so its size is fixed.
    """
    spark = rerated.sparkSession
    grid = sweep_grid(spark, config)
    scope = spark.createDataFrame([(t, e, m) for t, (e, m) in SWEEP_SCOPE.items()], "tolerance string, error_type string, scope_mode string")
    points = grid.join(scope, "tolerance")
    v, t = F.col("value").cast("decimal(12,6)"), F.col("tolerance")
    tests = {"rate_pct": lambda v: rate_hit(v, config), "fsc_ltl_pp": lambda v: ltl_fuel_hit(v, config), "fsc_tl_pct": lambda v: tl_fuel_hit(v, config), "weight_pct": weight_hit}
    either = lambda found: reduce(lambda a, b: a | b, found)
    hit = either([(t == name) & test(v) for name, test in tests.items()])
    # a threshold is linear in its tolerance, so what no grid's lowest or highest value finds no value between finds
    ends = [(name, min(values), max(values)) for name in tests if (values := [*config.sweeps.get(name, ()), getattr(config.tolerances, name)])]
    any_hit = either([tests[name](F.lit(round(float(x), 6)).cast("decimal(12,6)")) for name, *span in ends for x in span])
    impact = F.when(t == "rate_pct", F.col("rate_impact")).when(t == "weight_pct", F.col("weight_impact")).otherwise(F.col("fsc_impact"))
    own = ids(rerated, labels, invoice_mode)
    raised = rerated.filter(any_hit).crossJoin(F.broadcast(points)).filter(hit).select("tolerance", "value", "error_type", *own, impact.alias("flagged"))
    gone = labels.filter("label_kind = 'superseded'").select(*own).distinct()
    known = gone.isEmpty()
    apart = lambda d: d if known else d.join(gone, own, "left_anti")
    truth = apart(labels.filter("label_kind = 'error'")).join(invoice_mode.select(*own, F.col("mode").alias("inv_mode")), own).groupBy(*own, F.col("label").alias("error_type"), "inv_mode").agg(F.sum("true_dollar_impact").cast(MONEY).alias("true_dollars"))
    positives = truth.join(F.broadcast(scope), "error_type").filter("scope_mode is null or scope_mode = inv_mode").groupBy("tolerance").agg(F.count(F.lit(1)).alias("positives"))
    tp = apart(raised).join(truth.select(*own, "error_type", F.lit(True).alias("true")), [*own, "error_type"], "left")
    got = tp.groupBy("tolerance", "value").agg(F.count_if(F.col("true")).alias("tp"), F.count_if(F.col("true").isNull()).alias("fp"), F.coalesce(F.sum(F.when(F.col("true"), F.col("flagged"))), F.lit(0)).cast(MONEY).alias("tp_dollars"))
    d = points.join(got, ["tolerance", "value"], "left").join(positives, "tolerance", "left")
    d = d.withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in ("tp", "fp", "positives")}).withColumn("tp_dollars", F.coalesce("tp_dollars", F.lit(0)).cast(MONEY))
    e = config.economics
    rate = lambda x: F.lit(str(x)).cast("decimal(18,4)")
    d = d.withColumns({"fn": F.col("positives") - F.col("tp"), "flags": F.col("tp") + F.col("fp")})
    d = d.withColumns({
        "precision": ratio(F.col("tp"), F.col("flags")), "recall": ratio(F.col("tp"), F.col("positives")), "carrier_mode": F.coalesce("scope_mode", F.lit("ALL")),
        "review_cost": (F.col("flags") * rate(e.review_minutes_per_flag / 60 * e.analyst_cost_per_hour)).cast(MONEY), "false_dispute_cost": (F.col("fp") * rate(e.false_dispute_cost)).cast(MONEY),
    })
    d = d.withColumn("net_value", (F.col("tp_dollars") - F.col("review_cost") - F.col("false_dispute_cost")).cast(MONEY)).withColumn("meets_floor", F.coalesce(F.col("precision") >= e.min_precision, F.lit(False)))
    return d.select("tolerance", "value", "error_type", "carrier_mode", "is_current", "flags", "tp", "fp", "fn", "precision", "recall", "tp_dollars", "review_cost", "false_dispute_cost", "net_value", "meets_floor")


def recommend(points: DataFrame, config: Config) -> DataFrame:
    """Per tolerance the current, the best and the recommended value.

    Best is the highest net value among points at or above the precision floor (ties to the one nearest the current setting, then the
    lowest), or the most precise point if none is. It is recommended if it gains more than the material amount or if the current point is below the floor.
    """
    now = points.filter("is_current").select("tolerance", F.col("value").alias("current_value"), F.col("net_value").alias("current_net"), F.col("meets_floor").alias("current_meets"))
    d = points.join(now, "tolerance").withColumn("_near", F.abs(F.col("value") - F.col("current_value")))
    w = Window.partitionBy("tolerance").orderBy(F.desc("meets_floor"), F.when(F.col("meets_floor"), F.col("net_value")).desc_nulls_last(), F.when(~F.col("meets_floor"), F.coalesce("precision", F.lit(-1.0))).desc_nulls_last(), F.when(F.col("meets_floor"), F.col("_near")).asc_nulls_last(), "value")
    best = d.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    change = (~F.col("current_meets")) | (F.col("net_value") - F.col("current_net") > F.lit(str(config.economics.min_material_gain)).cast(MONEY))
    return best.select("tolerance", "current_value", "current_net", F.col("value").alias("best_value"), F.col("net_value").alias("best_net"), F.when(change, F.col("value")).otherwise(F.col("current_value")).alias("recommended_value"), change.alias("changed"))
