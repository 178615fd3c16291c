"""Acting on flags: the exception queue, carrier disputes and systemic patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.formats import month_label, p_text, pct, usd
from ..functions.money import MONEY, total
from ..functions.stats import binomial_tail
from .books import ERROR_TYPES, ids
from .ordered import indexed
from .resolve import live
from .rules import rule_order


def exception_queue(counted: DataFrame, invoices: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per flagged invoice, ranked by recoverable dollars, then receipt, then id; types and reasons in rule order."""
    return ranked(flagged_invoices(counted, invoices, summary), "queue_rank", F.desc("recoverable"), F.col("received_date").asc_nulls_last(), "invoice_id")


def flagged_invoices(counted: DataFrame, invoices: DataFrame, summary: DataFrame) -> DataFrame:
    """The queue's rows without their rank."""
    entry = F.struct(rule_order(F.col("error_type")).alias("o"), "error_type", "reason")
    own = ids(counted, invoices, summary)
    per = counted.groupBy(*own).agg(F.array_sort(F.collect_list(entry)).alias("f"))
    d = per.join(summary.select(*own, "carrier_id", "invoice_number", "shipment_id", "total", "n_flags", "recoverable"), own).join(invoices.select(*own, "received_date", "ship_date", "match_method"), own)
    return d.withColumns({"error_types": F.array_join(F.array_distinct(F.transform("f", lambda x: x["error_type"])), ";"), "reasons": F.array_join(F.transform("f", lambda x: x["reason"]), " | ")}).drop("f", "home")


def ranked(d: DataFrame, name: str, *order) -> DataFrame:
    """A global 1..n rank without pulling all rows into one task. ``order`` should end in a unique key."""
    return indexed(d, [], list(order), "_i").withColumn(name, F.col("_i") + 1).drop("_i")


def filter_queue(queue: DataFrame, carriers: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """The queue's rows of some carriers with any of some error types."""
    if carriers:
        queue = queue.filter(F.col("carrier_id").isin(*carriers))
    if types:
        queue = queue.filter(F.arrays_overlap(F.split("error_types", ";"), F.array(*[F.lit(t) for t in types])))
    return queue


def top_per_carrier(queue: DataFrame, n: int) -> DataFrame:
    """The first n of each carrier with their rank there."""
    w = Window.partitionBy("carrier_id").orderBy(F.desc("recoverable"), F.col("received_date").asc_nulls_last(), "invoice_id")
    return queue.withColumn("carrier_rank", F.row_number().over(w)).filter(F.col("carrier_rank") <= n).withColumn("carrier_rank", F.col("carrier_rank").cast("long"))  # cast last: each task then keeps n a carrier


def carrier_by_type(counted: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per carrier and error type: invoices, flags, flagged and recoverable dollars."""
    own = ids(counted, invoices)
    per = counted.join(invoices.select(*own, "carrier_id"), own).groupBy(*own, "carrier_id", "error_type").agg(F.count(F.lit(1)).alias("n"), F.sum("dollar_impact").alias("all"), F.sum(F.when(F.col("counted_in_recoverable"), F.col("dollar_impact"))).alias("used"))
    return per.groupBy("carrier_id", "error_type").agg(F.count(F.lit(1)).alias("invoices"), F.sum("n").alias("flags"), F.sum("all").cast(MONEY).alias("flagged_dollars"), total(F.col("used")).alias("recoverable_dollars"))


def window_rates(invoices: DataFrame, counted: DataFrame, modes: DataFrame, months: int) -> DataFrame:
    """carrier_id, mode, error_type, window (number), window_start, window_end, n, k, peer_n, peer_k over rolling windows of months present.

    Windows run over the sorted months with invoices, not the calendar. Invoices are counted once per carrier and month
    before anything is spread over windows.
    """
    own = ids(invoices, counted)
    inv = live(invoices).select(*own, "carrier_id", F.trunc("ship_date", "MM").alias("month")).join(modes, "carrier_id")
    base = inv.groupBy("carrier_id", "mode", "month").agg(F.count(F.lit(1)).alias("n"))
    hits = counted.select(*own, "error_type").distinct().join(inv, own).groupBy("carrier_id", "month", "error_type").agg(F.count(F.lit(1)).alias("k"))
    ordered = base.select("month").distinct().withColumn("i", F.row_number().over(Window.orderBy("month")))
    size = F.greatest(F.max("i").over(Window.partitionBy(F.lit(0))) - months + 1, F.lit(1))
    spans = ordered.withColumn("windows", size).withColumn("w", F.explode(F.sequence(F.greatest(F.col("i") - months + 1, F.lit(1)), F.least(F.col("i"), F.col("windows")))))
    edges = spans.groupBy("w").agg(F.min("month").alias("window_start"), F.last_day(F.max("month")).alias("window_end"))
    types = invoices.sparkSession.createDataFrame([(e,) for e in ERROR_TYPES], "error_type string")
    cells = base.crossJoin(F.broadcast(types)).join(hits, ["carrier_id", "month", "error_type"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    per = cells.join(spans.select("month", "w"), "month").groupBy("carrier_id", "mode", "error_type", "w").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    peers = Window.partitionBy("mode", "error_type", "w")
    per = per.withColumns({"peer_n": F.sum("n").over(peers) - F.col("n"), "peer_k": F.sum("k").over(peers) - F.col("k")})
    return per.join(edges, "w").withColumnRenamed("w", "window")


def systemic_findings(invoices: DataFrame, counted: DataFrame, modes: DataFrame, config: Config, rates: DataFrame | None = None) -> DataFrame:
    """Carrier and error type pairs whose flag rate in some window is far above their peers of the same mode (leave-one-out): the most significant window of each.

    Gates: least invoices and flags, a multiple of the peer rate, and a one-sided binomial p-value at or below alpha over the number
    of tests (carriers x types x windows, tested or not). ``rates`` may be their stored window rates.
    """
    s = config.systemic
    d = window_rates(invoices, counted, modes, s.window_months) if rates is None else rates
    tests = d.agg((F.countDistinct("carrier_id") * len(ERROR_TYPES) * F.countDistinct("window")).alias("tests"))
    d = d.crossJoin(F.broadcast(tests)).withColumns({"carrier_rate": F.try_divide("k", "n"), "peer_rate": F.coalesce(F.try_divide("peer_k", "peer_n"), F.lit(0.0)), "alpha_adjusted": F.lit(s.alpha) / F.greatest("tests", F.lit(1))})
    d = d.filter((F.col("n") >= s.min_invoices) & (F.col("k") >= s.min_flags) & (F.col("carrier_rate") >= s.multiple * F.col("peer_rate")))
    d = d.withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), F.col("peer_rate"))).filter("p_value <= alpha_adjusted")
    best = d.withColumn("_k", F.row_number().over(Window.partitionBy("carrier_id", "error_type").orderBy("p_value", "window_start"))).filter("_k = 1")
    return best.select("carrier_id", "mode", "error_type", "window_start", "window_end", F.col("n").alias("invoices"), F.col("k").alias("flagged"), "carrier_rate", "peer_rate", "p_value", "alpha_adjusted")


def finding_dollars(findings: DataFrame, counted: DataFrame, invoices: DataFrame) -> DataFrame:
    """Findings with the flags of their carrier and type on invoices shipped within the window: invoices and recoverable dollars."""
    own = ids(counted, invoices)
    flagged = counted.join(live(invoices).select(*own, "carrier_id", "ship_date"), own).select(*own, "carrier_id", "error_type", "ship_date", F.when(F.col("counted_in_recoverable"), F.col("dollar_impact")).alias("d"))
    keys = findings.select("carrier_id", "error_type", "window_start", "window_end")
    hits = flagged.join(F.broadcast(keys), ["carrier_id", "error_type"]).filter(F.col("ship_date").between(F.col("window_start"), F.col("window_end")))
    per = hits.groupBy(*own, "carrier_id", "error_type").agg(F.sum("d").alias("d"))
    sums = per.groupBy("carrier_id", "error_type").agg(F.count(F.lit(1)).alias("window_invoices"), total(F.col("d")).alias("window_recoverable"))
    return keys.join(sums, ["carrier_id", "error_type"], "left").withColumns({"window_invoices": F.coalesce("window_invoices", F.lit(0).cast("long")), "window_recoverable": F.coalesce("window_recoverable", F.lit(0).cast(MONEY))})


def finding_text(findings: DataFrame) -> DataFrame:
    """A sentence per finding."""
    line = F.concat("carrier_id", F.lit(": "), F.regexp_replace("error_type", "_", " "), F.lit(" on "), F.col("flagged").cast("string"), F.lit(" of "), F.col("invoices").cast("string"), F.lit(" invoices ("), pct(F.col("carrier_rate")), F.lit(") shipped "), month_label(F.col("window_start")), F.lit(" to "), month_label(F.col("window_end")), F.lit(", peers "), pct(F.col("peer_rate")), F.lit("; "), p_text(F.col("p_value")))
    return findings.select("carrier_id", "error_type", line.alias("text"))


def dispute_packs(queue: DataFrame, counted: DataFrame, invoices: DataFrame, findings: DataFrame, carriers: DataFrame, n: int, by_type: DataFrame | None = None) -> DataFrame:
    """One Markdown pack per carrier (carrier_id, carrier_name in ``carriers``), also for those without flags: period, table by type, top invoices, systemic lines. ``by_type`` may be the stored ``carrier_by_type``."""
    period = live(invoices).groupBy("carrier_id").agg(F.min("ship_date").alias("from"), F.max("ship_date").alias("to"))
    cell = F.concat(F.lit("| "), "error_type", F.lit(" | "), F.col("invoices").cast("string"), F.lit(" | "), usd(F.col("recoverable_dollars")), F.lit(" |"))
    table = (carrier_by_type(counted, invoices) if by_type is None else by_type).groupBy("carrier_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rule_order(F.col("error_type")).alias("o"), cell.alias("l")))), lambda x: x["l"]), "\n").alias("table"), F.sum("recoverable_dollars").cast(MONEY).alias("claim"))
    item = F.concat(F.col("carrier_rank").cast("string"), F.lit(". "), "invoice_number", F.lit(" "), usd(F.col("recoverable")), F.lit(": "), "reasons")
    top = top_per_carrier(queue, n).groupBy("carrier_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("carrier_rank", item.alias("l")))), lambda x: x["l"]), "\n").alias("top"))
    lines = finding_text(findings).groupBy("carrier_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "text"))), "\n").alias("systemic"))
    d = carriers.join(period, "carrier_id", "left").join(table, "carrier_id", "left").join(top, "carrier_id", "left").join(lines, "carrier_id", "left")
    head = F.concat(F.lit("# Dispute summary: "), "carrier_name", F.lit("\n\nShipped "), F.coalesce(F.col("from").cast("string"), F.lit("-")), F.lit(" to "), F.coalesce(F.col("to").cast("string"), F.lit("-")), F.lit("\n\n"))
    body = F.when(F.col("table").isNull(), "No exceptions.\n").otherwise(F.concat(F.lit("Claim: "), usd(F.col("claim")), F.lit("\n\n| Type | Invoices | Recoverable |\n|-|-|-|\n"), "table", F.lit("\n\n"), F.coalesce("top", F.lit("")), F.lit("\n\n"), F.coalesce("systemic", F.lit("No systemic issue found.")), F.lit("\n")))
    return d.select("carrier_id", F.concat(head, body).alias("markdown"))
