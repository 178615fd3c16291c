"""Month-end accruals without look-ahead, what they turned into, and the journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.money import MONEY, cents, ratio, total
from ..functions.tariff import linehaul, ltl_fuel, tl_fuel
from .books import ACCESSORIALS, RATED, WHOLE_INVOICE, Books, ids
from .ordered import medians, running_total
from .rerate import charges
from .resolve import at_shipment, live, moved, per_shipment
from .temporal import effective, with_diesel


def price_shipments(books: Books, config: Config) -> DataFrame:
    """Contract linehaul and fuel of every shipment; no month-end enters, so this is computed once for all of them."""
    f = config.fuel
    s = with_diesel(effective(books.shipments, books.rate_card, ["carrier_id", "lane_id"], "ship_date"), books.diesel)
    s = s.withColumn("lh_estimate", linehaul(F.col("mode"), F.col("weight_lbs"), F.col("miles")))
    fuel = F.when(F.col("mode") == "LTL", ltl_fuel(F.col("lh_estimate"), F.col("diesel_price"), base=f.ltl_base, step=f.ltl_step, per_step=f.ltl_pct_per_step)).otherwise(tl_fuel(F.col("miles"), F.col("diesel_price"), f.tl_peg, f.tl_mpg))
    return s.select("shipment_id", "carrier_id", "cost_center", "mode", "ship_date", "delivery_date", "lh_estimate", fuel.alias("fsc_estimate"))


def first_billed(invoices: DataFrame) -> DataFrame:
    """The first receipt of an original or rebill per shipment, superseded or not."""
    billed = invoices.filter(F.col("invoice_type").isin(*RATED) & F.col("shipment_id").isNotNull() & F.col("received_date").isNotNull())
    return per_shipment(billed, at_shipment(billed), F.min("received_date").alias("first_billed"))


def at_month_ends(rows: DataFrame, ends: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Each row once for every month-end from ``start`` to ``stop``, both included (a null stop is open, a null start gives none).

    The months are generated per row and joined by equality, so rows meet only month-ends they span.
    """
    edge = ends.agg(F.min("month_end").alias("a"), F.max("month_end").alias("b")).first()
    low, high = (F.lit(x).cast("date") for x in (edge.a, edge.b))
    first, last = F.trunc(F.greatest(start, low), "MM"), F.trunc(F.least(F.coalesce(stop, high), high), "MM")
    months = rows.withColumn("_month", F.explode(F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))))
    spread = months.withColumn("month_end", F.last_day("_month")).drop("_month").filter((start <= F.col("month_end")) & (stop.isNull() | (F.col("month_end") <= stop)))
    return spread.join(ends, "month_end", "left_semi")


def population(priced: DataFrame, invoices: DataFrame, ends: DataFrame) -> DataFrame:
    """Delivered and unbilled at each month-end, for all month-ends in one pass: a shipment accrues from its delivery until its first bill."""
    s = priced.join(first_billed(invoices), "shipment_id", "left")
    return at_month_ends(s, ends, F.col("delivery_date"), F.date_sub("first_billed", 1)).drop("first_billed")


def allowance(books: Books, config: Config, ends: DataFrame, modes: DataFrame) -> DataFrame:
    """month_end, carrier_id, accessorial_allowance, accessorial_basis.

    Authorized accessorial dollars per distinct billed shipment over invoices received in the trailing days up to each
    month-end and not known then to be superseded; lines count if an authorization was on file by then. Carriers without
    invoices in the window get their mode's default. ``modes`` has carrier_id and mode.
    """
    a = config.accruals
    own = ids(books.invoices, books.lines)
    inv = books.invoices.filter("shipment_id is not null").select(*own, "carrier_id", "shipment_id", "invoice_type", "received_date", "superseded_on")
    at = at_month_ends(inv, ends, F.col("received_date"), F.date_add("received_date", a.trailing_days - 1)).filter(~F.coalesce(F.col("superseded_on") <= F.col("month_end"), F.lit(False)))
    rated = at.filter(F.col("invoice_type").isin(*RATED))
    key = "home" if "home" in own else "shipment_id"
    there = moved if key == "home" and not at_shipment(inv) else lambda d: d  # rows by their shipment
    billed = there(rated.select(*own, "shipment_id", "month_end", "carrier_id")).select(key, "month_end", "carrier_id").distinct().groupBy("month_end", "carrier_id").agg(F.count(F.lit(1)).alias("n"))
    known = books.authorizations.groupBy("shipment_id", F.col("code").alias("charge_code")).agg(F.min("authorized_at").alias("authorized_at"))
    lines = there(books.lines.filter(F.col("charge_code").isin(*ACCESSORIALS)).join(at, own)).join(known.withColumnRenamed("shipment_id", key), [key, "charge_code"]).filter("authorized_at <= month_end")
    paid = lines.groupBy("month_end", "carrier_id").agg(F.sum("amount").cast(MONEY).alias("dollars"))
    d = ends.crossJoin(F.broadcast(modes)).join(billed, ["month_end", "carrier_id"], "left").join(paid, ["month_end", "carrier_id"], "left")
    default = F.when(F.col("mode") == "LTL", F.lit(str(a.default_ltl))).otherwise(F.lit(str(a.default_tl))).cast("decimal(18,8)")
    history = F.coalesce("dollars", F.lit(0).cast(MONEY)) / F.col("n").cast("decimal(18,0)")
    return d.select("month_end", "carrier_id", F.when(F.col("n") > 0, history.cast("decimal(18,8)")).otherwise(default).alias("accessorial_allowance"), F.when(F.col("n") > 0, "history").otherwise("default").alias("accessorial_basis"))


def with_allowance(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """The accrual detail of a population, or of another detail of it: which shipments accrue and their linehaul and fuel do not depend on the allowance. ``allowed`` has a row per month-end and carrier."""
    d = rows.drop("accessorial_estimate", "accessorial_basis", "accrual_estimate").join(F.broadcast(allowed), ["month_end", "carrier_id"], "left")
    d = d.withColumn("accessorial_estimate", cents(F.col("accessorial_allowance")))
    return d.select("month_end", "shipment_id", "carrier_id", "cost_center", "mode", "ship_date", "delivery_date", "lh_estimate", "fsc_estimate", "accessorial_estimate", "accessorial_basis", (F.col("lh_estimate") + F.col("fsc_estimate") + F.col("accessorial_estimate")).cast(MONEY).alias("accrual_estimate"))


def accrue(books: Books, config: Config, ends: DataFrame, modes: DataFrame, keep=lambda d: d) -> DataFrame:
    """The accrual detail of every month-end: linehaul, fuel and allowance of each delivered, unbilled shipment (``keep`` may persist or write the priced shipments)."""
    return with_allowance(population(keep(price_shipments(books, config)), books.invoices, ends), allowance(books, config, ends, modes))


def shipment_actuals(books: Books, counted: DataFrame, summary: DataFrame) -> DataFrame:
    """Per shipment what final invoices billed and what is payable after the audit, split into linehaul with fuel and accessorials.

    A whole-invoice recovery splits by the invoice's own lines; otherwise unauthorized accessorials come off accessorials (no
    more than were billed or are recoverable) and the rest off linehaul and fuel.
    """
    zero = F.lit(0).cast(MONEY)
    own = ids(books.invoices, books.lines, counted, summary)
    inv = live(books.invoices).filter("shipment_id is not null").select(*own, "shipment_id", "total")
    core = charges(books.lines).select(*own, (F.col("billed_lh") + F.col("billed_fsc")).cast(MONEY).alias("billed_core"))
    used = counted.filter("counted_in_recoverable").groupBy(*own).agg(F.max(F.col("error_type").isin(*WHOLE_INVOICE)).alias("whole"), total(F.when(F.col("error_type") == "unauthorized_accessorial", F.col("dollar_impact"))).alias("unauthorized"))
    d = inv.join(core, own, "left").join(used, own, "left").join(summary.select(*own, "recoverable"), own, "left")
    d = d.withColumns({"billed_core": F.coalesce("billed_core", zero), "recoverable": F.coalesce("recoverable", zero), "whole": F.coalesce("whole", F.lit(False)), "unauthorized": F.coalesce("unauthorized", zero)})
    d = d.withColumn("billed_acc", (F.col("total") - F.col("billed_core")).cast(MONEY)).withColumn("acc", F.least("unauthorized", "billed_acc", "recoverable"))
    d = d.withColumns({"rec_acc": F.when(F.col("whole"), F.col("billed_acc")).otherwise(F.col("acc")), "rec_core": F.when(F.col("whole"), F.col("billed_core")).otherwise((F.col("recoverable") - F.col("acc")).cast(MONEY))})
    sums = per_shipment(d, at_shipment(inv), F.count(F.lit(1)).alias("invoices_billed"), *[F.sum(c).cast(MONEY).alias(n) for c, n in (("total", "actual_billed"), ("billed_core", "core"), ("billed_acc", "acc"), ("rec_core", "rec_core"), ("rec_acc", "rec_acc"))])
    m = lambda c: c.cast(MONEY)
    return sums.select(
        "shipment_id", "invoices_billed", "actual_billed", F.col("core").alias("actual_lh_fsc_billed"), F.col("acc").alias("actual_accessorial_billed"), m(F.col("rec_core") + F.col("rec_acc")).alias("actual_recoverable"),
        m(F.col("actual_billed") - F.col("rec_core") - F.col("rec_acc")).alias("actual_payable"), m(F.col("core") - F.col("rec_core")).alias("payable_lh_fsc"), m(F.col("acc") - F.col("rec_acc")).alias("payable_accessorial"),
    )


def accuracy(detail: DataFrame, actuals: DataFrame, config: Config, keep=lambda d: d) -> DataFrame:
    """Accrual against eventual payable per month-end and over all (month_end null): net errors, and per-shipment error without netting (mean, median, share over the band).

    ``keep`` may persist or write the pairs of accrual and actual, which the medians read again.
    """
    d = keep(paired(detail, actuals))
    g = net_error(d, F.avg("ape").alias("shipment_mape"), F.avg((F.col("ape") > config.accruals.large_error).cast("int")).alias("shipment_share_over_band"))
    whole = F.lit(None).cast("date")
    middle = medians(d.select("month_end", "ape"), ["month_end"], "ape", "m").unionByName(medians(d.select("ape"), [], "ape", "m").select(whole.alias("month_end"), "m"))
    middle = middle.select(F.col("month_end").alias("_end"), F.col("m").alias("shipment_median_ape"))
    return g.join(middle, F.col("month_end").eqNullSafe(F.col("_end")), "left").drop("_end")


def paired(detail: DataFrame, actuals: DataFrame) -> DataFrame:
    """Each accrual with what its shipment turned into, and its absolute percentage error."""
    zero = F.lit(0).cast(MONEY)
    d = detail.join(actuals, "shipment_id", "left").select(
        "month_end", "accrual_estimate", "accessorial_estimate", (F.col("lh_estimate") + F.col("fsc_estimate")).cast(MONEY).alias("core"), F.col("invoices_billed").isNull().alias("never"),
        *[F.coalesce(a, zero).alias(b) for a, b in (("actual_billed", "billed"), ("actual_payable", "payable"), ("payable_lh_fsc", "pay_core"), ("payable_accessorial", "pay_acc"))],
    )
    return d.withColumn("ape", F.when(F.col("payable") > 0, F.abs(F.col("accrual_estimate") - F.col("payable")).cast("double") / F.col("payable").cast("double")))


def net_error(pairs: DataFrame, *more: Column) -> DataFrame:
    """Accrual against payable per month-end and over all, netted over shipments, with ``more`` aggregates."""
    s = lambda c: F.sum(c).cast(MONEY)
    g = pairs.groupingSets([["month_end"], []], "month_end").agg(
        F.count(F.lit(1)).alias("shipments_accrued"), F.count_if("never").alias("never_billed"), s("accrual_estimate").alias("accrual_estimate"), s("billed").alias("actual_billed"), s("payable").alias("actual_payable"),
        s("core").alias("lh_fsc_accrual"), s("pay_core").alias("lh_fsc_payable"), s("accessorial_estimate").alias("accessorial_accrual"), s("pay_acc").alias("accessorial_payable"),
        *more,
    )
    gap = lambda a, b: (F.col(a) - F.col(b)).cast(MONEY)
    g = g.withColumns({"error": gap("accrual_estimate", "actual_payable"), "lh_fsc_error": gap("lh_fsc_accrual", "lh_fsc_payable"), "accessorial_error": gap("accessorial_accrual", "accessorial_payable")})
    return g.withColumns({"error_pct": ratio(F.col("error"), F.col("actual_payable")), "lh_fsc_error_pct": ratio(F.col("lh_fsc_error"), F.col("lh_fsc_payable")), "accessorial_error_pct": ratio(F.col("accessorial_error"), F.col("accessorial_payable"))})


def headline(acc: DataFrame) -> DataFrame:
    """Mean absolute and mean signed monthly error."""
    return acc.filter("month_end is not null").agg(F.avg(F.abs("error_pct")).alias("mape"), F.avg("error_pct").alias("bias"))


def authorizations_at_delivery(books: Books) -> Books:
    """The what-if books: every authorization recorded on the day of delivery."""
    d = books.authorizations.drop("authorized_at").join(books.shipments.select("shipment_id", F.col("delivery_date").alias("authorized_at")), "shipment_id")
    return books.with_(authorizations=d)


SENSITIVE = ("accrual_estimate", "error", "error_pct", "accessorial_accrual", "accessorial_error", "accessorial_error_pct")


def at_delivery(detail: DataFrame, actuals: DataFrame, books: Books, config: Config, ends: DataFrame, modes: DataFrame) -> DataFrame:
    """The net errors of a detail in the what-if books. Their authorizations enter the allowance alone, so the detail is given theirs and nothing else is computed again."""
    return net_error(paired(with_allowance(detail, allowance(authorizations_at_delivery(books), config, ends, modes)), actuals))


def sensitivity(built: DataFrame, scenario: DataFrame) -> DataFrame:
    """The accuracy as built beside that of the what-if books, and the dollars that late paperwork moved."""
    b = built.select(F.coalesce("month_end", F.lit("9999-12-31").cast("date")).alias("k"), "month_end", "shipments_accrued", "actual_payable", *[F.col(c).alias(f"{c}_as_built") for c in SENSITIVE])
    s = scenario.select(F.coalesce("month_end", F.lit("9999-12-31").cast("date")).alias("k"), *[F.col(c).alias(f"{c}_auth_at_delivery") for c in SENSITIVE])
    return b.join(s, "k").drop("k").withColumn("late_auth_effect", (F.col("accrual_estimate_auth_at_delivery") - F.col("accrual_estimate_as_built")).cast(MONEY))


def journal(detail: DataFrame, config: Config) -> DataFrame:
    """Balanced entries: at each month-end expense by cost center against the liability in total, and the mirror image the next day."""
    a = config.accruals
    zero = F.lit(0).cast(MONEY)
    g = detail.groupingSets([["month_end", "cost_center"], ["month_end"]], "month_end", "cost_center").agg(F.sum("accrual_estimate").cast(MONEY).alias("amount"), F.grouping("cost_center").alias("_total"))
    whole = F.col("_total") == 1
    month = F.date_format("month_end", "yyyyMM")
    memo = F.concat(F.lit("Accrual of freight delivered through "), F.col("month_end").cast("string"), F.lit(" and not yet invoiced"))

    def entry(kind: str, prefix: str, date, expense_debit: bool, text):
        debit = (~whole) if expense_debit else whole
        return F.struct(F.concat(F.lit(prefix), month).alias("je_id"), date.alias("date"), F.lit(kind).alias("type"), F.when(whole, a.liability).otherwise(a.expense).alias("account"), F.when(whole, "").otherwise(F.col("cost_center")).alias("cost_center"), F.when(debit, F.col("amount")).otherwise(zero).alias("debit"), F.when(debit, zero).otherwise(F.col("amount")).alias("credit"), text.alias("memo"))

    both = F.array(entry("accrual", "ACR-", F.col("month_end"), True, memo), entry("reversal", "REV-", F.date_add("month_end", 1), False, F.concat(F.lit("Reversal of ACR-"), month)))
    return g.select(F.inline(both))


def liability_balance(je: DataFrame, config: Config) -> DataFrame:
    """The liability account's balance after each entry; zero after every reversal."""
    lines = je.filter(F.col("account") == config.accruals.liability).groupBy("date", "type", "je_id").agg(F.sum(F.col("credit") - F.col("debit")).cast(MONEY).alias("change"))
    return running_total(lines, "change", "balance", ["date", F.desc("type"), "je_id"]).withColumn("balance", F.col("balance").cast(MONEY))
