"""The six audit rules, the naive baseline, and recoverable dollars without double counting.

A rule takes an AuditContext and returns flags (FLAGS). New rules join through the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.formats import pct, title, usd
from ..functions.money import MONEY, money, ratio
from ..session import come_home, united
from .books import ERROR_TYPES, RATED, WHOLE_INVOICE, Books, ids
from .resolve import crossing, exact_match, live, spread
from .rerate import accessorial_lines, rerate_invoices

FLAGS = ("invoice_id", "error_type", "reason", "dollar_impact", "shipment_id", "related_invoice_id", "billed_value", "expected_value")
#: what the rules read of re-rated invoices
RERATED = (
    "shipment_id", "mode", "miles", "version", "diesel_week", "billed_weight_lbs", "certified_weight_lbs", "reference_weight_lbs", "billed_lh", "billed_fsc", "lh_at_billed", "lh_at_reference", "fsc_pct_expected", "fsc_expected",
    "rate_gap", "rate_impact", "weight_impact", "fsc_impact",
)
#: how many invoices of one freight are compared with each other
FEW = 32


@dataclass(frozen=True)
class AuditContext:
    books: Books
    rerated: DataFrame
    accessorials: DataFrame
    config: Config


def context(books: Books, config: Config, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> AuditContext:
    """What the rules read; ``keep`` may persist or write the frames that several of them share."""
    return AuditContext(books, keep(rerate_invoices(books, config)), keep(accessorial_lines(books, config.audit_as_of)), config)


RULES: dict[str, Callable[[AuditContext], DataFrame]] = {}


def rule(name: str):
    def add(f):
        RULES[name] = f
        return f

    return add


def flags(df: DataFrame, error_type: str, reason: Column, impact: Column, billed: Column, expected: Column, related: Column | None = None) -> DataFrame:
    return df.select(*ids(df), F.lit(error_type).alias("error_type"), reason.alias("reason"), impact.cast(MONEY).alias("dollar_impact"), F.col("shipment_id"), (F.lit(None).cast("string") if related is None else related).alias("related_invoice_id"), billed.cast(MONEY).alias("billed_value"), expected.cast(MONEY).alias("expected_value"))


def freight_key() -> Column:
    """What makes two invoices about the same freight: the matched shipment, else carrier and BOL, else the invoice alone."""
    return F.coalesce(F.when(F.col("shipment_id").isNotNull(), F.concat(F.lit("SHIP:"), "shipment_id")), F.concat(F.lit("BOL:"), "carrier_id", F.lit(":"), "bol_canonical"), F.concat(F.lit("INV:"), "invoice_id"))


def duplicate_pairs(books: Books, config: Config) -> DataFrame:
    """invoice_id, first_id, first_date, why: each repeat with the earliest invoice it repeats and that one's receipt.

    Repeats for the same freight have an earlier invoice (by receipt, then id) with a total within the tolerance and received within the window;
    a repeat of carrier and invoice number counts otherwise.

    Invoices of one freight, total and day are one point, which keeps its smallest id: no other of them can be the earliest. The points of one total in one stretch of days are one series.
    A point meets the series of the cells (two tolerances by two windows) that its tolerance and window reach into, four at most, so what it meets is bounded by the tolerance in cents,
    whatever the number of invoices of its freight.

    Where all invoices of a number have one home, those of a freight of one home with at most FEW invoices are compared with each other instead, in one window: a frame of FEW rows before and after holds
    the whole freight, so that its size never grows. Only the invoices of freights with several homes (some were matched to a shipment elsewhere) leave theirs.
    """
    pool = live(books.invoices).filter(F.col("invoice_type").isin(*RATED)).withColumn("key", freight_key()).select(*ids(books.invoices), "key", "carrier_id", "invoice_number", F.col("received_date").alias("day"), "total")
    dated, numbered = pool.filter("day is not null and total is not null"), pool.filter("invoice_number is not null")
    near = "home" in pool.columns and spread(numbered, ["carrier_id", "invoice_number"], "home")[0]
    own = ["home", "invoice_id"] if near else ["invoice_id"]
    if near:
        far, crowded = crossing(pool, "key", FEW)
        crowd = pool.groupBy("home", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select("home", "key")
        apart = [(crowd, ["home"])] * crowded
        if far is not None:
            pool = pool.join(far.withColumn("_far", F.lit(True)), ["home", "key"], "left")
            apart = [(crowd.join(far, ["home", "key"], "left_anti"), ["home"])] * crowded + [(far, [])]
        got = _repeats_at_home(pool, config)
        for some, at in apart:
            got = got.join(_freight_repeats(dated.join(some, ["home", "key"]), at, own, config).withColumnRenamed("by_freight", "_apart"), own, "left").withColumn("by_freight", F.coalesce("by_freight", "_apart")).drop("_apart")
        got = got.filter("by_freight is not null or by_number is not null")
    else:
        first = numbered.groupBy("carrier_id", "invoice_number").agg(F.min(F.struct(F.col("day").isNull().alias("undated"), "day", "invoice_id")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        first = first.select("carrier_id", "invoice_number", F.struct("f.day", "f.invoice_id").alias("by_number"))
        again = numbered.join(first, ["carrier_id", "invoice_number"]).filter("by_number.invoice_id != invoice_id").select(*own, "by_number")
        got = _freight_repeats(dated, [], own, config).join(again, own, "full_outer")
    got = got.withColumn("first", F.coalesce("by_freight", "by_number"))
    return got.select(*own, F.col("first.invoice_id").alias("first_id"), F.col("first.day").alias("first_date"), F.when(F.col("by_freight").isNotNull(), "same shipment or BOL, total within tolerance").otherwise("same carrier and invoice number").alias("why"))


def _repeats_at_home(pool: DataFrame, config: Config) -> DataFrame:
    """home, invoice_id, by_freight (of freights with at most FEW invoices, unless marked as _far), by_number of all invoices, by two windows within their homes; both are a day and an invoice."""
    t = config.tolerances
    freight, number = Window.partitionBy("home", "key").orderBy("invoice_id"), Window.partitionBy("home", "carrier_id", "invoice_number").orderBy(F.col("day").isNull(), "day", "invoice_id")
    d = pool.withColumns({"_n": F.count(F.lit(1)).over(freight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_all": F.collect_list(F.struct("day", "invoice_id", "total")).over(freight.rowsBetween(-FEW, FEW))})
    start, limit = F.date_sub("day", t.duplicate_window_days), money(t.duplicate_amount)
    earlier = lambda e: (e["day"] >= start) & ((e["day"] < F.col("day")) | ((e["day"] == F.col("day")) & (e["invoice_id"] < F.col("invoice_id")))) & (F.abs(F.col("total") - e["total"]) <= limit)
    here = F.col("_far").isNull() if "_far" in pool.columns else F.lit(True)
    d = d.withColumn("_few", F.when((F.col("_n") > 1) & (F.col("_n") <= FEW) & here, F.array_min(F.filter("_all", earlier))))
    few = F.when(F.col("_few").isNotNull(), F.struct("_few.day", "_few.invoice_id"))
    d = d.select("home", "invoice_id", "carrier_id", "invoice_number", "day", few.alias("by_freight")).withColumn("_first", F.first(F.struct("day", "invoice_id")).over(number))
    again = F.col("carrier_id").isNotNull() & F.col("invoice_number").isNotNull() & (F.col("_first.invoice_id") != F.col("invoice_id"))
    return d.select("home", "invoice_id", "by_freight", F.when(again, F.col("_first")).alias("by_number"))


def _freight_repeats(dated: DataFrame, near: list[str], own: list[str], config: Config) -> DataFrame:
    """The same of freights of any size, by the points and series of ``duplicate_pairs``; ``near`` names the home where a freight has one, ``own`` the columns that identify an invoice."""
    t = config.tolerances
    width, days = max(float(t.duplicate_amount), 0.01), max(int(t.duplicate_window_days), 1)
    many = dated.groupBy(*near, "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*near, "key")
    points = dated.join(many, [*near, "key"]).groupBy(*near, "key", "day", "total").agg(F.min("invoice_id").alias("first"))
    amount, at = F.col("total").cast("decimal(28,4)"), F.datediff("day", F.lit("2000-01-01").cast("date"))
    wide = F.lit(str(2 * width)).cast("decimal(28,4)")
    reach = F.lit(str(width)).cast("decimal(28,4)")
    x = lambda c: F.floor(c / wide).cast("long")
    y = lambda c: F.floor(c / (2 * days)).cast("long")
    both = lambda low, high: F.explode(F.array_distinct(F.array(low, high)))
    later = points.select(*near, "key", "day", "total", both(x(amount - reach), x(amount + reach)).alias("x")).withColumn("y", both(y(at - days), y(at)))
    series = points.groupBy(*near, "key", x(amount).alias("x"), y(at).alias("y"), F.col("total").alias("total_a")).agg(F.array_sort(F.collect_list(F.struct("day", F.col("first").alias("a")))).alias("days"))
    meet = later.join(series, [*near, "key", "x", "y"]).filter(F.abs(F.col("total") - F.col("total_a")) <= money(t.duplicate_amount))
    start = F.date_sub("day", t.duplicate_window_days)
    before = F.get(F.filter("days", lambda e: (e["day"] >= start) & (e["day"] < F.col("day"))), F.lit(0))
    today = F.get(F.filter("days", lambda e: e["day"] == F.col("day")), F.lit(0))["a"]
    best = meet.groupBy(*near, "key", "day", "total").agg(F.min(before).alias("before"), F.min(today).alias("today"))
    found = F.when(F.col("before").isNotNull(), F.struct("before.day", F.col("before.a").alias("invoice_id"))).when(F.col("today") < F.col("invoice_id"), F.struct("day", F.col("today").alias("invoice_id")))
    return dated.select(*own, "key", "day", "total").join(best, [*near, "key", "day", "total"]).select(*own, found.alias("by_freight")).filter("by_freight is not null")


@rule("duplicate_invoice")
def duplicate_invoice(c: AuditContext) -> DataFrame:
    pairs = duplicate_pairs(c.books, c.config)
    inv = c.books.invoices.select(*ids(c.books.invoices), "shipment_id", "total")
    d = pairs.join(inv, ids(pairs, inv))
    reason = F.concat(F.lit("Repeats "), "first_id", F.lit(" received "), F.coalesce(F.col("first_date").cast("string"), F.lit("on an unknown date")), F.lit(" ("), "why", F.lit("): "), usd(F.col("total")))
    return flags(d, "duplicate_invoice", reason, F.col("total"), F.col("total"), F.lit(0), F.col("first_id"))


@rule("phantom_invoice")
def phantom_invoice(c: AuditContext) -> DataFrame:
    d = live(c.books.invoices).filter("shipment_id is null")
    reason = F.concat(F.lit("No shipment for BOL "), F.coalesce("bol_raw", F.lit("(none)")), F.lit(" of "), "carrier_id", F.lit(": "), usd(F.col("total")))
    return flags(d, "phantom_invoice", reason, F.col("total"), F.col("total"), F.lit(0))


@rule("rate_overcharge")
def rate_overcharge(c: AuditContext) -> DataFrame:
    d = c.rerated.filter(rate_hit(F.lit(c.config.tolerances.rate_pct), c.config))
    reason = F.concat(F.lit("Linehaul "), usd(F.col("billed_lh")), F.lit(" vs contract "), usd(F.col("lh_at_billed")), F.lit(" at "), F.format_number("billed_weight_lbs", 0), F.lit(" lb (rate version "), F.col("version").cast("string"), F.lit("): +"), usd(F.col("rate_gap")))
    return flags(d, "rate_overcharge", reason, F.col("rate_impact"), F.col("billed_lh"), F.col("lh_at_billed"))


@rule("fsc_mismatch")
def fsc_mismatch(c: AuditContext) -> DataFrame:
    t = c.config.tolerances
    d = c.rerated.filter(ltl_fuel_hit(F.lit(t.fsc_ltl_pp), c.config) | tl_fuel_hit(F.lit(t.fsc_tl_pct), c.config))
    detail = F.when(F.col("mode") == "LTL", F.concat(pct(ratio(F.col("billed_fsc"), F.col("billed_lh"))), F.lit(" of linehaul vs "), pct(F.col("fsc_pct_expected")))).otherwise(F.concat(F.lit("over "), F.format_number("miles", 0), F.lit(" miles")))
    reason = F.concat(F.lit("Fuel "), usd(F.col("billed_fsc")), F.lit(" vs expected "), usd(F.col("fsc_expected")), F.lit(" (week of "), F.col("diesel_week").cast("string"), F.lit(", "), F.coalesce(detail, F.lit("no linehaul")), F.lit("): +"), usd(F.col("fsc_impact")))
    return flags(d, "fsc_mismatch", reason, F.col("fsc_impact"), F.col("billed_fsc"), F.col("fsc_expected"))


@rule("unauthorized_accessorial")
def unauthorized_accessorial(c: AuditContext) -> DataFrame:
    d = c.accessorials.filter("auth_status = 'unauthorized'")
    reason = F.concat(title(F.col("charge_code")), F.lit(" "), usd(F.col("amount")), F.lit(" without an authorization on file for "), "shipment_id", F.lit(" as of "), F.col("as_of").cast("string"))
    return flags(d, "unauthorized_accessorial", reason, F.col("amount"), F.col("amount"), F.lit(0))


@rule("weight_overbilling")
def weight_overbilling(c: AuditContext) -> DataFrame:
    d = c.rerated.filter(weight_hit(F.lit(c.config.tolerances.weight_pct)))
    reason = F.concat(F.lit("Billed "), F.format_number("billed_weight_lbs", 0), F.lit(" lb vs "), F.when(F.col("certified_weight_lbs").isNotNull(), "certified ").otherwise("shipped "), F.format_number("reference_weight_lbs", 0), F.lit(" lb: +"), usd(F.col("weight_impact")))
    return flags(d, "weight_overbilling", reason, F.col("weight_impact"), F.col("billed_weight_lbs"), F.col("reference_weight_lbs"))


# the predicates take the swept tolerance as a column, so that a grid joins in one pass


def _d(c: Column) -> Column:
    return c.cast("decimal(12,6)")


def rate_hit(rate_pct: Column, config: Config) -> Column:
    return F.col("rate_gap") > F.greatest(money(config.tolerances.rate_abs).cast("decimal(28,8)"), (_d(rate_pct) * F.col("lh_at_billed")).cast("decimal(28,8)"))


def ltl_fuel_hit(pp: Column, config: Config) -> Column:
    """Billed percentage over the expected one by more than ``pp`` points (multiplied out, no division) and more than the dollar floor."""
    over = (F.col("billed_fsc") - F.col("billed_lh") * F.col("fsc_pct_expected")) * 100
    return (F.col("mode") == "LTL") & (F.col("billed_lh") > 0) & (over > _d(pp) * F.col("billed_lh")) & (F.col("fsc_impact") > money(config.tolerances.fsc_min_dollars))


def tl_fuel_hit(share: Column, config: Config) -> Column:
    return (F.col("mode") == "TL") & (F.col("fsc_impact") > F.greatest(money(config.tolerances.fsc_tl_abs).cast("decimal(28,8)"), (_d(share) * F.col("fsc_expected")).cast("decimal(28,8)")))


def weight_hit(share: Column) -> Column:
    return (F.col("mode") == "LTL") & (F.col("billed_weight_lbs") > F.col("reference_weight_lbs") * (F.lit(1) + _d(share)))


def run_rules(c: AuditContext, rules: dict[str, Callable] | None = None) -> DataFrame:
    return united([f(c) for f in (rules or RULES).values()])


def rule_order(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in ERROR_TYPES]), c)


def count_recoverable(found: DataFrame) -> DataFrame:
    """The flags with counted_in_recoverable: an invoice's first whole-invoice flag counts alone; otherwise all its flags do."""
    w = Window.partitionBy(*ids(found)).orderBy(rule_order(F.col("error_type")), "related_invoice_id", "reason")
    whole = F.col("error_type").isin(*WHOLE_INVOICE)
    d = found.withColumn("_whole", whole).withColumn("_nth", F.sum(whole.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_any", F.max(whole).over(Window.partitionBy(*ids(found))))
    return d.withColumn("counted_in_recoverable", F.when(F.col("_any"), F.col("_whole") & (F.col("_nth") == 1)).otherwise(True)).drop("_whole", "_nth", "_any")


def invoice_summary(counted: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per live invoice: flags, error types in order of name, and the recoverable dollars, at most its total."""
    own = ids(counted, invoices)
    per = counted.groupBy(*own).agg(F.count(F.lit(1)).alias("n_flags"), F.array_join(F.array_sort(F.collect_set("error_type")), ";").alias("error_types"), F.sum(F.when(F.col("counted_in_recoverable"), F.col("dollar_impact"))).cast(MONEY).alias("sum"))
    d = live(invoices).select(*own, "carrier_id", "invoice_number", "invoice_type", "match_method", "shipment_id", "total").join(per, own, "left")
    return d.withColumns({"n_flags": F.coalesce("n_flags", F.lit(0)), "error_types": F.coalesce("error_types", F.lit("")), "recoverable": F.when(F.col("sum").isNotNull(), F.least("sum", "total")).otherwise(F.lit(0)).cast(MONEY)}).drop("sum")


def process_metrics(accessorials: DataFrame) -> DataFrame:
    """Four rows: accessorial lines in all, on time, late and unauthorized."""
    one = lambda s: F.coalesce(F.sum(F.when(F.col("auth_status") == s, F.col("line_count"))), F.lit(0)).cast("long")
    d = accessorials.agg(F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("accessorial_lines"), one("authorized").alias("authorized_on_time"), one("authorized_late").alias("authorized_late"), one("unauthorized").alias("unauthorized"))
    return d.unpivot([], d.columns, "metric", "value")


def audit(books: Books, config: Config, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counted flags, the invoice summary and the process metrics."""
    c = context(books, config, keep)
    counted = keep(count_recoverable(run_rules(c)))
    return counted, invoice_summary(counted, books.invoices), process_metrics(c.accessorials)


# ---------------------------------------------------------------- the naive baseline


def naive_books(books: Books, keep: Callable[[DataFrame], DataFrame] | None = None) -> Books:
    """The same books as a naive audit sees them: digits-only BOL match, the first rate row of a lane, no certificates, no supersession. ``keep`` may persist or write the matches that differ."""
    from ..functions.text import digits

    first = Window.partitionBy("carrier_id", "lane_id").orderBy("effective_from", "version")
    card = books.rate_card.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k").withColumns({"effective_from": F.lit("0001-01-01").cast("date"), "effective_to": F.lit("9999-12-31").cast("date")})
    own, seen = ids(books.invoices), books.invoices.withColumn("_bol", digits(F.col("bol_raw")))
    inv = exact_match(seen, books.shipments.select("shipment_id", "carrier_id", digits(F.col("bol")).alias("_bol")), "_bol", "_naive")
    if keep:  # most matches are those of the books
        other = keep(inv.filter(~F.col("_naive").eqNullSafe(F.col("shipment_id"))).select(*own, F.struct("_naive").alias("_other")))
        inv = seen.join(other, own, "left").withColumn("_naive", F.when(F.col("_other").isNotNull(), F.col("_other._naive")).otherwise(F.col("shipment_id"))).drop("_other")
    inv = inv.withColumn("shipment_id", F.col("_naive")).drop("_naive").withColumns({"match_method": F.when(F.col("shipment_id").isNotNull(), "exact").otherwise("unmatched"), "is_superseded": F.lit(False), "superseded_on": F.lit(None).cast("date")})
    return books.with_(rate_card=card, certificates=books.certificates.limit(0), invoices=inv)


def naive_audit(books: Books, config: Config, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The baseline's flags: the rules on naive books (``keep`` may persist or write what several rules read), authorizations only up to the invoice date, every later carrier-BOL repeat a
    duplicate, and a weight error priced as a rate error (linehaul is compared at the shipped weight)."""
    n = naive_books(books, keep)
    rerated = rerate_invoices(n, config).withColumns({"rate_gap": (F.col("billed_lh") - F.col("lh_at_reference")).cast(MONEY), "rate_impact": (F.col("billed_lh") - F.col("lh_at_reference")).cast(MONEY), "lh_at_billed": F.col("lh_at_reference")})
    t = config.tolerances
    hit = rate_hit(F.lit(t.rate_pct), config) | ltl_fuel_hit(F.lit(t.fsc_ltl_pp), config) | tl_fuel_hit(F.lit(t.fsc_tl_pct), config) | weight_hit(F.lit(t.weight_pct))
    rerated = keep(rerated.filter(hit).select(*ids(rerated), *RERATED))
    c = AuditContext(n, rerated, keep(accessorial_lines(n, "invoice_date").filter("auth_status = 'unauthorized'")), config)
    again = naive_repeats(n.invoices)
    dup = flags(again, "duplicate_invoice", F.concat(F.lit("Same carrier and BOL digits as "), "first_id"), F.col("total"), F.col("total"), F.lit(0), F.col("first_id"))
    return united([dup, *(f(c) for k, f in RULES.items() if k != "duplicate_invoice")])


def naive_repeats(invoices: DataFrame) -> DataFrame:
    """The invoices after the first (by receipt, then id) of their carrier and BOL digits, with first_id. Only those whose digits are in several homes leave theirs."""
    d = invoices.filter("_bol != ''").select(*ids(invoices), "carrier_id", "_bol", "received_date", "total", "shipment_id")

    def later(d: DataFrame, *at: str) -> DataFrame:
        w = Window.partitionBy(*at, "carrier_id", "_bol").orderBy(F.col("received_date").asc_nulls_last(), "invoice_id")
        return d.withColumn("first_id", F.first("invoice_id").over(w)).filter("first_id != invoice_id")

    if "home" not in d.columns:
        return later(d)
    keyed = d.withColumn("key", F.concat(F.coalesce(F.concat(F.length("carrier_id").cast("string"), F.lit(":"), "carrier_id"), F.lit("-")), F.lit(":"), "_bol"))
    far, _ = crossing(keyed, "key")
    if far is None:
        return later(d, "home")
    here, there = (later(keyed.join(far, ["home", "key"], how).drop("key"), *at) for how, at in (("left_anti", ["home"]), ("left_semi", [])))
    return united([here, come_home(there, d)])
