"""What each live matched invoice should have cost, split into non-overlapping weight, rate and fuel effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.money import MONEY, cents
from ..functions.tariff import linehaul, ltl_fuel_pct, tl_fuel
from .books import ACCESSORIALS, RATED, Books, ids
from .resolve import by_shipment, live
from .temporal import earliest_as_of, effective, with_diesel


def charges(lines: DataFrame, *more: Column) -> DataFrame:
    """billed_lh and billed_fsc per invoice, and ``more`` aggregates of its lines."""
    one = lambda code: F.coalesce(F.sum(F.when(F.col("charge_code") == code, F.col("amount"))), F.lit(0)).cast(MONEY)
    return lines.groupBy(*ids(lines)).agg(one("LH").alias("billed_lh"), one("FSC").alias("billed_fsc"), *more)


def rerate_invoices(books: Books, config: Config) -> DataFrame:
    """Live matched originals and rebills with contract linehaul at billed and at reference weight, fuel and the three impacts.

    The reference weight is the certified one where a certificate was on file by the audit date. The impacts add up to
    the whole overcharge: weight and rate carry their own fuel (LTL fuel is a percentage of linehaul), fuel is measured on the billed linehaul.
    Where invoices carry their billed_lh and billed_fsc, lines are not read.
    """
    billed = [c for c in ("billed_lh", "billed_fsc") if c in books.invoices.columns]
    inv = live(books.invoices).filter(F.col("shipment_id").isNotNull() & F.col("invoice_type").isin(*RATED)).select(*ids(books.invoices), "carrier_id", "invoice_type", "received_date", "invoice_date", "billed_weight_lbs", "total", "shipment_id", *billed)
    ship = books.shipments.select("shipment_id", "lane_id", "mode", "miles", "weight_lbs", "ship_date")
    cert = books.certificates.filter(F.col("certified_at") <= F.lit(config.audit_as_of)).groupBy("shipment_id").agg(F.max_by("certified_weight_lbs", "certified_at").alias("certified_weight_lbs"))
    r = by_shipment(inv, [ship, cert], lambda d, t, key: d.join(t[0], key).join(t[1], key, "left"))
    r = r if len(billed) == 2 else r.drop(*billed).join(charges(books.lines), ids(inv, books.lines), "left")
    r = with_diesel(effective(r, books.rate_card, ["carrier_id", "lane_id"], "ship_date"), books.diesel)
    f = config.fuel
    r = r.withColumns({"billed_lh": F.coalesce("billed_lh", F.lit(0).cast(MONEY)), "billed_fsc": F.coalesce("billed_fsc", F.lit(0).cast(MONEY)), "reference_weight_lbs": F.coalesce("certified_weight_lbs", "weight_lbs")})
    r = r.withColumns({
        "lh_at_billed": linehaul(F.col("mode"), F.col("billed_weight_lbs"), F.col("miles")), "lh_at_reference": linehaul(F.col("mode"), F.col("reference_weight_lbs"), F.col("miles")),
        "fsc_pct_expected": F.when(F.col("mode") == "LTL", ltl_fuel_pct(F.col("diesel_price"), f.ltl_base, f.ltl_step, f.ltl_pct_per_step)),
    })
    r = r.withColumn("fsc_expected", F.when(F.col("mode") == "LTL", cents(F.col("billed_lh") * F.col("fsc_pct_expected"))).otherwise(tl_fuel(F.col("miles"), F.col("diesel_price"), f.tl_peg, f.tl_mpg)))
    with_fuel = F.lit(1) + F.coalesce("fsc_pct_expected", F.lit(0).cast("decimal(12,6)"))
    r = r.withColumns({
        "rate_gap": (F.col("billed_lh") - F.col("lh_at_billed")).cast(MONEY),
        "rate_impact": cents((F.col("billed_lh") - F.col("lh_at_billed")) * with_fuel),
        "weight_impact": F.when(F.col("mode") == "LTL", cents((F.col("lh_at_billed") - F.col("lh_at_reference")) * with_fuel)).otherwise(F.lit(0).cast(MONEY)),
        "fsc_impact": (F.col("billed_fsc") - F.col("fsc_expected")).cast(MONEY),
    })
    return r.select(
        *ids(r), "carrier_id", "shipment_id", "invoice_type", "invoice_date", "received_date", "mode", "lane_id", "miles", "ship_date", "version", "effective_from", "diesel_week", "diesel_price", "billed_weight_lbs", "weight_lbs", "certified_weight_lbs",
        "reference_weight_lbs", "total", "billed_lh", "billed_fsc", "lh_at_billed", "lh_at_reference", "fsc_pct_expected", "fsc_expected", "rate_gap", "rate_impact", "weight_impact", "fsc_impact",
    )


def accessorial_lines(books: Books, as_of) -> DataFrame:
    """Accessorial lines of live matched invoices (balance dues too) with the earliest authorization known by ``as_of`` (a date, or a column name) and auth_status."""
    inv = live(books.invoices).filter("shipment_id is not null").select(*ids(books.invoices), "carrier_id", "shipment_id", "invoice_type", "invoice_date", "received_date")
    own = ids(inv, books.lines)
    acc = books.lines.filter(F.col("charge_code").isin(*ACCESSORIALS)).groupBy(*own, "charge_code").agg(F.sum("amount").cast(MONEY).alias("amount"), F.count(F.lit(1)).alias("line_count")).join(inv, own)
    acc = acc.withColumn("as_of", F.col(as_of) if isinstance(as_of, str) else F.lit(as_of).cast("date"))
    auth = books.authorizations.select("shipment_id", F.col("code").alias("charge_code"), "authorized_at")
    at = lambda d, t, key: earliest_as_of(d, t[0], [key, "charge_code"], [*ids(d), "charge_code"], "as_of", "authorized_at", "authorized_at")
    acc = by_shipment(acc, [auth], at)
    status = F.when(F.col("authorized_at").isNull(), "unauthorized").when(F.col("authorized_at") > F.col("invoice_date"), "authorized_late").otherwise("authorized")
    return acc.withColumn("auth_status", status)
