"""A synthetic shipper year, seeded by hashes: every draw depends on the seed, a stream name and the row's id only, so the same
seed gives the same tables whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.tariff import ltl_fuel_pct, ship_week
from ..functions.text import noisy_bol
from ..operators.books import Books
from .prices import bounded_walk

#: fixed values: shares and sizes of the default world
SHARES = {"liftgate": 0.12, "residential": 0.06, "detention": 0.10, "late": 0.25, "reweigh": 0.015, "rate": 0.03, "fuel": 0.025, "weight": 0.03, "unauthorized": 0.02, "duplicate": 0.015, "phantom": 0.005, "rebill": 0.01, "balance_due": 0.01, "amended": 0.20, "bol_noise": 0.04}
#: fixed values: carriers that err far more often for some months (carrier, error, months after the start, months, share)
SYSTEMIC = (("CARF", "fuel", 3, 3, 0.98), ("CARC", "weight", 6, 3, 0.12))
CENTS = "decimal(18,2)"


def uniform(seed: int, stream: str, *ids) -> Column:
    """A number in [0, 1) from the seed, the stream and the ids."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), *[F.col(i) if isinstance(i, str) else i for i in ids])
    return F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)


def normal(seed: int, stream: str, *ids) -> Column:
    """A standard normal number (Box and Muller)."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed, stream + "/r", *ids))) * F.cos(2 * 3.141592653589793 * uniform(seed, stream + "/a", *ids))


def pick(weights: list[tuple[str, float]], u: Column) -> Column:
    """A choice by cumulative probability."""
    total, at, out = sum(w for _, w in weights), 0.0, None
    for name, w in weights[:-1]:
        at += w / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def world(spark: SparkSession, config: Config) -> tuple[Books, DataFrame]:
    """Books with injected errors and traps, and the answer key (invoice_id, label_kind, label, mode, true_dollar_impact)."""
    seed, n = config.seed, config.shipments
    ltl = [c.carrier_id for c in config.carriers if c.mode == "LTL"]
    tl = [c.carrier_id for c in config.carriers if c.mode == "TL"]
    lanes = spark.range(60).select(F.concat(F.lit("L"), F.lpad((F.col("id") + 1).cast("string"), 2, "0")).alias("lane_id"), "id", (150 + F.floor(uniform(seed, "miles", "id") * 1800)).cast("int").alias("miles"))
    choose = lambda ids, u: F.element_at(F.array(*[F.lit(i) for i in ids]), (F.floor(u * len(ids)) + 1).cast("int"))
    start = F.lit(config.start).cast("date")
    s = spark.range(1, n + 1).select("id", (F.floor(uniform(seed, "lane", "id") * 60)).cast("long").alias("lane"), (uniform(seed, "mode", "id") < 0.2).alias("tl"), F.date_add(start, (F.floor(uniform(seed, "day", "id") * 30.4 * config.months)).cast("int")).alias("ship_date"))
    s = s.join(F.broadcast(lanes.withColumnRenamed("id", "lane")), "lane")
    s = s.select(
        F.format_string("S%07d", "id").alias("shipment_id"), F.lpad((10_000_000 + F.col("id") * 7 % 80_000_000).cast("string"), 8, "0").alias("bol"), "ship_date", "lane_id", F.when(F.col("tl"), "TL").otherwise("LTL").alias("mode"), "miles",
        F.when(F.col("tl"), choose(tl, uniform(seed, "tl", "lane"))).otherwise(choose(ltl, (uniform(seed, "ltl", "lane") * 0.5 + F.floor(uniform(seed, "which", "id") * 2) * 0.5))).alias("carrier_id"),
        F.when(F.col("tl"), 15000 + F.floor(uniform(seed, "w", "id") * 27000)).otherwise(F.least(F.greatest(F.exp(F.lit(7.09) + 0.8 * normal(seed, "w", "id")), F.lit(100.0)), F.lit(7500.0))).cast("int").alias("weight_lbs"),
        F.concat(F.lit("CC-"), (F.col("id") % 5 + 101).cast("string")).alias("cost_center"), "id",
    )
    s = s.withColumn("delivery_date", F.date_add("ship_date", (F.ceil(F.col("miles") / F.when(F.col("mode") == "TL", 550).otherwise(450)) + F.floor(uniform(seed, "transit", "id") * 2)).cast("int")))
    modes = spark.createDataFrame([(c.carrier_id, c.mode) for c in config.carriers], "carrier_id string, mode string")
    pairs = F.broadcast(modes).crossJoin(lanes.select("lane_id", "miles"))
    factor = (0.9 + 0.2 * uniform(seed, "factor", "carrier_id")) * (0.95 + 0.1 * uniform(seed, "noise", "carrier_id", "lane_id"))
    amended = uniform(seed, "amended", "carrier_id", "lane_id") < SHARES["amended"]
    change, middle = 0.94 + 0.14 * uniform(seed, "change", "carrier_id", "lane_id"), F.add_months(start, 6)
    both = pairs.withColumn("f", factor).withColumn("a", amended).select("*", F.explode(F.when(F.col("a"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("version"))
    level = F.when(F.col("version") == 2, F.col("f") * change).otherwise(F.col("f"))
    base = (8 + 0.035 * F.col("miles")) * level
    card = both.select(
        "carrier_id", "lane_id", "mode", "version", F.when(F.col("version") == 1, F.lit("2000-01-01").cast("date")).otherwise(middle).alias("effective_from"), F.when(F.col("a") & (F.col("version") == 1), F.date_sub(middle, 1)).otherwise(F.lit("2099-12-31").cast("date")).alias("effective_to"),
        F.when(F.col("mode") == "LTL", 110).otherwise(450).cast("decimal(10,2)").alias("min_charge"), (2.25 * level).cast("decimal(10,2)").alias("rate_per_mile"), F.lit(True).alias("deficit_weight_rating"),
        *[(base * m).cast("decimal(10,2)").alias(c) for c, m in (("cwt_0_499", 1.35), ("cwt_500_999", 1.15), ("cwt_1000_1999", 1.0), ("cwt_2000_4999", 0.85), ("cwt_5000_7500", 0.72))],
    )
    weeks = spark.range(1).select(F.explode(F.sequence(F.date_sub(ship_week(start), 28), F.date_add(F.add_months(start, config.months), 100), F.expr("interval 7 days"))).alias("week_start"))
    weeks = weeks.withColumn("week_start", ship_week(F.col("week_start")))
    diesel = bounded_walk(weeks, 0.05 * normal(seed, "diesel", "week_start"), 3.8, 3.8, 0.08, 3.25, 5.75).withColumn("price_per_gallon", F.col("price_per_gallon").cast("decimal(10,3)"))
    certs = s.filter((F.col("mode") == "LTL") & (uniform(seed, "reweigh", "id") < SHARES["reweigh"])).select("shipment_id", (F.col("weight_lbs") * (1.05 + 0.15 * uniform(seed, "factor2", "id"))).cast("int").alias("certified_weight_lbs"), F.date_add("ship_date", 1).alias("certified_at"))

    # original invoices: true charges, then additive errors
    from ..functions.money import cents
    from ..functions.tariff import linehaul, tl_fuel
    from ..operators.temporal import effective, with_diesel

    o = with_diesel(effective(s, card, ["carrier_id", "lane_id"], "ship_date"), diesel).join(certs.select("shipment_id", "certified_weight_lbs"), "shipment_id", "left")

    def hit(name: str) -> Column:
        share = F.lit(SHARES[name])
        for carrier, error, after, months, most in SYSTEMIC:
            if error == name:  # the pattern takes precedence over the plain share
                within = F.col("ship_date").between(F.add_months(start, after), F.date_sub(F.add_months(start, after + months), 1))
                share = F.when((F.col("carrier_id") == carrier) & within, most).otherwise(share)
        return uniform(seed, "error/" + name, "id") < share

    o = o.withColumn("true_weight", F.coalesce("certified_weight_lbs", "weight_lbs")).withColumns({"e_weight": (F.col("mode") == "LTL") & hit("weight"), "e_rate": hit("rate"), "e_fuel": hit("fuel"), "e_acc": hit("unauthorized")})
    o = o.withColumn("billed_weight_lbs", F.when(F.col("e_weight"), (F.col("true_weight") * (1.05 + 0.25 * uniform(seed, "inflate", "id"))).cast("int")).otherwise(F.col("true_weight")))
    o = o.withColumns({"lh_true": linehaul(F.col("mode"), F.col("true_weight"), F.col("miles")), "lh_at": linehaul(F.col("mode"), F.col("billed_weight_lbs"), F.col("miles"))})
    o = o.withColumn("lh", F.when(F.col("e_rate"), cents(F.col("lh_at") * (1.03 + 0.12 * uniform(seed, "markup", "id")))).otherwise(F.col("lh_at")))
    pct = ltl_fuel_pct(F.col("diesel_price"))
    o = o.withColumn("fsc_true", F.when(F.col("mode") == "LTL", cents(F.col("lh") * pct)).otherwise(tl_fuel(F.col("miles"), F.col("diesel_price"))))
    o = o.withColumn("fsc", F.when(F.col("e_fuel"), cents(F.col("fsc_true") * (1.05 + 0.1 * uniform(seed, "fuelup", "id")) + 2)).otherwise(F.col("fsc_true")))
    code = F.when(F.col("mode") == "TL", F.when(uniform(seed, "acc", "id") < SHARES["detention"], "DETENTION")).when(uniform(seed, "acc", "id") < SHARES["liftgate"], "LIFTGATE").when(uniform(seed, "acc", "id") < SHARES["liftgate"] + SHARES["residential"], "RESIDENTIAL")
    o = o.withColumn("ordered", code).withColumn("acc_code", F.when(F.col("e_acc") & F.col("ordered").isNull(), F.when(F.col("mode") == "TL", "DETENTION").otherwise("LIFTGATE")).otherwise(F.col("ordered")))
    o = o.withColumn("e_acc", F.col("e_acc") & F.col("ordered").isNull()).withColumn("acc", F.when(F.col("acc_code") == "LIFTGATE", 95).when(F.col("acc_code") == "RESIDENTIAL", 125).when(F.col("acc_code") == "DETENTION", 150).cast(CENTS))
    lag = F.least(F.exp(2.4 + 0.6 * normal(seed, "lag", "id")), F.lit(80.0)).cast("int")
    o = o.withColumn("invoice_date", F.date_add("delivery_date", lag)).withColumn("received_date", F.date_add("invoice_date", F.floor(uniform(seed, "delay", "id") * 6).cast("int")))
    late = uniform(seed, "late", "id") < SHARES["late"]
    auths = o.filter("ordered is not null").select("shipment_id", F.col("ordered").alias("code"), F.when(late, F.date_add("invoice_date", 1 + F.floor(uniform(seed, "late/d", "id") * 45).cast("int"))).otherwise(F.col("delivery_date")).alias("authorized_at"), "id", late.alias("late"))

    kinds = F.array_compact(F.array(F.lit("original"), F.when(uniform(seed, "dup", "id") < SHARES["duplicate"], "duplicate"), F.when(uniform(seed, "rebill", "id") < SHARES["rebill"], "rebill"), F.when(uniform(seed, "bd", "id") < SHARES["balance_due"], "balance_due"), F.when(uniform(seed, "phantom", "id") < SHARES["phantom"], "phantom")))
    v = o.withColumn("kind", F.explode(kinds))
    shift = F.when(F.col("kind") == "duplicate", 5 + F.floor(uniform(seed, "dup/d", "id") * 40)).when(F.col("kind") == "original", 0).otherwise(10 + F.floor(uniform(seed, "fu/d", "id") * 20)).cast("int")
    v = v.withColumn("received_date", F.date_add("received_date", shift)).withColumn("invoice_date", F.date_add("invoice_date", shift))
    v = v.withColumn("lh", F.when(F.array_contains(kinds, "rebill") & (F.col("kind") == "original"), cents(F.col("lh") * 1.05)).otherwise(F.col("lh")))
    invoice_id = F.concat("carrier_id", F.lit(":"), F.substring("kind", 1, 2), F.col("id").cast("string"))
    bol = F.when(F.col("kind") == "phantom", F.lpad((95_000_000 + F.col("id")).cast("string"), 8, "0")).otherwise(F.col("bol"))
    dressed = (F.col("kind") != "phantom") & (uniform(seed, "bol/noise", "id", "kind") < SHARES["bol_noise"])
    style = F.when(dressed, F.floor(uniform(seed, "bol/style", "id", "kind") * 6))
    inv = v.select(
        (F.col("version") == 2).alias("t_amended"), F.col("certified_weight_lbs").isNotNull().alias("t_reweighed"), (F.col("ordered").isNotNull() & late).alias("t_late"), style.alias("t_bol"), invoice_id.alias("invoice_id"), "carrier_id", F.concat(F.lit("N"), F.col("id").cast("string"), F.when(F.col("kind").isin("original", "duplicate") & (uniform(seed, "resend", "id") < 0.5), "").otherwise(F.substring("kind", 1, 1))).alias("invoice_number"), (100_000_000 + F.col("id")).cast("string").alias("pro_number"),
        F.when(style.isNotNull(), noisy_bol(bol, style)).otherwise(bol).alias("bol_raw"), bol.alias("bol_canonical"), F.when(F.col("kind").isin("rebill", "balance_due"), F.col("kind")).otherwise("original").alias("invoice_type"), F.lit(None).cast("string").alias("supersedes_invoice_number"), "invoice_date", "received_date", "ship_date",
        F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("destination"), "billed_weight_lbs", "kind", "lh", "fsc", "acc", "acc_code", "id", "e_weight", "e_rate", "e_fuel", "e_acc", "lh_true", "lh_at", "fsc_true",
    )
    lines = inv.select("invoice_id", F.inline(F.array_compact(F.array(
        F.when(F.col("kind") != "balance_due", F.struct(F.lit("LH").alias("charge_code"), F.col("lh").cast(CENTS).alias("amount"))), F.when(F.col("kind") != "balance_due", F.struct(F.lit("FSC").alias("charge_code"), F.col("fsc").cast(CENTS).alias("amount"))),
        F.when((F.col("kind") != "balance_due") & F.col("acc").isNotNull(), F.struct(F.col("acc_code").alias("charge_code"), F.col("acc").alias("amount"))), F.when(F.col("kind") == "balance_due", F.struct(F.lit("LIFTGATE").alias("charge_code"), F.lit(95).cast(CENTS).alias("amount"))),
    ))))
    bd = inv.filter("kind = 'balance_due'").join(s.select("id", "shipment_id", "delivery_date"), "id").select("shipment_id", F.lit("LIFTGATE").alias("code"), F.col("delivery_date").alias("authorized_at"))
    zero = F.lit(0).cast(CENTS)
    label = lambda kind, name, mode, dollars: F.struct(F.lit(kind).alias("label_kind"), F.lit(name).alias("label"), (F.lit(mode) if isinstance(mode, str) else mode).alias("mode"), dollars.cast(CENTS).alias("true_dollar_impact"))
    plain = F.col("kind") == "original"
    total = F.col("lh") + F.col("fsc") + F.coalesce("acc", zero)
    told = F.array_compact(F.array(
        F.when(F.col("kind") == "duplicate", label("error", "duplicate_invoice", "copy", total)), F.when(F.col("kind") == "phantom", label("error", "phantom_invoice", "bol", total)), F.when(plain & F.col("e_rate"), label("error", "rate_overcharge", "markup", F.col("lh") - F.col("lh_at"))),
        F.when(plain & F.col("e_fuel"), label("error", "fsc_mismatch", "step", F.col("fsc") - F.col("fsc_true"))), F.when(plain & F.col("e_weight"), label("error", "weight_overbilling", "inflated", F.col("lh_at") - F.col("lh_true"))), F.when(plain & F.col("e_acc"), label("error", "unauthorized_accessorial", "none", F.col("acc"))),
        F.when(F.col("kind") == "rebill", label("trap", "rebill", "", zero)), F.when(F.col("kind") == "balance_due", label("trap", "balance_due", "", zero)),
        F.when(plain & F.col("t_amended"), label("trap", "rate_amendment", "", zero)), F.when(plain & F.col("t_reweighed"), label("trap", "documented_reweigh", "", zero)), F.when(plain & F.col("t_late"), label("trap", "late_authorization", "", zero)),
        F.when(F.col("t_bol").isNotNull(), label("trap", "bol_format", F.when(F.col("t_bol") == 2, "zeros_dropped").otherwise("dressed"), zero)),
    ))
    labels = inv.select("invoice_id", F.inline(F.when(F.size(told) > 0, told).otherwise(F.array(label("clean", "clean", "", zero)))))
    totals = lines.groupBy("invoice_id").agg(F.sum("amount").cast(CENTS).alias("total"))
    keep = ["invoice_id", "carrier_id", "invoice_number", "pro_number", "bol_raw", "bol_canonical", "invoice_type", "supersedes_invoice_number", "invoice_date", "received_date", "ship_date", "origin", "destination", "billed_weight_lbs"]
    authorizations = auths.select("shipment_id", "code", "authorized_at").unionByName(bd)
    return Books(s.drop("id"), card, diesel, certs, authorizations, inv.select(keep).join(totals, "invoice_id", "left"), lines), labels
