"""Duplicates, the banded fallback match and supersession against plain Python, on random books and on hot keys."""

import random
import time
from collections import Counter
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wharfline.config import Config, Tolerances
from wharfline.operators.books import Books
from wharfline.operators.resolve import match_shipments, supersede
from wharfline.operators.rules import duplicate_pairs

DAY = date(2024, 1, 1)
INV = "invoice_id string, carrier_id string, invoice_number string, invoice_type string, received_date date, total decimal(18,2), shipment_id string, bol_canonical string, is_superseded boolean"


def duplicates(rows, amount, days):
    """invoice_id to first_id: the earliest earlier invoice of the same freight within tolerance and window, else of the same carrier and number."""
    order = lambda r: (r[4] is None, r[4] or DAY, r[0])
    pool = sorted((r for r in rows if r[3] in ("original", "rebill") and not r[8]), key=order)
    out = {}
    for i, b in enumerate(pool):
        key = b[6] and ("s", b[6]) or (("b", b[1], b[7]) if b[7] else ("i", b[0]))
        near = [a for a in pool[:i] if (a[6] and ("s", a[6]) or (("b", a[1], a[7]) if a[7] else ("i", a[0]))) == key and a[4] and b[4] and a[5] is not None and b[5] is not None and abs(a[5] - b[5]) <= amount and (b[4] - a[4]).days <= days]
        again = [a for a in pool[:i] if b[2] is not None and (a[1], a[2]) == (b[1], b[2])]
        if near or again:
            out[b[0]] = (near or again)[0][0]
    return out


def books_of(spark, frame):
    return Books(*[None] * 5, frame, None)


def test_duplicates_against_plain_python(spark):
    from decimal import Decimal

    for seed, amount, days in ((1, "1.00", 20), (2, "0.00", 5), (3, "0.05", 0), (4, "7.50", 200)):
        g = random.Random(seed)
        rows = []
        for i in range(700):
            total = None if g.random() < 0.02 else Decimal(g.choice([10000, 10050, 10099, 10100, 10101, 10200, g.randint(9000, 12000)])) / 100
            ship = g.choice(["S1", "S1", "S2", None, f"S{g.randint(3, 60)}"])
            rows.append((f"i{g.randint(0, 10**6):07d}-{i}", g.choice("AB"), g.choice([None, f"n{g.randint(0, 300)}"]), g.choice(["original", "original", "rebill", "balance_due"]), None if g.random() < 0.03 else DAY + timedelta(g.randint(0, 60)), total, ship, g.choice([None, "00000001", "00000002"]), g.random() < 0.05))
        config = Config(tolerances=replace(Tolerances(), duplicate_amount=float(amount), duplicate_window_days=days))
        got = {r.invoice_id: r.first_id for r in duplicate_pairs(books_of(spark, spark.createDataFrame(rows, INV)), config).collect()}
        assert got == duplicates(rows, Decimal(amount), days)


def test_duplicates_of_one_hot_freight(spark):
    """100,000 invoices of one shipment: half of them are one bill sent again and again, the rest lie a few cents apart."""
    n = 100_000
    i = F.col("id")
    d = spark.range(n).select(
        F.format_string("i%06d", i).alias("invoice_id"), F.lit("A").alias("carrier_id"), F.lit(None).cast("string").alias("invoice_number"), F.lit("original").alias("invoice_type"), F.date_add(F.lit(DAY), (i % 365).cast("int")).alias("received_date"),
        F.when(i % 2 == 0, F.lit("500.00")).otherwise((F.lit(50000) + (i * 7919) % 4000) / F.lit(100)).cast("decimal(18,2)").alias("total"), F.lit("S").alias("shipment_id"), F.lit("00000001").alias("bol_canonical"), F.lit(False).alias("is_superseded"),
    )
    began = time.time()
    got = {r.invoice_id: r.first_id for r in duplicate_pairs(books_of(spark, d), Config()).collect()}
    assert time.time() - began < 240
    # a sweep in order of receipt: per total in cents, days and ids still within the window
    rows = sorted((DAY + timedelta(k % 365), f"i{k:06d}", 50000 if k % 2 == 0 else 50000 + k * 7919 % 4000) for k in range(n))
    first, at = {}, {}
    for day, who, cents in rows:
        first.setdefault(cents, []).append((day, who))
    want = {}
    for day, who, cents in rows:
        best = None
        for c in range(cents - 100, cents + 101):
            own = first.get(c)
            if own:
                k = at.get(c, 0)
                while own[k][0] < day - timedelta(120):
                    k += 1
                    if k == len(own):
                        break
                at[c] = min(k, len(own) - 1)
                if k < len(own) and own[k] < (day, who) and (best is None or own[k] < best):
                    best = own[k]
        if best:
            want[who] = best[1]
    assert got == want


MATCH = "invoice_id string, carrier_id string, bol_canonical string, origin string, destination string, ship_date date, billed_weight_lbs int"


@pytest.mark.parametrize("share, days", [(0.02, 1), (0.0, 2), (0.5, 0), (1.0, 1)])
def test_fallback_against_plain_python(spark, share, days):
    g = random.Random(int(share * 100) + days)
    ships = [(f"S{k:04d}", f"{k:08d}", DAY + timedelta(g.randint(0, 12)), g.choice(["L1", "L2"]), g.choice("AB"), g.choice([0, 100, 102, g.randint(1, 9000)])) for k in range(300)]
    lanes = [("L1", "X", "Y"), ("L2", "Y", "X")]
    ends = {k: v for k, *v in lanes}
    invoices = []
    for k in range(400):
        s = g.choice(ships)
        o, d = ends[s[3]]
        invoices.append((f"i{k}", s[4], s[1] if g.random() < 0.2 else None, g.choice([o, None]) if g.random() < 0.1 else o, d, s[2] + timedelta(g.randint(-2, 2)), g.choice([None, 0]) if g.random() < 0.05 else max(0, int(s[5] * g.choice([1, 1, 0.98, 1.02, 1.021, 0.5, 1.5, 2])))))
    tol = replace(Tolerances(), fallback_days=days, fallback_weight_pct=share)
    got = {r.invoice_id: (r.shipment_id, r.match_method) for r in match_shipments(spark.createDataFrame(invoices, MATCH), spark.createDataFrame(ships, "shipment_id string, bol string, ship_date date, lane_id string, carrier_id string, weight_lbs int"), spark.createDataFrame(lanes, "lane_id string, origin_city string, destination_city string"), tol).collect()}
    for i, c, bol, o, d, day, w in invoices:
        exact = [s[0] for s in ships if bol and (s[4], s[1]) == (c, bol)]
        fits = [s[0] for s in ships if s[4] == c and ends[s[3]] == [o, d] and abs((s[2] - day).days) <= days and w is not None and abs(w - s[5]) <= share * s[5] + 1e-9]
        want = (min(exact), "exact") if exact else (fits[0], "fallback") if len(fits) == 1 else (None, "unmatched")
        assert got[i] == want


def test_fallback_on_one_hot_lane(spark):
    """A million shipments of one lane; an invoice has one fit, none or many."""
    i = F.col("id")
    ships = spark.range(1_000_000).select(F.format_string("S%07d", i).alias("shipment_id"), F.format_string("%08d", i).alias("bol"), F.date_add(F.lit(DAY), (i % 300).cast("int")).alias("ship_date"), F.lit("L1").alias("lane_id"), F.lit("A").alias("carrier_id"), F.when(i < 3, 9_000_000 * (i + 1)).otherwise(1000 + i % 4000).cast("int").alias("weight_lbs"))
    invoices = spark.range(20_000).select(F.format_string("i%05d", i).alias("invoice_id"), F.lit("A").alias("carrier_id"), F.lit(None).cast("string").alias("bol_canonical"), F.lit("X").alias("origin"), F.lit("Y").alias("destination"), F.date_add(F.lit(DAY), (i % 300).cast("int")).alias("ship_date"), F.when(i < 3, 9_000_000 * (i + 1)).otherwise(1000 + i % 4000).cast("int").alias("billed_weight_lbs"))
    got = match_shipments(invoices, ships, spark.createDataFrame([("L1", "X", "Y")], "lane_id string, origin_city string, destination_city string"), Tolerances()).filter("shipment_id is not null").collect()
    assert {r.invoice_id: r.shipment_id for r in got} == {f"i{k:05d}": f"S{k:07d}" for k in range(3)}


SUPER = "invoice_id string, carrier_id string, invoice_number string, pro_number string, invoice_type string, supersedes_invoice_number string, received_date date"


def replaced(rows):
    """invoice_id to (superseded_on, by) and rebill to target, in order of receipt."""
    on, target = {}, {}
    for r in sorted((r for r in rows if r[4] == "rebill" and r[6]), key=lambda r: (r[6], r[0])):
        fits = [x for x in rows if x[1] == r[1] and x[4] != "balance_due" and x[6] and x[6] < r[6] and x[0] not in on and (x[2] == r[5] if r[5] else x[3] is not None and x[3] == r[3])]
        if fits:
            x = max(fits, key=lambda x: (x[6], x[0]))
            on[x[0]], target[r[0]] = (r[6], r[0]), x[0]
    return on, target


@pytest.mark.parametrize("seed, cites", [(1, 0.0), (2, 1.0), (3, 0.5), (4, 0.1), (5, 0.9)])
def test_mixed_rebills_against_plain_python(spark, seed, cites):
    """Rebills that cite numbers and rebills that share pro numbers, over the same invoices."""
    g = random.Random(seed)
    rows = []
    for i in range(500):
        kind = g.choice(["original", "original", "rebill", "rebill", "balance_due"])
        number = lambda: g.choice([None, "", *[f"n{g.randint(0, 25)}"] * 6])
        rows.append((f"{g.choice('AB')}:{g.randint(0, 10**6):07d}{i}", g.choice("AB"), number(), g.choice([None, *[f"p{g.randint(0, 30)}"] * 8]), kind, (number() if kind == "rebill" and g.random() < cites else None), None if g.random() < 0.02 else DAY + timedelta(g.randint(0, 40))))
    on, target = replaced(rows)
    got = supersede(spark.createDataFrame(rows, SUPER)).collect()
    assert Counter(r.invoice_id for r in got) == Counter(r[0] for r in rows)
    assert {r.invoice_id: (r.superseded_on, r.superseded_by) for r in got if r.is_superseded} == on
    assert {r.invoice_id: r.target_id for r in got if r.target_id} == target
