"""A random world audited twice: by the engine, and by a few lines of plain Python that price and test one invoice at a time."""

import random
from dataclasses import replace
from datetime import date, timedelta
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from wharfline.config import Config
from wharfline.operators import accruals, action, rules, scoring, temporal
from wharfline.operators.books import Books
from wharfline.operators.resolve import supersede

D = Decimal
DAY_ONE = date(2023, 10, 2)
INV = "invoice_id string, carrier_id string, invoice_number string, pro_number string, bol_raw string, bol_canonical string, invoice_type string, supersedes_invoice_number string, invoice_date date, received_date date, ship_date date, origin string, destination string, billed_weight_lbs int, total decimal(18,2), shipment_id string, match_method string"
CARD = "carrier_id string, lane_id string, mode string, version int, effective_from date, effective_to date, min_charge decimal(10,2), rate_per_mile decimal(10,2), deficit_weight_rating boolean, cwt_0_499 decimal(10,2), cwt_500_999 decimal(10,2), cwt_1000_1999 decimal(10,2), cwt_2000_4999 decimal(10,2), cwt_5000_7500 decimal(10,2)"
FLOORS = (0, 500, 1000, 2000, 5000)
FEES = {"LIFTGATE": D(88), "RESIDENTIAL": D(131), "DETENTION": D(164)}


def cents(x):
    return D(x).quantize(D("0.01"), ROUND_HALF_UP)


class World:
    """Shipments of two carriers on four lanes whose rates change once, with a fuel index that moves every week."""

    def __init__(self, seed, n=48):
        rng = self.rng = random.Random(seed)
        self.card = {}
        for carrier, mode in (("CARB", "LTL"), ("CARG", "TL")):
            for lane in range(4):
                rates = sorted((D(rng.randrange(900, 6200)) / 100 for _ in FLOORS), reverse=True)
                for version, (a, b) in enumerate(((date(2023, 1, 1), date(2024, 1, 14)), (date(2024, 1, 15), date(2030, 12, 31))), 1):
                    level = 1 if version == 1 else D(rng.randrange(88, 115)) / 100
                    self.card[carrier, lane, version] = (a, b, D(rng.randrange(70, 140)), cents(D("2.13") * level), [cents(r * level) for r in rates], rng.random() < 0.5)
        self.fuel = {DAY_ONE + timedelta(7 * w): D(2700 + rng.randrange(0, 1500)) / 1000 for w in range(40)}
        self.ships = {}
        for k in range(n):
            tl = rng.random() < 0.3
            self.ships[f"T{k:02d}"] = ("CARG" if tl else "CARB", rng.randrange(4), rng.randrange(20000, 43000) if tl else rng.randrange(150, 7400), DAY_ONE + timedelta(rng.randrange(150)), rng.randrange(90, 1700))
        self.certified = {s: int(x[2] * D("1.08")) for s, x in self.ships.items() if x[0] == "CARB" and rng.random() < 0.15}
        self.allowed = {s: (rng.choice(sorted(FEES)), self.ships[s][3] + timedelta(rng.randrange(-9, 9))) for s in self.ships if rng.random() < 0.4}

    def linehaul(self, s, weight):
        carrier, lane, _, day, miles = self.ships[s]
        _, _, least, per_mile, rates, deficit = next(v for k, v in self.card.items() if k[:2] == (carrier, lane) and v[0] <= day <= v[1])
        if carrier == "CARG":
            return cents(max(per_mile * miles, least))
        own = max(i for i, f in enumerate(FLOORS) if weight >= f)
        choices = [rates[own] * weight / 100] + ([rates[i] * f / 100 for i, f in enumerate(FLOORS) if f > weight] if deficit else [])
        return cents(max(min(choices), least))

    def fuel_share(self, s):
        day = self.ships[s][3]
        price = self.fuel[day - timedelta(day.weekday())]
        return max(((price - D("1.20")) / D("0.10")).to_integral_value(ROUND_FLOOR), 0) * D("0.009")

    def fuel_for(self, s, linehaul):
        carrier, _, _, day, miles = self.ships[s]
        if carrier == "CARB":
            return cents(linehaul * self.fuel_share(s))
        return cents(max(self.fuel[day - timedelta(day.weekday())] - D("1.25"), 0) * miles / D("6.0"))

    def reference(self, s):
        return self.certified.get(s, self.ships[s][2])

    def bill(self, s, rate=D(1), fuel=D(0), weight=1.0, fee=None):
        pounds = int(self.reference(s) * weight)
        lh = cents(self.linehaul(s, pounds) * rate)
        return {"ship": s, "weight": pounds, "LH": lh, "FSC": self.fuel_for(s, lh) + fuel, "fee": fee, "received": self.ships[s][3] + timedelta(20)}

    def expected(self, x, t):
        """What the rules of the contract say of one bill: error type to dollars."""
        s, out = x["ship"], {}
        ltl = self.ships[s][0] == "CARB"
        at_billed, at_reference, share = self.linehaul(s, x["weight"]), self.linehaul(s, self.reference(s)), self.fuel_share(s)
        gap = x["LH"] - at_billed
        if gap > max(D(str(t.rate_abs)), D(str(t.rate_pct)) * at_billed):
            out["rate_overcharge"] = cents(gap * (1 + share)) if ltl else gap
        over = x["FSC"] - self.fuel_for(s, x["LH"])
        if ltl and (x["FSC"] - x["LH"] * share) * 100 > D(str(t.fsc_ltl_pp)) * x["LH"] and over > D(str(t.fsc_min_dollars)):
            out["fsc_mismatch"] = over
        if not ltl and over > max(D(str(t.fsc_tl_abs)), D(str(t.fsc_tl_pct)) * self.fuel_for(s, x["LH"])):
            out["fsc_mismatch"] = over
        if ltl and x["weight"] > self.reference(s) * (1 + D(str(t.weight_pct))):
            out["weight_overbilling"] = cents((at_billed - at_reference) * (1 + share))
        if x["fee"] and (s not in self.allowed or self.allowed[s][0] != x["fee"]):
            out["unauthorized_accessorial"] = FEES[x["fee"]]
        return out

    def books(self, spark, bills):
        ships = [(s, f"{41_000_000 + k:08d}", x[3], x[3] + timedelta(3), f"N{x[1]}", "TL" if x[0] == "CARG" else "LTL", x[4], x[0], x[2], f"CC-{200 + k % 4}") for k, (s, x) in enumerate(self.ships.items())]
        card = [(c, f"N{lane}", "TL" if c == "CARG" else "LTL", v, a, b, least, per_mile, deficit, *rates) for (c, lane, v), (a, b, least, per_mile, rates, deficit) in self.card.items()]
        rows, lines = [], []
        for i, x in enumerate(bills):
            carrier, _, _, day, _ = self.ships[x["ship"]]
            bol = next(r[1] for r in ships if r[0] == x["ship"])
            parts = [("LH", x["LH"]), ("FSC", x["FSC"]), *([(x["fee"], FEES[x["fee"]])] if x["fee"] else [])]
            lines += [(f"B{i:03d}", c, a) for c, a in parts]
            rows.append((f"B{i:03d}", carrier, f"#{i}", f"R{i}", bol, bol, "original", None, x["received"], x["received"], day, None, None, x["weight"], sum(a for _, a in parts), x["ship"], "exact"))
        frame = spark.createDataFrame
        return Books(
            frame(ships, "shipment_id string, bol string, ship_date date, delivery_date date, lane_id string, mode string, miles int, carrier_id string, weight_lbs int, cost_center string"), frame(card, CARD),
            frame(list(self.fuel.items()), "week_start date, price_per_gallon decimal(10,3)"), frame([(s, w, self.ships[s][3]) for s, w in self.certified.items()], "shipment_id string, certified_weight_lbs int, certified_at date"),
            frame([(s, c, d) for s, (c, d) in self.allowed.items()], "shipment_id string, code string, authorized_at date"), supersede(frame(rows, INV)), frame(lines, "invoice_id string, charge_code string, amount decimal(18,2)"),
        )


def test_rules_against_plain_python(spark):
    w, config = World(31), Config(audit_as_of=date(2024, 9, 30))
    rng = w.rng
    bills = []
    for s in w.ships:
        bills.append(w.bill(s, rate=rng.choice([D(1), D(1), D("1.009"), D("1.01"), D("1.0101"), D("1.07")]), fuel=rng.choice([D(0), D(0), D("0.99"), D("1.01"), D("2.00"), D("2.01"), D("9.5")]), weight=rng.choice([1.0, 1.0, 1.02, 1.03, 1.2]), fee=rng.choice([None, None, *FEES])))
    counted, summary, _ = rules.audit(w.books(spark, bills), config)
    got = {}
    for r in counted.collect():
        got.setdefault(r.invoice_id, {})[r.error_type] = r.dollar_impact
    want = {f"B{i:03d}": e for i, x in enumerate(bills) if (e := w.expected(x, config.tolerances))}
    assert got == want and len({t for e in want.values() for t in e}) == 4
    assert {r.invoice_id: r.recoverable for r in summary.collect() if r.n_flags} == {i: sum(e.values()) for i, e in want.items()}


def test_duplicates_at_the_edges(spark):
    w, config = World(7, 10), Config(audit_as_of=date(2024, 12, 31))
    edges = [(D("0.00"), 1), (D("1.00"), 9), (D("1.01"), 9), (D("0.50"), 120), (D("0.50"), 121)]
    bills = []
    for s, (gap, days) in zip(w.ships, edges):
        first = w.bill(s)
        bills += [first, first | {"LH": first["LH"] + gap, "received": first["received"] + timedelta(days)}]
    counted, _, _ = rules.audit(w.books(spark, bills), config)
    hit = {r.invoice_id for r in counted.collect() if r.error_type == "duplicate_invoice"}
    t = config.tolerances
    assert hit == {f"B{2 * k + 1:03d}" for k, (gap, days) in enumerate(edges) if gap <= D(str(t.duplicate_amount)) and days <= t.duplicate_window_days}


def test_supersession_matches_a_stack(spark):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        for i in range(rng.randint(1, 7)):
            rows.append((f"G{g}-{i}", "C", f"N{g}-{i}", f"P{g}", rng.choice(["original", "rebill", "rebill", "balance_due"]), None, date(2025, 1, 1) + timedelta(rng.randint(0, 4))))
    d = spark.createDataFrame(rows, "invoice_id string, carrier_id string, invoice_number string, pro_number string, invoice_type string, supersedes_invoice_number string, received_date date")
    got = {r.invoice_id: r.target_id for r in supersede(d).collect() if r.invoice_type == "rebill"}
    want = {}
    for g in {r[3] for r in rows}:
        own, gone = [r for r in rows if r[3] == g], set()
        for r in sorted((r for r in own if r[4] == "rebill"), key=lambda r: (r[6], r[0])):
            c = sorted((x[6], x[0]) for x in own if x[4] != "balance_due" and x[6] < r[6] and x[0] not in gone)
            want[r[0]] = c[-1][1] if c else None
            gone |= {want[r[0]]} - {None}
    assert got == want


def test_accruals_know_no_future(spark):
    w = World(13, 24)
    bills = [w.bill(s) | {"received": w.ships[s][3] + timedelta(w.rng.randrange(5, 90))} for s in list(w.ships)[::2]]
    books, config = w.books(spark, bills), replace(Config(), start=date(2023, 10, 1), months=7, audit_as_of=date(2024, 9, 30))
    ends = temporal.month_ends(spark, "2023-10-01", 7)
    modes = spark.createDataFrame([("CARB", "LTL"), ("CARG", "TL")], "carrier_id string, mode string")
    detail = accruals.accrue(books, config, ends, modes)
    got = {(r.month_end, r.shipment_id): r for r in detail.collect()}
    received = {x["ship"]: x["received"] for x in bills}
    last = [r.month_end for r in ends.collect()]
    want = {(m, s) for s, x in w.ships.items() for m in last if x[3] + timedelta(3) <= m and not (s in received and received[s] <= m)}
    assert set(got) == want
    for (_, s), r in got.items():
        lh = w.linehaul(s, w.reference(s) if r.lh_estimate == w.linehaul(s, w.reference(s)) else w.ships[s][2])
        assert r.lh_estimate == lh and r.fsc_estimate == w.fuel_for(s, lh)
    je = accruals.journal(detail, config)
    assert all(r.d == r.c for r in je.groupBy("je_id").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c")).collect())
    assert all(float(r.balance) == 0 for r in accruals.liability_balance(je, config).collect() if r.type == "reversal")
    cut = last[3]
    early = accruals.accrue(books.with_(invoices=books.invoices.filter(F.col("received_date") <= F.lit(cut)), authorizations=books.authorizations.filter(F.col("authorized_at") <= F.lit(cut))), config, ends, modes)
    assert {k: r.accrual_estimate for k, r in got.items() if k[0] <= cut} == {(r.month_end, r.shipment_id): r.accrual_estimate for r in early.collect() if r.month_end <= cut}


def test_scoring(spark):
    labels = spark.createDataFrame([("A", "error", "rate_overcharge", "m", D(105)), ("B", "clean", "clean", "", D(0)), ("C", "error", "rate_overcharge", "m", D(50)), ("X", "superseded", "x", "", D(0)), ("X", "error", "rate_overcharge", "m", D(5))], "invoice_id string, label_kind string, label string, mode string, true_dollar_impact decimal(18,2)")
    flags = spark.createDataFrame([("A", "rate_overcharge", D(100), True, ""), ("B", "rate_overcharge", D(25), True, "")], "invoice_id string, error_type string, dollar_impact decimal(18,2), counted_in_recoverable boolean, reason string")
    m = {r.error_type: r for r in scoring.metrics_by_type(scoring.outcomes(flags, labels)).collect()}
    assert (m["rate_overcharge"].tp, m["rate_overcharge"].fp, m["rate_overcharge"].fn, m["rate_overcharge"].f1) == (1, 1, 1, 0.5)
    assert m["phantom_invoice"].precision is None and m["ALL"].flags == 2 and len(m) == 7


def test_empty_books(spark):
    w = World(3, 4)
    books = w.books(spark, [w.bill(s) for s in w.ships])
    books = books.with_(invoices=books.invoices.limit(0), lines=books.lines.limit(0))
    counted, summary, metrics = rules.audit(books, Config())
    assert counted.isEmpty() and summary.isEmpty() and {r.value for r in metrics.collect()} == {0}
    assert action.exception_queue(counted, books.invoices, summary).isEmpty()


def test_prices_must_be_there(spark):
    w = World(21, 6)
    books = w.books(spark, [])
    assert temporal.pricing_problems(books.shipments, books.rate_card, books.diesel).isEmpty()
    weeks = {d - timedelta(d.weekday()) for d in (x[3] for x in w.ships.values())}
    gone = sorted(weeks)[0]
    with pytest.raises(ValueError, match=f"diesel price for {gone}"):
        temporal.require_priced(books.shipments, books.rate_card, books.diesel.filter(F.col("week_start") != F.lit(gone)))
    with pytest.raises(ValueError, match="rates in force"):
        temporal.require_priced(books.shipments, books.rate_card.unionByName(books.rate_card), books.diesel)
