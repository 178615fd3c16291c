"""Repeats of invoices with a home are found in their homes: by windows, whatever repeats, and with the charges that lie with the invoices."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wharfline.config import Config
from wharfline.operators import rules
from wharfline.operators.books import Books
from wharfline.operators.rerate import charges, rerate_invoices
from wharfline.operators.resolve import spread
from wharfline.plans import projection
from wharfline.session import at_home, lay, store

COLUMNS = "invoice_id string, home string, carrier_id string, invoice_number string, bol_canonical string, shipment_id string, invoice_type string, received_date date, total decimal(18,2), is_superseded boolean"


def drawn(spark, seed, crowd=0):
    rng = random.Random(seed)
    rows = []
    for k in range(240 + crowd):
        home = "crowd" if k < crowd else str(rng.randrange(60))
        day = rng.choice([None, *[datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(200)) for _ in range(9)]])
        total = rng.choice([None, *[Decimal(rng.randrange(9990, 10330)) / 100] * 9])
        ship = rng.choice([home, home, None])
        carrier = rng.choice([None, *["C1"] * 12])
        number = rng.choice([None, f"N{home}-{rng.randrange(3)}", f"N{home}-{rng.randrange(3)}"])
        rows.append((f"i{k:03}", home, carrier, number, rng.choice([None, home]), ship, rng.choice(["original", "rebill", "balance_due"]), day, total, rng.random() < 0.1))
    return spark.createDataFrame(rows, COLUMNS)


def pairs(d):
    found = rules.duplicate_pairs(Books(None, None, None, None, None, d, None), Config())
    return sorted(map(tuple, found.select("invoice_id", "first_id", "why").collect()))


@pytest.mark.parametrize(("seed", "few", "crowd"), [(1, 32, 0), (2, 3, 0), (3, 4, 40)])
def test_repeats_are_the_same_with_and_without_a_home(spark, monkeypatch, seed, few, crowd):
    monkeypatch.setattr(rules, "FEW", few)
    d = drawn(spark, seed, crowd)
    got = pairs(d)
    assert got == pairs(d.drop("home")) and {w[:12] for _, _, w in got} == {"same shipmen", "same carrier"}


def test_keys_in_several_homes_are_seen(spark):
    d = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("c", "2"), (None, "3")], "key string, home string")
    assert spread(d, ["key"], "home") == (True, 2)
    assert spread(d.unionByName(spark.createDataFrame([("b", "2")], d.schema)), ["key"], "home") == (False, 2)
    assert spread(d.filter("false"), ["key"], "home") == (True, 0)


def test_repeats_and_charges_stay_at_home(spark, tmp_path, monkeypatch):
    day = datetime.date(1998, 1, 5)
    spark.createDataFrame([(k, k % 7, day + datetime.timedelta(k % 300)) for k in range(200)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, k * 3 + n, k * 5 + n, max(1, n - 1), Decimal("0.05"), Decimal("0.02"), "R" if n == 3 else "N", "O", day + datetime.timedelta(20 + n)) for k in range(200) for n in (1, 2, 3)]  # numbers repeat
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount decimal(4,2), l_tax decimal(4,2), l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    books, _ = projection.books(spark, str(tmp_path), store, lay, 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with at_home(spark):
            found = rules.duplicate_pairs(books, Config())._jdf.queryExecution().executedPlan().toString()
            rated = rerate_invoices(books, Config())._jdf.queryExecution().executedPlan().toString()
            lined = books.lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in found and "Join" not in found
    assert "Generate" not in rated
    assert "filter(array" not in lined.lower()
    without = books.with_(invoices=books.invoices.drop("billed_lh", "billed_fsc"))
    same = lambda d: sorted(map(str, d.drop("diesel_week").collect()))
    assert same(rerate_invoices(books, Config())) == same(rerate_invoices(without, Config()))
    own = ["invoice_id", "billed_lh", "billed_fsc"]
    assert sorted(map(str, books.invoices.select(*own).collect())) == sorted(map(str, charges(books.lines).select(*own).collect()))
    assert books.lines.filter(F.col("charge_code").isNull()).isEmpty()
