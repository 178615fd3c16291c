"""Invoices with a home give what they give without one, and nothing of theirs is shuffled again."""

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from wharfline.config import Config
from wharfline.operators import rules
from wharfline.operators.resolve import match_shipments, supersede
from wharfline.plans import catalogue, projection
from wharfline.session import lay, store

SHIPS = "shipment_id string, carrier_id string, bol string"


def invoices(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        pro = str(rng.randrange(25))
        bol = rng.choice([pro, pro, str(rng.randrange(40)), None])
        kind = rng.choice(["original", "original", "rebill", "balance_due"])
        day = rng.choice([None, *[datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(12))] * 9])
        rows.append((f"i{k:03}", f"C{int(pro) % 3}", bol, kind, day, rng.choice([None, pro, pro, pro, pro]), pro))
    return spark.createDataFrame(rows, "invoice_id string, carrier_id string, bol_canonical string, invoice_type string, received_date date, pro_number string, home string").withColumn("invoice_number", F.col("pro_number")).withColumn("supersedes_invoice_number", F.lit(None).cast("string"))


def rows(d, *columns):
    return sorted(tuple(map(str, r)) for r in d.select(*columns).collect())


def test_matches_and_replacements_with_and_without_a_home(spark):
    for seed, twice in ((1, False), (2, True)):
        inv = invoices(spark, seed)
        ships = [(str(k), f"C{k % 3}", str(k)) for k in range(0, 40, 2)] + [("99", "C1", "13"), ("98", "C2", None)] + [("07", "C0", "0")] * twice
        ships = spark.createDataFrame(ships, SHIPS)
        what = ("invoice_id", "shipment_id", "match_method", "is_superseded", "superseded_on", "superseded_by", "target_id")
        run = lambda d: rows(supersede(match_shipments(d, ships, None, Config().tolerances)), *what)  # noqa: E731, B023
        got = run(inv)
        assert got == run(inv.drop("home"))
        assert any(r[1] == "99" for r in got) and any(r[3] == "True" for r in got)


def test_nothing_is_shuffled_again(spark, tmp_path):
    day = datetime.date(1998, 1, 5)
    spark.createDataFrame([(k, k % 7, day + datetime.timedelta(k % 300)) for k in range(400)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, k * 3 + n, k * 5 + n, n, Decimal("0.05"), Decimal("0.02"), "R" if n == 3 else "N", "O", day + datetime.timedelta(20 + n)) for k in range(400) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount decimal(4,2), l_tax decimal(4,2), l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    books, v = projection.books(spark, str(tmp_path), store, lay, 8)
    plain, _ = projection.books(spark, str(tmp_path), store)
    same = ("invoice_id", "shipment_id", "is_superseded", "superseded_by", "target_id", "total")
    assert rows(books.invoices, *same) == rows(plain.invoices, *same)
    assert rows(rules.duplicate_pairs(books, Config()), "invoice_id", "first_id", "why") == rows(rules.duplicate_pairs(plain, Config()), "invoice_id", "first_id", "why")
    c = catalogue.Case(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = supersede(c.books.invoices)._jdf.queryExecution().executedPlan().toString()
        counted = c.counted.groupBy("home", "invoice_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in done and "Exchange" not in counted
