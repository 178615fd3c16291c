"""Scores, patterns, the queue and the baseline take an invoice's rows where they lie: nothing is dealt by invoice, and a bucket is one file."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wharfline.operators import accruals, action, resolve, rules, scoring
from wharfline.plans import catalogue
from wharfline.session import at_home


@pytest.fixture
def case(spark, tmp_path):
    day = datetime.date(1998, 1, 5)
    spark.createDataFrame([(k, k % 7, day + datetime.timedelta(k % 300)) for k in range(400)], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, k * 3 + n, k * 5 + n, n, Decimal("0.05"), Decimal("0.02"), "R" if n == 3 else "N", "O", day + datetime.timedelta(20 + n)) for k in range(400) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount decimal(4,2), l_tax decimal(4,2), l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield catalogue.Case(spark, str(tmp_path))
    for k, v in before.items():
        spark.conf.set(k, v)


def dealt_by_invoice(spark, d):
    with at_home(spark):
        plan = d._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "invoice_id" in line]


def test_no_report_is_dealt_by_invoice(spark, case):
    c = case
    mode = c.books.invoices.join(c.modes, "carrier_id").select("home", "invoice_id", "mode")
    reports = {
        "recall_by_mode": scoring.recall_by_mode(c.labels, {"engine": c.outcomes}), "carrier_by_type": action.carrier_by_type(c.counted, c.books.invoices),
        "window_rates": action.window_rates(c.books.invoices, c.counted, c.modes, 6), "sweep": scoring.sweep(c.context.rerated, c.labels, mode.hint("broadcast"), c.config),
    }
    assert {k: dealt_by_invoice(spark, d) for k, d in reports.items() if dealt_by_invoice(spark, d)} == {}


def test_a_bucket_of_the_baseline_is_one_file(spark, case):
    c = case
    assert len(c.naive.inputFiles()) <= c.buckets
    assert dealt_by_invoice(spark, scoring.fp_causes(c.labels, c.naive_outcomes)) == []


def test_unions_at_home_keep_their_buckets(spark, case):
    c = case
    with at_home(spark):
        plans = [resolve.supersede(c.views["inv"].withColumn("supersedes_invoice_number", F.lit(None).cast("string"))), rules.naive_audit(c.books, c.config, c.lay), rules.run_rules(c.context)]
        for d in plans:
            assert "Exchange" not in rules.count_recoverable(d.withColumns({k: F.lit("") for k in ("error_type", "related_invoice_id", "reason")}))._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_accruals_are_made_at_home_and_not_computed_again(spark, case, monkeypatch):
    c = case
    again = accruals.accuracy(accruals.accrue(accruals.authorizations_at_delivery(c.books), c.config, c.ends, c.modes), c.actuals, c.config)
    want = sorted(map(str, accruals.sensitivity(c.accuracy, again).collect()))
    with at_home(spark):
        plain = c.books.with_(invoices=c.books.invoices.drop("home"), lines=c.books.lines.drop("home"))
        assert sorted(map(str, c.actuals.collect())) == sorted(map(str, accruals.shipment_actuals(plain, c.counted.drop("home"), c.summary.drop("home")).collect()))
        actuals = accruals.shipment_actuals(c.books, c.counted, c.summary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in actuals
    monkeypatch.setattr(accruals, "population", None)  # the what-if detail differs in its allowance alone
    assert sorted(map(str, c.sensitivity.collect())) == want
