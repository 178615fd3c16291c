"""Some invoices match a shipment that lies elsewhere (orders above 50,000,000, whose BOLs are those of other orders' phantoms): they alone leave their homes."""

import datetime
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from wharfline.operators import accruals, action, resolve, rules
from wharfline.plans import catalogue, projection
from wharfline.session import at_home, store


@pytest.fixture
def case(spark, tmp_path):
    day, keys = datetime.date(1998, 1, 5), [k + far for far in (0, 50_000_000) for k in range(300)]
    spark.createDataFrame([(k, k % 1000 % 3, day + datetime.timedelta(k % 1000 % 150)) for k in keys], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, k * 3 + n, 97 * (k % 50) if n == 2 else k % 1000 * 5 + n, n, Decimal("0.05"), Decimal("0.02"), "R" if n == 3 else "N", "O", day + datetime.timedelta(20 + k % 1000 % 100 + n)) for k in keys for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount decimal(4,2), l_tax decimal(4,2), l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield catalogue.Case(spark, str(tmp_path)), str(tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(d, *without):
    return sorted(map(str, d.drop("home", *without).select(*sorted(set(d.columns) - {"home", *without})).collect()))


def test_results_are_those_without_homes(spark, case):
    c, path = case
    assert c.books.invoices.filter("shipment_id != home").count() > 100
    plain, _ = projection.books(spark, path, store)
    context = rules.context(plain, c.config, store)
    counted = store(rules.count_recoverable(rules.run_rules(context)))
    assert rows(c.counted) == rows(counted)
    assert rows(c.naive) == rows(rules.count_recoverable(rules.naive_audit(plain, c.config, store)))
    assert rows(c.actuals) == rows(accruals.shipment_actuals(plain, counted, rules.invoice_summary(counted, plain.invoices)))
    assert rows(c.detail) == rows(accruals.accrue(plain, c.config, c.ends, c.modes))


def test_only_they_are_dealt(spark, case):
    c, _ = case
    for d in (c.counted, c.naive, c.context.rerated, c.context.accessorials):
        assert len(d.inputFiles()) <= c.buckets
    with at_home(spark):
        for d in (rules.count_recoverable(rules.run_rules(c.context)), rules.count_recoverable(rules.naive_audit(c.books, c.config, c.lay)), accruals.shipment_actuals(c.books, c.counted, c.summary)):
            above = d._jdf.queryExecution().executedPlan().toString().split("Union")
            assert len(above) > 1 and "Exchange" not in above[0]


def test_parts_of_the_queue_are_not_ranked_with_all_of_it(spark, case, monkeypatch):
    c, _ = case
    want = rows(action.top_per_carrier(c.queue, c.config.top_n), "queue_rank"), rows(action.filter_queue(c.queue, ["CAR1"], ["phantom_invoice"]), "queue_rank")
    monkeypatch.setattr(action, "indexed", None)
    monkeypatch.setitem(catalogue._cases, (spark.sparkContext.applicationId, c.sf_dir), (catalogue._state(spark, c.sf_dir), c))
    assert rows(c.top) == want[0] and "WindowGroupLimit" in action.top_per_carrier(c.listed, 3)._jdf.queryExecution().executedPlan().toString()
    assert rows(action.filter_queue(c.listed, ["CAR1"], ["phantom_invoice"])) == want[1]
    for name in ("top_n_per_carrier", "queue_filter"):
        assert catalogue.QUERIES[name](spark, c.sf_dir).columns[-1] in ("recoverable", "error_types")


def test_a_fallback_is_asked_for_once_a_home(spark, case):
    c, _ = case
    ships = c.books.shipments.withColumn("weight_lbs", (F.col("weight_lbs") % 400).cast("int"))
    lanes = ships.select("lane_id", F.concat(F.lit("O"), "lane_id").alias("origin_city"), F.concat(F.lit("D"), "lane_id").alias("destination_city")).distinct()
    inv = c.books.invoices.select("home", "invoice_id", "carrier_id", F.when(F.col("match_method") == "unmatched", F.col("bol_canonical")).alias("bol_canonical"), F.date_add("ship_date", F.length("invoice_id") % 3).alias("ship_date"), (F.col("billed_weight_lbs") % 400).cast("int").alias("billed_weight_lbs")).join(ships.select(F.col("shipment_id").alias("home"), "lane_id"), "home")
    inv = inv.withColumns({"origin": F.concat(F.lit("O"), "lane_id"), "destination": F.concat(F.lit("D"), "lane_id")})
    with at_home(spark):
        got = resolve.match_shipments(inv, ships, lanes, c.config.tolerances)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "invoice_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    same = ("invoice_id", "shipment_id", "match_method")
    assert rows(got.select(*same)) == rows(resolve.match_shipments(inv.drop("home"), ships, lanes, c.config.tolerances).select(*same))
    s, i = ships.collect(), inv.collect()
    found = {r.invoice_id: r.shipment_id for r in got.filter("match_method = 'fallback'").collect()}
    for r in i[::7]:
        fit = [x.shipment_id for x in s if x.carrier_id == r.carrier_id and x.lane_id == r.lane_id and abs((x.ship_date - r.ship_date).days) <= 1 and 50 * abs(r.billed_weight_lbs - x.weight_lbs) <= x.weight_lbs]
        assert r.bol_canonical is not None or found.get(r.invoice_id) == (fit[0] if len(fit) == 1 else None)
    assert len(found) > 20
