import collections
import csv
import io
import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from wharfline.config import Config
from wharfline.sources.layouts import LAYOUTS, detect
from wharfline.sources.normalize import fix_pivot, normalise
from wharfline.sources.numbered import fields, numbered_records
from wharfline.sources.prices import filled, price_series
from wharfline.sources.render import write_raw
from wharfline.sources.tables import registry, rounded, text_csv, typed_csv, write_tables

CITIES = [("Ames", "IA"), ("St. Cloud", "MN"), ("Gary", "IN"), ("Ft. Dodge", "IA")]


def drawn(seed, carriers, per_carrier):
    """Invoices and charge lines of a seed, as ``render`` takes them."""
    rng = random.Random(seed)
    invoices, lines = [], []
    for carrier in carriers:
        for k in range(per_carrier):
            control, day = f"{carrier[-1]}{seed}{k:03d}", date(2024, 2, 1) + timedelta(rng.randrange(70))
            (o, os_), (d, ds) = rng.sample(CITIES, 2)
            kind = rng.choice(["original", "original", "rebill", "balance_due"])
            codes = ["LH", "FSC", *rng.sample(["LIFTGATE", "RESIDENTIAL", "DETENTION"], rng.randint(0, 2))] if kind != "balance_due" else ["DETENTION"]
            lines += [(carrier, control, c, Decimal(rng.randint(100, 250_000)) / 100) for c in codes]
            invoices.append((carrier, control, f"N{k}", str(rng.randint(10**8, 10**9 - 1)), f"{rng.randint(10**7, 10**8 - 1)}", kind, f"N{k - 1}", day + timedelta(9), day + timedelta(12), day, o, os_, d, ds, rng.randint(100, 19_999), rng.randint(0, 11)))
    return invoices, lines


INVOICE = "carrier_id string, control_id string, invoice_number string, pro_number string, bol_raw string, invoice_type string, supersedes_invoice_number string, invoice_date date, received_date date, ship_date date, origin string, origin_state string, destination string, destination_state string, billed_weight_lbs int, style int"
LINE = "carrier_id string, control_id string, charge_code string, amount decimal(18,2)"
#: a row of one invoice per layout as a carrier writes it, by the layout's own column names
WRITTEN = {
    "A": {"Invoice No": "77", "Pro #": "600000001-BD", "BOL": "BOL# 31-0007", "EDI Ctrl #": "H1", "Inv Date": "02/28/2024", "Ship Date": "02/09/2024", "Origin": "AMES, IA", "Dest": "Ft Dodge", "Weight (lbs)": "812", "Linehaul": "", "Fuel Surcharge": "", "Acc1 Code": "DETENTION", "Acc1 Amt": "61.25", "Acc2 Code": "", "Acc2 Amt": "", "Total": "61.25"},
    "B": {"invoice_number": "78", "pro_number": "600000002", "bill_of_lading": "310008", "doc_id": "H2", "invoice_date": "2024-02-28", "ship_date": "2024-02-09", "origin_city": "Gary", "dest_city": "Ames", "weight_cwt": "8.12", "charge_code": "LH", "amount": "207.40", "invoice_type": "rebill", "supersedes": "12", "invoice_total": "207.40"},
    "C": {"Carrier": "C Express", "Invoice #": "79", "PRO Number": "600000003R", "BOL Number": "00310009", "Transmission ID": "H3", "Invoice Date": "2024-02-28 00:00:00", "Ship Date": "2024-02-09 00:00:00", "Origin": "GARY IN", "Destination": "st cloud MN", "Weight": "1,812 LB", "Linehaul": "$1,207.40", "FSC": "$88.10", "Acc 1": "", "Acc 1 Amount": "", "Acc 2": "", "Acc 2 Amount": "", "Total Due": "$1,295.50"},
    "D": {"Inv Number": "80", "Pro Number": "600000004", "BOL": "BOL#310010", "Control No": "H4", "Inv Date": "28-Feb-24", "Ship Date": "09-Feb-24", "Orig": "ft dodge ia", "Dest": "St. Cloud, MN", "Weight Lbs": "812", "Charge Description": "LINEHAUL", "Amount": "207.40", "Type": "ORIGINAL", "Orig Invoice Ref": "", "Invoice Total": "207.40"},
}


def shipper(spark):
    lanes = spark.createDataFrame([(f"L{i}{j}", a, b) for i, (a, _) in enumerate(CITIES) for j, (b, _) in enumerate(CITIES) if i != j], "lane_id string, origin_city string, destination_city string")
    ships = spark.createDataFrame([], "shipment_id string, bol string, ship_date date, lane_id string, carrier_id string, weight_lbs int")
    return lanes, ships


def save(path, rows, header):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        out.writerows([r[c] for c in header] for r in rows)


def test_drawn_invoices_come_back_from_every_layout(spark, tmp_path):
    invoices, lines = drawn(5, ["CARA", "CARB", "CARC", "CARD"], 25)
    config = Config()
    glob = write_raw(spark.createDataFrame(invoices, INVOICE), spark.createDataFrame(lines, LINE), config, f"file://{tmp_path}/raw")
    lanes, ships = shipper(spark)
    receipts = spark.createDataFrame([(i[0], i[1], i[8]) for i in invoices], "carrier_id string, control_id string, received_date date")
    n = normalise(spark, glob, config, lanes, ships, receipts)
    got = {r.invoice_id: r for r in n.invoices.collect()}
    assert len(got) == 100
    total = collections.Counter()
    for c, k, _, a in lines:
        total[f"{c}:{k}"] += a
    for i in invoices:
        r = got[f"{i[0]}:{i[1]}"]
        assert (r.invoice_number, r.pro_number, r.bol_canonical, r.invoice_type, r.invoice_date, r.received_date, r.ship_date, r.origin, r.destination, r.billed_weight_lbs, r.total, r.totals_ok) == (i[2], i[3], i[4], i[5], i[7], i[8], i[9], i[10], i[12], i[14], total[r.invoice_id], True)
    assert collections.Counter((r.invoice_id, r.charge_code, r.amount) for r in n.lines.collect()) == collections.Counter((f"{c}:{k}", code, a) for c, k, code, a in lines)
    # rows are numbered in each file, after its header
    per_file = collections.defaultdict(list)
    for r in got.values():
        per_file[r.source_file].append(r.csv_row)
    assert all(min(v) == 2 for v in per_file.values())
    assert {r.exception_type for r in n.exceptions.collect()} <= {"rebill_target_not_found"}
    table = {(r.fix_type, r.unit): r for r in fix_pivot(n.fixes, ["CARA", "CARB", "CARC", "CARD"]).collect()}
    assert table["cwt_to_lbs", "invoice"].CARB == 25 and table["cwt_to_lbs", "invoice"].CARA == 0 and table["date_parsing", "date field"].CARD == 50


def test_written_rows_and_bad_rows(spark, tmp_path):
    good = {"A": "CARA", "B": "CARB", "C": "CARC", "D": "CARD"}
    for name, carrier in good.items():
        row = WRITTEN[name]
        own = LAYOUTS[name].columns
        change = lambda n, **new: {**row, own["control_id"]: f"{row[own['control_id']]}-{n}", **{own[k]: v for k, v in new.items()}}  # noqa: B023, E731
        rows = [row, change(1, invoice_date="31/31/2024"), change(2, weight="heavy"), change(3, bol="?", origin="Nowhere\nat all"), change(4, total="n/a"), change(5, ship_date="soon", weight="-")]
        if not LAYOUTS[name].wide:
            rows += [change(6, charge="MYSTERY"), change(6, charge=row[own["charge"]], amount="x1"), change(7), change(7, total="1.00")]
        save(tmp_path / carrier / "f.csv", rows, sorted(row) if name in "AD" else list(row))
    save(tmp_path / "CARE" / "f.csv", [{"what": "1", "is": "2"}], ["what", "is"])
    text = (tmp_path / "CARB" / "f.csv").read_text()
    (tmp_path / "CARB" / "g.csv").write_text(text.split("\n")[0] + '\n\n79,"never closed')
    lanes, ships = shipper(spark)
    receipts = spark.createDataFrame([("CARA", "H1", date(2024, 3, 4))], "carrier_id string, control_id string, received_date date")
    n = normalise(spark, f"file://{tmp_path}/*/*.csv", Config(), lanes, ships, receipts)
    got = {r.control_id: r for r in n.invoices.collect()}
    first = lambda r: (r.pro_number, r.bol_canonical, r.invoice_type, str(r.invoice_date), str(r.ship_date), r.origin, r.destination, r.billed_weight_lbs, r.total)
    assert first(got["H1"]) == ("600000001", "00310007", "balance_due", "2024-02-28", "2024-02-09", "Ames", "Ft. Dodge", 812, Decimal("61.25")) and got["H1"].received_date == date(2024, 3, 4)
    assert first(got["H2"]) == ("600000002", "00310008", "rebill", "2024-02-28", "2024-02-09", "Gary", "Ames", 812, Decimal("207.40")) and got["H2"].supersedes_invoice_number == "12"
    assert first(got["H3"]) == ("600000003", "00310009", "rebill", "2024-02-28", "2024-02-09", "Gary", "St. Cloud", 1812, Decimal("1295.50"))
    assert first(got["H4"]) == ("600000004", "00310010", "original", "2024-02-28", "2024-02-09", "Ft. Dodge", "St. Cloud", 812, Decimal("207.40"))
    assert {k.split("-")[1] for k in got if "-" in k} == {"3", "4", "6", "7"}
    told = {(r.source_file, r.csv_row, r.exception_type, r.raw_value) for r in n.exceptions.collect()}
    for carrier in good.values():
        f = f"{carrier}/f.csv"
        want = {(3, "unparseable_date", "31/31/2024"), (4, "unparseable_weight", "heavy"), (5, "unparseable_bol", "?"), (5, "unknown_city", "Nowhere\nat all"), (6, "unparseable_total", "n/a"), (7, "unparseable_date", "soon"), (7, "unparseable_weight", "-")}
        assert {(f, *w) for w in want} <= told
    for f in ("CARB/f.csv", "CARD/f.csv"):
        assert {(f, 8, "unmapped_charge", "MYSTERY"), (f, 9, "unparseable_amount", "x1"), (f, 10, "inconsistent_total", "207.40")} <= told
    assert ("CARE/f.csv", 1, "unrecognized_header", "what,is") in told and ("CARB/g.csv", 2, "unclosed_quote", "") in told
    assert detect(list(LAYOUTS["A"].header)) is LAYOUTS["A"] and detect(["x"]) is None


def test_records_are_numbered_as_a_csv_reader_counts_them(spark, tmp_path):
    """Random files with quoted line feeds, quotes within fields, blank lines and marks, in splits down to a dozen bytes, against Python's reader."""
    rng = random.Random(4)
    want = {}
    for k in range(24):
        rows = []
        for _ in range(rng.randint(0, 25)):
            cells = []
            for _ in range(3):
                t = rng.choice(['5" x', 'x"y', 'a""b']) if rng.random() < 0.3 else "".join(rng.choice('ab,"\n é') for _ in range(rng.randint(0, 6)))
                cells.append('"' + t.replace('"', '""') + '"' if any(c in t for c in ",\n") or t.startswith('"') or rng.random() < 0.2 else t)
            rows.append(",".join(cells))
        body = "".join(r + rng.choice(["\n", "\n", "\r\n", "\n\n"]) for r in rows) + ('open,"never\nclosed, x' if k % 7 == 0 else "")
        path = tmp_path / f"F{k % 3}" / f"{k}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes((("\ufeff" if k % 5 == 0 else "") + body).encode())
        read = [r for r in csv.reader(io.StringIO(body.replace("\r\n", "\n"), newline="")) if r]
        want |= {(f"F{k % 3}/{k}.csv", i + 2 - 1): [c or "" for c in (r + [""] * 3)[:3]] for i, r in enumerate(read[: -1 if k % 7 == 0 else None])}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("31", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            records, unclosed = numbered_records(spark, f"file://{tmp_path}/*/*.csv")
            got = {(r.source_file, r.csv_row): [c or "" for c in r.v] for r in records.withColumn("v", fields(F.col("record"), 3)).collect()}
            assert got == want and unclosed.count() == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_price_series(spark, tmp_path):
    import pytest

    f = tmp_path / "p.csv"
    f.write_bytes('\ufeff2023-11-07,4.366\nWeekly retail prices,U.S.\n11/14/2023,4.294\n"Nov 20, 2023",4.209\nDec-04-2023,4.092\n12-Dec-2023,3.987\n13-Dec-2023,3.990\n20231218,3.894\nnot a date,1\n2023-12-25,n/a\n'.encode())
    got = [(str(r.week_start), float(r.price_per_gallon)) for r in price_series(spark, f"file://{f}").collect()]
    assert got == [("2023-11-06", 4.366), ("2023-11-13", 4.294), ("2023-11-20", 4.209), ("2023-12-04", 4.092), ("2023-12-11", 3.99), ("2023-12-18", 3.894)]
    # the span's first Monday has no price of its own: the one before it counts
    whole = filled(price_series(spark, f"file://{f}"), date(2023, 11, 27), date(2023, 12, 11))
    assert [float(r.price_per_gallon) for r in whole.orderBy("week_start").collect()] == [4.209, 4.092, 3.99]
    with pytest.raises(ValueError, match="covers 2023-11-06"):
        filled(price_series(spark, f"file://{f}"), date(2023, 1, 2), date(2023, 12, 11))
    f.write_text("title only\n")
    with pytest.raises(ValueError, match="no row"):
        price_series(spark, f"file://{f}")


def test_bounded_walk(spark):
    from pyspark.sql import functions as F

    from wharfline.sources.prices import bounded_walk, shock

    weeks = spark.range(60).select(F.expr("date_add(date'2023-10-02', cast(id * 7 as int))").alias("week_start"), (F.sin(F.col("id") * 1.7) / 2).alias("step")).repartition(5)
    got = bounded_walk(weeks, F.col("step"), 3.9, 3.7, 0.1, 3.4, 4.2, shock(F.col("week_start"), "2023-12-01", 0.6, 4, 3)).orderBy("week_start").collect()
    rows = weeks.orderBy("week_start").collect()
    walk, want = 3.9, []
    for i, r in enumerate(rows):
        if i:
            walk = min(max(walk + 0.1 * (3.7 - walk) + r.step, 3.4), 4.2)
        j = (r.week_start - date(2023, 12, 4)).days // 7
        up = 0.6 * j / 4 if 0 <= j <= 4 else 0.6 * (1 - (j - 4) / 3) if 4 < j <= 7 else 0
        want.append(round(min(max(walk + up, 3.4), 4.2), 3))
    assert [r.price_per_gallon for r in got] == want


def test_tables(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("shipment_id,bol,ship_date,miles,note\n007,00000012,2025-03-04,500,\n008,,bad,x,\"a, b\"\n")
    r = typed_csv(spark, f"file://{f}").orderBy("shipment_id").collect()
    assert (r[0].shipment_id, r[0].bol, str(r[0].ship_date), r[0].miles, r[0].note) == ("007", "00000012", "2025-03-04", 500, "") and r[1].ship_date is None and r[1].miles is None
    assert text_csv(spark, f"file://{f}", ["shipment_id", "bol", "ship_date", "miles", "note"]).count() == 2
    write_tables({"x": spark.range(3).toDF("id")}, f"file://{tmp_path}/out", "csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/x").count() == 3
    found = registry(spark, f"file://{tmp_path}", ["t"])
    assert found["t"].count() == 2 and spark.sql("select shipment_id from t where miles = 500").first()[0] == "007"
    assert tuple(rounded(spark.sql("select 0.123456D as a, cast(1.005 as decimal(18,3)) as b, 7 as c")).first()) == (0.1235, Decimal("1.01"), 7)


def test_synthetic_run_and_stream(spark, tmp_path):
    from wharfline.plans.audit_run import STAGES, key_findings, render, run, summary, write_run
    from wharfline.sources.stages import read_stage
    from wharfline.sources.synthetic import world
    from wharfline.streaming.ingest import invoice_stream, start

    config = Config(shipments=400, months=3)
    books, labels = world(spark, config)
    t = run(books, config, labels)
    m = {r.error_type: r for r in t["eval_by_type"].collect()}
    traps = {r.trap: r.invoices for r in t["trap_false_flags"].collect()}
    assert {"rebill", "balance_due", "rate_amendment", "documented_reweigh", "late_authorization", "bol_format"} >= set(traps) - {"(clean)"} and len(traps) >= 5
    assert m["ALL"].engine_precision > m["ALL"].baseline_precision and m["ALL"].engine_recall > 0.6
    assert sorted(map(tuple, world(spark, config)[1].collect())) == sorted(map(tuple, labels.collect()))
    s = summary(t)
    assert s["audit"]["audited"] > 0 and render("{{audit.audited|int}} audited", s).endswith("audited")
    lines = key_findings(t, config)
    assert len(lines) == 3 and "systemic" in lines[0] or "pattern" in lines[0] and lines[2].startswith("The accrual error of")
    told = write_run(t, f"file://{tmp_path}/run")
    assert {n for m_ in told.values() for n in m_} == {n for names in STAGES.values() for n in names} == set(t)
    assert write_run(t, f"file://{tmp_path}/again") == told
    files = {str(f.relative_to(tmp_path / "run")): f.read_bytes() for f in (tmp_path / "run").rglob("*") if f.is_file() and f.suffix != ".crc"}
    assert files == {str(f.relative_to(tmp_path / "again")): f.read_bytes() for f in (tmp_path / "again").rglob("*") if f.is_file() and f.suffix != ".crc"} and len(files) > len(t)
    assert read_stage(spark, f"file://{tmp_path}/run/audit", check=True)["audit_flags"].count() == t["audit_flags"].count()
    t["invoices"].write.parquet(f"file://{tmp_path}/in")
    q = start(invoice_stream(spark, f"file://{tmp_path}/in", t["invoices"].schema), books, config, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() > 0


def test_systemic_carriers_are_found(spark):
    from pyspark.sql import functions as F

    from wharfline.operators import action, rules
    from wharfline.operators.resolve import match_shipments, supersede
    from wharfline.sources.synthetic import world
    from wharfline.session import store

    config = Config(shipments=6000, months=9)
    books, _ = world(spark, config)
    books = books.with_(**{k: store(getattr(books, k)) for k in ("shipments", "rate_card", "diesel", "certificates", "authorizations", "lines")})
    books = books.with_(invoices=store(supersede(store(match_shipments(books.invoices, books.shipments, None, config.tolerances)))))
    counted = store(rules.count_recoverable(rules.run_rules(rules.context(books, config, store))))
    modes = spark.createDataFrame([(c.carrier_id, c.mode) for c in config.carriers], "carrier_id string, mode string")
    found = store(action.systemic_findings(books.invoices, counted, modes, config))
    assert ("CARF", "fsc_mismatch") in {(r.carrier_id, r.error_type) for r in found.collect()}
    d = action.finding_dollars(found, counted, books.invoices).filter("carrier_id = 'CARF' and error_type = 'fsc_mismatch'").first()
    assert d.window_invoices >= found.filter("carrier_id = 'CARF' and error_type = 'fsc_mismatch'").first().flagged and d.window_recoverable > 0
    assert action.finding_text(found).filter(F.col("text").startswith("CARF")).count() == 1
