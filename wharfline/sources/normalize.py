"""Raw carrier files to invoices and charge lines, with every fix counted and every problem kept as a row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import canonical_bol, city_key, lookup, parse_date, parse_money, parse_weight, pro_parts, without_state
from ..operators.resolve import match_shipments, supersede, totals
from ..session import store
from .layouts import LAYOUTS, Layout
from .numbered import fields, numbered_records


@dataclass(frozen=True)
class Normalised:
    """invoices, lines(invoice_id, charge_code, amount), fixes(carrier_id, fix_type, unit, count), exceptions(source_file, csv_row, carrier_id, control_id, exception_type, raw_value, detail)."""

    invoices: DataFrame
    lines: DataFrame
    fixes: DataFrame
    exceptions: DataFrame


def read_layouts(spark: SparkSession, paths: str | list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows of all files under ``paths`` (globs) by layout, and the exceptions that concern whole files.

    A file's layout follows from its header, whatever folder it lies in, and its columns may stand in any order. Rows have the layout's field names, source_file, csv_row (the record's
    number, the header being 1) and folder. Unknown headers and files that end inside quotes are told.
    """
    records, unclosed = numbered_records(spark, paths)
    width = max(len(x.header) for x in LAYOUTS.values()) + 1
    heads = records.filter("csv_row = 1").withColumn("_f", fields(F.col("record"), width))
    names = F.filter(F.array(*[F.col(f"_f.c{k}") for k in range(width)]), lambda c: c.isNotNull())
    layout = F.coalesce(*[F.when(F.array_sort(names) == F.array(*[F.lit(c) for c in sorted(x.header)]), F.lit(x.name)) for x in LAYOUTS.values()])
    heads = store(heads.select("file", "folder", "source_file", F.col("record").alias("header"), names.alias("names"), layout.alias("layout")), "headers")
    rows = store(records.filter("csv_row > 1").join(heads.filter("layout is not null").select("file", "layout", "names"), "file"), "records")
    found: dict[str, DataFrame] = {}
    for r in sorted(heads.filter("layout is not null").select("layout", "names").distinct().collect()):  # orders of columns in use
        known = LAYOUTS[r.layout]
        back = {c: f for f, c in known.columns.items()}
        own = rows.filter((F.col("layout") == r.layout) & (F.col("names") == F.array(*[F.lit(c) for c in r.names]))).withColumn("v", fields(F.col("record"), len(r.names)))
        part = own.select(*[F.coalesce(F.col(f"v.c{k}"), F.lit("")).alias(back.get(c, c)) for k, c in enumerate(r.names)], "source_file", "csv_row", "folder")
        found[r.layout] = found[r.layout].unionByName(part) if r.layout in found else part
    told = heads.filter("layout is null").select("source_file", F.lit(1).alias("csv_row"), F.col("folder").alias("carrier_id"), F.lit("").alias("control_id"), F.lit("unrecognized_header").alias("exception_type"), F.col("header").alias("raw_value"), F.lit("file skipped").alias("detail"))
    file = F.split("file", "/")
    open_ = unclosed.select(F.array_join(F.slice(file, -2, 2), "/").alias("source_file"), F.col("csv_row").cast("int").alias("csv_row"), F.regexp_replace(F.element_at(file, -2), "^[^=]*=", "").alias("carrier_id"), F.lit("").alias("control_id"), F.lit("unclosed_quote").alias("exception_type"), F.lit("").alias("raw_value"), F.lit("record not loaded").alias("detail"))
    return found, told.unionByName(open_)


def _marks(flags: list[tuple[str, str, Column]]) -> Column:
    """An array of (fix_type, unit) of the flags that hold."""
    made = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(t).alias("fix_type"), F.lit(u).alias("unit"))) for t, u, c in flags]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _problems(flags: list[tuple[Column, str, Column, Column]]) -> Column:
    made = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(kind).alias("exception_type"), raw.alias("raw_value"), detail.alias("detail"))) for c, kind, raw, detail in flags]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def parse(raw: DataFrame, layout: Layout, config: Config, cities: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Invoices, lines, fixes and exceptions of one layout's rows (of any number of files)."""
    spellings = {v: c.carrier_id for c in config.carriers for v in (c.carrier_name, *c.variants)}
    names = {c.carrier_id: c.carrier_name for c in config.carriers}
    own_name = "carrier" in layout.columns
    d = raw.withColumn("carrier_id", F.coalesce(lookup(F.col("carrier"), spellings), F.lit("")) if own_name else F.col("folder"))
    city = lambda c: F.coalesce(lookup(city_key(F.col(c)), cities), lookup(without_state(city_key(F.col(c))), cities))

    head = d
    if not layout.wide:
        w = Window.partitionBy("source_file", "control_id")
        head = d.withColumn("_k", F.row_number().over(w.orderBy("csv_row"))).withColumn("_totals", F.size(F.collect_set("total").over(w))).filter("_k = 1")
    if layout.suffix_types:
        pro, suffix = pro_parts(F.col("pro_number"))
        kind, cites = lookup(suffix, layout.suffix_types), F.lit(None).cast("string")
        type_fix = ("invoice_type_from_pro_suffix", "invoice", kind.isNotNull() & (suffix != ""))
    else:
        pro, kind, cites = F.col("pro_number"), lookup(F.col("type"), layout.types), F.nullif(F.col("supersedes"), F.lit(""))
        type_fix = ("invoice_type_text", "invoice", kind.isNotNull() & (F.col("type") != kind))
    h = head.select(
        "*", parse_date(F.col("invoice_date"), layout.date_format).alias("p_invoice"), parse_date(F.col("ship_date"), layout.date_format).alias("p_ship"), parse_weight(F.col("weight"), layout.weight_unit).alias("p_weight"),
        canonical_bol(F.col("bol")).alias("p_bol"), city("origin").alias("p_origin"), city("destination").alias("p_dest"), pro.alias("p_pro"), kind.alias("p_kind"), cites.alias("p_cites"), parse_money(F.col("total")).alias("p_total"),
    )
    fixes = [
        *[("date_parsing", "date field", F.col(p).isNotNull() & (F.col(c) != F.col(p).cast("string"))) for c, p in (("invoice_date", "p_invoice"), ("ship_date", "p_ship"))],
        ("cwt_to_lbs" if layout.weight_unit == "cwt" else "weight_text_cleanup", "invoice", F.col("p_weight").isNotNull() & (F.col("weight") != F.col("p_weight").cast("string"))),
        ("bol_canonicalization", "invoice", F.col("p_bol").isNotNull() & (F.col("bol") != F.col("p_bol"))),
        *[("city_cleanup", "city field", F.col(p).isNotNull() & (F.col(c) != F.col(p))) for c, p in (("origin", "p_origin"), ("destination", "p_dest"))],
        type_fix, ("currency_to_float", "amount field", F.col("total").rlike(r"[$,]")),
    ]
    if own_name:
        fixes.append(("carrier_name_variant", "invoice", (F.col("carrier_id") != "") & (F.col("carrier") != lookup(F.col("carrier_id"), names))))
    bad_type = F.col("p_kind").isNull() | F.col("p_pro").isNull()
    fatal = F.col("p_invoice").isNull() | F.col("p_ship").isNull() | F.col("p_weight").isNull() | bad_type | (F.col("carrier_id") == "")
    gone, kept = F.lit("row dropped"), lambda t: F.lit(t)
    problems = [
        (F.col("p_invoice").isNull(), "unparseable_date", F.col("invoice_date"), gone), (F.col("p_ship").isNull(), "unparseable_date", F.col("ship_date"), gone), (F.col("p_weight").isNull(), "unparseable_weight", F.col("weight"), gone),
        (bad_type, "unparseable_invoice_type", F.col("pro_number"), gone), (F.col("carrier_id") == "", "unknown_carrier_name", F.col("carrier" if own_name else "folder"), gone),
        (~fatal & F.col("p_bol").isNull(), "unparseable_bol", F.col("bol"), kept("kept; cannot match exactly")), (~fatal & F.col("p_origin").isNull(), "unknown_city", F.col("origin"), kept("kept")),
        (~fatal & F.col("p_dest").isNull(), "unknown_city", F.col("destination"), kept("kept")), (~fatal & F.col("p_total").isNull(), "unparseable_total", F.col("total"), kept("kept")),
    ]
    if not layout.wide:
        problems.append((F.col("_totals") > 1, "inconsistent_total", F.col("total"), kept("lines state different totals; the first is used")))
    h = h.withColumns({"fatal": fatal, "marks": _marks(fixes), "problems": _problems(problems)})
    invoice_id = F.concat("carrier_id", F.lit(":"), "control_id")
    invoices = h.filter(~F.col("fatal")).select(
        invoice_id.alias("invoice_id"), "carrier_id", "control_id", "invoice_number", F.col("p_pro").alias("pro_number"), F.col("bol").alias("bol_raw"), F.col("p_bol").alias("bol_canonical"), F.col("p_kind").alias("invoice_type"),
        F.col("p_cites").alias("supersedes_invoice_number"), F.col("p_invoice").alias("invoice_date"), F.col("p_ship").alias("ship_date"), F.col("p_origin").alias("origin"), F.col("p_dest").alias("destination"),
        F.col("p_weight").alias("billed_weight_lbs"), F.col("p_total").alias("total"), "source_file", "csv_row",
    )

    # charge lines: wide files are unpivoted
    if layout.wide:
        pair = lambda code, amount, keep: F.struct(code.alias("charge_raw"), amount.alias("amount_raw"), keep.alias("keep"))
        cells = [pair(F.lit(code), F.col(f"`{c}`"), F.col(f"`{c}`") != "") for code, c in layout.charges.items()] + [pair(F.col(f"`{a}`"), F.col(f"`{b}`"), (F.col(f"`{a}`") != "") | (F.col(f"`{b}`") != "")) for a, b in layout.slots]
        lines = d.select("carrier_id", "control_id", "source_file", "csv_row", F.inline(F.array(*cells))).filter("keep").drop("keep")
    else:
        lines = d.select("carrier_id", "control_id", "source_file", "csv_row", F.col("charge").alias("charge_raw"), F.col("amount").alias("amount_raw"))
    lines = lines.join(invoices.select("source_file", "control_id").distinct(), ["source_file", "control_id"], "left_semi")
    codes = {**config.charges, **{c: c for c in config.charges.values()}}
    lines = lines.withColumns({"code": lookup(F.col("charge_raw"), codes), "value": parse_money(F.col("amount_raw"))})
    lines = lines.withColumns({
        "marks": _marks([("charge_description_to_code", "line", F.col("code").isNotNull() & (F.col("charge_raw") != F.col("code"))), ("currency_to_float", "amount field", F.col("amount_raw").rlike(r"[$,]"))]),
        "problems": _problems([(F.col("code").isNull(), "unmapped_charge", F.col("charge_raw"), F.concat(F.lit("line not loaded, amount "), "amount_raw")), (F.col("code").isNotNull() & F.col("value").isNull(), "unparseable_amount", F.col("amount_raw"), F.lit("line not loaded"))]),
    })
    loaded = lines.filter("code is not null and value is not null").select(F.concat("carrier_id", F.lit(":"), "control_id").alias("invoice_id"), F.col("code").alias("charge_code"), F.col("value").alias("amount"), "source_file")

    marks = h.select("carrier_id", F.explode("marks").alias("m")).unionByName(lines.select("carrier_id", F.explode("marks").alias("m")))
    fixed = marks.select("carrier_id", "m.fix_type", "m.unit")
    told = lambda t: t.select("source_file", "csv_row", "carrier_id", "control_id", F.inline("problems"))
    return invoices, loaded, fixed, told(h).unionByName(told(lines))


def normalise(spark: SparkSession, paths: str | list[str], config: Config, lanes: DataFrame, shipments: DataFrame, receipts: DataFrame) -> Normalised:
    """All files under ``paths`` (globs such as ``raw/*/*.csv``; the folder is the carrier): parsed by layout, de-duplicated, dated by the receipt log, linked and matched.

    Of invoices with one id the first file and row stays, and with it only its own lines. Files with an unknown header are
    skipped and reported. ``lanes`` has lane_id, origin_city, destination_city; ``receipts`` carrier_id, control_id, received_date.
    """
    names = [r[0] for r in lanes.select("origin_city").union(lanes.select("destination_city")).distinct().collect()]  # a shipper's network: tens of cities
    cities = {" ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in n.lower()).split()): n for n in names}
    raw, whole_files = read_layouts(spark, paths)
    columns = "source_file string, csv_row int, carrier_id string, control_id string, exception_type string, raw_value string, detail string"
    told = [whole_files]
    invoices, lines, fixes = [], [], []
    for name, frame in raw.items():
        i, ln, fx, ex = parse(frame, LAYOUTS[name], config, cities)
        invoices.append(i), lines.append(ln), fixes.append(fx), told.append(ex)
    if not invoices:
        raise ValueError(f"no file with a known header under {paths}")
    both = lambda x: reduce(DataFrame.unionByName, x)
    inv = both(invoices).withColumn("_k", F.row_number().over(Window.partitionBy("invoice_id").orderBy("source_file", "csv_row")))
    again = inv.filter("_k > 1").select("source_file", "csv_row", "carrier_id", "control_id", F.lit("duplicate_control_id").alias("exception_type"), F.col("control_id").alias("raw_value"), F.lit("first copy kept").alias("detail"))
    inv = inv.filter("_k = 1").drop("_k")
    ln = both(lines).join(inv.select("invoice_id", "source_file"), ["invoice_id", "source_file"], "left_semi").select("invoice_id", "charge_code", "amount")
    got = receipts.groupBy("carrier_id", "control_id").agg(F.min("received_date").alias("received_date"))
    inv = totals(inv.join(got, ["carrier_id", "control_id"], "left"), ln, config.tolerances.totals)
    inv = supersede(match_shipments(inv, shipments, lanes, config.tolerances))
    row = lambda cond, kind, value, detail: inv.filter(cond).select("source_file", "csv_row", "carrier_id", "control_id", F.lit(kind).alias("exception_type"), value.cast("string").alias("raw_value"), F.lit(detail).alias("detail"))
    told += [
        again, row(F.col("received_date").isNull(), "missing_receipt", F.col("control_id"), "no receipt logged"), row(F.col("total").isNotNull() & ~F.col("totals_ok"), "totals_mismatch", F.col("total"), "charge lines do not add up to the stated total"),
        row((F.col("invoice_type") == "rebill") & F.col("target_id").isNull(), "rebill_target_not_found", F.coalesce("supersedes_invoice_number", "pro_number"), "no earlier invoice to replace"),
    ]
    cited = inv.select(F.col("invoice_id").alias("target_id"), F.col("invoice_number").alias("_cited"))
    inv = inv.join(cited, "target_id", "left").withColumn("supersedes_invoice_number", F.coalesce("supersedes_invoice_number", "_cited")).drop("_cited")
    counted = both(fixes).groupBy("carrier_id", "fix_type", "unit").agg(F.count(F.lit(1)).alias("count"))
    return Normalised(inv, ln, counted, both([t.select(*columns.replace(",", "").split(" ")[::2]) for t in told]))


def fix_pivot(fixes: DataFrame, carriers: list[str]) -> DataFrame:
    """Fixes by carrier, 0 where none."""
    return fixes.groupBy("fix_type", "unit").pivot("carrier_id", carriers).sum("count").na.fill(0)
