"""Invoices as the text rows that carriers send, in the four layouts: the inverse of the normaliser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .layouts import LAYOUTS, Layout

#: fixed values: how layout C writes the time of a date, and what goes before layout D's bill of lading
MIDNIGHT, BOL_MARK = " 00:00:00", "BOL#"


def consecutive(rows: DataFrame, keys: list[str], order: list, name: str, base: int = 0) -> DataFrame:
    """Numbers from ``base`` + 1 within each key, in the given order (which should end in a unique column)."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + base).cast("long"))


def date_text(d: Column, layout: Layout) -> Column:
    if layout.name == "C":
        return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(MIDNIGHT))
    return F.date_format(d, layout.date_format)


def amount_text(x: Column, layout: Layout) -> Column:
    """Dollars with two decimals; layout C has a dollar sign and thousands commas. Null gives an empty cell."""
    plain = F.format_string("$%s", F.format_number(x, 2)) if layout.name == "C" else x.cast("decimal(18,2)").cast("string")
    return F.coalesce(F.when(x.isNotNull(), plain), F.lit(""))


def weight_text(pounds: Column, layout: Layout) -> Column:
    if layout.weight_unit == "cwt":
        return (pounds.cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string")
    return F.concat(F.format_number(pounds, 0), F.lit(" LB")) if layout.name == "C" else pounds.cast("string")


def city_text(city: Column, state: Column, layout: Layout, style: Column) -> Column:
    """The city as the carrier prints it; layout D follows no one style (``style`` picks one of six)."""
    comma, blank = F.concat(city, F.lit(", "), state), F.concat(F.upper(city), F.lit(" "), state)
    if layout.name != "D":
        return {"A": comma, "B": city, "C": blank}[layout.name]
    styles = [comma, blank, F.lower(F.concat_ws(",", city, state)), F.concat(F.replace(city, F.lit(".")), F.lit(" "), state), F.concat(F.upper(comma), F.lit(".")), F.concat(city, F.lit("  "), state)]
    return F.element_at(F.array(*styles), (F.pmod(style, F.lit(len(styles))) + 1).cast("int"))


def bol_text(raw: Column, layout: Layout) -> Column:
    return F.when(F.lower(F.substring(raw, 1, 3)) != "bol", F.concat(F.lit(BOL_MARK), raw)).otherwise(raw) if layout.name == "D" else raw


def render(invoices: DataFrame, lines: DataFrame, layout: Layout, config: Config) -> DataFrame:
    """The rows of files in one layout: carrier_id, month (of receipt), csv_row (line in the file, the header being 1) and the file's columns as text.

    ``invoices`` has carrier_id, control_id (unique per carrier), invoice_number, pro_number, bol_raw, invoice_type, supersedes_invoice_number, invoice_date,
    received_date, ship_date, origin, origin_state, destination, destination_state, billed_weight_lbs and style (a number that picks spellings);
    ``lines`` carrier_id, control_id, charge_code, amount. Wide layouts have a row per invoice and two slots for further charges (more are an error), long ones a row per charge.
    """
    ids = ["carrier_id", "control_id"]
    line = F.struct("charge_code", "amount")
    charges = lines.groupBy(*ids).agg(F.sum("amount").alias("total"), F.array_sort(F.collect_list(line)).alias("lines"))
    d = invoices.join(charges, ids, "left")
    back = {code: kind for kind, code in layout.suffix_types.items()}
    pro = F.concat("pro_number", F.coalesce(*[F.when(F.col("invoice_type") == kind, F.lit(suffix)) for kind, suffix in back.items()])) if back else F.col("pro_number")
    printed = {kind: text for text, kind in layout.types.items()}
    names = F.create_map(*[x for c in config.carriers for x in (F.lit(c.carrier_id), F.array(*[F.lit(v) for v in (c.variants or (c.carrier_name,))]))])
    own = F.element_at(names, F.col("carrier_id"))
    cells: dict[str, Column] = {
        "carrier": F.element_at(own, (F.pmod("style", F.size(own)) + 1).cast("int")), "invoice_number": F.col("invoice_number"), "pro_number": pro, "bol": bol_text(F.col("bol_raw"), layout), "control_id": F.col("control_id"),
        "invoice_date": date_text(F.col("invoice_date"), layout), "ship_date": date_text(F.col("ship_date"), layout), "origin": city_text(F.col("origin"), F.col("origin_state"), layout, F.col("style")),
        "destination": city_text(F.col("destination"), F.col("destination_state"), layout, F.col("style") + 1), "weight": weight_text(F.col("billed_weight_lbs"), layout), "total": amount_text(F.col("total"), layout),
        "supersedes": F.when(F.col("invoice_type") == "rebill", F.col("supersedes_invoice_number")), "charge": F.col("line.charge_code"), "amount": amount_text(F.col("line.amount"), layout),
    }
    if printed:
        cells["type"] = F.coalesce(*[F.when(F.col("invoice_type") == kind, F.lit(text)) for kind, text in printed.items()])
    if layout.name == "D":
        cells["charge"] = F.coalesce(*[F.when(F.col("line.charge_code") == code, F.lit(text)) for text, code in config.charges.items()], F.col("line.charge_code"))
    if layout.wide:
        of = lambda code: F.element_at(F.map_from_entries(F.filter("lines", lambda x: x["charge_code"].isin(*layout.charges))), F.lit(code))
        rest = F.filter("lines", lambda x: ~x["charge_code"].isin(*layout.charges))
        slot = lambda k, part: F.get(rest, F.lit(k))[part]
        fits = F.when(F.size(rest) > len(layout.slots), F.raise_error(F.lit("more further charges than the layout has slots")))
        extra = {c: F.coalesce(fits, amount_text(of(code), layout)) for code, c in layout.charges.items()}
        for k, (code, amount) in enumerate(layout.slots):
            extra |= {code: slot(k, "charge_code"), amount: amount_text(slot(k, "amount"), layout)}
    else:
        d, extra = d.withColumn("line", F.explode("lines")), {}
    month = F.date_format("received_date", "yyyy-MM").alias("month")
    text = d.select("carrier_id", month, "received_date", *[F.coalesce(cells[f], F.lit("")).alias(c) for f, c in layout.columns.items()], *[F.coalesce(v, F.lit("")).alias(c) for c, v in extra.items()])
    order = ["received_date", F.col(f"`{layout.columns['control_id']}`"), *([] if layout.wide else [F.col(f"`{layout.columns['charge']}`"), F.col(f"`{layout.columns['amount']}`")])]
    return consecutive(text, ["carrier_id", "month"], order, "csv_row", 1).withColumn("csv_row", F.col("csv_row").cast("int")).drop("received_date")


def as_raw(rendered: DataFrame, layout: Layout) -> DataFrame:
    """Rendered rows as the normaliser reads them from files."""
    named = {c: f for f, c in layout.columns.items()}
    cols = [F.col(f"`{c}`").alias(named.get(c, c)) for c in rendered.columns if c not in ("carrier_id", "month", "csv_row")]
    return rendered.select(*cols, F.concat_ws("/", "carrier_id", F.concat("month", F.lit(".csv"))).alias("source_file"), "csv_row", F.col("carrier_id").alias("folder"))


def write_raw(invoices: DataFrame, lines: DataFrame, config: Config, path: str) -> str:
    """CSV files per layout, month and carrier (a carrier's month is one file), replacing an earlier run's; returns the glob under which ``normalise`` finds them."""
    for name, layout in LAYOUTS.items():
        carriers = [c.carrier_id for c in config.carriers if c.layout == name]
        if carriers:
            rows = render(invoices.filter(F.col("carrier_id").isin(*carriers)), lines.filter(F.col("carrier_id").isin(*carriers)), layout, config)
            placed = rows.repartition("month", "carrier_id").sortWithinPartitions("month", "carrier_id", "csv_row").drop("csv_row")
            plain = placed.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            plain.partitionBy("month", "carrier_id").csv(f"{path}/layout={name}")
    return f"{path}/layout=*/month=*/carrier_id=*/*.csv"
