"""The books as they were known on a date.

Facts have two times: when they are true and when the shipper learned of them. What is known on a day follows from the second alone, which is declared here per
table; whatever is computed from the known books cannot look ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .books import Books

#: the date on which a row of a table became known
KNOWN = {"shipments": "ship_date", "certificates": "certified_at", "authorizations": "authorized_at", "invoices": "received_date"}
#: columns of a table whose values became known later than their row, and the column that says when
LATER = {"invoices": ("superseded_on", ("is_superseded", "superseded_by", "superseded_on"))}


def _day(day) -> Column:
    return day if isinstance(day, Column) else F.lit(day).cast("date")


def known(table: DataFrame, name: str, day) -> DataFrame:
    """The rows of a table that were known on ``day`` (a date or a column), as they were known then. Rows without a date were never learned of."""
    d = table.filter(F.col(KNOWN[name]) <= _day(day)) if name in KNOWN else table
    if name in LATER:
        on, columns = LATER[name]
        if on in d.columns:
            before = F.col(on).isNull() | (F.col(on) > _day(day))
            d = d.withColumn("_before", before)
            for c in columns:
                if c in d.columns:
                    blank = F.lit(False) if c == "is_superseded" else F.lit(None).cast(d.schema[c].dataType)
                    d = d.withColumn(c, F.when(F.col("_before"), blank).otherwise(F.col(c)))
            d = d.drop("_before")
    return d


def as_known(books: Books, day) -> Books:
    """The books on a day: shipments shipped, certificates and authorizations on file, invoices received, with the replacements known by then; the lines go with their invoices."""
    invoices = known(books.invoices, "invoices", day)
    return books.with_(
        shipments=known(books.shipments, "shipments", day), certificates=known(books.certificates, "certificates", day), authorizations=known(books.authorizations, "authorizations", day),
        invoices=invoices, lines=books.lines.join(invoices.select("invoice_id"), "invoice_id", "left_semi"),
    )
