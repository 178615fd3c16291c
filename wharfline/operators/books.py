"""What the audit reads: reference tables and normalised invoices."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

#: order of the rules and whether a flag recovers the whole invoice
ERROR_TYPES = ("duplicate_invoice", "phantom_invoice", "rate_overcharge", "fsc_mismatch", "unauthorized_accessorial", "weight_overbilling")
WHOLE_INVOICE = ("duplicate_invoice", "phantom_invoice")
RATED = ("original", "rebill")
ACCESSORIALS = ("LIFTGATE", "RESIDENTIAL", "DETENTION")


def ids(*tables: DataFrame) -> list[str]:
    """The columns that identify an invoice in all of these tables.

    ``home`` is optional: a column that follows from an invoice's id and from its pro number, is the shipment id in most cases, and by which tables may be laid
    out in buckets. Joins, groups and windows that name it beside the id find the same rows as without it, where they already lie.
    """
    return ["home", "invoice_id"] if all("home" in t.columns for t in tables) else ["invoice_id"]


@dataclass(frozen=True)
class Books:
    """shipments(shipment_id, bol, ship_date, delivery_date, lane_id, mode, miles, carrier_id, weight_lbs, cost_center),
    rate_card(carrier_id, lane_id, mode, version, effective_from, effective_to, min_charge, rate_per_mile, deficit_weight_rating, cwt_*),
    diesel(week_start, price_per_gallon), certificates(shipment_id, certified_weight_lbs, certified_at),
    authorizations(shipment_id, code, authorized_at), invoices(invoice_id, carrier_id, invoice_number, pro_number, bol_raw, bol_canonical,
    invoice_type, supersedes_invoice_number, invoice_date, received_date, ship_date, origin, destination, billed_weight_lbs, total and,
    once resolved, is_superseded, superseded_on, shipment_id, match_method), lines(invoice_id, charge_code, amount)."""

    shipments: DataFrame
    rate_card: DataFrame
    diesel: DataFrame
    certificates: DataFrame
    authorizations: DataFrame
    invoices: DataFrame
    lines: DataFrame

    def with_(self, **tables: DataFrame) -> Books:
        return replace(self, **tables)
