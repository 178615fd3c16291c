"""The four layouts carriers send, declared as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Layout:
    """``columns`` maps our fields to the file's; wide files have ``charges`` and (code, amount) ``slots``, long ones a charge per row."""

    name: str
    wide: bool
    date_format: str
    weight_unit: str
    columns: dict[str, str]
    charges: dict[str, str] = field(default_factory=dict)
    slots: tuple[tuple[str, str], ...] = ()
    suffix_types: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)

    @property
    def header(self) -> frozenset[str]:
        return frozenset([*self.columns.values(), *self.charges.values(), *[c for s in self.slots for c in s]])


_SAME = {"original": "original", "rebill": "rebill", "balance_due": "balance_due"}
#: fixed values: headers, formats and type marks of each layout
LAYOUTS = {
    "A": Layout(
        "A", True, "MM/dd/yyyy", "lbs",
        {"invoice_number": "Invoice No", "pro_number": "Pro #", "bol": "BOL", "control_id": "EDI Ctrl #", "invoice_date": "Inv Date", "ship_date": "Ship Date", "origin": "Origin", "destination": "Dest", "weight": "Weight (lbs)", "total": "Total"},
        {"LH": "Linehaul", "FSC": "Fuel Surcharge"}, (("Acc1 Code", "Acc1 Amt"), ("Acc2 Code", "Acc2 Amt")), {"": "original", "-C": "rebill", "-BD": "balance_due"},
    ),
    "B": Layout(
        "B", False, "yyyy-MM-dd", "cwt",
        {"invoice_number": "invoice_number", "pro_number": "pro_number", "bol": "bill_of_lading", "control_id": "doc_id", "invoice_date": "invoice_date", "ship_date": "ship_date", "origin": "origin_city", "destination": "dest_city", "weight": "weight_cwt", "charge": "charge_code", "amount": "amount", "type": "invoice_type", "supersedes": "supersedes", "total": "invoice_total"},
        types=_SAME,
    ),
    "C": Layout(
        "C", True, "yyyy-MM-dd HH:mm:ss", "lbs",
        {"carrier": "Carrier", "invoice_number": "Invoice #", "pro_number": "PRO Number", "bol": "BOL Number", "control_id": "Transmission ID", "invoice_date": "Invoice Date", "ship_date": "Ship Date", "origin": "Origin", "destination": "Destination", "weight": "Weight", "total": "Total Due"},
        {"LH": "Linehaul", "FSC": "FSC"}, (("Acc 1", "Acc 1 Amount"), ("Acc 2", "Acc 2 Amount")), {"": "original", "R": "rebill", "B": "balance_due"},
    ),
    "D": Layout(
        "D", False, "dd-MMM-yy", "lbs",
        {"invoice_number": "Inv Number", "pro_number": "Pro Number", "bol": "BOL", "control_id": "Control No", "invoice_date": "Inv Date", "ship_date": "Ship Date", "origin": "Orig", "destination": "Dest", "weight": "Weight Lbs", "charge": "Charge Description", "amount": "Amount", "type": "Type", "supersedes": "Orig Invoice Ref", "total": "Invoice Total"},
        types={"ORIGINAL": "original", "REBILL": "rebill", "BAL DUE": "balance_due"},
    ),
}


def detect(header: list[str]) -> Layout | None:
    """The layout whose columns are exactly the file's, whatever folder it lies in."""
    return next((x for x in LAYOUTS.values() if x.header == frozenset(header)), None)
