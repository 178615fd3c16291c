"""The sentences of flags."""

import datetime
from decimal import Decimal

from wharfline.config import Config
from wharfline.operators import rules


def test_percentage_of_linehaul_as_a_double(spark):
    """A quotient that is a tie in decimals and not one in doubles is printed as the double."""
    at = lambda a, b: f"{float(a) / float(b) * 100:.1f}"
    exact = lambda a, b: f"{float(a / b) * 100:.1f}"
    found = [(a, b) for b in (Decimal(k) / 100 for k in range(20000, 60000, 20)) for m in range(2005, 2500, 10) for a in [b * m / 10000] if a == round(a, 2) and at(a, b) != exact(a, b)]
    assert found
    a, b = found[0]
    row = (("i", "s", "LTL", a, b, Decimal("0.100000"), Decimal("1.00"), a - 1, 1, datetime.date(2020, 1, 6)),)
    rerated = spark.createDataFrame(row, "invoice_id string, shipment_id string, mode string, billed_fsc decimal(18,2), billed_lh decimal(18,2), fsc_pct_expected decimal(12,6), fsc_expected decimal(18,2), fsc_impact decimal(18,2), miles int, diesel_week date")
    reason = rules.fsc_mismatch(rules.AuditContext(None, rerated, None, Config())).first().reason
    assert f", {at(a, b)}% of linehaul" in reason, (reason, a, b)
