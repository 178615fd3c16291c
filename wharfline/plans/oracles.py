"""DuckDB SQL for the catalogue's queries, over the same projection but computed on its own."""

from __future__ import annotations

from ..config import CARRIERS
from .projection import AS_OF, lh_sql, pct_sql, projection, tl_sql

M = "DECIMAL(18,2)"

RESOLVED = f"""
tot AS (SELECT invoice_id, CAST(sum(amount) AS {M}) AS total, CAST(coalesce(sum(amount) FILTER (charge_code = 'LH'), 0) AS {M}) AS lh, CAST(coalesce(sum(amount) FILTER (charge_code = 'FSC'), 0) AS {M}) AS fsc FROM line GROUP BY 1),
sb AS (SELECT carrier_id, bol, min(shipment_id) AS sid FROM ship GROUP BY 1, 2),
mi AS (SELECT i.*, t.total, sb.sid AS shipment_id, CASE WHEN sb.sid IS NULL THEN 'unmatched' ELSE 'exact' END AS match_method
       FROM inv i LEFT JOIN tot t USING (invoice_id) LEFT JOIN sb ON sb.carrier_id = i.carrier_id AND sb.bol = i.bol_canonical),
ev AS (SELECT carrier_id, pro_number, invoice_id, received_date, -1 AS step FROM mi WHERE invoice_type = 'rebill'
       UNION ALL SELECT carrier_id, pro_number, invoice_id, received_date, 1 FROM mi WHERE invoice_type <> 'balance_due'),
e1 AS (SELECT *, sum(step) OVER w AS s, least(min(sum_) OVER w, 0) AS lo FROM (SELECT *, sum(step) OVER w0 AS sum_ FROM ev WINDOW w0 AS (PARTITION BY carrier_id, pro_number ORDER BY received_date, step, invoice_id ROWS UNBOUNDED PRECEDING)) q
       WINDOW w AS (PARTITION BY carrier_id, pro_number ORDER BY received_date, step, invoice_id ROWS UNBOUNDED PRECEDING)),
e2 AS (SELECT *, step < 0 AND s = lo AND lo < coalesce(lag(lo) OVER (PARTITION BY carrier_id, pro_number ORDER BY received_date, step, invoice_id), 0) AS miss FROM e1),
e3 AS (SELECT *, s - lo + CASE WHEN step < 0 THEN 1 ELSE 0 END AS lev FROM e2 WHERE NOT miss),
e4 AS (SELECT *, lag(invoice_id) OVER (PARTITION BY carrier_id, pro_number, lev ORDER BY received_date, step, invoice_id) AS target FROM e3),
lk AS (SELECT invoice_id AS by_, target, received_date AS on_ FROM e4 WHERE step < 0),
bi AS (SELECT mi.*, h.on_ AS superseded_on, h.by_ AS superseded_by, g.target AS target_id, h.on_ IS NOT NULL AS is_superseded
       FROM mi LEFT JOIN lk h ON h.target = mi.invoice_id LEFT JOIN lk g ON g.by_ = mi.invoice_id)"""

PRICED = f"""
ps AS (SELECT s.*, c.version, c.effective_from, c.min_charge, c.rate_per_mile, c.cwt_0_499 AS c0, c.cwt_500_999 AS c1, c.cwt_1000_1999 AS c2, c.cwt_2000_4999 AS c3, c.cwt_5000_7500 AS c4, d.week_start AS week, d.price_per_gallon AS price
       FROM ship s LEFT JOIN card c ON c.carrier_id = s.carrier_id AND c.lane_id = s.lane_id AND s.ship_date BETWEEN c.effective_from AND c.effective_to LEFT JOIN diesel d ON d.week_start = CAST(date_trunc('week', s.ship_date) AS DATE)),
pl AS (SELECT *, {lh_sql("weight_lbs")} AS lh FROM ps),
pr AS (SELECT *, CASE WHEN mode = 'LTL' THEN CAST(round(lh * {pct_sql("price")}, 2) AS {M}) ELSE {tl_sql("price", "miles")} END AS fsc FROM pl)"""

RERATED = f"""
r0 AS (SELECT b.invoice_id, b.carrier_id, b.invoice_type, b.received_date, b.total, b.shipment_id, p.mode, p.miles, p.version, p.min_charge, p.rate_per_mile, p.c0, p.c1, p.c2, p.c3, p.c4, p.price, b.billed_weight_lbs AS bw,
              coalesce(ce.certified_weight_lbs, p.weight_lbs) AS rw, t.lh AS blh, t.fsc AS bfsc
       FROM bi b JOIN ps p USING (shipment_id) LEFT JOIN (SELECT * FROM cert WHERE certified_at <= DATE '{AS_OF}') ce USING (shipment_id) LEFT JOIN tot t USING (invoice_id)
       WHERE NOT b.is_superseded AND b.invoice_type <> 'balance_due'),
r1 AS (SELECT *, {lh_sql("bw")} AS lhb, {lh_sql("rw")} AS lhr, CASE WHEN mode = 'LTL' THEN {pct_sql("price")} END AS pct FROM r0),
r2 AS (SELECT *, CASE WHEN mode = 'LTL' THEN CAST(round(blh * pct, 2) AS {M}) ELSE {tl_sql("price", "miles")} END AS fexp FROM r1),
rr AS (SELECT *, CAST(blh - lhb AS {M}) AS gap, CAST(round((blh - lhb) * (1 + coalesce(pct, 0)), 2) AS {M}) AS rate_i,
              CASE WHEN mode = 'LTL' THEN CAST(round((lhb - lhr) * (1 + coalesce(pct, 0)), 2) AS {M}) ELSE CAST(0 AS {M}) END AS weight_i, CAST(bfsc - fexp AS {M}) AS fsc_i FROM r2)"""


def acc(name: str, source: str, as_of: str) -> str:
    return f"""
{name}0 AS (SELECT l.invoice_id, l.charge_code, CAST(sum(l.amount) AS {M}) AS amount, count(*) AS n, any_value(b.shipment_id) AS shipment_id, any_value(b.invoice_date) AS invoice_date
       FROM line l JOIN {source} b USING (invoice_id) WHERE l.charge_code IN ('LIFTGATE', 'RESIDENTIAL', 'DETENTION') AND b.shipment_id IS NOT NULL AND NOT b.is_superseded GROUP BY 1, 2),
{name} AS (SELECT q.*, CASE WHEN at_ IS NULL THEN 'unauthorized' WHEN at_ > invoice_date THEN 'authorized_late' ELSE 'authorized' END AS st FROM
       (SELECT a.*, (SELECT min(u.authorized_at) FROM auth u WHERE u.shipment_id = a.shipment_id AND u.code = a.charge_code AND u.authorized_at <= {as_of}) AS at_ FROM {name}0 a) q)"""


ACCESSORIAL = acc("ac", "bi", f"DATE '{AS_OF}'")

FLAGS = f"""
po AS (SELECT *, coalesce('SHIP:' || shipment_id, 'BOL:' || carrier_id || ':' || bol_canonical) AS k FROM bi WHERE NOT is_superseded AND invoice_type <> 'balance_due'),
pn AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY received_date, invoice_id) AS rn FROM po),
d1 AS (SELECT b.invoice_id, arg_min(a.invoice_id, a.rn) AS f FROM pn b JOIN pn a ON a.k = b.k AND a.rn < b.rn AND abs(a.total - b.total) <= 1.00 AND b.received_date - a.received_date <= 120 GROUP BY 1),
d2 AS (SELECT invoice_id, f FROM (SELECT invoice_id, first_value(invoice_id) OVER (PARTITION BY carrier_id, invoice_number ORDER BY received_date, invoice_id) AS f FROM po) WHERE f <> invoice_id),
du AS (SELECT coalesce(d1.invoice_id, d2.invoice_id) AS invoice_id, coalesce(d1.f, d2.f) AS f FROM d1 FULL JOIN d2 ON d1.invoice_id = d2.invoice_id),
fl AS (
  SELECT b.invoice_id, 'duplicate_invoice' AS error_type, 1 AS o, b.total AS impact, b.total AS billed, CAST(0 AS {M}) AS expected, du.f AS related FROM du JOIN bi b USING (invoice_id)
  UNION ALL SELECT invoice_id, 'phantom_invoice', 2, total, total, 0, NULL FROM bi WHERE NOT is_superseded AND shipment_id IS NULL
  UNION ALL SELECT invoice_id, 'rate_overcharge', 3, rate_i, blh, lhb, NULL FROM rr WHERE gap > greatest(CAST(2.00 AS DECIMAL(28,8)), 0.01 * lhb)
  UNION ALL SELECT invoice_id, 'fsc_mismatch', 4, fsc_i, bfsc, fexp, NULL FROM rr WHERE (mode = 'LTL' AND blh > 0 AND (bfsc - blh * pct) * 100 > 0.25 * blh AND fsc_i > 1.00) OR (mode = 'TL' AND fsc_i > greatest(CAST(2.00 AS DECIMAL(28,8)), 0.005 * fexp))
  UNION ALL SELECT invoice_id, 'unauthorized_accessorial', 5, amount, amount, 0, NULL FROM ac WHERE st = 'unauthorized'
  UNION ALL SELECT invoice_id, 'weight_overbilling', 6, weight_i, bw, rw, NULL FROM rr WHERE mode = 'LTL' AND bw > rw * 1.02),
co AS (SELECT *, CASE WHEN min(o) OVER (PARTITION BY invoice_id) <= 2 THEN o = min(o) OVER (PARTITION BY invoice_id) ELSE true END AS counted FROM fl),
su AS (SELECT b.invoice_id, b.carrier_id, b.invoice_number, b.invoice_type, b.match_method, b.shipment_id, b.total, b.received_date, coalesce(n, 0) AS n_flags, coalesce(types, '') AS error_types, CAST(CASE WHEN s IS NULL THEN 0 ELSE least(s, b.total) END AS {M}) AS recoverable
       FROM bi b LEFT JOIN (SELECT invoice_id, count(*) AS n, string_agg(DISTINCT error_type, ';' ORDER BY error_type) AS types, sum(impact) FILTER (counted) AS s FROM co GROUP BY 1) f USING (invoice_id) WHERE NOT b.is_superseded)"""

NAIVE = f"""
nb AS (SELECT i.*, t.total, t.lh AS blh_, t.fsc AS bfsc_, s.sid AS shipment_id, false AS is_superseded FROM inv i LEFT JOIN tot t USING (invoice_id) LEFT JOIN (SELECT carrier_id, bol, min(shipment_id) AS sid FROM ship GROUP BY 1, 2) s ON s.carrier_id = i.carrier_id AND s.bol = i.bol_raw),
n0 AS (SELECT b.invoice_id, s.mode, s.miles, c.min_charge, c.rate_per_mile, c.cwt_0_499 AS c0, c.cwt_500_999 AS c1, c.cwt_1000_1999 AS c2, c.cwt_2000_4999 AS c3, c.cwt_5000_7500 AS c4, d.price_per_gallon AS price, b.billed_weight_lbs AS bw, s.weight_lbs AS rw, b.blh_ AS blh, b.bfsc_ AS bfsc
       FROM nb b JOIN ship s ON s.shipment_id = b.shipment_id JOIN (SELECT * FROM card QUALIFY row_number() OVER (PARTITION BY carrier_id, lane_id ORDER BY effective_from, version) = 1) c ON c.carrier_id = b.carrier_id AND c.lane_id = s.lane_id
       LEFT JOIN diesel d ON d.week_start = CAST(date_trunc('week', s.ship_date) AS DATE) WHERE b.invoice_type <> 'balance_due'),
n1 AS (SELECT *, {lh_sql("bw")} AS lhb, {lh_sql("rw")} AS lhr, CASE WHEN mode = 'LTL' THEN {pct_sql("price")} END AS pct FROM n0),
nr AS (SELECT *, CASE WHEN mode = 'LTL' THEN CAST(round(blh * pct, 2) AS {M}) ELSE {tl_sql("price", "miles")} END AS fexp FROM n1),
{acc("na", "nb", "a.invoice_date").strip()},
nf AS (
  SELECT invoice_id, 'duplicate_invoice' AS error_type, total AS impact FROM (SELECT *, first_value(invoice_id) OVER (PARTITION BY carrier_id, bol_raw ORDER BY received_date, invoice_id) AS f FROM nb) WHERE f <> invoice_id
  UNION ALL SELECT invoice_id, 'phantom_invoice', total FROM nb WHERE shipment_id IS NULL
  UNION ALL SELECT invoice_id, 'rate_overcharge', CAST(blh - lhr AS {M}) FROM nr WHERE blh - lhr > greatest(CAST(2.00 AS DECIMAL(28,8)), 0.01 * lhr)
  UNION ALL SELECT invoice_id, 'fsc_mismatch', CAST(bfsc - fexp AS {M}) FROM nr WHERE (mode = 'LTL' AND blh > 0 AND (bfsc - blh * pct) * 100 > 0.25 * blh AND bfsc - fexp > 1.00) OR (mode = 'TL' AND bfsc - fexp > greatest(CAST(2.00 AS DECIMAL(28,8)), 0.005 * fexp))
  UNION ALL SELECT invoice_id, 'unauthorized_accessorial', amount FROM na WHERE st = 'unauthorized'
  UNION ALL SELECT invoice_id, 'weight_overbilling', CASE WHEN mode = 'LTL' THEN CAST(round((lhb - lhr) * (1 + coalesce(pct, 0)), 2) AS {M}) ELSE 0 END FROM nr WHERE mode = 'LTL' AND bw > rw * 1.02)"""

LABELS = f"""
la AS (
  SELECT invoice_id, 'error' AS kind, 'rate_overcharge' AS label, 'markup' AS lmode, 50 AS dollars FROM inv WHERE invoice_type <> 'balance_due' AND l_linenumber % 5 = 0 AND l_discount > 0
  UNION ALL SELECT invoice_id, 'error', 'fsc_mismatch', 'extra', 3 FROM inv WHERE invoice_type <> 'balance_due' AND l_partkey % 17 = 0
  UNION ALL SELECT invoice_id, 'error', 'weight_overbilling', 'inflated', 20 FROM inv WHERE invoice_type <> 'balance_due' AND l_suppkey % 11 = 0 AND mode = 'LTL'
  UNION ALL SELECT invoice_id, 'error', 'phantom_invoice', 'bol', 100 FROM inv WHERE l_suppkey % 97 = 0
  UNION ALL SELECT invoice_id, 'error', 'unauthorized_accessorial', 'none', 95 FROM inv WHERE l_partkey % 7 = 0 AND l_partkey % 3 = 0
  UNION ALL SELECT invoice_id, 'trap', 'rebill', '', 0 FROM inv WHERE invoice_type = 'rebill'
  UNION ALL SELECT invoice_id, 'trap', 'balance_due', '', 0 FROM inv WHERE invoice_type = 'balance_due'
  UNION ALL SELECT invoice_id, 'trap', 'bol_format', 'zeros_dropped', 0 FROM inv WHERE l_suppkey % 13 = 0
  UNION ALL SELECT invoice_id, 'trap', 'late_authorization', '', 0 FROM inv WHERE l_partkey % 7 = 0 AND l_partkey % 60 > 30),
te AS (SELECT invoice_id, label AS error_type, any_value(lmode) AS lmode, CAST(sum(dollars) AS {M}) AS t FROM la WHERE kind = 'error' GROUP BY 1, 2)"""


def scored(name: str, flags: str) -> str:
    return f"""
{name} AS (SELECT coalesce(f.invoice_id, te.invoice_id) AS invoice_id, coalesce(f.error_type, te.error_type) AS error_type, coalesce(f.s, 0) AS flagged, coalesce(te.t, 0) AS truth,
       CASE WHEN f.invoice_id IS NULL THEN 'FN' WHEN te.invoice_id IS NULL THEN 'FP' ELSE 'TP' END AS status
       FROM (SELECT invoice_id, error_type, CAST({flags}) AS s {{source}} GROUP BY 1, 2) f FULL JOIN te ON te.invoice_id = f.invoice_id AND te.error_type = f.error_type)"""


OUTCOMES = LABELS + "," + scored("oc", f"coalesce(sum(impact) FILTER (counted), 0) AS {M}").replace("{source}", "FROM co")
NAIVE_OUTCOMES = LABELS + "," + scored("no", f"sum(impact) AS {M}").replace("{source}", "FROM nf")

ACCRUED = f"""
me AS (SELECT CAST(last_day(DATE '1997-07-01' + to_months(CAST(i AS INTEGER))) AS DATE) AS m FROM range(12) t(i)),
fb AS (SELECT shipment_id, min(received_date) AS first_billed FROM bi WHERE invoice_type <> 'balance_due' AND shipment_id IS NOT NULL GROUP BY 1),
pop AS (SELECT me.m, pr.* FROM pr CROSS JOIN me LEFT JOIN fb ON fb.shipment_id = pr.shipment_id WHERE pr.delivery_date <= me.m AND (first_billed IS NULL OR first_billed > me.m)),
ka AS (SELECT shipment_id, code, min(authorized_at) AS at_ FROM auth GROUP BY 1, 2),
wi AS (SELECT me.m, b.* FROM bi b JOIN me ON b.received_date <= me.m AND b.received_date > me.m - 90 WHERE b.shipment_id IS NOT NULL AND NOT coalesce(b.superseded_on <= me.m, false)),
nn AS (SELECT m, carrier_id, count(DISTINCT shipment_id) AS n FROM wi WHERE invoice_type <> 'balance_due' GROUP BY 1, 2),
dd AS (SELECT wi.m, wi.carrier_id, CAST(sum(l.amount) AS {M}) AS dollars FROM wi JOIN line l USING (invoice_id) JOIN ka ON ka.shipment_id = wi.shipment_id AND ka.code = l.charge_code AND ka.at_ <= wi.m WHERE l.charge_code IN ('LIFTGATE', 'DETENTION') GROUP BY 1, 2),
al AS (SELECT me.m, c.carrier_id, CASE WHEN n > 0 THEN CAST(coalesce(dollars, 0) AS DOUBLE) / n WHEN c.mode = 'LTL' THEN 12.0 ELSE 8.0 END AS a, CASE WHEN n > 0 THEN 'history' ELSE 'default' END AS basis
       FROM me CROSS JOIN (SELECT DISTINCT carrier_id, mode FROM ship) c LEFT JOIN nn ON nn.m = me.m AND nn.carrier_id = c.carrier_id LEFT JOIN dd ON dd.m = me.m AND dd.carrier_id = c.carrier_id),
de AS (SELECT pop.m, pop.shipment_id, pop.carrier_id, pop.cost_center, pop.lh, pop.fsc, CAST(round(CAST(a AS DECIMAL(18,8)), 2) AS {M}) AS ac_, CAST(pop.lh + pop.fsc + CAST(round(CAST(a AS DECIMAL(18,8)), 2) AS {M}) AS {M}) AS est FROM pop JOIN al ON al.m = pop.m AND al.carrier_id = pop.carrier_id)"""

ACTUALS = f"""
us AS (SELECT invoice_id, bool_or(o <= 2) AS whole, CAST(coalesce(sum(impact) FILTER (error_type = 'unauthorized_accessorial'), 0) AS {M}) AS un FROM co WHERE counted GROUP BY 1),
i1 AS (SELECT s.invoice_id, s.shipment_id, s.total, t.lh + t.fsc AS core, s.total - (t.lh + t.fsc) AS ba, s.recoverable AS r, coalesce(us.whole, false) AS whole, coalesce(us.un, 0) AS un
       FROM su s JOIN tot t USING (invoice_id) LEFT JOIN us USING (invoice_id) WHERE s.shipment_id IS NOT NULL),
i2 AS (SELECT *, CASE WHEN whole THEN ba ELSE least(un, ba, r) END AS ra, CASE WHEN whole THEN core ELSE r - least(un, ba, r) END AS rc FROM i1),
sa AS (SELECT shipment_id, count(*) AS n, CAST(sum(total) AS {M}) AS billed, CAST(sum(core) AS {M}) AS core, CAST(sum(ba) AS {M}) AS acc, CAST(sum(ra + rc) AS {M}) AS rec, CAST(sum(total) - sum(ra + rc) AS {M}) AS payable FROM i2 GROUP BY 1)"""

WINDOWS = """
wm AS (SELECT b.invoice_id, b.carrier_id, s.mode, CAST(date_trunc('month', b.ship_date) AS DATE) AS mo FROM bi b JOIN (SELECT DISTINCT carrier_id, mode FROM ship) s USING (carrier_id) WHERE NOT is_superseded),
mo AS (SELECT mo, row_number() OVER (ORDER BY mo) AS i, count(*) OVER () AS c FROM (SELECT DISTINCT mo FROM wm)),
sp AS (SELECT mo.mo, w.w FROM mo JOIN (SELECT i AS w FROM mo WHERE i <= greatest(c - 2, 1)) w ON mo.i BETWEEN w.w AND w.w + 2),
ty AS (SELECT unnest(['duplicate_invoice', 'phantom_invoice', 'rate_overcharge', 'fsc_mismatch', 'unauthorized_accessorial', 'weight_overbilling']) AS error_type),
wn AS (SELECT carrier_id, mode, w, count(*) AS n FROM wm JOIN sp USING (mo) GROUP BY ALL),
wk AS (SELECT carrier_id, w, error_type, count(*) AS k FROM wm JOIN sp USING (mo) JOIN (SELECT DISTINCT invoice_id, error_type FROM co) f USING (invoice_id) GROUP BY ALL),
wc AS (SELECT wn.carrier_id, mode, ty.error_type, wn.w, n, coalesce(k, 0) AS k FROM wn CROSS JOIN ty LEFT JOIN wk ON wk.carrier_id = wn.carrier_id AND wk.w = wn.w AND wk.error_type = ty.error_type),
wr AS (SELECT *, sum(n) OVER p - n AS pn, sum(k) OVER p - k AS pk FROM wc WINDOW p AS (PARTITION BY mode, error_type, w)),
we AS (SELECT w, min(mo) AS a, CAST(last_day(max(mo)) AS DATE) AS b FROM sp GROUP BY 1)"""

_R = [RESOLVED]
_A = [RESOLVED, PRICED, RERATED, ACCESSORIAL, FLAGS]


def sql(parts: list[str], select: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in [projection("duckdb").strip().rstrip(","), *parts]) + "\n" + select


def d(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" if " " not in n else f"CAST({n.split()[0]} AS DOUBLE) AS {n.split()[1]}" for n in names)


def rule_sql(name: str) -> str:
    return sql(_A, f"SELECT invoice_id, {d('impact dollar_impact', 'billed billed_value', 'expected expected_value')}, CAST(related AS VARCHAR) AS related_invoice_id, counted AS counted_in_recoverable FROM co WHERE error_type = '{name}'")


_TAIL = "ln(list_sum([exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}) - ({peak})) FOR i IN range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1)])) + ({peak})"


def tail(k: str, n: str, p: str) -> str:
    peak = f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"
    return _TAIL.format(k=k, n=n, p=p, peak=peak)


SWEEP = f"""
gr AS (SELECT 'rate_pct' AS tolerance, unnest([0.0, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.05]) AS value UNION ALL SELECT 'fsc_ltl_pp', unnest([0.0, 0.1, 0.25, 0.5, 1.0, 2.0]) UNION ALL SELECT 'fsc_tl_pct', unnest([0.0, 0.0025, 0.005, 0.01, 0.02, 0.05]) UNION ALL SELECT 'weight_pct', unnest([0.0, 0.005, 0.01, 0.02, 0.03, 0.05])),
sc AS (SELECT * FROM (VALUES ('rate_pct', 'rate_overcharge', NULL, 0.01), ('fsc_ltl_pp', 'fsc_mismatch', 'LTL', 0.25), ('fsc_tl_pct', 'fsc_mismatch', 'TL', 0.005), ('weight_pct', 'weight_overbilling', 'LTL', 0.02)) t(tolerance, error_type, m, now)),
hi AS (SELECT gr.tolerance, gr.value, sc.error_type, rr.invoice_id, CASE gr.tolerance WHEN 'rate_pct' THEN rate_i WHEN 'weight_pct' THEN weight_i ELSE fsc_i END AS flagged FROM rr CROSS JOIN gr JOIN sc USING (tolerance) WHERE
  (tolerance = 'rate_pct' AND gap > greatest(CAST(2.00 AS DECIMAL(28,8)), CAST(value AS DECIMAL(12,6)) * lhb)) OR (tolerance = 'fsc_ltl_pp' AND mode = 'LTL' AND blh > 0 AND (bfsc - blh * pct) * 100 > CAST(value AS DECIMAL(12,6)) * blh AND fsc_i > 1)
  OR (tolerance = 'fsc_tl_pct' AND mode = 'TL' AND fsc_i > greatest(CAST(2.00 AS DECIMAL(28,8)), CAST(value AS DECIMAL(12,6)) * fexp)) OR (tolerance = 'weight_pct' AND mode = 'LTL' AND bw > rw * (1 + CAST(value AS DECIMAL(12,6))))),
pz AS (SELECT sc.tolerance, count(*) AS pos FROM te JOIN inv USING (invoice_id) JOIN sc ON sc.error_type = te.error_type AND (sc.m IS NULL OR sc.m = inv.mode) GROUP BY 1),
sg AS (SELECT hi.tolerance, hi.value, count(te.invoice_id) AS tp, count(*) - count(te.invoice_id) AS fp, CAST(coalesce(sum(flagged) FILTER (te.invoice_id IS NOT NULL), 0) AS {M}) AS tpd FROM hi LEFT JOIN te ON te.invoice_id = hi.invoice_id AND te.error_type = hi.error_type GROUP BY 1, 2),
sw AS (SELECT gr.tolerance, CAST(gr.value AS DOUBLE) AS value, coalesce(sc.m, 'ALL') AS carrier_mode, gr.value = sc.now AS is_current, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(pos, 0) - coalesce(tp, 0) AS fn, coalesce(tpd, 0) AS tpd,
  CASE WHEN coalesce(tp, 0) + coalesce(fp, 0) > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS pre, CAST(coalesce(tpd, 0) - (coalesce(tp, 0) + coalesce(fp, 0)) * 4.5 - coalesce(fp, 0) * 25 AS {M}) AS net
  FROM gr JOIN sc USING (tolerance) LEFT JOIN sg ON sg.tolerance = gr.tolerance AND sg.value = gr.value LEFT JOIN pz ON pz.tolerance = gr.tolerance)"""

_SCORE = [*_A, OUTCOMES]
_CAUSE = """CASE WHEN error_type = 'unauthorized_accessorial' AND late THEN 'late_authorization' WHEN error_type = 'duplicate_invoice' AND rb THEN 'rebill_balance_due' WHEN error_type = 'phantom_invoice' AND zero THEN 'bol_typo_or_zero' WHEN error_type = 'rate_overcharge' AND wo THEN 'weight_misread_as_rate' ELSE 'other' END"""
_ALL = "(SELECT unnest(['duplicate_invoice', 'phantom_invoice', 'rate_overcharge', 'fsc_mismatch', 'unauthorized_accessorial', 'weight_overbilling', 'ALL']) AS error_type)"

ORACLES: dict[str, str] = {
    "parse_bol": """WITH r AS (SELECT o_orderkey, regexp_replace(CASE WHEN o_orderkey % 5 = 0 THEN 'BOL#' WHEN o_orderkey % 5 = 1 THEN 'bol ' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 9, '1') ELSE CAST(o_orderkey AS VARCHAR) END, '[^0-9]', '', 'g') AS d FROM orders)
SELECT o_orderkey, CASE WHEN length(d) BETWEEN 1 AND 8 THEN lpad(d, 8, '0') END AS bol, d AS digits FROM r""",
    "parse_city": "SELECT n_nationkey, trim(regexp_replace(lower(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ', IL' ELSE '  .' END), '[^a-z0-9]+', ' ', 'g')) AS city_key, CASE WHEN regexp_matches(trim(regexp_replace(lower(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ', IL' ELSE '  .' END), '[^a-z0-9]+', ' ', 'g')), '^.+ [a-z0-9]{2}$') THEN regexp_replace(trim(regexp_replace(lower(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ', IL' ELSE '  .' END), '[^a-z0-9]+', ' ', 'g')), ' [a-z0-9]{2}$', '') END AS without_state FROM nation",
    "parse_amounts": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 7919 % 5000000) / 100.0 END AS amount, CASE WHEN o_orderkey * 31 % 20000 > 0 THEN CAST(o_orderkey * 31 % 20000 AS INTEGER) END AS pounds, CASE WHEN o_orderkey % 900 * 100 + o_orderkey % 100 > 0 THEN CAST(o_orderkey % 900 * 100 + o_orderkey % 100 AS INTEGER) END AS from_cwt FROM orders",
    "parse_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "pro_number_parts": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderkey AS VARCHAR) END AS pro, CASE WHEN o_orderkey % 10 <> 9 THEN CASE o_orderkey % 3 WHEN 0 THEN 'rebill' WHEN 1 THEN 'balance_due' ELSE 'original' END END AS invoice_type FROM orders",
    "unpivot_charges": sql([], "SELECT invoice_id, charge_code, CAST(sum(amount) AS DOUBLE) AS amount FROM line WHERE charge_code IN ('LH', 'FSC', 'LIFTGATE') GROUP BY 1, 2"),
    "rate_lookup_effective": sql([PRICED], f"SELECT shipment_id, version, effective_from, {d('c2 cwt_1000_1999')} FROM ps"),
    "rate_card_problems": sql([], "SELECT s.carrier_id, s.lane_id, s.ship_date, count(c.version) AS rows_in_force FROM (SELECT DISTINCT carrier_id, lane_id, CAST(ship_date - INTERVAL 36 MONTH AS DATE) AS ship_date FROM ship) s LEFT JOIN card c ON c.carrier_id = s.carrier_id AND c.lane_id = s.lane_id AND s.ship_date BETWEEN c.effective_from AND c.effective_to GROUP BY ALL HAVING count(c.version) <> 1"),
    "linehaul_and_fuel": sql([PRICED], f"SELECT shipment_id, mode, {d('lh lh_estimate', 'fsc fsc_estimate')} FROM pr"),
    "contract_spend": sql([PRICED], "SELECT mode, count(*) AS shipments, CAST(sum(lh) AS DOUBLE) AS linehaul, CAST(sum(fsc) AS DOUBLE) AS fuel FROM pr GROUP BY 1"),
    "fuel_week_lookup": sql([PRICED], f"SELECT shipment_id, week AS diesel_week, CAST(price AS DOUBLE) AS diesel_price, price IS NULL AS missing, CAST({pct_sql('price')} AS DOUBLE) AS ltl_pct FROM ps"),
    "diesel_forward_fill": sql([], "SELECT CAST(w AS DATE) AS week_start, (SELECT CAST(arg_max(price_per_gallon, week_start) AS DOUBLE) FROM x WHERE x.week_start <= w) AS price_per_gallon FROM (SELECT unnest(generate_series((SELECT min(week_start) FROM x), (SELECT max(week_start) FROM x), INTERVAL 7 DAY)) AS w) s").replace("\nSELECT CAST(w", ", x AS (SELECT * FROM diesel WHERE month(week_start) % 3 <> 0)\nSELECT CAST(w"),
    "haversine_miles": """WITH a AS (SELECT c_custkey, radians(25 + (c_custkey * 37 % 2400) / 100.0) AS p1, radians(25 + ((c_custkey + 17) * 37 % 2400) / 100.0) AS p2, radians(((c_custkey + 17) * 91 % 5700) / 100.0 - (c_custkey * 91 % 5700) / 100.0) AS dl FROM customer)
SELECT c_custkey, CAST(round(2 * 3958.8 * asin(sqrt(pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin(dl / 2), 2))) * 1.2) AS INTEGER) AS miles FROM a""",
    "largest_remainder": """WITH w AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT *, round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY c_mktsegment), 9) AS x FROM w),
f AS (SELECT *, CAST(floor(x) AS BIGINT) AS fl, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(x - floor(x), 9) DESC, c_nationkey) AS k, 100 - sum(floor(x)) OVER (PARTITION BY c_mktsegment) AS rest FROM s)
SELECT c_mktsegment, c_nationkey, fl + CASE WHEN k <= rest THEN 1 ELSE 0 END AS n FROM f""",
    "match_exact": sql(_R, "SELECT invoice_id, shipment_id, match_method FROM mi"),
    "supersession_links": sql(_R, "SELECT invoice_id, is_superseded, superseded_on, superseded_by, target_id FROM bi"),
    "totals_check": sql(_R, "SELECT invoice_id, CAST(total AS DOUBLE) AS lines_total, substring(bol_canonical, 8, 1) <> '3' AS totals_ok FROM mi"),
    "keep_first_number": sql(_R, "SELECT carrier_id, invoice_number, arg_min(invoice_id, (received_date, invoice_id)) AS invoice_id FROM mi GROUP BY 1, 2"),
    "match_fallback": sql([RESOLVED], """, x AS (SELECT i.invoice_id, i.carrier_id, CASE WHEN i.match_method = 'unmatched' THEN i.bol_canonical END AS bol, i.ship_date, i.billed_weight_lbs AS w, s.lane_id FROM mi i JOIN ship s ON s.shipment_id = i.pro_number),
e AS (SELECT x.*, sb.sid FROM x LEFT JOIN sb ON sb.carrier_id = x.carrier_id AND sb.bol = x.bol),
c AS (SELECT e.invoice_id, count(*) AS n, min(s.shipment_id) AS f FROM e JOIN ship s ON s.carrier_id = e.carrier_id AND s.lane_id = e.lane_id AND abs(e.ship_date - s.ship_date) <= 1 AND abs(e.w - s.weight_lbs) <= 0.02 * s.weight_lbs WHERE e.sid IS NULL GROUP BY 1 HAVING count(*) = 1)
SELECT e.invoice_id, coalesce(e.sid, c.f) AS shipment_id, CASE WHEN e.sid IS NOT NULL THEN 'exact' WHEN c.f IS NOT NULL THEN 'fallback' ELSE 'unmatched' END AS match_method FROM e LEFT JOIN c USING (invoice_id)"""),
    "rerate_impacts": sql([RESOLVED, PRICED, RERATED], f"SELECT invoice_id, version, rw AS reference_weight_lbs, {d('blh billed_lh', 'bfsc billed_fsc', 'lhb lh_at_billed', 'lhr lh_at_reference', 'fexp fsc_expected', 'rate_i rate_impact', 'weight_i weight_impact', 'fsc_i fsc_impact')} FROM rr"),
    "authorization_status": sql([RESOLVED, ACCESSORIAL], f"SELECT invoice_id, charge_code, at_ AS authorized_at, st AS auth_status, {d('amount')} FROM ac"),
    **{f"rule_{r}": rule_sql(r) for r in ("duplicate_invoice", "phantom_invoice", "rate_overcharge", "fsc_mismatch", "unauthorized_accessorial", "weight_overbilling")},
    "invoice_summary": sql(_A, f"SELECT invoice_id, carrier_id, invoice_type, match_method, n_flags, error_types, {d('total', 'recoverable')} FROM su"),
    "process_metrics": sql([RESOLVED, ACCESSORIAL], "SELECT * FROM (SELECT unnest(['accessorial_lines', 'authorized_on_time', 'authorized_late', 'unauthorized']) AS metric, unnest([CAST(coalesce(sum(n), 0) AS BIGINT), CAST(coalesce(sum(n) FILTER (st = 'authorized'), 0) AS BIGINT), CAST(coalesce(sum(n) FILTER (st = 'authorized_late'), 0) AS BIGINT), CAST(coalesce(sum(n) FILTER (st = 'unauthorized'), 0) AS BIGINT)]) AS value FROM ac)"),
    "flag_reasons": sql(_R, "SELECT invoice_id, 'No shipment for BOL ' || bol_raw || ' of ' || carrier_id || ': ' || '$' || format('{:,.2f}', CAST(total AS DOUBLE)) AS reason FROM bi WHERE NOT is_superseded AND shipment_id IS NULL"),
    "naive_flags": sql([RESOLVED, NAIVE], "SELECT error_type, count(*) AS flags, CAST(sum(impact) AS DOUBLE) AS dollars FROM nf GROUP BY 1"),
    "engine_vs_naive": sql([*_A, NAIVE], f"SELECT t.error_type, coalesce(e.n, 0) AS engine_flags, coalesce(v.n, 0) AS naive_flags FROM {_ALL} t LEFT JOIN (SELECT error_type, count(*) AS n FROM co GROUP BY 1) e ON e.error_type = t.error_type LEFT JOIN (SELECT error_type, count(*) AS n FROM nf GROUP BY 1) v ON v.error_type = t.error_type WHERE t.error_type <> 'ALL'"),
    "outcomes": sql(_SCORE, f"SELECT invoice_id, error_type, status, {d('flagged flagged_dollars', 'truth true_dollars')} FROM oc"),
    "metrics_by_type": sql(_SCORE, f"""SELECT t.error_type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tp + fp, 0) AS flags, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END, 9) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 9) AS f1, CAST(coalesce(fd, 0) AS DOUBLE) AS flagged_dollars, CAST(coalesce(td, 0) AS DOUBLE) AS true_dollars, CAST(coalesce(tpd, 0) AS DOUBLE) AS tp_dollars
 FROM {_ALL} t LEFT JOIN (SELECT coalesce(error_type, 'ALL') AS error_type, count(*) FILTER (status = 'TP') AS tp, count(*) FILTER (status = 'FP') AS fp, count(*) FILTER (status = 'FN') AS fn, sum(flagged) AS fd, sum(truth) AS td, sum(flagged) FILTER (status = 'TP') AS tpd FROM oc GROUP BY GROUPING SETS ((error_type), ())) g ON g.error_type = t.error_type"""),
    "recall_by_mode": sql(_SCORE, "SELECT te.error_type, te.lmode AS mode, count(*) AS errors, CAST(sum(te.t) AS DOUBLE) AS dollars, count(oc.invoice_id) AS engine_found, round(count(oc.invoice_id) / CAST(count(*) AS DOUBLE), 9) AS engine_recall FROM te LEFT JOIN (SELECT * FROM oc WHERE status = 'TP') oc ON oc.invoice_id = te.invoice_id AND oc.error_type = te.error_type GROUP BY 1, 2"),
    "trap_false_flags": sql([RESOLVED, NAIVE, NAIVE_OUTCOMES], """, gp AS (SELECT DISTINCT invoice_id, label AS trap FROM la WHERE kind = 'trap' UNION SELECT invoice_id, '(clean)' FROM inv WHERE invoice_id NOT IN (SELECT invoice_id FROM la)), hh AS (SELECT trap, error_type, count(*) AS n FROM gp JOIN (SELECT * FROM no WHERE status = 'FP') f USING (invoice_id) GROUP BY 1, 2)
SELECT g.trap, g.invoices, coalesce(f.n, 0) AS invoices_flagged, CAST(coalesce(h.n, 0) AS BIGINT) AS false_flags, coalesce(h.b, '') AS by_type FROM (SELECT trap, count(DISTINCT invoice_id) AS invoices FROM gp GROUP BY 1) g LEFT JOIN (SELECT trap, count(DISTINCT invoice_id) AS n FROM gp JOIN (SELECT * FROM no WHERE status = 'FP') f USING (invoice_id) GROUP BY 1) f USING (trap) LEFT JOIN (SELECT trap, sum(n) AS n, string_agg(error_type || ':' || n, ';' ORDER BY error_type) AS b FROM hh GROUP BY 1) h USING (trap)"""),
    "false_flag_causes": sql([RESOLVED, NAIVE, NAIVE_OUTCOMES], f""", lx AS (SELECT invoice_id, bool_or(label = 'late_authorization') AS late, bool_or(label IN ('rebill', 'balance_due')) AS rb, bool_or(label = 'bol_format') AS zero, bool_or(label = 'weight_overbilling') AS wo FROM la GROUP BY 1),
cx AS (SELECT {_CAUSE} AS cause, error_type, count(*) AS n FROM (SELECT f.error_type, coalesce(late, false) AS late, coalesce(rb, false) AS rb, coalesce(zero, false) AS zero, coalesce(wo, false) AS wo FROM no f LEFT JOIN lx USING (invoice_id) WHERE status = 'FP') q GROUP BY 1, 2)
SELECT t.cause, CAST(coalesce(n, 0) AS BIGINT) AS false_flags, round(coalesce(n, 0) / CAST(sum(n) OVER () AS DOUBLE), 9) AS share, coalesce(b, '') AS by_rule FROM (SELECT unnest(['rate_amendment', 'reweigh', 'weight_misread_as_rate', 'late_authorization', 'rebill_balance_due', 'bol_typo_or_zero', 'other']) AS cause) t LEFT JOIN (SELECT cause, sum(n) AS n, string_agg(error_type || ':' || n, ';' ORDER BY error_type) AS b FROM cx GROUP BY 1) g USING (cause)"""),
    "tolerance_sweep": sql([*_A, LABELS, SWEEP], "SELECT tolerance, value, carrier_mode, is_current, tp + fp AS flags, tp, fp, fn, round(pre, 9) AS precision, CAST(tpd AS DOUBLE) AS tp_dollars, CAST(net AS DOUBLE) AS net_value, coalesce(pre >= 0.9, false) AS meets_floor FROM sw"),
    "sweep_recommendation": sql([*_A, LABELS, SWEEP], """, nw AS (SELECT tolerance, value AS cv, net AS cn, coalesce(pre >= 0.9, false) AS cm FROM sw WHERE is_current),
rk AS (SELECT sw.*, cv, cn, cm, coalesce(pre >= 0.9, false) AS ok FROM sw JOIN nw USING (tolerance)),
bs AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY tolerance ORDER BY ok DESC, CASE WHEN ok THEN net END DESC NULLS LAST, CASE WHEN NOT ok THEN coalesce(pre, -1) END DESC NULLS LAST, CASE WHEN ok THEN abs(value - cv) END NULLS LAST, value) = 1)
SELECT tolerance, cv AS current_value, value AS best_value, CASE WHEN NOT cm OR net - cn > 1000 THEN value ELSE cv END AS recommended_value, NOT cm OR net - cn > 1000 AS changed, CAST(cn AS DOUBLE) AS current_net, CAST(net AS DOUBLE) AS best_net FROM bs"""),
    "exception_queue": sql(_A, f"SELECT row_number() OVER (ORDER BY recoverable DESC, received_date, invoice_id) AS queue_rank, invoice_id, carrier_id, types AS error_types, n_flags, {d('total', 'recoverable')} FROM su JOIN (SELECT invoice_id, string_agg(error_type, ';' ORDER BY o) AS types FROM (SELECT DISTINCT invoice_id, error_type, o FROM co) GROUP BY 1) t USING (invoice_id) WHERE n_flags > 0"),
    "top_n_per_carrier": sql(_A, f"SELECT carrier_id, k AS carrier_rank, invoice_id, {d('recoverable')} FROM (SELECT *, row_number() OVER (PARTITION BY carrier_id ORDER BY recoverable DESC, received_date, invoice_id) AS k FROM su WHERE n_flags > 0) WHERE k <= 10"),
    "queue_filter": sql(_A, "SELECT invoice_id, types AS error_types FROM su JOIN (SELECT invoice_id, string_agg(error_type, ';' ORDER BY o) AS types, bool_or(error_type IN ('fsc_mismatch', 'phantom_invoice')) AS hit FROM (SELECT DISTINCT invoice_id, error_type, o FROM co) GROUP BY 1) t USING (invoice_id) WHERE hit AND carrier_id IN ('CAR1', 'CAR6')"),
    "carrier_by_type": sql(_A, "SELECT carrier_id, error_type, count(DISTINCT invoice_id) AS invoices, count(*) AS flags, CAST(sum(impact) AS DOUBLE) AS flagged_dollars, CAST(coalesce(sum(impact) FILTER (counted), 0) AS DOUBLE) AS recoverable_dollars FROM co JOIN bi USING (invoice_id) GROUP BY 1, 2"),
    "systemic_windows": sql([*_A, WINDOWS], 'SELECT carrier_id, error_type, w AS "window", a AS window_start, b AS window_end, n, k, CAST(pn AS BIGINT) AS peer_n, CAST(pk AS BIGINT) AS peer_k FROM wr JOIN we USING (w)'),
    "systemic_findings": sql([*_A, WINDOWS], f""", t1 AS (SELECT wr.*, we.a, we.b, k / CAST(n AS DOUBLE) AS cr, CASE WHEN pn > 0 THEN pk / CAST(pn AS DOUBLE) ELSE 0.0 END AS prr, (SELECT count(DISTINCT carrier_id) * 6 * count(DISTINCT w) FROM wr) AS tests FROM wr JOIN we USING (w)),
t2 AS (SELECT *, CASE WHEN prr <= 0 THEN NULL ELSE {tail("k", "n", "prr")} END AS lp FROM t1 WHERE n >= 20 AND k >= 10 AND cr >= 1.05 * prr)
SELECT carrier_id, error_type, a AS window_start, b AS window_end, n AS invoices, k AS flagged, round(cr, 9) AS carrier_rate, round(prr, 9) AS peer_rate, round(lp, 6) AS ln_p FROM t2 WHERE prr <= 0 OR lp <= -ln(tests) QUALIFY row_number() OVER (PARTITION BY carrier_id, error_type ORDER BY CASE WHEN prr <= 0 THEN -1e9 ELSE round(lp, 9) END, a) = 1"""),
    "binomial_tail": f"WITH q AS (SELECT p_partkey, p_partkey % 90 + 10 AS n, p_partkey * 7 % (p_partkey % 90 + 10) + 1 AS k, (p_partkey % 37 + 1) / 100.0 AS p FROM part) SELECT p_partkey, round({tail('k', 'n', 'p')}, 6) AS ln_tail FROM q",
    "accrual_population": sql([RESOLVED, PRICED, ACCRUED], "SELECT m AS month_end, shipment_id FROM pop"),
    "accessorial_allowance": sql([RESOLVED, PRICED, ACCRUED], "SELECT m AS month_end, carrier_id, CAST(round(CAST(a AS DECIMAL(18,8)), 6) AS DOUBLE) AS accessorial_allowance, basis AS accessorial_basis FROM al"),
    "accrual_detail": sql([RESOLVED, PRICED, ACCRUED], f"SELECT m AS month_end, shipment_id, cost_center, {d('lh lh_estimate', 'fsc fsc_estimate', 'ac_ accessorial_estimate', 'est accrual_estimate')} FROM de"),
    "shipment_actuals": sql([*_A, ACTUALS], f"SELECT shipment_id, n AS invoices_billed, {d('billed actual_billed', 'core actual_lh_fsc_billed', 'acc actual_accessorial_billed', 'rec actual_recoverable', 'payable actual_payable')} FROM sa"),
    "accrual_accuracy": sql([*_A, ACTUALS, ACCRUED], """, jj AS (SELECT de.*, sa.n, coalesce(sa.billed, 0) AS billed, coalesce(sa.payable, 0) AS payable, CASE WHEN sa.payable > 0 THEN CAST(abs(est - sa.payable) AS DOUBLE) / CAST(sa.payable AS DOUBLE) END AS ape FROM de LEFT JOIN sa USING (shipment_id))
SELECT m AS month_end, count(*) AS shipments_accrued, count(*) - count(n) AS never_billed, CAST(sum(est) AS DOUBLE) AS accrual_estimate, CAST(sum(billed) AS DOUBLE) AS actual_billed, CAST(sum(payable) AS DOUBLE) AS actual_payable, CAST(sum(est) - sum(payable) AS DOUBLE) AS error,
 round(CASE WHEN sum(payable) <> 0 THEN CAST(sum(est) - sum(payable) AS DOUBLE) / CAST(sum(payable) AS DOUBLE) END, 9) AS error_pct, round(avg(ape), 9) AS shipment_mape, round(median(ape), 9) AS shipment_median_ape, round(avg(CASE WHEN ape IS NOT NULL THEN CASE WHEN ape > 0.10 THEN 1.0 ELSE 0.0 END END), 9) AS shipment_share_over_band FROM jj GROUP BY GROUPING SETS ((m), ())"""),
    "accuracy_headline": sql([*_A, ACTUALS, ACCRUED], "SELECT round(avg(abs(e)), 9) AS mape, round(avg(e), 9) AS bias FROM (SELECT CAST(sum(est) - sum(coalesce(payable, 0)) AS DOUBLE) / CAST(sum(coalesce(payable, 0)) AS DOUBLE) AS e FROM de LEFT JOIN sa USING (shipment_id) GROUP BY m)"),
    "accrual_sensitivity": sql([*_A, ACTUALS, ACCRUED], f""", ka2 AS (SELECT DISTINCT a.shipment_id, a.code, s.delivery_date AS at_ FROM auth a JOIN ship s USING (shipment_id)),
dd2 AS (SELECT wi.m, wi.carrier_id, CAST(sum(l.amount) AS {M}) AS dollars FROM wi JOIN line l USING (invoice_id) JOIN ka2 ka ON ka.shipment_id = wi.shipment_id AND ka.code = l.charge_code AND ka.at_ <= wi.m WHERE l.charge_code IN ('LIFTGATE', 'DETENTION') GROUP BY 1, 2),
al2 AS (SELECT al.m, al.carrier_id, CASE WHEN n > 0 THEN CAST(coalesce(dollars, 0) AS DOUBLE) / n ELSE al.a END AS a FROM al LEFT JOIN nn ON nn.m = al.m AND nn.carrier_id = al.carrier_id LEFT JOIN dd2 ON dd2.m = al.m AND dd2.carrier_id = al.carrier_id),
de2 AS (SELECT de.m, de.shipment_id, de.est, CAST(de.lh + de.fsc + CAST(round(CAST(al2.a AS DECIMAL(18,8)), 2) AS {M}) AS {M}) AS est2 FROM de JOIN al2 ON al2.m = de.m AND al2.carrier_id = de.carrier_id)
SELECT m AS month_end, count(*) AS shipments_accrued, CAST(sum(coalesce(payable, 0)) AS DOUBLE) AS actual_payable, CAST(sum(est) AS DOUBLE) AS accrual_estimate_as_built, CAST(sum(est2) AS DOUBLE) AS accrual_estimate_auth_at_delivery, CAST(sum(est2) - sum(est) AS DOUBLE) AS late_auth_effect FROM de2 LEFT JOIN sa USING (shipment_id) GROUP BY GROUPING SETS ((m), ())"""),
    "journal_entries": sql([RESOLVED, PRICED, ACCRUED], """, g AS (SELECT m, cost_center, CAST(sum(est) AS DOUBLE) AS a FROM de GROUP BY GROUPING SETS ((m, cost_center), (m)))
SELECT 'ACR-' || strftime(m, '%Y%m') AS je_id, m AS date, 'accrual' AS type, CASE WHEN cost_center IS NULL THEN '2150 Accrued Freight' ELSE '6100 Freight Expense' END AS account, coalesce(cost_center, '') AS cost_center, CASE WHEN cost_center IS NULL THEN 0.0 ELSE a END AS debit, CASE WHEN cost_center IS NULL THEN a ELSE 0.0 END AS credit, 'Accrual of freight delivered through ' || m || ' and not yet invoiced' AS memo FROM g
UNION ALL SELECT 'REV-' || strftime(m, '%Y%m'), CAST(m + 1 AS DATE), 'reversal', CASE WHEN cost_center IS NULL THEN '2150 Accrued Freight' ELSE '6100 Freight Expense' END, coalesce(cost_center, ''), CASE WHEN cost_center IS NULL THEN a ELSE 0.0 END, CASE WHEN cost_center IS NULL THEN 0.0 ELSE a END, 'Reversal of ACR-' || strftime(m, '%Y%m') FROM g"""),
    "liability_balance": sql([RESOLVED, PRICED, ACCRUED], ", g AS (SELECT m, CAST(sum(est) AS DOUBLE) AS a FROM de GROUP BY 1) SELECT 'ACR-' || strftime(m, '%Y%m') AS je_id, m AS date, a AS change, a AS balance FROM g UNION ALL SELECT 'REV-' || strftime(m, '%Y%m'), CAST(m + 1 AS DATE), -a, 0.0 FROM g"),
    "overview_metrics": sql(_A, "SELECT count(*) AS audited, CAST(sum(total) AS DOUBLE) AS billed, count(*) FILTER (n_flags > 0) AS flagged, CAST(sum(recoverable) AS DOUBLE) AS recoverable FROM su"),
    "recoverable_text": sql(_A, "SELECT carrier_id, '$' || format('{:,.2f}', CAST(sum(recoverable) AS DOUBLE)) AS recoverable_text, CASE WHEN sum(recoverable) > 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', CAST(sum(recoverable) AS DOUBLE)) AS negative_text FROM su GROUP BY 1"),
}
_LAYOUT = """, ly AS (SELECT inv.*, substr('ABCDABCD', CAST(substr(carrier_id, 4) AS INT) + 1, 1) AS layout FROM inv), n AS (SELECT invoice_id, count(*) AS n_lines, sum(amount) AS line_total FROM line GROUP BY 1)"""
_FIXES = (
    ("date_parsing", "date field", "2", "layout <> 'B'"), ("cwt_to_lbs", "invoice", "1", "layout = 'B'"), ("weight_text_cleanup", "invoice", "1", "layout = 'C'"), ("city_cleanup", "city field", "2", "layout <> 'B'"),
    ("bol_canonicalization", "invoice", "1", "layout = 'D' OR bol_raw <> bol_canonical"), ("invoice_type_from_pro_suffix", "invoice", "1", "layout IN ('A', 'C') AND invoice_type <> 'original'"), ("invoice_type_text", "invoice", "1", "layout = 'D'"),
    ("carrier_name_variant", "invoice", "1", "layout = 'C'"), ("currency_to_float", "amount field", "1 + n_lines", "layout = 'C'"), ("charge_description_to_code", "line", "n_lines", "layout = 'D'"),
)
_CITY = "CASE {} % 3 WHEN 0 THEN 'St. Louis' WHEN 1 THEN 'Ft. Worth' ELSE 'Chicago' END"
ORACLES |= {
    "layout_round_trip": sql([], _LAYOUT + f"""SELECT invoice_id AS control_id, carrier_id, invoice_number, pro_number, bol_canonical, invoice_type, CASE WHEN layout IN ('B', 'D') AND invoice_type = 'rebill' THEN 'E' || pro_number END AS supersedes_invoice_number, invoice_date, ship_date,
       {_CITY.format("l_partkey")} AS origin, {_CITY.format("l_suppkey")} AS destination, CAST(billed_weight_lbs AS BIGINT) AS billed_weight_lbs, CAST(line_total AS DOUBLE) AS total, CAST(line_total AS DOUBLE) AS line_total, n_lines FROM ly LEFT JOIN n USING (invoice_id)"""),
    "systemic_dollars": sql(_A, ", sf AS (" + ORACLES["systemic_findings"] + f""") SELECT sf.carrier_id, sf.error_type, sf.window_start, sf.window_end, count(DISTINCT q.invoice_id) AS window_invoices, CAST(coalesce(sum(q.d), 0) AS DOUBLE) AS window_recoverable
       FROM sf LEFT JOIN (SELECT co.invoice_id, bi.carrier_id, co.error_type, bi.ship_date, CASE WHEN co.counted THEN co.impact END AS d FROM co JOIN bi USING (invoice_id) WHERE NOT bi.is_superseded) q
       ON q.carrier_id = sf.carrier_id AND q.error_type = sf.error_type AND q.ship_date BETWEEN sf.window_start AND sf.window_end GROUP BY 1, 2, 3, 4"""),
    "pricing_problems": sql([], """SELECT 'rates in force' AS problem, s.carrier_id || ' ' || s.lane_id || ' ' || CAST(s.ship_date AS VARCHAR) AS key, count(c.lane_id) AS n FROM (SELECT DISTINCT carrier_id, lane_id, ship_date FROM ship) s
       LEFT JOIN (SELECT * FROM card WHERE version = 1 OR CAST(substr(lane_id, 2) AS INT) % 2 = 1) c ON c.carrier_id = s.carrier_id AND c.lane_id = s.lane_id AND s.ship_date BETWEEN c.effective_from AND c.effective_to GROUP BY 1, 2 HAVING count(c.lane_id) <> 1
       UNION ALL SELECT DISTINCT 'diesel price', CAST(CAST(date_trunc('week', ship_date) AS DATE) AS VARCHAR), 0 FROM ship WHERE CAST(floor(date_diff('day', DATE '1990-01-01', CAST(date_trunc('week', ship_date) AS DATE)) / 7.0) AS BIGINT) % 5 = 0"""),
    "normaliser_fixes": sql([], _LAYOUT + "SELECT carrier_id, fix_type, unit, CAST(sum(k) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT carrier_id, '{t}' AS fix_type, '{u}' AS unit, {k} AS k FROM ly JOIN n USING (invoice_id) WHERE {w}" for t, u, k, w in _FIXES) + ") GROUP BY 1, 2, 3"),
}
ORACLES = {k: v.replace(")\n, ", "),\n") if "\n, " in v else v for k, v in ORACLES.items()}

_USD = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', CAST(abs({0}) AS DOUBLE))"


def usd(x: str) -> str:
    return _USD.format(x)


def pct(x: str) -> str:
    return f"format('{{:,.1f}}', CAST({x} AS DOUBLE) * 100) || '%'"


def pounds(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


_REASONS = f"""
SELECT c.invoice_id, c.error_type, 'Repeats ' || du.f || ' received ' || coalesce(CAST(fb_.received_date AS VARCHAR), 'on an unknown date') || ' (' || CASE WHEN d1.f IS NOT NULL THEN 'same shipment or BOL, total within tolerance' ELSE 'same carrier and invoice number' END || '): ' || {usd("b.total")} AS reason
  FROM co c JOIN du USING (invoice_id) JOIN bi b USING (invoice_id) LEFT JOIN bi fb_ ON fb_.invoice_id = du.f LEFT JOIN d1 ON d1.invoice_id = c.invoice_id WHERE c.error_type = 'duplicate_invoice'
UNION ALL SELECT invoice_id, 'phantom_invoice', 'No shipment for BOL ' || bol_raw || ' of ' || carrier_id || ': ' || {usd("total")} FROM bi WHERE NOT is_superseded AND shipment_id IS NULL
UNION ALL SELECT invoice_id, 'rate_overcharge', 'Linehaul ' || {usd("blh")} || ' vs contract ' || {usd("lhb")} || ' at ' || {pounds("bw")} || ' lb (rate version ' || version || '): +' || {usd("gap")} FROM rr WHERE gap > greatest(CAST(2.00 AS DECIMAL(28,8)), 0.01 * lhb)
UNION ALL SELECT invoice_id, 'fsc_mismatch', 'Fuel ' || {usd("bfsc")} || ' vs expected ' || {usd("fexp")} || ' (week of ' || CAST(CAST(date_trunc('week', s.ship_date) AS DATE) AS VARCHAR) || ', ' ||
    CASE WHEN rr.mode = 'LTL' THEN coalesce({pct("CAST(bfsc AS DOUBLE) / CAST(blh AS DOUBLE)")} || ' of linehaul vs ' || {pct("pct")}, 'no linehaul') ELSE 'over ' || {pounds("rr.miles")} || ' miles' END || '): +' || {usd("fsc_i")}
  FROM rr JOIN ship s USING (shipment_id) WHERE (rr.mode = 'LTL' AND blh > 0 AND (bfsc - blh * pct) * 100 > 0.25 * blh AND fsc_i > 1.00) OR (rr.mode = 'TL' AND fsc_i > greatest(CAST(2.00 AS DECIMAL(28,8)), 0.005 * fexp))
UNION ALL SELECT invoice_id, 'unauthorized_accessorial', upper(charge_code[1]) || lower(charge_code[2:]) || ' ' || {usd("amount")} || ' without an authorization on file for ' || shipment_id || ' as of {AS_OF}' FROM ac WHERE st = 'unauthorized'
UNION ALL SELECT rr.invoice_id, 'weight_overbilling', 'Billed ' || {pounds("bw")} || ' lb vs ' || CASE WHEN ce.shipment_id IS NOT NULL THEN 'certified ' ELSE 'shipped ' END || {pounds("rw")} || ' lb: +' || {usd("weight_i")}
  FROM rr LEFT JOIN (SELECT DISTINCT shipment_id FROM cert WHERE certified_at <= DATE '{AS_OF}') ce USING (shipment_id) WHERE rr.mode = 'LTL' AND bw > rw * 1.02"""

_SPOILED = " UNION ALL ".join(
    f"SELECT carrier_id, invoice_id AS control_id, '{kind}' AS exception_type, '{raw}' AS raw_value, '{detail}' AS detail, 1 AS n FROM ly WHERE l_partkey % 50 = {k}"
    for k, kind, raw, detail in (
        (1, "unparseable_date", "31/31/1998", "row dropped"), (2, "unparseable_date", "", "row dropped"), (3, "unparseable_weight", "heavy", "row dropped"),
        (4, "unparseable_total", "n/a", "kept"), (5, "unknown_city", "Nowhere", "kept"), (6, "unparseable_bol", "??", "kept; cannot match exactly"),
    )
)

#: the stacks of an order, one event after another, as lists; an entry is an invoice with its number and pro number
_MIXED = """
WITH RECURSIVE src AS (SELECT * FROM ({inv})),
ev AS (
  SELECT *, row_number() OVER (PARTITION BY carrier_id, pro_number ORDER BY received_date, step, invoice_id) AS at FROM (
    SELECT carrier_id, pro_number, invoice_id, invoice_number, received_date, -1 AS step, cites FROM src WHERE invoice_type = 'rebill'
    UNION ALL SELECT carrier_id, pro_number, invoice_id, invoice_number, received_date, 1, NULL FROM src WHERE invoice_type <> 'balance_due')),
st AS (
  SELECT carrier_id, pro_number, 0::BIGINT AS at, []::STRUCT(id VARCHAR, num VARCHAR)[] AS open, NULL::VARCHAR AS by_, NULL::VARCHAR AS target, NULL::DATE AS on_ FROM (SELECT DISTINCT carrier_id, pro_number FROM ev)
  UNION ALL
  SELECT e.carrier_id, e.pro_number, e.at, CASE WHEN e.step > 0 THEN list_append(open, {{'id': e.invoice_id, 'num': e.invoice_number}}) WHEN hit IS NULL THEN open ELSE list_filter(open, lambda x: x.id <> hit) END,
    CASE WHEN e.step < 0 AND hit IS NOT NULL THEN e.invoice_id END, CASE WHEN e.step < 0 THEN hit END, CASE WHEN e.step < 0 AND hit IS NOT NULL THEN e.received_date END
  FROM (SELECT s.open, e.*, CASE WHEN e.step < 0 THEN (list_filter(s.open, lambda x: e.cites IS NULL OR x.num = e.cites)[-1]).id END AS hit FROM st s JOIN ev e ON e.carrier_id = s.carrier_id AND e.pro_number = s.pro_number AND e.at = s.at + 1) e),
lk AS (SELECT * FROM st WHERE by_ IS NOT NULL)
SELECT src.invoice_id, h.by_ IS NOT NULL AS is_superseded, h.on_ AS superseded_on, h.by_ AS superseded_by, g.target AS target_id
FROM src LEFT JOIN lk h ON h.target = src.invoice_id LEFT JOIN lk g ON g.by_ = src.invoice_id"""


_SCORES = """SELECT s.system, coalesce(t.error_type, 'ALL') AS kind, count(*) FILTER (status <> 'FN') AS flags, count(*) FILTER (status = 'TP') AS tp, count(*) FILTER (status = 'FP') AS fp, count(*) FILTER (status = 'FN') AS fn,
  coalesce(count(*) FILTER (status = 'TP') / nullif(CAST(count(*) FILTER (status <> 'FN') AS DOUBLE), 0), 0) AS precision, coalesce(count(*) FILTER (status = 'TP') / nullif(CAST(count(*) FILTER (status <> 'FP') AS DOUBLE), 0), 0) AS recall, sum(truth) FILTER (status = 'FN') AS missed
  FROM (SELECT 'engine' AS system, error_type, status, truth FROM oc UNION ALL SELECT 'baseline', error_type, status, truth FROM no) s, LATERAL (SELECT s.error_type UNION ALL SELECT NULL) t(error_type) GROUP BY 1, 2"""

ORACLES |= {
    "flag_reasons_all": sql(_A, _REASONS),
    "normaliser_exceptions": sql([], _LAYOUT + f"""SELECT carrier_id, control_id, exception_type, raw_value, detail, CAST(sum(n) AS BIGINT) AS n FROM ({_SPOILED}
  UNION ALL SELECT ly.carrier_id, ly.invoice_id, 'unmapped_charge', 'MYSTERY', 'line not loaded, amount ' || CAST(line.amount AS VARCHAR), 1 FROM ly JOIN line USING (invoice_id) WHERE layout IN ('B', 'D') AND l_partkey % 50 = 7
  UNION ALL SELECT ly.carrier_id, ly.invoice_id, 'unparseable_amount', 'x1', 'line not loaded', 1 FROM ly JOIN line USING (invoice_id) WHERE layout IN ('B', 'D') AND l_partkey % 50 = 8) GROUP BY ALL"""),
    "csv_record_numbers": "SELECT doc_id, doc_id // 200 AS file, CAST(row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id) + 1 AS INTEGER) AS csv_row, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "supersession_mixed": _MIXED.format(inv=sql([], "SELECT *, CASE WHEN invoice_type = 'rebill' AND l_partkey % 2 = 0 THEN 'N' || pro_number || '-' || (l_linenumber - 1) END AS cites FROM inv")),
    "supersession_links": _MIXED.format(inv=sql([], "SELECT *, NULL::VARCHAR AS cites FROM inv")),
    "accruals_as_known": sql([RESOLVED, PRICED, ACCRUED], f"SELECT m AS month_end, shipment_id, {d('lh lh_estimate', 'fsc fsc_estimate', 'ac_ accessorial_estimate', 'est accrual_estimate')} FROM de WHERE m IN (DATE '1997-09-30', DATE '1997-12-31', DATE '1998-03-31')"),
    "stage_manifest": sql(_SCORE, "SELECT 'audit_flags' AS table_name, count(*) AS n_rows, count(*) AS told_rows FROM co UNION ALL SELECT 'audit_invoice_summary', count(*), count(*) FROM su UNION ALL SELECT 'outcomes', count(*), count(*) FROM oc"),
    "overview_breakdown": sql(_A, """SELECT level, key, audited, flagged, CAST(billed AS DOUBLE) AS billed, CAST(recoverable AS DOUBLE) AS recoverable, round(flagged / CAST(audited AS DOUBLE), 9) AS flag_rate, round(CAST(recoverable AS DOUBLE) / CAST(billed AS DOUBLE), 9) AS recoverable_share FROM (
  SELECT 'all' AS level, 'ALL' AS key, count(*) AS audited, count(*) FILTER (n_flags > 0) AS flagged, sum(total) AS billed, sum(recoverable) AS recoverable FROM su
  UNION ALL SELECT 'carrier', carrier_id, count(*), count(*) FILTER (n_flags > 0), sum(total), sum(recoverable) FROM su GROUP BY 2 UNION ALL SELECT 'invoice_type', invoice_type, count(*), count(*) FILTER (n_flags > 0), sum(total), sum(recoverable) FROM su GROUP BY 2)"""),
    "dispute_packs": sql([*_A], f""", names AS (SELECT * FROM (VALUES {", ".join(f"('CAR{i}', '{x.carrier_name}')" for i, x in enumerate(CARRIERS))}) t(carrier_id, carrier_name)),
per AS (SELECT carrier_id, min(ship_date) AS a, max(ship_date) AS z FROM bi WHERE NOT is_superseded GROUP BY 1),
bt AS (SELECT carrier_id, error_type, o, count(DISTINCT invoice_id) AS n, coalesce(sum(impact) FILTER (counted), 0) AS r FROM co JOIN bi USING (invoice_id) GROUP BY 1, 2, 3),
tb AS (SELECT carrier_id, string_agg('| ' || error_type || ' | ' || n || ' | ' || {usd("r")} || ' |', chr(10) ORDER BY o) AS t, sum(r) AS claim FROM bt GROUP BY 1),
rs AS (SELECT invoice_id, string_agg(reason, ' | ' ORDER BY o, error_type, reason) AS reasons FROM (SELECT q.*, list_position(['duplicate_invoice', 'phantom_invoice', 'rate_overcharge', 'fsc_mismatch', 'unauthorized_accessorial', 'weight_overbilling'], error_type) AS o FROM ({_REASONS}) q) GROUP BY 1),
tn AS (SELECT *, row_number() OVER (PARTITION BY carrier_id ORDER BY recoverable DESC, received_date, invoice_id) AS k FROM su WHERE n_flags > 0),
tp AS (SELECT carrier_id, string_agg(k || '. ' || invoice_number || ' ' || {usd("recoverable")} || ': ' || reasons, chr(10) ORDER BY k) AS t FROM tn JOIN rs USING (invoice_id) WHERE k <= 10 GROUP BY 1)
SELECT carrier_id, '# Dispute summary: ' || carrier_name || chr(10) || chr(10) || 'Shipped ' || coalesce(CAST(a AS VARCHAR), '-') || ' to ' || coalesce(CAST(z AS VARCHAR), '-') || chr(10) || chr(10) ||
  CASE WHEN tb.t IS NULL THEN 'No exceptions.' || chr(10) ELSE 'Claim: ' || {usd("claim")} || chr(10) || chr(10) || '| Type | Invoices | Recoverable |' || chr(10) || '|-|-|-|' || chr(10) || tb.t || chr(10) || chr(10) || coalesce(tp.t, '') || chr(10) || chr(10) || 'No systemic issue found.' || chr(10) END AS markdown
FROM names LEFT JOIN per USING (carrier_id) LEFT JOIN tb USING (carrier_id) LEFT JOIN tp USING (carrier_id)"""),
}


def _of(name: str) -> str:
    return f"({ORACLES[name]})"


_WHOLE = sql([*_A, ACTUALS, ACCRUED], """, sp2 AS (SELECT shipment_id, sum(ba) - sum(ra) AS pay_acc, sum(core) - sum(rc) AS pay_core FROM i2 GROUP BY 1),
j AS (SELECT de.*, coalesce(sa.billed, 0) AS billed, coalesce(sa.payable, 0) AS payable, coalesce(pay_acc, 0) AS pay_acc, coalesce(pay_core, 0) AS pay_core, CASE WHEN sa.payable > 0 THEN CAST(abs(est - sa.payable) AS DOUBLE) / CAST(sa.payable AS DOUBLE) END AS ape FROM de LEFT JOIN sa USING (shipment_id) LEFT JOIN sp2 USING (shipment_id))
SELECT m, count(*) AS n, CAST(sum(est) AS DOUBLE) AS est, CAST(sum(billed) AS DOUBLE) AS billed, CAST(sum(payable) AS DOUBLE) AS payable, CAST(sum(est) - sum(payable) AS DOUBLE) AS error, CAST(sum(ac_) AS DOUBLE) AS acc, CAST(sum(ac_) - sum(pay_acc) AS DOUBLE) AS acc_error, CAST(sum(pay_acc) AS DOUBLE) AS pay_acc,
  CAST(sum(lh + fsc) - sum(pay_core) AS DOUBLE) AS core_error, CAST(sum(pay_core) AS DOUBLE) AS pay_core, avg(ape) AS mape, median(ape) AS mid, avg(CASE WHEN ape IS NOT NULL THEN CASE WHEN ape > 0.10 THEN 1.0 ELSE 0.0 END END) AS band FROM j GROUP BY GROUPING SETS ((m), ())""")

ORACLES["key_findings"] = f"""SELECT 1 AS position, 'No systemic pattern passes the test.' AS text
UNION ALL SELECT 2, text FROM (SELECT 'Most false flags of the baseline come from ' || replace(cause, '_', ' ') || ': ' || {pounds("false_flags")} || ' (' || {pct("share")} || ').' AS text FROM {_of("false_flag_causes")} WHERE cause <> 'other' AND false_flags > 0 ORDER BY false_flags DESC, cause LIMIT 1)
UNION ALL SELECT 3, 'The accrual error of ' || {usd("error")} || ' is driven by ' || CASE WHEN acc_error / error > 0.5 THEN 'accessorials' ELSE 'linehaul and fuel' END || '.' FROM ({_WHOLE}) WHERE m IS NULL"""


def _leaves(source: str, prefix: str, named: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {prefix} || '.{name}' AS path, CAST({value} AS DOUBLE) AS value FROM {source}" for name, value in named.items())


_same = lambda *names: {n: n for n in names}
_BLOCK = [
    _leaves("ov", "'audit'", _same("audited", "flagged", "billed", "recoverable") | {"flag_rate": "flagged / CAST(audited AS DOUBLE)", "recoverable_share": "recoverable / billed"}),
    _leaves("(SELECT error_type, count(*) AS flags, coalesce(sum(impact) FILTER (counted), 0) AS recoverable FROM co GROUP BY 1)", "'by_type.' || error_type", _same("flags", "recoverable")),
    _leaves("sc", "'scores.' || system || '.' || kind", _same("flags", "tp", "fp", "fn", "precision", "recall")),
    _leaves("(SELECT max(fp) FILTER (system = 'baseline' AND kind = 'ALL') - max(fp) FILTER (system = 'engine' AND kind = 'ALL') AS avoided, max(flags) FILTER (system = 'baseline' AND kind = 'duplicate_invoice') AS dup, max(fp) FILTER (system = 'baseline' AND kind = 'duplicate_invoice') AS dfp FROM sc)", "'disputes'", {"avoided": "avoided", "duplicate_flags": "dup", "false_duplicates": "dfp", "false_share": "coalesce(dfp / nullif(CAST(dup AS DOUBLE), 0), 0)"}),
    _leaves("(SELECT * FROM sc WHERE system = 'engine' AND kind = 'ALL')", "'misses'", {"missed": "fn", "dollars": "coalesce(missed, 0)"}),
    _leaves("fc", "'causes.' || cause", _same("false_flags", "share")),
    "SELECT 'systemic.found' AS path, 0.0 AS value UNION ALL SELECT 'systemic.least_p', NULL",
    _leaves("(SELECT * FROM aw WHERE m IS NULL)", "'accruals'", {"shipments_accrued": "n", "accrual_estimate": "est", "actual_billed": "billed", "actual_payable": "payable", "error": "error", "error_pct": "error / payable", "lh_fsc_error_pct": "core_error / pay_core", "accessorial_error_pct": "acc_error / pay_acc", "shipment_mape": "mape", "shipment_median_ape": "mid", "shipment_share_over_band": "band", "accessorial_share": "acc / est", "accessorial_share_of_error": "acc_error / error", "error_pct_of_billed": "(est - billed) / billed"}),
    _leaves("(SELECT avg(abs(error / payable)) AS mape, avg(error / payable) AS bias, arg_max(error / payable, abs(error / payable)) AS worst_error_pct FROM aw WHERE m IS NOT NULL)", "'accruals'", _same("mape", "bias", "worst_error_pct")),
    _leaves("(SELECT * FROM se WHERE month_end IS NULL)", "'accruals'", {"late_auth_effect": "late_auth_effect", "late_auth_share": "late_auth_effect / abs(accrual_estimate_as_built - actual_payable)", "error_pct_auth_at_delivery": "(accrual_estimate_auth_at_delivery - actual_payable) / actual_payable"}),
    _leaves("(SELECT count(*) AS swept, count(*) FILTER (changed) AS changed, max(best_net - current_net) AS largest_gain FROM rc_)", "'tolerances'", _same("swept", "changed", "largest_gain")),
    _leaves("rc_", "'swept.' || tolerance", _same("current_value", "best_value", "recommended_value")),
]
ORACLES["summary_block"] = sql(
    [*_A, NAIVE, OUTCOMES, NAIVE_OUTCOMES.removeprefix(LABELS + ","), f"\nsc AS ({_SCORES})", f"\nov AS {_of('overview_metrics')}", f"\nfc AS {_of('false_flag_causes')}", f"\naw AS ({_WHOLE})", f"\nse AS {_of('accrual_sensitivity')}", f"\nrc_ AS {_of('sweep_recommendation')}"],
    "SELECT path, round(value, 6) AS value FROM (" + " UNION ALL ".join(_BLOCK) + ")",
)
