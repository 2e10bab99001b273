"""Stock, purchasing, risk and packaging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybook.catalog.base import AS_OF, SQL_VIEWS, query, sql_base, sql_pack, sql_regional
from tallybook.catalog.derivations import SQL_3PL_CLASS, SQL_3PL_SKU, SQL_PO_CLASS
from tallybook.catalog.erp import facts
from tallybook.functions import codes
from tallybook.operators import erp_lines
from tallybook.plans import erp, inventory, packaging, purchasing, risk

SINCE = packaging.window_start(AS_OF, 6)

SQL_VIEWS.update({
    "s_branch": """SELECT code, CASE WHEN branch_name = '' THEN 'Unknown' ELSE branch_name END AS branch, sum(stock_on_hand) AS soh, sum(available) AS avail,
 sum(incoming) AS incoming, bool_or(stock_on_hand <> 0 OR incoming <> 0) AS held FROM f_stock WHERE code <> '' GROUP BY 1, 2""",
    "s_stock": """SELECT code, sum(soh) AS soh, sum(avail) AS avail, sum(incoming) AS incoming,
 coalesce(sum(soh) FILTER (branch IN ('Amazon FBA', 'AmazonFBA AU')), 0) AS fba_soh, coalesce(sum(avail) FILTER (branch IN ('Amazon FBA', 'AmazonFBA AU')), 0) AS fba_avail,
 coalesce(sum(incoming) FILTER (branch IN ('Amazon FBA', 'AmazonFBA AU')), 0) AS fba_incoming,
 coalesce(string_agg(branch || ':' || CAST(soh AS BIGINT) || '/' || CAST(incoming AS BIGINT), ';' ORDER BY branch) FILTER (held), '') AS branches FROM s_branch GROUP BY 1""",
    "s_meta": "SELECT code, arg_max(category, part_id) AS category FROM f_product_meta GROUP BY 1",
    "s_inv": f"""SELECT s.code AS sku, coalesce(m.category, '') AS category,
 CASE WHEN s.code LIKE '%-NPS-100' THEN 'soap' WHEN s.code LIKE 'AU-CTN-%' THEN 'carton' WHEN s.code LIKE 'AU-B-%' THEN 'base-b' ELSE 'base' END AS kind,
 s.soh + coalesce(t.soh, 0) AS soh, s.avail + coalesce(t.avail, 0) AS avail, s.incoming, s.soh + coalesce(t.soh, 0) - s.fba_soh AS warehouse_soh,
 s.avail + coalesce(t.avail, 0) - s.fba_avail AS warehouse_avail, s.incoming - s.fba_incoming AS warehouse_incoming, s.fba_soh AS fba,
 (s.code LIKE 'AU-SC-%' OR s.code LIKE 'AU-CTN-SC-%' OR s.code LIKE 'AU-B-SC-%' OR s.code LIKE 'D-AU-SC-%') AS discontinued
 FROM s_stock s LEFT JOIN s_meta m ON m.code = s.code LEFT JOIN (SELECT {sql_base('code')} AS base, sum((soh - fba_soh) * 12) AS soh, sum((avail - fba_avail) * 12) AS avail
  FROM s_stock WHERE code LIKE 'AU-SRT-%' GROUP BY 1) t ON t.base = s.code
 WHERE s.code LIKE 'AU-%' AND s.code NOT LIKE '%CANVAS%' AND s.code NOT LIKE 'AU-BAG%' AND s.code NOT LIKE 'AU-SRT-%' AND s.code NOT LIKE 'AU-CTN-SRT-%'
  AND (s.code LIKE '%-NPS-100' OR coalesce(m.category, '') IN ('', 'Finished Products', 'Bicarb Based'))""",
    "s_base_stock": """SELECT CASE WHEN kind = 'carton' THEN 'AU-' || substr(sku, 8, length(sku) - 10) || '-35' ELSE sku END AS base,
 coalesce(sum(warehouse_soh) FILTER (kind <> 'carton'), 0) AS loose, coalesce(sum(fba) FILTER (kind <> 'carton'), 0) AS fba,
 coalesce(sum(warehouse_soh * 48) FILTER (kind = 'carton'), 0) AS from_cartons, coalesce(sum(warehouse_soh) FILTER (kind = 'carton' AND warehouse_soh > 0), 0) AS carton_count
 FROM s_inv WHERE NOT discontinued AND (kind IN ('base', 'base-b') OR (kind = 'carton' AND sku LIKE 'AU-CTN-%_-48')) GROUP BY 1""",
    "s_po": """SELECT reference, any_value(company) AS company, any_value(created_date) AS created_date, any_value(status) AS status, any_value(fully_received_date) AS fully_received_date,
 any_value(delivery_date) AS delivery_date, any_value(estimated_delivery_date) AS estimated_delivery_date, count(*) AS line_count,
 count(*) FILTER (qty > 0) > 0 AND count(*) FILTER (qty > 0 AND qty_received < qty) = 0 AS received_by_lines,
 coalesce(any_value(delivery_date), any_value(estimated_delivery_date)) AS expected_date FROM f_po_lines GROUP BY 1""",
    "s_open_po": "SELECT * FROM s_po WHERE fully_received_date IS NULL AND lower(status) NOT IN ('completed', 'void', 'voided', 'cancelled', 'closed') AND NOT received_by_lines",
    "s_leads": """SELECT * FROM (SELECT reference, company, created_date, fully_received_date, date_diff('day', created_date, fully_received_date) AS days,
  row_number() OVER (PARTITION BY company ORDER BY fully_received_date DESC, reference DESC) AS rn FROM s_po
  WHERE fully_received_date >= DATE '2001-06-30' - 547 AND date_diff('day', created_date, fully_received_date) BETWEEN 0 AND 365) WHERE rn <= 10""",
    "s_incoming": f"""SELECT base, reference, expected_date, sum(q) AS qty FROM (SELECT CASE WHEN l.code LIKE 'AU-CTN-%' OR l.code LIKE 'AU-SRT-%' THEN {sql_base('l.code')} ELSE l.code END AS base,
  o.reference, o.expected_date, l.qty * CASE WHEN l.code LIKE 'AU-CTN-%' OR l.code LIKE 'AU-SRT-%' THEN {sql_pack('l.code')} ELSE 1 END AS q
  FROM f_po_lines l JOIN s_open_po o ON o.reference = l.reference WHERE l.code LIKE 'AU-%') GROUP BY 1, 2, 3""",
    "s_incoming_sku": """SELECT base, sum(qty) AS qty, count(*) AS pos, min(expected_date) AS next_date,
 arg_max(reference, struct_pack(d := -date_diff('day', DATE '1970-01-01', expected_date), r := reference)) FILTER (expected_date IS NOT NULL) AS next_ref,
 list_aggregate(list_slice(list_reverse(list_sort(list(reference))), 1, 3), 'string_agg', ',') AS refs FROM s_incoming GROUP BY 1""",
    "s_rates": """SELECT sku, tins, cur, CASE WHEN tins / 92.0::DOUBLE = 0 AND cur > 0 THEN cur / 30.0::DOUBLE ELSE tins / 92.0::DOUBLE END AS rate, tins / 92.0::DOUBLE = 0 AND cur > 0 AS provisional FROM (
 SELECT sku, CAST(coalesce(sum(t) FILTER (ym <> '2001-06'), 0) AS DOUBLE) AS tins, CAST(coalesce(sum(t) FILTER (ym = '2001-06'), 0) AS DOUBLE) AS cur
 FROM (SELECT sku, ym, CAST(col + woo2 + dist + woo + amz AS DECIMAL(38,4)) AS t, revenue FROM s_merged WHERE ym IN ('2001-03', '2001-04', '2001-05', '2001-06')) WHERE t <> 0 OR revenue <> 0 GROUP BY 1)""",
    "s_tins": "SELECT substr(code, 3) AS sku, sum(soh) AS soh, sum(incoming) AS incoming FROM s_stock WHERE regexp_matches(code, '^T-AU-.*-(35|85)$') AND code NOT LIKE 'T-AU-BLANK%' GROUP BY 1",
})


def stock(v):
    return inventory.stock_by_sku(v("f_stock"))


def meta(v):
    return inventory.latest_meta(v("f_product_meta"))


def stock_inventory(v):
    return inventory.inventory(stock(v), meta(v))


@query("stock_by_sku", """
SELECT code, CAST(soh AS BIGINT) AS soh, CAST(avail AS BIGINT) AS avail, CAST(incoming AS BIGINT) AS incoming, CAST(fba_soh AS BIGINT) AS fba_soh,
 CAST(fba_avail AS BIGINT) AS fba_avail, CAST(fba_incoming AS BIGINT) AS fba_incoming, branches FROM s_stock""")
def stock_by_sku(v):
    entries = F.array_sort(F.map_entries("branches"))
    shown = F.transform(entries, lambda e: F.concat(
        e["key"], F.lit(":"), e["value"]["soh"].cast("string"), F.lit("/"), e["value"]["incoming"].cast("string")))
    return stock(v).withColumn("branches", F.array_join(shown, ";")).drop("name")


@query("stock_code_probe", """
SELECT code, 'field' AS kind, part, CAST(value AS BIGINT) AS value FROM (
 SELECT code, 'stock_on_hand' AS part, sum(stock_on_hand) AS value FROM f_stock WHERE code <> '' GROUP BY 1
 UNION ALL SELECT code, 'available', sum(available) FROM f_stock WHERE code <> '' GROUP BY 1
 UNION ALL SELECT code, 'incoming', sum(incoming) FROM f_stock WHERE code <> '' GROUP BY 1) WHERE value <> 0
UNION ALL SELECT code, 'branch', branch || ' soh', CAST(soh AS BIGINT) FROM s_branch WHERE held
UNION ALL SELECT code, 'branch', branch || ' incoming', CAST(incoming AS BIGINT) FROM s_branch WHERE held""")
def stock_code_probe(v):
    return inventory.code_probe(v("f_stock"), ("stock_on_hand", "available", "incoming"))


@query("stock_join_meta", "SELECT s.code, CAST(s.soh AS BIGINT) AS soh, coalesce(m.category, '') AS category FROM s_stock s LEFT JOIN s_meta m ON m.code = s.code")
def stock_join_meta(v):
    return inventory.with_meta(stock(v), meta(v)).select("code", "soh", "category")


@query("stock_lookup_code_or_base", """
SELECT i.order_id, i.code, i.base_sku, CAST(i.qty AS DOUBLE) AS qty, CAST(coalesce(a.soh, b.soh) AS BIGINT) AS soh
FROM (SELECT order_id, code, coalesce(base_sku, code) AS base_sku, qty FROM s_erp_lines WHERE code <> '') i
LEFT JOIN s_stock a ON a.code = i.code LEFT JOIN s_stock b ON b.code = i.base_sku""")
def stock_lookup_code_or_base(v):
    lines = erp_lines.derive_lines(v("f_erp_lines"), "sales").filter(F.col("code").isNotNull())
    return inventory.lookup_code_or_base(lines, stock(v), "soh").select("order_id", "code", "base_sku", "qty", "soh")


@query("empty_tins_by_sku", "SELECT sku, CAST(soh AS BIGINT) AS soh, CAST(incoming AS BIGINT) AS incoming FROM s_tins")
def empty_tins_by_sku(v):
    return inventory.empty_tins(stock(v))


@query("inventory_rollup", """
SELECT sku, category, kind, CASE kind WHEN 'carton' THEN 48 ELSE 1 END::BIGINT AS mult, CAST(soh AS BIGINT) AS soh, CAST(avail AS BIGINT) AS avail, CAST(incoming AS BIGINT) AS incoming,
 CAST(warehouse_soh AS BIGINT) AS warehouse_soh, CAST(warehouse_avail AS BIGINT) AS warehouse_avail, CAST(warehouse_incoming AS BIGINT) AS warehouse_incoming,
 CAST(fba AS BIGINT) AS fba, discontinued FROM s_inv""")
def inventory_rollup(v):
    return inventory.inventory_sorted(stock_inventory(v)).drop("name")


@query("base_stock_rollup", """
SELECT base, CAST(loose AS BIGINT) AS loose, CAST(fba AS BIGINT) AS fba, CAST(from_cartons AS BIGINT) AS from_cartons, CAST(carton_count AS BIGINT) AS carton_count FROM s_base_stock""")
def base_stock_rollup(v):
    return inventory.base_stock(stock_inventory(v))


@query("fully_received_pos", "SELECT reference, company FROM s_po WHERE received_by_lines")
def fully_received_pos(v):
    return purchasing.po_headers(v("f_po_lines")).filter("received_by_lines").select("reference", "company")


@query("open_pos", "SELECT reference, company, status, CAST(created_date AS VARCHAR) AS created_date, CAST(expected_date AS VARCHAR) AS expected_date FROM s_open_po")
def open_pos(v):
    return purchasing.open_pos(v("f_po_lines")).select(
        "reference", "company", "status", "created_date", purchasing.expected_date().alias("expected_date"))


@query("po_rollup", f"""
WITH b AS (SELECT reference, coalesce(sum(qty) FILTER (c = 'finished'), 0) AS fin, coalesce(sum(qty) FILTER (c = 'soap'), 0) AS soap, coalesce(sum(qty) FILTER (c = 'raw_tin'), 0) AS tin,
  coalesce(sum(qty) FILTER (c = 'packaging'), 0) AS pkg, coalesce(sum(qty) FILTER (c = 'carton_tray'), 0) AS ctn, coalesce(sum(qty) FILTER (c = 'fees'), 0) AS fees, coalesce(sum(qty) FILTER (c = 'other'), 0) AS oth,
  count(DISTINCT code) FILTER (code <> '' AND c <> 'fees') AS skus FROM (SELECT *, {SQL_PO_CLASS} AS c FROM f_po_lines) GROUP BY 1),
t AS (SELECT *, CASE WHEN fin > 0 THEN 'finished' WHEN soap > 0 THEN 'soap' WHEN tin > pkg THEN 'tins' WHEN pkg > 0 THEN 'packaging' WHEN ctn > 0 THEN 'finished' ELSE 'other' END AS type FROM b)
SELECT p.reference AS po, p.company, CAST(p.created_date AS VARCHAR) AS created_date, CAST(p.expected_date AS VARCHAR) AS expected_date,
 CASE WHEN p.delivery_date IS NOT NULL THEN 'delivery_date' WHEN p.estimated_delivery_date IS NOT NULL THEN 'estimated_delivery_date' END AS expected_date_source,
 p.status, CAST(p.fully_received_date AS VARCHAR) AS fully_received_date, CAST(p.line_count AS BIGINT) AS line_count, CAST(t.skus AS BIGINT) AS sku_count,
 CAST(fin + ctn AS BIGINT) AS finished_units, CAST(soap AS BIGINT) AS soap_units, CAST(tin AS BIGINT) AS raw_tin_units, CAST(pkg AS BIGINT) AS packaging_units,
 CAST(fees AS BIGINT) AS fee_lines,
 CAST(CASE type WHEN 'finished' THEN fin + ctn WHEN 'soap' THEN soap WHEN 'tins' THEN tin WHEN 'packaging' THEN pkg ELSE fin + soap + tin + pkg + ctn + oth END AS BIGINT) AS total_units, type
FROM s_po p JOIN t ON t.reference = p.reference""")
def po_rollup(v):
    return purchasing.po_rollup(v("f_po_lines"))


@query("newest_n_per_supplier", """
SELECT company, reference, CAST(created_date AS VARCHAR) AS created_date, CAST(fully_received_date AS VARCHAR) AS fully_received_date, CAST(days AS BIGINT) AS days, CAST(rn AS BIGINT) AS rn FROM s_leads""")
def newest_n_per_supplier(v):
    return purchasing.lead_samples(v("f_po_lines"), AS_OF).select("company", "reference", "created_date", "fully_received_date", "days", "rn")


@query("supplier_lead_times", """
SELECT company AS key, company AS supplier, CAST(floor(median(days) + 0.5) AS BIGINT) AS median_days, CAST(min(days) AS BIGINT) AS min_days, CAST(max(days) AS BIGINT) AS max_days,
 CAST(count(*) AS BIGINT) AS samples, arg_min(reference, rn) AS latest_ref, CAST(arg_min(days, rn) AS BIGINT) AS latest_days FROM s_leads GROUP BY 1""")
def supplier_lead_times(v):
    return purchasing.lead_times(purchasing.lead_samples(v("f_po_lines"), AS_OF))


@query("incoming_by_sku", """
SELECT base, i.reference, CAST(i.expected_date AS VARCHAR) AS expected_date, CAST(i.qty AS BIGINT) AS po_qty, CAST(k.qty AS BIGINT) AS qty, CAST(pos AS BIGINT) AS pos,
 CAST(next_date AS VARCHAR) AS next_date, next_ref FROM s_incoming i JOIN s_incoming_sku k USING (base)""")
def incoming_by_sku(v):
    return purchasing.incoming_by_sku(purchasing.incoming_units(v("f_po_lines")))


@query("po_closure_profile", """
WITH p AS (SELECT *, reference IN (SELECT reference FROM s_open_po) AS opn, lower(status) NOT IN ('completed', 'void', 'voided', 'cancelled', 'closed') AS old FROM s_po)
SELECT measure, CAST(n AS BIGINT) AS n FROM (
 SELECT 'total' AS measure, count(*) AS n FROM p UNION ALL SELECT 'completed_date_set', 0 UNION ALL SELECT 'cancellation_date_set', 0 UNION ALL SELECT 'is_void_true', 0
 UNION ALL SELECT 'fully_received_date_set', count(fully_received_date) FROM p UNION ALL SELECT 'fully_received_by_lines', count(*) FILTER (received_by_lines) FROM p
 UNION ALL SELECT 'open_by_old_rule', count(*) FILTER (old) FROM p UNION ALL SELECT 'open_by_new_rule', count(*) FILTER (opn) FROM p
 UNION ALL SELECT 'open_delivery_date_set', count(delivery_date) FILTER (opn) FROM p UNION ALL SELECT 'open_estimated_delivery_date_set', count(estimated_delivery_date) FILTER (opn) FROM p
 UNION ALL SELECT 'open_estimated_arrival_date_set', 0 UNION ALL SELECT 'open_supplier_acceptance_date_set', 0
 UNION ALL SELECT 'open_no_date', count(*) FILTER (opn AND expected_date IS NULL) FROM p
 UNION ALL SELECT 'open_delta', count(*) FILTER (old) - count(*) FILTER (opn) FROM p
 UNION ALL SELECT 'status ' || status, count(*) FROM p GROUP BY 1)""")
def po_closure_profile(v):
    return purchasing.closure_profile(v("f_po_lines"))


@query("oldest_closed_approved", """
SELECT reference, company, CAST(created_date AS VARCHAR) AS created_date FROM s_po WHERE lower(status) = 'approved' AND reference NOT IN (SELECT reference FROM s_open_po)
ORDER BY created_date, reference LIMIT 20""")
def oldest_closed_approved(v):
    return purchasing.closed_but_approved(v("f_po_lines"), 20).select("reference", "company", "created_date")


_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(created_date) * 3 - 2, 3)"
_NEXT_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', (month(created_date) % 12 + 1) * 3 - 2, 3)"
_SCHEDULE = f"""SELECT DISTINCT CASE WHEN day(created_date) % 7 = 0 THEN 'x' ELSE 'Cust ' || substr(reference, 4) END AS cust_po,
 CASE day(created_date) % 6 WHEN 0 THEN CAST(day(created_date) AS STRING) || '-' || {_MON} WHEN 1 THEN CAST(day(created_date) AS STRING) || ' & ' || CAST(day(created_date) % 28 + 1 AS STRING) || ' ' || {_MON}
  WHEN 2 THEN CAST(day(created_date) AS STRING) || ' ' || {_MON} || ' & 3 ' || {_NEXT_MON} WHEN 3 THEN 'tbc ' || {_MON} WHEN 4 THEN 'soon' ELSE {_MON} || ' ' || CAST(day(created_date) AS STRING) END AS fill_text,
 CAST(day(created_date) AS STRING) || '/' || CAST(month(created_date) AS STRING) || '/2001' AS due_text, reference, created_date FROM f_po_lines"""


@query("schedule_match_pos", f"""
WITH r AS (SELECT *, day(created_date) AS d, day(created_date) % 28 + 1 AS d2, month(created_date) AS m, month(created_date) % 12 + 1 AS m2, day(created_date) % 6 AS k FROM ({_SCHEDULE})),
a AS (SELECT *, CAST(make_date(2001, m, 1) + CAST(d - 1 AS INT) AS DATE) AS x, CAST(make_date(2001, m, 1) + CAST(d2 - 1 AS INT) AS DATE) AS y, make_date(2001, m2, 3) AS z,
 CAST(make_date(2002, m, 1) + CAST(d - 1 AS INT) AS DATE) AS x2, CAST(make_date(2002, m, 1) + CAST(d2 - 1 AS INT) AS DATE) AS y2, make_date(2002, m2, 3) AS z2 FROM r),
b AS (SELECT *, CASE WHEN date_diff('day', x, DATE '2001-06-30') > 120 THEN x2 ELSE x END AS fx, CASE WHEN date_diff('day', y, DATE '2001-06-30') > 120 THEN y2 ELSE y END AS fy,
 CASE WHEN date_diff('day', z, DATE '2001-06-30') > 120 THEN z2 ELSE z END AS fz FROM a),
c AS (SELECT b.*, CASE k WHEN 0 THEN fx WHEN 1 THEN least(fx, fy) WHEN 2 THEN least(fx, fz) WHEN 5 THEN fx END AS nd, p.estimated_delivery_date AS cur, p.reference IS NOT NULL AS found
 FROM b LEFT JOIN s_po p ON cust_po <> 'x' AND p.reference = b.reference)
SELECT cust_po, fill_text, due_text, CASE WHEN cust_po <> 'x' THEN reference END AS ref, CAST(cur AS VARCHAR) AS current_etd, CAST(nd AS VARCHAR) AS new_etd,
 CASE WHEN NOT found THEN 'nomatch' WHEN nd IS NULL THEN 'baddate' WHEN nd = cur THEN 'same' ELSE 'change' END AS change, k IN (1, 2) AS several_dates,
 coalesce(nd > try_cast('2001-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE), FALSE) AS after_due FROM c""")
def schedule_match_pos(v):
    schedule = v.select(_SCHEDULE).drop("reference", "created_date")
    return purchasing.schedule_match(schedule, v("f_po_lines"), AS_OF)


def _rates(v):
    return risk.run_rate(erp.sku_rows(facts(v)), AS_OF)


@query("run_rate", "SELECT sku, tins, cur AS current_tins, rate, provisional AS rate_provisional FROM s_rates")
def run_rate(v):
    return _rates(v)


@query("stock_risk", """
WITH a AS (SELECT i.sku, coalesce(b.loose, 0) AS loose, coalesce(b.fba, 0) AS fba, coalesce(b.from_cartons, 0) AS ctn, coalesce(b.carton_count, 0) AS cc, coalesce(r.rate, 0) AS rate,
  coalesce(r.provisional, FALSE) AS prov, coalesce(n.qty, 0) AS inq, n.next_date, n.next_ref, coalesce(n.refs, '') AS refs, coalesce(t.soh, 0) AS es, coalesce(t.incoming, 0) AS ei
 FROM s_inv i LEFT JOIN s_base_stock b ON b.base = i.sku LEFT JOIN s_rates r ON r.sku = i.sku LEFT JOIN s_incoming_sku n ON n.base = i.sku LEFT JOIN s_tins t ON t.sku = i.sku
 WHERE NOT i.discontinued AND i.kind IN ('base', 'base-b')),
c AS (SELECT *, CAST(loose + ctn + fba AS BIGINT) AS st, CASE WHEN rate > 0 THEN CAST(loose + ctn + fba AS DOUBLE) / rate END AS dl FROM a)
SELECT sku, st AS current_stock, CAST(loose AS BIGINT) AS stock_loose_tins, CAST(fba AS BIGINT) AS stock_fba, CAST(ctn AS BIGINT) AS stock_from_cartons, CAST(cc AS BIGINT) AS stock_carton_count,
 CAST(es AS BIGINT) AS empty_tins_soh, CAST(ei AS BIGINT) AS empty_tins_incoming, prov AS rate_provisional, CAST(inq AS BIGINT) AS incoming_qty, next_ref AS next_po_ref, refs AS next_po_refs,
 CASE WHEN rate = 0 AND st = 0 THEN 'inactive' WHEN rate = 0 THEN 'no-sales' WHEN dl < 14 THEN CASE WHEN inq = 0 THEN 'critical' ELSE 'critical-incoming' END
  WHEN dl < 30 THEN CASE WHEN inq = 0 THEN 'low' ELSE 'low-incoming' END WHEN dl < 60 THEN 'monitor' ELSE 'stable' END AS risk,
 floor(dl * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS days_left, floor(rate * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS run_rate_per_day, CAST(date_diff('day', DATE '2001-06-30', next_date) AS BIGINT) AS next_po_days FROM c""")
def stock_risk(v):
    return risk.risk_sorted(risk_rows(v))


def risk_rows(v):
    inv = stock_inventory(v)
    incoming = purchasing.incoming_shown(purchasing.incoming_units(v("f_po_lines")))
    return risk.stock_risk(inv, inventory.base_stock(inv), incoming, _rates(v), inventory.empty_tins(stock(v)), AS_OF)


_PACK_SQL = """SELECT s.*, CASE WHEN s.code LIKE 'P-AU-SRT-%' THEN 'srt' WHEN s.code LIKE 'P-OC-AU-CTN-%' THEN 'cartons' END AS grp,
 CASE WHEN s.code LIKE 'P-AU-SRT-%' THEN 'AU-' || substr(s.code, 10) || '-35' WHEN s.code LIKE 'P-OC-AU-CTN-%' THEN substr(s.code, 6) END AS derived
 FROM s_stock s WHERE s.code LIKE 'P-AU-SRT-%' OR s.code LIKE 'P-OC-AU-CTN-%'"""


@query("packaging_link_check", f"""
SELECT p.code, p.grp, p.derived, l.code AS linked_sku FROM ({_PACK_SQL}) p LEFT JOIN s_stock l ON l.code = p.derived""")
def packaging_link_check(v):
    return packaging.link_check(stock(v)).select("code", "grp", "derived", "linked_sku")


@query("packaging_stock", f"""
SELECT p.grp, p.code AS sku, CAST(p.soh AS BIGINT) AS soh, CAST(p.avail AS BIGINT) AS avail, CAST(p.incoming AS BIGINT) AS incoming, l.code AS linked_sku,
 CASE p.grp WHEN 'srt' THEN 12 ELSE 4 END::BIGINT AS capacity, FALSE AS manual_demand, l.code IS NULL AS discontinued FROM ({_PACK_SQL}) p LEFT JOIN s_stock l ON l.code = p.derived""")
def packaging_stock(v):
    return packaging.packaging_stock(stock(v)).drop("name", "branches").orderBy("grp", "sku")


THREEPL = f"SELECT part_id, {SQL_3PL_SKU} AS sku, name, part_id % 97 AS quantity, part_id % 7 AS quantity_reserved, part_id % 11 AS quantity_incoming, part_id % 13 AS low_threshold, part_id % 5 AS cost, CASE part_id % 4 WHEN 0 THEN 'Packaging items' WHEN 1 THEN 'Finished' WHEN 2 THEN 'In Manufacturing' ELSE '' END AS category FROM f_sku"


@query("threepl_packaging", f"""
SELECT {SQL_3PL_CLASS} AS grp, sku, name, CAST(quantity AS BIGINT) AS on_hand, CAST(quantity_reserved AS BIGINT) AS reserved, CAST(quantity - quantity_reserved AS BIGINT) AS available,
 CAST(quantity_incoming AS BIGINT) AS incoming, CAST(low_threshold AS BIGINT) AS low_threshold, CAST(cost AS BIGINT) AS unit_cost,
 CASE WHEN sku LIKE 'T-%' THEN substr(sku, 3) WHEN sku = 'P-CA-SRT-SS' THEN '' WHEN sku LIKE 'P-CA-SRT-%' THEN 'CA-' || substr(sku, 10) || '-35' END AS linked_sku,
 CASE WHEN sku LIKE 'T-%' THEN '35g' END AS size, CASE WHEN sku LIKE 'P-CA-SRT-%' THEN substr(sku, 10, 2) END AS scent,
 CASE WHEN sku LIKE 'P-CA-SRT-%' THEN substr(sku, 13) END AS form, CASE WHEN sku LIKE 'P-CA-BLANK-CTN-%' THEN CAST(substr(sku, 16, 1) AS BIGINT) WHEN sku LIKE 'P-BLANK-%' THEN 0 END AS tray_capacity,
 CASE WHEN sku LIKE 'T-%' THEN NULL WHEN sku = 'P-ENV-A1' THEN 3 ELSE 4 END::BIGINT AS lead_time_months
FROM ({THREEPL}) WHERE {SQL_3PL_CLASS} IS NOT NULL""")
def threepl_packaging(v):
    return packaging.threepl_packaging(v.select(THREEPL), {"P-ENV-A1": 3})


@query("packaging_overrides", f"""
SELECT part_id, sku, CASE WHEN sku = 'T-CA-LL-VLB-35' THEN 'Retired tins' ELSE name END AS name, sku IN ('T-CA-LL-VLB-35', 'T-CA-CL-NPO-35') AS le_blank
FROM (SELECT part_id, sku, name FROM ({THREEPL}) WHERE sku LIKE 'T-%' AND sku <> 'T-CA-EF-BCF-35')""")
def packaging_overrides(v):
    overlay = v.spark.createDataFrame(
        [("T-CA-LL-VLB-35", "Retired tins", True), ("T-CA-CL-NPO-35", None, True)], "sku string, name string, le_blank boolean")
    tins = v.select(THREEPL).filter(F.col("sku").startswith("T-")).select("part_id", "sku", "name", F.lit(True).alias("le_blank"))
    out = packaging.apply_overrides(tins, ["T-CA-EF-BCF-35"], overlay, ("le_blank", "committed"))
    return out.withColumn("le_blank", F.coalesce("le_blank", F.lit(False)))


_PACK_TEST = "(sku ILIKE 'AU-SRT-%' OR sku ILIKE 'AU-CTN-%' OR sku ILIKE 'WC-AU-%')"


@query("d2c_orders", f"""
SELECT id, market, status FROM f_store_orders o WHERE NOT EXISTS (SELECT 1 FROM f_store_items i WHERE i.order_id = o.id AND {_PACK_TEST})""")
def d2c_orders(v):
    return packaging.d2c_orders(v("f_store_orders"), v("f_store_items")).select("id", "market", "status")


@query("mailer_demand", f"""
WITH d AS (SELECT o.id, strftime(o.local_date, '%Y-%m') AS ym, sum(CASE WHEN i.sku LIKE '%-35' OR i.sku LIKE '%-35M' THEN i.quantity ELSE 0 END) AS a,
  sum(CASE WHEN i.sku LIKE '%-85' OR i.sku LIKE '%-85M' THEN i.quantity ELSE 0 END) AS b FROM f_store_orders o JOIN f_store_items i ON i.order_id = o.id
 WHERE o.market = 'AU' AND o.status IN ('completed', 'processing') AND o.local_date >= DATE '{SINCE}'
  AND NOT EXISTS (SELECT 1 FROM f_store_items x WHERE x.order_id = o.id AND (x.sku LIKE 'AU-SRT-%' OR x.sku LIKE 'AU-CTN-%' OR x.sku LIKE 'WC-AU-%')) GROUP BY 1, 2),
t AS (SELECT *, b > 6 OR a > 12 OR (a > 0 AND b > 0 AND a + b > 10) AS box FROM d WHERE a + b > 0)
SELECT ym, CAST(count(*) FILTER (box) AS BIGINT) AS box, CAST(count(*) FILTER (NOT box AND (b > 0 OR a > 6)) AS BIGINT) AS large_envelope,
 CAST(count(*) FILTER (NOT box AND b = 0 AND a <= 6) AS BIGINT) AS envelope, CAST(0 AS BIGINT) AS unassigned, CAST(count(*) AS BIGINT) AS orders FROM t GROUP BY 1""")
def mailer_demand(v):
    return packaging.mailer_demand(v("f_store_orders"), v("f_store_items"), SINCE)


@query("tray_carton_demand", f"""
WITH u AS (SELECT ym, code, channel, sum(units) AS units FROM (
  SELECT strftime(i.local_date, '%Y-%m') AS ym, i.sku AS code, 'woo' AS channel, CAST(i.quantity AS DECIMAL(18,4)) AS units FROM f_store_items i JOIN f_store_orders o ON o.id = i.order_id
   WHERE i.market = 'AU' AND o.status IN ('completed', 'processing') AND i.local_date >= DATE '{SINCE}' AND {_PACK_TEST.replace('sku', 'i.sku')}
  UNION ALL SELECT o.ym, i.code, 'supermarket', i.qty FROM s_erp_lines i JOIN s_erp_orders o ON o.id = i.order_id WHERE o.status = 'APPROVED' AND o.attr IN ('col', 'woo2', 'dist')
   AND o.created_date >= '{SINCE}' AND {_PACK_TEST.replace('sku', 'i.code')}) GROUP BY 1, 2, 3 HAVING sum(units) > 0),
x AS (SELECT ym, 'trays' AS grp, 'P-AU-SRT-' || rtrim(substr(code, 8, length(code) - 10), '-') AS sku, units FROM u WHERE code LIKE 'AU-SRT-%x12'
 UNION ALL SELECT ym, 'cartons', 'P-OC-' || code, units FROM u WHERE code LIKE 'AU-CTN-%-48' AND code NOT LIKE 'AU-CTN-SRT-MIX%'
 UNION ALL SELECT ym, 'trays', 'P-AU-SRT-' || substr(code, 8, length(code) - 10), units * 4 FROM u WHERE code LIKE 'AU-CTN-%-48' AND code NOT LIKE 'AU-CTN-SRT-MIX%'
 UNION ALL SELECT ym, 'unmapped', code || ' (' || channel || ')', units FROM u WHERE code NOT LIKE 'WC-AU-%' AND code NOT LIKE 'AU-SRT-%x12' AND (code NOT LIKE 'AU-CTN-%-48' OR code LIKE 'AU-CTN-SRT-MIX%'))
SELECT ym, grp, sku, CAST(sum(units) AS DOUBLE) AS units FROM x GROUP BY 1, 2, 3""")
def tray_carton_demand(v):
    erp_orders = erp_lines.with_channel(v("f_erp_orders"))
    units = packaging.pack_units(v("f_store_orders"), v("f_store_items"), erp_orders, v("f_erp_lines"), SINCE)
    return packaging.tray_carton_demand(units)
