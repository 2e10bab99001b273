"""Golden vectors for the column rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallybook.functions import calendar, channels, codes, text


def apply(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("x"))).collect()]


def test_base_code_and_pack_size(spark):
    cases = {
        "WC-AU-OG-NPO-35-NL": ("AU-OG-NPO-35", 54), "WC-AU-OG-NPO-35-WC": ("AU-OG-NPO-35", 54), "WC-AU-OG-NPO-35": ("AU-OG-NPO-35", 54),
        "WC-AU-NL": ("AU-NL", 54), "WC-AU-": ("WC-AU-", 1), "AU-CTN-OG-NPO-48": ("AU-OG-NPO-35", 48), "AU-CTN--48": ("AU-CTN--48", 1),
        "AU-CTN-SRT-MIX-72-V3": ("AU-CTN-SRT-MIX-72-V3", 72), "AU-CTN-SRT-MIX-48": ("AU-SRT-MIX-35", 48),
        "AU-SRT-OG-NPOx12": ("AU-OG-NPO", 12), "AU-SRT-OG-NPO--x12": ("AU-OG-NPO", 12), "AU-SRT--x12": ("AU-", 12), "AU-SRT-x12": ("AU-SRT-x12", 1),
        "AU-OG-NPO-35M": ("AU-OG-NPO-35", 1), "AU-M": ("AU-M", 1), " AU-OG-NPO-85 ": ("AU-OG-NPO-85", 1), "196": ("196", 1), "": (None, 1), None: (None, 1),
    }
    assert apply(spark, codes.base_code, cases) == [b for b, _ in cases.values()]
    assert apply(spark, codes.pack_size, cases) == [m for _, m in cases.values()]


def test_regional_and_discontinued(spark):
    values = ["AU-X", "wc-au-X", "D-AU-X", "CA-AU-X", "196", "", None, " au-x"]
    assert apply(spark, codes.is_regional, values) == [True, True, True, False, False, False, False, True]
    values = ["AU-SC-BCF-35", "AU-CTN-SC-BCF-48", "AU-B-SC-BCF-35", "D-AU-SC-BCF-35", "AU-OG-SC-35", "CA-SC-BCF-35"]
    assert apply(spark, codes.is_discontinued, values) == [True, True, True, True, False, False]


def test_marketplace_aliases(spark):
    assert apply(spark, codes.marketplace_sku, [" HP-G88K-NR69 ", "US-OG-NPO-35-AM", "us-og-npo-35", "AU-OG-NPO-35", "", None]) == [
        "CA-FF-VLB-35", "CA-OG-NPO-35", None, None, None, None]
    assert apply(spark, codes.regional_marketplace_sku, [" AU-X ", "CA-OG-NPO-35", None]) == ["AU-X", None, None]


def test_company_to_channel(spark):
    cases = {
        "WOOLWORTHS - Moorebank - NDC": "woo2", "Coles": "col", "Grocery Holdings Pty Ltd - RedBank": "col", "Grocery Holdings Pty Ltd - NDC SOMERTON": "col",
        "Kemps Creek": "col", "Amazon Seller X": "amz", "Amazon FBA": None, "Stock Adjustments": None, "": None, "[Redacted]": None, "Mrs": None,
        "Momentum Foods": "dist", "Some Stockist": None,
    }
    none = F.lit(None).cast("string")
    assert apply(spark, lambda c: channels.erp_channel(none, c, none, F.lit("SCO-1")), cases) == list(cases.values())
    assert apply(spark, lambda r: channels.erp_channel(none, F.lit("[Redacted]"), none, r), ["123-1234567-1234567", "123"]) == ["amz", None]
    assert apply(spark, lambda r: channels.erp_channel(none, F.lit("Momentum Foods"), none, r), ["MFO-29", "12345"]) == ["dist", None]
    assert apply(spark, lambda c: channels.erp_channel(c, F.lit("Coles"), none, none), ["Cloud", ""]) == ["refund", "col"]
    assert apply(spark, lambda c: channels.erp_channel_csv(F.lit("Backend"), c, none), ["Some Stockist", "Amazon Seller X", "Mr"]) == ["dist", None, None]


def test_distribution_centres(spark):
    label = lambda attr: (lambda c: channels.distributor(F.lit(attr), c)["label"])
    assert apply(spark, label("col"), ["Grocery Holdings - Red Bank", "NDC SOMERTON", "Kemps Creek", "Coles"]) == ["Coles QLD", "Coles VIC", "Coles NSW", "Coles"]
    assert apply(spark, label("woo2"), ["WOOLWORTHS Erskine Park", "WOOLWORTHS Redbank"]) == ["Woolworths — Erskine Park", "Woolworths"]
    assert apply(spark, label("amz"), ["X"]) == [None]


def test_local_dates(spark):
    assert apply(spark, calendar.business_date, ["2026-04-29T03:18:49+00:00", "2026-04-29T15:30:00Z", "2026-01-15T04:59:59Z", "nonsense", None]) == [
        dt.date(2026, 4, 28), dt.date(2026, 4, 29), dt.date(2026, 1, 14), None, None]
    assert apply(spark, calendar.warehouse_date, ["2026-07-07T14:00:06Z", "2026-07-07", "2026-07-07 oddly", None]) == [
        dt.date(2026, 7, 8), dt.date(2026, 7, 7), dt.date(2026, 7, 7), None]


def test_business_midnight(spark):
    rule = lambda c: calendar.business_midnight_text(c.cast("date"))
    # On a clock-change day midnight is still in the old offset.
    assert apply(spark, rule, ["2026-04-01", "2026-01-15", "2026-11-01"]) == [
        "2026-04-01T00:00:00-04:00", "2026-01-15T00:00:00-05:00", "2026-11-01T00:00:00-04:00"]


def test_week_key_and_business_day(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(800)]

    def week(d):
        return max(d - dt.timedelta(days=d.weekday()), d.replace(day=1))

    def before(d):
        d -= dt.timedelta(days=1)
        while d.weekday() > 4:
            d -= dt.timedelta(days=1)
        return d

    texts = [d.isoformat() for d in days]
    assert apply(spark, lambda c: calendar.week_key(c.cast("date")), texts) == [week(d) for d in days]
    floor = dt.date(2025, 3, 1)
    assert apply(spark, lambda c: calendar.week_key(c.cast("date"), floor), texts) == [week(d) if week(d) >= floor else None for d in days]
    assert apply(spark, lambda c: calendar.previous_business_day(c.cast("date")), texts) == [before(d) for d in days]


def test_month_window(spark):
    rows = calendar.month_window(spark, dt.date(2026, 2, 15), 4).orderBy("idx").collect()
    assert [(r["idx"], r["ym"], r["label"]) for r in rows] == [
        (0, "2025-11", "Nov 2025"), (1, "2025-12", "Dec 2025"), (2, "2026-01", "Jan 2026"), (3, "2026-02", "Feb 2026")]
    assert calendar.month_keys(dt.date(2026, 2, 15), 4) == [r["ym"] for r in rows]


@pytest.mark.parametrize(("raw", "expected"), [
    ("1-2 Jul", dt.date(2026, 7, 1)), ("3-Jul", dt.date(2026, 7, 3)), ("17 & 24 Jul", dt.date(2026, 7, 17)), ("30-31 Jul", dt.date(2026, 7, 30)),
    ("29 Jul & 3 Aug", dt.date(2026, 7, 29)), ("5 Jan", dt.date(2027, 1, 5)), ("Jul 4", dt.date(2026, 7, 4)), ("31 Jun", dt.date(2026, 7, 1)), ("soon", None), ("July", None), ("", None),
])
def test_fill_date(spark, raw, expected):
    assert apply(spark, lambda c: calendar.fill_date(c, dt.date(2026, 7, 8)), [raw]) == [expected]


def test_accounting_date(spark):
    values = ["/Date(1690848000000+0000)/", "/Date(1690848000000+1100)/", "/Date(-86400000)/", "2023-08-01T00:00:00", "soon", None]
    assert apply(spark, calendar.accounting_date, values) == [dt.date(2023, 8, 1), dt.date(2023, 8, 1), dt.date(1969, 12, 31), dt.date(2023, 8, 1), None, None]


def test_iso_utc(spark):
    assert apply(spark, calendar.iso_utc, ["2026-01-02 03:04:05", "2026-01-02 03:04:05.123", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+10:00", "x", ""]) == [
        "2026-01-02T03:04:05Z", "2026-01-02T03:04:05.123Z", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+10:00", "x", None]


def test_scrub(spark):
    values = [
        "https://x/?consumer_key=abc&consumer_secret=def", "ck_0123456789abcdef0123", "Atzr|Iw-_x=|y end", "amzn1.oa2-cs.v1.abc", "Bearer eyJabcdefgh.payload.sign ok", None]
    assert apply(spark, text.scrub, values) == [
        "https://x/?consumer_key=[REDACTED]&consumer_secret=[REDACTED]", "ck_[REDACTED]", "Atz_[REDACTED] end", "amzn1.oa2-cs.v1.[REDACTED]", "Bearer eyJ[REDACTED] ok", ""]


def test_natural_order(spark):
    refs = ["SO-1010", "so-1009", "SO-99", "SO-099b", "A2", "A10", "A1"]
    rows = spark.createDataFrame([(r,) for r in refs], "r string").orderBy(text.natural_key(F.col("r"))).collect()
    assert [r[0] for r in rows] == ["A1", "A2", "A10", "SO-99", "SO-099b", "so-1009", "SO-1010"]


def test_tray_links(spark):
    assert apply(spark, codes.tray_tin, ["P-CA-SRT-OG-NPO", "P-CA-SRT-SS", "P-CA-SRT-CL-VLB", "X"]) == ["CA-OG-NPO-35", "", "CA-CL-VLB-35", ""]
    assert apply(spark, codes.carton_capacity, ["P-CA-BLANK-CTN-4SRT", "P-BLANK-ENV-A1"]) == [4, 0]
    assert apply(spark, codes.packaging_class, ["T-X", "NP_INSERTS", "P-CA-BLANK-CTN-2SRT", "P-BLANK-ENV-A1", "P-CA-SRT-SS", "P-ENV-A1", "CA-1"]) == [
        "tins", "inserts", "blankCartons", "blankCartons", "srt", "envelopes", None]


def test_po_line_class(spark):
    assert apply(spark, codes.po_line_class, ["Freight", "KittingFee", "T-L-1", "AU-BD-NPS-100", "AU-CTN-X-48", "AU-SRT-X", "AU-X", "P-ENV-A1", "X", ""]) == [
        "fees", "fees", "raw_tin", "soap", "carton_tray", "carton_tray", "finished", "packaging", "other", "other"]
