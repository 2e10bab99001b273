"""Landing accounting purchase orders and invoices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import calendar

_PO_LINE = "struct<ItemCode: string, Description: string, Quantity: decimal(18,4), UnitAmount: decimal(18,2), LineAmount: decimal(18,2)>"
PO_SCHEMA = (
    "PurchaseOrderID string, PurchaseOrderNumber string, Status string, DeliveryDate string, Reference string,"
    f" Contact struct<Name: string>, Total decimal(18,2), CurrencyCode string, LineItems array<{_PO_LINE}>"
)
INVOICE_SCHEMA = (
    "InvoiceID string, InvoiceNumber string, Type string, Status string, Date string, Contact struct<Name: string>,"
    " Total decimal(18,2), CurrencyCode string,"
    " LineItems array<struct<ItemCode: string, Quantity: decimal(18,4), LineAmount: decimal(18,2)>>"
)


def supplier_pos(documents: DataFrame, as_of: dt.date) -> DataFrame:
    """Open supplier POs due this month or later, without tin lines; one row per PO document."""
    status = F.upper(F.coalesce("Status", F.lit("")))
    due = calendar.accounting_date(F.col("DeliveryDate"))
    lines = F.filter("LineItems", lambda li: ~F.coalesce(li["ItemCode"].startswith("T-"), F.lit(False)))
    return documents.filter(~status.isin("BILLED", "DELETED") & (due >= F.lit(calendar.month_start(as_of)))).select(
        F.coalesce("PurchaseOrderNumber", "PurchaseOrderID").alias("po"),
        F.lower(F.coalesce(F.nullif("Status", F.lit("")), F.lit("unknown"))).alias("status"), due.alias("expected_date"),
        F.coalesce("Contact.Name", F.lit("Unknown")).alias("supplier"), F.coalesce("Reference", F.lit("")).alias("notes"),
        F.coalesce("Total", F.lit(0).cast("decimal(18,2)")).alias("total"), F.coalesce("CurrencyCode", F.lit("CAD")).alias("currency"),
        lines.alias("lines"),
    ).filter(F.size("lines") > 0)


def po_lines(pos: DataFrame) -> DataFrame:
    header = [c for c in pos.columns if c != "lines"]
    return pos.select(*header, F.explode("lines").alias("li")).select(
        *header, F.coalesce("li.ItemCode", F.lit("")).alias("sku"), F.coalesce("li.Quantity", F.lit(0)).alias("qty"),
        F.coalesce("li.LineAmount", F.lit(0)).alias("line_total"))


def invoices(documents: DataFrame, as_of: dt.date, months: int = 6) -> DataFrame:
    """Receivable invoices of the last months, minus contacts counted elsewhere."""
    since = F.add_months(F.lit(as_of), -months)
    day = calendar.accounting_date(F.col("Date"))
    contact = F.coalesce("Contact.Name", F.lit(""))
    keep = (F.col("Type") == "ACCREC") & (day >= since) & ~F.lower(contact).rlike("metorik|amazon")
    lines = F.filter("LineItems", lambda li: F.coalesce(li["ItemCode"] != "", F.lit(False)))
    return documents.filter(keep).select(
        F.col("InvoiceID").alias("id"), F.col("InvoiceNumber").alias("number"), day.alias("date"), F.col("Status").alias("status"),
        F.when(contact != "", contact).otherwise("Unknown").alias("contact"), F.coalesce("Total", F.lit(0).cast("decimal(18,2)")).alias("total"),
        F.coalesce("CurrencyCode", F.lit("CAD")).alias("currency"), lines.alias("lines"))


def invoice_lines(rows: DataFrame) -> DataFrame:
    header = [c for c in rows.columns if c != "lines"]
    return rows.select(*header, F.explode("lines").alias("li")).select(
        *header, F.col("li.ItemCode").alias("sku"), F.coalesce("li.Quantity", F.lit(0)).alias("qty"),
        F.coalesce("li.LineAmount", F.lit(0)).alias("line_total"))
