"""Landing ERP orders, credit notes and the bulk CSV export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import codes
from tallybook.functions.channels import erp_channel, erp_channel_csv
from tallybook.operators.erp_lines import derive_lines
from tallybook.operators.maintain import arrival, first_by_key, newest_documents
from tallybook.sources.parse import MONEY, any_time, blank_null, number, strict

LINE = (
    "struct<id: long, parentId: long, code: string, name: string, qty: decimal(18,4), uomSize: decimal(18,4),"
    " unitPrice: decimal(18,6), total: decimal(18,2)>"
)
ORDER_SCHEMA = (
    "id long, reference string, company string, firstName string, lastName string, channel string, status string, stage string,"
    " createdDate string, modifiedDate string, dispatchedDate string, estimatedDeliveryDate string, total decimal(18,2),"
    f" lineItems array<{LINE}>"
)
CREDIT_SCHEMA = (
    "id long, reference string, company string, status string, createdDate string, modifiedDate string, total decimal(18,2),"
    f" lineItems array<{LINE}>"
)


def _filled(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def _land(documents: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines).  Each date stands in for the other; without both, a document is skipped.

    A document delivered again replaces its header and all its lines.
    """
    created, modified = blank_null(F.col("createdDate")), blank_null(F.col("modifiedDate"))
    present = {c: F.col(c) if c in documents.columns else F.lit(None).cast("string") for c in (
        "firstName", "lastName", "channel", "stage", "dispatchedDate", "estimatedDeliveryDate")}
    dated = documents.withColumns({
        "created_date": F.coalesce(created, modified), "modified_date": F.coalesce(modified, created), **present,
    }).filter(F.col("created_date").isNotNull())
    wanted = ["reference", "company", "status", "total", "created_date", "modified_date", *(present if kind == "sales" else []), "lineItems"]
    dated = newest_documents(dated, "id", [F.col("modified_date"), arrival(documents)], wanted)
    shared = [
        "id", _filled("reference").alias("reference"), _filled("company").alias("company"),
        F.coalesce(_filled("status"), F.lit("UNKNOWN")).alias("status"), F.coalesce("total", F.lit(0).cast(MONEY)).alias("total"),
        "created_date", "modified_date"]
    extra = []
    if kind == "sales":
        attr = erp_channel(F.col("channel"), F.col("company"), F.col("firstName"), F.col("reference"))
        extra = [
            attr.alias("channel_attr"), _filled("stage").alias("stage"), _filled("firstName").alias("first_name"),
            _filled("lastName").alias("last_name"), blank_null(F.col("dispatchedDate")).alias("dispatched_date"),
            blank_null(F.col("estimatedDeliveryDate")).alias("delivery_date")]
    heads = dated.select(*shared, *extra)
    key = "order_id" if kind == "sales" else "credit_note_id"
    lines = dated.select(F.col("id").alias(key), "created_date", F.explode("lineItems").alias("li")).select(
        key, "created_date", F.col("li.parentId").alias("parent_id"), "li.code", "li.name", "li.qty",
        F.col("li.uomSize").cast("long").alias("uom_size"), F.col("li.unitPrice").alias("unit_price"), "li.total")
    return heads, derive_lines(lines, kind)


def land_orders(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _land(documents, "sales")


def land_credit_notes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _land(documents, "credit")


_FORMATS = ("d MMM yyyy h:mm a", "d MMM yyyy")
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def import_csv(rows: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(orders, lines) of the export; only supermarket and wholesale rows are kept.

    The modified date is the latest of three dates that is not in the future,
    so that the cursor taken from it never runs ahead of time.
    """
    attr = erp_channel_csv(F.col("Channel"), F.col("Company"), F.col("First Name"))
    when = {c: any_time(F.col(c), _FORMATS) for c in ("Created Date", "Invoice Date", "Fully Dispatched")}
    past = [F.when(t <= F.lit(now), t) for t in when.values()]
    created = when["Created Date"]

    def filled(column: str) -> Column:
        return F.coalesce(F.trim(column) != "", F.lit(False))

    status = (
        F.when(filled("Cancellation Date"), "VOID").when(filled("Fully Dispatched") | filled("Invoice Date"), "APPROVED").otherwise("OPEN")
    )
    kept = rows.withColumn("channel_attr", attr).filter(F.col("channel_attr").isNotNull())
    shaped = kept.select(
        "position", F.trim("Order Id").try_cast("long").alias("id"), F.nullif("Order Ref", F.lit("")).alias("reference"), status.alias("status"),
        "channel_attr", F.nullif("Company", F.lit("")).alias("company"), strict(F.col("Total Excl")).alias("total"),
        F.date_format(created, _ISO).alias("created_date"), F.date_format(F.coalesce(F.greatest(*past), created), _ISO).alias("modified_date"),
        blank_null(F.col("Item Code")).alias("code"), strict(F.col("Item Qty"), "decimal(18,4)").alias("qty"),
        strict(F.col("Item Price"), "decimal(18,6)").alias("unit_price"), F.nullif("Item Name", F.lit("")).alias("name"),
    ).filter(F.col("id").isNotNull())
    header = ["id", "reference", "status", "channel_attr", "company", "total", "created_date", "modified_date"]
    orders = first_by_key(shaped.select("position", *header), ["id"], ["position"]).drop("position")
    code = F.col("code")
    regional = codes.is_regional(code)
    lines = shaped.select(
        F.col("id").alias("order_id"), "code", codes.base_code(code).alias("base_sku"), codes.pack_size(code).alias("multiplier"), "qty", "unit_price",
        (F.col("qty") * F.col("unit_price")).cast(MONEY).alias("total"), "name", regional.alias("is_au_sku"),
        F.when(regional, F.col("qty") * codes.pack_size(code)).otherwise(0).cast("decimal(18,4)").alias("tins"))
    return orders, lines


def import_summary(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders, lines and tins per channel, per status and per month."""
    counted = lines.groupBy("order_id").agg(F.count("*").alias("items"), F.sum("tins").alias("tins"))
    joined = orders.join(counted, orders["id"] == counted["order_id"], "left")
    keys = {"channel": F.col("channel_attr"), "status": F.col("status"), "month": F.substring("created_date", 1, 7)}
    entries = F.explode(F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), c)])).alias("grp", "key")
    return joined.select("items", "tins", entries).groupBy("grp", "key").agg(
        F.count("*").alias("orders"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("tins"), F.lit(0)).cast("decimal(18,4)").alias("tins"))
