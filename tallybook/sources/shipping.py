"""Landing the shipping queue: stores, orders and shipments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORE_SCHEMA = "storeId long, storeName string, marketplaceName string, accountName string, integrationUrl string, active boolean"
ORDER_SCHEMA = (
    "orderId long, orderNumber string, orderStatus string, orderDate string, storeId long, advancedOptions struct<storeId: long>,"
    " requestedShippingService string, serviceCode string, carrierCode string, customerUsername string,"
    " billTo struct<company: string>, shipTo struct<company: string, country: string>,"
    " items array<struct<sku: string, name: string, quantity: long>>"
)
SHIPMENT_SCHEMA = "shipmentId long, shipDate string, voided boolean, shipmentItems array<struct<sku: string, quantity: long>>"


def stores(documents: DataFrame) -> DataFrame:
    """Store directory, inactive stores included."""
    return documents.select(
        F.col("storeId").alias("store_id"), F.col("storeName").alias("store_name"), F.col("marketplaceName").alias("marketplace"),
        F.col("accountName").alias("account_name"), F.col("integrationUrl").alias("integration_url"), "active")


def orders(documents: DataFrame, status: str | None = "awaiting_shipment") -> DataFrame:
    """Flat queue orders; the nested store id wins over the outer one."""
    rows = documents if status is None else documents.filter(F.col("orderStatus") == status)
    return rows.select(
        F.coalesce("orderNumber", F.col("orderId").cast("string")).alias("order_number"), F.col("orderStatus").alias("order_status"),
        F.coalesce("advancedOptions.storeId", "storeId").alias("store_id"), F.col("shipTo.country").alias("country"),
        F.coalesce("requestedShippingService", "serviceCode").alias("service"), F.col("serviceCode").alias("service_code"),
        F.col("carrierCode").alias("carrier"),
        F.col("billTo.company").alias("bill_company"), F.col("shipTo.company").alias("ship_company"),
        F.col("customerUsername").alias("username"), "items")


def shipments(documents: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Items of shipments that were not voided, of one ship date or of all."""
    rows = documents.filter(~F.coalesce("voided", F.lit(False))).withColumn("ship_date", F.substring("shipDate", 1, 10).try_cast("date"))
    if day is not None:
        rows = rows.filter(F.col("ship_date") == F.lit(day))
    return rows.select(F.col("shipmentId").alias("shipment_id"), "ship_date", F.explode_outer("shipmentItems").alias("i")).select(
        "shipment_id", "ship_date", "i.sku", F.coalesce("i.quantity", F.lit(0)).alias("quantity"))
