"""Shipping-queue reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.fixed import EXPRESS_WORDS


def is_international(country: Column) -> Column:
    """Ship-to outside the home country; a blank country is domestic."""
    c = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    return (c != "") & (c != "AU")


def is_express(*services: Column) -> Column:
    words = "(?i)" + "|".join(EXPRESS_WORDS)
    hit = F.lit(False)
    for service in services:
        hit = hit | F.coalesce(service.rlike(words), F.lit(False))
    return hit


def order_flags(orders: DataFrame, services: tuple[str, ...] = ("service", "service_code", "carrier")) -> DataFrame:
    """Add flags: INTL and EXPRESS, either, both or none; every service field an order has is looked at."""
    intl = is_international(F.col("country"))
    express = is_express(*[F.col(s) for s in services if s in orders.columns])
    flags = F.array_compact(F.array(F.when(intl, F.lit("INTL")), F.when(express, F.lit("EXPRESS"))))
    return orders.withColumn("flags", flags)


def is_wholesale_sku(sku: Column) -> Column:
    return F.coalesce(sku.rlike("(?i)^WC-|-SRT-|-CTN-"), F.lit(False))


def buyer(orders: DataFrame) -> Column:
    """Bill-to company, else ship-to company, else the user name."""
    present = [c for c in ("bill_company", "ship_company", "company", "username") if c in orders.columns]
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in present])


def wholesale_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct wholesale SKUs of each order, one row per order and SKU.

    Rows, not an array per order: a huge order stays spread over tasks.
    """
    hits = lines.filter(is_wholesale_sku(F.col("sku"))).select("order_id", "sku").distinct()
    return (
        hits.join(orders.withColumn("company", buyer(orders)), F.col("order_id") == F.col("order_number"))
        .drop("order_id")
    )


def wholesale_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with at least one wholesale line."""
    hits = lines.filter(is_wholesale_sku(F.col("sku"))).select("order_id").distinct()
    return orders.withColumn("company", buyer(orders)).join(hits, F.col("order_number") == F.col("order_id"), "left_semi")


def alert_lists(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The two lists of the open queue: express or international orders with their flags, and wholesale orders with a row per SKU.

    An order may stand in both.  Rows: list, order_number, country, service, flags, sku, company.
    """
    opened = order_flags(orders.filter(F.col("order_status") == "awaiting_shipment"))
    shown = ["order_number", "country", "service"]
    express = opened.filter(F.size("flags") > 0).select(F.lit("express_intl").alias("list"), *shown, F.array_join("flags", ",").alias("flags"))
    wholesale = wholesale_lines(opened, lines).select(F.lit("wholesale").alias("list"), *shown, "sku", "company")
    return express.unionByName(wholesale, allowMissingColumns=True)


def on_hold_by_store(orders: DataFrame) -> DataFrame:
    store = F.coalesce(F.col("store_id").cast("string"), F.lit("unknown"))
    return (
        orders.filter(F.col("order_status") == "on_hold")
        .groupBy(store.alias("store_id")).agg(F.count("*").alias("orders"))
    )


def named_customer(orders: DataFrame, lines: DataFrame, pattern: str) -> DataFrame:
    """Open wholesale orders, and those whose company matches a pattern."""
    opened = orders.filter(F.col("order_status") == "awaiting_shipment")
    return wholesale_orders(opened, lines).agg(
        F.count("*").alias("wholesale_open"),
        F.count_if(F.col("company").rlike(pattern)).alias("flagged"),
    )


def snapshot(orders: DataFrame, lines: DataFrame, shipments: DataFrame, day: dt.date | None, store_id: int) -> DataFrame:
    """Queue measures as (measure, value): open, express/intl, wholesale, on hold, shipped.

    ``day`` limits shipments to one local date; None counts every day.
    """
    opened = order_flags(orders.filter(F.col("order_status") == "awaiting_shipment"))
    queue = opened.agg(
        F.count("*").alias("open_orders"),
        F.count_if(F.size("flags") > 0).alias("express_intl_open"),
    )
    wholesale = wholesale_orders(opened, lines).agg(F.count("*").alias("wholesale_open"))
    held = orders.agg(
        F.count_if((F.col("order_status") == "on_hold") & (F.col("store_id") == store_id)).alias("store_on_hold"))
    sent = shipments.filter(~F.col("voided"))
    if day is not None:
        sent = sent.filter(F.col("ship_date") == F.lit(day))
    shipped = sent.agg(
        F.count_distinct("shipment_id").alias("shipped_orders"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("shipped_items"),
    )
    parts = []
    for frame in (queue, wholesale, held, shipped):
        names = frame.columns
        parts.append(frame.unpivot([], names, "measure", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
