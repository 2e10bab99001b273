"""Distributor board: what is open, and whether stock covers it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import calendar, channels, text
from tallybook.operators.erp_lines import derive_lines, with_channel
from tallybook.plans.inventory import lookup_code_or_base


def distributor_orders(orders: DataFrame) -> DataFrame:
    """Supermarket and wholesale orders with their board fields."""
    keep = with_channel(orders).filter(F.col("channel_attr").isin("col", "woo2", "dist"))
    day = calendar.leading_date(F.coalesce("delivery_date", "created_date"))
    placed = keep.withColumn("d", channels.distributor(F.col("channel_attr"), F.col("company"))).select(
        *orders.columns, "channel_attr", "d.*", day.alias("delivery_day"),
        calendar.warehouse_date(F.col("dispatched_date")).alias("dispatched_day"))
    ship_by = F.when(F.col("ship_day_before"), calendar.previous_business_day(F.col("delivery_day"))).otherwise(F.col("delivery_day"))
    return placed.withColumns({"must_ship_by": ship_by, "is_dispatched": F.col("dispatched_day").isNotNull()})


def open_orders(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Approved orders, kept until the day after their expected delivery."""
    etd = calendar.leading_date(F.col("delivery_date"))
    return orders.filter((F.col("status") == "APPROVED") & (etd >= F.lit(as_of - dt.timedelta(days=1))))


def _number(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def line_fulfilment(orders: DataFrame, lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Cartons and tins each open line needs against warehouse stock on hand.

    A carton code is ready from packed cartons only; loose tins of its base code
    can be kitted.  Other lines draw on tins of their code, else of the base.
    """
    on_hand = stock.select("code", F.greatest(F.col("soh") - F.col("fba_soh"), F.lit(0)).cast("double").alias("wh"))
    tops = derive_lines(lines, "sales").filter((F.col("parent_id") == 0) & (F.col("qty") > 0)).withColumn(
        "base_sku", F.coalesce("base_sku", "code"))
    heads = orders.select(F.col("id").alias("order_id"), "is_dispatched")
    rows = lookup_code_or_base(tops.join(heads, "order_id"), on_hand, "wh")
    alt = F.col("uom_size") > 1
    qty, uom, mult = F.col("qty").cast("double"), F.col("uom_size").cast("double"), F.col("multiplier").cast("double")
    zero = F.lit(0.0)
    per_carton = F.when(alt, uom).otherwise(mult)
    needed = F.when(alt, qty / uom).otherwise(qty)
    is_carton = (F.col("multiplier") > 1) & ~alt
    packed = F.coalesce("code_wh", zero)
    loose = F.when(F.col("base_sku") != F.col("code"), F.coalesce("base_wh", zero)).otherwise(zero)
    tins = F.coalesce("wh", zero)
    sized = rows.withColumns({
        "per_carton": per_carton, "cartons_needed": needed, "tins_needed": F.when(alt, qty).otherwise(qty * mult),
        "cartons_available": F.when(is_carton, packed).when(per_carton > 1, F.floor(tins / per_carton).cast("double")).otherwise(tins),
        "kittable_cartons": F.when(is_carton, F.floor(loose / per_carton).cast("double")).otherwise(zero),
        "tins_available": F.when(is_carton, packed * per_carton + loose).otherwise(tins)})
    need, have, kit = F.col("cartons_needed"), F.col("cartons_available"), F.col("kittable_cartons")
    state = (
        F.when(F.col("is_dispatched"), "dispatched").when(have >= need, "ready").when(have + kit >= need, "kit").otherwise("short")
    )
    staged = sized.withColumn("fulfil_state", state)
    sent = F.col("is_dispatched")
    unit = F.when(F.col("per_carton") > 1, "cartons").otherwise("units")
    final_have = F.when(sent, need).otherwise(have)
    to_kit = F.when(sent, zero).otherwise(F.greatest(need - have, zero))
    s = F.col("fulfil_state")
    gap = (
        F.when(s.isin("dispatched", "ready"), F.concat_ws(" ", _number(need), unit))
        .when(s == "kit", F.concat(_number(have), F.lit("/"), _number(need), F.lit(" packed · kit "), _number(to_kit)))
        .otherwise(F.concat(_number(have), F.lit(" / "), _number(need), F.lit(" "), unit))
    )
    return staged.select(
        "order_id", F.col("code").alias("sku"), "base_sku", "qty", "uom_size", "cartons_needed",
        final_have.alias("cartons_available"), F.when(sent, zero).otherwise(kit).alias("kittable_cartons"),
        to_kit.alias("cartons_to_kit"), "tins_needed",
        F.when(sent, F.col("tins_needed")).otherwise(F.col("tins_available")).alias("tins_available"),
        unit.alias("unit_label"), s.isin("dispatched", "ready").alias("is_fulfillable"), "fulfil_state", gap.alias("gap_display"))


def board(orders: DataFrame, fulfilment: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per order; an order without lines is never fulfillable."""
    per_order = fulfilment.groupBy("order_id").agg(F.count("*").alias("lines"), F.min("is_fulfillable").alias("covered"))
    joined = orders.join(per_order, orders["id"] == per_order["order_id"], "left").drop("order_id")
    past = ~F.col("is_dispatched") & (F.col("must_ship_by") < F.lit(as_of))
    return joined.withColumns({
        "line_count": F.coalesce("lines", F.lit(0)), "all_fulfillable": F.coalesce("covered", F.lit(False)),
        "is_past_due": F.coalesce(past, F.lit(False))}).drop("lines", "covered")


def board_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp").agg(F.count("*").alias("orders"), F.count_if("is_past_due").alias("past_due"))


def must_ship_order() -> list:
    """Dispatched orders last, then by ship date with undated orders last."""
    return ["is_dispatched", F.col("must_ship_by").asc_nulls_last(), "id"]


def by_must_ship(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*must_ship_order())


def reference_order() -> list:
    """Dispatched orders last, then references in number-aware order."""
    return ["is_dispatched", text.natural_key(F.col("reference")), "id"]


def by_reference(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*reference_order())
