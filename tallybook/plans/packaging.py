"""Packaging stock and packaging demand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import calendar, codes
from tallybook.functions.fixed import COUNTABLE_STATUSES, ENVELOPE_CODES, PAPER_LEAD_MONTHS, TINS_PER_TRAY, TRAYS_PER_CARTON

_PACK = "(?i)^(AU-SRT-|AU-CTN-|WC-AU-)"


def is_pack(sku: Column) -> Column:
    return F.coalesce(sku.rlike(_PACK), F.lit(False))


def window_start(as_of: dt.date, months: int) -> dt.date:
    """Start of a rolling window of mean-length months."""
    return (dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=months * 30.44)).date()


def packaging_links(stock: DataFrame) -> DataFrame:
    """Packaging rows with their group and the finished code they are derived for."""
    code = F.col("code")
    tail = F.regexp_extract(code, r"^P-AU-SRT-(.*)$", 1)
    derived_tray = F.when(tail.rlike(r"^[A-Z0-9]+-[A-Z0-9]+(-[A-Z0-9]+)?$"), F.concat(F.lit("AU-"), tail, F.lit("-35")))
    tray, outer = code.startswith("P-AU-SRT-"), code.startswith("P-OC-AU-CTN-")
    blank_outer = code.rlike(r"^P-AU-(BLANK|PRINTED)-.*OUTERS$")
    group = (
        F.when(tray, "srt").when(outer | blank_outer, "cartons").when(code.isin(*ENVELOPE_CODES), "envelopes")
        .when(code == "PCI", "inserts").when(code.startswith("T-AU-BLANK-"), "blankTins")
    )
    derived = F.when(tray, derived_tray).when(outer, F.regexp_replace(code, "^P-OC-", ""))
    return stock.withColumns({"grp": group, "derived": derived}).filter(F.col("grp").isNotNull())


def link_check(stock: DataFrame) -> DataFrame:
    """Keep a derived finished code only when it is itself in stock."""
    links = packaging_links(stock)
    known = stock.select(F.col("code").alias("linked_sku"))
    return links.join(known, F.col("derived") == F.col("linked_sku"), "left")


def packaging_stock(stock: DataFrame) -> DataFrame:
    """Packaging in five groups with link, capacity, manual and discontinued flags."""
    grp, derived, linked = F.col("grp"), F.col("derived"), F.col("linked_sku")
    capacity = F.when(grp == "srt", TINS_PER_TRAY).when((grp == "cartons") & derived.isNotNull(), TRAYS_PER_CARTON)
    manual = derived.isNull() & (grp != "envelopes")
    return link_check(stock).select(
        "grp", F.col("code").alias("sku"), "name", "soh", "avail", "incoming", "branches", "linked_sku",
        capacity.alias("capacity"), manual.alias("manual_demand"), (derived.isNotNull() & linked.isNull()).alias("discontinued"))


def threepl_packaging(items: DataFrame, lead_months: dict[str, int] | None = None) -> DataFrame:
    """3PL packaging items with stock figures and the columns of their class."""
    sku = F.col("sku")
    grp = codes.packaging_class(sku)
    lead = F.lit(PAPER_LEAD_MONTHS)
    for code, months in (lead_months or {}).items():
        lead = F.when(sku == code, months).otherwise(lead)
    size = F.regexp_extract(sku, r"-(\d+)$", 1)
    g = F.col("grp")
    return items.withColumn("grp", grp).filter(g.isNotNull()).select(
        "grp", "sku", "name", F.col("quantity").alias("on_hand"), F.col("quantity_reserved").alias("reserved"),
        (F.col("quantity") - F.col("quantity_reserved")).alias("available"), F.col("quantity_incoming").alias("incoming"),
        "low_threshold", F.col("cost").alias("unit_cost"),
        F.when(g == "tins", F.substring(sku, 3, 1 << 20)).when(g == "srt", codes.tray_tin(sku)).alias("linked_sku"),
        F.when(g == "tins", F.when(size != "", F.concat(size, F.lit("g"))).otherwise("")).alias("size"),
        F.when(g == "srt", codes.tray_scent(sku)).alias("scent"), F.when(g == "srt", codes.tray_form(sku)).alias("form"),
        F.when(g == "blankCartons", codes.carton_capacity(sku)).alias("tray_capacity"),
        F.when(g != "tins", lead).alias("lead_time_months"))


def apply_overrides(items: DataFrame, excluded: list[str], overlay: DataFrame, managed: tuple[str, ...]) -> DataFrame:
    """Drop excluded SKUs, clear managed fields, then lay per-SKU values on top.

    ``overlay`` has one row per SKU; a null leaves the item's own value.
    """
    kept = items.filter(~F.col("sku").isin(*excluded)).drop(*managed)
    fields = [c for c in overlay.columns if c != "sku"]
    laid = overlay.select("sku", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = kept.join(laid, "sku", "left")
    own = [F.coalesce(f"new_{c}", c) if c in fields else F.col(c) for c in kept.columns]
    added = [F.col(f"new_{c}").alias(c) for c in fields if c not in kept.columns]
    return joined.select(*[col.alias(name) for col, name in zip(own, kept.columns)], *added)


def d2c_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders without any tray, carton or wholesale line."""
    packed = lines.filter(is_pack(F.col("sku"))).select("order_id").distinct()
    return orders.join(packed, orders["id"] == packed["order_id"], "left_anti")


def mailer_demand(orders: DataFrame, lines: DataFrame, since: dt.date, market: str = "AU") -> DataFrame:
    """Direct orders per month and mailer; ``unassigned`` must stay 0.

    Lines collapse to one row per order, pack flag included, before they meet
    the order: that replaces the anti join, and no order is too big for a task.
    """
    sku, qty = F.col("sku"), F.col("quantity")

    def tins(size: int) -> Column:
        return F.sum(F.when(sku.rlike(f"(?i)-{size}M?$"), qty).otherwise(0))

    per_order = lines.groupBy("order_id").agg(tins(35).alias("n35"), tins(85).alias("n85"), F.max(is_pack(sku)).alias("packed"))
    keep = orders.filter(
        (F.col("market") == market) & F.col("status").isin(*COUNTABLE_STATUSES) & (F.col("local_date") >= F.lit(since))
    ).select("id", calendar.month_of(F.col("local_date")).alias("ym"))
    n35, n85 = F.col("n35"), F.col("n85")
    direct = keep.join(per_order, keep["id"] == per_order["order_id"]).filter(~F.col("packed") & (n35 + n85 > 0))
    box = (n85 > 6) | (n35 > 12) | ((n85 > 0) & (n35 > 0) & (n85 + n35 > 10))
    large = ~box & ((n85 > 0) | (n35 > 6))
    small = ~box & (n85 == 0) & (n35 <= 6)
    return direct.groupBy("ym").agg(
        F.count_if(box).alias("box"), F.count_if(large).alias("large_envelope"), F.count_if(small).alias("envelope"),
        F.count_if(~box & ~large & ~small).alias("unassigned"), F.count("*").alias("orders"))


def pack_units(store_orders: DataFrame, store_lines: DataFrame, erp_orders: DataFrame, erp_lines: DataFrame, since: dt.date, market: str = "AU") -> DataFrame:
    """Pack units sold per month, code and source channel; non-positive sums dropped."""
    keep = store_orders.filter(F.col("status").isin(*COUNTABLE_STATUSES)).select(F.col("id").alias("order_id"))
    direct = store_lines.filter(
        (F.col("market") == market) & (F.col("local_date") >= F.lit(since)) & is_pack(F.col("sku"))
    ).join(keep, "order_id").select(
        calendar.month_of(F.col("local_date")).alias("ym"), F.trim("sku").alias("code"),
        F.col("quantity").cast("decimal(18,4)").alias("units"), F.lit("woo").alias("channel"))
    heads = erp_orders.filter(
        (F.col("status") == "APPROVED") & F.col("channel_attr").isin("col", "woo2", "dist")
        & (F.col("created_date") >= since.isoformat())).select(F.col("id").alias("order_id"), "ym")
    retail = erp_lines.filter(is_pack(F.col("code"))).join(heads, "order_id").select(
        "ym", F.trim("code").alias("code"), F.col("qty").cast("decimal(18,4)").alias("units"), F.lit("supermarket").alias("channel"))
    return direct.unionByName(retail).groupBy("ym", "code", "channel").agg(F.sum("units").alias("units")).filter(F.col("units") > 0)


def tray_carton_demand(units: DataFrame) -> DataFrame:
    """Packaging consumed per month: trays, cartons, and packs nothing maps to.

    A retail carton takes one outer and four trays.  Wholesale cartons ship in
    their own packaging and take none.
    """
    code, n = F.col("code"), F.col("units")
    tray, carton = r"^AU-SRT-(.+?)-*x12$", r"^AU-CTN-(?!SRT-MIX)(.+)-48$"

    def use(grp: str, sku: Column, amount: Column) -> Column:
        return F.struct(F.lit(grp).alias("grp"), sku.alias("sku"), amount.cast("decimal(28,4)").alias("units"))

    tray_sku = F.concat(F.lit("P-AU-SRT-"), F.regexp_extract(code, tray, 1))
    scent = F.regexp_extract(code, carton, 1)
    uses = (
        F.when(code.rlike(tray), F.array(use("trays", tray_sku, n)))
        .when(code.rlike(carton), F.array(
            use("cartons", F.concat(F.lit("P-OC-AU-CTN-"), scent, F.lit("-48")), n),
            use("trays", F.concat(F.lit("P-AU-SRT-"), scent), n * TRAYS_PER_CARTON)))
        .when(~code.startswith("WC-AU-"), F.array(use("unmapped", F.concat(code, F.lit(" ("), F.col("channel"), F.lit(")")), n)))
    )
    return units.select("ym", F.explode(uses).alias("u")).groupBy("ym", "u.grp", "u.sku").agg(F.sum("u.units").alias("units"))
