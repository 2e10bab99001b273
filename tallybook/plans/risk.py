"""Run rate and days-of-stock risk per base code."""

from __future__ import annotations

import calendar as _calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import calendar
from tallybook.functions.fixed import RISK_ORDER


def half_up(col: Column, places: int = 0) -> Column:
    """floor(x + 0.5): halves go up, also below zero."""
    scale = float(10 ** places)
    return F.floor(col * scale + 0.5) / scale if places else F.floor(col + 0.5)


def complete_months(as_of: dt.date, n: int = 3) -> list[str]:
    return calendar.month_keys(calendar.month_start(as_of, 1), n)


def run_rate(skus: DataFrame, as_of: dt.date, months: list[str] | None = None) -> DataFrame:
    """Tins a day per SKU over the given complete months.

    ``skus`` is the merged SKU report (ym, sku, total_tins).  A month that could
    not be loaded is left out of ``months`` and its days leave the divisor.
    A SKU without sales there gets a provisional rate from the current month.
    """
    months = complete_months(as_of) if months is None else months
    days = sum(_calendar.monthrange(int(m[:4]), int(m[5:]))[1] for m in months)
    current = as_of.strftime("%Y-%m")
    ym, tins = F.col("ym"), F.col("total_tins").cast("decimal(18,4)")
    window = F.sum(F.when(ym.isin(*months), tins)) if months else F.sum(F.lit(None).cast("decimal(18,4)"))
    summed = skus.filter(ym.isin(*months, current)).groupBy("sku").agg(
        F.coalesce(window, F.lit(0)).cast("double").alias("tins"),
        F.coalesce(F.sum(F.when(ym == current, tins)), F.lit(0)).cast("double").alias("current_tins"))
    rate = F.col("tins") / F.lit(float(days)) if days else F.lit(0.0)
    provisional = (rate == 0) & (F.col("current_tins") > 0)
    return summed.select(
        "sku", "tins", "current_tins",
        F.when(provisional, F.col("current_tins") / F.lit(float(as_of.day))).otherwise(rate).alias("rate"),
        provisional.alias("rate_provisional"))


def stock_risk(inventory: DataFrame, base: DataFrame, incoming: DataFrame, rates: DataFrame, tins: DataFrame, as_of: dt.date) -> DataFrame:
    """Days of stock left and a risk class for every active base code."""
    active = inventory.filter(~F.col("discontinued") & F.col("kind").isin("base", "base-b")).select("sku")
    joined = (
        active.join(base.withColumnRenamed("base", "sku"), "sku", "left")
        .join(incoming.withColumnRenamed("base", "sku").withColumnRenamed("qty", "incoming_qty"), "sku", "left")
        .join(rates.select("sku", "rate", "rate_provisional"), "sku", "left")
        .join(tins.select("sku", F.col("soh").alias("empty_soh"), F.col("incoming").alias("empty_incoming")), "sku", "left")
    )
    zero = F.lit(0)
    loose, fba, cartons = (F.coalesce(c, zero) for c in ("loose", "fba", "from_cartons"))
    filled = joined.select(
        "sku", (loose + fba + cartons).alias("current_stock"), loose.alias("stock_loose_tins"), fba.alias("stock_fba"),
        cartons.alias("stock_from_cartons"), F.coalesce("carton_count", zero).alias("stock_carton_count"),
        F.coalesce("empty_soh", zero).alias("empty_tins_soh"), F.coalesce("empty_incoming", zero).alias("empty_tins_incoming"),
        F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("rate_provisional", F.lit(False)).alias("rate_provisional"),
        F.coalesce("incoming_qty", zero).alias("incoming_qty"), "next_date", F.col("next_ref").alias("next_po_ref"),
        F.coalesce("refs", F.lit("")).alias("next_po_refs"),
    ).withColumn("left", F.when(F.col("rate") > 0, F.col("current_stock") / F.col("rate")))
    suffix = F.when(F.col("incoming_qty") == 0, "").otherwise("-incoming")
    risk = (
        F.when((F.col("rate") == 0) & (F.col("current_stock") == 0), "inactive").when(F.col("rate") == 0, "no-sales")
        .when(F.col("left") < 14, F.concat(F.lit("critical"), suffix)).when(F.col("left") < 30, F.concat(F.lit("low"), suffix))
        .when(F.col("left") < 60, "monitor").otherwise("stable")
    )
    out = filled.withColumns({
        "risk": risk, "days_left": half_up(F.col("left"), 1), "run_rate_per_day": half_up(F.col("rate"), 1),
        "next_po_days": F.datediff("next_date", F.lit(as_of))})
    return out.drop("rate", "left", "next_date")


def risk_order() -> list:
    """The worst risk first, then the fewest days."""
    return [F.array_position(F.array(*[F.lit(r) for r in RISK_ORDER]), F.col("risk")), F.coalesce("days_left", F.lit(99999.0)), "sku"]


def risk_sorted(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*risk_order())
