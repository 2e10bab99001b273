"""Derived fields of ERP order and credit-note lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import codes
from tallybook.functions.channels import erp_channel

QTY = "decimal(18,4)"
MONEY = "decimal(18,2)"
PRICE = "decimal(18,6)"


def derive_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Add code, base_sku, multiplier, is_au_sku, tins, total, revenue_signed.

    ``kind`` is 'sales' or 'credit': a credit line moves tins only for a
    regional code and always counts negative.
    """
    code = codes.clean(F.col("code"))
    qty = F.coalesce("qty", F.lit(0)).cast(QTY)
    price = F.col("unit_price") if "unit_price" in lines.columns else F.lit(0)
    total = F.coalesce(F.col("total").cast(MONEY), (qty * F.coalesce(price, F.lit(0)).cast(PRICE)).cast(MONEY))
    uom = F.coalesce("uom_size", F.lit(0))
    units = F.when(uom > 1, qty).otherwise((qty * codes.pack_size(code)).cast(QTY))
    regional = codes.is_regional(code)
    if kind == "credit":
        tins = F.when(regional, -F.abs(units)).otherwise(F.lit(0)).cast(QTY)
    else:
        tins = units.cast(QTY)
    derived = {
        "base_sku": codes.base_code(code),
        "multiplier": codes.pack_size(code),
        "uom_size": F.greatest(uom, F.lit(1)),
        "is_au_sku": regional,
        "tins": tins,
        "revenue_signed": -F.abs(total),
        "qty": qty,
        "total": total,
        "parent_id": F.coalesce("parent_id", F.lit(0).cast("bigint")),
        "code": F.when(code != "", code),
    }
    return lines.withColumns(derived)


def with_channel(orders: DataFrame) -> DataFrame:
    """Add channel_attr and ym to ERP order headers."""
    first = F.col("first_name") if "first_name" in orders.columns else F.lit(None).cast("string")
    return orders.withColumns({
        "channel_attr": erp_channel(F.col("channel"), F.col("company"), first, F.col("reference")),
        "ym": F.substring("created_date", 1, 7),
    })
