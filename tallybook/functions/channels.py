"""Sales-channel rules for ERP orders, and the distributor lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.fixed import (
    DISTRIBUTION_CENTRES, PERSONAL_TITLES, WHOLESALE_ACCOUNTS,
)

_ORDER_ID = r"^\d{3}-\d{7}-\d{7}$"
_SUPERMARKET_C = "grocery holdings|^coles$|^kemps creek$"
_TITLES = "|".join(PERSONAL_TITLES)
# Mirrors of other channels and private buyers: never an ERP sale.
_NOT_A_SALE = rf"^amazon|^$|^\[redacted\]$|^({_TITLES})$"
_ACCOUNTS = "|".join(WHOLESALE_ACCOUNTS)


def _text(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit("")))


def erp_channel(channel: Column, company: Column, first_name: Column, reference: Column) -> Column:
    """Channel of an ERP order, from the live feed; the first rule that fits wins."""
    low, ref = F.lower(_text(company)), _text(reference)
    return (
        F.when(_text(channel) == "Cloud", "refund")
        .when((_text(company) == "Stock Adjustments") | (_text(first_name) == "Stock Adjustments"), F.lit(None))
        .when(ref.rlike(_ORDER_ID), "amz")
        .when(low.contains("woolworths"), "woo2")
        .when(low.rlike(_SUPERMARKET_C), "col")
        .when(low.startswith("amazon seller"), "amz")
        .when(low.rlike(_NOT_A_SALE), F.lit(None))
        .when(low.rlike(_ACCOUNTS) & ~ref.rlike(r"^\d+$"), "dist")
    )


def erp_channel_csv(channel: Column, company: Column, first_name: Column) -> Column:
    """Channel of an ERP order in the bulk export, which has its own rules."""
    low = F.lower(_text(company))
    return (
        F.when((company == "Stock Adjustments") | (_text(first_name) == "Stock Adjustments"), F.lit(None))
        .when(low.startswith("amazon"), F.lit(None))
        .when(low.contains("woolworths"), "woo2")
        .when(low.rlike(_SUPERMARKET_C), "col")
        .when((_text(channel) == "Backend") & ~low.rlike(_NOT_A_SALE), "dist")
    )


def distributor(attr: Column, company: Column) -> Column:
    """Struct (grp, label, state, ship_day_before); null for other channels."""
    low = F.lower(company)

    def record(grp: str, label: Column, state: str | None, before: bool) -> Column:
        return F.struct(
            F.lit(grp).alias("grp"), label.alias("label"),
            F.lit(state).cast("string").alias("state"), F.lit(before).alias("ship_day_before"),
        )

    rules = []
    for value, grp, generic in (("col", "coles", "Coles"), ("woo2", "woolies", "Woolworths")):
        for match, label, state, before in DISTRIBUTION_CENTRES[value]:
            rules.append(((attr == value) & low.contains(match), record(grp, F.lit(label), state, before)))
        rules.append((attr == value, record(grp, F.lit(generic), None, False)))
    named = F.coalesce(F.nullif(F.trim(company), F.lit("")), F.lit("Distributor"))
    rules.append((attr == "dist", record("otherDistributors", named, None, False)))
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out
