"""Landing marketplace orders, shipment reports and CSV exports."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import calendar, codes
from tallybook.functions.fixed import (
    MARKETPLACE_CSV_COLUMNS, MARKETPLACE_IDS, REPORT_COLUMNS, SKIPPED_MARKETPLACE_STATUSES,
)
from tallybook.operators.maintain import first_by_key
from tallybook.sources import folders
from tallybook.sources.parse import blank_null, number, strict, strict_whole, whole
from tallybook.sources.store import market_currency

ORDER_SCHEMA = (
    "AmazonOrderId string, MarketplaceId string, OrderStatus string, PurchaseDate string, LastUpdateDate string,"
    " OrderTotal struct<Amount: string, CurrencyCode: string>"
)


def land_orders(documents: DataFrame) -> DataFrame:
    """Usable orders of documents tagged with their market."""
    own = F.create_map(*[F.lit(x) for x in chain.from_iterable(MARKETPLACE_IDS.items())])[F.col("market")]
    place = F.nullif("MarketplaceId", F.lit(""))
    status = F.coalesce("OrderStatus", F.lit(""))
    usable = documents.filter(
        (place.isNull() | (place == own)) & ~status.isin(*SKIPPED_MARKETPLACE_STATUSES)
        & (F.coalesce("AmazonOrderId", F.lit("")) != ""))
    bought = F.coalesce(F.nullif("PurchaseDate", F.lit("")), F.nullif("LastUpdateDate", F.lit("")), F.lit(""))
    return usable.select(
        F.col("AmazonOrderId").alias("id"), "market", F.coalesce(F.nullif("OrderStatus", F.lit("")), F.lit("unknown")).alias("status"),
        bought.alias("purchase_date"), calendar.business_date(bought).alias("local_date"),
        number(F.col("OrderTotal.Amount")).alias("total"),
        F.coalesce(F.nullif("OrderTotal.CurrencyCode", F.lit("")), market_currency(F.col("market"))).alias("currency"),
        own.alias("marketplace_id"))


def normal_header(name: str) -> str:
    return re.sub(r"[- ]", "_", name.strip().lower())


def pick_columns(raw: DataFrame, candidates: dict[str, tuple[str, ...]], normalise=normal_header) -> dict[str, str]:
    """Field -> the first column of the file that is a candidate for it."""
    found = {}
    for field, names in candidates.items():
        for column in raw.columns:
            if normalise(column) in names:
                found[field] = column
                break
    return found


def tag_report(raw: DataFrame, tags: tuple[str, ...] = ("market", "range_label", "report_job_id")) -> DataFrame:
    """Report rows with their outcome: wrong_market, unmatched or matched.

    The market is told by the first signal column the file has; a row where
    that column is blank passes.  A file without a quantity column counts 1.
    """
    at = pick_columns(raw, REPORT_COLUMNS)

    def field(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{at[name]}`"), F.lit(""))) if name in at else F.lit("")

    signal = next((s for s in ("sales_channel", "currency", "ship_country") if s in at), "NONE")
    value = F.lower(field(signal)) if signal != "NONE" else F.lit("")
    fits = {
        "sales_channel": {"CA": ("amazon.ca",), "US": ("amazon.com", "amazon.com.us", "amazon")},
        "currency": {"CA": ("cad",), "US": ("usd",)},
        "ship_country": {"CA": ("ca",), "US": ("us", "usa")},
        "NONE": {},
    }[signal]
    wrong = F.lit(False)
    for market, values in fits.items():
        wrong = wrong | ((F.col("market") == market) & (value != "") & ~value.isin(*values))
    sku = codes.marketplace_sku(field("sku"))
    outcome = F.when(wrong, "wrong_market").when(sku.isNull(), "unmatched").otherwise("matched")
    return raw.select(
        *tags, outcome.alias("outcome"), F.lit(signal).alias("filter_signal"), field("sku").alias("seller_sku"), sku.alias("dashboard_sku"),
        F.nullif(field("name"), F.lit("")).alias("name"),
        (whole(field("quantity")) if "quantity" in at else F.lit(1).cast("long")).alias("quantity"),
        number(field("price")).alias("total"),
        # One candidate price column is per unit yet is stored as the line total.
        F.lit("price" in at and normal_header(at["price"]) == "item_price_per_unit").alias("price_per_unit"),
        field("date").alias("date_created"),
        calendar.business_date(field("date")).alias("local_date"), F.nullif(field("line_id"), F.lit("")).alias("shipment_item_id"))


def land_report(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("outcome") == "matched").drop("outcome")


def report_stats(tagged: DataFrame, keys: tuple[str, ...] = ("market", "range_label")) -> DataFrame:
    hit = F.col("outcome") == "matched"
    return tagged.groupBy(*keys, "filter_signal").agg(
        F.count("*").alias("rows_total"), F.count_if(hit).alias("rows_matched"),
        F.count_if(F.col("outcome") == "unmatched").alias("rows_unmatched"),
        F.count_if(F.col("outcome") == "wrong_market").alias("rows_wrong_market"),
        F.count_if(hit & F.col("shipment_item_id").isNull()).alias("identity_missing"))


def sniff_delimiter(header_line: str) -> str:
    return "\t" if header_line.count("\t") >= header_line.count(",") else ","


REQUIRED_COLUMNS = ("order_id", "purchase_date", "sku", "quantity", "item_price", "currency")


def missing_columns(columns: list[str]) -> list[str]:
    """Required fields that none of a file's columns holds."""
    return [f for f in REQUIRED_COLUMNS if not set(MARKETPLACE_CSV_COLUMNS[f]) & set(columns)]


def read_export_folder(spark: SparkSession, path: str) -> tuple[list[DataFrame], DataFrame]:
    """(one frame per kind of header, files) of a folder of exports in any mix of delimiters and naming conventions.

    files: file, header, delimiter, missing (required fields; such files are skipped, and so are files without a header).
    """
    kinds, files = folders.by_header(spark, path, sniff_delimiter)
    usable = [k for k in kinds if not missing_columns(k.columns)]
    bad = F.array_compact(F.array(*[
        F.when(~F.arrays_overlap("columns", F.array(*[F.lit(c) for c in MARKETPLACE_CSV_COLUMNS[f]])), F.lit(f)) for f in REQUIRED_COLUMNS]))
    return [folders.read(spark, k) for k in usable], files.select("file", "delimiter", bad.alias("missing"))


def canonical_csv(raw: DataFrame) -> DataFrame:
    """One export file under the importer's own column names."""
    at = pick_columns(raw, MARKETPLACE_CSV_COLUMNS, normalise=lambda c: c)
    missing = [f for f in REQUIRED_COLUMNS if f not in at]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    fields = [F.col(f"`{at[f]}`").alias(f) if f in at else F.lit(None).cast("string").alias(f) for f in MARKETPLACE_CSV_COLUMNS]
    return raw.select("position", *fields)


def csv_rows(files: list[DataFrame]) -> DataFrame:
    """Rows of all files with the reason a row is dropped for, or 'candidate'.

    A number is a text that is one as a whole; any other text counts 0.
    """
    rows = canonical_csv(files[0])
    for raw in files[1:]:
        rows = rows.unionByName(canonical_csv(raw), allowMissingColumns=True)

    def text(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    currency = F.upper(F.coalesce(blank_null(F.col("currency")), F.lit("AUD")))
    country = F.upper(text("country"))
    reason = (
        F.when(text("order_id") == "", "no_order_id").when(~country.isin("", "AU"), "non_au_ship_country")
        .when(currency != "AUD", "non_aud_currency").otherwise("candidate")
    )
    bought = text("purchase_date")
    moment = calendar.instant(F.regexp_replace(bought, " ", "T"))
    # The export's dates use a fixed +10 h, without daylight saving.
    day = F.coalesce((moment + F.expr("INTERVAL 10 HOURS")).cast("date"), calendar.leading_date(bought))
    return rows.select(
        "position", reason.alias("reason"), text("order_id").alias("order_id"), currency.alias("currency"), text("item_id").alias("item_id"),
        text("sku").alias("seller_sku"), bought.alias("purchase_date"), day.alias("local_date"), text("product_name").alias("name"),
        strict_whole(F.col("quantity")).alias("quantity"), strict(F.col("item_price")).alias("item_price"), strict(F.col("shipping")).alias("shipping"))


def csv_items(rows: DataFrame) -> DataFrame:
    """Kept lines: of repeats among the candidates, the earliest by file and row.

    A line is known by its shipment item id, else by order and SKU.
    """
    key = F.coalesce(F.nullif("item_id", F.lit("")), F.concat("order_id", F.lit("|"), "seller_sku"))
    candidates = rows.filter(F.col("reason") == "candidate").drop("reason").withColumn("dedupe_key", key)
    return first_by_key(candidates, ["dedupe_key"], ["position"]).withColumn(
        "dashboard_sku", codes.regional_marketplace_sku(F.col("seller_sku")))


def csv_orders(items: DataFrame) -> DataFrame:
    """One row per order; the earliest line dates it and the total includes shipping."""
    first = F.min(F.struct("position", "purchase_date", "local_date", "currency")).alias("f")
    return items.groupBy("order_id").agg(
        first, F.sum(F.col("item_price") + F.col("shipping")).cast("decimal(18,2)").alias("total"), F.count("*").alias("items")
    ).select("order_id", F.lit("Shipped").alias("status"), "f.purchase_date", "f.local_date", "f.currency", "total", "items")


def csv_stats(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(metric, key, n): rows by reason, mapped lines, unmapped SKUs, months covered.

    Only the number of repeats is reported: candidates read less lines kept.
    """
    def metric(name: str, df: DataFrame, key: str | Column = "key") -> DataFrame:
        shown = F.col(key) if isinstance(key, str) else key
        return df.select(F.lit(name).alias("metric"), shown.alias("key"), "n")

    count = F.count("*").alias("n")
    read = rows.groupBy("reason").agg(count)
    seen = read.agg(F.sum("n").alias("n"))
    candidate = F.col("reason") == "candidate"
    kept = items.agg(count)
    repeats = read.filter(candidate).select("n").unionByName(kept.select((-F.col("n")).alias("n"))).agg(F.sum("n").alias("n"))
    known = F.col("dashboard_sku").isNotNull()
    mapped = items.groupBy(F.when(known, "mapped").otherwise("unmapped").alias("key")).agg(count)
    unknown = items.filter(~known & (F.col("seller_sku") != "")).groupBy(F.col("seller_sku").alias("key")).agg(count)
    orders = items.groupBy("order_id").agg(F.min(F.struct("position", "local_date"))["local_date"].alias("local_date"))
    months = orders.filter(F.col("local_date").isNotNull()).groupBy(calendar.month_of(F.col("local_date")).alias("key")).agg(count)
    parts = [
        metric("rows", seen, F.lit("seen")), metric("reason", read.filter(~candidate), "reason"), metric("reason", kept, F.lit("kept")),
        metric("reason", repeats, F.lit("duplicate_item_id")), metric("lines", mapped), metric("unmapped sku", unknown), metric("month", months)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


FBA_SCHEMA = (
    "asin string, sellerSku string, fnSku string, productName string, totalQuantity long,"
    " inventoryDetails struct<fulfillableQuantity: long, inboundWorkingQuantity: long,"
    " reservedQuantity: struct<totalReservedQuantity: long>, unfulfillableQuantity: struct<totalUnfulfillableQuantity: long>>"
)


def fba_inventory(documents: DataFrame) -> DataFrame:
    """Flat stock; a real 0 stays 0, the total only stands in for absent details."""
    details = F.col("inventoryDetails")
    zero = F.lit(0).cast("long")

    def part(path: str) -> Column:
        return F.coalesce(F.col(f"inventoryDetails.{path}"), zero)

    return documents.select(
        F.coalesce("sellerSku", F.lit("")).alias("seller_sku"), codes.marketplace_sku(F.col("sellerSku")).alias("dashboard_sku"),
        F.when(details.isNotNull(), part("fulfillableQuantity")).otherwise(F.coalesce("totalQuantity", zero)).alias("fulfillable"),
        part("inboundWorkingQuantity").alias("inbound"), part("reservedQuantity.totalReservedQuantity").alias("reserved"),
        part("unfulfillableQuantity.totalUnfulfillableQuantity").alias("unfulfillable"))


def fba_match_counts(inventory: DataFrame) -> DataFrame:
    known = F.col("dashboard_sku").isNotNull()
    return inventory.agg(
        F.count("*").alias("count"), F.count_if(known).alias("matched"), F.count_if(~known & (F.col("seller_sku") != "")).alias("unmatched"))
