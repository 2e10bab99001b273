"""Landing stock rows, product meta, 3PL items, WMS uploads and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import codes
from tallybook.functions.fixed import SALES_CHANNELS
from tallybook.operators.maintain import latest_by_key
from tallybook.sources.parse import number

STOCK_SCHEMA = (
    "code string, styleCode string, productName string, option1 string, option2 string, option3 string, branchName string,"
    " stockOnHand decimal(18,4), available decimal(18,4), incoming decimal(18,4), openPurchaseOrders decimal(18,4)"
)


def land_stock(documents: DataFrame) -> DataFrame:
    """Stock rows; the style code and the legacy incoming field are fallbacks."""
    def filled(c: str) -> Column:
        return F.nullif(c, F.lit(""))

    def units(*fields: str) -> Column:
        """Whole units: a feed may write 12 as 12.0."""
        return F.round(F.coalesce(*fields, F.lit(0)), 0).cast("long")

    options = F.concat_ws(" / ", filled("option1"), filled("option2"), filled("option3"))
    title = F.when(options == "", filled("productName")).when(filled("productName").isNotNull(), F.concat_ws(" — ", filled("productName"), options))
    return documents.select(
        codes.clean(F.coalesce(filled("code"), filled("styleCode"))).alias("code"), F.col("branchName").alias("branch_name"),
        units("stockOnHand").alias("stock_on_hand"), units("available").alias("available"),
        units("incoming", "openPurchaseOrders").alias("incoming"),
        title.alias("product_name"),
    ).filter(F.col("code") != "")


PRODUCT_SCHEMA = "id long, styleCode string, category string, status string, productOptions array<struct<code: string, status: string>>"


def land_product_meta(documents: DataFrame) -> DataFrame:
    """One row per option code, the style code standing in; the last write wins."""
    options = F.when(F.size("productOptions") > 0, F.col("productOptions"))
    exploded = documents.select("id", "styleCode", "category", F.col("status").alias("product_status"), F.posexplode_outer(options).alias("at", "o"))
    rows = exploded.select(
        "id", F.coalesce("at", F.lit(0)).alias("at"), codes.clean(F.coalesce(F.nullif("o.code", F.lit("")), F.col("styleCode"))).alias("code"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce(F.nullif("o.status", F.lit("")), F.col("product_status"), F.lit("")).alias("status")).filter(F.col("code") != "")
    return latest_by_key(rows, ["code"], ["id", "at"]).drop("id", "at")


_ITEM = (
    "sku: string, name: string, description: string, quantity: string, quantity_reserved: string, quantity_incoming: string,"
    " low_threshold: string, cost: string, category: string"
)
_WRAPPED = f"struct<Item: struct<{_ITEM}>, {_ITEM}>"


def land_3pl_items(pages: DataFrame, column: str = "value") -> DataFrame:
    """Items of pages in any of three shapes, each item bare or wrapped in ``Item``."""
    text = F.col(column)
    nested = F.flatten(F.from_json(text, f"struct<items: array<array<{_WRAPPED}>>>")["items"])
    flat = F.from_json(text, f"struct<items: array<{_WRAPPED}>>")["items"]
    bare = F.from_json(text, f"array<{_WRAPPED}>")
    items = F.when(text.rlike(r"^\s*\["), bare).when(text.rlike(r'"items"\s*:\s*\[\s*\['), nested).otherwise(flat)
    rows = pages.select(F.explode(items).alias("r")).select(F.coalesce("r.Item", F.struct(*[f"r.{f.split(':')[0].strip()}" for f in _ITEM.split(",")])).alias("i")).select("i.*")

    def amount(c: str) -> Column:
        return number(F.col(c))

    category = F.coalesce(F.get_json_object("category", "$.name"), F.col("category"), F.lit(""))
    return rows.select(
        F.trim(F.coalesce("sku", F.lit(""))).alias("sku"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"),
        amount("quantity").alias("quantity"), amount("quantity_reserved").alias("quantity_reserved"),
        amount("quantity_incoming").alias("quantity_incoming"), amount("low_threshold").alias("low_threshold"), amount("cost").alias("cost"),
        category.alias("category"))


def threepl_inventory(items: DataFrame) -> DataFrame:
    """Finished goods at the 3PL: packaging, manufacturing, labels and parts are left out."""
    skip = F.lower("category").rlike("packaging|manufacturing") | F.col("sku").rlike("^(Label-|MF-)")
    return items.filter(~skip).select("sku", "name", (F.col("quantity") - F.col("quantity_reserved")).alias("quantity"), "category")


def validate_upload(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One row: count, blank SKUs and the verdict, which names every check an upload fails."""
    blank = F.trim(F.coalesce("sku", F.lit(""))) == ""
    counted = rows.agg(F.count("*").alias("rows"), F.count_if(blank).alias("blank"))
    failed = [F.when(F.col("rows") == 0, "inventory is empty"), F.when(F.col("blank") > 0, "blank sku")]
    if max_rows is not None:
        failed.insert(1, F.when(F.col("rows") > max_rows, "inventory too large"))
    verdict = F.concat_ws("; ", *failed)
    return counted.withColumn("verdict", F.when(verdict == "", "ok").otherwise(verdict))


def accept_upload(rows: DataFrame, uploaded_at: str, file_name: str = "unknown", max_rows: int | None = None) -> DataFrame:
    """The upload stamped for storage; an invalid one fails the job."""
    check = validate_upload(rows, max_rows).first()
    if check["verdict"] != "ok":
        raise ValueError(check["verdict"])
    return rows.withColumns({
        "count": F.lit(check["rows"]), "uploaded_at": F.lit(uploaded_at), "file_name": F.lit(file_name)})


HISTORY_SCHEMA = "sku string, monthlySales map<string, int>, allocated int"


def buying_history_long(documents: DataFrame) -> DataFrame:
    """One row per SKU and month; the allocation buffer is kept on each."""
    return documents.select("sku", F.explode("monthlySales").alias("ym", "quantity"), "allocated")


def buying_history_document(texts: DataFrame, column: str = "value") -> DataFrame:
    """The same rows of whole scripts that hold one object keyed by SKU: comments and the export go, keys become rows.

    A SKU without months has one row without a month; so its allocation isn't lost.
    """
    body = F.regexp_replace(F.col(column), r"(?m)^\s*//.*$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)^\s*export\s+default\s*", ""), r"(?s);\s*$", "")
    docs = F.from_json(body, "map<string, struct<monthlySales: map<string, int>, allocated: int>>")
    return texts.select(F.explode(docs).alias("sku", "d")).select(
        "sku", F.explode_outer("d.monthlySales").alias("ym", "quantity"), F.col("d.allocated").alias("allocated"))


_CHANNEL = "struct<units: double, tins: double, revenue: double, orders: long>"
_SKU = "struct<sku: string, name: string, woo: double, amz: double, col: double, woo2: double, dist: double, total_tins: double, revenue: double>"
SNAPSHOT_SCHEMA = f"struct<salesByMonth: map<string, map<string, {_CHANNEL}>>, skuSalesByMonth: map<string, array<{_SKU}>>>"


def _snapshots(texts: DataFrame, column: str) -> DataFrame:
    body = F.regexp_replace(F.col(column), r"(?m)^\s*//.*$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)^\s*window\.\w+\s*=\s*", ""), r"(?s);\s*$", "")
    return texts.select(F.from_json(body, SNAPSHOT_SCHEMA).alias("d"))


def month_snapshot_channels(texts: DataFrame, column: str = "value") -> DataFrame:
    """What the scripts say by channel: a channel's units and tins of a month, and each SKU's tins by channel."""
    docs = _snapshots(texts, column)
    channels = docs.select(F.explode("d.salesByMonth").alias("ym", "c")).select("ym", F.explode("c").alias("channel", "r")).select(
        "ym", "channel", F.lit(None).cast("string").alias("sku"), "r.units", "r.tins")
    skus = docs.select(F.explode("d.skuSalesByMonth").alias("ym", "s")).select("ym", F.explode("s").alias("r")).select("ym", "r.sku", *[f"r.{c}" for c in SALES_CHANNELS])
    by_channel = skus.unpivot(["ym", "sku"], list(SALES_CHANNELS), "channel", "tins").filter(F.col("tins").isNotNull())
    return channels.unionByName(by_channel, allowMissingColumns=True)


def month_snapshot(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows of baked script files: drop comments and the assignment, parse, explode."""
    docs = _snapshots(texts, column)
    channels = docs.select(F.explode("d.salesByMonth").alias("ym", "c")).select("ym", F.explode("c").alias("key", "r")).select(
        F.lit("channel").alias("section"), "ym", "key", "r.tins", "r.revenue", "r.orders")
    skus = docs.select(F.explode("d.skuSalesByMonth").alias("ym", "s")).select("ym", F.explode("s").alias("r")).select(
        F.lit("sku").alias("section"), "ym", F.col("r.sku").alias("key"), F.col("r.total_tins").alias("tins"), "r.revenue",
        F.lit(None).cast("long").alias("orders"))
    return channels.unionByName(skus)
