"""ERP sales, refunds, and the five-channel monthly merge.

Every report covers all months at once, keyed by ``ym``; filter the inputs or
the result to get one month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import calendar, codes
from tallybook.functions.fixed import (
    COUNTABLE_STATUSES, DEAD_CREDIT_STATUSES, DEAD_ORDER_STATUSES, SALES_CHANNELS,
)
from tallybook.operators.erp_lines import MONEY, derive_lines, with_channel
from tallybook.operators.ranking import ranked

TINS = "decimal(18,4)"


def _sum(col, kind: str = MONEY):
    return F.coalesce(F.sum(col), F.lit(0)).cast(kind)


def live_orders(orders: DataFrame) -> DataFrame:
    return with_channel(orders.filter(~F.upper(F.trim("status")).isin(*DEAD_ORDER_STATUSES)))


def live_credit_lines(credits: DataFrame) -> DataFrame:
    live = credits.filter(~F.upper(F.trim("status")).isin(*DEAD_CREDIT_STATUSES))
    return derive_lines(live, "credit").filter(F.col("parent_id") == 0).withColumn("ym", F.substring("created_date", 1, 7))


def channel_heads(orders: DataFrame, cutover: str) -> DataFrame:
    """Live channel orders as (order_id, channel, ym); 'amz' counts from the cut-over month."""
    attr, ym = F.col("channel_attr"), F.col("ym")
    heads = live_orders(orders).filter(attr.isin("col", "woo2", "dist") | ((attr == "amz") & (ym >= cutover)))
    return heads.select(F.col("id").alias("order_id"), attr.alias("channel"), "ym")


def channel_lines(orders: DataFrame, lines: DataFrame, cutover: str) -> DataFrame:
    """Top-level lines of channel orders: ym, channel, sku (base code), name, tins, total."""
    tops = derive_lines(lines, "sales").filter(F.col("parent_id") == 0)
    return tops.join(channel_heads(orders, cutover), "order_id").withColumnRenamed("base_sku", "sku")


def line_facts(lines: DataFrame) -> DataFrame:
    """Tins and revenue per month, channel, SKU and name: all later reports fold this."""
    return lines.groupBy("ym", "channel", "sku", "name").agg(
        _sum("tins", TINS).alias("tins"), _sum("total").alias("revenue"))


def order_counts(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders per month and channel that have a line.

    A semi join over the line's key alone: counting distinct ids on the wide
    join would shuffle every order of the report a second time.
    """
    return heads.join(lines.select("order_id"), "order_id", "left_semi").groupBy("ym", "channel").agg(F.count("*").alias("orders"))


def top_level(lines: DataFrame) -> DataFrame:
    return lines.filter(F.coalesce("parent_id", F.lit(0)) == 0)


def channel_month(facts: DataFrame, counts: DataFrame) -> DataFrame:
    sums = facts.groupBy("ym", "channel").agg(F.sum("tins").cast(TINS).alias("tins"), F.sum("revenue").cast(MONEY).alias("revenue"))
    return sums.join(counts, ["ym", "channel"])


def sku_pivot(facts: DataFrame) -> DataFrame:
    """Tins per base SKU and channel, with ERP and marketplace revenue apart."""
    attr = F.col("channel")
    tins = [_sum(F.when(attr == c, F.col("tins")), TINS).alias(c) for c in ("col", "woo2", "dist", "amz")]
    return facts.filter(F.col("sku").isNotNull()).groupBy("ym", "sku").agg(
        F.max("name").alias("name"), *tins,
        _sum(F.when(attr == "amz", F.col("revenue"))).alias("amz_revenue"),
        _sum(F.when(attr != "amz", F.col("revenue"))).alias("erp_revenue"))


def refunds_month(credits: DataFrame) -> DataFrame:
    """One negative pool per month; a note counts when any line moves something."""
    moved = (F.col("tins") != 0) | (F.col("revenue_signed") != 0)
    return live_credit_lines(credits).groupBy("ym").agg(
        _sum("tins", TINS).alias("tins"), _sum("revenue_signed").alias("revenue"),
        F.count_distinct(F.when(moved, F.col("credit_note_id"))).alias("orders"))


def refund_sku_lines(credits: DataFrame) -> DataFrame:
    lines = live_credit_lines(credits).filter(F.col("is_au_sku") & F.col("base_sku").isNotNull())
    name = F.max("name") if "name" in lines.columns else F.max(F.lit(None).cast("string"))
    return lines.groupBy("ym", F.col("base_sku").alias("sku")).agg(
        _sum("tins", TINS).alias("tins"), _sum("revenue_signed").alias("sales"), name.alias("name"))


def store_heads(orders: DataFrame, market: str = "AU") -> DataFrame:
    keep = orders.filter((F.col("market") == market) & F.col("status").isin(*COUNTABLE_STATUSES))
    return keep.select(
        F.col("id").alias("order_id"), F.lit("woo").alias("channel"), calendar.month_of(F.col("local_date")).alias("ym"))


def store_lines(orders: DataFrame, lines: DataFrame, market: str = "AU") -> DataFrame:
    """Regional store lines; a code of another region has no base SKU and moves no tins."""
    sku = F.col("sku")
    regional = codes.is_regional(sku)
    rows = lines.select(
        "order_id", "name", "quantity", "total", F.when(regional, codes.base_code(sku)).alias("sku"),
        F.when(regional, F.col("quantity") * codes.pack_size(sku)).otherwise(0).cast("bigint").alias("tins"))
    return rows.join(store_heads(orders, market), "order_id")


def store_facts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("ym", "channel", "sku", "name").agg(
        F.sum("quantity").alias("units"), F.sum("tins").alias("tins"), _sum("total").alias("revenue"))


def store_channel(facts: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channel totals, per-SKU rows) of the store channel."""
    sums = [F.sum("units").alias("units"), F.sum("tins").alias("tins"), F.sum("revenue").cast(MONEY).alias("revenue")]
    total = facts.groupBy("ym", "channel").agg(*sums).join(counts, ["ym", "channel"]).drop("channel")
    by_sku = facts.filter(F.col("sku").isNotNull()).groupBy("ym", "sku").agg(F.max("name").alias("name"), *sums)
    return total, by_sku


def marketplace_facts(items: DataFrame, market: str = "AU") -> DataFrame:
    """Units and line revenue per month, SKU and name; one tin per unit."""
    rows = items.filter(F.col("market") == market)
    name = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    return rows.groupBy(
        calendar.month_of(F.col("local_date")).alias("ym"), F.col("dashboard_sku").alias("sku"), name.alias("name")).agg(
        F.sum("quantity").alias("units"), _sum("total").alias("revenue"))


def marketplace_heads(orders: DataFrame, market: str = "AU") -> DataFrame:
    """Orders and order revenue per month: the channel figure includes shipping."""
    return orders.filter(F.col("market") == market).groupBy(calendar.month_of(F.col("local_date")).alias("ym")).agg(
        F.count_distinct("id").alias("orders"), _sum("total").alias("revenue"))


def marketplace_channel(facts: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channel totals, per-SKU rows): orders give revenue, lines give units.

    Units count unmapped lines, the SKU rows do not.
    """
    zero = F.lit(0).cast("bigint")
    units = facts.groupBy("ym").agg(F.sum("units").alias("units"))
    total = heads.join(units, "ym", "full").select(
        "ym", F.coalesce("units", zero).alias("units"), F.coalesce("units", zero).alias("tins"),
        F.coalesce("revenue", F.lit(0).cast(MONEY)).alias("revenue"), F.coalesce("orders", zero).alias("orders"))
    by_sku = facts.filter(F.col("sku").isNotNull()).groupBy("ym", "sku").agg(
        F.max("name").alias("name"), F.sum("units").alias("units"), F.sum("revenue").cast(MONEY).alias("revenue"))
    return total, by_sku


def five_channel_facts(
    erp_orders: DataFrame, erp_lines: DataFrame, store_orders: DataFrame, store_items: DataFrame,
    market_orders: DataFrame, market_items: DataFrame, cutover: str,
) -> DataFrame:
    """Everything the five-channel report adds up, already summed per source.

    ``revenue`` counts for the SKU, ``channel_revenue`` for the channel: they
    differ for marketplace lines, whose channel revenue comes from the orders.
    ``rank`` says whose product name wins.
    """
    zero = F.lit(0).cast(MONEY)
    none = F.lit(None).cast("string")

    def shape(df: DataFrame, rank: int, channel, sku, name, tins, revenue, channel_revenue, orders) -> DataFrame:
        return df.select(
            "ym", channel.alias("channel"), sku.alias("sku"), F.lit(rank).alias("rank"), F.nullif(name, F.lit("")).alias("name"),
            tins.cast(TINS).alias("tins"), revenue.cast(MONEY).alias("revenue"),
            channel_revenue.cast(MONEY).alias("channel_revenue"), orders.cast("bigint").alias("orders"))

    def lines_of(df: DataFrame, rank: int) -> DataFrame:
        return shape(df, rank, F.col("channel"), F.col("sku"), F.col("name"), F.col("tins"), F.col("revenue"), F.col("revenue"), F.lit(0))

    def orders_of(df: DataFrame) -> DataFrame:
        return shape(df, 9, F.col("channel"), none, none, F.lit(0), zero, zero, F.col("orders"))

    amz = F.lit("amz")
    before = F.col("ym") < cutover
    items = marketplace_facts(market_items).filter(before)
    heads = marketplace_heads(market_orders).filter(before)
    parts = [
        lines_of(line_facts(channel_lines(erp_orders, erp_lines, cutover)), 0),
        orders_of(order_counts(channel_heads(erp_orders, cutover), top_level(erp_lines))),
        lines_of(store_facts(store_lines(store_orders, store_items)), 1),
        orders_of(order_counts(store_heads(store_orders), store_items)),
        shape(items, 2, amz, F.col("sku"), F.col("name"), F.col("units"), F.col("revenue"), zero, F.lit(0)),
        shape(heads, 9, amz, none, none, F.lit(0), zero, F.col("revenue"), F.col("orders")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tins per channel, totals, and the product name of the best-ranked source."""
    named = F.when(F.col("name").isNotNull(), F.struct((-F.col("rank")).alias("order"), "name"))
    return rows.groupBy(*keys).agg(
        F.max(named)["name"].alias("name"),
        *[_sum(F.when(F.col("channel") == c, F.col("tins")), TINS).alias(c) for c in SALES_CHANNELS],
        _sum("tins", TINS).alias("total_tins"), _sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))


def _moved():
    return (F.col("total_tins") != 0) | (F.col("revenue") != 0)


def sku_rows(facts: DataFrame) -> DataFrame:
    """One row per month and SKU over all five channels, all-zero rows dropped."""
    return _fold(facts.filter(F.col("sku").isNotNull()), ["ym", "sku"]).filter(_moved()).drop("orders")


def five_channel(facts: DataFrame, credits: DataFrame) -> DataFrame:
    """The monthly sales report as rows tagged by section: channel, sku, refund, refund_sku.

    Channel and SKU rows come out of one aggregation over the summed facts.
    """
    def entry(section: str, key, name, revenue, orders):
        return F.struct(
            F.lit(section).alias("section"), key.alias("key"), name.alias("name"), revenue.alias("revenue"), orders.alias("orders"))

    none = F.lit(None)
    text, tins = none.cast("string"), none.cast(TINS)
    entries = F.array_compact(F.array(
        entry("channel", F.col("channel"), text, F.col("channel_revenue"), F.col("orders")),
        F.when(F.col("sku").isNotNull(), entry("sku", F.col("sku"), F.col("name"), F.col("revenue"), none.cast("bigint")))))
    rows = facts.select("ym", "channel", "rank", "tins", F.explode(entries).alias("e")).select("ym", "channel", "rank", "tins", "e.*")
    folded = _fold(rows, ["section", "ym", "key"]).filter((F.col("section") == "channel") | _moved())
    is_sku = F.col("section") == "sku"
    out = ["section", "ym", "key", "name", *SALES_CHANNELS, "total_tins", "revenue", "orders"]
    sales = folded.withColumns({c: F.when(is_sku, F.col(c)) for c in SALES_CHANNELS}).select(*out)
    blank = {c: tins for c in SALES_CHANNELS}
    refunds = refunds_month(credits).withColumns({
        "section": F.lit("refund"), "key": F.lit("all"), "name": text, **blank}).withColumnRenamed("tins", "total_tins")
    refund_skus = refund_sku_lines(credits).withColumns({
        "section": F.lit("refund_sku"), "orders": none.cast("bigint"), **blank}).withColumnsRenamed(
        {"sku": "key", "tins": "total_tins", "sales": "revenue"})
    return sales.unionByName(refunds.select(*out)).unionByName(refund_skus.select(*out))


def five_channel_order() -> list:
    """Sections together, months in order, the biggest SKUs first."""
    return ["section", "ym", F.col("total_tins").desc(), "key"]


def five_channel_sorted(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*five_channel_order())


def five_channel_whole(rows: DataFrame, cutover: str) -> DataFrame:
    """The report of ``five_channel`` as it is shown: each month of it has all five channels and a refund row, zeros
    included, and its counts; ``position`` is a row's place in the order of the report.

    Counts: orders of the ERP's channels (the marketplace among them from the cut-over month on), the same with refund notes,
    the notes, and the SKU rows.  Months, channels and counts are added to rows that have been summed before.
    """
    slots = F.array(*[F.struct(F.lit("channel").alias("section"), F.lit(c).alias("key")) for c in SALES_CHANNELS], F.struct(F.lit("refund").alias("section"), F.lit("all").alias("key")))
    zeros = rows.select("ym").distinct().select("ym", F.explode(slots).alias("s")).select(
        "s.section", "ym", "s.key", F.lit(0).cast(TINS).alias("total_tins"), F.lit(0).cast(rows.schema["revenue"].dataType).alias("revenue"), F.lit(0).cast("bigint").alias("orders"))
    shown = rows.filter(F.col("section").isin("channel", "refund")).unionByName(zeros, allowMissingColumns=True).groupBy("section", "ym", "key").agg(
        *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in ("total_tins", "revenue", "orders")])
    erp_channels = ~F.col("key").isin("woo", "amz") | ((F.col("key") == "amz") & (F.col("ym") >= cutover))
    of_erp = F.sum(F.when((F.col("section") == "channel") & erp_channels, F.col("orders")).otherwise(0))
    notes = F.sum(F.when(F.col("section") == "refund", F.col("orders")).otherwise(0))
    counts = rows.groupBy("ym").agg(
        of_erp.alias("ordersConsidered"), (of_erp + notes).alias("attributedRefs"), notes.alias("creditNotesConsidered"),
        F.count_if(F.col("section") == "sku").alias("skuRows"),
    ).unpivot("ym", ["ordersConsidered", "attributedRefs", "creditNotesConsidered", "skuRows"], "key", "orders").withColumn("section", F.lit("counts"))
    lists = rows.filter(F.col("section").isin("sku", "refund_sku"))
    whole = lists.unionByName(shown, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True)
    return ranked(whole.select(*rows.columns), *five_channel_order())


def channel_month_raw(documents: DataFrame, credits: DataFrame) -> DataFrame:
    """The same month straight from nested documents, for parity with the tables.

    ``documents`` hold a ``lineItems`` array; a document may carry any part of
    an order's lines.  Blank codes are skipped and refunds include 'refund' orders.
    """
    orders = live_orders(documents).filter(F.col("channel_attr").isNotNull())
    exploded = orders.select(
        "channel_attr", "ym", F.coalesce("reference", F.col("id").cast("string")).alias("ref"), F.explode("lineItems").alias("li"))
    lines = derive_lines(exploded.select("channel_attr", "ym", "ref", "li.*"), "sales").filter(
        (F.col("parent_id") == 0) & F.col("code").isNotNull())
    sales = lines.select("ym", F.col("channel_attr").alias("channel"), "tins", "total", "ref")
    notes = live_credit_lines(credits)
    moved = (F.col("tins") != 0) | (F.col("revenue_signed") != 0)
    back = notes.select(
        "ym", F.lit("refund").alias("channel"), "tins", F.col("revenue_signed").alias("total"),
        F.when(moved, F.concat(F.lit("note-"), F.col("credit_note_id").cast("string"))).alias("ref"))
    return sales.unionByName(back).groupBy("ym", "channel").agg(
        _sum("tins", TINS).alias("tins"), _sum("total").alias("revenue"), F.count_distinct("ref").alias("orders"))


def channel_source_compare(orders: DataFrame, lines: DataFrame, market_orders: DataFrame, market_items: DataFrame) -> DataFrame:
    """Marketplace sales by month from the ERP mirror and from the marketplace.

    Each side is reduced to one row per month before the two meet.
    """
    mirror = orders.filter(
        ~F.col("status").isin(*DEAD_ORDER_STATUSES) & F.lower(F.trim("company")).startswith("amazon seller"))
    tops = derive_lines(lines, "sales").filter(F.col("parent_id") == 0)
    erp = tops.join(mirror.select(F.col("id").alias("order_id"), F.substring("created_date", 1, 7).alias("ym")), "order_id").groupBy("ym").agg(
        F.count_distinct("order_id").alias("erp_orders"), _sum("tins", TINS).alias("erp_tins"), _sum("total").alias("erp_revenue"))
    own, _ = marketplace_channel(marketplace_facts(market_items), marketplace_heads(market_orders))
    own = own.select("ym", F.col("orders").alias("mkt_orders"), F.col("tins").alias("mkt_tins"), F.col("revenue").alias("mkt_revenue"))
    return erp.join(own, "ym", "full").na.fill(0)


def stage_distribution(orders: DataFrame, column: str, status: str | None = None) -> DataFrame:
    """Rows per value of a column, nulls shown as '(NULL)'."""
    if status is not None:
        orders = orders.filter(F.col("status") == status)
    return orders.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(NULL)")).alias("value")).agg(F.count("*").alias("n"))


def value_profile(rows: DataFrame, fields: list[str], top: int) -> DataFrame:
    """Top values of each field by count; ties break on the value.

    Counting comes first, so ranking sees one row per distinct value, and the
    limit is applied in every task before the rows of a field are brought together.
    """
    shown = rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    counted = shown.unpivot([], fields, "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= top)


def credit_note_profile(credits: DataFrame) -> DataFrame:
    """Parent, child and alternative-unit line counts of credit notes, by status."""
    return credits.groupBy("status").agg(
        F.count_distinct("credit_note_id").alias("notes"), F.count("*").alias("lines"),
        F.count_if(F.coalesce("parent_id", F.lit(0)) == 0).alias("parent_lines"),
        F.count_if(F.coalesce("parent_id", F.lit(0)) > 0).alias("child_lines"),
        F.count_if(F.coalesce("uom_size", F.lit(0)) > 1).alias("alt_unit_lines"))


def order_samples(orders: DataFrame, lines: DataFrame, limit: int) -> DataFrame:
    """First orders that look like bulk orders or like refunds, oldest id first."""
    flags = lines.groupBy("order_id").agg(
        F.max(F.coalesce(F.col("code"), F.lit("")).startswith("AU-CTN-")).alias("bulk"), F.max(F.col("qty") < 0).alias("refund"))
    hits = orders.join(flags, orders["id"] == flags["order_id"])

    def sample(kind: str) -> DataFrame:
        return hits.filter(F.col(kind)).orderBy("id").limit(limit).select(F.lit(kind).alias("kind"), "id", "reference", "company")

    return sample("bulk").unionByName(sample("refund"))
