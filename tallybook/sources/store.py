"""Landing store orders: JSON documents and the bulk CSV export."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import calendar
from tallybook.functions.fixed import MARKET_CURRENCY
from tallybook.operators.maintain import arrival, first_by_key, newest_documents
from tallybook.sources.parse import any_time, blank_null, number, strict, strict_whole, whole

ORDER_SCHEMA = (
    "id long, number string, status string, date_created string, date_modified string, total string, currency string,"
    " line_items array<struct<sku string, name string, quantity string, total string>>"
)


def market_currency(market: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(MARKET_CURRENCY.items())])[market]


def land_orders(documents: DataFrame, with_lines: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(orders, lines) of documents tagged with their market.

    The local date is cut from the store's own clock text, never converted.
    An order delivered again replaces its header and all its lines: the copy
    modified last counts, then the one that arrived last.  Where only the orders
    are wanted, the lines of the documents need not be moved.
    """
    wanted = ["market", "number", "status", "date_created", "total", "currency", *(["line_items"] if with_lines else [])]
    documents = newest_documents(documents, "id", [F.coalesce("date_modified", "date_created"), arrival(documents)], wanted)
    local_date = calendar.leading_date(F.col("date_created")).alias("local_date")
    orders = documents.select(
        "id", "market",
        F.coalesce(F.nullif("number", F.lit("")), F.col("id").cast("string")).alias("number"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status"),
        F.coalesce("date_created", F.lit("")).alias("date_created"),
        local_date,
        number(F.col("total")).alias("total"),
        F.coalesce(F.nullif("currency", F.lit("")), market_currency(F.col("market"))).alias("currency"),
    )
    if not with_lines:
        return orders, None
    lines = documents.select(F.col("id").alias("order_id"), "market", local_date, F.explode("line_items").alias("li")).select(
        "order_id", "market", F.nullif("li.sku", F.lit("")).alias("sku"), F.nullif("li.name", F.lit("")).alias("name"),
        whole(F.col("li.quantity")).alias("quantity"), number(F.col("li.total")).alias("total"), "local_date")
    return orders, lines


_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def import_csv(rows: DataFrame, market: str = "AU") -> tuple[DataFrame, DataFrame]:
    """(orders, lines) of the export: one row per line, the order repeated.

    The first row of an order supplies its header.  A date in neither known
    format is kept as it is.
    """
    created = any_time(F.col("Order Created At"), _FORMATS)
    raw_date = F.trim(F.coalesce("Order Created At", F.lit("")))
    shaped = rows.select(
        "position", F.col("Order ID").try_cast("double").cast("long").alias("id"),
        F.regexp_replace(F.trim(F.coalesce(F.nullif("Order Number", F.lit("")), F.col("Order ID"))), "^#+", "").alias("number"),
        F.lower(F.coalesce(blank_null(F.col("Status")), F.lit("unknown"))).alias("status"),
        F.coalesce(F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss"), raw_date).alias("date_created"),
        strict(F.col("Total")).alias("total"),
        F.coalesce(blank_null(F.col("Currency")), market_currency(F.lit(market))).alias("currency"),
        blank_null(F.col("Line Item Sku")).alias("sku"), blank_null(F.col("Line Item Name")).alias("name"),
        strict_whole(F.col("Line Item Quantity")).alias("quantity"), strict(F.col("Line Item Total")).alias("line_total"),
    ).filter(F.col("id").isNotNull() & (F.col("id") != 0))
    header = ["id", "number", "status", "date_created", "total", "currency"]
    orders = first_by_key(shaped.select("position", *header), ["id"], ["position"]).drop("position").select(
        "id", F.lit(market).alias("market"), *header[1:], F.nullif(F.substring("date_created", 1, 10), F.lit("")).alias("local_date"))
    dates = orders.select(F.col("id").alias("order_id"), "date_created", "local_date")
    lines = shaped.select(F.col("id").alias("order_id"), "sku", "name", "quantity", F.col("line_total").alias("total")).join(dates, "order_id")
    return orders, lines


def import_summary(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders, lines and revenue per status, and orders and revenue per month."""
    counted = lines.groupBy("order_id").agg(F.count("*").alias("n"))
    joined = orders.join(counted, orders["id"] == counted["order_id"], "left")
    sums = [F.count("*").alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.sum("total").cast("decimal(18,2)").alias("revenue")]
    by_status = joined.groupBy(F.lit("status").alias("grp"), F.col("status").alias("key")).agg(*sums)
    dated = joined.filter(F.col("local_date").isNotNull())
    by_month = dated.groupBy(F.lit("month").alias("grp"), F.substring(F.col("local_date").cast("string"), 1, 7).alias("key")).agg(*sums)
    return by_status.unionByName(by_month)
