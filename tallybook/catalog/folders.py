"""Landing from folders of files as they are delivered, with what can't be landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.catalog.base import query
from tallybook.catalog.landing import _MKT_KEPT, marketplace_files, s, store_texts
from tallybook.session import work_dir
from tallybook.sources import marketplace, parse, store


def _export_folder(v):
    """Both conventions, comma and tab separated, with number texts no importer takes, one that lacks columns and an empty file.

    A large export comes in parts, each with its header: the rows of a part follow those of the parts before it by name.
    """
    path = work_dir(v.spark, "exports")
    titled, hyphened = marketplace_files(v)

    def spoiled(rows, order, quantity, price):
        # A quarter of the orders has numbers with a thousands separator or a unit.
        odd = F.pmod(F.crc32(F.col(order).cast("binary")), F.lit(4))
        return rows.withColumns({
            quantity: F.when(odd == 1, "12abc").when(odd == 2, F.concat(F.lit(" "), quantity)).otherwise(F.col(quantity)),
            price: F.when(odd == 1, "1,234.50").otherwise(F.col(price))}).repartitionByRange("position").sortWithinPartitions("position").drop("position")

    files = (
        ("a-titled", ",", spoiled(titled, "Amazon Order Id", "Dispatched Quantity", "Item Price")),
        ("b-hyphened", "\t", spoiled(hyphened, "amazon-order-id", "quantity-shipped", "item-price")),
        ("c-other", ",", v("part").select(s("p_partkey").alias("sku"), F.lit("x").alias("note"))),
    )
    for name, sep, rows in files:
        rows.write.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", False).csv(f"{path}/{name}")
    v.spark.range(1).select(F.lit("").alias("value")).coalesce(1).write.option("lineSep", "\n").option("compression", "none").text(f"{path}/d-empty")
    return path


# CRC-32 of the order number in SQL, by its table of 256 remainders.
_CRC = """(SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
 lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
_ODD = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(order_id) + 1), lambda k: ascii(substr(order_id, k, 1))::BIGINT)),
 lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4"""


@query("import_marketplace_folder", f"""
WITH k AS (SELECT * REPLACE (CASE WHEN odd = 1 THEN 0 ELSE quantity END AS quantity, CASE WHEN odd = 1 THEN 0 ELSE item_price END AS item_price) FROM (SELECT k.*, {_ODD} AS odd FROM ({_MKT_KEPT}) k, {_CRC}))
SELECT 'order' AS kind, order_id, CAST(NULL AS VARCHAR) AS sku, CAST(count(*) AS BIGINT) AS quantity, CAST(sum(item_price + shipping) AS DOUBLE) AS total, CAST(any_value(local_date) AS VARCHAR) AS local_date FROM k GROUP BY 2
UNION ALL SELECT 'item', order_id, trim(sku), CAST(quantity AS BIGINT), CAST(item_price AS DOUBLE), CAST(local_date AS VARCHAR) FROM k""")
def import_marketplace_folder(v):
    frames, _ = marketplace.read_export_folder(v.spark, _export_folder(v))
    items = marketplace.csv_items(marketplace.csv_rows(frames))
    orders = marketplace.csv_orders(items).select(
        F.lit("order").alias("kind"), "order_id", F.lit(None).cast("string").alias("sku"), F.col("items").alias("quantity"), "total", "local_date")
    return orders.unionByName(items.select(F.lit("item").alias("kind"), "order_id", F.col("seller_sku").alias("sku"), "quantity", F.col("item_price").alias("total"), "local_date"))


@query("export_folder_files", """
SELECT * FROM (VALUES ('a-titled', ',', ''), ('b-hyphened', chr(9), ''), ('c-other', ',', 'order_id,purchase_date,quantity,item_price,currency'), ('d-empty', NULL, 'order_id,purchase_date,sku,quantity,item_price,currency')) t(folder, delimiter, missing)
WHERE (SELECT count(*) FROM x_mkt_csv) > 0""")
def export_folder_files(v):
    _, files = marketplace.read_export_folder(v.spark, _export_folder(v))
    return files.select(F.element_at(F.split("file", "/"), -2).alias("folder"), "delimiter", F.array_join("missing", ",").alias("missing")).distinct()


def _delivered(v):
    """Store documents as texts; some are cut off, some have lost their id."""
    docs = store_texts(v).filter("arrival = 0")
    n = F.get_json_object("value", "$.id").cast("long")
    text = F.when(n % 50 == 7, F.expr("substring(value, 1, length(value) - 5)")).when(n % 50 == 9, F.regexp_replace("value", "^\\{\"id\":\\d+", '{"id":null')).otherwise(F.col("value"))
    return docs.withColumn("value", text)


@query("land_store_rejects", """
WITH d AS (SELECT market, id FROM f_store_orders UNION ALL SELECT market, id FROM f_store_orders WHERE id % 6 = 0),
r AS (SELECT market, CASE id % 50 WHEN 7 THEN 'broken' WHEN 9 THEN 'no key' END AS reason FROM d)
SELECT market, coalesce(reason, 'landed') AS outcome, CAST(count(*) AS BIGINT) AS deliveries FROM r WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT market, 'landed', count(DISTINCT id) FROM d WHERE id % 50 NOT IN (7, 9) GROUP BY 1""")
def land_store_rejects(v):
    path = work_dir(v.spark, "store-documents")
    _delivered(v).write.partitionBy("market").option("compression", "zstd").parquet(path)
    good, rejects = parse.with_rejects(v.spark.read.parquet(path), store.ORDER_SCHEMA)
    orders, _ = store.land_orders(good, with_lines=False)
    landed = orders.groupBy("market").agg(F.count("*").alias("deliveries")).select("market", F.lit("landed").alias("outcome"), "deliveries")
    return rejects.groupBy("market", F.col("reason").alias("outcome")).agg(F.count("*").alias("deliveries")).select("market", "outcome", "deliveries").unionByName(landed)
