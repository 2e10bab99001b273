"""Landing from real files: header variants, page shapes, quoted newlines."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallybook.sources import erp, marketplace, parse, stock, store


def test_store_documents(spark, tmp_path):
    docs = [
        {"id": 1, "number": "N1", "status": "completed", "date_created": "2026-04-28T23:18:49", "total": "12.50", "currency": "CAD",
         "line_items": [{"sku": "A", "name": "a", "quantity": 3, "total": "10.00"}, {"sku": "", "quantity": "2.9", "total": None}]},
        {"id": 2, "date_created": "2026-04-29T00:00:00", "line_items": []},
    ]
    (tmp_path / "o.json").write_text("\n".join(map(json.dumps, docs)))
    raw = parse.read_documents(spark, str(tmp_path), store.ORDER_SCHEMA).withColumn("market", F.lit("CA"))
    orders, lines = store.land_orders(raw)
    got = {r["id"]: r for r in orders.collect()}
    assert (got[1]["number"], got[1]["local_date"], float(got[1]["total"])) == ("N1", dt.date(2026, 4, 28), 12.5)
    assert (got[2]["number"], got[2]["status"], got[2]["currency"], float(got[2]["total"])) == ("2", "unknown", "CAD", 0.0)
    assert sorted((r["sku"], r["quantity"]) for r in lines.collect() if r["sku"]) == [("A", 3)]
    assert lines.filter("sku IS NULL").first()["quantity"] == 2


def test_store_order_delivered_again_replaces_its_lines(spark):
    def doc(status, modified, *quantities):
        items = [{"sku": "A", "quantity": q, "total": "1"} for q in quantities]
        return json.dumps({"id": 1, "status": status, "date_created": "2026-01-01T00:00:00", "date_modified": modified, "line_items": items})

    first, later, tied = doc("refunded", "2026-01-01T00:00:00", 2, 5), doc("completed", "2026-01-02T00:00:00", 1), doc("on-hold", "2026-01-02T00:00:00", 7)
    for texts, status, quantities in (((first, later, first), "completed", [1]), ((later, tied), "on-hold", [7]), ((first, first), "refunded", [2, 5])):
        raw = parse.from_text(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, arrival int"), store.ORDER_SCHEMA)
        orders, lines = store.land_orders(raw.withColumn("market", F.lit("CA")))
        assert [r["status"] for r in orders.collect()] == [status]
        assert sorted(r["quantity"] for r in lines.collect()) == quantities


def test_store_csv_quoted_newlines(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        "Order ID,Order Number,Status,Order Created At,Currency,Total,Line Item Sku,Line Item Name,Line Item Quantity,Line Item Total,Line Item Meta\n"
        '7,#7,Completed,2026-01-02 03:04:05,AUD,9.5,A,"big\ntin",2,9.5,"a: 1\nb: 2"\n'
        "7,#7,Failed,2026-01-02 03:04:05,AUD,9.5,B,tin,1,0,x\n"
        "0,#0,Failed,2026-01-02,AUD,9.5,B,tin,1,0,x\n"
        ",,,,,,,,,,\n")
    orders, lines = store.import_csv(parse.read_csv(spark, str(tmp_path)))
    assert [(r["id"], r["number"], r["status"], r["date_created"], r["local_date"]) for r in orders.collect()] == [
        (7, "7", "completed", "2026-01-02T03:04:05", "2026-01-02")]
    assert sorted((r["sku"], r["name"], r["quantity"]) for r in lines.collect()) == [("A", "big\ntin", 2), ("B", "tin", 1)]


def report(spark, tmp_path, header, *rows):
    (tmp_path / "r.txt").write_text("\n".join(["\t".join(header), *["\t".join(r) for r in rows]]) + "\n")
    raw = parse.read_report(spark, str(tmp_path / "r.txt"))
    return marketplace.tag_report(raw.withColumn("market", F.lit("CA")), ("market",))


def test_report_headers_and_signals(spark, tmp_path):
    tagged = report(
        spark, tmp_path, ["Seller SKU", "Quantity Shipped", "item-price", "Purchase-Date", "shipment-item-id", "Sales Channel"],
        ["CA-OG-NPO-35", "2", "5.5", "2026-04-29T03:18:49+00:00", "L1", "Amazon.ca"], ["CA-OG-NPO-35", "2", "5.5", "", "", ""],
        ["CA-OG-NPO-35", "2", "5.5", "", "L3", "amazon.com"], ["UNKNOWN", "1", "1", "", "L4", "amazon.ca"])
    rows = tagged.orderBy(F.coalesce("shipment_item_id", F.lit("L2"))).collect()
    assert [r["outcome"] for r in rows] == ["matched", "matched", "wrong_market", "unmatched"]
    assert rows[0]["local_date"] == dt.date(2026, 4, 28) and rows[1]["local_date"] is None
    stats = marketplace.report_stats(tagged, ("market",)).first()
    assert (stats["filter_signal"], stats["rows_total"], stats["rows_matched"], stats["identity_missing"]) == ("sales_channel", 4, 2, 1)


def test_report_without_quantity_and_per_unit_price(spark, tmp_path):
    row = report(spark, tmp_path, ["sku", "item-price-per-unit", "ship-country"], ["CA-OG-NPO-35", "5.5", "CA"], ["CA-OG-NPO-35", "5.5", "US"]).orderBy("outcome").first()
    assert (row["outcome"], row["quantity"], float(row["total"]), row["price_per_unit"], row["filter_signal"]) == ("matched", 1, 5.5, True, "ship_country")


def test_report_with_quotes_in_titles(spark, tmp_path):
    tagged = report(
        spark, tmp_path, ["sku", "product-name", "quantity-shipped", "item-price", "ship-country"],
        ["CA-OG-NPO-35", '"Tin', "2", "5.5", "CA"], ["CA-OG-NPO-35", 'Tin 5" wide', "3", "1", "CA"], ["CA-OG-NPO-35", '"Tin"', "4", "1", "CA"])
    assert sorted(r["quantity"] for r in tagged.collect()) == [2, 3, 4]


def test_marketplace_csv_conventions(spark, tmp_path):
    titled = "Amazon Order Id,Shipment Item ID,Purchase Date,Merchant SKU,Title,Dispatched Quantity,Currency,Item Price,Delivery Price,Delivery Country Code\n"
    (tmp_path / "a.csv").write_text(titled + "O1,I1,2026-03-15T14:23:11+00:00,AU-X,Tin,2,AUD,10,5,AU\nO1,I2,2026-03-15T14:23:11+00:00,ZZ,Tin,1,,1,,\nO2,I3,2026-03-15T04:23:11Z,AU-X,Tin,1,NZD,1,,AU\n")
    (tmp_path / "b.txt").write_text("amazon-order-id\tpurchase-date\tsku\tquantity-shipped\tcurrency\titem-price\nO1\t2026-03-15T14:23:11Z\tAU-X\t9\tAUD\t99\nO3\t2026-03-01\tAU-Y\t1\tAUD\t7\n")
    first = (tmp_path / "b.txt").read_text().splitlines()[0]
    assert marketplace.sniff_delimiter(first) == "\t" and marketplace.sniff_delimiter(titled) == ","
    files = [parse.read_csv(spark, str(tmp_path / "a.csv")), parse.read_csv(spark, str(tmp_path / "b.txt"), sep="\t")]
    rows = marketplace.csv_rows(files)
    items = marketplace.csv_items(rows)
    assert sorted((r["order_id"], r["seller_sku"], r["quantity"]) for r in items.collect()) == [("O1", "AU-X", 2), ("O1", "AU-X", 9), ("O1", "ZZ", 1), ("O3", "AU-Y", 1)]
    orders = {r["order_id"]: r for r in marketplace.csv_orders(items).collect()}
    assert float(orders["O1"]["total"]) == 115.0 and orders["O1"]["local_date"] == dt.date(2026, 3, 16)
    stats = {(r["metric"], r["key"]): r["n"] for r in marketplace.csv_stats(rows, items).collect()}
    assert stats[("rows", "seen")] == 5 and stats[("reason", "non_aud_currency")] == 1 and stats[("reason", "duplicate_item_id")] == 0 and stats[("unmapped sku", "ZZ")] == 1
    with pytest.raises(ValueError, match="item_price"):
        marketplace.canonical_csv(files[1].drop("item-price"))


def test_erp_csv(spark, tmp_path):
    header = "Order Id,Order Ref,Company,First Name,Last Name,Channel,Created Date,Invoice Date,Fully Dispatched,Cancellation Date,Total Excl,Product Total,Item Code,Item Qty,Item Price,Item Name\n"
    (tmp_path / "e.csv").write_text(
        header + "1,R1,Coles,,,,5 Jan 2026 09:05 AM,07 Jan 2026,01 Jan 2030 01:00 PM,,100,100,AU-CTN-OG-NPO-48,2,50,Carton\n"
        "1,R1,Coles,,,,5 Jan 2026 09:05 AM,07 Jan 2026,01 Jan 2030 01:00 PM,,100,100,196,3,1,Fee\n"
        "2,R2,Some Stockist,,,Backend,05 Jan 2026,,,,10,10,AU-OG-NPO-35,4,2.5,Tin\n3,R3,Some Stockist,,,,05 Jan 2026,,,,10,10,AU-OG-NPO-35,4,2.5,Tin\n")
    orders, lines = erp.import_csv(parse.read_csv(spark, str(tmp_path), encoding="ISO-8859-1"), dt.datetime(2026, 2, 1))
    got = {r["id"]: (r["channel_attr"], r["status"], r["created_date"], r["modified_date"]) for r in orders.collect()}
    assert got == {
        1: ("col", "APPROVED", "2026-01-05T09:05:00Z", "2026-01-07T00:00:00Z"), 2: ("dist", "OPEN", "2026-01-05T00:00:00Z", "2026-01-05T00:00:00Z")}
    assert sorted((r["order_id"], r["base_sku"], float(r["tins"]), float(r["total"])) for r in lines.collect()) == [
        (1, "196", 0.0, 3.0), (1, "AU-OG-NPO-35", 96.0, 100.0), (2, "AU-OG-NPO-35", 4.0, 10.0)]


def test_3pl_page_shapes(spark):
    item = {"sku": " CA-1 ", "name": "n", "quantity": "5.5", "quantity_reserved": 2, "category": {"name": "Finished"}}
    flat = {**item, "sku": "CA-2", "category": "Packaging"}
    pages = [{"items": [[{"Item": item}], [{"Item": flat}]]}, {"items": [flat]}, [{"Item": item}, flat]]
    rows = stock.land_3pl_items(spark.createDataFrame([(json.dumps(p),) for p in pages], "value string"))
    assert sorted((r["sku"], float(r["quantity"]), r["category"]) for r in rows.collect()) == sorted(
        [("CA-1", 5.5, "Finished")] * 2 + [("CA-2", 5.5, "Packaging")] * 3)
    assert {(r["sku"], float(r["quantity"])) for r in stock.threepl_inventory(rows).collect()} == {("CA-1", 3.5)}


def test_upload_validation(spark):
    def verdict(rows, cap=None):
        return stock.validate_upload(spark.createDataFrame(rows, "sku string"), cap).first()["verdict"]

    assert [verdict([]), verdict([("a",), ("b",)], 1), verdict([("a",), (" ",)]), verdict([("a",)])] == ["inventory is empty", "inventory too large", "blank sku", "ok"]
    assert verdict([("a",), (" ",)], 1) == "inventory too large; blank sku"
    with pytest.raises(ValueError, match="blank sku"):
        stock.accept_upload(spark.createDataFrame([(None,)], "sku string"), "2026-01-01T00:00:00Z")
    assert stock.accept_upload(spark.createDataFrame([("a",)], "sku string"), "2026-01-01T00:00:00Z").first()["count"] == 1


def test_fba_real_zero(spark):
    docs = [
        {"sellerSku": "CA-OG-NPO-35", "totalQuantity": 9, "inventoryDetails": {"fulfillableQuantity": 0, "inboundWorkingQuantity": 4}},
        {"sellerSku": "X", "totalQuantity": 9}, {"totalQuantity": 1, "inventoryDetails": {}}]
    raw = parse.from_text(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"), marketplace.FBA_SCHEMA)
    rows = marketplace.fba_inventory(raw)
    assert sorted((r["seller_sku"], r["fulfillable"], r["inbound"]) for r in rows.collect()) == [("", 0, 0), ("CA-OG-NPO-35", 0, 4), ("X", 9, 0)]
    assert tuple(marketplace.fba_match_counts(rows).first()) == (3, 1, 1)


def test_month_snapshot_file(spark, tmp_path):
    body = {"months": ["2026-04"], "salesByMonth": {"2026-04": {"woo": {"units": 2.0, "tins": 3.0, "revenue": 4.5, "orders": 1}, "refunds": {"tins": -1, "revenue": -2, "orders": 1, "sku_lines": {}}}},
            "skuSalesByMonth": {"2026-04": [{"sku": "AU-X", "name": "x", "woo": 1.0, "total_tins": 3.0, "revenue": 4.5}]}}
    (tmp_path / "data.js").write_text("// generated // by a job\n// again\nwindow.DATA = " + json.dumps(body, indent=2) + ";\n")
    rows = stock.month_snapshot(spark.read.text(str(tmp_path), wholetext=True)).collect()
    assert sorted((r["section"], r["key"], r["tins"], r["orders"]) for r in rows) == [("channel", "refunds", -1.0, 1), ("channel", "woo", 3.0, 1), ("sku", "AU-X", 3.0, None)]
