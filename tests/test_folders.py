"""Folders of exports, number texts and rejects."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybook.catalog import folders as queries
from tallybook.sources import folders, marketplace, parse

TITLED = "Amazon Order Id,Purchase Date,Merchant SKU,Title,Dispatched Quantity,Item Price,Currency"
HYPHENED = "\t".join(("currency", "amazon-order-id", "purchase-date", "sku", "quantity-shipped", "item-price", "ship-country"))


def export(folder, n, header=TITLED, sep=","):
    rows = [[f"o{n}-{i}", "2026-03-15T04:23:11+00:00", "AU-A-35", 'a "tin",\nof two lines', "2", "1.50", "AUD"] for i in range(3)]
    if sep == "\t":
        rows = [["AUD", r[0], r[1], r[2], r[4], r[5], "AU"] for r in rows]
    body = [sep.join('"' + c.replace('"', '""') + '"' if sep == "," else c for c in r) for r in rows]
    return "\n".join([header, *body]) + "\n"


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode())


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_a_mixed_folder(spark, tmp_path):
    write(tmp_path / "in", "1 a+b%20[x].csv", "﻿" + export(tmp_path, 1))
    write(tmp_path / "in/deep", "2.TXT", export(tmp_path, 2, HYPHENED, "\t"))
    write(tmp_path / "in", "3.csv", "some,other\n1,2\n")
    write(tmp_path / "in", "4.tsv", "\n")
    write(tmp_path / "in", "5.csv", "")
    write(tmp_path / "in", ".hidden.csv", export(tmp_path, 5))
    write(tmp_path / "in", "readme.md", export(tmp_path, 6))
    frames, files = marketplace.read_export_folder(spark, str(tmp_path / "in"))
    missing = {r["file"].rsplit("/", 1)[1]: r["missing"] for r in files.collect()}
    assert {k: len(v) for k, v in missing.items()} == {"1 a+b%20[x].csv": 0, "2.TXT": 0, "3.csv": 6, "4.tsv": 6}
    rows = marketplace.csv_rows(frames).collect()
    assert sorted(r["order_id"] for r in rows) == [f"o{n}-{i}" for n in (1, 2) for i in range(3)]
    assert {r["name"] for r in rows if r["order_id"].startswith("o1")} == {'a "tin",\nof two lines'}
    assert {(r["quantity"], float(r["item_price"]), str(r["local_date"]), r["reason"]) for r in rows} == {(2, 1.5, "2026-03-15", "candidate")}


def test_many_files_are_one_scan_a_kind(spark, tmp_path):
    plans = []
    for count in (6, 60):
        for n in range(count):
            tab = n % 2
            write(tmp_path / str(count), f"{n:03}.csv", export(tmp_path, n, HYPHENED if tab else TITLED, "\t" if tab else ","))
        rows = marketplace.csv_rows(marketplace.read_export_folder(spark, str(tmp_path / str(count)))[0])
        assert rows.count() == 3 * count
        plans.append(scans(rows))
    assert plans == [2, 2]


def test_the_first_file_wins_among_repeats(spark, tmp_path):
    write(tmp_path / "in", "b.csv", TITLED + "\no1,2026-01-01,AU-X,t,7,9,AUD\n")
    write(tmp_path / "in", "a.csv", TITLED + "\no1,2026-01-01,AU-X,t,5,9,AUD\no1,2026-01-01,AU-X,t,6,9,AUD\n")
    frames, _ = marketplace.read_export_folder(spark, str(tmp_path / "in"))
    assert [r["quantity"] for r in marketplace.csv_items(marketplace.csv_rows(frames)).collect()] == [5]


@pytest.mark.parametrize("text, money, whole", [
    ("12", "12.00", 12), (" 3.7 ", "3.70", 3), ("-2.5", "-2.50", -2), ("1,234.50", "0.00", 0), ("12abc", "0.00", 0), ("", "0.00", 0), (None, "0.00", 0), ("1e2", "100.00", 100),
    (".5", "0.50", 0), ("5.", "5.00", 5), ("1f", "0.00", 0), ("NaN", "0.00", 0), ("--1", "0.00", 0),
])
def test_strict_numbers(spark, text, money, whole):
    row = spark.createDataFrame([(text,)], "t string").select(parse.strict(F.col("t")).alias("m"), parse.strict_whole(F.col("t")).alias("w")).first()
    assert (str(row["m"]), row["w"]) == (money, whole)


def test_rejects_keep_the_raw_text(spark):
    raw = ['{"id": 1, "n": "a"}', '{"id": 2, "n": ', '{"n": "no id"}', "", None, '{"id": "x"}', "[1]", '{"id": 3}']
    frame = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(raw)], "file string, value string")
    good, rejects = parse.with_rejects(frame, "id long, n string")
    assert sorted((r["file"], r["id"], r["n"]) for r in good.collect()) == [("f0", 1, "a"), ("f7", 3, None)]
    assert sorted((r["file"], r["reason"], r["raw"]) for r in rejects.collect()) == [
        (f"f{i}", "no key" if i == 2 else "broken", raw[i]) for i in (1, 2, 3, 4, 5, 6)]
    assert good.columns == ["file", "id", "n"] and folders.NAMES


class Given:
    """Inputs of given rows in place of the test tables."""

    def __init__(self, spark, **frames):
        self.spark, self.frames = spark, frames

    def __call__(self, name):
        return self.frames[name]


@pytest.fixture()
def export_inputs(spark):
    n = F.col("id")
    rows = spark.range(4000).select(
        (n % 2).alias("file_no"), F.lpad(n.cast("string"), 5, "0").alias("sort_text"), n.cast("string").alias("order_id"), F.concat(F.lit("i"), (n % 1000).cast("string")).alias("item_id"),
        F.lit("2026-03-15").cast("date").alias("day"), F.lit(4).alias("hour"), F.lit(False).alias("bad_date"), F.lit("AU-A-35").alias("sku"), (n % 9).alias("quantity"),
        F.lit("AUD").alias("currency"), F.lit("AU").alias("country"), F.lit("1.50").cast("decimal(18,2)").alias("item_price"), F.lit(0).cast("decimal(18,2)").alias("shipping"))
    # Without coalescing, small ranges stay apart as large ones do.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield Given(spark, x_mkt_csv=rows, part=spark.range(10).select(F.col("id").alias("p_partkey")))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_export_of_many_parts(spark, export_inputs):
    path = queries._export_folder(export_inputs)
    frames, files = marketplace.read_export_folder(spark, path)
    parts = files.groupBy(F.element_at(F.split("file", "/"), -2).alias("folder")).count().collect()
    assert {r["folder"]: r["count"] for r in parts if r["folder"] < "c"} == {"a-titled": 8, "b-hyphened": 8}
    items = marketplace.csv_items(marketplace.csv_rows(frames)).select(F.col("order_id").cast("int").alias("o")).collect()
    # The first of each item's four rows, by file and row over all parts.
    assert sorted(r["o"] for r in items) == list(range(1000))
    got = queries.export_folder_files(export_inputs).collect()
    assert sorted((r["folder"], r["delimiter"], r["missing"]) for r in got) == [
        ("a-titled", ",", ""), ("b-hyphened", "\t", ""), ("c-other", ",", "order_id,purchase_date,quantity,item_price,currency"),
        ("d-empty", None, "order_id,purchase_date,sku,quantity,item_price,currency")]


def test_documents_are_parsed_once(spark):
    raw = spark.createDataFrame([('{"id": 1, "n": "a"}',), (None,), ("{",)], "value string")
    read = parse.from_text(raw.repartition(2), "id long, n string")
    some = read.filter((F.col("id") > 0) & (F.lower("n") == "a"))
    good, rejects = parse.with_rejects(raw.repartition(2), "id long, n string")
    for frame in (some, good, rejects):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert read.count() == 3 and [tuple(r) for r in some.collect()] == [(1, "a")]
    assert [tuple(r) for r in good.collect()] == [(1, "a")] and rejects.count() == 2
