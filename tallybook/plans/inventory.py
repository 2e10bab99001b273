"""Stock per SKU and the inventory report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import codes
from tallybook.functions.fixed import TINS_PER_CARTON


def is_fba(branch: Column) -> Column:
    return F.coalesce(branch.rlike(r"(?i)amazon\s*fba"), F.lit(False))


def stock_by_branch(rows: DataFrame) -> DataFrame:
    """Stock rows summed per code and branch; a blank branch is 'Unknown'."""
    named = "product_name" in rows.columns
    branch = F.trim(F.coalesce(F.nullif("branch_name", F.lit("")), F.lit("Unknown")))
    held = (F.col("stock_on_hand") != 0) | (F.col("incoming") != 0)
    clean = rows.select(
        codes.clean(F.col("code")).alias("code"), branch.alias("branch"),
        F.coalesce("stock_on_hand", F.lit(0)).alias("stock_on_hand"), F.coalesce("available", F.lit(0)).alias("available"),
        F.coalesce("incoming", F.lit(0)).alias("incoming"),
        (F.nullif("product_name", F.lit("")) if named else F.lit(None).cast("string")).alias("product_name"),
    ).filter(F.col("code") != "")
    return clean.groupBy("code", "branch").agg(
        F.sum("stock_on_hand").alias("soh"), F.sum("available").alias("avail"), F.sum("incoming").alias("incoming"),
        F.coalesce(F.max(held), F.lit(False)).alias("held"), F.min("product_name").alias("name"))


def stock_by_sku(rows: DataFrame) -> DataFrame:
    """One row per code: totals over all branches, the FBA part, and a branch map.

    Branches are summed first, so the map collects one entry per branch.
    """
    fba = is_fba(F.col("branch"))

    def part(c: str) -> Column:
        return F.coalesce(F.sum(F.when(fba, F.col(c))), F.lit(0))

    entry = F.when(F.col("held"), F.struct("branch", F.struct("soh", "incoming")))
    return stock_by_branch(rows).groupBy("code").agg(
        F.coalesce(F.min("name"), F.lit("")).alias("name"),
        F.sum("soh").alias("soh"), F.sum("avail").alias("avail"), F.sum("incoming").alias("incoming"),
        part("soh").alias("fba_soh"), part("avail").alias("fba_avail"), part("incoming").alias("fba_incoming"),
        F.map_from_entries(F.collect_list(entry)).alias("branches"))


def latest_meta(products: DataFrame, order: str = "part_id") -> DataFrame:
    """Category per code; the last write wins."""
    return products.groupBy("code").agg(F.max_by(F.coalesce("category", F.lit("")), order).alias("category"))


def with_meta(stock: DataFrame, meta: DataFrame) -> DataFrame:
    return stock.join(meta.select("code", "category"), "code", "left").withColumn("category", F.coalesce("category", F.lit("")))


def lookup_code_or_base(lines: DataFrame, stock: DataFrame, value: str) -> DataFrame:
    """Add code_<value>, base_<value> and <value>: exact code first, then base code.

    A stock frame has one row per code, so neither join multiplies lines.
    """
    by_code = stock.select(F.col("code").alias("_code"), F.col(value).alias(f"code_{value}"))
    by_base = stock.select(F.col("code").alias("_base"), F.col(value).alias(f"base_{value}"))
    return (
        lines.join(by_code, F.col("code") == F.col("_code"), "left")
        .join(by_base, F.col("base_sku") == F.col("_base"), "left")
        .drop("_code", "_base")
        .withColumn(value, F.coalesce(f"code_{value}", f"base_{value}"))
    )


def empty_tins(stock: DataFrame) -> DataFrame:
    """Unfilled tin stock on the finished SKU the tins belong to."""
    finished = F.substring("code", 3, 1 << 20)
    keep = F.col("code").rlike(r"^T-AU-(?!BLANK).*-(35|85)$")
    return stock.filter(keep).groupBy(finished.alias("sku")).agg(F.sum("soh").alias("soh"), F.sum("incoming").alias("incoming"))


def inventory(stock: DataFrame, meta: DataFrame) -> DataFrame:
    """Sellable stock per code: trays folded into their tin, FBA split out.

    Trays sit in the warehouse only, so they add to the total and the warehouse
    figure of their base code, when that code is in stock at all.
    """
    code = F.col("code")
    trays = stock.filter(code.startswith("AU-SRT-")).groupBy(codes.base_code(code).alias("base")).agg(
        F.sum((F.col("soh") - F.col("fba_soh")) * codes.pack_size(code)).alias("tray_soh"),
        F.sum((F.col("avail") - F.col("fba_avail")) * codes.pack_size(code)).alias("tray_avail"))
    listed = code.rlike(r"^AU-(?!BAG|SRT-|CTN-SRT-)(?!.*CANVAS)")
    soap = codes.is_soap(code)
    sellable = soap | F.col("category").isin("", "Finished Products", "Bicarb Based")
    kind = (
        F.when(soap, "soap").when(code.startswith("AU-CTN-"), "carton").when(code.startswith("AU-B-"), "base-b").otherwise("base")
    )
    rows = with_meta(stock.filter(listed), meta).filter(sellable)
    folded = rows.join(trays, rows["code"] == trays["base"], "left").drop("base")
    zero = F.lit(0)
    total_soh = F.col("soh") + F.coalesce("tray_soh", zero)
    total_avail = F.col("avail") + F.coalesce("tray_avail", zero)
    return folded.select(
        code.alias("sku"), "name", "category", kind.alias("kind"),
        F.when(kind == "carton", TINS_PER_CARTON).otherwise(1).alias("mult"),
        total_soh.alias("soh"), total_avail.alias("avail"), "incoming",
        (total_soh - F.col("fba_soh")).alias("warehouse_soh"),
        (total_avail - F.col("fba_avail")).alias("warehouse_avail"),
        (F.col("incoming") - F.col("fba_incoming")).alias("warehouse_incoming"),
        F.col("fba_soh").alias("fba"), codes.is_discontinued(code).alias("discontinued"),
    )


def inventory_order() -> list:
    """Discontinued codes last, then the largest stock first."""
    return ["discontinued", F.col("warehouse_soh").desc(), "sku"]


def inventory_sorted(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*inventory_order())


def base_stock(rows: DataFrame) -> DataFrame:
    """Tins per base code: loose in the warehouse, at FBA, and inside cartons."""
    sku, kind, held = F.col("sku"), F.col("kind"), F.col("warehouse_soh")
    pattern = r"^AU-CTN-(.+)-48$"
    carton = (kind == "carton") & sku.rlike(pattern)
    base = F.when(carton, F.concat(F.lit("AU-"), F.regexp_extract(sku, pattern, 1), F.lit("-35"))).otherwise(sku)
    loose = kind.isin("base", "base-b")
    return (
        rows.filter(~F.col("discontinued") & (carton | loose)).groupBy(base.alias("base"))
        .agg(
            F.sum(F.when(loose, held).otherwise(0)).alias("loose"),
            F.sum(F.when(loose, F.col("fba")).otherwise(0)).alias("fba"),
            F.sum(F.when(carton, held * TINS_PER_CARTON).otherwise(0)).alias("from_cartons"),
            F.sum(F.when(carton & (held > 0), held).otherwise(0)).alias("carton_count"))
    )


def code_probe(rows: DataFrame, fields: tuple[str, ...], code: str | None = None) -> DataFrame:
    """Per code: every non-zero numeric field summed, and every branch split.

    With ``code`` only that code is probed, whatever its case.
    """
    clean = rows.withColumn("code", codes.clean(F.col("code"))).filter(F.col("code") != "")
    if code is not None:
        clean = clean.filter(F.upper("code") == code.strip().upper())
    totals = clean.groupBy("code").agg(*[F.sum(f).alias(f) for f in fields])
    long = totals.unpivot(["code"], list(fields), "part", "value").withColumn("kind", F.lit("field"))
    branches = stock_by_branch(clean).filter("held").unpivot(["code", "branch"], ["soh", "incoming"], "measure", "value")
    split = branches.select("code", F.concat_ws(" ", "branch", "measure").alias("part"), "value", F.lit("branch").alias("kind"))
    return long.filter(F.col("value") != 0).unionByName(split)
