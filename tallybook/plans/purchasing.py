"""Purchase orders: what is open, what it holds, how long suppliers take."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import calendar, codes
from tallybook.functions.fixed import CLOSED_PO_STATUSES, PACKAGING_FAMILIES

# Expected-date fields, most specific first.
DATE_FIELDS = ("delivery_date", "estimated_delivery_date", "estimated_arrival_date", "supplier_acceptance_date")
CLASSES = ("finished", "soap", "raw_tin", "packaging", "carton_tray", "fees", "other")
_HEADER = ("reference", "company", "created_date", "status", "fully_received_date", "completed_date", "cancellation_date", "is_void")


def with_header(lines: DataFrame) -> DataFrame:
    """Add the header fields a source may lack, as nulls."""
    kinds = {"is_void": "boolean"}
    wanted = [*_HEADER, *DATE_FIELDS]
    missing = {c: F.lit(None).cast(kinds.get(c, "date")) for c in wanted if c not in lines.columns}
    return lines.withColumns(missing) if missing else lines


def po_headers(lines: DataFrame) -> DataFrame:
    """One row per PO with its received flag; the header repeats on each line.

    A PO is received when it has a positive line and every such line is in.
    """
    positive = F.col("qty") > 0
    late = F.col("qty_received") + F.lit(0.001) < F.col("qty")
    return with_header(lines).groupBy(*_HEADER, *DATE_FIELDS).agg(
        F.count("*").alias("line_count"), F.count_if(positive).alias("_positive"), F.count_if(positive & late).alias("_late"),
    ).withColumn("received_by_lines", (F.col("_positive") > 0) & (F.col("_late") == 0)).drop("_positive", "_late")


def status_closed() -> Column:
    return F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*CLOSED_PO_STATUSES)


def is_open() -> Column:
    """Open by every closure signal; reads the columns of po_headers."""
    closed = (
        F.coalesce("is_void", F.lit(False)) | F.col("completed_date").isNotNull() | F.col("fully_received_date").isNotNull()
        | F.col("cancellation_date").isNotNull() | status_closed() | F.col("received_by_lines")
    )
    return ~closed


def open_pos(lines: DataFrame) -> DataFrame:
    return po_headers(lines).filter(is_open())


def expected_date() -> Column:
    return F.coalesce(*DATE_FIELDS)


def po_rollup(lines: DataFrame, open_only: bool = False) -> DataFrame:
    """Per PO: quantity by line class, type, primary units, SKU count, expected date.

    Lines fold to one row per PO and code first, which makes the distinct SKU
    count a plain count in the second step.
    """
    heads = po_headers(lines)
    if open_only:
        heads = heads.filter(is_open())
    code = codes.clean(F.col("code"))
    cls = codes.po_line_class(F.col("code"))
    per_code = lines.groupBy("reference", code.alias("code")).agg(F.sum("qty").alias("qty")).withColumn("cls", cls)
    buckets = per_code.groupBy("reference").agg(
        *[F.sum(F.when(F.col("cls") == c, F.col("qty")).otherwise(0)).alias(c) for c in CLASSES],
        F.count_if((F.col("code") != "") & (F.col("cls") != "fees")).alias("sku_count"))
    b = {c: F.col(c) for c in CLASSES}
    kind = (
        F.when(b["finished"] > 0, "finished").when(b["soap"] > 0, "soap").when(b["raw_tin"] > b["packaging"], "tins")
        .when(b["packaging"] > 0, "packaging").when(b["carton_tray"] > 0, "finished").otherwise("other")
    )
    filled = b["finished"] + b["carton_tray"]
    everything = filled + b["soap"] + b["raw_tin"] + b["packaging"] + b["other"]
    typed = heads.join(buckets, "reference").withColumn("type", kind)
    t = F.col("type")
    units = (
        F.when(t == "finished", filled).when(t == "soap", b["soap"]).when(t == "tins", b["raw_tin"])
        .when(t == "packaging", b["packaging"]).otherwise(everything)
    )
    source = F.coalesce(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in DATE_FIELDS])
    return typed.select(
        F.col("reference").alias("po"), "company", "created_date", expected_date().alias("expected_date"),
        source.alias("expected_date_source"), "status", "fully_received_date", "line_count", "sku_count",
        filled.alias("finished_units"), b["soap"].alias("soap_units"), b["raw_tin"].alias("raw_tin_units"),
        b["packaging"].alias("packaging_units"), b["fees"].alias("fee_lines"),
        units.alias("total_units"), "type",
    )


def lead_samples(lines: DataFrame, as_of: dt.date, months_back: int = 18, newest: int = 10) -> DataFrame:
    """Newest created-to-received samples per supplier.

    The rank limit runs in every task before the shuffle, so a supplier with
    most of the POs sends only its newest few from each.
    """
    cutoff = as_of - dt.timedelta(days=int(months_back * 30.44))
    heads = with_header(lines).filter(F.col("fully_received_date") >= F.lit(cutoff)).select(
        "reference", F.trim("company").alias("company"), "created_date", "fully_received_date").distinct()
    days = F.datediff("fully_received_date", "created_date")
    rows = heads.withColumn("days", days).filter(F.col("days").between(0, 365) & (F.col("company") != ""))
    order = Window.partitionBy("company").orderBy(F.col("fully_received_date").desc(), F.col("reference").desc())
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= newest)


def lead_times(samples: DataFrame) -> DataFrame:
    """Observed lead time per supplier, and again per packaging family.

    The median of an even count rounds half up.
    """
    per = samples.groupBy("company").agg(
        F.floor(F.median("days") + 0.5).alias("median_days"), F.min("days").alias("min_days"), F.max("days").alias("max_days"),
        F.count("*").alias("samples"),
        F.min_by(F.struct("reference", "days"), "rn").alias("latest"), F.max("fully_received_date").alias("last_received"))
    hits = [F.when(F.col("company").rlike(pattern), F.lit(f"family:{family}")) for family, pattern in PACKAGING_FAMILIES]
    keyed = per.withColumn("key", F.explode(F.array_compact(F.array(F.col("company"), F.coalesce(*hits)))))
    fields = ("company", "median_days", "min_days", "max_days", "samples", "latest")
    best = F.max_by(F.struct(*fields), F.struct("last_received", "company")).alias("b")
    return keyed.groupBy("key").agg(best).select(
        "key", F.col("b.company").alias("supplier"), "b.median_days", "b.min_days", "b.max_days", "b.samples",
        F.col("b.latest.reference").alias("latest_ref"), F.col("b.latest.days").alias("latest_days"))


def incoming_units(lines: DataFrame) -> DataFrame:
    """Finished units on open POs per base code and PO; packs count their tins."""
    code = codes.clean(F.col("code"))
    pack = code.startswith("AU-CTN-") | code.startswith("AU-SRT-")
    base = F.when(pack, codes.base_code(code)).otherwise(code)
    tins = F.when(pack, F.col("qty") * codes.pack_size(code)).otherwise(F.col("qty"))
    opened = open_pos(lines).select("reference", expected_date().alias("expected_date"))
    per_po = lines.filter(code.startswith("AU-")).groupBy("reference", base.alias("base")).agg(F.sum(tins).alias("qty"))
    return per_po.join(opened, "reference")


def _incoming_totals(units: DataFrame) -> DataFrame:
    # The earliest date, and of POs of one date the newest reference.
    dated = F.when(F.col("expected_date").isNotNull(), F.struct((-F.unix_date("expected_date")).alias("soon"), "reference", "expected_date"))
    total = units.groupBy("base").agg(F.sum("qty").alias("qty"), F.count("*").alias("pos"), F.max(dated).alias("next"))
    return total.select("base", "qty", "pos", F.col("next.expected_date").alias("next_date"), F.col("next.reference").alias("next_ref"))


def incoming_by_sku(units: DataFrame) -> DataFrame:
    """Every open PO of a base code with its date and units, next to the code's units, PO count and earliest dated PO."""
    per_po = units.select("base", "reference", "expected_date", F.col("qty").alias("po_qty"))
    return per_po.join(_incoming_totals(units), "base")


def incoming_shown(units: DataFrame, listed: int = 3) -> DataFrame:
    """One row per base code, as the risk report shows it: units, PO count, the earliest dated PO, and the first few refs."""
    order = Window.partitionBy("base").orderBy(F.col("reference").desc())
    shown = units.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= listed).groupBy("base").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "reference"))), lambda s: s["reference"]), ",").alias("refs"))
    return _incoming_totals(units).join(shown, "base")


def closure_profile(lines: DataFrame) -> DataFrame:
    """Counts per closure signal, old against new open rule, date coverage of open POs."""
    heads = po_headers(lines)
    opened = is_open()
    old_open = ~(F.col("completed_date").isNotNull() | status_closed())
    measures = {
        "total": F.lit(True),
        "completed_date_set": F.col("completed_date").isNotNull(),
        "fully_received_date_set": F.col("fully_received_date").isNotNull(),
        "cancellation_date_set": F.col("cancellation_date").isNotNull(),
        "is_void_true": F.coalesce("is_void", F.lit(False)),
        "fully_received_by_lines": F.col("received_by_lines"),
        "open_by_old_rule": old_open,
        "open_by_new_rule": opened,
        **{f"open_{f}_set": opened & F.col(f).isNotNull() for f in DATE_FIELDS},
        "open_no_date": opened & expected_date().isNull(),
    }
    counts = heads.agg(*[F.count_if(c).alias(n) for n, c in measures.items()])
    with_delta = counts.withColumn("open_delta", F.col("open_by_old_rule") - F.col("open_by_new_rule"))
    signals = with_delta.unpivot([], [*measures, "open_delta"], "measure", "n")
    statuses = heads.groupBy(F.concat(F.lit("status "), F.coalesce("status", F.lit(""))).alias("measure")).agg(F.count("*").alias("n"))
    return signals.unionByName(statuses)


def closed_but_approved(lines: DataFrame, limit: int) -> DataFrame:
    """Approved POs the open rule drops, oldest first; the cap is the sample size."""
    return (
        po_headers(lines).filter((F.lower("status") == "approved") & ~is_open())
        .orderBy("created_date", "reference").limit(limit)
    )


def schedule_match(schedule: DataFrame, lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Supplier schedule rows against POs: new fill date, current date, what to do.

    ``schedule`` has cust_po, fill_text and due_text (d/m/y).
    """
    digits = F.regexp_replace(F.coalesce("cust_po", F.lit("")), "[^0-9]", "")
    parts = F.split(F.regexp_extract(F.trim("due_text"), r"^(\d{1,2}/\d{1,2}/\d{2,4})", 1), "/")
    year = F.get(parts, F.lit(2))
    due = F.when(
        F.size(parts) == 3,
        F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year),
                    F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0")))
    rows = schedule.withColumns({
        "ref": F.when(digits != "", F.concat(F.lit("PO-"), digits)),
        "dates": calendar.fill_dates(F.col("fill_text"), as_of), "due": due.try_cast("date")})
    heads = with_header(lines).groupBy(F.upper("reference").alias("ref")).agg(
        F.max("estimated_delivery_date").alias("current_etd"), F.lit(True).alias("found"))
    joined = rows.join(heads, "ref", "left").withColumn("new_etd", F.array_min("dates"))
    change = (
        F.when(F.col("found").isNull(), "nomatch").when(F.col("new_etd").isNull(), "baddate")
        .when(F.col("new_etd").eqNullSafe(F.col("current_etd")), "same").otherwise("change")
    )
    return joined.select(
        *schedule.columns, "ref", "current_etd", "new_etd", change.alias("change"),
        F.coalesce(F.size("dates") > 1, F.lit(False)).alias("several_dates"),
        F.coalesce(F.col("new_etd") > F.col("due"), F.lit(False)).alias("after_due"))
