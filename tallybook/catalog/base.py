"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.testviews import VIEWS, Inputs, names_in, view_sql

# Parameters of the registered runs; jobs never read the clock.
AS_OF = dt.date(2001, 6, 30)
NOW = dt.datetime(2024, 1, 30, 12, 0, 0)
MONTHS = 6
CUTOVER = "2001-03"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Views only the checking SQL uses: its own statement of shared rules.
SQL_VIEWS: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result columns as text, bigint, double or boolean, so engines compare."""
    picked = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        picked.append(col.alias(field.name))
    return df.select(*picked)


def query(key: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under a key, with its checking SQL."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(Inputs(spark, sf_dir)))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_views(sql)
        return fn

    return register


def with_views(body: str) -> str:
    """Put the views a statement names in front of it, in dependency order."""
    known = dict(SQL_VIEWS)
    known.update({name: view_sql(name) for name in VIEWS if name not in known})
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(text, known):
            if name not in ordered:
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({known[name]})" for name in ordered)
    text = body.strip()
    if not ctes:
        return text
    if text[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"


# --- pieces of checking SQL shared by several keys (DuckDB dialect) ---------

def sql_base(c: str) -> str:
    s = f"trim(coalesce({c}, ''))"
    return (
        f"CASE WHEN {s} = '' THEN NULL"
        f" WHEN regexp_matches({s}, '^WC-AU-.') THEN regexp_replace(substr({s}, 4), '-(NL|WC)$', '')"
        f" WHEN regexp_matches({s}, '^AU-CTN-.+-48$') THEN 'AU-' || substr({s}, 8, length({s}) - 10) || '-35'"
        f" WHEN {s} LIKE 'AU-CTN-SRT-MIX-%' THEN {s}"
        f" WHEN regexp_matches({s}, '^AU-SRT-.+x12$') THEN 'AU-' || rtrim(substr({s}, 8, length({s}) - 10), '-')"
        f" WHEN regexp_matches({s}, '^AU-.+M$') THEN substr({s}, 1, length({s}) - 1)"
        f" ELSE {s} END"
    )


def sql_pack(c: str) -> str:
    s = f"trim(coalesce({c}, ''))"
    return (
        f"CASE WHEN regexp_matches({s}, '^WC-AU-.') THEN 54"
        f" WHEN regexp_matches({s}, '^AU-CTN-.+-48$') THEN 48"
        f" WHEN {s} LIKE 'AU-CTN-SRT-MIX-%' THEN 72"
        f" WHEN regexp_matches({s}, '^AU-SRT-.+x12$') THEN 12 ELSE 1 END"
    )


def sql_regional(c: str) -> str:
    s = f"upper(trim(coalesce({c}, '')))"
    return f"({s} LIKE 'AU-%' OR {s} LIKE 'WC-AU-%' OR {s} LIKE 'D-AU-%')"


# The six aliases and self-names the test data can hold, of the full table.
SQL_ALIAS = (
    "CASE trim(seller_sku) WHEN 'V9-2U5C-RGSU' THEN 'CA-CL-VLB-35' WHEN 'US-OG-NPO-35' THEN 'CA-OG-NPO-35'"
    " WHEN 'CA-OG-NPO-85' THEN 'CA-OG-NPO-85' WHEN 'HP-G88K-NR69' THEN 'CA-FF-VLB-35' END"
)
SQL_ALIAS_AU = "CASE WHEN trim(seller_sku) LIKE 'AU-%' THEN trim(seller_sku) END"

SQL_CHANNEL = """CASE
 WHEN trim(channel) = 'Cloud' THEN 'refund'
 WHEN company = 'Stock Adjustments' THEN NULL
 WHEN regexp_full_match(reference, '[0-9]{3}-[0-9]{7}-[0-9]{7}') THEN 'amz'
 WHEN lower(company) LIKE '%woolworths%' THEN 'woo2'
 WHEN lower(company) IN ('coles', 'kemps creek') OR lower(company) LIKE '%grocery holdings%' THEN 'col'
 WHEN lower(company) LIKE 'amazon seller%' THEN 'amz'
 WHEN lower(company) LIKE 'amazon%' OR company IN ('', '[Redacted]') THEN NULL
 WHEN lower(company) IN ('mr', 'mrs', 'ms', 'private') THEN NULL
 WHEN (lower(company) LIKE '%momentum foods%' OR lower(company) LIKE '%avo trading%')
  AND NOT regexp_full_match(reference, '[0-9]+') THEN 'dist'
 END"""

SQL_VIEWS.update({
    "s_erp_orders": f"""SELECT *, {SQL_CHANNEL} AS attr, substr(created_date, 1, 7) AS ym FROM f_erp_orders""",
    "s_erp_lines": f"""SELECT order_id, parent_id, trim(code) AS code, {sql_base('code')} AS base_sku,
 {sql_pack('code')} AS mult, {sql_regional('code')} AS is_au, uom_size, qty,
 CAST(coalesce(total, qty * unit_price) AS DECIMAL(18,2)) AS total, name,
 CAST(CASE WHEN uom_size > 1 THEN qty ELSE qty * {sql_pack('code')} END AS DECIMAL(18,4)) AS tins
 FROM f_erp_lines""",
    "s_credit_lines": f"""SELECT credit_note_id, status, substr(created_date, 1, 7) AS ym, parent_id, {sql_base('code')} AS base_sku,
 {sql_regional('code')} AS is_au,
 CAST(CASE WHEN {sql_regional('code')} THEN -abs(CASE WHEN uom_size > 1 THEN qty ELSE qty * {sql_pack('code')} END) ELSE 0 END AS DECIMAL(18,4)) AS tins,
 -abs(total) AS revenue FROM f_credit_lines""",
    "s_mkt_items": f"""SELECT *, {SQL_ALIAS} AS dashboard_sku,
 CAST(timezone('America/Toronto', timezone('UTC', CAST(left(date_created, 19) AS TIMESTAMP))) AS DATE) AS local_date FROM f_mkt_items""",
    "s_mkt_orders": """SELECT *, CAST(timezone('America/Toronto', timezone('UTC', CAST(left(purchase_date, 19) AS TIMESTAMP))) AS DATE) AS local_date FROM f_mkt_orders""",
})
