"""Input views over the test tables.

Each view binds one input schema of the library to the read-only test tables.
Every expression is accepted by Spark SQL and by DuckDB, so one definition
feeds both the job and the SQL it is checked against.  A view is
``name: (source, ((column, expression), ...))``; a source may name other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import prepare

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

VIEWS: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "f_sku": (
        "part",
        (
            ("part_id", "p_partkey"),
            ("scent", "CASE p_partkey % 5 WHEN 0 THEN 'OG' WHEN 1 THEN 'CL' WHEN 2 THEN 'LL' WHEN 3 THEN 'SC' ELSE 'EF' END"),
            ("form", "CASE p_partkey % 3 WHEN 0 THEN 'NPO' WHEN 1 THEN 'BCF' ELSE 'VLB' END"),
            ("shape", "p_partkey % 17"),
            ("name", "p_name"),
        ),
    ),
    "f_code": (
        "f_sku",
        (
            ("part_id", "part_id"),
            ("code", "CASE shape WHEN 0 THEN 'WC-AU-'||scent||'-'||form||'-35-NL' WHEN 1 THEN 'AU-CTN-'||scent||'-'||form||'-48' WHEN 2 THEN 'AU-CTN-SRT-MIX-72-V3' WHEN 3 THEN 'AU-SRT-'||scent||'-'||form||'-35x12' WHEN 4 THEN 'AU-'||scent||'-'||form||'-35M' WHEN 5 THEN 'AU-'||scent||'-'||form||'-85' WHEN 6 THEN 'D-AU-'||scent||'-'||form||'-35' WHEN 7 THEN '196' WHEN 8 THEN '' WHEN 9 THEN 'T-AU-'||scent||'-'||form||'-35' WHEN 10 THEN 'P-AU-SRT-'||scent||'-'||form WHEN 11 THEN 'P-OC-AU-CTN-'||scent||'-'||form||'-48' WHEN 12 THEN 'AU-B-'||scent||'-'||form||'-35' WHEN 13 THEN 'AU-BD-NPS-100' ELSE 'AU-'||scent||'-'||form||'-35' END"),
            ("name", "CASE WHEN part_id % 23 = 0 THEN NULL ELSE name END"),
        ),
    ),
    "f_store_orders": (
        "orders",
        (
            ("id", "o_orderkey"),
            ("market", "CASE o_custkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' ELSE 'AU' END"),
            ("number", "CAST(o_orderkey AS STRING)"),
            ("status", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'refunded' ELSE 'cancelled' END END"),
            ("date_created", "CAST(CAST(o_orderdate AS DATE) AS STRING)||'T'||lpad(CAST(o_orderkey % 24 AS STRING), 2, '0')||':30:00'"),
            ("local_date", "CAST(o_orderdate AS DATE)"),
            ("total", "CAST(o_totalprice AS DECIMAL(18,2))"),
            ("currency", "CASE o_custkey % 3 WHEN 0 THEN 'CAD' WHEN 1 THEN 'USD' ELSE 'AUD' END"),
        ),
    ),
    "f_store_items": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN f_code ON l_partkey = part_id",
        (
            ("order_id", "l_orderkey"),
            ("market", "CASE o_custkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' ELSE 'AU' END"),
            ("sku", "CASE WHEN code = '' THEN NULL ELSE code END"),
            ("name", "name"),
            ("quantity", "CAST(l_quantity AS BIGINT) % 6 + 1"),
            ("total", "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2))"),
            ("local_date", "CAST(o_orderdate AS DATE)"),
        ),
    ),
    "f_mkt_orders": (
        "orders",
        (
            ("id", "lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')||'-'||lpad(CAST(o_orderkey AS STRING), 7, '0')||'-'||lpad(CAST(o_custkey AS STRING), 7, '0')"),
            ("market", "CASE o_custkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' ELSE 'AU' END"),
            ("status", "CASE o_orderstatus WHEN 'F' THEN 'Shipped' WHEN 'O' THEN 'Unshipped' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Pending' ELSE 'Canceled' END END"),
            ("purchase_date", "CAST(CAST(o_orderdate AS DATE) AS STRING)||'T'||lpad(CAST(o_orderkey % 24 AS STRING), 2, '0')||':18:49+00:00'"),
            ("total", "CAST(o_totalprice AS DECIMAL(18,2))"),
        ),
    ),
    "f_mkt_items": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey",
        (
            ("market", "CASE o_custkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' ELSE 'AU' END"),
            ("seller_sku", "CASE l_partkey % 7 WHEN 0 THEN 'V9-2U5C-RGSU' WHEN 1 THEN 'US-OG-NPO-35' WHEN 2 THEN 'CA-OG-NPO-85' WHEN 3 THEN 'UNKNOWN-1' WHEN 4 THEN ' HP-G88K-NR69 ' WHEN 5 THEN 'AU-OG-NPO-35' ELSE '' END"),
            ("shipment_item_id", "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING) END"),
            ("quantity", "CAST(l_quantity AS BIGINT)"),
            ("total", "CAST(l_extendedprice AS DECIMAL(18,2))"),
            ("date_created", "CAST(CAST(l_shipdate AS DATE) AS STRING)||'T'||lpad(CAST(l_orderkey % 24 AS STRING), 2, '0')||':18:49+00:00'"),
            ("sales_channel", "CASE l_suppkey % 5 WHEN 0 THEN 'Amazon.ca' WHEN 1 THEN 'amazon.com' WHEN 2 THEN 'Amazon.com.au' WHEN 3 THEN 'amazon' ELSE '' END"),
            ("currency", "CASE l_suppkey % 3 WHEN 0 THEN 'CAD' WHEN 1 THEN 'USD' ELSE 'AUD' END"),
            ("ship_country", "CASE l_suppkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' WHEN 2 THEN 'USA' ELSE 'AU' END"),
            ("range_label", "substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7)||'-'||CAST(CASE WHEN day(l_shipdate) < 16 THEN 1 ELSE 2 END AS STRING)||'h'"),
            ("report_job_id", "CAST((((year(l_shipdate) * 12 + month(l_shipdate)) * 2 + CASE WHEN day(l_shipdate) < 16 THEN 1 ELSE 2 END) * 3 + o_custkey % 3) * 2 + l_suppkey % 2 AS BIGINT)"),
        ),
    ),
    "f_report_jobs": (
        "(SELECT DISTINCT report_job_id, market, range_label FROM f_mkt_items) j",
        (
            ("id", "report_job_id"),
            ("source", "'amazon'"),
            ("market", "market"),
            ("range_label", "range_label"),
            ("status", "CASE report_job_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'ready' ELSE 'ingested' END"),
            ("attempts", "report_job_id % 30"),
        ),
    ),
    "f_erp_orders": (
        "orders",
        (
            ("id", "o_orderkey"),
            ("reference", "CASE o_orderkey % 5 WHEN 0 THEN lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')||'-'||lpad(CAST(o_orderkey AS STRING), 7, '0')||'-'||lpad(CAST(o_custkey AS STRING), 7, '0') WHEN 1 THEN CAST(o_orderkey AS STRING) ELSE 'SOR-'||CAST(o_orderkey AS STRING) END"),
            ("company", "CASE o_custkey % 13 WHEN 0 THEN 'WOOLWORTHS - Moorebank - NDC' WHEN 1 THEN 'Coles' WHEN 2 THEN 'Grocery Holdings Pty Ltd - RedBank' WHEN 3 THEN 'Kemps Creek' WHEN 4 THEN 'Amazon Seller X' WHEN 5 THEN 'Amazon FBA' WHEN 6 THEN 'Stock Adjustments' WHEN 7 THEN '' WHEN 8 THEN '[Redacted]' WHEN 9 THEN 'Mrs' WHEN 10 THEN 'Momentum Foods' WHEN 11 THEN 'AVO Trading Co' ELSE 'Some Stockist' END"),
            ("channel", "CASE WHEN o_orderkey % 97 = 0 THEN 'Cloud' WHEN o_orderkey % 3 = 0 THEN 'Backend' ELSE '' END"),
            ("status", "CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'VOID' ELSE 'DRAFT' END ELSE 'APPROVED' END"),
            ("created_date", "CAST(CAST(o_orderdate AS DATE) AS STRING)||'T10:00:00Z'"),
            ("modified_date", "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS STRING)||'T14:00:06Z'"),
            ("delivery_date", "CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS STRING)||'T00:00:00Z'"),
            ("dispatched_date", "CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) AS STRING)||'T14:00:06Z' ELSE NULL END"),
        ),
    ),
    "f_erp_lines": (
        "lineitem JOIN f_code ON l_partkey = part_id",
        (
            ("order_id", "l_orderkey"),
            ("line_no", "l_linenumber"),
            ("parent_id", "CASE WHEN l_linenumber >= 6 THEN l_orderkey + 1 ELSE CAST(0 AS BIGINT) END"),
            ("code", "code"),
            ("uom_size", "CAST(CASE WHEN l_suppkey % 9 = 0 THEN 48 ELSE 1 END AS BIGINT)"),
            ("qty", "CAST(l_quantity AS DECIMAL(18,4))"),
            ("unit_price", "CAST(900 + l_partkey % 1000 AS DECIMAL(18,2))"),
            ("total", "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END"),
            ("name", "name"),
        ),
    ),
    "f_credit_lines": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN f_code ON l_partkey = part_id WHERE l_returnflag = 'R'",
        (
            ("credit_note_id", "l_orderkey"),
            ("status", "CASE o_orderstatus WHEN 'P' THEN 'DRAFT' WHEN 'O' THEN 'APPROVED' ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'VOID' ELSE 'APPROVED' END END"),
            ("created_date", "CAST(CAST(o_orderdate AS DATE) AS STRING)||'T10:00:00Z'"),
            ("parent_id", "CAST(0 AS BIGINT)"),
            ("code", "code"),
            ("uom_size", "CAST(CASE WHEN l_suppkey % 9 = 0 THEN 48 ELSE 1 END AS BIGINT)"),
            ("qty", "CAST(CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,4))"),
            ("total", "CAST(CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2))"),
        ),
    ),
    "f_stock": (
        "lineitem JOIN f_code ON l_partkey = part_id",
        (
            ("code", "code"),
            ("branch_name", "CASE l_suppkey % 5 WHEN 0 THEN 'Amazon FBA' WHEN 1 THEN 'AmazonFBA AU' WHEN 2 THEN 'Main Warehouse' WHEN 3 THEN 'North Depot' ELSE '' END"),
            ("stock_on_hand", "CAST(l_quantity AS BIGINT)"),
            ("available", "CAST(CASE WHEN l_quantity > 10 THEN l_quantity - 10 ELSE 0 END AS BIGINT)"),
            ("incoming", "CAST(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS BIGINT)"),
        ),
    ),
    "f_product_meta": (
        "part JOIN f_code ON p_partkey = part_id",
        (
            ("code", "code"),
            ("category", "CASE p_type WHEN 'STANDARD' THEN 'Finished Products' WHEN 'PROMO' THEN 'Bicarb Based' WHEN 'ECONOMY' THEN '' ELSE 'Merch' END"),
            ("part_id", "p_partkey"),
        ),
    ),
    "f_po_supplier": (
        "(SELECT l_orderkey, min(l_suppkey) AS low, max(l_suppkey) AS high FROM lineitem GROUP BY l_orderkey) s",
        (
            ("po_key", "l_orderkey"),
            ("po_supplier", "CASE WHEN l_orderkey % 2 = 0 THEN low ELSE high END"),
        ),
    ),
    "f_po_lines": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN f_po_supplier ON po_key = o_orderkey JOIN supplier ON po_supplier = s_suppkey JOIN f_code ON l_partkey = part_id",
        (
            ("reference", "'PO-'||CAST(o_orderkey AS STRING)"),
            ("company", "s_name"),
            ("created_date", "CAST(o_orderdate AS DATE)"),
            ("status", "CASE o_orderpriority WHEN '5-LOW' THEN 'VOID' WHEN '1-URGENT' THEN 'Completed' ELSE 'APPROVED' END"),
            ("fully_received_date", "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) ELSE NULL END"),
            ("delivery_date", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(30 AS INT) ELSE NULL END"),
            ("estimated_delivery_date", "CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + CAST(45 AS INT) ELSE NULL END"),
            ("code", "CASE WHEN l_linenumber = 7 THEN 'Freight' ELSE code END"),
            ("qty", "CAST(l_quantity AS BIGINT)"),
            ("qty_received", "CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS BIGINT)"),
        ),
    ),
    "f_ship_orders": (
        "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        (
            ("order_number", "o_orderkey"),
            ("country", "CASE n_regionkey WHEN 0 THEN 'AU' WHEN 1 THEN 'au ' WHEN 2 THEN NULL WHEN 3 THEN 'NZ' ELSE 'US' END"),
            ("service", "CASE o_orderpriority WHEN '1-URGENT' THEN 'Express Post' WHEN '2-HIGH' THEN 'next_day' ELSE 'standard' END"),
            ("order_status", "CASE o_orderstatus WHEN 'O' THEN 'awaiting_shipment' WHEN 'P' THEN 'on_hold' ELSE 'shipped' END"),
            ("store_id", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 4 END"),
            ("company", "CASE WHEN o_custkey % 50 = 0 THEN 'Waiva  Clark' ELSE c_name END"),
        ),
    ),
    "f_run_log": (
        "events",
        (
            ("run_at", "ts"),
            ("run_id", "event_id"),
            ("source", "CASE user_id % 4 WHEN 0 THEN 'woo' WHEN 1 THEN 'amazon' WHEN 2 THEN 'cin7_sales_orders' ELSE 'cin7_credit_notes' END"),
            ("market", "CASE user_id % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' ELSE 'AU' END"),
            ("action", "CASE event_type WHEN 'signup' THEN 'amazon-safetynet' WHEN 'purchase' THEN 'backfill' WHEN 'click' THEN 'amazon-reports' ELSE 'incremental' END"),
            ("status", "CASE WHEN event_type = 'error' THEN 'error' WHEN value > 200 THEN 'rate_limited' ELSE 'ok' END"),
            ("orders_added", "CAST(floor(value) AS BIGINT) % 4"),
            ("items_added", "event_id % 3"),
        ),
    ),
    "f_stock_ticks": (
        "events",
        (
            ("ts", "ts"),
            ("product_id", "user_id % 20"),
            ("stock", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 6 END"),
        ),
    ),
}

_NAME = re.compile(r"\b([a-z]\w*)\b")


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    picked = ", ".join(f"{expr} AS {col}" for col, expr in columns)
    return f"SELECT {picked} FROM {source}"


def names_in(text: str, known) -> list[str]:
    """Known names used in a piece of SQL, in order of first use."""
    return [n for n in dict.fromkeys(_NAME.findall(text)) if n in known]


class Inputs:
    """The test tables and the views over them, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def stream_path(self, table: str) -> str:
        """A glob: the file source takes one for a single file, a folder otherwise."""
        return f"{self.sf_dir}/{table}.parque[t]"

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                self._frames[name] = self.spark.read.parquet(self.path(name))
            else:
                frame = self.select(view_sql(name))
                if name == "f_code":
                    # Stored catalogues hold codes as plain columns.  Here they come
                    # from a long CASE, which the optimizer would copy into every
                    # filter on a code; a generator makes them plain columns again.
                    frame = frame.select(F.inline(F.array(F.struct(*frame.columns))))
                self._frames[name] = frame
        return self._frames[name]

    def select(self, text: str) -> DataFrame:
        """Run a SELECT whose FROM clause names tables or views."""
        known = set(BASE_TABLES) | set(VIEWS)
        head, _, tail = text.partition(" FROM ")
        used = names_in(tail, known)
        for name in used:
            tail = re.sub(rf"(?<![\w.]){name}(?![\w.])", "{" + name + "}", tail, count=1)
        return self.spark.sql(f"{head} FROM {tail}", **{n: self(n) for n in used})
