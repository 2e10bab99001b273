"""Lookup tables and word lists the reports depend on."""

from __future__ import annotations

# Seller SKU alias -> canonical SKU.
MARKETPLACE_ALIASES = {
    "CA-OG-NPO-85": "CA-OG-NPO-85",
    "CA-CL-VLB-85": "CA-CL-VLB-85",
    "CA-CL-VLB-35": "CA-CL-VLB-35",
    "CA-FF-VLB-35": "CA-FF-VLB-35",
    "CA-FP-VLB-35": "CA-FP-VLB-35",
    "CA-OG-NPO-35": "CA-OG-NPO-35",
    "CA-OG-BCF-35": "CA-OG-BCF-35",
    "CA-SC-BCF-35": "CA-SC-BCF-35",
    "CA-SC-NPO-35": "CA-SC-NPO-35",
    "V9-2U5C-RGSU": "CA-CL-VLB-35",
    "HP-G88K-NR69": "CA-FF-VLB-35",
    "0T-GA0Y-L3HG": "CA-OG-NPO-35",
    "IC-OLUM-TQLF": "CA-SC-NPO-35",
    "EX-DHDC-UJK7": "CA-FP-VLB-35",
    "SC-NPO-35-GS1": "CA-SC-NPO-35",
    "US-FP-VLB-35": "CA-FP-VLB-35",
    "US-SC-BCF-35": "CA-SC-BCF-35",
    "US-FF-VLB-35": "CA-FF-VLB-35",
    "US-OG-NPO-35": "CA-OG-NPO-35",
    "US-OG-NPO-35-AM": "CA-OG-NPO-35",
    "US-OG-BCF-35": "CA-OG-BCF-35",
    "US-SC-NPO-35": "CA-SC-NPO-35",
}

# Markets.
MARKET_CURRENCY = {"CA": "CAD", "US": "USD", "AU": "AUD"}
MARKETPLACE_IDS = {"CA": "A2EUQ1WTGCTBG2", "US": "ATVPDKIKX0DER", "AU": "A39IBJ37TRP1C6"}
BUSINESS_TZ = "America/Toronto"
WAREHOUSE_TZ = "Australia/Sydney"

# Statuses.
COUNTABLE_STATUSES = ("completed", "processing")
SKIPPED_MARKETPLACE_STATUSES = ("Canceled", "Pending", "PendingAvailability")
DEAD_ORDER_STATUSES = ("VOID", "VOIDED", "CANCELLED")
DEAD_CREDIT_STATUSES = ("VOID", "VOIDED", "CANCELLED", "DRAFT")
CLOSED_PO_STATUSES = ("completed", "void", "voided", "cancelled", "closed")

# Sales channels.
SALES_CHANNELS = ("col", "woo2", "dist", "woo", "amz")
PERSONAL_TITLES = ("mr", "mrs", "ms", "private")
WHOLESALE_ACCOUNTS = (
    "momentum foods",
    "avo trading",
    "favaro hair spa",
    "sunshine coast health products",
)

# Distribution centres as (company substring, label, state, ship the day before).
DISTRIBUTION_CENTRES = {
    "col": (
        ("redbank", "Coles QLD", "QLD", True),
        ("red bank", "Coles QLD", "QLD", True),
        ("somerton", "Coles VIC", "VIC", True),
        ("kemps creek", "Coles NSW", "NSW", False),
    ),
    "woo2": (
        ("moorebank", "Woolworths — Moorebank", "NSW", False),
        ("erskine park", "Woolworths — Erskine Park", "NSW", False),
    ),
}

# Packaging.
TINS_PER_TRAY = 12
TRAYS_PER_CARTON = 4
TINS_PER_CARTON = 48
ENVELOPE_CODES = ("ENVELOPES", "P-ENV-A1", "P-BOX-12x85")
PAPER_LEAD_MONTHS = 4
PACKAGING_FAMILIES = (
    ("srt", r"(?i)tc\s*printing"),
    ("cartons", r"(?i)sps\s*packaging"),
    ("envelopes", r"(?i)huizhou|ztj"),
    ("tins", r"(?i)guanqiao"),
)

# Shipping.
EXPRESS_WORDS = (
    "express", "overnight", "priority", "next_day", "next-day", "nextday", "expedited",
)

# Risk classes in report order.
RISK_ORDER = (
    "critical", "critical-incoming", "low", "low-incoming",
    "monitor", "stable", "no-sales", "inactive",
)

# Daily order-count milestones.
MILESTONES = (500, 1000, 1500, 1733, 2100, 2500)

# Candidate header names in marketplace shipment reports.
REPORT_COLUMNS = {
    "sku": ("sku", "seller_sku"),
    "name": ("product_name", "product_title", "item_name"),
    "quantity": ("quantity", "quantity_ordered", "quantity_shipped"),
    "price": ("item_price", "item_price_per_unit", "price", "item_total"),
    "date": ("purchase_date", "last_updated_date", "shipment_date", "payments_date"),
    "line_id": ("shipment_item_id", "amazon_order_item_id", "order_item_id"),
    "sales_channel": ("sales_channel",),
    "currency": ("currency",),
    "ship_country": ("ship_country", "ship_to_country", "ship_country_code"),
}

# Candidate header names in marketplace CSV exports.
MARKETPLACE_CSV_COLUMNS = {
    "order_id": ("Amazon Order Id", "amazon-order-id"),
    "item_id": ("Shipment Item ID", "shipment-item-id"),
    "purchase_date": ("Purchase Date", "purchase-date"),
    "sku": ("Merchant SKU", "sku"),
    "product_name": ("Title", "product-name"),
    "quantity": ("Dispatched Quantity", "quantity-shipped"),
    "currency": ("Currency", "currency"),
    "item_price": ("Item Price", "item-price"),
    "shipping": ("Delivery Price", "shipping-price"),
    "country": ("Delivery Country Code", "ship-country"),
}

# Hours after which a source counts as stale.
STALE_HOURS = {"sweep": 4, "stock": 1, "threepl": 4, "upload": 168}
