"""Product-code rules: pack rollup, regional test, aliases, line classes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.fixed import MARKETPLACE_ALIASES

_WHOLESALE = r"^WC-(AU-.+?)(?:-(?:NL|WC))?$"


def clean(code: Column) -> Column:
    """Trimmed code, empty instead of null."""
    return F.trim(F.coalesce(code, F.lit("")))


def _framed(s: Column, head: str, tail: str) -> Column:
    """True for head + at least one character + tail."""
    return s.startswith(head) & s.endswith(tail) & (F.length(s) > len(head) + len(tail))


def _middle(s: Column, head: str, tail: str) -> Column:
    return F.substring(s, F.lit(len(head) + 1), F.length(s) - len(head) - len(tail))


# Codes are tested by plain prefix and suffix: these run on every line of every
# order, and a regular expression per rule would cost more than the aggregation.

def base_code(code: Column) -> Column:
    """Single-tin code a pack code rolls up to; null for a blank code."""
    s = clean(code)
    return (
        F.when(s == "", F.lit(None))
        .when(_framed(s, "WC-AU-", ""), F.regexp_extract(s, _WHOLESALE, 1))
        .when(_framed(s, "AU-CTN-", "-48"), F.concat(F.lit("AU-"), _middle(s, "AU-CTN-", "-48"), F.lit("-35")))
        .when(s.startswith("AU-CTN-SRT-MIX-"), s)
        .when(_framed(s, "AU-SRT-", "x12"), F.concat(F.lit("AU-"), F.rtrim(_middle(s, "AU-SRT-", "x12"), F.lit("-"))))
        .when(_framed(s, "AU-", "M"), _middle(s, "", "M"))
        .otherwise(s)
    )


def pack_size(code: Column) -> Column:
    """Tins in one unit of a pack code."""
    s = clean(code)
    return (
        F.when(_framed(s, "WC-AU-", ""), F.lit(54))
        .when(_framed(s, "AU-CTN-", "-48"), F.lit(48))
        .when(s.startswith("AU-CTN-SRT-MIX-"), F.lit(72))
        .when(_framed(s, "AU-SRT-", "x12"), F.lit(12))
        .otherwise(F.lit(1))
    )


def is_regional(code: Column) -> Column:
    head = F.upper(F.substring(clean(code), 1, 6))
    return head.startswith("AU-") | head.startswith("D-AU-") | (head == "WC-AU-")


def is_discontinued(code: Column) -> Column:
    return code.rlike(r"^(AU-(CTN-|B-)?|D-AU-)SC-")


def is_soap(code: Column) -> Column:
    return F.coalesce(code, F.lit("")).endswith("-NPS-100")


def marketplace_sku(seller_sku: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical SKU of a seller SKU, null when the alias table lacks it."""
    table = MARKETPLACE_ALIASES if aliases is None else aliases
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return lookup[clean(seller_sku)]


def regional_marketplace_sku(seller_sku: Column, aliases: dict[str, str] | None = None) -> Column:
    """Alias if listed, else a regional code stands for itself, else null."""
    s = clean(seller_sku)
    own = F.when(s.startswith("AU-"), s)
    return F.coalesce(marketplace_sku(seller_sku, aliases), own) if aliases else own


def po_line_class(code: Column) -> Column:
    s = clean(code)
    return (
        F.when(s == "", F.lit("other"))
        .when(F.lower(s).isin("freight", "shipping", "postage", "kittingfee"), F.lit("fees"))
        .when(s.startswith("T-"), F.lit("raw_tin"))
        .when(s.startswith("AU-BD-"), F.lit("soap"))
        .when(s.startswith("AU-CTN-") | s.startswith("AU-SRT-"), F.lit("carton_tray"))
        .when(s.startswith("AU-"), F.lit("finished"))
        .when(s.startswith("P-"), F.lit("packaging"))
        .otherwise(F.lit("other"))
    )


def packaging_class(sku: Column) -> Column:
    """3PL packaging group of a SKU; null when it is not packaging."""
    s = clean(sku)
    return (
        F.when(s.startswith("T-"), F.lit("tins"))
        .when(s == "NP_INSERTS", F.lit("inserts"))
        .when(s.rlike(r"(?i)^P-CA-BLANK-CTN-\d+SRT$"), F.lit("blankCartons"))
        .when(s.startswith("P-BLANK-ENV-") | s.rlike(r"^[A-Z]+-PURO-BOXES$"), F.lit("blankCartons"))
        .when(s.startswith("P-CA-SRT-"), F.lit("srt"))
        .when(s.startswith("P-ENV-"), F.lit("envelopes"))
    )


_LINK = r"^P-CA-SRT-([A-Z]{2})(?:-([A-Z]{2,3}))?$"


def tray_scent(sku: Column) -> Column:
    return F.regexp_extract(clean(sku), _LINK, 1)


def tray_form(sku: Column) -> Column:
    return F.regexp_extract(clean(sku), _LINK, 2)


def tray_tin(sku: Column) -> Column:
    """Tin SKU a 3PL tray is filled with, '' when the code names none."""
    scent, form = tray_scent(sku), tray_form(sku)
    return F.when(form != "", F.concat_ws("-", F.lit("CA"), scent, form, F.lit("35"))).otherwise(F.lit(""))


def carton_capacity(sku: Column) -> Column:
    """Trays per blank carton, from a trailing -<n>SRT; 0 when absent."""
    digits = F.regexp_extract(clean(sku), r"(?i)-(\d+)SRT$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))
