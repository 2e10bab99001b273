"""Text rules: secret masking, number-aware sort keys, run summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential shapes and what replaces them, applied in order.
SECRET_RULES = (
    (r"""(?i)(consumer_key|consumer_secret|access_token|refresh_token|api_key|client_secret|oauth_token|code|id_token)=[^&\s"']+""",
     "$1=[REDACTED]"),
    (r"(?i)\b(ck|cs)_[a-f0-9]{20,}\b", "$1_[REDACTED]"),
    (r"\bAtz[ar]\|[A-Za-z0-9_\-+/=|]+", "Atz_[REDACTED]"),
    (r"\bamzn1\.oa2-cs\.v1\.[A-Za-z0-9]+", "amzn1.oa2-cs.v1.[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b", "eyJ[REDACTED]"),
)


def scrub(text: Column) -> Column:
    """Mask credentials in log text before it is stored."""
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement in SECRET_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def natural_key(text: Column) -> Column:
    """Sort key that orders digit runs by value and ignores case."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\d+|\D+)"), F.lit(1))

    def padded(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=\\d)", "")
        # A length prefix orders runs of any size without a fixed width.
        sized = F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        return F.when(run.rlike(r"^\d"), sized).otherwise(run)

    return F.array_join(F.transform(runs, padded), "")


def counted(n: Column, noun: str) -> Column:
    """'+2 orders' with the plural only where it belongs."""
    return F.concat(F.lit("+"), n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def run_summary(action: Column, status: Column, error: Column, orders: Column, items: Column) -> Column:
    """One line of text about a sync run."""
    a, b = F.coalesce(orders, F.lit(0)), F.coalesce(items, F.lit(0))
    jobs = F.concat(counted(a, "job"), F.lit(" ingested"))
    polls = F.concat(counted(b, "poll"), F.lit(" advanced"))
    reports = (
        F.when((a == 0) & (b == 0), "idle (all ranges fresh)")
        .when(b == 0, jobs)
        .when(a == 0, polls)
        .otherwise(F.concat_ws(", ", jobs, polls))
    )
    plain = (
        F.when((a == 0) & (b == 0), "0 new orders, system healthy")
        .when(b == 0, counted(a, "order"))
        .otherwise(F.concat_ws(", ", counted(a, "order"), counted(b, "item")))
    )
    return (
        F.when(status == "rate_limited", F.coalesce(F.when(error != "", error), F.lit("rate-limited by upstream")))
        .when(status == "error", F.coalesce(F.when(error != "", error), F.lit("error")))
        .when(action == "amazon-reports", reports)
        .otherwise(plain)
    )


def job_summary(
    status: Column, label: Column, attempts: Column, error: Column,
    matched: Column, unmatched: Column, wrong_market: Column,
) -> Column:
    """One line of text about a report request."""
    name = F.coalesce(label, F.lit("?"))
    tries = F.coalesce(attempts, F.lit(0))
    m, u, w = (F.coalesce(c, F.lit(0)) for c in (matched, unmatched, wrong_market))
    tail = F.when(
        (u > 0) | (w > 0),
        F.concat(F.lit(" ("), u.cast("string"), F.lit(" unmatched, "), w.cast("string"), F.lit(" wrong-market)")),
    ).otherwise("")
    return (
        F.when(status == "ingested", F.concat(name, F.lit(" ingested · "), m.cast("string"), F.lit(" rows matched"), tail))
        .when(status == "failed", F.concat(name, F.lit(" failed: "), F.coalesce(error, F.lit("unknown"))))
        .when(status == "ready", F.concat(name, F.lit(" ready to ingest")))
        .otherwise(F.concat(name, F.lit(" pending ("), tries.cast("string"), F.lit(" poll"), F.when(tries == 1, "").otherwise("s"), F.lit(")")))
    )


def snapshot_summary(count: Column, noun: str = "SKU", tail: str = "cached") -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"), F.lit(f" {tail}"))
