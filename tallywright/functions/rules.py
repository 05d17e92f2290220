"""The published alert rules as column expressions over transactions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amounts from which a settled transaction must raise an alert.
ANY_AMOUNT, WIRE_AMOUNT, CRYPTO_AMOUNT, INTERNATIONAL_AMOUNT = 250_000, 75_000, 50_000, 100_000
CRITICAL_AMOUNT = 500_000


def is_settled() -> Column:
    return F.col("status") == "SETTLED"


def is_suspicious() -> Column:
    amount = F.col("amount_inr")
    return is_settled() & (
        (amount >= ANY_AMOUNT)
        | ((F.col("channel") == "WIRE") & (amount >= WIRE_AMOUNT))
        | ((F.col("category") == "CRYPTO") & (amount >= CRYPTO_AMOUNT))
        | ((F.col("is_international") == 1) & (amount >= INTERNATIONAL_AMOUNT))
    )


def rule_code() -> Column:
    """The first rule that a suspicious transaction meets."""
    amount = F.col("amount_inr")
    return (
        F.when(amount >= ANY_AMOUNT, "HV_AMT_250K")
        .when((F.col("channel") == "WIRE") & (amount >= WIRE_AMOUNT), "WIRE_75K")
        .when((F.col("category") == "CRYPTO") & (amount >= CRYPTO_AMOUNT), "CRYPTO_50K")
        .otherwise("INTL_100K")
    )


def alert_severity() -> Column:
    return (
        F.when(F.col("amount_inr") >= CRITICAL_AMOUNT, "CRITICAL")
        .when(F.col("amount_inr") >= ANY_AMOUNT, "HIGH")
        .when(F.col("category") == "CRYPTO", "MEDIUM")
        .otherwise("HIGH")
    )


def leak_cause(leak_month: str, month: str = "month") -> Column:
    """Why an alert is missing: the pipeline leak of one month, or noise."""
    leaked = (F.col("category") == "CRYPTO") | ((F.col("channel") == "WIRE") & (F.col("amount_inr") < ANY_AMOUNT))
    return F.when((F.col(month) == leak_month) & leaked, "LEAK").otherwise("NOISE")


def month_key(ts: Column) -> Column:
    """Month of a row as yyyy-MM. A text keeps its local month: its first seven characters are taken as they stand."""
    return F.substring(ts.cast("string"), 1, 7)


def month_label(month: Column) -> Column:
    """yyyy-MM as 'July 2026'."""
    return F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMMM yyyy")


def per_thousand(part: Column, whole: Column) -> Column:
    """part / whole * 1000 with two decimals, halves up, in whole numbers; 0 without a whole."""
    return _ratio(part, whole, 1000, 100)


def percent(part: Column, whole: Column, decimals: int = 1) -> Column:
    """part / whole * 100, halves up, in whole numbers; 0 without a whole."""
    return _ratio(part, whole, 100, 10**decimals)


def _ratio(part: Column, whole: Column, times: int, scale: int) -> Column:
    halves_up = F.call_function("div", 2 * part * (times * scale) + whole, 2 * F.when(whole > 0, whole))
    return F.when(whole > 0, halves_up / F.lit(float(scale))).otherwise(F.lit(0.0))
