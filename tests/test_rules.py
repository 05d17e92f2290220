from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallywright.functions import rules, scalars

ROWS = [  # amount, channel, category, status, international: suspicious, rule, severity
    (249_999, "UPI", "RETAIL", "SETTLED", 0, False, None, None),
    (250_000, "UPI", "RETAIL", "SETTLED", 0, True, "HV_AMT_250K", "HIGH"),
    (250_000, "UPI", "RETAIL", "PENDING", 0, False, None, None),
    (500_000, "UPI", "CRYPTO", "SETTLED", 0, True, "HV_AMT_250K", "CRITICAL"),
    (74_999, "WIRE", "RETAIL", "SETTLED", 0, False, None, None),
    (75_000, "WIRE", "CRYPTO", "SETTLED", 1, True, "WIRE_75K", "MEDIUM"),
    (49_999, "UPI", "CRYPTO", "SETTLED", 0, False, None, None),
    (50_000, "UPI", "CRYPTO", "SETTLED", 0, True, "CRYPTO_50K", "MEDIUM"),
    (99_999, "UPI", "RETAIL", "SETTLED", 1, False, None, None),
    (100_000, "UPI", "RETAIL", "SETTLED", 1, True, "INTL_100K", "HIGH"),
    (None, "WIRE", "CRYPTO", "SETTLED", 1, False, None, None),
]


def test_thresholds(spark):
    schema = "id int, amount_inr long, channel string, category string, status string, is_international int"
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(ROWS)], schema)
    rows = df.select("id", F.coalesce(rules.is_suspicious(), F.lit(False)).alias("s"), rules.rule_code().alias("r"), rules.alert_severity().alias("v")).collect()
    for r in rows:
        suspicious, rule, severity = ROWS[r.id][5:]
        assert r.s == suspicious
        if suspicious:
            assert (r.r, r.v) == (rule, severity)


@pytest.mark.parametrize(
    ("month", "category", "channel", "amount", "cause"),
    [
        ("2026-07", "CRYPTO", "UPI", 900_000, "LEAK"), ("2026-07", "RETAIL", "WIRE", 249_999, "LEAK"), ("2026-07", "RETAIL", "WIRE", 250_000, "NOISE"),
        ("2026-06", "CRYPTO", "WIRE", 100_000, "NOISE"), ("2026-07", "RETAIL", "UPI", 300_000, "NOISE"),
    ],
)
def test_leak_cause(spark, month, category, channel, amount, cause):
    df = spark.createDataFrame([(month, category, channel, amount)], "month string, category string, channel string, amount_inr long")
    assert df.select(rules.leak_cause("2026-07").alias("c")).first().c == cause


def test_ratios_round_half_up_and_guard_zero(spark):
    df = spark.createDataFrame([(1, 8), (0, 0), (5, 0), (201, 200_000), (2, 3)], "a long, b long")
    rows = df.select(rules.per_thousand(F.col("a"), F.col("b")).alias("t"), rules.percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [(125.0, 12.5), (0.0, 0.0), (0.0, 0.0), (1.01, 0.1), (666.67, 66.7)]


def test_scalars(spark):
    df = spark.createDataFrame([(0,), (999,), (1000,), (123456,), (1234567,), (-12345678901,)], "n long")
    assert [r[0] for r in df.select(scalars.format_inr(F.col("n"))).collect()] == ["₹0", "₹999", "₹1,000", "₹1,23,456", "₹12,34,567", "₹-12,34,56,78,901"]
    df = spark.createDataFrame([(0,), (9_500_000,), (10_500_000,), (1_234_000_000,)], "n long")
    assert [r[0] for r in df.select(scalars.format_inr_crore(F.col("n"))).collect()] == ["₹0.0 Cr", "₹1.0 Cr", "₹1.1 Cr", "₹123.4 Cr"]
    df = spark.createDataFrame([(7,), (1234567,)], "n long")
    assert [r[0] for r in df.select(scalars.padded_id("TXN", F.col("n"))).collect()] == ["TXN000007", "TXN1234567"]
    df = spark.createDataFrame([("2026-07-01T02:00:00+05:30",), ("2026-06-30T20:30:00.000+00:00",), ("never",), (None,)], "t string")
    ts = df.select("t", scalars.parse_ts(F.col("t")).alias("ts"))
    assert [r.ts for r in ts.collect()] == [datetime(2026, 6, 30, 20, 30)] * 2 + [None, None]
    assert ts.select(scalars.utc_iso(F.col("ts"))).first()[0] == "2026-06-30T20:30:00.000Z"
    assert df.select(rules.month_key(F.col("t"))).first()[0] == "2026-07"
    assert spark.range(1).select(scalars.trim_all(F.lit("\n\t a b \r\n"))).first()[0] == "a b"
