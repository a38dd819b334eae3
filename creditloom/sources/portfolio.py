"""Synthetic portfolio with the stated distributions, generated on the executors.

Every draw is arithmetic on the row id and a salt, so rows can be rebuilt by
any task at any time and no random state is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.pic import idiv
from creditloom.plans.risk import loan_class, provision_rate

MODULUS = 2147483647
# Weights in percent of each drawn code.
CUST_TYPES = [("PP", 88), ("PM", 10), ("NR", 2)]
SEGMENT_WEIGHTS = [("MM", 70), ("MB", 22), ("PR", 7), ("PB", 1)]
KYC_WEIGHTS = [("V", 92), ("P", 5), ("E", 3)]
CUST_STATUS = [("A", 92), ("I", 6), ("B", 2)]
LOAN_TYPE_WEIGHTS = [("CON", 40), ("IMM", 25), ("AUT", 15), ("PRO", 12), ("REV", 5), ("DEC", 3)]
LOAN_STATUS = [("AC", 85), ("RS", 7), ("LT", 5), ("SD", 2), ("WO", 1)]
COLLATERAL_STATUS = [("A", 90), ("R", 7), ("S", 3)]
GUARANTEE_STATUS = [("A", 88), ("C", 7), ("E", 5)]
EMPLOYERS = [
    ("BANQUE NATIONALE", 8), ("MINISTERE PUBLIC", 10), ("TUNISIE TELECOM", 5), ("ORANGE", 5), ("PHARMACIE CENTRALE", 7), ("GROUPE INDUSTRIEL", 20),
    ("COMMERCE DETAIL", 12), ("ARTISAN INDEPENDANT", 13), ("CABINET MEDICAL", 20),
]
INCOME_CENTS = {"MM": (150000, 500000), "MB": (500000, 1500000), "PR": (1500000, 4000000), "PB": (4000000, 12000000)}
AMOUNT_CENTS = {
    "IMM": (8000000, 80000000), "PRO": (2000000, 40000000), "AUT": (1500000, 12000000), "REV": (500000, 5000000),
    "DEC": (100000, 2000000), "CON": (200000, 3000000),
}


def draw(key: Column, salt: int) -> Column:
    """A number in [0, MODULUS) from the row id: two rounds of a multiplicative congruence."""
    x = F.pmod(key * F.lit(48271) + F.lit(salt * 7919 + 12345), F.lit(MODULUS))
    return F.pmod(x * F.lit(69621) + F.lit(salt * 104729 + 1), F.lit(MODULUS))


def between(key: Column, salt: int, low: int | Column, high: int | Column) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.pmod(draw(key, salt), high - low + 1)).cast("bigint")


def weighted(key: Column, salt: int, weights: list[tuple[str, int]]) -> Column:
    roll, edge, out = F.pmod(draw(key, salt), F.lit(100)), 0, None
    for code, w in weights:
        edge += w
        out = F.when(roll < edge, code) if out is None else out.when(roll < edge, code)
    return out


def _by_code(code: Column, table: dict[str, tuple[int, int]], side: int) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(code == k, v[side]) if out is None else out.when(code == k, v[side])
    return out.cast("bigint")


def customers(ids: DataFrame) -> DataFrame:
    """``ids(id)`` to customers."""
    k = F.col("id")
    seg = weighted(k, 2, SEGMENT_WEIGHTS)
    return ids.select(
        (F.lit(10000001) + k).alias("cust_id"), F.lpad(between(k, 1, 1000000, 99999999).cast("string"), 8, "0").alias("cin"),
        weighted(k, 3, CUST_TYPES).alias("cust_type"), F.concat(F.lit("FIRST"), between(k, 4, 0, 47).cast("string")).alias("first_name"),
        F.concat(F.lit("LAST"), between(k, 5, 0, 34).cast("string")).alias("last_name"), F.lit("TUN").alias("nationality"),
        weighted(k, 14, EMPLOYERS).alias("employer"),
        seg.alias("segment"), between(k, 6, _by_code(seg, INCOME_CENTS, 0), _by_code(seg, INCOME_CENTS, 1)).alias("income_cents"),
        weighted(k, 7, KYC_WEIGHTS).alias("kyc"), F.when(F.pmod(draw(k, 8), F.lit(1000)) < 20, "Y").otherwise("N").alias("aml_flag"),
        F.when(F.pmod(draw(k, 9), F.lit(1000)) < 15, "Y").otherwise("N").alias("pep_flag"), weighted(k, 10, CUST_STATUS).alias("status"),
        (between(k, 11, 2005, 2024) * 10000 + between(k, 12, 1, 12) * 100 + between(k, 13, 1, 28)).alias("open_date"),
    )


def loans(ids: DataFrame, n_customers: int) -> DataFrame:
    """``ids(id)`` to loans of ``n_customers`` customers."""
    k = F.col("id")
    kind, status = weighted(k, 21, LOAN_TYPE_WEIGHTS), weighted(k, 22, LOAN_STATUS)
    base = ids.select(
        (F.lit(1000000001) + k).alias("loan_id"), (F.lit(10000001) + F.pmod(draw(k, 23), F.lit(n_customers))).alias("cust_id"),
        kind.alias("loan_type"), status.alias("status"),
        between(k, 24, _by_code(kind, AMOUNT_CENTS, 0), _by_code(kind, AMOUNT_CENTS, 1)).alias("original_cents"),
        between(k, 25, 0, 70).alias("_paid"), between(k, 26, 75000, 140000).alias("rate_e4"),
        F.when(kind == "IMM", between(k, 27, 120, 300)).when(kind == "AUT", between(k, 27, 36, 84)).otherwise(between(k, 27, 12, 72)).alias("_months"),
        F.when(status == "AC", F.when(F.pmod(draw(k, 28), F.lit(100)) < 85, F.lit(0)).otherwise(between(k, 29, 1, 30)))
        .when(status == "RS", between(k, 29, 0, 30)).when(status == "LT", between(k, 29, 91, 365)).otherwise(between(k, 29, 180, 720))
        .cast("bigint").alias("dpd"),
    )
    out = F.when(F.col("status") == "WO", 0).otherwise(idiv(F.col("original_cents") * (F.lit(100) - F.col("_paid")), 100)).cast("bigint")
    return base.select(
        "loan_id", "cust_id", "loan_type", "status", loan_class(F.col("dpd")).alias("loan_class"), "original_cents",
        out.alias("outstanding_cents"), idiv(F.col("original_cents"), F.col("_months")).alias("payment_cents"), "rate_e4", "dpd",
        F.least(idiv(F.col("dpd"), 30), F.lit(999)).alias("missed"), provision_rate(F.col("dpd")).alias("prov_rate_e4"),
    )


def collateral(ids: DataFrame, n_loans: int) -> DataFrame:
    k = F.col("id")
    return ids.select(
        (F.lit(2000000001) + k).alias("col_id"), (F.lit(1000000001) + F.pmod(draw(k, 31), F.lit(n_loans))).alias("loan_id"),
        between(k, 32, 2500000, 100000000).alias("value_cents"), weighted(k, 33, COLLATERAL_STATUS).alias("status"),
    )


def guarantees(ids: DataFrame, n_loans: int) -> DataFrame:
    k = F.col("id")
    return ids.select(
        (F.lit(3000000001) + k).alias("gtr_id"), (F.lit(1000000001) + F.pmod(draw(k, 41), F.lit(n_loans))).alias("loan_id"),
        between(k, 42, 2000000, 50000000).alias("amount_cents"), weighted(k, 43, GUARANTEE_STATUS).alias("status"),
    )


def sanctions(ids: DataFrame) -> DataFrame:
    k = F.col("id")
    return ids.select(
        F.concat(F.lit("FIRST"), between(k, 51, 0, 47).cast("string"), F.lit(" LISTED"), k.cast("string")).alias("name_key"),
        F.lpad(between(k, 52, 1, 99999999).cast("string"), 8, "0").alias("cin"),
        weighted(k, 53, [("PEP", 49), ("OFC", 19), ("EUL", 14), ("TUN", 10), ("UNL", 8)]).alias("list_code"), between(k, 54, 1, 5).alias("severity"),
    )


def make_portfolio(spark: SparkSession, n_loans: int) -> dict[str, DataFrame]:
    """Customers, loans, collateral, guarantees and sanctions in the stated proportions."""
    n_cust = max(n_loans * 5 // 8, 1)
    return {
        "customers": customers(spark.range(n_cust)), "loans": loans(spark.range(n_loans), n_cust),
        "collateral": collateral(spark.range(max(n_loans // 2, 1)), n_loans), "guarantees": guarantees(spark.range(max(n_loans // 4, 1)), n_loans),
        "sanctions": sanctions(spark.range(max(n_loans // 16, 1))),
    }
