"""Payroll: pay, tax, summary and period reset.  Hours in tenths, money in cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.pic import rescale, store

# Standard hours (tenths), overtime factor (scale 1), tax bands.
STANDARD_TENTHS, OVERTIME_E1 = 400, 15
TAX_BANDS = [(50_000, 5), (150_000, 12), (300_000, 22)]
TAX_TOP = 30


def tax_rate(gross: Column) -> Column:
    out = None
    for below, pct in TAX_BANDS:
        out = F.when(gross < below, pct) if out is None else out.when(gross < below, pct)
    return out.otherwise(TAX_TOP).cast("bigint")


def payable() -> Column:
    return (F.col("active") == "Y") & (F.col("computed") == "N") & (F.col("hours_tenths") > 0)


def payroll(employees: DataFrame) -> DataFrame:
    """Pay of every payable employee; others keep their row unchanged."""
    over = F.greatest(F.col("hours_tenths") - STANDARD_TENTHS, F.lit(0))
    regular_hours = F.least(F.col("hours_tenths"), F.lit(STANDARD_TENTHS))
    regular = rescale(regular_hours * F.col("rate_cents"), 3, 2, rounded=True)
    overtime = rescale(over * F.col("rate_cents") * F.lit(OVERTIME_E1), 4, 2, rounded=True)
    pay = payable()
    e = employees.withColumn("_gross", store(regular + overtime, 2, 6, 2))
    e = e.withColumn("_tax", rescale(F.col("_gross") * tax_rate(F.col("_gross")), 4, 2, rounded=True))
    return e.withColumns(
        {
            "gross_cents": F.when(pay, F.col("_gross")).otherwise(F.col("gross_cents")),
            "tax_cents": F.when(pay, F.col("_tax")).otherwise(F.col("tax_cents")),
            "net_cents": F.when(pay, F.col("_gross") - F.col("_tax")).otherwise(F.col("net_cents")),
            "computed": F.when(pay, "Y").otherwise(F.col("computed")),
        }
    ).drop("_gross", "_tax")


def pay_summary(paid: DataFrame) -> DataFrame:
    """Totals over computed rows; the first employee keeps a tie for the highest pay."""
    rows = paid.where((F.col("active") == "Y") & (F.col("computed") == "Y"))
    top = F.max_by("emp_name", F.struct(F.col("gross_cents"), -F.col("emp_id")))
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return rows.agg(
        F.count("*").alias("employees"), money("gross_cents"), money("tax_cents"), money("net_cents"),
        F.coalesce(top, F.lit("")).alias("highest_paid"),
    )


def reset_pay_period(employees: DataFrame) -> DataFrame:
    """Zero hours and pay of active employees."""
    active = F.col("active") == "Y"
    zeroed = {c: F.when(active, F.lit(0).cast("bigint")).otherwise(F.col(c)) for c in
              ("hours_tenths", "gross_cents", "tax_cents", "net_cents")}
    return employees.withColumns({**zeroed, "computed": F.when(active, "N").otherwise(F.col("computed"))})
