"""Monthly management report: every breakdown from one grouping-sets pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.pic import idiv, ratio
from creditloom.plans.risk import CLASSES, active_portfolio, with_all_codes

# Product and segment codes of the report.
LOAN_TYPES = ("CON", "IMM", "AUT", "PRO", "REV", "DEC")
TYPE_LABELS = {
    "CON": "CONSOMMATION", "IMM": "IMMOBILIER", "AUT": "AUTOMOBILE", "PRO": "PROFESSIONNEL", "REV": "REVOLVING",
    "DEC": "DECOUVERT",
}
SEGMENTS = ("MM", "MB", "PR", "PB")


def report_class(klass: Column) -> Column:
    """Unknown classes count as class 1."""
    return F.when(klass.isin("2", "3", "4"), klass).otherwise("1")


def with_customer(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Names and segment; blank when the customer is missing."""
    who = customers.select("cust_id", "first_name", "last_name", "segment")
    j = loans.join(who, "cust_id", "left")
    return j.withColumns({c: F.coalesce(c, F.lit("")) for c in ("first_name", "last_name", "segment")})


def portfolio_by_class(loans: DataFrame) -> DataFrame:
    agg = active_portfolio(loans).groupBy(report_class(F.col("loan_class")).alias("loan_class")).agg(
        F.count("*").alias("loans"), F.sum("outstanding_cents").alias("outstanding_cents"),
        F.sum("provision_cents").alias("provision_cents"),
    )
    return with_all_codes(agg, "loan_class", CLASSES, ["loans", "outstanding_cents", "provision_cents"])


def portfolio_by_type(loans: DataFrame) -> DataFrame:
    """Six known types; other types are not reported."""
    known = active_portfolio(loans).where(F.col("loan_type").isin(*LOAN_TYPES))
    agg = known.groupBy("loan_type").agg(F.count("*").alias("loans"), F.sum("outstanding_cents").alias("outstanding_cents"))
    return with_all_codes(agg, "loan_type", LOAN_TYPES, ["loans", "outstanding_cents"])


def portfolio_by_segment(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Count, outstanding, active against restructured loans per segment.

    Loans are summed per customer first, so one customer with very many loans
    reaches the join as one row.
    """
    active = F.col("status") == "AC"
    per_cust = active_portfolio(loans).groupBy("cust_id").agg(
        F.count("*").alias("loans"), F.sum("outstanding_cents").alias("outstanding_cents"),
        F.count_if(active).alias("active_loans"), F.count_if(~active).alias("other_loans"),
    )
    j = per_cust.join(customers.select("cust_id", "segment"), "cust_id")
    names = ["loans", "outstanding_cents", "active_loans", "other_loans"]
    agg = j.where(F.col("segment").isin(*SEGMENTS)).groupBy("segment").agg(*[F.sum(n).alias(n) for n in names])
    return with_all_codes(agg, "segment", SEGMENTS, names)


def rate_weight(rate_e4: Column, outstanding: Column) -> Column:
    """Rate times outstanding in cents, each product cut to two decimals before summing."""
    return idiv(rate_e4 * outstanding, 10_000)


def portfolio_totals(loans: DataFrame) -> DataFrame:
    """Loans, outstanding, provision, weighted mean rate and provision percent."""
    agg = active_portfolio(loans).agg(
        F.count("*").alias("loans"), F.coalesce(F.sum("outstanding_cents"), F.lit(0)).alias("outstanding_cents"),
        F.coalesce(F.sum("provision_cents"), F.lit(0)).alias("provision_cents"),
        F.coalesce(F.sum(rate_weight(F.col("rate_e4"), F.col("outstanding_cents")).cast("decimal(38,0)")), F.lit(0)).alias("w"),
    )
    out = F.col("outstanding_cents")
    avg = F.when(out > 0, F.call_function("div", F.col("w") * F.lit(10_000).cast("decimal(5,0)"), out.cast("decimal(20,0)")))
    pct = F.when(out > 0, F.call_function("div", F.col("provision_cents").cast("decimal(20,0)") * F.lit(10_000).cast("decimal(5,0)"), out.cast("decimal(20,0)")))
    return agg.select(
        "loans", "outstanding_cents", "provision_cents", avg.cast("bigint").alias("avg_rate_e4"),
        pct.cast("bigint").alias("provision_pct_e2"),
    )


def risk_ratios(loans: DataFrame) -> DataFrame:
    """Non-performing, loss and coverage percent at scale 2, half up."""
    k = report_class(F.col("loan_class"))
    amount = F.col("outstanding_cents")
    agg = active_portfolio(loans).agg(
        F.sum(amount).alias("t"), F.sum(F.when(k != "1", amount).otherwise(0)).alias("npl"),
        F.sum(F.when(k == "4", amount).otherwise(0)).alias("loss"), F.sum("provision_cents").alias("prov"),
    )
    has = F.col("t") > 0
    return agg.select(
        *[F.when(has, ratio(F.col(c), F.col("t"), 4)).alias(f"{n}_pct_e2") for c, n in
          (("npl", "npl"), ("loss", "loss"), ("prov", "coverage"))]
    )


def portfolio_sections(loans: DataFrame, customers: DataFrame) -> DataFrame:
    """Class, type, segment and total rows from a single pass over the loans."""
    p = with_customer(active_portfolio(loans), customers).select(
        report_class(F.col("loan_class")).alias("loan_class"), "loan_type", "segment", "outstanding_cents", "provision_cents"
    )
    g = p.groupingSets(
        [[F.col("loan_class")], [F.col("loan_type")], [F.col("segment")], []],
        F.col("loan_class"), F.col("loan_type"), F.col("segment"),
    ).agg(
        F.grouping_id("loan_class", "loan_type", "segment").alias("gid"), F.count("*").alias("loans"),
        F.sum("outstanding_cents").alias("outstanding_cents"), F.sum("provision_cents").alias("provision_cents"),
    )
    # grouping_id bits: class 4, type 2, segment 1; a set bit means "not grouped".
    section = F.when(F.col("gid") == 3, "class").when(F.col("gid") == 5, "type").when(F.col("gid") == 6, "segment").otherwise("total")
    code = F.when(F.col("gid") == 3, F.col("loan_class")).when(F.col("gid") == 5, F.col("loan_type")).when(F.col("gid") == 6, F.col("segment")).otherwise("ALL")
    return g.select(section.alias("section"), code.alias("code"), "loans", "outstanding_cents", "provision_cents")


def top_exposures(loans: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    """Largest outstanding amounts; the earlier loan wins a tie.

    The n rows are chosen before the customer join.
    """
    top = active_portfolio(loans).where(F.col("outstanding_cents") > 0).orderBy(F.col("outstanding_cents").desc(), "loan_id").limit(n)
    named = with_customer(top, customers)
    name = F.substring(F.concat(F.rpad("last_name", 30, " "), F.lit(" "), F.rpad("first_name", 25, " ")), 1, 40)
    return named.select("loan_id", "cust_id", F.rtrim(name).alias("cust_name"), "outstanding_cents", "loan_class", "loan_type")


