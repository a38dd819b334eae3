"""Regulatory classification, provisions, recovery flag and class totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.conditions import in_portfolio
from creditloom.functions.pic import LITERAL, band, check_mode, percent_of, store
from creditloom.sources.published import publish, published

# Days past due -> class, class -> provision rate (percent, scale 4).
CLASS_BANDS = [(30, "1"), (90, "2"), (180, "3")]
RATE_BANDS = [(30, 0), (90, 200000), (180, 500000)]
RATE_LOSS = 1000000
CLASSES = ("1", "2", "3", "4")
RECOVERY_TABLE_ROWS = 200


def loan_class(dpd: Column) -> Column:
    return band(dpd, CLASS_BANDS, "4", "<=")


def provision_rate(dpd: Column, mode: str = LITERAL) -> Column:
    """Literal mode: 100 % does not fit two integer digits and is stored as 0."""
    rate = band(dpd, RATE_BANDS, RATE_LOSS, "<=").cast("bigint")
    return store(rate, 4, 2, 4) if check_mode(mode) == LITERAL else rate


def provision(outstanding: Column, rate_e4: Column) -> Column:
    """Half-up percentage of the outstanding amount."""
    return store(percent_of(outstanding, rate_e4, 4), 2, 11, 2)


def active_portfolio(loans: DataFrame) -> DataFrame:
    return loans.where(in_portfolio(F.col("status")))


def classify(loans: DataFrame, mode: str = LITERAL) -> DataFrame:
    """Class, rate and provision of every portfolio loan; the former class is kept."""
    rated = active_portfolio(loans).withColumnRenamed("loan_class", "prev_class").select(
        "*", loan_class(F.col("dpd")).alias("loan_class"), provision_rate(F.col("dpd"), mode).alias("prov_rate_e4")
    )
    return rated.withColumn("provision_cents", provision(F.col("outstanding_cents"), F.col("prov_rate_e4")))


def stored_provision(cents: Column, mode: str = LITERAL) -> Column:
    """The loan row holds nine integer digits only."""
    return store(cents, 2, 9, 2) if check_mode(mode) == LITERAL else cents


def flag_recovery(classified: DataFrame, actions: DataFrame, first_rows: int | None = None) -> DataFrame:
    """'REC' where an action exists for the loan, else 'NRC'.

    ``first_rows`` looks only at the first actions by id, as the fixed-size
    table of the batch does.
    """
    if first_rows is not None:
        actions = actions.orderBy("action_id").limit(first_rows)
    ids = actions.select("loan_id").distinct().withColumn("_has", F.lit(True))
    flagged = classified.join(ids, "loan_id", "left")
    return flagged.withColumn("recovery_flag", F.when(F.col("_has"), "REC").otherwise("NRC")).drop("_has")


def classify_portfolio(
    loans: DataFrame, actions: DataFrame, mode: str = LITERAL, first_rows: int | None = None
) -> DataFrame:
    """Classified portfolio with recovery flag; feeds every output of the step."""
    return flag_recovery(classify(loans, mode), actions, first_rows)


def rewrite_loans(loans: DataFrame, mode: str = LITERAL) -> DataFrame:
    """The loan table after the step: portfolio loans replaced, others unchanged.

    The new values depend on the row alone, so no join is needed.
    """
    inside = in_portfolio(F.col("status"))
    rate = provision_rate(F.col("dpd"), mode)
    amount = stored_provision(provision(F.col("outstanding_cents"), rate), mode)
    old_rate = F.col("prov_rate_e4") if "prov_rate_e4" in loans.columns else F.lit(0).cast("bigint")
    old_amount = F.col("provision_cents") if "provision_cents" in loans.columns else F.lit(0).cast("bigint")
    return loans.withColumns(
        {
            "loan_class": F.when(inside, loan_class(F.col("dpd"))).otherwise(F.col("loan_class")),
            "prov_rate_e4": F.when(inside, rate).otherwise(old_rate),
            "provision_cents": F.when(inside, amount).otherwise(old_amount),
        }
    )


def risk_history(classified: DataFrame, today: int) -> DataFrame:
    """One audit row per classified loan."""
    return classified.select(
        "loan_id", "cust_id", F.col("loan_class").alias("new_class"), "prev_class", "outstanding_cents",
        "provision_cents", "dpd", F.lit(today).cast("bigint").alias("report_date"),
    )


def append_risk_history(classified: DataFrame, today: int, path: str) -> None:
    """Append the audit rows, one folder per report date."""
    risk_history(classified, today).write.mode("append").partitionBy("report_date").parquet(path)


def publish_risk_history(classified: DataFrame, today: int, path: str, run: str) -> None:
    """Add the audit rows of one run; a retry after a failure, or a second call, adds nothing twice."""
    publish(risk_history(classified, today).withColumn("dpd", F.col("dpd").cast("bigint")), path, run)


def read_risk_history(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of all published runs."""
    schema = (
        "loan_id bigint, cust_id bigint, new_class string, prev_class string, outstanding_cents bigint, "
        "provision_cents bigint, dpd bigint, report_date bigint"
    )
    found = published(spark, path)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def with_all_codes(agg: DataFrame, code: str, codes: tuple[str, ...], zeros: list[str]) -> DataFrame:
    """Left join a constant dimension so that absent codes show zero."""
    spark = agg.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias(code))
    out = dim.join(agg, code, "left")
    return out.select(code, *[F.coalesce(z, F.lit(0)).cast("bigint").alias(z) for z in zeros])


def class_totals(classified: DataFrame) -> DataFrame:
    """Count, outstanding and provision per class; empty classes stay."""
    agg = classified.groupBy("loan_class").agg(
        F.count("*").alias("loans"), F.sum("outstanding_cents").alias("outstanding_cents"),
        F.sum("provision_cents").alias("provision_cents"),
    )
    return with_all_codes(agg, "loan_class", CLASSES, ["loans", "outstanding_cents", "provision_cents"])


def counterparty_exposure(loans: DataFrame) -> DataFrame:
    """Outstanding per customer over the portfolio."""
    return active_portfolio(loans).groupBy("cust_id").agg(
        F.count("*").alias("loans"), F.sum("outstanding_cents").alias("outstanding_cents")
    )
