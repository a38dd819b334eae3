"""Transaction posting and customer statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.pic import edited
from creditloom.operators.ordered import running_sum


def split_transactions(txns: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) transactions."""
    ids = master.select("cust_id")
    return txns.join(ids, "cust_id", "left_semi"), txns.join(ids, "cust_id", "left_anti")


def txn_deltas(txns: DataFrame) -> DataFrame:
    """Signed sum per customer, whatever the type; summed before the join."""
    return txns.groupBy("cust_id").agg(F.sum("amount_cents").alias("delta_cents"), F.count("*").alias("txns"))


def post_transactions(txns: DataFrame, master: DataFrame) -> DataFrame:
    """Master rows with posted balances."""
    j = master.join(txn_deltas(txns), "cust_id", "left")
    zero = F.lit(0).cast("bigint")
    return j.withColumns(
        {
            "balance_cents": F.col("balance_cents") + F.coalesce("delta_cents", zero),
            "posted": F.coalesce("txns", zero),
        }
    ).drop("delta_cents", "txns")


def posting_totals(txns: DataFrame, master: DataFrame) -> DataFrame:
    """Posted and failed counts; one row per customer reaches the join."""
    per = txns.groupBy("cust_id").agg(F.count("*").alias("n"))
    j = per.join(master.select("cust_id", F.lit(True).alias("_m")), "cust_id", "left")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint")
    return j.agg(count(F.col("_m").isNotNull()).alias("posted"), count(F.col("_m").isNull()).alias("failed"))


def failed_lines(txns: DataFrame, master: DataFrame) -> DataFrame:
    """Report line of each transaction without a customer."""
    _, failed = split_transactions(txns, master)
    return failed.select(
        "txn_id", F.concat(F.rpad(F.col("cust_id").cast("string"), 10, " "), F.lit("FAILED")).alias("line")
    )


def running_balance(txns: DataFrame, master: DataFrame) -> DataFrame:
    """Balance after each posted transaction, in transaction order."""
    matched, _ = split_transactions(txns, master)
    run = running_sum(matched, ["cust_id"], "txn_id", "run_cents", F.col("amount_cents"), sparse=True)
    opened = master.select("cust_id", F.col("balance_cents").alias("opening_cents"))
    return run.join(opened, "cust_id").select(
        "txn_id", "cust_id", "amount_cents", (F.col("opening_cents") + F.col("run_cents")).alias("balance_cents")
    )


def statement_rows(master: DataFrame) -> DataFrame:
    """Active customers only."""
    return master.where(F.col("status") == "A")


def statement_totals(master: DataFrame) -> DataFrame:
    return statement_rows(master).agg(
        F.count("*").alias("records"), F.coalesce(F.sum("balance_cents"), F.lit(0)).alias("total_cents")
    )


def statements(master: DataFrame) -> DataFrame:
    """Report lines (section, cust_id, line) in print order."""
    head = F.lit("CUSTOMER STATEMENT REPORT")
    spark = master.sparkSession
    body = statement_rows(master).select(
        F.lit(1).alias("section"), "cust_id",
        F.concat(F.rpad(F.col("cust_id").cast("string"), 10, " "), F.rpad("name", 30, " ")).alias("line"),
    )
    no = F.lit(None).cast("bigint")
    top = spark.range(1).select(F.lit(0).alias("section"), no.alias("cust_id"), head.alias("line"))
    total = edited(F.col("total_cents"), 2, 12, 2)
    t = statement_totals(master)
    foot = t.select(
        F.lit(2).alias("section"), no.alias("cust_id"),
        F.explode(
            F.array(
                F.concat(F.rpad(F.lit("GRAND TOTAL: "), 14, " "), total),
                F.concat(F.rpad(F.lit("TOTAL RECORDS: "), 16, " "), F.lpad(F.col("records").cast("string"), F.greatest(F.length(F.col("records").cast("string")), F.lit(5)), F.lit("0"))),
                F.lit("END OF REPORT"),
            )
        ).alias("line"),
    )
    return top.unionByName(body).unionByName(foot)
