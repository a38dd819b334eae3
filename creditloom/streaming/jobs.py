"""Continuous versions of posting, screening and submission de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.text import source_hash
from creditloom.plans.aml import aml_screen


def matched_stream(txns: DataFrame, master: DataFrame) -> DataFrame:
    """Each arriving transaction with a flag for a known customer."""
    known = master.select("cust_id", F.lit(True).alias("_known"))
    j = txns.join(known, "cust_id", "left")
    return j.withColumn("posted", F.col("_known").isNotNull()).drop("_known")


def post_transactions_stream(txns: DataFrame, master: DataFrame) -> DataFrame:
    """Balance deltas and counts per customer, updated as transactions arrive.

    Summed before the join, so that a hot customer meets the master as one row.
    """
    sums = txns.groupBy("cust_id").agg(F.sum("amount_cents").alias("delta_cents"), F.count("*").alias("txns"))
    return sums.join(master.select("cust_id"), "cust_id", "left_semi")


def failed_transactions_stream(txns: DataFrame, master: DataFrame) -> DataFrame:
    """Transactions without a customer, appended as they arrive."""
    return matched_stream(txns, master).where(~F.col("posted")).drop("posted")


def aml_screen_stream(txns: DataFrame, sanctions: DataFrame) -> DataFrame:
    """Screen each arriving transaction against the static list."""
    return aml_screen(txns, sanctions)


def dedupe_submissions(submissions: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Pass each content once within the delay; later copies are dropped.

    State is bounded by the watermark: a copy that comes more than ``delay`` after the last one passes again, and
    rows older than the watermark are dropped by Spark, also where they are a first copy.  Choose ``delay`` above the
    longest lateness.
    """
    keyed = submissions.withColumn("source_hash", source_hash(F.col("content")))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["source_hash"])


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Drain what is available into a parquet table and return it."""
    out = f"{folder}/out"
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Drain an aggregation and return its latest row per key.

    Each batch overwrites its own folder, so a repeated batch changes nothing.
    """
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = stream.sparkSession.read.parquet(out)
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return last.select(*keys, "v.*")
