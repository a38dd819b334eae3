"""Run-history rows with a JSON payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.text import source_hash

COLUMNS = ["id", "entry_type", "program_name", "source_hash", "analysis_engine", "complexity", "created_at", "payload_json"]


def history_rows(entries: DataFrame, payload: list[str]) -> DataFrame:
    """Entries to history rows; the payload columns are kept as JSON text."""
    return entries.select(
        "id", "entry_type", "program_name", source_hash(F.col("source_code")).alias("source_hash"),
        "analysis_engine", "complexity",
        "created_at", F.to_json(F.struct(*payload)).alias("payload_json"),
    )


def write_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, payload_schema: str) -> DataFrame:
    """Latest row per id, payload parsed.  Reading resolves replaced rows."""
    raw = spark.read.parquet(path)
    last = raw.groupBy("id").agg(F.max_by(F.struct(*[c for c in raw.columns if c != "id"]), "created_at").alias("r"))
    flat = last.select("id", "r.*")
    return flat.withColumn("payload", F.from_json("payload_json", payload_schema))


def prune_history(rows: DataFrame, n: int) -> DataFrame:
    """Newest n rows."""
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def list_history(rows: DataFrame, limit: int) -> DataFrame:
    return prune_history(rows, limit)
