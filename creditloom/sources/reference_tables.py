"""Small reference tables: sectors and bureau scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.conditions import SECTOR_ADJUSTMENTS
from creditloom.plans.credit import bureau_latest


def default_sectors(spark: SparkSession) -> DataFrame:
    """The twelve constant sectors."""
    return spark.createDataFrame(SECTOR_ADJUSTMENTS, "code string, label string, adjustment int")


def read_sector_risk(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Active sectors from a table, or the constants when no path is given."""
    if path is None:
        return default_sectors(spark)
    return active_sectors(spark.read.parquet(path))


def active_sectors(table: DataFrame) -> DataFrame:
    """Active rows, one per code: that with the least adjustment and, of several such, the least label."""
    live = table.where(F.col("active_flag") == "Y")
    return live.groupBy("code").agg(F.min_by("label", F.struct("adjustment", "label")).alias("label"), F.min("adjustment").alias("adjustment"))


def read_bureau_latest(spark: SparkSession, path: str) -> DataFrame:
    return bureau_latest(spark.read.parquet(path))
