"""Activity log source and sink (S4, S6): date-partitioned, seven-day retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import as_of_col
from ..model import ACTIVITY_TTL_DAYS


def append_activity(df: DataFrame, path: str, ts_col: str = "ts") -> None:
    """Append log rows, partitioned by UTC day so reads can prune whole days."""
    df.withColumn("log_date", F.to_date(F.col(ts_col))) \
        .write.mode("append").partitionBy("log_date").parquet(path)


def read_activity_log(spark: SparkSession, path: str, as_of=None, ts_col: str = "ts",
                      ttl_days: int = ACTIVITY_TTL_DAYS) -> DataFrame:
    """Rows newer than ``as_of - 7 days``; the ``log_date`` predicate prunes partitions."""
    cutoff = as_of_col(as_of) - F.expr(f"INTERVAL {ttl_days} DAYS")
    df = spark.read.parquet(path)
    return df.where((F.col("log_date") >= F.to_date(cutoff)) & (F.col(ts_col) > cutoff))
