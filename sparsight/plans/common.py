"""Tables and fixed-point outputs that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch  # noqa: F401

SCALE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(x: Column) -> Column:
    """Millionths, rounded half up, so that results compare exactly."""
    return F.floor(x * SCALE + 0.5).cast("bigint")


def fixed_sql(x: str) -> str:
    return f"CAST(floor(({x}) * {SCALE} + 0.5) AS BIGINT)"


def text(a: Column) -> Column:
    return F.concat_ws(",", a.cast("array<string>"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the hour they fall in, by which ordered computations are cut."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600).cast("bigint"))
