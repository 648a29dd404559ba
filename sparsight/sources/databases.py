"""Tables of databases, read in even parts: ranges of a key from the table's own quantiles, one connection a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running
from ..shared import written


def key_ranges(keys: DataFrame, column: str, parts: int) -> DataFrame:
    """part, low, high, n: ranges of a key that hold about a parts-th of the rows each, in order; a key's rows are never parted.

    A key belongs to the part in which its first row falls, so a key that holds more than a part's rows makes its part as
    large, and parts that begin inside it are left out. Null keys are in no range.
    """
    counts = keys.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    ranges = written(counts.repartitionByRange("key").withColumn("chunk", F.spark_partition_id()), "key-counts")
    total = ranges.agg(F.sum("n")).first()[0] or 0
    placed = running(ranges, [], "chunk", ["key"], {"upto": ("sum", "n")})
    part = F.floor((F.col("upto") - F.col("n")) * parts / total) if total else F.lit(0)
    return placed.withColumn("part", part.cast("bigint")).groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("n").alias("n"))


def predicates(lows: list, column: str) -> list[str]:
    """Conditions that hold for each row of a table exactly once: half-open ranges that begin at lows; nulls go with the first.

    lows are numbers in rising order; what lies below the first, such as rows that came later, goes with the first as well.
    """
    if len(lows) < 2:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(lows[1:], lows[2:])]
    return [f"{column} < {lows[1]} OR {column} IS NULL", *inner, f"{column} >= {lows[-1]}"]


def even_parts(spark: SparkSession, url: str, table: str, column: str, parts: int, **options) -> DataFrame:
    """A database's table in parts of about equal numbers of rows, by a whole-number key.

    The key alone is read first, over ranges of equal width; its quantiles, one number a part, are the bounds of the parts.
    Columns and filters of later operations go to the database.
    """
    def jdbc(query: str):
        return spark.read.format("jdbc").options(**options).option("url", url).option("query", query)

    low, high = jdbc(f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}").load().first()
    if low is None:
        return spark.read.jdbc(url, table, properties=options)
    keys = spark.read.format("jdbc").options(**options).option("url", url).option("dbtable", f"(SELECT {column} AS k FROM {table}) keys_of")
    keys = keys.option("partitionColumn", "k").option("lowerBound", low).option("upperBound", high + 1).option("numPartitions", parts).load()
    lows = [r.low for r in key_ranges(keys, keys.columns[0], parts).orderBy("part").collect()]
    return spark.read.jdbc(url, table, predicates=predicates(lows, column), properties=options)
