"""The metric store's queries: filtered series, tails, statistics, ranges, aligned volumes, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likelihood import bucket_start


def metric_query(data: DataFrame, uid=None, first_row: int | None = None, last_row: int | None = None, start=None, end=None, limit: int | None = None, least_score: float | None = None, ascending: bool = False) -> DataFrame:
    """Rows (uid, rowid, ts, value, score) of a metric by row numbers or times; the limit comes before the score filter, the default order is latest first.

    A least score of 0 asks for rows that have a score at all. Without a uid, the limit holds for each metric.
    """
    q = data
    if uid is not None:
        q = q.where(F.col("uid") == uid)
    for test in ((F.col("rowid") >= first_row) if first_row is not None else None, (F.col("rowid") <= last_row) if last_row is not None else None, (F.col("ts") >= start) if start is not None else None, (F.col("ts") <= end) if end is not None else None):
        if test is not None:
            q = q.where(test)
    if limit is not None:
        order = F.col("rowid").asc() if ascending else F.col("rowid").desc()
        q = q.withColumn("__n", F.row_number().over(Window.partitionBy("uid").orderBy(order))).where(F.col("__n") <= limit).drop("__n")
    if least_score is not None:
        q = q.where(F.col("score") >= least_score if least_score > 0 else F.col("score").isNotNull())
    return q


def metric_tail(data: DataFrame, n: int) -> DataFrame:
    """The latest n rows with a score of each metric."""
    w = Window.partitionBy("uid").orderBy(F.col("ts").desc(), F.col("rowid").desc())
    return data.where("score is not null").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def metric_stats(data: DataFrame) -> DataFrame:
    return data.groupBy("uid").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """A stored table with changes put in: rows of new keys are added, those of known keys replaced; of changes to one key the latest version counts.

    Serves metrics as well as jobs and their models: a status is set by a change that differs in it alone.
    """
    columns = [c for c in table.columns if c != key]
    latest = changes.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("__row")).select(key, "__row.*")
    return table.join(latest, key, "left_anti").unionByName(latest)


def adopt(models: DataFrame, offered: DataFrame, identity: str, order: str) -> DataFrame:
    """models plus the offered rows whose identity (a hash of their parameters) is not there yet; of equal ones offered, the first."""
    columns = [c for c in models.columns if c != identity]
    first = offered.groupBy(identity).agg(F.min_by(F.struct(*columns), order).alias("__row")).select(identity, "__row.*")
    return models.unionByName(first.join(models, identity, "left_anti"))


def with_status(table: DataFrame, keys: DataFrame, key: str, status: str) -> DataFrame:
    """A stored table in which the named keys have a status."""
    named = keys.select(F.col(key).alias("__key")).distinct()
    marked = table.join(named, F.col(key).eqNullSafe(F.col("__key")), "left")
    return marked.withColumn("status", F.when(F.col("__key").isNotNull(), F.lit(status)).otherwise(F.col("status"))).drop("__key")


def value_range(value: Column, spread: float) -> tuple[Column, Column]:
    """Aggregates: the least and most value, widened by so many population deviations."""
    return F.min(value) - spread * F.stddev_pop(value), F.max(value) + spread * F.stddev_pop(value)


def encoder_resolution(low: Column, high: Column, buckets: int, least: float) -> Column:
    high = F.when(high == low, low + 1).otherwise(high)
    return F.greatest(F.lit(least), (high - low) / buckets)


def bucket_volumes(events: DataFrame, ts: str, key: str, seconds: int) -> DataFrame:
    """key, bucket, volume: events in aligned buckets; pre-aggregated before the shuffle."""
    return events.groupBy(F.col(key).alias("key"), bucket_start(F.col(ts), seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("volume"))


def fill_volumes(volumes: DataFrame, seconds: int) -> DataFrame:
    """A row for every key and bucket between the first and last of all, 0 where nothing came; keys are a catalogue of metrics."""
    span = volumes.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    every = volumes.select("key").distinct().crossJoin(F.broadcast(span)).select("key", F.explode(F.sequence("a", "b", F.lit(seconds).cast("bigint"))).alias("bucket"))
    return every.join(volumes, ["key", "bucket"], "left").select("key", "bucket", F.coalesce("volume", F.lit(0)).alias("volume"))


def tag_join(samples: DataFrame, routes: dict[str, DataFrame]) -> DataFrame:
    """Samples with the metrics they belong to, by several routes (column -> table of that column and metric); repeats are kept."""
    parts = [samples.join(table, column).select("sample", "metric", F.lit(column).alias("route")) for column, table in routes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def name_matches(name: Column, patterns: list[str]) -> Column:
    """Whether a name matches one of the patterns, in either case."""
    return name.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(True)


def membership(rows: DataFrame, others: DataFrame, on: str, inverted: bool = False) -> DataFrame:
    """Rows whose key another table has, or has not."""
    return rows.join(others.select(on).distinct(), on, "left_anti" if inverted else "left_semi")


def results_per_choice(scores: DataFrame, choice: str, error: str, generation: str | None = None, until: int | None = None) -> DataFrame:
    """choice, errors: the finite errors of each choice, ascending, up to a generation where one is given."""
    kept = scores.where(F.col(error).isNotNull() & (F.abs(error) < float("inf")))
    if generation is not None and until is not None:
        kept = kept.where(F.col(generation) <= until)
    return kept.groupBy(choice).agg(F.array_sort(F.collect_list(error)).alias("errors"))


def model_error(metric: Column, maximise: bool, is_matured: Column, reason: Column) -> Column:
    """A model's error: infinite unless it has matured and ended well; negated where more is better."""
    return F.when(is_matured & reason.isin("eof", "stopped"), -metric if maximise else metric).otherwise(float("inf"))
