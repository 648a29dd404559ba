"""Pipelines from typed records to scored ones: layers as functions of tables, regions as compositions, parameters, stored runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..functions.sdr import digits_to_bits, to_sparse
from ..streaming import keyed

# The defaults of the parameter bag, and the ranges that are checked.
DEFAULTS = {
    "columns": 2048, "cells": 32, "activation": 13, "matching": 10, "max_new": 20, "max_synapses": 255, "max_segments": 255, "initial": 0.21, "connected": 0.5, "inc": 0.10, "dec": 0.10, "punish": 0.0,
    "potential_pct": 0.5, "density": -1.0, "active": 10, "stimulus": 0, "active_inc": 0.05, "inactive_dec": 0.008, "syn_connected": 0.10, "below_inc": 0.01, "trim": 0.05, "period": 1000, "max_boost": 10.0,
    "shape": (), "input_shape": (), "local_radius": 0, "potential_radius": 0, "wrap": True, "adapt_radius": False,
    "n": 500, "w": 21, "low": 0.0, "high": 1000.0, "resolution": 1.0, "alpha": 0.001, "steps": (1,), "seed": 42,
}
RANGES = {"potential_pct": (0, 1), "initial": (0, 1), "connected": (0, 1), "inc": (0, 1), "dec": (0, 1), "active_inc": (0, 1), "inactive_dec": (0, 1), "alpha": (0, 1), "columns": (1, None), "cells": (1, None)}


class Parameters(dict):
    """The bag: known keys only, values within their ranges."""

    def __init__(self, **values):
        super().__init__(DEFAULTS)
        self.update(values)

    def update(self, values) -> None:
        for k, v in dict(values).items():
            if k not in DEFAULTS:
                raise KeyError(f"unknown parameter {k}")
            low, high = RANGES.get(k, (None, None))
            if low is not None and v < low or high is not None and v > high:
                raise ValueError(f"{k} must lie between {low} and {high}")
            self[k] = v


#: Encoders by kind; `functions.encoders.record_bits` builds a record's encoding from fields that name one.
ENCODERS: dict[str, Callable] = E.KINDS


def as_input(rows: DataFrame, column: str) -> Column:
    """struct(kind, bits, record): a column of any input type as one; text of digits and whole-number arrays are bits, maps are records."""
    kind, value = dict(rows.dtypes)[column], F.col(column)
    no_bits, no_record = F.lit(None).cast("array<int>"), F.lit(None).cast("map<string,string>")
    if kind.startswith("map<"):
        parts = "record", no_bits, value.cast("map<string,string>")
    elif kind in ("array<int>", "array<bigint>"):
        parts = "bits", F.array_sort(value.cast("array<int>")), no_record
    elif kind == "string":
        parts = "digits", to_sparse(digits_to_bits(value)), no_record
    else:
        raise ValueError(f"{column} is a {kind}; inputs are text, arrays of whole numbers, or maps")
    return F.struct(F.lit(parts[0]).alias("kind"), parts[1].alias("bits"), parts[2].alias("record"))


@dataclass
class Layer:
    """Steps from table to table, in the order they were added; each is a name and a function."""

    name: str
    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def add(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Layer:
        self.steps.append((name, step))
        return self

    def where(self, condition) -> Layer:
        return self.add("where", lambda df: df.where(condition))

    def skip(self, n: int, number: str = "rec_no") -> Layer:
        """Drops the first n records, as priming does."""
        return self.add("skip", lambda df: df.where(F.col(number) >= n))

    def encode(self, encoder: E.ScalarEncoder, value: str) -> Layer:
        return self.add("encode", lambda df: keyed.encoded(df, encoder, value))

    def model(self, keys: list[str], order: list[str], encoder: E.ScalarEncoder, value: str, **settings) -> Layer:
        """The learned part: pooler, memory, classifier, likelihood."""
        return self.add("model", lambda df: keyed.score(df, keys, order, encoder, value, **settings))

    def apply(self, rows: DataFrame) -> DataFrame:
        for _, step in self.steps:
            rows = rows.transform(step)
        return rows


@dataclass
class Network:
    """Layers by name and which feeds which; one layer is the head."""

    layers: dict[str, Layer] = field(default_factory=dict)
    feeds: dict[str, str] = field(default_factory=dict)

    def layer(self, name: str) -> Layer:
        return self.layers.setdefault(name, Layer(name))

    def connect(self, lower: str, upper: str) -> Network:
        if lower not in self.layers or upper not in self.layers:
            raise KeyError("connect layers that exist")
        self.feeds[upper] = lower
        if self.head() is None:
            raise ValueError("layers may not feed each other in a circle")
        return self

    def head(self) -> str | None:
        tops = [n for n in self.layers if n not in self.feeds.values()]
        return tops[0] if tops else None

    def run(self, rows: DataFrame, until: str | None = None) -> DataFrame:
        order, at = [], until or self.head()
        while at is not None:
            order.append(at)
            at = self.feeds.get(at)
        for name in reversed(order):
            rows = self.layers[name].apply(rows)
        return rows


# -- predictions read from classification columns --------------------------------------------------------------------
def multi_step_predictions(likelihoods: DataFrame, by: list[str], value: str, p: str, least: float = 1e-4, most: int = 8) -> DataFrame:
    """by, value, p, rank, is_best: probabilities summed over equal values, the best first, unlikely ones dropped."""
    from ..operators.columns import drop_unlikely

    summed = likelihoods.groupBy(*by, value).agg(F.sum(p).alias("p"))
    return drop_unlikely(summed, by, value, "p", least, most).withColumn("is_best", F.col("rank") == 1)


def add_deltas(predictions: DataFrame, delta: str, current: str, out: str) -> DataFrame:
    """Predicted differences as values again."""
    return predictions.withColumn(out, F.col(current) + F.col(delta))


# -- runs and models kept as tables ----------------------------------------------------------------------------------
def store(rows: DataFrame, folder: str, name: str, settings: dict | None = None) -> str:
    """Writes a run's output and its settings under a name with the next number; returns the path."""
    spark = rows.sparkSession
    path = f"{folder}/{name}/{len(versions(spark, folder, name)):06d}"
    rows.write.parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(settings or {}, sort_keys=True),)], "settings string").coalesce(1).write.json(f"{path}/settings")
    return path


def versions(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Paths of what was stored under a name, oldest first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in fs.listStatus(where)) if fs.exists(where) else []


def load(spark: SparkSession, folder: str, name: str, back: int = 0) -> tuple[DataFrame, dict]:
    """The latest stored run, or one so many before it."""
    found = versions(spark, folder, name)
    if back >= len(found):
        raise FileNotFoundError(f"{name} was not stored that often")
    path = found[-1 - back]
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.json(f"{path}/settings").first().settings)


def resume(rows: DataFrame, done: DataFrame, number: str = "rec_no") -> DataFrame:
    """Records after the last one done."""
    last = done.agg(F.max(number).alias("__last"))
    return rows.join(F.broadcast(last), F.col("__last").isNull() | (F.col(number) > F.col("__last"))).drop("__last")


def latest(rows: DataFrame, keys: list[str], number: str = "rec_no") -> DataFrame:
    """Each key's last record: the state that accessors read. Maxima are taken before rows move, so a key may be hot."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), number).alias("__row")).select("__row.*")


def describe(encoder) -> dict:
    return asdict(encoder)


# -- records around models ---------------------------------------------------------------------------------------------
def record_dict(rows: DataFrame, fields: list[str], at: Column, number: Column, category: Column | None = None, reset: Column | None = None, sequence: Column | None = None) -> Column:
    """A row as the map that a model reads: its fields as text, and beside them when it came, its number, category, reset and sequence."""
    own = {
        "_timestamp": F.unix_timestamp(at), "_timestampRecordIdx": number, "_category": category if category is not None else F.lit(-1),
        "_reset": F.coalesce(reset.cast("int"), F.lit(0)) if reset is not None else F.lit(0), "_sequenceId": sequence if sequence is not None else F.lit(0),
    }
    clash = set(own) & set(fields)
    if clash:
        raise ValueError(f"fields that records have themselves: {sorted(clash)}")
    pairs = [(name, F.col(f"`{name}`")) for name in fields] + list(own.items())
    return F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[c.cast("string") for _, c in pairs]))


def backlog(stored: DataFrame, started: DataFrame, keys: list[str], number: str, batch: int) -> DataFrame:
    """What models that start must catch up on: all stored rows after each model's last one (keys, last; null: none), in batches by number.

    Rows of keys without a model are left out. A batch holds `batch` numbers of a key.
    """
    rows = stored.join(started.select(*keys, "last"), keys)
    after = F.coalesce(F.col("last"), F.lit(-1))
    return rows.where(F.col(number) > after).withColumn("batch", F.floor((F.col(number) - after - 1) / batch)).drop("last")


def column_report(rows: DataFrame, path: str) -> DataFrame:
    """Writes a search's results as CSV with a header and reads them back as text columns."""
    rows.write.option("header", True).csv(path)
    return rows.sparkSession.read.option("header", True).csv(path)


#: Classifiers that fields can be inferred by.
def classifiers() -> dict[str, Callable]:
    from ..operators.learned import SoftmaxClassifier, VotingClassifier

    return {"sdr": SoftmaxClassifier, "cla": VotingClassifier}


def classifier_of(inferred: dict[str, str | None], **settings) -> dict[str, object]:
    """A classifier for each field that is to be inferred (field -> kind; None: not inferred)."""
    known = classifiers()
    unknown = {k for k in inferred.values() if k is not None and k not in known}
    if unknown:
        raise ValueError(f"unknown classifiers {sorted(unknown)}; known: {sorted(known)}")
    return {field: known[kind](**settings.get(field, {})) for field, kind in inferred.items() if kind is not None}
