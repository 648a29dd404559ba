"""Record streams: CSV with a three-line header (names, types, flags), databases, images, generators; one registry for all."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names that types go by in headers, and the flags.
TYPE_NAMES = {
    "string": "char string nvarchar category list", "timestamp": "date datetime datetime2 time", "boolean": "bool boolean", "coord": "coord", "geo": "geo",
    "int": "int integer long", "float": "double float number numeral real num scalar", "sarr": "sarr", "darr": "darr",
}
KINDS = {alias: kind for kind, names in TYPE_NAMES.items() for alias in names.split()} | {"date time": "timestamp", "floating point": "float"}
FLAGS = {"R": "reset", "RESET": "reset", "S": "sequence", "SEQUENCE": "sequence", "T": "timestamp", "TIMESTAMP": "timestamp", "C": "category", "CATEGORY": "category", "L": "learn", "LEARN": "learn"}
TIME_FORMATS = ("M/d/yy H:mm", "M/d/yy H:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss")


@dataclass(frozen=True)
class Header:
    """Fields by position; positions that only one of the lines has get a name of their own and the type float."""

    names: tuple[str, ...]
    kinds: tuple[str, ...]
    flags: tuple[str, ...]

    @classmethod
    def parse(cls, lines: list[str]) -> Header:
        if len(lines) < 3:
            raise ValueError("a header has three lines: names, types, flags")
        names, kinds, flags = ([x.strip() for x in line.lstrip("﻿").rstrip("\r\n").split(",")] for line in lines[:3])
        n = max(len(names), len(kinds), len(flags))
        at = lambda row, i: row[i] if i < len(row) else ""
        flags = [FLAGS.get(at(flags, i).upper(), "") for i in range(n)]
        return cls(tuple(at(names, i) or flags[i] or f"field{i}" for i in range(n)), tuple(KINDS.get(at(kinds, i).lower(), "float") for i in range(n)), tuple(flags))

    def schema(self) -> T.StructType:
        kinds = {"string": T.StringType(), "timestamp": T.TimestampType(), "sarr": T.ArrayType(T.IntegerType()), "darr": T.ArrayType(T.IntegerType()), "coord": T.ArrayType(T.DoubleType()), "geo": T.ArrayType(T.DoubleType())}
        return T.StructType([T.StructField(n, kinds.get(k, T.DoubleType()), True, {"flag": f}) for n, k, f in zip(self.names, self.kinds, self.flags)])

    def of_flag(self, flag: str) -> list[str]:
        return [n for n, f in zip(self.names, self.flags) if f == flag]


def kind_of(name: Column) -> Column:
    """The kind that a header's type name stands for; float where it is unknown or missing."""
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(name))), F.lit("float"))


def flag_of(mark: Column) -> Column:
    """What a header's flag means; empty where there is none."""
    known = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.upper(F.trim(mark))), F.lit(""))


def decode(value: Column, kind: str, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """A field's text as its type: numbers and booleans as doubles (NaN where missing), places as three doubles, arrays as ints."""
    value = F.trim(value)
    if kind == "string":
        return value
    if kind == "timestamp":
        return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])
    if kind == "boolean":
        return F.when(F.lower(value).isin("true", "1", "1.0", "t"), 1.0).otherwise(0.0)
    if kind in ("coord", "geo"):
        return F.transform(F.split(value, ";"), lambda x: F.trim(x).try_cast("double"))
    if kind in ("sarr", "darr"):
        return F.transform(F.split(F.regexp_replace(value, "[\\[\\]\\s]", ""), ","), lambda x: x.try_cast("int"))
    return F.coalesce(value.try_cast("double"), F.lit(float("nan")))


def csv_records(spark: SparkSession, path: str, header: Header | None = None, row: Callable[[Column], Column] | None = None) -> DataFrame:
    """rec_no and the typed fields of a file with a three-line header (or rows of a folder for which a header is given).

    row(line) -> array<string> replaces the splitter, which splits at commas and keeps a line that starts with [ whole.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    if header is None:
        head = [r.line for r in lines.orderBy("file", "at").limit(3).collect()]
        header = Header.parse(head)
        lines = lines.join(F.broadcast(lines.orderBy("file", "at").limit(3).select("file", "at")), ["file", "at"], "left_anti")
    return typed(lines, header, row)


def typed(lines: DataFrame, header: Header, row: Callable[[Column], Column] | None = None) -> DataFrame:
    """lines(line, file, at) as rec_no and typed fields; numbers come from counts of lines a part, not from one task."""
    split = row or (lambda c: F.when(c.startswith("["), F.array(c)).otherwise(F.split(c, ",")))
    block = lines.withColumn("part", F.shiftright("at", 33))
    from ..operators.ordered import running

    numbered = running(block.withColumn("one", F.lit(1)), [], "part", ["at"], {"n": ("count", "one")}) if "file" not in lines.columns else running(block.withColumn("one", F.lit(1)).withColumn("chunk", F.concat_ws("|", "file", F.lpad(F.col("part").cast("string"), 12, "0"))), [], "chunk", ["at"], {"n": ("count", "one")})
    cells = numbered.select((F.col("n") - 1).alias("rec_no"), split(F.col("line")).alias("cells"))
    return cells.select("rec_no", *[decode(F.get("cells", i), k).alias(n, metadata={"flag": f}) for i, (n, k, f) in enumerate(zip(header.names, header.kinds, header.flags))])


def control_columns(rows: DataFrame, header: Header, order: list[str], chunk: str) -> DataFrame:
    """rows plus reset (a reset field is 1, or a sequence field changed) and learn (the learn field is 1; true without one)."""
    from ..operators.ordered import trailing

    resets, sequences, learns = header.of_flag("reset"), header.of_flag("sequence"), header.of_flag("learn")
    out = rows
    if sequences:
        out = trailing(out, [], chunk, order, 1, {f"__{s}": (lambda w, s=s: F.lag(s).over(w)) for s in sequences}, sequences)
    changed = F.lit(False)
    for r in resets:
        changed |= F.coalesce(F.col(r) == 1, F.lit(False))
    for s in sequences:
        changed |= F.coalesce(F.col(s) != F.col(f"__{s}"), F.lit(False))
    learn = F.lit(True)
    for name in learns:
        learn &= F.coalesce(F.col(name) == 1, F.lit(False))
    return out.withColumns({"reset": changed, "learn": learn}).drop(*[f"__{s}" for s in sequences])


def database(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A query's rows; partitioning options make the read parallel."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def stream_of(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_a_batch: int = 1000) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(path)


class Publisher:
    """Pushes lines into a folder that stream_of reads: three header lines first, then records; each flush is a file."""

    def __init__(self, spark: SparkSession, folder: str, header: list[str]):
        self.spark, self.folder, self.header, self.lines, self.done = spark, folder, Header.parse(header), [], False

    def on_next(self, line: str) -> None:
        if self.done:
            raise RuntimeError("the publisher has completed")
        self.lines.append(line)

    def flush(self) -> None:
        if self.lines:
            cells = self.spark.createDataFrame([(i, x) for i, x in enumerate(self.lines)], "at long, line string").withColumn("part", F.lit(0))
            fields = [decode(F.get(F.split("line", ","), i), k).alias(n) for i, (n, k) in enumerate(zip(self.header.names, self.header.kinds))]
            cells.coalesce(1).select("at", *fields).write.mode("append").parquet(self.folder)
            self.lines = []

    def on_complete(self) -> None:
        self.flush()
        self.done = True


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """file and tag of every image of an XML list."""
    text = spark.read.option("wholetext", True).text(path)
    found = F.regexp_extract_all("value", F.lit("(?s)<image\\b[^>]*>"), F.lit(0))
    return text.select(F.explode(found).alias("tag")).select(F.regexp_extract("tag", "file=\"([^\"]*)\"", 1).alias("file"), F.regexp_extract("tag", "tag=\"([^\"]*)\"", 1).alias("tag"))


def pixels_to_bits(pixels: Column, threshold: int = 128) -> Column:
    """On-bits of dark grey values."""
    return F.filter(F.transform(pixels, lambda p, i: F.when(p < threshold, i)), lambda i: i.isNotNull())


def grayscale(red: Column, green: Column, blue: Column) -> Column:
    """0.3, 0.59 and 0.11 of the colours, in hundredths, halves up."""
    return F.floor((red * 30 + green * 59 + blue * 11 + 50) / 100).cast("int")


def metric_configuration(spark: SparkSession, path: str) -> DataFrame:
    """resource, metric, provider settings of a JSON file {resource: {metrics: {name: {...}}}}; the file is a small configuration."""
    rows = []
    for line in spark.read.option("wholetext", True).text(path).collect():
        for resource, body in json.loads(line.value).items():
            rows += [(resource, name, json.dumps(settings)) for name, settings in body.get("metrics", {}).items()]
    return spark.createDataFrame(rows, "resource string, metric string, settings string")


def sine_of(i: Column, rate: float, frequency: float = 1.0, amplitude: float = 1.0) -> Column:
    """amplitude * sin(2 pi f t), two decimals, t = i / rate."""
    return F.round(amplitude * F.sin(2 * F.pi() * frequency * i / rate), 2)


def sine(spark: SparkSession, n: int, rate: float, frequency: float = 1.0, amplitude: float = 1.0) -> DataFrame:
    """rec_no and the wave's value of n records."""
    return spark.range(n).select(F.col("id").alias("rec_no"), sine_of(F.col("id"), rate, frequency, amplitude).alias("value"))


def patterns(spark: SparkSession, n: int, width: int, w: int, seed: int = 42) -> DataFrame:
    """n random patterns of w on-bits."""
    from ..functions.encoders import random_bits

    return spark.range(n).select(F.col("id").alias("pattern"), random_bits(F.col("id"), w, width, seed).alias("bits"))


def sequences(spark: SparkSession, n: int, length: int, patterns_: int, seed: int = 42) -> DataFrame:
    """n sequences of random pattern numbers, each ended by -1 (a reset)."""
    one = F.transform(F.sequence(F.lit(0), F.lit(length)), lambda i: F.when(i == length, F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(patterns_)).cast("int")))
    return spark.range(n).select(F.col("id").alias("sequence"), F.posexplode(one).alias("step", "pattern"))


def clusters(spark: SparkSession, classes: int, each: int, dims: int, spread: float = 0.1, seed: int = 42) -> DataFrame:
    """Gaussian classes about random centres: id, category, x."""
    centre = lambda d: F.pmod(F.xxhash64(F.lit(seed), F.col("category"), d), F.lit(1000)) / 1000.0
    uniform = lambda d, k: (F.pmod(F.xxhash64(F.lit(seed + k), F.col("id"), d), F.lit(1_000_000)) + 1) / 1_000_001.0
    normal = lambda d: F.sqrt(-2 * F.log(uniform(d, 1))) * F.cos(2 * F.pi() * uniform(d, 2))
    rows = spark.range(classes * each).withColumn("category", F.floor(F.col("id") / each).cast("int"))
    return rows.select("id", "category", F.array(*[centre(F.lit(d)) + spread * normal(F.lit(d)) for d in range(dims)]).alias("x"))


def _observed(spark: SparkSession, path: str, **options) -> DataFrame:
    from .observed import observed

    return observed(spark, path, **options)


def _even_parts(spark: SparkSession, url: str, table: str, column: str, parts: int, **options) -> DataFrame:
    from .databases import even_parts

    return even_parts(spark, url, table, column, parts, **options)


def _twister(spark: SparkSession, seed: int, n: int, **options) -> DataFrame:
    from .twister import numbers

    return numbers(spark, seed, n, **options)


SOURCES: dict[str, Callable[..., DataFrame]] = {"file": csv_records, "observed": _observed, "database": database, "database parts": _even_parts, "twister": _twister, "stream": stream_of, "images": image_list, "metrics": metric_configuration, "sine": sine, "patterns": patterns, "sequences": sequences, "clusters": clusters}


def read(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind}; known: {sorted(SOURCES)}")
    return SOURCES[kind](spark, **options)
