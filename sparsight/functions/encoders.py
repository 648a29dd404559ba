"""Encoders of typed values into sparse bit arrays: parameters are derived on the driver, values are encoded by expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sdr import overlap


def _whole(x: Column) -> Column:
    """Truncated towards zero."""
    return x.cast("bigint")


@dataclass(frozen=True)
class ScalarEncoder:
    """w contiguous on-bits of n, placed by the value between low and high; periodic values wrap around."""

    w: int
    low: float
    high: float
    n: int
    resolution: float
    periodic: bool = False
    clip: bool = True

    @classmethod
    def of(cls, w: int, low: float, high: float, n: int = 0, radius: float = 0, resolution: float = 0, periodic: bool = False, clip: bool = True, forced: bool = False) -> ScalarEncoder:
        """Exactly one of n, radius and resolution says how fine the encoding is."""
        if w % 2 == 0:
            raise ValueError("w must be odd")
        if not forced and w < 21:
            raise ValueError("w below 21 needs forced=True")
        if low >= high or sum(x > 0 for x in (n, radius, resolution)) != 1:
            raise ValueError("low < high and one of n, radius, resolution are needed")
        width = high - low
        if n:
            if n <= w:
                raise ValueError("n must exceed w")
            resolution = width / n if periodic else width / (n - w)
        else:
            resolution = resolution or radius / w
            n = math.ceil(round((width if periodic else width + resolution) / resolution, 9)) + 2 * (0 if periodic else (w - 1) // 2)
        return cls(w, low, high, n, resolution, periodic, clip)

    @property
    def half(self) -> int:
        return (self.w - 1) // 2

    def _within(self, x: Column) -> Column:
        # greatest and least pass over nulls, which must stay null
        return F.when(x.isNotNull(), F.greatest(F.lit(float(self.low)), F.least(F.lit(float(self.high)), x))) if self.clip and not self.periodic else x

    def first_bit(self, x: Column) -> Column:
        """May be negative for periodic values; null outside of the range where nothing clips, and for NaN."""
        x = F.when(~F.isnan(x), x)
        if self.periodic:
            inside = F.when((x >= self.low) & (x < self.high), x)
            return _whole((inside - self.low) * self.n / (self.high - self.low)) - self.half
        inside = self._within(x) if self.clip else F.when((x >= self.low) & (x <= self.high), x)
        return _whole(((inside - self.low) + self.resolution / 2) / self.resolution)

    def bucket(self, x: Column) -> Column:
        first = self.first_bit(x)
        return F.pmod(first + self.half, F.lit(self.n)) if self.periodic else first

    def bits(self, x: Column) -> Column:
        """Sorted on-bits; empty for NaN, null and what lies outside."""
        first = self.first_bit(x)
        run = F.sequence(first, first + (self.w - 1))
        run = F.transform(run, lambda i: F.pmod(i, F.lit(self.n)).cast("int"))
        return F.coalesce(F.array_sort(run), F.array().cast("array<int>"))

    def bucket_value(self, bucket: Column) -> Column:
        return self.low + bucket * self.resolution + (self.resolution / 2 if self.periodic else 0.0)

    def buckets(self, spark: SparkSession) -> DataFrame:
        """bucket, value, bits of all buckets: the table that decoding looks up."""
        count = self.n if self.periodic else self.n - 2 * self.half
        rows = spark.range(count).select(F.col("id").alias("bucket"), self.bucket_value(F.col("id")).alias("value"))
        return rows.select("bucket", "value", self.bits(F.col("value") if not self.periodic else self.low + (F.col("bucket") + 0.5) * self.resolution).alias("bits"))

    def decode(self, rows: DataFrame, bits: str, key: str) -> DataFrame:
        """The bucket whose bits overlap a row's bits most, first of equals: key, bucket, value. The table is bounded by n.

        Different bit arrays are decoded once, so that rows are not spread over their bits and buckets.
        """
        asked = rows.select(F.col(bits).alias("__bits")).distinct()
        best = asked.select("__bits", F.explode("__bits").alias("bit")).join(F.broadcast(self.buckets(rows.sparkSession).select("bucket", "value", F.explode("bits").alias("bit"))), "bit")
        scored = best.groupBy("__bits", "bucket", "value").count()
        found = scored.groupBy("__bits").agg(F.max_by(F.struct("bucket", "value"), F.struct("count", -F.col("bucket"))).alias("b"))
        return rows.select(key, F.col(bits).alias("__own")).join(found, F.col("__own") == F.col("__bits")).select(key, "b.bucket", "b.value")

    def runs(self, bits: Column) -> Column:
        """Value ranges that a bit array stands for: runs of on-bits, gaps up to half a width closed, as array of (low, high)."""
        start = F.array().cast("array<struct<first:int,last:int>>")
        joined = F.aggregate(
            F.array_sort(bits), start,
            lambda s, b: F.when((F.size(s) > 0) & (b - F.get(s, F.size(s) - 1).last <= self.half + 1), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.get(s, F.size(s) - 1).first.alias("first"), b.alias("last"))))).otherwise(
                F.concat(s, F.array(F.struct(b.alias("first"), b.alias("last"))))
            ),
        )
        pad = 0 if self.periodic else self.half

        def value(bit: Column) -> Column:
            return F.greatest(F.lit(float(self.low)), F.least(F.lit(float(self.high)), (bit - pad) * self.resolution + self.low))

        inner = lambda r: F.struct(value(F.when(r.last - r.first + 1 > self.w, r.first + self.half).otherwise(F.floor((r.first + r.last) / 2))).alias("low"), value(F.when(r.last - r.first + 1 > self.w, r.last - self.half).otherwise(F.floor((r.first + r.last) / 2))).alias("high"))
        return F.transform(joined, inner)


    def description(self, bits: Column) -> Column:
        """The value ranges that a bit array stands for as text: low-high, or one number where they are equal, two decimals."""
        number = lambda x: F.format_string("%.2f", x)
        return F.concat_ws(", ", F.transform(self.runs(bits), lambda r: F.when(r.low == r.high, number(r.low)).otherwise(F.concat_ws("-", number(r.low), number(r.high)))))


def settings(low: Column, high: Column, w: int, n: int) -> Column:
    """What follows from a range by rows, as a struct of an encoder's settings: fractions in millionths; equal bounds are one apart."""
    top = F.when(high == low, low + 1).otherwise(high)
    millionths = lambda x: F.floor(x * 1_000_000 + 0.5).cast("bigint")
    return F.struct(
        F.lit(w).alias("w"), F.lit(n).alias("n"), F.lit((w - 1) // 2).alias("padding"), millionths(low).alias("low_e6"), millionths(top).alias("high_e6"),
        millionths((top - low) / (n - w)).alias("resolution_e6"), F.lit(False).alias("periodic"),
    )


@dataclass(frozen=True)
class LogEncoder:
    """A scalar encoder of log10 of the clipped value."""

    scalar: ScalarEncoder
    low: float
    high: float

    @classmethod
    def of(cls, w: int = 5, low: float = 1.0, high: float = 10_000.0, n: int = 0, radius: float = 0, resolution: float = 0) -> LogEncoder:
        low = max(low, 1e-7)
        return cls(ScalarEncoder.of(w, math.log10(low), math.log10(high), n, radius, resolution, forced=True), low, high)

    def scaled(self, x: Column) -> Column:
        return F.when(x.isNotNull(), F.log10(F.greatest(F.lit(self.low), F.least(F.lit(self.high), x))))

    def bucket(self, x: Column) -> Column:
        return self.scalar.bucket(self.scaled(x))

    def bits(self, x: Column) -> Column:
        return self.scalar.bits(self.scaled(x))

    def bucket_value(self, bucket: Column) -> Column:
        return F.pow(F.lit(10.0), self.scalar.bucket_value(bucket))

    def closeness(self, expected: Column, actual: Column) -> Column:
        return F.lit(1.0) - F.least(F.abs(self.scaled(expected) - self.scaled(actual)) / (math.log10(self.high) - math.log10(self.low)), F.lit(1.0))


def closeness(expected: Column, actual: Column, fractional: bool = True) -> Column:
    error = F.abs(expected - actual)
    return F.greatest(F.lit(0.0), 1 - error / F.when(F.greatest(expected, actual) == 0, F.lit(1.0)).otherwise(F.greatest(expected, actual))) if fractional else error


@dataclass(frozen=True)
class RandomScalarEncoder:
    """Buckets of a resolution around an offset, each with random on-bits such that near buckets share many and far ones few."""

    resolution: float
    w: int = 21
    n: int = 400
    seed: int = 42
    max_buckets: int = 1000
    max_overlap: int = 2

    def bucket(self, x: Column, offset: Column) -> Column:
        """Half-even rounding; null for null and NaN."""
        mid = self.max_buckets // 2
        steps = F.rint(F.abs(x - offset) / self.resolution) * F.signum(x - offset)
        return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0), F.least(F.lit(self.max_buckets - 1), (mid + steps).cast("bigint"))))

    def sequence(self) -> list[int]:
        """Bits of which those of bucket k are the w from place k on: one sequence holds all buckets.

        Near buckets share w minus their distance, as no bit comes again within 2 w - 1 places; far ones share max_overlap
        at most. It grows from the middle to both ends. For each new bucket, what it shares with every other is known from
        the bits it keeps; a bit that comes in adds one for the w buckets around each earlier place of it, so that a try
        takes no longer the more buckets there are.
        """
        if self.n <= 6 * self.w:
            raise ValueError("n must exceed 6 w")
        rng, w, mid = np.random.default_rng(self.seed), self.w, self.max_buckets // 2
        bits = np.full(self.max_buckets + w - 1, -1, dtype=np.int64)
        bits[mid : mid + w] = rng.permutation(self.n)[:w]
        low, high = mid, mid + w  # places that are known
        for up in (True, False):
            places: dict[int, list[int]] = {}
            for p in range(low, high):
                places.setdefault(int(bits[p]), []).append(p)
            # what the newest bucket shares with each known bucket, by place; near ones aren't asked for
            shared = np.zeros(self.max_buckets + 2 * w, dtype=np.int64)
            newest = high - w if up else low

            def count(bit: int, by: int):
                for p in places.get(bit, ()):
                    shared[p + 1 : p + 1 + w] += by  # buckets p - w + 1 to p, shifted by w

            for b in bits[newest : newest + w].tolist():
                count(b, 1)
            while newest < self.max_buckets - 1 if up else newest > 0:
                newest += 1 if up else -1
                gone, place = (newest - 1, newest + w - 1) if up else (newest + w, newest)
                count(int(bits[gone]), -1)
                recent = bits[max(0, newest - w + 1) : newest + w - 1] if up else bits[newest + 1 : newest + 2 * w - 1]
                barred = set(recent.tolist())
                for b in rng.permutation(self.n).tolist():
                    if b not in barred and all(shared[p + 1 : p + 1 + w].max() < self.max_overlap for p in places.get(b, ())):
                        break
                else:
                    raise ValueError("no bit keeps the overlap rule; n is too small for so many buckets")
                bits[place] = b
                places.setdefault(b, []).append(place)
                count(b, 1)
            low, high = (low, self.max_buckets + w - 1) if up else (0, high)
        return bits.tolist()

    def table(self, radius: int | None = None) -> dict[int, list[int]]:
        """bucket -> sorted on-bits, of all buckets or those within radius of the middle."""
        line, mid = self.sequence(), self.max_buckets // 2
        kept = range(self.max_buckets) if radius is None else range(max(0, mid - radius), min(self.max_buckets, mid + radius + 1))
        return {k: sorted(line[k : k + self.w]) for k in kept}

    def bits(self, bucket: Column) -> Column:
        """Sorted on-bits of a bucket, a slice of one constant; empty for null."""
        line = F.split(F.lit(",".join(map(str, self.sequence()))), ",").cast("array<int>")
        return F.coalesce(F.array_sort(F.slice(line, (bucket + 1).cast("int"), self.w)), F.array().cast("array<int>"))

    def _allowed(self, i: int, j: int, a: list[int], b: list[int]) -> bool:
        shared = len(set(a) & set(b))
        return shared == self.w - abs(i - j) if abs(i - j) < self.w else shared <= self.max_overlap


def random_bits(key: Column, w: int, n: int, seed: int = 42) -> Column:
    """w distinct bits of n that a key's hashes order first: the same for equal keys, whatever was seen before."""
    ranked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i")))
    return F.array_sort(F.transform(F.slice(F.array_sort(ranked), 1, w), lambda s: s.i))


def least_match(w: int, n: int) -> int:
    """How many bits two random encodings share at least if they agree by more than chance."""
    return max((w * w // n + w) // 2, w - 3)


def category_match(a: Column, b: Column, w: int, n: int) -> Column:
    """Whether two random encodings agree by more than chance."""
    return overlap(a, b) >= least_match(w, n)


def categories_of(rows: DataFrame, bits: str, known: DataFrame, w: int, n: int) -> DataFrame:
    """rows plus category: every one of known(category, bits) that a row's bits agree with by more than chance.

    Different encodings are decoded once, and meet the known ones by the bits that they share.
    """
    asked = rows.select(F.col(bits).alias("__bits")).distinct()
    held = known.select("category", F.explode("bits").alias("__bit"))
    met = asked.select("__bits", F.explode("__bits").alias("__bit")).join(held, "__bit").groupBy("__bits", "category").agg(F.count(F.lit(1)).alias("__n"))
    found = met.where(F.col("__n") >= least_match(w, n)).select("__bits", "category")
    return rows.join(found, F.col(bits) == F.col("__bits")).drop("__bits")


# -- dates -----------------------------------------------------------------------------------------------------------
def seconds_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("bigint")


def season(ts: Column) -> Column:
    return (F.dayofyear(ts) - 1).cast("int")


def weekday(ts: Column) -> Column:
    """0 is Monday."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    """From Friday 18:00 on."""
    return (F.weekday(ts) + seconds_of_day(ts) / 86400.0 >= 4.75).cast("int")


def holiday_ramp(ts: Column, month: int = 12, day: int = 25) -> Column:
    """1 on the day; falls to 0 over the day after and rises from 0 over the day before."""
    start = F.make_timestamp(F.year(ts), F.lit(month), F.lit(day), F.lit(0), F.lit(0), F.lit(0))
    after = (F.unix_timestamp(ts) - F.unix_timestamp(start)).cast("double")
    return F.when((after >= 0) & (after < 86400), 1.0).when((after >= 86400) & (after < 172800), 1 - (after - 86400) / 86400).when((after < 0) & (after > -86400), 1 + after / 86400).otherwise(0.0)


def parse_timestamp(text: Column, *formats: str) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


@dataclass(frozen=True)
class DateEncoder:
    """Sub-encodings of a time side by side; a width of 0 leaves one out."""

    season_w: int = 21
    weekday_w: int = 21
    weekend_w: int = 21
    time_w: int = 21
    holiday_w: int = 0

    def parts(self, ts: Column) -> list[tuple[Column, ScalarEncoder]]:
        hours = seconds_of_day(ts) / 3600.0
        found = [
            (season(ts).cast("double"), self.season_w, 0, 366, 91.5, True),
            (weekday(ts).cast("double"), self.weekday_w, 0, 7, 1.0, True),
            (is_weekend(ts).cast("double"), self.weekend_w, 0, 1, 1.0, False),
            (holiday_ramp(ts), self.holiday_w, 0, 1, 1.0, False),
            (hours, self.time_w, 0, 24, 4.0, True),
        ]
        return [(value, ScalarEncoder.of(w, low, high, radius=radius, periodic=periodic, forced=True)) for value, w, low, high, radius, periodic in found if w]

    @property
    def width(self) -> int:
        return sum(e.n for _, e in self.parts(F.lit(None).cast("timestamp")))

    def bits(self, ts: Column) -> Column:
        parts = self.parts(ts)
        return F.concat(*[_shifted(e.bits(v), sum(f.n for _, f in parts[:i])) for i, (v, e) in enumerate(parts)])

    def buckets(self, ts: Column) -> Column:
        return F.array(*[e.bucket(v) for v, e in self.parts(ts)])


# -- places ----------------------------------------------------------------------------------------------------------
EARTH = 6_378_137.0


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH, EARTH * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def radius_for_speed(speed: Column, timestep: float, scale: float, w: int) -> Column:
    """Overlap of successive positions, at least what w bits need."""
    return F.greatest(F.ceil(speed * timestep / scale * 1.5 / 2), F.lit(math.ceil((math.sqrt(w) - 1) / 2))).cast("int")


def portable_hash(seed: int, *keys: Column) -> Column:
    """48 bits of the MD5 of a seed and keys, as a whole number: the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 12), 16, 10).cast("bigint")


def coordinate_bits(x: Column, y: Column, radius: Column, w: int, n: int, seed: int = 42, order=None) -> Column:
    """The w neighbours in the box around (x, y) that hash highest, each mapped to a bit; order(x, y) may replace the hash."""
    order = order or (lambda a, b: portable_hash(seed, a, b))
    axis = lambda c: F.sequence(c - radius, c + radius)
    box = F.flatten(F.transform(axis(x), lambda a: F.transform(axis(y), lambda b: F.struct((-F.pmod(order(a, b), F.lit(2**62))).alias("o"), a.alias("x"), b.alias("y")))))
    return F.array_sort(F.array_distinct(F.transform(F.slice(F.array_sort(box), 1, w), lambda s: F.pmod(portable_hash(seed + 1, s.x, s.y), F.lit(n)).cast("int"))))


def geo_bits(lon: Column, lat: Column, speed: Column, w: int, n: int, scale: float = 30.0, timestep: float = 60.0, seed: int = 42) -> Column:
    """Bits of a place and a speed: the projected position in units of scale, with the radius that the speed needs."""
    x, y = mercator(lon, lat)
    return coordinate_bits(F.floor(x / scale), F.floor(y / scale), radius_for_speed(speed, timestep, scale, w).cast("bigint"), w, n, seed)


# -- several fields --------------------------------------------------------------------------------------------------
def multi(encodings: list[tuple[str, Column, int]]) -> Column:
    """Bits of several fields side by side, (name, bits, width) each, in order of names."""
    parts, at = [], 0
    for _, bits, width in sorted(encodings, key=lambda e: e[0]):
        parts.append(_shifted(bits, at))
        at += width
    return F.concat(*parts)


def _shifted(bits: Column, by: int) -> Column:
    return F.transform(bits, lambda b: b + by)


def pass_through(bits: Column, width: int, w: int | None = None) -> Column:
    """The bits themselves; null where one lies outside of the width or their number isn't w."""
    good = F.forall(bits, lambda b: (b >= 0) & (b < width))
    return F.when(good & (F.lit(True) if w is None else F.size(bits) == w), F.array_sort(bits))


# -- by name ---------------------------------------------------------------------------------------------------------
def delta(value: Column, before: Column) -> Column:
    """What a delta encoder encodes: the step from the value before; 0 for the first."""
    return value - F.coalesce(before, value)


@dataclass(frozen=True)
class Field:
    """One field of a record: the encoder's kind, the column that holds its value, and the encoder's settings."""

    name: str
    kind: str
    column: str
    settings: tuple = ()


#: Kind -> (settings, names of columns) -> (bits, width). Places and coordinates read two columns, or three with a speed.
KINDS = {}


def _kind(*names: str):
    def add(make):
        KINDS.update(dict.fromkeys(names, make))
        return make

    return add


@_kind("scalar", "adaptive-scalar", "delta")
def _scalar(s: dict, columns: list[str]):
    """The adaptive kind is given the range seen so far as low and high; the delta kind a column of differences."""
    e = ScalarEncoder.of(**s)
    return e.bits(F.col(columns[0]).cast("double")), e.n


@_kind("log")
def _log(s: dict, columns: list[str]):
    e = LogEncoder.of(**s)
    return e.bits(F.col(columns[0]).cast("double")), e.scalar.n


@_kind("category")
def _category(s: dict, columns: list[str]):
    """w bits for each of the categories listed, the first w for what isn't."""
    known = F.array(*map(F.lit, s["categories"]))
    at = F.coalesce(F.array_position(known, F.col(columns[0])), F.lit(0)).cast("int") * s["w"]
    return F.sequence(at, at + (s["w"] - 1)), s["w"] * (len(s["categories"]) + 1)


@_kind("sdr-category")
def _sdr_category(s: dict, columns: list[str]):
    return random_bits(F.col(columns[0]), s["w"], s["n"], s.get("seed", 42)), s["n"]


@_kind("random-scalar")
def _random(s: dict, columns: list[str]):
    """All buckets have bits; a radius of them, once a limit, is accepted and changes nothing."""
    e = RandomScalarEncoder(**{k: v for k, v in s.items() if k not in ("offset", "radius")})
    return e.bits(e.bucket(F.col(columns[0]).cast("double"), F.lit(float(s["offset"])))), e.n


@_kind("date")
def _date(s: dict, columns: list[str]):
    e = DateEncoder(**s)
    return e.bits(F.col(columns[0])), e.width


@_kind("coordinate")
def _coordinate(s: dict, columns: list[str]):
    x, y = (F.col(c).cast("bigint") for c in columns)
    return coordinate_bits(x, y, F.lit(s["radius"]), s["w"], s["n"], s.get("seed", 42)), s["n"]


@_kind("geospatial")
def _geospatial(s: dict, columns: list[str]):
    return geo_bits(*(F.col(c).cast("double") for c in columns), **s), s["n"]


@_kind("pass-through", "sparse-pass-through", "sdr-pass-through")
def _pass(s: dict, columns: list[str]):
    """The sparse kinds hold positions; the dense one 0 and 1."""
    bits = F.col(columns[0]) if not s.get("dense") else F.filter(F.transform(columns[0], lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return pass_through(bits, s["n"], s.get("w")), s["n"]


@_kind("boolean")
def _boolean(s: dict, columns: list[str]):
    at = F.coalesce(F.col(columns[0]).cast("int"), F.lit(0)) * s["w"]
    return F.sequence(at, at + (s["w"] - 1)), 2 * s["w"]


def scalar_space(space: str) -> str:
    """The kind of encoder of a space of values: absolute ones adapt to their range, deltas are encoded as such."""
    known = {"absolute": "adaptive-scalar", "delta": "delta"}
    if space not in known:
        raise ValueError(f"unknown space {space}; known: {sorted(known)}")
    return known[space]


def record_bits(fields: list[Field]) -> tuple[Column, int]:
    """(bits, width) of a record: the encodings of its fields side by side, in order of names."""
    parts = []
    for f in fields:
        if f.kind not in KINDS:
            raise ValueError(f"unknown encoder {f.kind}; known: {sorted(KINDS)}")
        parts.append((f.name, *KINDS[f.kind](dict(f.settings), f.column.split(","))))
    return multi(parts), sum(width for _, _, width in parts)
