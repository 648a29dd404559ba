"""Queries over arrays and single values: kernels, ranges, matrices, seeded numbers, encodings, inhibition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..functions import likelihood as L
from ..functions import sdr as A
from ..operators import columns as C
from ..sources.records import grayscale, pixels_to_bits
from .common import events, fixed, fixed_sql, table, text
from .series import HOURLY, LOG, SCALAR, _HOURS, _scalar_sql


def _arrays(spark, sf) -> DataFrame:
    """Two small whole-number arrays of every part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    whole = lambda *xs: F.array(*[x.cast("bigint") for x in xs])
    return table(spark, sf, "part").select("p_partkey", whole(size, key % 7, key % 5 - 2, size % 3).alias("a"), whole(key % 3, F.lit(2), size % 4, F.lit(-4)).alias("b"))


_AB = "ab AS (SELECT p_partkey, [p_size, p_partkey % 7, p_partkey % 5 - 2, p_size % 3]::BIGINT[] AS a, [p_partkey % 3, 2, p_size % 4, -4]::BIGINT[] AS b FROM part)"


def _all(a: Column) -> Column:
    return text(F.transform(a, lambda x: fixed(x)))


def _all_sql(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: {fixed_sql('x')}), ',')"


def _list_sql(a: str) -> str:
    return f"array_to_string({a}, ',')"


def array_rounded_divide(spark, sf) -> DataFrame:
    """Quotients at one decimal, halves away from zero; divisors are powers of two, so that halves are exact."""
    a = F.transform("a", lambda x: x.cast("double"))
    b = F.transform("b", lambda x: F.when(x % 3 == 0, 0.0).when(x % 3 == 1, 4.0).otherwise(8.0))
    return _arrays(spark, sf).select("p_partkey", _all(A.rounded_divide(a, b, 1)).alias("quotients_e6"))


def array_powers(spark, sf) -> DataFrame:
    a = F.transform("a", lambda x: x.cast("double"))
    return _arrays(spark, sf).select("p_partkey", text(A.absolute(F.col("a"))).alias("sizes"), _all(A.power(a, 2)).alias("squares_e6"), _all(A.exp(F.transform(a, lambda x: x / 16))).alias("exps_e6"), fixed(A.mean(a)).alias("mean_e6"))


def matrix_products(spark, sf) -> DataFrame:
    m = lambda c: A.reshape(F.transform(c, lambda x: x.cast("double")), 2)
    return _arrays(spark, sf).select(
        "p_partkey", _all(A.matrix_vector(m("a"), F.transform(F.slice("b", 1, 2), lambda x: x.cast("double")))).alias("by_vector_e6"),
        _all(F.flatten(A.matrix_matrix(m("a"), m("b")))).alias("by_matrix_e6"), text(F.flatten(A.transpose(A.reshape(F.col("a"), 2)))).alias("transposed"),
    )


_MATRICES = f"""WITH {_AB} SELECT p_partkey,
  {_all_sql('[a[1] * b[1] + a[2] * b[2], a[3] * b[1] + a[4] * b[2]]')} AS by_vector_e6,
  {_all_sql('[a[1] * b[1] + a[2] * b[3], a[1] * b[2] + a[2] * b[4], a[3] * b[1] + a[4] * b[3], a[3] * b[2] + a[4] * b[4]]')} AS by_matrix_e6,
  {_list_sql('[a[1], a[3], a[2], a[4]]')} AS transposed FROM ab"""


def ranges(spark, sf) -> DataFrame:
    low, high = F.col("a")[1], F.col("a")[1] + F.col("b")[0]
    return _arrays(spark, sf).select("p_partkey", text(F.sequence(low, high)).alias("whole"), _all(A.float_range(low.cast("double"), high.cast("double"), 0.25)).alias("steps_e6"), _all(A.linear_range(low.cast("double"), high.cast("double"), 5)).alias("linear_e6"))


_RANGES = f"""WITH {_AB} SELECT p_partkey, {_list_sql('range(a[2], a[2] + b[1] + 1)')} AS whole,
  {_all_sql('list_transform(range(0, 4 * b[1]), lambda i: a[2] + i * 0.25)')} AS steps_e6, {_all_sql('list_transform(range(0, 5), lambda i: a[2] + b[1] * i / 4.0)')} AS linear_e6 FROM ab"""


def array_set_values(spark, sf) -> DataFrame:
    a = F.col("a")
    between = F.transform(a, lambda x, i: F.when((i >= 1) & (i < 3), F.lit(9)).otherwise(x))
    return _arrays(spark, sf).select("p_partkey", text(A.replace_at(a, F.array(F.lit(0), F.lit(3)), 7)).alias("at"), text(between).alias("between"), text(A.where_set(a, lambda x: x == 1, -1)).alias("replaced"))


_SETS = f"""WITH {_AB} SELECT p_partkey, {_list_sql('[7, a[2], a[3], 7]')} AS at, {_list_sql('[a[1], 9, 9, a[4]]')} AS between,
  {_list_sql('list_transform(a, lambda x: CASE WHEN x = 1 THEN -1 ELSE x END)')} AS replaced FROM ab"""


def array_raised(spark, sf) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _arrays(spark, sf).select("p_partkey", text(A.raise_by(a, 3)).alias("all"), text(A.raise_by(a, 3, F.array(F.lit(1), F.lit(2)))).alias("some"), text(A.add(a, b)).alias("each"))


_RAISED = f"""WITH {_AB} SELECT p_partkey, {_list_sql('list_transform(a, lambda x: x + 3)')} AS "all", {_list_sql('[a[1], a[2] + 3, a[3] + 3, a[4]]')} AS some,
  {_list_sql('list_transform(list_zip(a, b), lambda p: p[1] + p[2])')} AS each FROM ab"""


def array_shapes(spark, sf) -> DataFrame:
    """Reversed, without the first, rotated, cut into rows and flattened again, and positions as coordinates and back."""
    a = F.col("a")
    at = A.coordinates(F.col("p_partkey") % 24, [2, 3, 4])
    return _arrays(spark, sf).select(
        "p_partkey", text(F.reverse(a)).alias("backwards"), text(A.tail(a)).alias("tail"), text(A.rotate(a, 1)).alias("rotated"), text(F.flatten(A.reshape(a, 3))).alias("flat"),
        F.size(A.reshape(a, 3)).alias("n_rows"), text(at).alias("at"), A.flat_index(at, [2, 3, 4]).cast("bigint").alias("index"),
    )


_SHAPES = f"""WITH {_AB} SELECT p_partkey, {_list_sql('list_reverse(a)')} AS backwards, {_list_sql('a[2:]')} AS tail, {_list_sql('[a[4], a[1], a[2], a[3]]')} AS rotated, {_list_sql('a')} AS flat,
  2 AS n_rows, {_list_sql('[p_partkey % 24 // 12, p_partkey % 12 // 4, p_partkey % 4]')} AS at, p_partkey % 24 AS index FROM ab"""


def seeded_shuffle(spark, sf) -> DataFrame:
    """Each part's array in a seeded order, and two of its elements without replacement."""
    a, key = F.col("a"), F.col("p_partkey")
    return _arrays(spark, sf).select("p_partkey", text(A.shuffled(a, 42, key)).alias("shuffled"), text(A.sample(a, 2, 42, key)).alias("sampled"))


_ORDER = "list_transform(list_sort(list_transform(range(0, 4), lambda i: {'h': md5(concat_ws(':', 42, p_partkey, i)), 'i': i})), lambda s: a[s.i + 1])"
_SHUFFLED = f"WITH {_AB}, s AS (SELECT p_partkey, {_ORDER} AS s FROM ab) SELECT p_partkey, {_list_sql('s')} AS shuffled, {_list_sql('s[1:2]')} AS sampled FROM s"


def seeded_numbers(spark, sf) -> DataFrame:
    key = F.col("p_partkey")
    return _arrays(spark, sf).select("p_partkey", fixed(A.uniform(7, key)).alias("uniform_e6"), F.round(A.gaussian(7, key), 4).cast("decimal(9,4)").cast("string").alias("normal"), A.choice(F.col("a"), 7, key).alias("chosen"))


def _uniform_sql(seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || p_partkey), 1, 12))::BIGINT / {float(2**48)})"


_NUMBERS = f"""WITH {_AB} SELECT p_partkey, {fixed_sql(_uniform_sql('7'))} AS uniform_e6,
  CAST(CAST(round(sqrt(-2 * ln(1 - {_uniform_sql('7a')})) * cos(2 * pi() * {_uniform_sql('7b')}), 4) AS DECIMAL(9, 4)) AS VARCHAR) AS normal,
  a[CAST(floor({_uniform_sql('7')} * 4) AS BIGINT) + 1] AS chosen FROM ab"""


def array_interleave(spark, sf) -> DataFrame:
    """Two arrays element by element, and four bytes as one number."""
    a, b = F.col("a"), F.col("b")
    octets = F.transform(a, lambda x: F.pmod(x, F.lit(256)))
    return _arrays(spark, sf).select("p_partkey", text(A.interleave(a, b)).alias("mixed"), F.aggregate(octets, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x).alias("merged"))


_MIXED = f"""WITH {_AB} SELECT p_partkey, {_list_sql('[a[1], b[1], a[2], b[2], a[3], b[3], a[4], b[4]]')} AS mixed,
  ((((a[1] + 256) % 256) * 256 + (a[2] + 256) % 256) * 256 + (a[3] + 256) % 256) * 256 + (a[4] + 256) % 256 AS merged FROM ab"""


def json_roundtrip(spark, sf) -> DataFrame:
    """Nested values through their JSON text and back."""
    row = F.struct(F.col("p_partkey").alias("key"), F.col("a").alias("a"), F.col("b").alias("b"))
    read = F.from_json(F.to_json(row), "key bigint, a array<bigint>, b array<bigint>")
    return _arrays(spark, sf).select(F.to_json(F.struct("a")).alias("json"), read.alias("r")).select(F.col("r.key").alias("p_partkey"), "json", text(F.col("r.b")).alias("b"))


def matrix_or_all_any(spark, sf) -> DataFrame:
    """The union of the bits of a brand's parts, and whether it holds all, or any, of three probes."""
    bits = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("int").alias("bit")).groupBy("p_brand").agg(F.array_sort(F.collect_set("bit")).alias("bits"))
    probe = F.array(F.lit(1), F.lit(2), F.lit(3))
    return bits.select("p_brand", text(F.col("bits")).alias("bits"), A.contains_all(F.col("bits"), probe).alias("has_all"), A.contains_any(F.col("bits"), probe).alias("has_any"))


def digits_to_bits(spark, sf) -> DataFrame:
    """A row of digits as text, read as the on-bits of a vector."""
    digits = F.concat_ws(", ", *[F.shiftright("p_partkey", k).bitwiseAND(1).cast("string") for k in range(8)])
    dense = A.digits_to_bits(digits)
    return table(spark, sf, "part").select("p_partkey", text(dense).alias("dense"), text(A.to_sparse(dense)).alias("bits"))


def pass_through_bits(spark, sf) -> DataFrame:
    """Bits that are encodings already: sorted, or null where one lies outside of the width or their number is wrong."""
    bits = F.array(F.col("p_size").cast("int"), (F.col("p_partkey") % 11 + 50).cast("int"))
    dense = F.array(*[F.shiftright("p_partkey", k).bitwiseAND(1).cast("int") for k in range(6)])
    rows = table(spark, sf, "part").select("p_partkey", bits.alias("bits"), dense.alias("dense"))
    sparse, _ = E.KINDS["sparse-pass-through"]({"n": 58, "w": 2}, ["bits"])
    whole, _ = E.KINDS["pass-through"]({"n": 6, "dense": True}, ["dense"])
    return rows.select("p_partkey", text(sparse).alias("sparse"), sparse.isNull().alias("refused"), text(whole).alias("dense"))


def log_closeness(spark, sf) -> DataFrame:
    """How near a value and twice it lie on the log scale."""
    v = F.col("value")
    return events(spark, sf).select("event_id", fixed(LOG.closeness(v, v * 2)).alias("close_e6"))


def _log_sql(x: str) -> str:
    return f"log10(greatest(1.0, least(10000.0, {x})))"


def range_description(spark, sf) -> DataFrame:
    """A value's encoding as the text of the range it stands for."""
    return events(spark, sf).select("event_id", SCALAR.description(SCALAR.bits(F.col("value"))).alias("description"))


_DESCRIBED = f"SELECT event_id, printf('%.2f', greatest(0.0, least(500.0, {_scalar_sql('value')} * {SCALAR.resolution!r}))) AS description FROM events"


def parse_dates(spark, sf) -> DataFrame:
    """Times written in one of two ways, read by the first format that fits; null where none does."""
    written = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "M/d/yy H:mm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("no time"))
    return events(spark, sf).select("event_id", F.unix_timestamp(E.parse_timestamp(written, "M/d/yy H:mm", "yyyy-MM-dd HH:mm:ss")).alias("at"))


def record_bits(spark, sf) -> DataFrame:
    """Records of several fields through the encoder registry: a scalar, a log, a category, a flag and a time of day."""
    fields = [
        E.Field("amount", "scalar", "value", (("w", 21), ("low", 0), ("high", 500), ("n", 421))),
        E.Field("order", "log", "value", (("w", 5), ("low", 1.0), ("high", 10_000.0), ("n", 105))),
        E.Field("kind", "category", "event_type", (("w", 3), ("categories", ("click", "error", "purchase")))),
        E.Field("paid", "boolean", "paid", (("w", 3),)),
        E.Field("when", "date", "ts", (("season_w", 0), ("weekday_w", 0), ("weekend_w", 0), ("time_w", 21))),
    ]
    bits, width = E.record_bits(fields)
    rows = events(spark, sf).withColumn("paid", F.col("event_type") == "purchase")
    return rows.select("event_id", F.lit(width).alias("width"), text(F.array_sort(bits)).alias("bits"))


_LOG_FIRST = f"CAST(trunc(({_log_sql('value')} + {LOG.scalar.resolution!r} / 2) / {LOG.scalar.resolution!r}) AS BIGINT)"
_RECORD = f"""WITH f AS (SELECT event_id, {_scalar_sql('value')} AS a, 421 + 3 * CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS k,
  433 + {_LOG_FIRST} AS o, 538 + 3 * CAST(event_type = 'purchase' AS INT) AS p, CAST(trunc({_HOURS} * 126 / 24.0) AS BIGINT) AS t FROM events)
SELECT event_id, 670 AS width, array_to_string(list_sort(list_concat(range(a, a + 21), range(k, k + 3), range(o, o + 5), range(p, p + 3), list_transform(range(t - 10, t + 11), lambda i: 544 + (i + 126) % 126))), ',') AS bits FROM f"""


def pixel_bits(spark, sf) -> DataFrame:
    """Grey values of four coloured points, and the positions of the dark ones."""
    key = F.col("p_partkey")
    point = lambda k: grayscale((key * 37 + k * 11) % 256, (key * 13 + k * 90) % 256, F.col("p_size") * 5 % 256)
    grey = F.array(*map(point, range(4)))
    return table(spark, sf, "part").select("p_partkey", text(grey).alias("grey"), text(pixels_to_bits(grey)).alias("bits"))


_GREY = "list_transform(range(0, 4), lambda k: CAST((30 * ((p_partkey * 37 + k * 11) % 256) + 59 * ((p_partkey * 13 + k * 90) % 256) + 11 * (p_size * 5 % 256) + 50) // 100 AS INT))"
_PIXELS = f"WITH g AS (SELECT p_partkey, {_GREY} AS g FROM part) SELECT p_partkey, {_list_sql('g')} AS grey, {_list_sql('list_filter(range(0, 4), lambda i: g[i + 1] < 128)')} AS bits FROM g"


def local_inhibition(spark, sf) -> DataFrame:
    """Winners among twelve columns on a line, each against its neighbours two to either side."""
    overlaps = F.array(*[(F.col("p_partkey") * (k + 3) + F.col("p_size") * k) % 9 for k in range(12)])
    return table(spark, sf, "part").select("p_partkey", text(C.inhibit_locally(overlaps, 2, 0.3)).alias("winners"))


_NEAR = "o[greatest(i - 2, 0) + 1 : least(i + 2, 11) + 1]"
_LOCAL = f"""WITH v AS (SELECT p_partkey, list_transform(range(0, 12), lambda k: (p_partkey * (k + 3) + p_size * k) % 9) AS o FROM part)
SELECT p_partkey, array_to_string(list_filter(range(0, 12), lambda i: o[i + 1] > 0 AND len(list_filter({_NEAR}, lambda y: y > o[i + 1])) < floor(0.5 + 0.3 * len({_NEAR}))), ',') AS winners FROM v"""


def inhibition_radius(spark, sf) -> DataFrame:
    """From brands as columns and sizes as the inputs that they are connected to."""
    connected = table(spark, sf, "part").select(F.col("p_brand").alias("col"), F.col("p_size").alias("bit"))
    return C.inhibition_radius(connected, 25, 50)


def least_duty(spark, sf) -> DataFrame:
    """Least duty cycles of nations as columns, by all and by those within two of each."""
    duty = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("col")).agg((F.count(F.lit(1)) / 1000).alias("duty"))
    local = C.least_duty(duty, 0.1, 2).select("col", F.col("least").alias("local"))
    return C.least_duty(duty, 0.1).join(local, "col").select("col", fixed(F.col("least")).alias("global_e6"), fixed(F.col("local")).alias("local_e6"))


_DUTY = f"""WITH d AS (SELECT s_nationkey AS col, count(*) / 1000 AS duty FROM supplier GROUP BY 1)
SELECT a.col, {fixed_sql('(SELECT max(duty) FROM d) * 0.1')} AS global_e6, {fixed_sql('max(b.duty) * 0.1')} AS local_e6 FROM d a JOIN d b ON b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY a.col"""


def estimator_validity(spark, sf) -> DataFrame:
    """Whether what was estimated for a user can be used: there is a moving average, and no moment is zero."""
    rows = events(spark, sf).groupBy("user_id").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.when(F.count("value") >= 3, F.max("value")).alias("average"))
    return rows.select("user_id", L.estimator_is_valid(F.col("mean"), F.col("variance"), F.col("average")).alias("valid"))


def anomaly_modes(spark, sf) -> DataFrame:
    """One raw score and likelihood under each of the three modes."""
    raw, likely = F.col("event_id") % 11 / 10, F.col("event_id") % 7 / 6
    modes = {m: L.anomaly(m, raw, likely) for m in ("pure", "likelihood", "weighted")}
    return events(spark, sf).select("event_id", *[fixed(c).alias(f"{m}_e6") for m, c in modes.items()])


def input_dispatch(spark, sf) -> DataFrame:
    """Inputs of different kinds brought to one: numbers, text of digits and arrays as bits, maps as records."""
    from .network import as_input

    rows = _arrays(spark, sf).select("p_partkey", F.concat_ws(",", F.transform("a", lambda x: (x > 0).cast("int"))).alias("t"), F.array_distinct(F.transform("a", lambda x: F.abs(x).cast("int"))).alias("s"), F.create_map(F.lit("k"), F.col("p_partkey").cast("string")).alias("m"))
    return rows.select("p_partkey", *[as_input(rows, c).alias(c) for c in ("t", "s", "m")]).select("p_partkey", text(F.col("t.bits")).alias("t"), text(F.col("s.bits")).alias("s"), F.col("m.record")["k"].alias("m"))


_INPUTS = f"""WITH {_AB} SELECT p_partkey, {_list_sql('list_filter(range(0, 4), lambda i: a[i + 1] > 0)')} AS t, {_list_sql('list_sort(list_distinct(list_transform(a, lambda x: abs(x))))')} AS s, CAST(p_partkey AS VARCHAR) AS m FROM ab"""

QUERIES = {
    "array_rounded_divide": (array_rounded_divide, f"WITH {_AB} SELECT p_partkey, {_all_sql('list_transform(list_zip(a, b), lambda p: round(p[1] / CASE p[2] % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 4.0 ELSE 8.0 END, 1))')} AS quotients_e6 FROM ab"),
    "array_powers": (array_powers, f"WITH {_AB} SELECT p_partkey, {_list_sql('list_transform(a, lambda x: abs(x))')} AS sizes, {_all_sql('list_transform(a, lambda x: x * x)')} AS squares_e6, {_all_sql('list_transform(a, lambda x: exp(x / 16))')} AS exps_e6, {fixed_sql('list_avg(a)')} AS mean_e6 FROM ab"),
    "matrix_products": (matrix_products, _MATRICES),
    "ranges": (ranges, _RANGES),
    "array_set_values": (array_set_values, _SETS),
    "array_raised": (array_raised, _RAISED),
    "array_shapes": (array_shapes, _SHAPES),
    "seeded_shuffle": (seeded_shuffle, _SHUFFLED),
    "seeded_numbers": (seeded_numbers, _NUMBERS),
    "array_interleave": (array_interleave, _MIXED),
    "json_roundtrip": (json_roundtrip, f"WITH {_AB} SELECT p_partkey, '{{\"a\":[' || {_list_sql('a')} || ']}}' AS json, {_list_sql('b')} AS b FROM ab"),
    "matrix_or_all_any": (matrix_or_all_any, f"WITH s AS (SELECT p_brand, list_sort(list_distinct(list(p_size))) AS s FROM part GROUP BY 1) SELECT p_brand, {_list_sql('s')} AS bits, list_has_all(s, [1, 2, 3]) AS has_all, list_has_any(s, [1, 2, 3]) AS has_any FROM s"),
    "digits_to_bits": (digits_to_bits, f"WITH d AS (SELECT p_partkey, list_transform(range(0, 8), lambda k: (p_partkey >> k) & 1) AS d FROM part) SELECT p_partkey, {_list_sql('d')} AS dense, {_list_sql('list_filter(range(0, 8), lambda k: d[k + 1] = 1)')} AS bits FROM d"),
    "pass_through_bits": (pass_through_bits, f"WITH d AS (SELECT p_partkey, p_size AS x, p_partkey % 11 + 50 AS y, list_filter(range(0, 6), lambda k: (p_partkey >> k) & 1 = 1) AS d FROM part) SELECT p_partkey, CASE WHEN y < 58 THEN {_list_sql('list_sort([x, y])')} ELSE '' END AS sparse, y >= 58 AS refused, {_list_sql('d')} AS dense FROM d"),
    "log_closeness": (log_closeness, f"SELECT event_id, {fixed_sql('1.0 - least(abs(' + _log_sql('value') + ' - ' + _log_sql('value * 2') + ') / 4.0, 1.0)')} AS close_e6 FROM events"),
    "range_description": (range_description, _DESCRIBED),
    "parse_dates": (parse_dates, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS at FROM events"),
    "record_bits": (record_bits, _RECORD),
    "pixel_bits": (pixel_bits, _PIXELS),
    "local_inhibition": (local_inhibition, _LOCAL),
    "inhibition_radius": (inhibition_radius, "WITH s AS (SELECT p_brand, max(p_size) - min(p_size) + 1 AS s FROM part GROUP BY 1) SELECT CAST(greatest(1, floor((avg(s) * 0.5 - 1) / 2 + 0.5)) AS BIGINT) AS radius FROM s"),
    "least_duty": (least_duty, _DUTY),
    "estimator_validity": (estimator_validity, "SELECT user_id, count(value) >= 3 AND coalesce(avg(value), 0) <> 0 AND coalesce(var_pop(value), 0) <> 0 AS valid FROM events GROUP BY 1"),
    "anomaly_modes": (anomaly_modes, f"SELECT event_id, {fixed_sql('event_id % 11 / 10')} AS pure_e6, {fixed_sql('event_id % 7 / 6')} AS likelihood_e6, {fixed_sql('(event_id % 11 / 10) * (event_id % 7 / 6)')} AS weighted_e6 FROM events"),
    "input_dispatch": (input_dispatch, _INPUTS),
}
