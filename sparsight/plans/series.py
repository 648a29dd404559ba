"""Queries over record streams: encoders, moving windows, likelihoods, error metrics, aggregation, stored metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..functions import likelihood as L
from ..functions.sdr import unique
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import runs as U
from ..operators import stores as S
from ..shared import written
from .common import events, fixed, fixed_sql, table, text

SCALAR = E.ScalarEncoder.of(21, 0, 500, n=421)
HOURLY = E.ScalarEncoder.of(21, 0, 24, n=240, periodic=True)
LOG = E.LogEncoder.of(5, 1.0, 10_000.0, n=105)
RANDOM = E.RandomScalarEncoder(resolution=2.5)
ORDER = ["ts", "event_id"]
W10 = "PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"
BY_TYPE = "PARTITION BY event_type ORDER BY ts, event_id"


def _scalar_sql(x: str) -> str:
    return f"CAST(trunc((greatest(0.0, least(500.0, {x})) - 0.0 + {SCALAR.resolution!r} / 2) / {SCALAR.resolution!r}) AS BIGINT)"


def scalar_bucket(spark, sf) -> DataFrame:
    return events(spark, sf).select("event_id", SCALAR.bucket(F.col("value")).alias("bucket"))


def scalar_encode_bits(spark, sf) -> DataFrame:
    return events(spark, sf).select("event_id", text(SCALAR.bits(F.col("value"))).alias("bits"))


def periodic_bucket(spark, sf) -> DataFrame:
    hours = E.seconds_of_day(F.col("ts")) / 3600.0
    return events(spark, sf).select("event_id", HOURLY.bucket(hours).alias("bucket"), text(HOURLY.bits(hours)).alias("bits"))


_HOURS = "((extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + CAST(floor(extract(second FROM ts)) AS INT)) / 3600.0)"
_PERIODIC = f"(CAST(trunc({_HOURS} * 240 / 24.0) AS BIGINT) - 10)"


def scalar_decode(spark, sf) -> DataFrame:
    found = SCALAR.decode(events(spark, sf).select("event_id", SCALAR.bits(F.col("value")).alias("bits")), "bits", "event_id")
    return found.select("event_id", "bucket", fixed(F.col("value")).alias("value_e6"))


def log_bucket(spark, sf) -> DataFrame:
    return events(spark, sf).select("event_id", LOG.bucket(F.col("value")).alias("bucket"))


def rdse_bucket(spark, sf) -> DataFrame:
    first = events(spark, sf).groupBy("event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("origin"))
    return events(spark, sf).join(first, "event_type").select("event_id", RANDOM.bucket(F.col("value"), F.col("origin")).alias("bucket"))


def delta_value(spark, sf) -> DataFrame:
    rows = O.trailing(events(spark, sf), ["event_type"], "hour", ORDER, 1, {"before": lambda w: F.lag("value").over(w)}, ["value"])
    return rows.select("event_id", fixed(F.col("value") - F.coalesce("before", "value")).alias("delta_e6"))


def adaptive_range_bucket(spark, sf) -> DataFrame:
    rows = O.running(events(spark, sf), ["event_type"], "hour", ORDER, {"low": ("min", "value"), "high": ("max", "value")})
    high = F.when(F.col("high") == F.col("low"), F.col("low") + 1).otherwise(F.col("high"))
    step = (high - F.col("low")) / 100
    return rows.select("event_id", fixed(F.col("low")).alias("low_e6"), fixed(high).alias("high_e6"), ((F.col("value") - F.col("low") + step / 2) / step).cast("bigint").alias("bucket"))


WINDOW = 300


def adaptive_window_bucket(spark, sf) -> DataFrame:
    """Buckets of values in 100 steps of the range of the last 300 records of their type."""
    rows = U.sliding_range(events(spark, sf), ["event_type"], ORDER, "value", WINDOW)
    high = F.when(F.col("high") == F.col("low"), F.col("low") + 1).otherwise(F.col("high"))
    step = (high - F.col("low")) / 100
    return rows.select("event_id", fixed(F.col("low")).alias("low_e6"), fixed(high).alias("high_e6"), ((F.col("value") - F.col("low") + step / 2) / step).cast("bigint").alias("bucket"))


def _adaptive_sql(frame: str) -> str:
    return (
        f"WITH r AS (SELECT event_id, value, min(value) OVER w AS low, max(value) OVER w AS top FROM events WINDOW w AS ({BY_TYPE}{frame})), s AS (SELECT *, CASE WHEN top = low THEN low + 1 ELSE top END AS high FROM r) "
        f"SELECT event_id, {fixed_sql('low')} AS low_e6, {fixed_sql('high')} AS high_e6, CAST(trunc((value - low + (high - low) / 100 / 2) / ((high - low) / 100)) AS BIGINT) AS bucket FROM s"
    )


def rdse_bits(spark, sf) -> DataFrame:
    """For each bucket that values fall in: its records, its bits, and how it keeps the overlap rule with the other buckets seen.

    Buckets meet by the bits that they share, and by their numbers where they are near; there are 1000 at most.
    """
    first = events(spark, sf).groupBy("event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("origin"))
    rows = events(spark, sf).join(first, "event_type").select(RANDOM.bucket(F.col("value") * 5, F.col("origin") * 5).alias("bucket"))
    seen = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_records")).withColumn("bits", RANDOM.bits(F.col("bucket")))
    on = seen.select("bucket", F.explode("bits").alias("bit"))
    pairs = on.join(on.withColumnRenamed("bucket", "other"), "bit").where("bucket <> other").groupBy("bucket", "other").agg(F.count(F.lit(1)).alias("shared"))
    apart = F.abs(F.col("bucket") - F.col("other"))
    kept = F.col("shared") == RANDOM.w - apart
    law = pairs.groupBy("bucket").agg(F.count_if((apart < RANDOM.w) & kept).alias("near"), F.count_if((apart >= RANDOM.w) & (F.col("shared") > RANDOM.max_overlap)).alias("far_over"), F.count_if((apart < RANDOM.w) & ~kept).alias("near_off"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return seen.join(law, "bucket", "left").select("bucket", "n_records", F.size("bits").alias("n_bits"), F.size(F.array_distinct("bits")).alias("n_distinct"), zero("near"), zero("near_off"), zero("far_over"))


_RDSE_BITS = f"""
WITH o AS (SELECT value * 5 AS v, 5 * first_value(value) OVER ({BY_TYPE}) AS o FROM events),
b AS (SELECT CAST(greatest(0, least(999, 500 + sign(v - o) * round_even(abs(v - o) / 2.5, 0))) AS BIGINT) AS bucket, count(*) AS n_records FROM o GROUP BY 1)
SELECT bucket, n_records, 21 AS n_bits, 21 AS n_distinct, (SELECT count(*) FROM b c WHERE c.bucket <> b.bucket AND abs(c.bucket - b.bucket) < 21) AS near, 0 AS near_off, 0 AS far_over FROM b"""


def date_scalars(spark, sf) -> DataFrame:
    ts = F.col("ts")
    return events(spark, sf).select("event_id", E.season(ts).alias("season"), E.weekday(ts).cast("int").alias("weekday"), E.seconds_of_day(ts).alias("second_of_day"), E.is_weekend(ts).alias("weekend"))


_SOD = "(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + CAST(floor(extract(second FROM ts)) AS INT))"


def date_holiday_ramp(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, cast(o_orderkey % 24 as int), 0, 0)"))
    return rows.select("o_orderkey", fixed(E.holiday_ramp(F.col("ts"))).alias("ramp_e6"))


def date_bucket_indices(spark, sf) -> DataFrame:
    """Buckets of season (of 122 days' parts) and time of day (of 24 hours)."""
    ts = F.col("ts")
    season = E.ScalarEncoder.of(21, 0, 366, n=122, periodic=True)
    return events(spark, sf).select("event_id", season.bucket(E.season(ts).cast("double")).alias("season_bucket"), HOURLY.bucket(E.seconds_of_day(ts) / 3600.0).alias("time_bucket"))


DATE = E.DateEncoder(21, 0, 21, 21)


def date_encode_bits(spark, sf) -> DataFrame:
    bits = DATE.bits(F.col("ts"))
    return events(spark, sf).select("event_id", text(DATE.buckets(F.col("ts"))).alias("buckets"), F.size(bits).alias("n_bits"), F.array_max(bits).alias("last"))


def _date_sql() -> str:
    # the same arithmetic over the encoders' sizes: season and time wrap around, the weekend flag clips
    season_n, time_n, weekend = 84, 126, E.ScalarEncoder.of(21, 0, 1, radius=1.0, forced=True)
    first = f"CAST(trunc((e + {weekend.resolution!r} / 2) / {weekend.resolution!r}) AS BIGINT)"
    last = f"greatest(list_max(list_transform(range(s - 10, s + 11), lambda i: (i + {season_n}) % {season_n})), {season_n} + {first} + 20, {season_n + weekend.n} + list_max(list_transform(range(t - 10, t + 11), lambda i: (i + {time_n}) % {time_n})))"
    return (
        f"WITH b AS (SELECT event_id, CAST(trunc((dayofyear(ts) - 1) * {season_n} / 366.0) AS BIGINT) AS s, CAST((isodow(ts) - 1 + {_SOD} / 86400.0) >= 4.75 AS BIGINT) AS e, CAST(trunc({_HOURS} * {time_n} / 24.0) AS BIGINT) AS t FROM events) "
        f"SELECT event_id, concat_ws(',', s, {first}, t) AS buckets, 63 AS n_bits, CAST({last} AS INT) AS last FROM b"
    )


def name_filter(spark, sf) -> DataFrame:
    return table(spark, sf, "part").where(S.name_matches(F.col("p_name"), ["^SMALL", "gear$"])).select("p_partkey", "p_name")


def membership(spark, sf) -> DataFrame:
    """Customers without events, and orders of customers with events."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("k")).distinct()
    quiet = S.membership(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), users, "k", inverted=True).select("k", F.lit("quiet").alias("kind"))
    heard = S.membership(table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), users, "k").select(F.col("o_orderkey").alias("k"), F.lit("heard").alias("kind"))
    return quiet.union(heard)


def results_per_choice(spark, sf) -> DataFrame:
    """Suppliers' worst taxes by nation, as errors of choices."""
    worst = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max(F.floor(F.col("l_tax") * 100)).alias("err"), F.count(F.lit(1)).alias("n"))
    rows = worst.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return S.results_per_choice(rows, "s_nationkey", "err").select("s_nationkey", text(F.col("errors")).alias("errors"))


def multi_encode_offsets(spark, sf) -> DataFrame:
    parts = [("value", SCALAR.bits(F.col("value")), SCALAR.n), ("hour", HOURLY.bits(E.seconds_of_day(F.col("ts")) / 3600.0), HOURLY.n)]
    bits = E.multi(parts)
    return events(spark, sf).select("event_id", F.size(bits).alias("n_bits"), text(F.array_sort(bits)).alias("bits"))


def category_bucket(spark, sf) -> DataFrame:
    """Categories numbered by name; 0 stays for the unknown."""
    brands = table(spark, sf, "part").select("p_brand").where(F.col("p_brand").isNotNull()).distinct()
    known = U.numbered(brands, [], ["p_brand"], "i").select("p_brand", (F.col("i") + 1).alias("bucket"))
    return table(spark, sf, "part").join(known, "p_brand", "left").select("p_partkey", F.coalesce("bucket", F.lit(0)).cast("bigint").alias("bucket"))


def category_decode(spark, sf) -> DataFrame:
    """Every event type's random encoding finds its own category again by overlap; types are encoded once, not once an event."""
    kinds = events(spark, sf).select(F.col("event_type").alias("category")).distinct().withColumn("bits", E.random_bits(F.col("category"), 21, 400))
    kinds = written(kinds, "kinds")  # or what reads the bits would filter the events by them
    found = E.categories_of(kinds.withColumnRenamed("category", "kind"), "bits", kinds, 21, 400).select("kind", "category")
    return events(spark, sf).select("event_id", "event_type").join(found, F.col("event_type").eqNullSafe(F.col("kind"))).select("event_id", "category")


def moving_average(spark, sf) -> DataFrame:
    rows = O.trailing(events(spark, sf), ["event_type"], "hour", ORDER, 9, {"ma": lambda w: O.moving_average(w, "value", 10)}, ["value"])
    return rows.select("event_id", fixed(F.col("ma")).alias("ma_e6"))


def _score():
    """A stand-in for a raw anomaly score, from 0 to 1."""
    return F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000.0


_SCORE = "(((event_id * 7919) % 1000) / 1000.0)"


def score_moving_average(spark, sf) -> DataFrame:
    rows = events(spark, sf).withColumn("score", _score())
    rows = O.trailing(rows, ["event_type"], "hour", ORDER, 9, {"ma": lambda w: O.moving_average(w, "score", 10)}, ["score"])
    return rows.select("event_id", fixed(F.col("ma")).alias("ma_e6"))


def normal_fit(spark, sf) -> DataFrame:
    g = events(spark, sf).withColumn("score", _score()).groupBy("event_type").agg(F.avg("score").alias("m"), F.var_pop("score").alias("v"))
    mean, var = F.greatest("m", F.lit(L.MEAN_FLOOR)), F.greatest("v", F.lit(L.VARIANCE_FLOOR))
    return g.select("event_type", fixed(mean).alias("mean_e6"), fixed(var).alias("variance_e6"), fixed(F.sqrt(var)).alias("stdev_e6"))


def normal_tail_prob(spark, sf) -> DataFrame:
    return events(spark, sf).select("event_id", fixed(L.normal_tail(F.col("value"), F.lit(150.0), F.lit(80.0))).alias("tail_e6"))


def log_likelihood(spark, sf) -> DataFrame:
    return events(spark, sf).select("event_id", fixed(L.log_likelihood(_score())).alias("log_e6"))


def likelihood_filter(spark, sf) -> DataFrame:
    """Extreme tails that follow an extreme one are lifted."""
    rows = events(spark, sf).withColumn("tail", F.when(F.pmod(F.col("event_id"), F.lit(3)) < 2, 1e-6).otherwise(_score()))
    rows = O.trailing(rows, ["event_type"], "hour", ORDER, 1, {"before": lambda w: F.lag("tail").over(w)}, ["tail"])
    return rows.select("event_id", fixed(L.lift_repeats(F.col("tail"), F.col("before")) * 1000).alias("tail_e9"))


SKIP = 10


def anomaly_likelihood_batch(spark, sf) -> DataFrame:
    """Likelihood of each event type's averaged scores under the normal law fitted to them, without the first SKIP rows of a type."""
    rows = events(spark, sf).withColumn("score", _score()).withColumn("one", F.lit(1))
    rows = O.trailing(rows, ["event_type"], "hour", ORDER, 9, {"ma": lambda w: O.moving_average(w, "score", 10)}, ["score"])
    rows = O.running(rows, ["event_type"], "hour", ORDER, {"at": ("count", "one")})
    late = F.when(F.col("at") > SKIP, F.col("ma"))
    metric = F.when(F.col("at") > SKIP, F.col("value"))
    law = rows.groupBy("event_type").agg(F.avg(late).alias("m"), F.var_pop(late).alias("v"), F.var_pop(metric).alias("mv"))
    flat = F.col("m").isNull() | (F.col("mv") < L.FLAT_VARIANCE)
    law = law.select("event_type", F.when(flat, L.NULL_MEAN).otherwise(F.greatest("m", F.lit(L.MEAN_FLOOR))).alias("mean"), F.sqrt(F.when(flat, L.NULL_VARIANCE).otherwise(F.greatest("v", F.lit(L.VARIANCE_FLOOR)))).alias("stdev"))
    rows = rows.join(law, "event_type").withColumn("tail", L.normal_tail(F.col("ma"), F.col("mean"), F.col("stdev")))
    rows = O.trailing(rows, ["event_type"], "hour", ORDER, 1, {"before": lambda w: F.lag("tail").over(w)}, ["tail"])
    return rows.select("event_id", fixed(F.col("ma")).alias("ma_e6"), fixed(1 - L.lift_repeats(F.col("tail"), F.col("before"))).alias("likelihood_e6"))


_LIKELIHOOD_SQL = f"""
WITH a AS (SELECT event_id, event_type, ts, value, avg({_SCORE}) OVER ({W10}) AS ma, row_number() OVER ({BY_TYPE}) AS nth FROM events),
law AS (SELECT event_type, avg(ma) FILTER (nth > {SKIP}) AS m, var_pop(ma) FILTER (nth > {SKIP}) AS v, var_pop(value) FILTER (nth > {SKIP}) AS mv FROM a GROUP BY event_type),
f AS (SELECT event_type, CASE WHEN m IS NULL OR mv < {L.FLAT_VARIANCE} THEN {L.NULL_MEAN} ELSE greatest(m, {L.MEAN_FLOOR}) END AS mean,
  sqrt(CASE WHEN m IS NULL OR mv < {L.FLAT_VARIANCE} THEN {L.NULL_VARIANCE} ELSE greatest(v, {L.VARIANCE_FLOOR}) END) AS stdev FROM law),
t AS (SELECT a.*, {L.tail_sql("ma", "mean", "stdev")} AS tail FROM a JOIN f USING (event_type)),
b AS (SELECT *, lag(tail) OVER ({BY_TYPE}) AS before FROM t)
SELECT event_id, {fixed_sql("ma")} AS ma_e6, {fixed_sql(f"1 - (CASE WHEN tail <= {L.RED} AND before <= {L.RED} THEN {L.YELLOW} ELSE tail END)")} AS likelihood_e6 FROM b
"""


def raw_anomaly(spark, sf) -> DataFrame:
    """Users active in an hour against those active in the hour before."""
    hours = events(spark, sf).groupBy("hour").agg(F.array_sort(F.collect_set("user_id")).alias("active"))
    before = hours.select((F.col("hour") + 1).alias("hour"), F.col("active").alias("predicted"))
    joined = hours.join(before, "hour", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<bigint>")))
    return joined.select("hour", fixed(L.raw_score(F.col("active"), F.col("predicted"))).alias("score_e6"))


_METRIC_INPUT = "SELECT event_type, value AS t, lag(value, 1) OVER (" + BY_TYPE + ") AS p1, lag(value, 5) OVER (" + BY_TYPE + ") AS p5, ts, event_id FROM events"


def _predicted(spark, sf, steps=(1, 5)) -> DataFrame:
    columns = {f"p{k}": (lambda w, k=k: F.lag("value", k).over(w)) for k in steps}
    return O.trailing(events(spark, sf), ["event_type"], "hour", ORDER, max(steps), columns, ["value"])


def _metric(name):
    def query(spark, sf) -> DataFrame:
        return _predicted(spark, sf, (1,)).groupBy("event_type").agg(fixed(M.metric(name, F.col("value"), F.col("p1"))).alias("metric_e6"))

    return query


def metric_multistep(spark, sf) -> DataFrame:
    return _predicted(spark, sf).groupBy("event_type").agg(fixed(M.multistep("aae", F.col("value"), {1: F.col("p1"), 5: F.col("p5")})).alias("metric_e6"))


def metric_windowed(spark, sf) -> DataFrame:
    """Root mean square and relative errors over the trailing 20 rows, whose sums are rounded as in the SQL: by blocks of 16 rows of a type."""
    rows = O.running(_predicted(spark, sf, (1,)).withColumn("one", F.lit(1)), ["event_type"], "hour", ORDER, {"at": ("count", "one")})

    def windowed(name):
        return lambda w: M.metric(name, F.col("value"), F.col("p1"), w.rowsBetween(-19, 0), lambda term: O.blocked_sum(w, term, 20, F.col("at")))

    rows = O.trailing(rows, ["event_type"], "hour", ORDER, 19, {"rmse": windowed("rmse"), "mape": windowed("altMAPE")}, ["value", "p1"])
    return rows.select("event_id", fixed(F.col("rmse")).alias("rmse_e6"), fixed(F.col("mape")).alias("mape_e6"))


def inference_shift(spark, sf) -> DataFrame:
    return _predicted(spark, sf).select("event_id", fixed(F.col("p1")).alias("p1_e6"), fixed(F.col("p5")).alias("p5_e6"))


def bucket_volume(spark, sf) -> DataFrame:
    return S.bucket_volumes(events(spark, sf), "ts", "event_type", 900)


def bucket_volume_zero_fill(spark, sf) -> DataFrame:
    return S.fill_volumes(S.bucket_volumes(events(spark, sf), "ts", "event_type", 3600), 3600)


def scrub_increasing_ts(spark, sf) -> DataFrame:
    """Events come by user and id; of each type, those stay that are later than all before. Arrival is cut by the user."""
    late = O.running(events(spark, sf), ["event_type"], "user_id", ["user_id", "event_id"], {"latest": ("max", "ts")}, strict=True)
    return late.where(F.col("latest").isNull() | (F.col("ts") > F.col("latest"))).select("event_id")


def _metric_data(spark, sf) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").alias("uid"), F.col("event_id").alias("rowid"), "ts", "value", F.when(F.col("event_id") % 4 != 0, _score()).alias("score"))


_DATA = f"(SELECT user_id AS uid, event_id AS rowid, ts, value, CASE WHEN event_id % 4 <> 0 THEN {_SCORE} END AS score FROM events)"


def metric_data_query(spark, sf) -> DataFrame:
    return S.metric_query(_metric_data(spark, sf), limit=5, least_score=0.5).select("uid", "rowid", fixed(F.col("score")).alias("score_e6"))


def metric_tail(spark, sf) -> DataFrame:
    return S.metric_tail(_metric_data(spark, sf), 3).select("uid", "rowid")


def metric_stats(spark, sf) -> DataFrame:
    return S.metric_stats(_metric_data(spark, sf)).select("uid", fixed(F.col("least")).alias("least_e6"), fixed(F.col("most")).alias("most_e6"), "n", "scored")


def encoder_resolution(spark, sf) -> DataFrame:
    low, high = S.value_range(F.col("value"), 1.0)
    g = events(spark, sf).groupBy("user_id").agg(low.alias("low"), high.alias("high"))
    return g.select("user_id", fixed(S.encoder_resolution(F.col("low"), F.col("high"), 130, 0.001)).alias("resolution_e6"))


def reset_learn_flags(spark, sf) -> DataFrame:
    """A new sequence (user) within an hour resets, logins excepted; error events don't learn."""
    rows = O.trailing(events(spark, sf).withColumn("all", F.lit(0)), ["all"], "hour", ORDER, 1, {"before": lambda w: F.lag("user_id").over(w)}, ["user_id"])
    changed = F.col("before").isNotNull() & (F.col("before") != F.col("user_id"))
    return rows.select("event_id", (changed | (F.col("event_type") == "signup")).cast("int").alias("reset"), (F.col("event_type") != "error").cast("int").alias("learn"))


def run_group_by(spark, sf) -> DataFrame:
    """Runs of equal event types along the stream: first event, type, length."""
    rows = O.trailing(events(spark, sf).withColumn("all", F.lit(0)), ["all"], "hour", ORDER, 1, {"before": lambda w: F.lag("event_type").over(w)}, ["event_type"])
    rows = rows.withColumn("starts", (F.col("before").isNull() | (F.col("before") != F.col("event_type"))).cast("bigint"))
    rows = O.running(rows, ["all"], "hour", ORDER, {"run": ("sum", "starts")})
    return rows.groupBy("run", "event_type").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n"))


def duty_cycle(spark, sf) -> DataFrame:
    """Share of a user's events so far that were clicks (cumulative mean, as duty cycles are within their period)."""
    rows = events(spark, sf).withColumn("on", (F.col("event_type") == "click").cast("bigint")).withColumn("day", F.floor(F.col("hour") / 24))
    rows = O.running(rows, ["user_id"], "day", ORDER, {"on_sum": ("sum", "on"), "n": ("count", "on")})
    return rows.select("event_id", fixed(F.col("on_sum") / F.col("n")).alias("duty_e6"))


PERIOD = 20


def duty_cycle_period(spark, sf) -> DataFrame:
    """How often a user clicks: the mean of the first 20 events, a decaying one from then on. Halves of a millionth are lifted over the edge in both engines."""
    rows = events(spark, sf).withColumn("on", (F.col("event_type") == "click").cast("int"))
    return U.duty_cycles(rows, ["user_id"], ORDER, "on", PERIOD).select("event_id", fixed(F.col("duty") + 1e-13).alias("duty_e6"))


_DUTY = f"""WITH n AS (SELECT event_id, user_id, CAST(event_type = 'click' AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)
SELECT b.event_id, {fixed_sql(f"CASE WHEN b.t <= {PERIOD} THEN avg(a.x) ELSE sum(a.x * pow({1 - 1 / PERIOD!r}, b.t - greatest(a.t, {PERIOD}))) / {PERIOD} END + 1e-13")} AS duty_e6
FROM n b JOIN n a ON a.user_id = b.user_id AND a.t <= b.t GROUP BY b.event_id, b.t"""


def bucket_actual_value_ema(spark, sf) -> DataFrame:
    """Exponential mean (0.3 to the newest) of a user's values: weights by age, the oldest with what is left."""
    # counted from the newest record back: an age is a weight, and the sums are partial ones
    rows = events(spark, sf).withColumns({"back": -F.floor(F.col("hour") / 24), "newest": -F.unix_micros(F.col("ts").cast("timestamp")), "last": -F.col("event_id")})
    aged = O.running(rows, ["user_id"], "back", ["newest", "last"], {"age": ("count", "event_id")})
    left = F.pow(F.lit(0.7), F.col("age") - 1)
    sums = aged.groupBy("user_id").agg(F.sum(0.3 * left * F.col("value")).alias("s"), F.max_by(0.7 * left * F.col("value"), "age").alias("oldest"))
    return sums.select("user_id", fixed(F.col("s") + F.col("oldest")).alias("ema_e6"))


def row_numbers(spark, sf) -> DataFrame:
    """Records numbered from 0 along the stream, without a single task: by hours, then within."""
    rows = O.running(events(spark, sf).withColumn("all", F.lit(0)), ["all"], "hour", ORDER, {"n": ("count", "event_id")})
    return rows.select("event_id", (F.col("n") - 1).alias("rec_no"))


def count_traces(spark, sf) -> DataFrame:
    """Distinct users an hour, and their running total."""
    hours = events(spark, sf).groupBy("hour").agg(F.count_distinct("user_id").alias("n")).withColumn("all", F.lit(0)).withColumn("day", F.floor(F.col("hour") / 24))
    return O.running(hours, ["all"], "day", ["hour"], {"running": ("sum", "n")}).select("hour", "n", "running")


def trace_stats(spark, sf) -> DataFrame:
    return events(spark, sf).groupBy("event_type").agg(fixed(F.min("value")).alias("least_e6"), fixed(F.max("value")).alias("most_e6"), fixed(F.avg("value")).alias("mean_e6"), fixed(F.stddev_pop("value")).alias("stdev_e6"))


def set_traces(spark, sf) -> DataFrame:
    """Users of an hour against those of the hour before: how many came again, stayed away, are new."""
    from ..operators.columns import trace_sets

    hours = events(spark, sf).groupBy("hour").agg(unique(F.collect_set("user_id")).alias("active"))
    before = hours.select((F.col("hour") + 1).alias("hour"), F.col("active").alias("predicted"))
    rows = hours.join(before, "hour")
    return rows.select("hour", *[c.alias(n) for n, c in trace_sets(F.col("active"), F.col("predicted")).items()])


def _ratio_sql(name: str) -> str:
    top = {"rmse": "sqrt(avg(pow(t - p1, 2)))", "aae": "avg(abs(t - p1))", "avg_err": "avg(CAST(t <> p1 AS DOUBLE))", "altMAPE": "CASE WHEN sum(abs(t)) > 0 THEN 100 * sum(abs(t - p1)) / sum(abs(t)) ELSE 0 END"}[name]
    return f"SELECT event_type, {fixed_sql(top)} AS metric_e6 FROM ({_METRIC_INPUT}) WHERE p1 IS NOT NULL GROUP BY event_type"


_DATE_SQL = _date_sql()
_HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"
_HOURLY_SETS = f"(SELECT {_HOUR} AS hour, list(DISTINCT user_id) AS users FROM events GROUP BY 1)"

QUERIES = {
    "scalar_bucket": (scalar_bucket, f"SELECT event_id, {_scalar_sql('value')} AS bucket FROM events"),
    "scalar_encode_bits": (scalar_encode_bits, f"SELECT event_id, array_to_string(range(b, b + 21), ',') AS bits FROM (SELECT event_id, {_scalar_sql('value')} AS b FROM events)"),
    "periodic_bucket": (periodic_bucket, f"SELECT event_id, (b + 10 + 240) % 240 AS bucket, array_to_string(list_sort(list_transform(range(b, b + 21), lambda i: (i + 240) % 240)), ',') AS bits FROM (SELECT event_id, {_PERIODIC} AS b FROM events)"),
    "scalar_decode": (scalar_decode, f"SELECT event_id, b AS bucket, {fixed_sql(f'0.0 + b * {SCALAR.resolution!r}')} AS value_e6 FROM (SELECT event_id, {_scalar_sql('value')} AS b FROM events)"),
    "log_bucket": (log_bucket, f"SELECT event_id, CAST(trunc((log10(greatest(1.0, least(10000.0, value))) + {LOG.scalar.resolution!r} / 2) / {LOG.scalar.resolution!r}) AS BIGINT) AS bucket FROM events"),
    "rdse_bucket": (rdse_bucket, f"SELECT event_id, CAST(greatest(0, least(999, 500 + sign(value - o) * round_even(abs(value - o) / 2.5, 0))) AS BIGINT) AS bucket FROM (SELECT event_id, value, first_value(value) OVER ({BY_TYPE}) AS o FROM events)"),
    "delta_value": (delta_value, f"SELECT event_id, {fixed_sql('value - coalesce(b, value)')} AS delta_e6 FROM (SELECT event_id, value, lag(value) OVER ({BY_TYPE}) AS b FROM events)"),
    "adaptive_range_bucket": (adaptive_range_bucket, _adaptive_sql("")),
    "adaptive_window_bucket": (adaptive_window_bucket, _adaptive_sql(f" ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW")),
    "rdse_bits": (rdse_bits, _RDSE_BITS),
    "date_scalars": (date_scalars, f"SELECT event_id, CAST(dayofyear(ts) - 1 AS INT) AS season, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST({_SOD} AS BIGINT) AS second_of_day, CAST((isodow(ts) - 1 + {_SOD} / 86400.0) >= 4.75 AS INT) AS weekend FROM events"),
    "date_holiday_ramp": (date_holiday_ramp, f"WITH t AS (SELECT o_orderkey, epoch(o_orderdate) + (o_orderkey % 24) * 3600 AS s, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS ts FROM orders), d AS (SELECT o_orderkey, s - epoch(make_timestamp(CAST(year(ts) AS BIGINT), 12, 25, 0, 0, 0.0)) AS a FROM t) SELECT o_orderkey, {fixed_sql('CASE WHEN a >= 0 AND a < 86400 THEN 1.0 WHEN a >= 86400 AND a < 172800 THEN 1 - (a - 86400) / 86400.0 WHEN a < 0 AND a > -86400 THEN 1 + a / 86400.0 ELSE 0.0 END')} AS ramp_e6 FROM d"),
    "date_bucket_indices": (date_bucket_indices, f"SELECT event_id, CAST(trunc((dayofyear(ts) - 1) * 122 / 366.0) AS BIGINT) % 122 AS season_bucket, ({_PERIODIC} + 250) % 240 AS time_bucket FROM events"),
    "multi_encode_offsets": (multi_encode_offsets, f"SELECT event_id, 42 AS n_bits, array_to_string(list_sort(list_concat(list_transform(range(p, p + 21), lambda i: (i + 240) % 240), list_transform(range(b, b + 21), lambda i: i + 240))), ',') AS bits FROM (SELECT event_id, {_PERIODIC} AS p, {_scalar_sql('value')} AS b FROM events)"),
    "date_encode_bits": (date_encode_bits, _DATE_SQL),
    "name_filter": (name_filter, "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(^SMALL)|(gear$)', 'i')"),
    "membership": (membership, "SELECT c_custkey AS k, 'quiet' AS kind FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT o_orderkey, 'heard' FROM orders WHERE o_custkey IN (SELECT user_id FROM events)"),
    "results_per_choice": (results_per_choice, "SELECT s_nationkey, string_agg(CAST(err AS VARCHAR), ',' ORDER BY err) AS errors FROM (SELECT l_suppkey, CAST(max(floor(l_tax * 100)) AS BIGINT) AS err FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"),
    "category_bucket": (category_bucket, "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) AS BIGINT) AS bucket FROM part"),
    "category_decode": (category_decode, "SELECT event_id, event_type AS category FROM events"),
    "moving_average": (moving_average, f"SELECT event_id, {fixed_sql(f'avg(value) OVER ({W10})')} AS ma_e6 FROM events"),
    "score_moving_average": (score_moving_average, f"SELECT event_id, {fixed_sql(f'avg({_SCORE}) OVER ({W10})')} AS ma_e6 FROM events"),
    "normal_fit": (normal_fit, f"SELECT event_type, {fixed_sql('greatest(m, 0.03)')} AS mean_e6, {fixed_sql('greatest(v, 0.0003)')} AS variance_e6, {fixed_sql('sqrt(greatest(v, 0.0003))')} AS stdev_e6 FROM (SELECT event_type, avg({_SCORE}) AS m, var_pop({_SCORE}) AS v FROM events GROUP BY 1)"),
    "normal_tail_prob": (normal_tail_prob, f"SELECT event_id, {fixed_sql(L.tail_sql('value', '150.0', '80.0'))} AS tail_e6 FROM events"),
    "log_likelihood": (log_likelihood, f"SELECT event_id, {fixed_sql(f'ln(1.0000000001 - {_SCORE}) / -23.02585084720009')} AS log_e6 FROM events"),
    "likelihood_filter": (likelihood_filter, f"WITH t AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 3 < 2 THEN 1e-6 ELSE {_SCORE} END AS tail FROM events), b AS (SELECT *, lag(tail) OVER ({BY_TYPE}) AS before FROM t) SELECT event_id, {fixed_sql('(CASE WHEN tail <= 1e-5 AND before <= 1e-5 THEN 1e-3 ELSE tail END) * 1000')} AS tail_e9 FROM b"),
    "anomaly_likelihood_batch": (anomaly_likelihood_batch, _LIKELIHOOD_SQL),
    "raw_anomaly": (raw_anomaly, f"SELECT a.hour, {fixed_sql('1 - len(list_intersect(a.users, coalesce(b.users, []))) / len(a.users)')} AS score_e6 FROM {_HOURLY_SETS} a LEFT JOIN {_HOURLY_SETS} b ON b.hour + 1 = a.hour"),
    **{f"metric_{n.lower()}": (_metric(n), _ratio_sql(n)) for n in M.METRICS},
    "metric_multistep": (metric_multistep, f"SELECT event_type, {fixed_sql('(avg(abs(t - p1)) + avg(abs(t - p5))) / 2')} AS metric_e6 FROM ({_METRIC_INPUT}) GROUP BY event_type"),
    "metric_windowed": (metric_windowed, f"SELECT event_id, {fixed_sql('sqrt(avg(pow(t - p1, 2)) OVER w)')} AS rmse_e6, {fixed_sql('CASE WHEN sum(abs(t)) FILTER (p1 IS NOT NULL) OVER w > 0 THEN 100 * (sum(abs(t - p1)) OVER w) / (sum(abs(t)) FILTER (p1 IS NOT NULL) OVER w) ELSE 0 END')} AS mape_e6 FROM ({_METRIC_INPUT}) WINDOW w AS ({BY_TYPE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
    "inference_shift": (inference_shift, f"SELECT event_id, {fixed_sql('p1')} AS p1_e6, {fixed_sql('p5')} AS p5_e6 FROM ({_METRIC_INPUT})"),
    "bucket_volume": (bucket_volume, "SELECT event_type AS key, CAST(floor(floor(epoch(ts)) / 900) * 900 AS BIGINT) AS bucket, count(*) AS volume FROM events GROUP BY 1, 2"),
    "bucket_volume_zero_fill": (bucket_volume_zero_fill, "WITH v AS (SELECT event_type AS key, CAST(floor(floor(epoch(ts)) / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS volume FROM events GROUP BY 1, 2), s AS (SELECT unnest(range((SELECT min(bucket) FROM v), (SELECT max(bucket) FROM v) + 1, 3600)) AS bucket) SELECT k.key, s.bucket, coalesce(v.volume, 0) AS volume FROM (SELECT DISTINCT key FROM v) k CROSS JOIN s LEFT JOIN v ON v.key = k.key AND v.bucket = s.bucket"),
    "scrub_increasing_ts": (scrub_increasing_ts, "SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY event_type ORDER BY user_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR ts > m"),
    "metric_data_query": (metric_data_query, f"SELECT uid, rowid, {fixed_sql('score')} AS score_e6 FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY rowid DESC) AS n FROM {_DATA}) WHERE n <= 5 AND score >= 0.5"),
    "metric_tail": (metric_tail, f"SELECT uid, rowid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, rowid DESC) AS n FROM {_DATA} WHERE score IS NOT NULL) WHERE n <= 3"),
    "metric_stats": (metric_stats, f"SELECT uid, {fixed_sql('min(value)')} AS least_e6, {fixed_sql('max(value)')} AS most_e6, count(*) AS n, count(score) AS scored FROM {_DATA} GROUP BY uid"),
    "encoder_resolution": (encoder_resolution, f"WITH r AS (SELECT user_id, min(value) - stddev_pop(value) AS low, max(value) + stddev_pop(value) AS high FROM events GROUP BY 1) SELECT user_id, {fixed_sql('greatest(0.001, ((CASE WHEN high = low THEN low + 1 ELSE high END) - low) / 130)')} AS resolution_e6 FROM r"),
    "reset_learn_flags": (reset_learn_flags, "SELECT event_id, CAST((b IS NOT NULL AND b <> user_id) OR event_type = 'signup' AS INT) AS reset, CAST(event_type <> 'error' AS INT) AS learn FROM (SELECT *, lag(user_id) OVER (ORDER BY ts, event_id) AS b FROM events)"),
    "run_group_by": (run_group_by, "WITH l AS (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS b FROM events), r AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS run FROM l) SELECT CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first_event, count(*) AS n FROM r GROUP BY 1, 2"),
    "duty_cycle": (duty_cycle, f"SELECT event_id, {fixed_sql('avg(CAST(event_type = ' + chr(39) + 'click' + chr(39) + ' AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS duty_e6 FROM events"),
    "duty_cycle_period": (duty_cycle_period, _DUTY),
    "bucket_actual_value_ema": (bucket_actual_value_ema, f"WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, {fixed_sql('sum(value * pow(0.7, age) * CASE WHEN age = n - 1 THEN 1 ELSE 0.3 END)')} AS ema_e6 FROM r GROUP BY user_id"),
    "row_numbers": (row_numbers, "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rec_no FROM events"),
    "count_traces": (count_traces, f"SELECT hour, n, CAST(sum(n) OVER (ORDER BY hour) AS BIGINT) AS running FROM (SELECT {_HOUR} AS hour, count(DISTINCT user_id) AS n FROM events GROUP BY 1)"),
    "trace_stats": (trace_stats, f"SELECT event_type, {fixed_sql('min(value)')} AS least_e6, {fixed_sql('max(value)')} AS most_e6, {fixed_sql('avg(value)')} AS mean_e6, {fixed_sql('stddev_pop(value)')} AS stdev_e6 FROM events GROUP BY 1"),
    "set_traces": (set_traces, f"SELECT a.hour, CAST(len(list_intersect(a.users, b.users)) AS INT) AS predicted_active, CAST(len(b.users) - len(list_intersect(a.users, b.users)) AS INT) AS predicted_inactive, CAST(len(a.users) - len(list_intersect(a.users, b.users)) AS INT) AS unpredicted_active FROM {_HOURLY_SETS} a JOIN {_HOURLY_SETS} b ON b.hour + 1 = a.hour"),
}
