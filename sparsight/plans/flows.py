"""Queries over sources, layers, stored runs, predictions and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import ordered as O
from ..operators import stores as S
from ..sources import records as R
from ..streaming import windows as W
from . import network, search
from .common import events, fixed, fixed_sql, scratch, table, text
from .patterns import _SOFTMAX, _probabilities

ORDER = ["ts", "event_id"]


# -- sources -----------------------------------------------------------------------------------------------------------
def _lines(spark, rows: DataFrame, header: list[str], label: str) -> str:
    """A folder of record files: three header lines in the first, the rows' lines (in order of `at`) behind."""
    path = scratch(spark, label)
    head = spark.createDataFrame([(i - 3, line) for i, line in enumerate(header)], "at long, line string")
    head.union(rows.select("at", "line")).orderBy("at").select("line").write.text(path)
    return path


_CUSTOMERS = ["key, name,balance,since,vip", "int,string,float,datetime,bool", ",,,T,"]


def csv_records(spark, sf) -> DataFrame:
    """Customers written as lines under a three-line header, read as numbered, typed records."""
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("at"),
        F.concat_ws(",", "c_custkey", "c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal").cast("string")).otherwise(""), F.concat(F.lit("2020-01-0"), (F.col("c_custkey") % 9 + 1).cast("string")), (F.col("c_custkey") % 2).cast("string")).alias("line"),
    )
    found = R.csv_records(spark, _lines(spark, rows, _CUSTOMERS, "customers"))
    return found.select("rec_no", F.col("key").cast("bigint").alias("key"), "name", fixed(F.nanvl("balance", F.lit(None))).alias("balance_e6"), F.unix_timestamp("since").alias("since"), F.col("vip").cast("int").alias("vip"))


_CSV = f"""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS rec_no, c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 5 > 0 THEN {fixed_sql('c_acctbal')} END AS balance_e6,
  CAST(epoch(TIMESTAMP '2020-01-01') AS BIGINT) + 86400 * (c_custkey % 9) AS since, CAST(c_custkey % 2 AS INT) AS vip FROM customer"""


def observed_records(spark, sf) -> DataFrame:
    """The same records through the source that reads folders in parts."""
    from ..sources.observed import observed

    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("at"), F.concat_ws(",", "c_custkey", "c_name", "c_acctbal").alias("line"))
    found = observed(spark, _lines(spark, rows, ["key,name,balance", "int,string,float", "S,,"], "observed"))
    return found.select("rec_no", F.col("key").cast("bigint").alias("key"), "name", fixed(F.col("balance")).alias("balance_e6"))


def key_ranges(spark, sf) -> DataFrame:
    """Ranges of customers with about an eighth of the orders each, by which a database would be read."""
    from ..sources.databases import key_ranges

    return key_ranges(table(spark, sf, "orders"), "o_custkey", 8)


def metric_transitions(spark, sf) -> DataFrame:
    """The lives of users as metrics: active from their 25th event on, or at once where their range is known; equal bounds are an error."""
    from ..streaming.lifecycle import transitions_of

    ranges = table(spark, sf, "events").where("user_id % 3 = 0").groupBy(F.col("user_id").alias("key")).agg(F.min("value").alias("low"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(0.0)).alias("high"))
    found = transitions_of(table(spark, sf, "events"), "user_id", "ts", "event_id", 25, ranges)
    return found.select("key", F.col("step").cast("bigint").alias("step"), "record", F.unix_timestamp("ts").alias("ts"), "before", "after")


_TRANSITIONS = """WITH n AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
g AS (SELECT user_id AS key, min(value) AS low, max(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS high FROM events WHERE user_id % 3 = 0 GROUP BY 1),
t AS (
  SELECT key, 0 AS record, NULL AS ts, 0 AS nth, CASE WHEN low >= high THEN 'error' ELSE 'create_pending' END AS after FROM g
  UNION ALL SELECT key, 1, ts, 1, 'active' FROM n JOIN g USING (key) WHERE r = 1 AND low < high
  UNION ALL SELECT key, 1, ts, 0, 'pending_data' FROM n WHERE r = 1 AND key % 3 <> 0
  UNION ALL SELECT key, 25, ts, x.nth, x.after FROM n, (VALUES (0, 'create_pending'), (1, 'active')) x(nth, after) WHERE r = 25 AND key % 3 <> 0
)
SELECT key, row_number() OVER w - 1 AS step, CAST(record AS BIGINT) AS record, ts, coalesce(lag(after) OVER w, 'unmonitored') AS before, after FROM t WINDOW w AS (PARTITION BY key ORDER BY record, nth)"""


def typed_values(spark, sf) -> DataFrame:
    """Orders' values as text of several kinds, read as what they are: numbers (none where there is no number), flags, lists, places."""
    key = F.col("o_orderkey")
    words = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (key % len(xs) + 1).cast("int"))
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(key % 4 > 0, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).otherwise("none").alias("number"), words("True", "0", " t", "no", "1.0").alias("flag"),
        F.concat(F.lit("[1, "), key.cast("string"), F.lit(",x]")).alias("list"), F.concat_ws("; ", (key % 90).cast("string"), F.lit("-7.5"), F.lit("2")).alias("place"),
    )
    read = rows.select("o_orderkey", *[R.decode(F.col(c), kind).alias(c) for c, kind in (("number", "float"), ("flag", "boolean"), ("list", "sarr"), ("place", "geo"))])
    return read.select("o_orderkey", fixed(F.nanvl("number", F.lit(None))).alias("number_e6"), F.col("flag").cast("int").alias("flag"), F.concat_ws(",", F.transform("list", lambda x: F.coalesce(x.cast("string"), F.lit("?")))).alias("list"), fixed(F.get("place", F.lit(0)) + F.get("place", F.lit(1))).alias("place_e6"))


_TYPED_VALUES = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN {fixed_sql('o_totalprice')} END AS number_e6, [1, 0, 1, 0, 1][o_orderkey % 5 + 1] AS flag,
  '1,' || CASE WHEN o_orderkey <= 2147483647 THEN CAST(o_orderkey AS VARCHAR) ELSE '?' END || ',?' AS list, {fixed_sql('CAST(o_orderkey % 90 AS DOUBLE) - 7.5')} AS place_e6 FROM orders"""


def encoder_settings(spark, sf) -> DataFrame:
    """The settings of every user's own scalar encoder, as JSON: its range widened by a deviation, and what follows from it."""
    low, high = S.value_range(F.col("value"), 1.0)
    ranges = table(spark, sf, "events").groupBy("user_id").agg(low.alias("low"), high.alias("high"))
    return ranges.select("user_id", F.to_json(E.settings(F.col("low"), F.col("high"), 21, 421)).alias("settings"))


_SETTINGS = f"""WITH r AS (SELECT user_id, min(value) - stddev_pop(value) AS low, max(value) + stddev_pop(value) AS top FROM events GROUP BY 1), s AS (SELECT user_id, low, CASE WHEN top = low THEN low + 1 ELSE top END AS high FROM r)
SELECT user_id, '{{"w":21,"n":421,"padding":10,"low_e6":' || {fixed_sql('low')} || ',"high_e6":' || {fixed_sql('high')} || ',"resolution_e6":' || {fixed_sql('(high - low) / 400')} || ',"periodic":false}}' AS settings FROM s"""


def csv_custom_rows(spark, sf) -> DataFrame:
    """Lines of another shape, split by the caller's own function."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("at"), F.concat_ws(" | ", "n_regionkey", "n_name").alias("line"))
    path = _lines(spark, rows, ["region,name", "int,string", ","], "nations")
    found = R.csv_records(spark, path, row=lambda line: F.split(line, "\\|"))
    return found.select("rec_no", F.col("region").cast("bigint").alias("region"), "name")


def header_flags(spark, sf) -> DataFrame:
    """Parts as fields of headers: type names and flags as they may be written, and what they stand for."""
    name = F.element_at(F.array(*map(F.lit, _TYPED)), (F.col("p_partkey") % len(_TYPED) + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, _MARKED)), (F.col("p_size") % len(_MARKED) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", R.kind_of(name).alias("kind"), R.flag_of(mark).alias("flag"))


_TYPED = [" Int", "char", "real", "datetime2", "geo", "sarr", "Bool", "list", "nonesuch"]
_MARKED = ["S", "", "t", "reset", " C ", "x", "L"]
_HEADER_FLAGS = """SELECT p_partkey, ['int', 'string', 'float', 'timestamp', 'geo', 'sarr', 'boolean', 'string', 'float'][p_partkey % 9 + 1] AS kind,
  ['sequence', '', 'timestamp', 'reset', 'category', '', 'learn'][p_size % 7 + 1] AS flag FROM part"""


def image_tags(spark, sf) -> DataFrame:
    """Files and tags of an XML list of images."""
    path = scratch(spark, "images")
    tags = table(spark, sf, "part").select(F.concat(F.lit('  <image file="img/'), F.col("p_partkey").cast("string"), F.lit('.png" tag="'), F.col("p_brand"), F.lit('"/>')).alias("line"))
    tags.write.text(path)
    return R.image_list(spark, path)


def metric_configuration(spark, sf) -> DataFrame:
    """Metrics of every resource from a JSON file."""
    path = scratch(spark, "metrics")
    body = F.struct(F.struct(F.struct(F.col("n_regionkey").alias("min")).alias("size"), F.struct(F.col("n_name").alias("unit")).alias("volume")).alias("metrics"))
    table(spark, sf, "nation").select(F.to_json(F.map_from_arrays(F.array("n_name"), F.array(body))).alias("line")).write.text(path)
    return R.metric_configuration(spark, path)


def sine_wave(spark, sf) -> DataFrame:
    """The wave at every customer's key."""
    return table(spark, sf, "customer").select("c_custkey", fixed(R.sine_of(F.col("c_custkey"), 250.0, 3.0, 5.0)).alias("value_e6"))


# -- layers ------------------------------------------------------------------------------------------------------------
def _numbered(spark, sf) -> DataFrame:
    rows = O.running(events(spark, sf).withColumn("all", F.lit(0)), ["all"], "hour", ORDER, {"n": ("count", "event_id")})
    return rows.withColumn("rec_no", F.col("n") - 1)


_NUMBERED = "n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rec_no FROM events)"


def layer_chain(spark, sf) -> DataFrame:
    """One layer: records after the first 50, one type, a user's function, a map."""
    layer = network.Layer("l").skip(50).where(F.col("event_type") == "click").add("halve", lambda df: df.withColumn("half", F.col("value") / 2)).add("map", lambda df: df.select("event_id", "rec_no", fixed(F.col("half")).alias("half_e6")))
    return layer.apply(_numbered(spark, sf))


def region_chain(spark, sf) -> DataFrame:
    """Two connected layers: sums by user of the lower one, those above a bound in the upper one."""
    net = network.Network()
    net.layer("low").add("sum", lambda df: df.groupBy("user_id").agg(F.sum(F.floor("value")).alias("total")))
    net.layer("high").where(F.col("total") > 500)
    return net.connect("low", "high").run(events(spark, sf).select("user_id", "value"))


def resume_records(spark, sf) -> DataFrame:
    """Records after the last that a stored run has done."""
    rows = _numbered(spark, sf).select("rec_no", "event_id")
    folder = scratch(spark, "runs")
    network.store(rows.where("rec_no < 300"), folder, "run", {"until": 300})
    done, settings = network.load(spark, folder, "run")
    return network.resume(rows, done).withColumn("until", F.lit(settings["until"]))


def stored_versions(spark, sf) -> DataFrame:
    """A run stored twice under one name: the newer and the one before it."""
    folder, nation = scratch(spark, "versions"), table(spark, sf, "nation").select("n_nationkey")
    network.store(nation, folder, "n", {"v": 1})
    network.store(nation.where("n_nationkey < 5"), folder, "n", {"v": 2})
    kept = [network.load(spark, folder, "n", back) for back in (0, 1)]
    return kept[0][0].select("n_nationkey", F.lit(kept[0][1]["v"]).alias("v")).union(kept[1][0].select("n_nationkey", F.lit(kept[1][1]["v"])))


def latest_state(spark, sf) -> DataFrame:
    """Each user's last record."""
    return network.latest(_numbered(spark, sf).select("user_id", "rec_no", "event_id", "event_type"), ["user_id"])


def record_dicts(spark, sf) -> DataFrame:
    """Rows as the maps that models read."""
    rows = _numbered(spark, sf)
    found = network.record_dict(rows, ["event_type", "user_id"], F.col("ts"), F.col("rec_no"), category=F.col("user_id") % 3, reset=F.col("event_type") == "error")
    return rows.select("event_id", F.concat_ws(";", F.array_sort(F.transform(F.map_entries(found), lambda e: F.concat_ws("=", e.key, e.value)))).alias("record"))


_DICT = f"""WITH {_NUMBERED} SELECT event_id, concat_ws(';', '_category=' || user_id % 3, '_reset=' || CAST(event_type = 'error' AS INT), '_sequenceId=0', '_timestamp=' || CAST(floor(epoch(ts)) AS BIGINT),
  '_timestampRecordIdx=' || rec_no, 'event_type=' || event_type, 'user_id=' || user_id) AS record FROM n"""


def backlog_replay(spark, sf) -> DataFrame:
    """Rows that models of some users must catch up on, in batches of 100."""
    started = events(spark, sf).select("user_id").distinct().where("user_id % 2 = 0").withColumn("last", F.when(F.col("user_id") % 4 == 0, F.col("user_id") * 10))
    return network.backlog(_numbered(spark, sf).select("user_id", "rec_no", "event_id"), started, ["user_id"], "rec_no", 100).select("event_id", "batch")


# -- windows, predictions ------------------------------------------------------------------------------------------------
def tumbling_volumes(spark, sf) -> DataFrame:
    """Events a type and window of six hours."""
    return W.volumes(events(spark, sf), "ts", "event_type", 21_600)


def most_probable(spark, sf) -> DataFrame:
    """Each user's likeliest type, the first of equals; none where all are impossible."""
    return _probabilities(spark, sf).where("p > 0").groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.round("p", 9), "event_type")).alias("best"))


def multi_step_predictions(spark, sf) -> DataFrame:
    """Probabilities of buckets added up by the value they stand for; the best first, unlikely ones dropped."""
    rows = _probabilities(spark, sf).withColumn("actual", F.substring("event_type", 1, 1))
    found = network.multi_step_predictions(rows, ["user_id"], "actual", "p", 0.05, 3)
    return network.add_deltas(found, "rank", "user_id", "moved").select("user_id", "actual", fixed(F.col("p")).alias("p_e6"), F.col("rank").cast("bigint").alias("rank"), "is_best", F.col("moved").cast("bigint").alias("moved"))


_MULTI = f"""WITH s AS (SELECT user_id, substr(event_type, 1, 1) AS actual, sum(p) AS p FROM {_SOFTMAX} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, actual) AS "rank" FROM s)
SELECT user_id, actual, {fixed_sql('p')} AS p_e6, "rank", "rank" = 1 AS is_best, user_id + "rank" AS moved FROM r WHERE p >= 0.05 AND "rank" <= 3"""


# -- neighbours ----------------------------------------------------------------------------------------------------------
def _found(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x * 256).cast("double")).alias("x"), F.col("label").alias("category"))
    forgotten = rows.where("id % 3 = 1").select("id")
    return N.closest(rows.where("id % 20 = 0"), N.forget(rows, forgotten), 1, by_category=True)


_DISTANCES = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS FLOAT) * 256)::DOUBLE) AS x FROM embeddings),
d AS (SELECT q.vec_id AS q, p.vec_id AS p, p.label, list_sum(list_transform(list_zip(q.x, p.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v q JOIN v p ON p.vec_id % 3 <> 1 WHERE q.vec_id % 20 = 0)"""


def knn_closest_of_category(spark, sf) -> DataFrame:
    """The nearest pattern of one category, among those that weren't removed."""
    return N.closest_of_category(_found(spark, sf), 2).select("query_id", "proto_id")


def knn_learn_apart(spark, sf) -> DataFrame:
    """Patterns that are learned with a least distance to those learned before."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x * 256).cast("double")).alias("x"), F.col("label").alias("category"))
    return N.learn(rows, distance_threshold=250.0).select("id", "category")


_APART = """WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id AS id, label AS category, list_transform(embedding, lambda x: floor(CAST(x AS FLOAT) * 256)::DOUBLE) AS x FROM embeddings),
k(n, kept, id, category) AS (
  SELECT 0::BIGINT, []::DOUBLE[][], NULL::BIGINT, NULL::INTEGER
  UNION ALL
  SELECT v.n, CASE WHEN near THEN kept ELSE list_append(kept, x) END, CASE WHEN near THEN NULL ELSE v.id END, v.category
  FROM (SELECT v.n, v.id, v.category, v.x, k.kept, len(list_filter(k.kept, lambda y: sqrt(list_sum(list_transform(list_zip(y, v.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) < 250.0)) > 0 AS near FROM k JOIN v ON v.n = k.n + 1) v
)
SELECT id, category FROM k WHERE id IS NOT NULL"""


# -- search ------------------------------------------------------------------------------------------------------------
def combinations_of_types(spark, sf) -> DataFrame:
    """All pairs and triples of event types."""
    kinds = events(spark, sf).select("event_type").distinct()
    return search.combinations(kinds, "event_type", 2).union(search.combinations(kinds, "event_type", 3)).select(text(F.col("c")).alias("kinds"))


def grid_points(spark, sf) -> DataFrame:
    """All combinations of sizes and types that the parts of a brand have."""
    values = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_size").alias("sizes"), F.collect_set("p_type").alias("types"))
    return search.grids(values, "p_brand", size=F.col("sizes"), kind=F.col("types"))


def grid_search_errors(spark, sf) -> DataFrame:
    """The mean error of lines through the events, for every slope and offset of a grid."""
    off = lambda c: F.abs(F.floor("value") - c["slope"] * (F.col("event_id") % 50) - c["offset"])
    return search.grid_errors(table(spark, sf, "events"), off, slope=[1, 3, 4], offset=[0, 10]).select("settings", fixed(F.col("error")).alias("error_e6"))


_GRID_ERRORS = f"""SELECT 'offset=' || o || ',slope=' || s AS settings, {fixed_sql("avg(abs(floor(value) - s * (event_id % 50) - o))")} AS error_e6
FROM events, (VALUES (1), (3), (4)) a(s), (VALUES (0), (10)) b(o) GROUP BY s, o"""


def model_error_scores(spark, sf) -> DataFrame:
    """Suppliers as models: a score only of those that matured and ended well, negated where more is better."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 2 == 0).alias("matured"), F.element_at(F.array(*map(F.lit, ("eof", "stopped", "killed"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("reason"))
    score = lambda up: S.model_error(F.col("s_acctbal"), up, F.col("matured"), F.col("reason"))
    finite = lambda c: F.when(F.abs(c) < float("inf"), fixed(c))
    return rows.select("s_suppkey", finite(score(False)).alias("least_e6"), finite(score(True)).alias("most_e6"))


def results_database(spark, sf) -> DataFrame:
    """Line items as reports of models: the newest a set of parameters, orphans apart, the best a generation."""
    rows = table(spark, sf, "lineitem").select(F.concat_ws(":", "l_suppkey", "l_linenumber").alias("params"), (F.col("l_suppkey") % 4).alias("generation"), F.floor(F.col("l_tax") * 100).alias("error"), F.col("l_orderkey").alias("reported"), (F.col("l_linenumber") == 7).alias("orphan"))
    return search.results_by_generation(rows)


_RESULTS = """WITH r AS (SELECT concat_ws(':', l_suppkey, l_linenumber) AS params, l_suppkey % 4 AS generation, floor(l_tax * 100) AS error, l_orderkey AS reported, l_linenumber = 7 AS orphan FROM lineitem),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY params ORDER BY reported DESC, error, generation) AS n FROM r WHERE NOT orphan) WHERE n = 1)
SELECT generation, count(*) AS models, CAST(min(error) AS BIGINT) AS error, min_by(params, {'e': error, 'p': params}) AS best FROM u GROUP BY 1"""


def search_report(spark, sf) -> DataFrame:
    """Results written as a CSV report, read back."""
    rows = table(spark, sf, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return network.column_report(rows, scratch(spark, "report"))


def useless_swarms(spark, sf) -> DataFrame:
    """Combinations of fields that can't help any more: no gain over the best of their parts."""
    rows = table(spark, sf, "supplier").select(F.array_sort(F.array_distinct(F.array(F.col("s_nationkey") % 3, F.col("s_nationkey") % 5))).alias("fields"), F.floor(F.abs("s_acctbal")).alias("error"))
    return search.useless(rows.groupBy("fields").agg(F.min("error").alias("error")), 5.0).select(text(F.col("fields")).alias("fields"), "useless")


_USELESS = """WITH f AS (SELECT list_sort(list_distinct([s_nationkey % 3, s_nationkey % 5])) AS f, min(floor(abs(s_acctbal))) AS e FROM supplier GROUP BY 1),
p AS (SELECT a.f, a.e, min(b.e) AS before FROM f a LEFT JOIN f b ON len(a.f) > len(b.f) AND list_has_all(a.f, b.f) GROUP BY 1, 2)
SELECT array_to_string(f, ',') AS fields, coalesce((before - e) * 100 < 5 * before, false) AS useless FROM p"""

# -- metrics by label, stored tables -----------------------------------------------------------------------------------
def metrics_manager(spark, sf) -> DataFrame:
    """A value predicts its tens for the next record of its type (temporal) and for itself (not temporal)."""
    rows = events(spark, sf).withColumn("tens", F.floor(F.col("value") / 10) * 10.0)
    specs = [{"element": "prediction", "kind": "TemporalNextStep", "metric": m, "field": "value", "prediction": "tens", "params": {"steps": 1}} for m in ("aae", "rmse", "altMAPE")]
    specs.append({"element": "encoding", "kind": "NontemporalAnomaly", "metric": "aae", "field": "value", "prediction": "tens"})
    found = M.manage(rows, ["event_type"], "hour", ORDER, specs)
    return found.select("event_type", "label", fixed(F.col("value")).alias("value_e6"))


_MANAGER = f"""WITH r AS (SELECT event_type, value, floor(value / 10) * 10.0 AS tens FROM events),
l AS (SELECT event_type, value, lag(floor(value / 10) * 10.0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)
SELECT event_type, 'prediction:aae:steps=1:field=value' AS label, {fixed_sql("avg(abs(value - p))")} AS value_e6 FROM l GROUP BY 1
UNION ALL SELECT event_type, 'prediction:rmse:steps=1:field=value', {fixed_sql("sqrt(avg(pow(value - p, 2)))")} FROM l GROUP BY 1
UNION ALL SELECT event_type, 'prediction:altMAPE:steps=1:field=value', {fixed_sql("100 * sum(abs(value - p)) / sum(abs(value)) FILTER (p IS NOT NULL)")} FROM l GROUP BY 1
UNION ALL SELECT event_type, 'encoding:aae:field=value', {fixed_sql("avg(abs(value - tens))")} FROM r GROUP BY 1"""


def inference_kinds(spark, sf) -> DataFrame:
    """Events as inferences of several kinds: which are shifted before they are held against the truth."""
    kind = F.element_at(F.array(*map(F.lit, [*M.KINDS, "unknown"])), (F.col("event_id") % (len(M.KINDS) + 1) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", M.shifted(kind).alias("shifted"))


def stored_metrics(spark, sf) -> DataFrame:
    """Customers as metrics: orders change them (the latest counts), those of a region are deleted, the indebted are marked."""
    own = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("size"), F.lit("new").alias("status"))
    orders = table(spark, sf, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000).alias("c_custkey"), F.col("o_totalprice").alias("size"), F.lit("changed").alias("status"), "o_orderkey")
    changed = S.upsert(own, orders, "c_custkey", "o_orderkey")
    kept = S.membership(changed, table(spark, sf, "customer").where("c_nationkey < 5"), "c_custkey", inverted=True)
    marked = S.with_status(kept, table(spark, sf, "customer").where("c_acctbal < 0"), "c_custkey", "error")
    return marked.select("c_custkey", fixed(F.col("size")).alias("size_e6"), "status")


_STORED = f"""WITH c AS (SELECT o_custkey + o_orderkey % 2 * 1000000 AS k, arg_max(o_totalprice, o_orderkey) AS size FROM orders GROUP BY 1),
a AS (SELECT k, size, 'changed' AS status FROM c UNION ALL SELECT c_custkey, c_acctbal, 'new' FROM customer WHERE c_custkey NOT IN (SELECT k FROM c))
SELECT k AS c_custkey, {fixed_sql("size")} AS size_e6, CASE WHEN k IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'error' ELSE status END AS status
FROM a WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)"""


def adopted_models(spark, sf) -> DataFrame:
    """Models by the hash of their parameters (brand and size of a part): those known stay, of the others the first is taken."""
    parts = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("params"), F.col("p_partkey").alias("model"))
    known = parts.where("model <= 50").groupBy("params").agg(F.max("model").alias("model"))
    return S.adopt(known, parts.where("model > 50"), "params", "model")


_ADOPTED = """WITH p AS (SELECT p_brand || '/' || p_size AS params, p_partkey AS model FROM part),
k AS (SELECT params, max(model) AS model FROM p WHERE model <= 50 GROUP BY 1)
SELECT * FROM k UNION ALL SELECT params, min(model) FROM p WHERE model > 50 AND params NOT IN (SELECT params FROM k) GROUP BY 1"""

QUERIES = {
    "metrics_manager": (metrics_manager, _MANAGER),
    "inference_kinds": (inference_kinds, "SELECT event_id, [false, true, true, false, true, false, true, true, false, NULL][event_id % 10 + 1] AS shifted FROM events"),
    "stored_metrics": (stored_metrics, _STORED),
    "adopted_models": (adopted_models, _ADOPTED),
    "csv_records": (csv_records, _CSV),
    "observed_records": (observed_records, f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS rec_no, c_custkey AS key, c_name AS name, {fixed_sql('c_acctbal')} AS balance_e6 FROM customer"),
    "key_ranges": (key_ranges, "WITH k AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1), u AS (SELECT k, n, sum(n) OVER (ORDER BY k) AS upto, sum(n) OVER () AS total FROM k) SELECT CAST((upto - n) * 8 // total AS BIGINT) AS part, min(k) AS low, max(k) AS high, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1"),
    "metric_transitions": (metric_transitions, _TRANSITIONS),
    "typed_values": (typed_values, _TYPED_VALUES),
    "encoder_settings": (encoder_settings, _SETTINGS),
    "csv_custom_rows": (csv_custom_rows, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rec_no, CAST(n_regionkey AS BIGINT) AS region, n_name AS name FROM nation"),
    "header_flags": (header_flags, _HEADER_FLAGS),
    "image_tags": (image_tags, "SELECT 'img/' || p_partkey || '.png' AS file, p_brand AS tag FROM part"),
    "metric_configuration": (metric_configuration, "SELECT n_name AS resource, 'size' AS metric, '{\"min\": ' || n_regionkey || '}' AS settings FROM nation UNION ALL SELECT n_name, 'volume', '{\"unit\": \"' || n_name || '\"}' FROM nation"),
    "sine_wave": (sine_wave, f"SELECT c_custkey, {fixed_sql('round(5.0 * sin(2 * pi() * 3.0 * c_custkey / 250.0), 2)')} AS value_e6 FROM customer"),
    "layer_chain": (layer_chain, f"WITH {_NUMBERED} SELECT event_id, rec_no, {fixed_sql('value / 2')} AS half_e6 FROM n WHERE rec_no >= 50 AND event_type = 'click'"),
    "region_chain": (region_chain, "SELECT user_id, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY 1 HAVING sum(floor(value)) > 500"),
    "resume_records": (resume_records, f"WITH {_NUMBERED} SELECT rec_no, event_id, 300 AS until FROM n WHERE rec_no >= 300"),
    "stored_versions": (stored_versions, "SELECT n_nationkey, 2 AS v FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, 1 FROM nation"),
    "latest_state": (latest_state, f"WITH {_NUMBERED} SELECT user_id, rec_no, event_id, event_type FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rec_no DESC) = 1"),
    "record_dicts": (record_dicts, _DICT),
    "backlog_replay": (backlog_replay, f"WITH {_NUMBERED}, s AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN user_id * 10 ELSE -1 END AS after FROM n WHERE user_id % 2 = 0) SELECT event_id, (rec_no - after - 1) // 100 AS batch FROM s WHERE rec_no > after"),
    "tumbling_volumes": (tumbling_volumes, "SELECT event_type AS key, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS bucket, count(*) AS volume FROM events GROUP BY 1, 2"),
    "most_probable": (most_probable, f"SELECT user_id, event_type AS best FROM {_SOFTMAX} WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, event_type) = 1"),
    "multi_step_predictions": (multi_step_predictions, _MULTI),
    "knn_closest_of_category": (knn_closest_of_category, f"WITH {_DISTANCES} SELECT q AS query_id, p AS proto_id FROM d WHERE label = 2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, p) = 1"),
    "knn_learn_apart": (knn_learn_apart, _APART),
    "combinations_of_types": (combinations_of_types, "WITH k AS (SELECT DISTINCT event_type AS t FROM events) SELECT concat_ws(',', a.t, b.t) AS kinds FROM k a JOIN k b ON b.t > a.t UNION ALL SELECT concat_ws(',', a.t, b.t, c.t) FROM k a JOIN k b ON b.t > a.t JOIN k c ON c.t > b.t"),
    "grid_points": (grid_points, "SELECT DISTINCT a.p_brand, a.p_size AS size, b.p_type AS kind FROM part a JOIN part b USING (p_brand)"),
    "grid_search_errors": (grid_search_errors, _GRID_ERRORS),
    "model_error_scores": (model_error_scores, f"SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 < 2 THEN {fixed_sql('s_acctbal')} END AS least_e6, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 < 2 THEN {fixed_sql('-s_acctbal')} END AS most_e6 FROM supplier"),
    "results_database": (results_database, _RESULTS),
    "search_report": (search_report, "SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"),
    "useless_swarms": (useless_swarms, _USELESS),
}
