"""Queries over patterns, bipartite graphs and sets: neighbours, inhibition, votes, merges, array kernels, model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..functions import sdr as A
from ..operators import columns as C
from ..operators import neighbours as N
from ..operators import runs as U
from ..operators import stores as S
from .common import events, fixed, fixed_sql, table, text

DIMS = 64


def _patterns(spark, sf) -> DataFrame:
    """Each embedding in 64ths, as whole numbers, so that sums are exact."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 64).cast("double"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"), F.col("label").alias("category"), F.pmod("vec_id", F.lit(3)).alias("partition"))


_P = f"(SELECT vec_id AS id, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 64)) AS x, label AS category, vec_id % 3 AS part FROM embeddings)"
_B = "(SELECT id, list_transform(x, lambda v: CAST(v > 0 AS DOUBLE)) AS x, category, part FROM " + _P + ")"


def _binary(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.transform("x", lambda v: (v > 0).cast("double")))


def _asked(rows: DataFrame) -> DataFrame:
    """The stated queries: every twentieth pattern; patterns are compared with all others."""
    return rows.where(F.col("id") % 20 == 0)


def _found(spark, sf, k, method="norm", power=2, partitions=False, by_category=False) -> DataFrame:
    rows = _patterns(spark, sf) if method == "norm" else _binary(_patterns(spark, sf))
    return N.closest(_asked(rows), rows, k, method, power, partitions, exclude_self=True, by_category=by_category)


def _knn(method, power=2, partitions=False):
    def query(spark, sf) -> DataFrame:
        near = N.nearest(_found(spark, sf, 5, method, power, partitions), 5)
        return near.select("query_id", F.col("rank").cast("bigint").alias("rank"), "proto_id", fixed(F.col("dist")).alias("dist_e6"))

    return query


_DOT = "list_sum(list_transform(list_zip(q.x, p.x), lambda z: z[1] * z[2]))"
_DISTANCE = {
    "l2": (_P, "sqrt(list_sum(list_transform(list_zip(q.x, p.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"),
    "l1": (_P, "list_sum(list_transform(list_zip(q.x, p.x), lambda z: abs(z[1] - z[2])))"),
    "raw_overlap": (_B, f"list_sum(q.x) - {_DOT}"),
    "pct_input": (_B, f"CASE WHEN list_sum(q.x) > 0 THEN 1 - {_DOT} / list_sum(q.x) ELSE 1.0 END"),
    "pct_prototype": (_B, f"CASE WHEN list_sum(p.x) > 0 THEN 1 - {_DOT} / list_sum(p.x) ELSE 1.0 END"),
    "pct_larger": (_B, f"CASE WHEN greatest(list_sum(q.x), list_sum(p.x)) > 0 THEN 1 - {_DOT} / greatest(list_sum(q.x), list_sum(p.x)) ELSE 1.0 END"),
}


def _found_sql(kind: str, extra: str = "") -> str:
    rows, expr = _DISTANCE[kind]
    return f"(SELECT q.id AS query_id, p.id AS proto_id, p.category, {expr} AS dist FROM {rows} q JOIN {rows} p ON q.id <> p.id {extra} WHERE q.id % 20 = 0)"


def _knn_sql(kind: str, extra: str = "") -> str:
    return f"SELECT query_id, rank, proto_id, {fixed_sql('dist')} AS dist_e6 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, proto_id) AS rank FROM {_found_sql(kind, extra)}) WHERE rank <= 5"


def knn_vote(spark, sf) -> DataFrame:
    v = N.vote(_found(spark, sf, 5), 5)
    return v.select("query_id", "winner", fixed(F.col("share")).alias("share_e6"))


def knn_category_distance(spark, sf) -> DataFrame:
    d = N.category_distance(_found(spark, sf, 1, "pct_input", by_category=True))
    return d.select("query_id", "category", fixed(F.col("dist")).alias("dist_e6"))


def knn_sparsify(spark, sf) -> DataFrame:
    x = N.sparsify(F.col("x"), 20.0, winners=3, binarise=True)
    return _patterns(spark, sf).select("id", text(F.transform(x, lambda v: v.cast("int"))).alias("bits"))


def knn_learn(spark, sf) -> DataFrame:
    """One prototype of equal coarse patterns of a category."""
    rows = _patterns(spark, sf).withColumn("x", F.transform("x", lambda v: F.floor(v / 40)))
    return N.learn(rows).select("id", "category")


def exact_match_classify(spark, sf) -> DataFrame:
    """Documents that are verbatim a document with a smaller id of another source."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return N.exact_match(docs, docs.withColumnRenamed("source", "first_source"), "text", "first_source", "doc_id").select("doc_id", F.col("match").alias("first_source"))


def _graph(spark, sf) -> DataFrame:
    """Orders as records whose bits are parts; suppliers as columns connected to the parts they shipped."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_partkey").alias("bit"), F.col("l_suppkey").alias("col"))


def _overlaps(spark, sf) -> DataFrame:
    g = _graph(spark, sf)
    connected = g.select("col", "bit").distinct()
    return C.overlap_join(g.select("rec", "bit").distinct(), connected)


def overlap_join(spark, sf) -> DataFrame:
    return _overlaps(spark, sf).select("rec", "col", "overlap")


def topk_inhibition(spark, sf) -> DataFrame:
    g = _graph(spark, sf)
    best = C.top_columns(g.select("rec", "bit").distinct(), g.select("col", "bit").distinct(), 3, 1)
    return best.select("rec", "col", F.col("rank").cast("bigint").alias("rank"))


_OVERLAP = "(SELECT b.rec, c.col, count(*) AS overlap FROM (SELECT DISTINCT l_orderkey AS rec, l_partkey AS bit FROM lineitem) b JOIN (SELECT DISTINCT l_suppkey AS col, l_partkey AS bit FROM lineitem) c USING (bit) GROUP BY 1, 2)"


def segment_activity(spark, sf) -> DataFrame:
    """Orders as segments with synapses to parts (permanence by discount); cells are the parts of brand Brand#1."""
    synapses = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seg"), F.col("l_partkey").alias("cell"), (F.col("l_discount") * 5).alias("perm"))
    active = table(spark, sf, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("cell"))
    return C.segment_activity(active, synapses, 0.2, 2, 2)


MERGED = 64


def cogroup_merge(spark, sf) -> DataFrame:
    """Orders, nations and events of customers side by side, in parts of 64 items."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    late = table(spark, sf, "events").select("user_id", "event_id")
    m = U.merged_lists([(orders, "o_custkey", "o_orderkey"), (customers, "c_custkey", "c_nationkey"), (late, "user_id", "event_id")], MERGED)
    return m.select("key", "part", text(F.col("list1")).alias("orders"), text(F.col("list2")).alias("nations"), text(F.col("list3")).alias("events"))


def _parts_of_orders(spark, sf) -> DataFrame:
    """Orders as sequences, parts as cells."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sequence"), F.col("l_partkey").alias("cell"))


def cells_per_sequence(spark, sf) -> DataFrame:
    return C.cells_of_sequences(_parts_of_orders(spark, sf))


def sequences_per_cell(spark, sf) -> DataFrame:
    return C.sequences_of_cells(_parts_of_orders(spark, sf))


def shared_cells(spark, sf) -> DataFrame:
    """Parts that the suppliers of two nations both deliver: nations as sequences, parts as cells."""
    nations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("sequence"))
    return C.shared_cells(table(spark, sf, "lineitem").join(nations, "l_suppkey").select("sequence", F.col("l_partkey").alias("cell")))


def tag_join_volume(spark, sf) -> DataFrame:
    """Documents belong to metrics by their source and by their language."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sample"), "source", "lang")
    routes = {c: docs.select(c).where(F.col(c).isNotNull()).distinct().select(c, F.concat(F.lit(f"{c}:"), c).alias("metric")) for c in ("source", "lang")}
    return S.tag_join(docs, routes).groupBy("metric").agg(F.count(F.lit(1)).alias("volume"))


def positional_zip(spark, sf) -> DataFrame:
    rows = _patterns(spark, sf)
    z = F.arrays_zip(F.col("x").alias("a"), F.reverse("x").alias("b"))
    return rows.select("id", F.concat_ws(";", F.transform(z, lambda s: F.concat_ws(":", s["a"].cast("bigint").cast("string"), s["b"].cast("bigint").cast("string")))).alias("pairs"))


def sparse_set_ops(spark, sf) -> DataFrame:
    rows = _patterns(spark, sf)
    bits = lambda a: F.filter(F.transform(a, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    rows = rows.select("id", bits(F.col("x")).alias("a"), bits(F.reverse("x")).alias("b"))
    return rows.select("id", text(A.intersection(F.col("a"), F.col("b"))).alias("both"), text(A.union(F.col("a"), F.col("b"))).alias("any"), text(A.difference(F.col("a"), F.col("b"))).alias("left_only"), A.contains_all(F.col("a"), F.col("b")).cast("int").alias("holds"))


def cells_to_columns(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("int")).alias("cells"))
    columns = A.cells_to_columns(F.col("cells"), 32)
    return rows.select("l_orderkey", text(columns).alias("columns"), F.size(A.columns_to_cells(columns, 32)).alias("n_cells"))


def topology_neighbourhood(spark, sf) -> DataFrame:
    at = F.col("p_partkey") % 48
    return table(spark, sf, "part").select("p_partkey", text(A.neighbourhood(at, 1, [8, 6])).alias("box"), text(A.neighbourhood(at, 1, [8, 6], wrap=True)).alias("wrapped"))


def array_arithmetic(spark, sf) -> DataFrame:
    rows = _patterns(spark, sf)
    x, y = F.col("x"), F.reverse("x")
    whole = lambda a: text(F.transform(a, lambda v: v.cast("bigint")))
    return rows.select(
        "id", whole(A.add(x, y)).alias("plus"), whole(A.multiply(x, y)).alias("times"), whole(A.modulo(x, 7)).alias("mod7"), whole(A.clip(x, -5.0, 5.0)).alias("clipped"),
        whole(A.maximum(x, y)).alias("larger"), whole(A.dense_and(x, y)).alias("ands"), whole(A.differences(x)).alias("steps"), whole(A.running_sum(x)).alias("sums"),
        A.dot(x, y).cast("bigint").alias("dot"), A.count_where(x, lambda v: v > 3).alias("over3"), A.argmax(x).alias("first_max"), text(A.argsort(x)).alias("by_value"), text(A.greatest_positions(x, 3)).alias("top3"),
        fixed(A.variance(x)).alias("variance_e6"), whole(A.where_set(x, lambda v: v < 0, 0.0)).alias("cut"), whole(A.gather(x, F.array(F.lit(63), F.lit(0), F.lit(3)))).alias("picked"), fixed(A.total(A.divide(x, y))).alias("ratio_e6"),
    )


_ARITHMETIC_SQL = f"""
WITH r AS (SELECT id, x, list_reverse(x) AS y FROM {_P}), z AS (SELECT *, list_zip(x, y) AS xy FROM r),
i AS (SELECT id, list(k ORDER BY v, k) AS asc_k, list(k ORDER BY v DESC, k) AS desc_k FROM (SELECT id, unnest(range({DIMS})) AS k, unnest(x) AS v FROM r) GROUP BY id)
SELECT id, {', '.join(f"array_to_string(list_transform({e}, lambda v: CAST(v AS BIGINT)), ',') AS {n}" for n, e in (
    ("plus", "list_transform(xy, lambda p: p[1] + p[2])"), ("times", "list_transform(xy, lambda p: p[1] * p[2])"), ("mod7", "list_transform(x, lambda v: ((v % 7) + 7) % 7)"),
    ("clipped", "list_transform(x, lambda v: greatest(-5, least(5, v)))"), ("larger", "list_transform(xy, lambda p: greatest(p[1], p[2]))"), ("ands", "list_transform(xy, lambda p: CAST(p[1] > 0 AND p[2] > 0 AS INT))"),
    ("steps", f"list_transform(range(1, {DIMS}), lambda k: x[k + 1] - x[k])"), ("sums", f"list_transform(range(1, {DIMS} + 1), lambda k: list_sum(x[1:k]))"), ("cut", "list_transform(x, lambda v: CASE WHEN v < 0 THEN 0 ELSE v END)"), ("picked", "[x[64], x[1], x[4]]")))},
  CAST(list_sum(list_transform(xy, lambda p: p[1] * p[2])) AS BIGINT) AS dot, CAST(len(list_filter(x, lambda v: v > 3)) AS INT) AS over3, CAST(list_position(x, list_max(x)) - 1 AS INT) AS first_max,
  array_to_string(asc_k, ',') AS by_value, array_to_string(desc_k[1:3], ',') AS top3,
  {fixed_sql(f"list_sum(list_transform(x, lambda v: v * v)) / {DIMS} - pow(list_sum(x) / {DIMS}, 2)")} AS variance_e6, {fixed_sql("list_sum(list_transform(xy, lambda p: p[1] / CASE WHEN p[2] = 0 THEN 1.0 ELSE p[2] END))")} AS ratio_e6
FROM z JOIN i USING (id)
"""


def cla_votes(spark, sf) -> DataFrame:
    """Users (bits) vote for the event type (bucket) of the hour (record): weights by how often they did it before, decaying by age in events."""
    e = events(spark, sf)
    history = e.select(F.col("user_id").alias("bit"), F.col("event_type").alias("bucket"), F.floor(F.lit(0) + (F.lit(2_000_000) - F.col("hour")) / 24).alias("age"))
    votes = C.bucket_votes(e.select(F.col("hour").alias("rec"), F.col("user_id").alias("bit")).distinct(), C.decayed_histogram(history.withColumn("age", F.pmod("age", F.lit(30))), 0.1))
    return votes.select("rec", "bucket", fixed(F.col("p")).alias("p_e6"))


def _probabilities(spark, sf) -> DataFrame:
    counts = events(spark, sf).groupBy("user_id", "event_type").agg((F.sum(F.floor("value")) / 100).alias("s"))
    return C.softmax_rows(counts, ["user_id"], "s")


def softmax_infer(spark, sf) -> DataFrame:
    return _probabilities(spark, sf).select("user_id", "event_type", fixed(F.col("p")).alias("p_e6"))


def remove_unlikely(spark, sf) -> DataFrame:
    return C.drop_unlikely(_probabilities(spark, sf), ["user_id"], "event_type", "p", 0.2, 2).select("user_id", "event_type", F.col("rank").cast("bigint").alias("rank"))


_SOFTMAX = "(WITH c AS (SELECT user_id, event_type, sum(floor(value)) / 100 AS s FROM events GROUP BY 1, 2), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY user_id)) AS e FROM c) SELECT user_id, event_type, e / sum(e) OVER (PARTITION BY user_id) AS p FROM e)"


def best_model(spark, sf) -> DataFrame:
    """Suppliers as models, line items as evaluations: the model of least mean error of each nation."""
    items = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.floor(F.col("l_tax") * 100)).alias("e"), F.count(F.lit(1)).alias("n"))
    rows = items.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct((F.col("e") / F.col("n")), "s_suppkey")).alias("model"))


def swarm_best_so_far(spark, sf) -> DataFrame:
    """Running least error of each nation's models, in order of the model."""
    items = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(fixed(F.sum(F.floor(F.col("l_tax") * 100)) / F.count(F.lit(1))).alias("err"))
    rows = items.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("s_nationkey", "s_suppkey", F.min("err").over(w).alias("best_e6"))


def field_contributions(spark, sf) -> DataFrame:
    """Per cent by which each ship year's mean tax lies below the mean of all of a flag."""
    items = table(spark, sf, "lineitem").withColumn("cents", F.floor(F.col("l_tax") * 100))
    base = items.groupBy("l_returnflag").agg((F.sum("cents") / F.count(F.lit(1))).alias("base"))
    rows = items.groupBy("l_returnflag", F.year("l_shipdate").alias("field")).agg((F.sum("cents") / F.count(F.lit(1))).alias("err"))
    floor = F.greatest("base", F.lit(1e-5))
    return rows.join(base, "l_returnflag").select("l_returnflag", F.col("field").cast("bigint").alias("field"), fixed((floor - F.col("err")) * 100 / floor).alias("pct_e6"))


def _places(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") * 7 % 160 - 80).cast("double").alias("lat"), (F.col("c_custkey") % 40).cast("double").alias("speed"))


_PLACES = "(SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 7 % 160 - 80 AS DOUBLE) AS lat, CAST(c_custkey % 40 AS DOUBLE) AS speed FROM customer)"
_MERCATOR = (f"radians(lon) * {E.EARTH}", f"{E.EARTH} * ln(tan(pi() / 4 + radians(lat) / 2))")


def mercator(spark, sf) -> DataFrame:
    x, y = E.mercator(F.col("lon"), F.col("lat"))
    return _places(spark, sf).select("c_custkey", F.floor(x * 10 + 0.5).cast("bigint").alias("x_e1"), F.floor(y * 10 + 0.5).cast("bigint").alias("y_e1"))


def inverse_mercator(spark, sf) -> DataFrame:
    lon, lat = E.inverse_mercator(*E.mercator(F.col("lon"), F.col("lat")))
    return _places(spark, sf).select("c_custkey", fixed(lon).alias("lon_e6"), fixed(lat).alias("lat_e6"))


def radius_for_speed(spark, sf) -> DataFrame:
    return _places(spark, sf).select("c_custkey", E.radius_for_speed(F.col("speed"), 60, 30, 21).alias("radius"))


def coordinate_bits(spark, sf) -> DataFrame:
    bits = E.coordinate_bits((F.col("c_custkey") % 100).cast("bigint"), F.floor(F.col("c_custkey") / 100).cast("bigint"), F.lit(2).cast("bigint"), 21, 1000)
    return _places(spark, sf).select("c_custkey", text(bits).alias("bits"))


def geo_bits(spark, sf) -> DataFrame:
    """Bits of customers' places; customers that share place and speed share one encoding."""
    at = ["lon", "lat", "speed"]
    different = _places(spark, sf).select(*at).distinct().repartition(spark.sparkContext.defaultParallelism * 4)
    coded = different.select(*at, text(E.geo_bits(F.col("lon"), F.col("lat"), F.col("speed") / 10, 21, 1000)).alias("bits"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in at]
    return _places(spark, sf).alias("p").join(coded.alias("c"), same).select("p.c_custkey", "c.bits")


def _coordinate_sql(places: str, w: int, n: int) -> str:
    """Bits of places(key, x, y, radius): the cells around with the highest hashes, each hashed to a bit."""
    hashed = lambda seed: f"CAST('0x' || substr(md5(concat_ws(':', {seed}, x, y)), 1, 12) AS BIGINT)"
    return f"""cells AS (SELECT key, x + i AS x, y + j AS y FROM (SELECT *, unnest(range(-radius, radius + 1)) AS i FROM ({places})) p, unnest(range(-radius, radius + 1)) r(j)),
best AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY key ORDER BY {hashed(42)} DESC, x, y) <= {w}),
bits AS (SELECT DISTINCT key, {hashed(43)} % {n} AS bit FROM best)"""


_GEO = f"SELECT c_custkey AS key, CAST(floor({_MERCATOR[0]} / 30) AS BIGINT) AS x, CAST(floor({_MERCATOR[1]} / 30) AS BIGINT) AS y, CAST(greatest(ceil(speed / 10 * 60 / 30 * 1.5 / 2), ceil((sqrt(21) - 1) / 2)) AS BIGINT) AS radius FROM {_PLACES}"
_GRID = "SELECT c_custkey AS key, c_custkey % 100 AS x, c_custkey // 100 AS y, 2::BIGINT AS radius FROM customer"
_BITS = "SELECT key AS c_custkey, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM bits GROUP BY key"


def record_places(spark, sf) -> DataFrame:
    """Records of several fields through the registry: a place on a grid, a place on the earth with a speed, and the step of a balance."""
    fields = [
        E.Field("grid", "coordinate", "x,y", (("radius", 2), ("w", 21), ("n", 1000))),
        E.Field("place", "geospatial", "lon,lat,speed", (("w", 21), ("n", 1000))),
        E.Field("step", "delta", "step", (("w", 21), ("low", -1000), ("high", 1000), ("n", 421))),
    ]
    bits, width = E.record_bits(fields)
    where = _places(spark, sf).select("c_custkey", "lon", "lat", (F.col("speed") / 10).alias("speed"), (F.col("c_custkey") % 100).alias("x"), F.floor(F.col("c_custkey") / 100).alias("y"))
    balance = table(spark, sf, "customer").select(F.col("c_custkey"), F.col("c_acctbal").alias("now"))
    before = balance.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("now").alias("before"))
    steps = balance.join(before, "c_custkey", "left").select("c_custkey", E.delta(F.col("now"), F.col("before")).alias("step"))
    return where.join(steps, "c_custkey").select("c_custkey", F.lit(width).alias("width"), text(F.array_sort(bits)).alias("bits"))


_STEP = E.ScalarEncoder.of(21, -1000, 1000, n=421)
_RECORD_PLACES = f"""WITH g AS (WITH {_coordinate_sql(_GRID, 21, 1000)} SELECT * FROM bits), p AS (WITH {_coordinate_sql(_GEO, 21, 1000)} SELECT * FROM bits),
s AS (SELECT c.c_custkey AS key, c.c_acctbal - coalesce(b.c_acctbal, c.c_acctbal) AS d FROM customer c LEFT JOIN customer b ON b.c_custkey + 1 = c.c_custkey),
f AS (SELECT key, CAST(trunc((greatest(-1000.0, least(1000.0, d)) + 1000.0 + {_STEP.resolution!r} / 2) / {_STEP.resolution!r}) AS BIGINT) AS b FROM s),
u AS (SELECT key, bit FROM g UNION ALL SELECT key, bit + 1000 FROM p UNION ALL SELECT key, unnest(range(b, b + 21)) + 2000 FROM f)
SELECT key AS c_custkey, 2421 AS width, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM u GROUP BY key"""


def pattern_moments(spark, sf) -> DataFrame:
    """What the principal axes rest on: each coordinate's sum and the sums of its products with the later ones."""
    at = F.posexplode("x").alias("i", "v")
    rows = _patterns(spark, sf).select("id", "x", at)
    products = F.transform("x", lambda y, j: F.when(j >= F.col("i"), F.col("v") * y).otherwise(0.0))
    sums = rows.select("i", "v", F.posexplode(products).alias("j", "p")).where("j >= i").groupBy("i", "j").agg(F.sum("v").cast("bigint").alias("total"), F.sum("p").cast("bigint").alias("product"))
    return sums.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "total", "product")


def pca_project(spark, sf) -> DataFrame:
    """Patterns on the two main axes of all patterns; signs of axes are free, so there is no SQL."""
    rows = _patterns(spark, sf)
    mean, axes = N.principal_axes(rows, "x", dims=2)
    return rows.select("id", fixed(N.project(F.col("x"), mean, axes)[0]).alias("first_e6"), fixed(N.project(F.col("x"), mean, axes)[1]).alias("second_e6"))


_MERGE_SQL = f"""
WITH r AS (SELECT o_custkey AS key, 0 AS t, o_orderkey AS item FROM orders UNION ALL SELECT c_custkey, 1, c_nationkey FROM customer UNION ALL SELECT user_id, 2, event_id FROM events),
n AS (SELECT *, CAST((row_number() OVER (PARTITION BY key ORDER BY t, item) - 1) // {MERGED} AS BIGINT) AS part FROM r WHERE item IS NOT NULL)
SELECT key, part, {", ".join(f"coalesce(string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) FILTER (t = {t}), '') AS {name}" for t, name in enumerate(("orders", "nations", "events")))}
FROM n GROUP BY key, part"""

QUERIES = {
    "knn_l2": (_knn("norm"), _knn_sql("l2")),
    "knn_l1": (_knn("norm", 1), _knn_sql("l1")),
    **{f"knn_overlap_{m}": (_knn(m), _knn_sql(m)) for m in ("raw_overlap", "pct_input", "pct_prototype", "pct_larger")},
    "knn_partition_excluded": (_knn("norm", 2, True), _knn_sql("l2", "AND q.part <> p.part")),
    "knn_vote": (knn_vote, f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, proto_id) AS rank FROM {_found_sql('l2')}), v AS (SELECT query_id, category, count(*) AS c FROM n WHERE rank <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, category) AS k, sum(c) OVER (PARTITION BY query_id) AS s FROM v) SELECT query_id, category AS winner, {fixed_sql('c / s')} AS share_e6 FROM w WHERE k = 1"),
    "knn_category_distance": (knn_category_distance, f"SELECT query_id, category, {fixed_sql('greatest(0, least(1, min(dist)))')} AS dist_e6 FROM {_found_sql('pct_input')} GROUP BY 1, 2"),
    "knn_sparsify": (knn_sparsify, f"WITH e AS (SELECT id, unnest(range({DIMS})) AS k, unnest(x) AS v FROM {_P}), s AS (SELECT id, k, CASE WHEN v * abs(v) > 20 THEN v ELSE 0 END AS v FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, k) AS n FROM s) SELECT id, string_agg(CAST(CASE WHEN n <= 3 AND v <> 0 THEN 1 ELSE 0 END AS VARCHAR), ',' ORDER BY k) AS bits FROM r GROUP BY id"),
    "knn_learn": (knn_learn, f"SELECT min(id) AS id, category FROM (SELECT id, category, list_transform(x, lambda v: floor(v / 40)) AS c FROM {_P}) GROUP BY category, c"),
    "exact_match_classify": (exact_match_classify, "SELECT d.doc_id, f.source AS first_source FROM documents d JOIN (SELECT text, arg_min(source, doc_id) AS source FROM documents GROUP BY text) f USING (text)"),
    "overlap_join": (overlap_join, f"SELECT rec, col, overlap FROM {_OVERLAP}"),
    "topk_inhibition": (topk_inhibition, f"SELECT rec, col, rank FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY overlap DESC, col DESC) AS rank FROM {_OVERLAP}) WHERE rank <= 3 AND overlap >= 1"),
    "segment_activity": (segment_activity, "SELECT l_orderkey AS seg, count(*) AS potential, CAST(sum(CAST(l_discount * 5 > 0.2 - 1e-5 AS INT)) AS BIGINT) AS connected, CAST(sum(CAST(l_discount * 5 > 0.2 - 1e-5 AS INT)) >= 2 AS INT) AS is_active, CAST(count(*) >= 2 AS INT) AS is_matching FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#1' GROUP BY 1"),
    "cogroup_merge": (cogroup_merge, _MERGE_SQL),
    "cells_per_sequence": (cells_per_sequence, "SELECT l_orderkey AS sequence, count(DISTINCT l_partkey) AS n_cells FROM lineitem GROUP BY 1"),
    "sequences_per_cell": (sequences_per_cell, "SELECT l_partkey AS cell, count(DISTINCT l_orderkey) AS n_sequences FROM lineitem GROUP BY 1"),
    "shared_cells": (shared_cells, "WITH p AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS s, l_partkey AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT x.s AS a, y.s AS b, count(*) AS shared FROM p x JOIN p y ON x.c = y.c AND x.s < y.s GROUP BY 1, 2"),
    "tag_join_volume": (tag_join_volume, "SELECT 'source:' || source AS metric, count(*) AS volume FROM documents WHERE source IS NOT NULL GROUP BY 1 UNION ALL SELECT 'lang:' || lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY 1"),
    "positional_zip": (positional_zip, f"SELECT id, array_to_string(list_transform(range(1, {DIMS} + 1), lambda k: CAST(CAST(x[k] AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(x[{DIMS} + 1 - k] AS BIGINT) AS VARCHAR)), ';') AS pairs FROM {_P}"),
    "sparse_set_ops": (sparse_set_ops, f"WITH r AS (SELECT id, list_filter(range({DIMS}), lambda k: x[k + 1] > 0) AS a, list_filter(range({DIMS}), lambda k: x[{DIMS} - k] > 0) AS b FROM {_P}) SELECT id, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS any, array_to_string(list_filter(a, lambda k: NOT list_contains(b, k)), ',') AS left_only, CAST(len(list_filter(b, lambda k: NOT list_contains(a, k))) = 0 AS INT) AS holds FROM r"),
    "cells_to_columns": (cells_to_columns, "SELECT l_orderkey, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS columns, CAST(count(*) * 32 AS INT) AS n_cells FROM (SELECT DISTINCT l_orderkey, CAST(floor(l_partkey / 32) AS INT) AS c FROM lineitem) GROUP BY 1"),
    "topology_neighbourhood": (topology_neighbourhood, "WITH a AS (SELECT p_partkey, p_partkey % 48 // 6 AS r, p_partkey % 6 AS c FROM part), d AS (SELECT unnest([-1, 0, 1]) AS d), n AS (SELECT p_partkey, r + i.d AS y, c + j.d AS x FROM a, d i, d j) SELECT p_partkey, string_agg(CAST(y * 6 + x AS VARCHAR), ',' ORDER BY y * 6 + x) FILTER (y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 5) AS box, string_agg(CAST((y + 8) % 8 * 6 + (x + 6) % 6 AS VARCHAR), ',' ORDER BY (y + 8) % 8 * 6 + (x + 6) % 6) AS wrapped FROM n GROUP BY 1"),
    "array_arithmetic": (array_arithmetic, _ARITHMETIC_SQL),
    "cla_votes": (cla_votes, f"WITH e AS (SELECT user_id AS bit, event_type AS bucket, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS rec FROM events), w AS (SELECT bit, bucket, sum(pow(0.9, CAST(floor((2000000 - rec) / 24) AS BIGINT) % 30)) AS w FROM e GROUP BY 1, 2), s AS (SELECT bit, bucket, w / sum(w) OVER (PARTITION BY bit) AS v FROM w), t AS (SELECT rec, bucket, sum(v) AS v FROM (SELECT DISTINCT rec, bit FROM e) JOIN s USING (bit) GROUP BY 1, 2) SELECT rec, bucket, {fixed_sql('v / sum(v) OVER (PARTITION BY rec)')} AS p_e6 FROM t"),
    "softmax_infer": (softmax_infer, f"SELECT user_id, event_type, {fixed_sql('p')} AS p_e6 FROM {_SOFTMAX}"),
    "remove_unlikely": (remove_unlikely, f"SELECT user_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS rank FROM {_SOFTMAX}) WHERE rank <= 2 AND (p >= 0.2 OR rank = 1)"),
    "best_model": (best_model, "SELECT s_nationkey, arg_min(s_suppkey, (e, s_suppkey)) AS model FROM (SELECT l_suppkey, sum(floor(l_tax * 100)) / count(*) AS e FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"),
    "swarm_best_so_far": (swarm_best_so_far, f"SELECT s_nationkey, s_suppkey, min(err) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS best_e6 FROM (SELECT l_suppkey, {fixed_sql('sum(floor(l_tax * 100)) / count(*)')} AS err FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey"),
    "field_contributions": (field_contributions, f"WITH b AS (SELECT l_returnflag, greatest(sum(floor(l_tax * 100)) / count(*), 1e-5) AS base FROM lineitem GROUP BY 1), r AS (SELECT l_returnflag, year(l_shipdate) AS field, sum(floor(l_tax * 100)) / count(*) AS err FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, field, {fixed_sql('(base - err) * 100 / base')} AS pct_e6 FROM r JOIN b USING (l_returnflag)"),
    "mercator": (mercator, f"SELECT c_custkey, CAST(floor({_MERCATOR[0]} * 10 + 0.5) AS BIGINT) AS x_e1, CAST(floor({_MERCATOR[1]} * 10 + 0.5) AS BIGINT) AS y_e1 FROM {_PLACES}"),
    "inverse_mercator": (inverse_mercator, f"SELECT c_custkey, {fixed_sql('lon')} AS lon_e6, {fixed_sql('lat')} AS lat_e6 FROM {_PLACES}"),
    "radius_for_speed": (radius_for_speed, f"SELECT c_custkey, CAST(greatest(ceil(speed * 60 / 30 * 1.5 / 2), ceil((sqrt(21) - 1) / 2)) AS INT) AS radius FROM {_PLACES}"),
    "coordinate_bits": (coordinate_bits, f"WITH {_coordinate_sql(_GRID, 21, 1000)} {_BITS}"),
    "geo_bits": (geo_bits, f"WITH {_coordinate_sql(_GEO, 21, 1000)} {_BITS}"),
    "record_places": (record_places, _RECORD_PLACES),
    "pattern_moments": (pattern_moments, f"WITH e AS (SELECT id, x, unnest(range({DIMS})) AS i FROM {_P}) SELECT i, j, CAST(sum(x[i + 1]) AS BIGINT) AS total, CAST(sum(x[i + 1] * x[j + 1]) AS BIGINT) AS product FROM e, range({DIMS}) r(j) WHERE j >= i GROUP BY i, j"),
    "pca_project": (pca_project, None),
}
