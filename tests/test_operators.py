import pickle
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparsight.operators import columns as C
from sparsight.operators import learned as H
from sparsight.operators import metrics as M
from sparsight.operators import neighbours as N
from sparsight.operators import ordered as O
from sparsight.operators import stores as S


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, i // rng.choice([9, 10, 10]) // 2, float(rng.randint(0, 50))) for i in range(200)]
    rows = [(k, i, i // 10, v) for k, i, _, v in rows]
    return spark.createDataFrame(rows, "k string, i long, chunk long, v double").repartition(4)


def test_trailing_equals_a_plain_window(stream):
    w = Window.partitionBy("k").orderBy("i")
    for n in (1, 3, 25):
        plain = stream.withColumn("x", F.sum("v").over(w.rowsBetween(-n, 0))).withColumn("y", F.lag("v", n).over(w))
        cut = O.trailing(stream, ["k"], "chunk", ["i"], n, {"x": lambda u, n=n: F.sum("v").over(u.rowsBetween(-n, 0)), "y": lambda u, n=n: F.lag("v", n).over(u)}, ["v"])
        assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, cut.select(plain.columns).collect()), key=repr)


def test_running_equals_a_plain_window(stream):
    w = Window.partitionBy("k").orderBy("i")
    for strict, frame in ((False, w.rowsBetween(Window.unboundedPreceding, 0)), (True, w.rowsBetween(Window.unboundedPreceding, -1))):
        plain = stream.select("*", F.sum("v").over(frame).alias("s"), F.max("v").over(frame).alias("m"), F.count("v").over(frame).alias("n"))
        cut = O.running(stream, ["k"], "chunk", ["i"], {"s": ("sum", "v"), "m": ("max", "v"), "n": ("count", "v")}, strict)
        assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, cut.select(plain.columns).collect()), key=repr)


def test_metrics_skip_nulls_and_know_their_names(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (4.0, None), (0.0, 2.0)], "t double, p double")
    r = M.score_table(df.withColumn("g", F.lit(1)), "t", "p", list(M.METRICS), ["g"]).first()
    assert (r.rmse, r.aae, r.avg_err, r.altMAPE) == (pytest.approx((5 / 3) ** 0.5), 1.0, pytest.approx(2 / 3), 75.0)
    assert df.agg(M.multistep("aae", F.col("t"), {1: F.col("p"), 2: F.col("t")})).first()[0] == 0.5
    edge = spark.createDataFrame([(100.0, 93.0)], "t double, p double")  # 100 * (7 / 100) is above 7
    assert edge.agg(M.metric("altMAPE", F.col("t"), F.col("p"))).first()[0] == 100 * 7.0 / 100.0 == 7.0
    assert M.label("rmse", "multi", "y", window=10, steps=1) == "multi:rmse:steps=1:window=10:field=y"
    with pytest.raises(ValueError):
        M.metric("trivial", F.col("t"), F.col("p"))


def test_distances(spark):
    row = spark.createDataFrame([([1.0, 0.0, 1.0, 1.0], [1.0, 1.0, 0.0, 1.0])], "x array<double>, p array<double>")
    d = lambda m, k=2: row.select(N.distance(m, F.col("x"), F.col("p"), k)).first()[0]
    assert (d("norm"), d("norm", 1), d("raw_overlap")) == (pytest.approx(2**0.5), 2.0, 1.0)
    assert d("pct_input") == d("pct_prototype") == d("pct_larger") == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        d("norm", 3)


def test_prototypes(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 1), (3, [5.0, 5.0], 1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, category int")
    assert {r.id for r in N.learn(df).collect()} == {0, 2, 3}
    assert {r.id for r in N.learn(df, replace_duplicates=True).collect()} == {2, 3}
    assert {r.id for r in N.learn(df, capacity=2).collect()} == {2, 3}
    assert {r.id for r in N.forget(df, df.where("id = 1").select("id")).collect()} == {0, 2, 3}
    q = spark.createDataFrame([(9, [4.0, 4.0])], "id long, x array<double>")
    assert N.closest_of_category(N.distances(q, df), 1).first().proto_id == 3


@pytest.mark.parametrize("whole", [True, False])
def test_cells_give_the_nearest_of_all_distances(spark, monkeypatch, whole):
    monkeypatch.setattr(N, "CELL_QUERIES", 7)
    monkeypatch.setattr(N, "CELL_PROTOTYPES", 23)
    draw = random.Random(3)
    x = lambda: [float(draw.randrange(3)) if whole else draw.random() for _ in range(5)]
    rows = [(i, x(), i % 4 if i % 7 else None, i % 3 if i % 11 else None) for i in range(80)] + [(80, None, 1, 1), (81, [1.0, None, 0.0, 0.0, 0.0], 1, 2), (82, [1.0], 2, 0), (None, x(), 1, 1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, category int, partition int")
    ask = df.where("id % 5 = 0 or id > 79")
    for method, power, apart in [("norm", 2, False), ("norm", 1, True), ("raw_overlap", 2, False), ("pct_input", 2, True), ("pct_prototype", 2, False), ("pct_larger", 2, False)]:
        plain = N.distances(ask, df, method, power, apart).where("query_id <> proto_id")
        found = N.closest(ask, df, 3, method, power, apart, exclude_self=True)
        assert found.count() < plain.count()
        three = lambda d: sorted((r.query_id, r["rank"], r.proto_id, r.category, r.dist) for r in N.nearest(d, 3).collect())
        assert str(three(found)) == str(three(plain))
        each = N.closest(ask, df, 1, method, power, apart, exclude_self=True, by_category=True)
        assert sorted(map(str, N.category_distance(each).collect())) == sorted(map(str, N.category_distance(plain).collect()))


def test_near_pairs_meet_in_cells_and_copies_do_not(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_PATTERNS", 17)
    draw = random.Random(5)
    xs = {i: [draw.uniform(0, 3) for _ in range(4)] for i in range(100)}
    near = {(a, b) for a in xs for b in xs if a < b and sum((s - t) ** 2 for s, t in zip(xs[a], xs[b])) ** 0.5 < 1.0}
    found = N._near_pairs(spark.createDataFrame(list(xs.items()), "id long, x array<double>"), 1.0).collect()
    assert sorted(map(tuple, found)) == sorted(near)
    copies = [(i, [1.0, 2.0]) for i in range(300)] + [(300, [9.0, None]), (301, [9.0, None]), (302, None), (303, [float("nan")] * 2), (304, [float("nan")] * 2)]
    asked = []
    pairs = N._near_pairs
    monkeypatch.setattr(N, "_near_pairs", lambda rows, least: asked.append(rows.count()) or pairs(rows, least))
    kept = N.learn(spark.createDataFrame(copies, "id long, x array<double>").withColumn("category", F.lit(1)), distance_threshold=1.0)
    assert sorted(r.id for r in kept.collect()) == [0, 300, 301, 302, 303, 304] and asked == [1]


def test_projection_separates_clusters_completely(spark):
    from sparsight.sources.records import clusters

    rows = clusters(spark, 5, 30, 6, 0.01)
    mean, axes = N.principal_axes(rows, "x", dims=3)
    assert np.allclose(axes @ axes.T, np.eye(3), atol=1e-9)
    low = rows.select("id", "category", N.project(F.col("x"), mean, axes).alias("x"))
    found = N.distances(low.where("id % 10 = 0"), low).where("query_id <> proto_id")
    winners = {r.query_id: r.winner for r in N.vote(found, 11).collect()}
    assert all(w == q // 30 for q, w in winners.items()) and len(winners) == 15


def test_store_queries(spark):
    data = spark.createDataFrame([(1, i, i, float(i), i / 10 if i % 2 else None) for i in range(10)], "uid long, rowid long, ts long, value double, score double")
    ids = lambda q: sorted(r.rowid for r in q.collect())
    assert ids(S.metric_query(data, 1, limit=3)) == [7, 8, 9] and ids(S.metric_query(data, 1, limit=3, ascending=True)) == [0, 1, 2]
    assert ids(S.metric_query(data, 1, limit=3, least_score=0.8)) == [9] and ids(S.metric_query(data, 1, least_score=0)) == [1, 3, 5, 7, 9]
    assert ids(S.metric_query(data, 1, first_row=2, last_row=4)) == [2, 3, 4] and ids(S.metric_query(data, 1, start=8)) == [8, 9] and ids(S.metric_query(data, 2)) == []


def test_inhibition_sizes():
    assert C.active_winners(100, density=0.1) == 10 and C.active_winners(100, active_per_area=10, radius=100) == 10 and C.active_winners(10, active_per_area=9, radius=9) == 5


def model(seed=42):
    return H.SpatialPooler(H.PoolerParams(inputs=60, columns=80, active=8, seed=seed))


def test_pooler_invariants():
    rng, p = np.random.default_rng(3), model()
    for _ in range(200):
        active = p.compute(np.sort(rng.choice(60, 12, replace=False)), True)
        assert len(active) == 8 and len(set(active.tolist())) == 8 and (np.diff(active) > 0).all()
        assert p.perm.min() >= 0 and p.perm.max() <= 1 and not p.perm[~p.potential].any() and 1 <= p.boost.min() <= p.boost.max() <= 10
    q, r = model(), model()
    bits = np.arange(12)
    assert [q.compute(bits, True).tolist() for _ in range(5)] == [r.compute(bits, True).tolist() for _ in range(5)]
    before = q.perm.copy()
    q.compute(bits, False)
    assert (q.perm == before).all() and set(q.strip_unlearned(np.arange(80))) <= set(np.flatnonzero(q.active_duty > 0))


def test_local_inhibition_keeps_the_density():
    p = H.SpatialPooler(H.PoolerParams(inputs=60, columns=80, active=8, local_radius=5))
    won = p.inhibit(np.random.default_rng(1).random(80) * 10 + 1)
    assert 0 < len(won) <= 16


def test_memory_learns_a_sequence_and_forgets_nothing_by_looking():
    rng = np.random.default_rng(5)
    memory = H.TemporalMemory(H.MemoryParams(columns=100, cells=6, activation=5, matching=3, max_new=10))
    sequence = [np.sort(rng.choice(100, 8, replace=False)) for _ in range(6)]
    misses = []
    for _ in range(25):
        memory.reset()
        predicted, miss = np.zeros(0, int), []
        for columns in sequence:
            miss.append(1 - len(np.intersect1d(predicted, columns)) / len(columns))
            memory.compute(columns, True)
            predicted = memory.predictive_columns()
        misses.append(np.mean(miss[1:]))
    assert misses[0] == 1 and misses[-1] == 0
    segments = {s: dict(x) for s, x in memory.segments.items()}
    memory.reset()
    for columns in sequence:
        memory.compute(columns, False)
    assert segments == memory.segments
    assert all(0 < v <= 1 for x in memory.segments.values() for v in x.values()) and all(len(x) <= 40 for x in memory.segments.values())
    memory.reset()
    memory.compute(sequence[0], False)
    assert set(memory.active.tolist()) == {c * 6 + k for c in sequence[0] for k in range(6)}  # the unpredicted burst


def test_classifiers_learn_what_follows():
    for make in (lambda: H.SoftmaxClassifier((1, 2), 0.5), lambda: H.VotingClassifier((1, 2), 0.1)):
        c = make()
        for i in range(120):
            p = c.compute([i % 3 * 4 + k for k in range(4)], i % 3, float(i % 3 * 10))
        assert p[1].argmax() == (119 + 1) % 3 and p[2].argmax() == (119 + 2) % 3 and abs(p[1].sum() - 1) < 1e-9
        assert c.actual[2] == 20.0


def test_online_likelihood():
    rng = np.random.default_rng(2)
    one = H.OnlineLikelihood(learning=50, estimation=50)
    out = [one.compute(float(rng.random()), float(rng.random() < 0.1)) for _ in range(600)]
    assert set(out[:100]) == {0.5} and 0 <= min(out) and max(out) <= 1
    late = [one.compute(0.5, 1.0) for _ in range(12)]
    assert max(late) > 0.999 and late.count(1 - 1e-3) >= 1
    assert H.tail_probability(-1, 0, 1) == pytest.approx(1 - H.tail_probability(1, 0, 1))
    flat = H.OnlineLikelihood(learning=20, estimation=20)
    assert {round(flat.compute(1.0, 0.0), 2) for _ in range(100)} == {0.5}


def test_likelihood_service():
    rng = np.random.default_rng(3)
    service = H.LikelihoodService()
    rows = [(float(rng.random()), float(rng.random() < 0.05)) for _ in range(900)]
    out = service.update(rows[:500]) + service.update(rows[500:])
    assert set(out[:199]) == {0.5} and 0 <= min(out) and max(out) <= 1 and len(out) == 900
    assert max(service.update([(0.5, 1.0)] * 12)) > 0.99


def test_pooler_tells_patterns_apart():
    rng = np.random.default_rng(4)
    patterns = [np.sort(rng.choice(60, 20, replace=False)) for _ in range(8)]
    accuracy, cycles = H.train_pooler_for_patterns(patterns, list(range(8)), model())
    assert accuracy == 1.0 and cycles <= 5


def test_pooler_on_a_grid():
    p = H.SpatialPooler(H.PoolerParams(inputs=144, columns=36, active=6, shape=(6, 6), input_shape=(12, 12), potential_radius=2, potential_pct=1.0, wrap=False, local_radius=1, adapt_radius=True, update_period=5))
    assert p.centre(0) == 1 * 12 + 1 and p.centre(35) == 11 * 12 + 11
    for c in (0, 14, 35):
        row, col = divmod(p.centre(c), 12)
        box = {r * 12 + k for r in range(max(0, row - 2), min(12, row + 3)) for k in range(max(0, col - 2), min(12, col + 3))}
        assert set(np.flatnonzero(p.potential[c])) == box
    spans = []
    for c in range(36):
        at = np.flatnonzero(p.perm[c] >= 0.1)
        spans.append(((at // 12).max() - (at // 12).min() + (at % 12).max() - (at % 12).min() + 2) / 2)
    assert p.radius == int(max(1, (np.mean(spans) * 0.5 - 1) / 2) + 0.5)
    rng = np.random.default_rng(1)
    for _ in range(20):
        active = p.compute(np.sort(rng.choice(144, 30, replace=False)), True)
        assert len(active) > 0
    duty = p.active_duty.reshape(6, 6)
    assert np.isclose(p.min_active[0], 0.001 * duty[: p.radius + 1, : p.radius + 1].max())
    assert H.grid_box((4, 5), 0, 1, True).tolist() == [0, 1, 4, 5, 6, 9, 15, 16, 19] and H.grid_box((4, 5), 0, 1, False).tolist() == [0, 1, 5, 6]
    with pytest.raises(ValueError):
        H.SpatialPooler(H.PoolerParams(inputs=144, columns=36, shape=(6, 5), input_shape=(12, 12)))


def test_observed_memory_learns_like_the_plain_one():
    seen = []
    plain, watched = H.TemporalMemory(H.MemoryParams(columns=20)), H.ObservedMemory(H.TemporalMemory(H.MemoryParams(columns=20)), lambda m, c: seen.append((c.tolist(), len(m.active))))
    for i in range(30):
        columns = np.array([i % 5, 5 + i % 5, 10 + i % 5, 15 + i % 5])
        plain.compute(columns, True)
        watched.compute(columns, True)
    assert len(seen) == 30 and watched.winners.tolist() == plain.winners.tolist() and watched.segments == plain.segments


def test_memory_learns_the_same_with_and_without_its_table(monkeypatch):
    def learned(entries):
        monkeypatch.setattr(H, "TABLE_ENTRIES", entries)
        rng, memory, out = np.random.default_rng(8), H.TemporalMemory(H.MemoryParams(columns=24, cells=4, activation=2, matching=1, max_new=6, max_segments=3, max_synapses=5, punish=0.01)), []
        assert (memory.met is None) == (entries == 0)
        for i in range(400):
            if i % 50 == 49:
                memory = pickle.loads(pickle.dumps(memory))
            memory.compute(np.sort(rng.choice(24, 4, replace=False)), i % 7 > 0)
            out.append((memory.active.tolist(), memory.winners.tolist(), memory.active_segments.tolist(), memory.matching_segments.tolist()))
        return out, memory.segments

    assert learned(48_000_000) == learned(0)


def test_pooler_looks_up_inputs_and_forgets_them_in_pickles():
    rng, p = np.random.default_rng(3), model()
    inputs = [np.sort(rng.choice(60, 12, replace=False)) for _ in range(5)]
    for i in range(60):
        p.compute(inputs[i % 5], True)
        assert (p.joined == (p.perm >= p.p.connected)).all()
    q = pickle.loads(pickle.dumps(p))
    assert len(p.seen) == 5 and not q.seen
    assert [p.compute(x, True).tolist() for x in inputs] == [q.compute(x, True).tolist() for x in inputs] and (p.duty == q.duty).all()


def test_softmax_learns_from_runs_as_from_scattered_bits():
    order = np.array([3, 0, 4, 1, 2, 5, 7, 6])
    a, b = H.SoftmaxClassifier((1,), 0.5), H.SoftmaxClassifier((1,), 0.5)
    for i in range(30):
        run = np.arange(i % 4, i % 4 + 4)
        p, q = a.compute(run, i % 3, 1.0), b.compute(order[run], i % 3, 1.0)
        assert np.allclose(p[1], q[1])
    twice, once = H.SoftmaxClassifier((1,), 0.5), H.SoftmaxClassifier((1,), 0.5)
    for c, bits in ((twice, [1, 1]), (once, [1])):
        c.compute(bits, 0)
        c.compute(bits, 1)
    assert np.allclose(twice.weights[1][1], 2 * once.weights[1][1])


def test_changed_inference_kinds():
    with pytest.raises(ValueError):
        M.is_temporal("Anything")


@pytest.mark.parametrize("limits", [(65_536, 4096), (7, 2), (1000, 3)])
def test_packed_postings_give_the_winners_of_the_plain_join(spark, monkeypatch, limits):
    monkeypatch.setattr(C, "GROUP_COLUMNS", limits[0])
    monkeypatch.setattr(C, "POSTING_COLUMNS", limits[1])
    rng = random.Random(5)
    bits = spark.createDataFrame([(rng.choice([1, 1, 2, 3, 4, 5, None]), rng.choice([0, 0, 0, *range(20), None])) for _ in range(200)], "rec int, bit int").distinct()
    connected = spark.createDataFrame([(rng.choice([*range(30), None]), rng.choice([0, 0, *range(20), None])) for _ in range(300)], "col long, bit int").distinct()
    for winners, stimulus in ((3, 1), (1, 4), (50, 0)):
        want = C.inhibit(C.overlap_join(bits.where("rec is not null"), connected.where("col is not null")), winners, max(1, stimulus))
        got = C.top_columns(bits, connected, winners, stimulus)
        assert sorted(map(tuple, got.select("rec", "col", "overlap", "rank").collect())) == sorted(map(tuple, want.select("rec", "col", "overlap", "rank").collect()))
    assert C.top_columns(bits.limit(0), connected, 3).count() == 0 == C.top_columns(bits, connected.limit(0), 3).count()


def test_overlaps_are_counted_from_packed_columns(spark):
    draw = random.Random(9)
    bits = spark.createDataFrame([(draw.randrange(9), draw.randrange(12)) for _ in range(60)], "rec long, bit long")
    connected = spark.createDataFrame([(draw.randrange(20), draw.randrange(12)) for _ in range(80)], "col int, bit long")
    found = C.overlap_join(bits, connected, 2)
    plain = bits.join(connected, "bit").groupBy("rec", "col").count()
    want = sorted((r.rec, r.col, r["count"] if r["count"] >= 2 else 0) for r in plain.collect())
    assert sorted(map(tuple, found.select("rec", "col", "overlap").collect())) == want and found.schema["col"].dataType.simpleString() == "int"
    assert "HashAggregate(keys=[rec" not in found._jdf.queryExecution().executedPlan().toString()
    nulls = bits.union(spark.createDataFrame([(None, 3)], "rec long, bit long"))
    assert C.overlap_join(nulls, connected).where("rec is null").count() == connected.where("bit = 3").select("col").distinct().count()


def test_arrays_are_cut_by_the_columns_of_their_bit(spark, monkeypatch):
    monkeypatch.setattr(C, "POSTING_COLUMNS", 20)
    connected = spark.range(400).select("id", F.floor(F.col("id") / 4).alias("bit")).union(spark.range(100).select(F.col("id") * 4, F.lit(500))).toDF("col", "bit")
    postings, groups = C._postings(connected)
    rows = {r.bit: r["count"] for r in postings.groupBy("bit").count().collect()}
    assert groups == 1 and {n for bit, n in rows.items() if bit != 500} == {1} and 1 < rows[500] <= 5


def test_a_record_that_spans_batches_is_counted_once(spark):
    bits = spark.range(0, 30_000, numPartitions=3).select(F.lit(9).alias("rec"), F.col("id").alias("bit")).union(spark.range(5).select(F.lit(10), F.col("id")))
    connected = spark.range(0, 30_000).select((F.col("id") % 7).alias("col"), F.col("id").alias("bit")).union(spark.range(20_000).select(F.lit(100).cast("long"), F.col("id")))
    found = sorted(map(tuple, C.top_columns(bits, connected, 2).select("rec", "rank", "col", "overlap").collect()))
    assert found == [(9, 1, 100, 20_000), (9, 2, 4, 4286), (10, 1, 100, 5), (10, 2, 4, 1)]


def test_cells_of_sequences(spark):
    rows = [("a", 1), ("a", 1), ("a", 64), ("a", -1), ("b", 1), ("b", 64), ("b", 200), ("c", 200), ("d", None), (None, 1)]
    df = spark.createDataFrame(rows, "sequence string, cell long")
    assert sorted(map(tuple, C.shared_cells(df).collect())) == [("a", "b", 2), ("b", "c", 1)]
    assert {r.sequence: r.n_cells for r in C.cells_of_sequences(df).collect()} == {"a": 3, "b": 3, "c": 1, None: 1}
    assert {r.cell: r.n_sequences for r in C.sequences_of_cells(df).collect()} == {1: 2, 64: 2, -1: 1, 200: 2}


def test_blocked_sums_round_as_the_sql_engine(spark):
    """Bit by bit, over keys of different lengths; sums from left to right differ from them."""
    draw = random.Random(11)
    rows = [(k, i // 40, i, draw.choice([None, *[draw.uniform(0, 500) for _ in range(9)]])) for k, n in ((0, 15), (1, 20), (2, 400)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, chunk long, i long, x double").withColumn("at", F.col("i") + 1)
    sums = {"blocked": lambda w: O.blocked_sum(w, F.col("x"), 20, F.col("at")), "plain": lambda w: F.sum("x").over(w.rowsBetween(-19, 0))}
    found = {(r.k, r.i): r for r in O.trailing(df, ["k"], "chunk", ["i"], 19, sums, ["x"]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, i BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, i, x) for k, _, i, x in rows])
    want = {}
    for k in range(3):  # one key at a time: the engine may lay keys side by side
        want |= {(k, i): s for i, s in con.execute(f"SELECT i, sum(x) OVER (ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) FROM t WHERE k = {k}").fetchall()}
    assert {key: r.blocked for key, r in found.items()} == want
    assert any(r.plain != want[key] for key, r in found.items())


def test_lists_of_columns_travel_packed(spark):
    draw = random.Random(12)
    ends = [0, 1, 127, 128, -1, -(2**63), 2**63 - 1]
    lists = [[], ends, [5], [], [7, 7, 7], *[[draw.randrange(-(10**draw.randrange(1, 19)), 10**9) for _ in range(draw.randrange(40))] for _ in range(50)], []]
    counts = np.array([len(x) for x in lists])
    packed, at = C.pack_lists(np.array([v for x in lists for v in x], np.int64), counts)
    values, found = C.unpack_lists(packed, at)
    assert found.tolist() == counts.tolist() and values.tolist() == [v for x in lists for v in sorted(x)]
    assert [len(x) for x in C.unpack_lists(*C.pack_lists(np.zeros(0, np.int64), np.zeros(0, np.int64)))] == [0, 0]
    connected = spark.range(6000).select((F.col("id") * 30 % 1009).alias("col"), (F.col("id") % 200).alias("bit"))
    size, n = C._postings(connected)[0].agg(F.sum(F.length("cols")), F.count("bit")).first()
    assert n == 200 and size < 2 * 6000 + 200  # four bytes a column before
