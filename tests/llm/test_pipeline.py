import glob
import re
import time

import corpus_pipeline as P
from pyspark.sql import functions as F

from sparsight.llm import secrets as S
from sparsight.llm.common import written
from sparsight.shared import SHUFFLES_GO
from tests.llm.test_jaccard import shingles


def linked(a, b):
    return a and b and 100 * len(a & b) >= 80 * len(a | b)


def test_language_stage_keeps_clean_documents(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.identify_languages(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    right = kept.join(docs.select("doc_id", F.col("lang").alias("label")), "doc_id").agg(F.avg((F.col("lang") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.96
    left = P.identify_languages(spark, odd, sf).collect()
    assert {r.doc_id for r in left} == {None, 3, 4, 7, 9, 10, 11} and all(r.text for r in left)


def test_one_document_of_each_group_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("component_id", F.lit("x"))
    kept = P.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    sets = {k: shingles(r.text, 5) for k, r in rows.items()}
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and linked(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(rows[k]) for k in rows if root(k) == k)


def test_near_duplicates_of_odd_rows(spark, odd, sf):
    kept = P.drop_near_duplicates(spark, odd, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted(
        {(r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect() if r.doc_id != 4}
    )


def test_secrets_are_masked_and_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, P.mask_secrets(spark, docs, sf)))
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert not [s for s in S.scan(r.text) if s[1] < 3] and r.n_chars == len(r.text)
        assert (r.text == before[k].text) == (not S.scan(before[k].text))
        hidden = {i for a, _, b in S.scan(before[k].text) for i in range(a, b)}
        assert re.sub(r"\[secret\]", "", r.text) == "".join(c for i, c in enumerate(before[k].text) if i not in hidden)


def test_run_is_the_stages_in_order(spark, sf, empty_dir):
    rows = P.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.01 * sum(fill.values()) / 1024 + 1
    assert P.run(spark, empty_dir).count() == 0


def test_stages_keep_columns_of_any_name(spark, sf, odd):
    names = ["__key", "__found", "row", "key", "found", "masked", "stays", "a.b", "back`tick", "id"]
    docs = odd.select("*", *[F.struct(F.lit(i).alias("x")).alias(n) for i, n in enumerate(names)])
    plain = {name: sorted(map(tuple, stage(spark, odd, sf).collect()), key=str) for name, stage in P.STAGES[:3]}
    for name, stage in P.STAGES[:3]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
        rows = kept.collect()
        assert sorted((tuple(r)[:5] for r in rows), key=str) == plain[name]
        assert all(tuple(r)[5:] == tuple((i,) for i in range(len(names))) for r in rows)
    assert P.pack_sequences(spark, docs, sf).count() == P.pack_sequences(spark, odd, sf).count()


def test_whole_rows_are_shuffled_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.drop_near_duplicates(spark, docs, sf)
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.split("\n") if re.search(r"Exchange hashpartitioning\((\w+\()?key#", line)]
    assert len(exchanges) == 1, exchanges


def test_written_tables_leave_no_shuffle_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get(SHUFFLES_GO)
    folders = glob.glob(f"{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/blockmgr-*")
    files = lambda: {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}
    held = files()
    dealt = written(docs.repartition(7, "doc_id"), "dealt")
    for _ in range(50):  # the removal is told to the executors, and not waited for
        left = files() - held
        if not left:
            break
        time.sleep(0.1)
    assert folders and not left and spark.conf.get(SHUFFLES_GO) == before
    assert dealt.count() == docs.count()
