import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import types as T

from sparsight.llm import trie as P

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows):
    """Nodes as a dictionary of sequences; no two turns of a conversation may tie unless they are equal."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, source = crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(source, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode().split()) if k else 0) + sum(saved[x] for x in below)
    return sorted(((
        min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k],
        hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest(),
    ) for k, m in members.items()), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(rng, conversations, most, texts, roles=("user", "assistant", None)):
    rows = []
    for c in conversations:
        for turn in range(rng.randint(1, most)):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, roles[turn % len(roles)], rng.choice(texts)))
    rng.shuffle(rows)
    return rows


def test_louds_of_a_small_forest():
    #    0     1        labels order siblings: 1 before 0
    #   2 3    4
    #          5
    parent, label = np.array([-1, -1, 0, 0, 1, 4]), np.array([5, 1, 7, 6, 0, 0])
    trie = P.Louds.of(parent, label)
    assert trie.order.tolist() == [1, 0, 4, 3, 2, 5]
    assert "".join("01"[int(b)] for b in trie.bits) == "110" + "10" + "110" + "10" + "0" + "0" + "0"
    assert trie.parents().tolist() == [-1, -1, 0, 1, 1, 2] and trie.degrees().tolist() == [1, 2, 1, 0, 0, 0]
    assert trie.rolled_up(np.ones(6, np.int64)).tolist() == [3, 3, 2, 1, 1, 1]
    empty = P.Louds.of(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert empty.rolled_up(np.zeros(0, np.int64)).tolist() == [] == empty.parents().tolist()


@pytest.mark.parametrize("heavy", [1, 3, 25, 100_000])
@pytest.mark.parametrize("chunk", [2, 4096])
def test_shared_beginnings_against_brute_force(spark, monkeypatch, heavy, chunk):
    monkeypatch.setattr(P, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "IDS_TOGETHER", 3)
    rng = random.Random(heavy + chunk)
    rows = made(rng, [*range(-30, 70), 1000, 1001, 10**15], 7, ["yes", "no", "", None, "two words\there", " one é "])
    rows += [(2000 + i, t, "user", f"again {t}") for i in range(40) for t in range(6)]  # copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(P.prefix_trie(df)) == brute(rows)


def test_a_long_conversation_spans_tasks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 50)
    monkeypatch.setattr(P, "HEAVY_ROWS", 400)
    rows = [(20, t, "user", f"turn {t % 7}") for t in range(1500)] + [(21, t, "user", f"turn {t % 7}") for t in range(700)] + [(5, 0, "user", "turn 0"), (41, 3, "a", "alone")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(P.prefix_trie(df)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "x y"), (1, 0, "user", "x y"), (1, None, None, None), (None, 1, "user", "lost"), (0, 2, "user", "only"), (3, None, "a", "w " * 30_000), (3, None, "a", "w " * 30_000), (-1, 0, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(P.prefix_trie(df)) == brute(rows)
    clashing = df.selectExpr("*", "1 as conv", "2 as a", "3 as depth", "4 as `a.b`", "5 as shard")
    assert got(P.prefix_trie(clashing)) == brute(rows)
    assert P.prefix_trie(df.limit(0)).count() == 0 == P.prefix_trie(df.where("conv_id is null")).count()


def test_conversations_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(P.op11_louds_prefix_trie(spark, sf)) == brute(rows)
