"""Containers hold everything, within capacity, nearly full; pieces give the text back."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shirabe.llm.pack_containers import STEP, class_bounds, fill, pack_containers, patterns, token_rows


def packed(spark, sizes, capacity=4096):
    df = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(sizes)], "doc_id long, piece long, n_tokens long, _row string")
    return pack_containers(df, capacity).collect()


@pytest.mark.parametrize("seed,n,top", [(1, 3000, 4096), (2, 2000, 900), (3, 500, 60), (4, 1, 4096)])
def test_valid_and_tight(spark, seed, n, top):
    rnd = random.Random(seed)
    sizes = [rnd.randint(1, top) for _ in range(n)]
    rows = packed(spark, sizes)
    assert {r["_row"] for r in rows} == {"x"}
    load = Counter()
    for r in rows:
        load[r["container"]] += r["n_tokens"]
    assert len(rows) == n and max(load.values()) <= 4096
    assert set(load) == set(range(len(load)))
    assert len(load) <= -(-sum(sizes) // 4096) * 1.03 + 1


def test_hot_size_ties_and_odd_sizes(spark):
    rows = packed(spark, [1365] * 600 + [2731] * 100 + [None, 0, 5000])
    load = Counter()
    for r in rows:
        if r["n_tokens"] not in (None, 0, 5000):
            load[r["container"]] += r["n_tokens"]
        else:
            assert r["container"] is None
    assert max(load.values()) <= 4096 and len(load) == 100 + -(-500 // 3)


def test_patterns_hold_every_item_in_fixed_counts():
    rnd = random.Random(5)
    bounds = class_bounds()
    h = Counter(int(bounds[bounds >= rnd.randint(1, 4096)][0]) for _ in range(5000))
    total = Counter()
    for times, filling in patterns(h):
        assert sum(c * n for c, n in filling) <= 4096
        lead, n = filling[0]
        assert n == min(4096 // lead, h[lead] - total[lead])  # the reciprocal count
        for c, n in filling:
            total[c] += times * n
    assert total == h


@pytest.mark.parametrize("capacity", [1, 2, 7, 100, 4096])
def test_classes_are_reciprocal(capacity):
    bounds = class_bounds(capacity)
    assert {capacity // j for j in range(1, capacity + 1)} <= set(bounds.tolist())
    for size in range(1, capacity + 1):
        bound = int(bounds[bounds >= size][0])
        assert capacity // bound == capacity // size and bound - size < STEP


@pytest.mark.parametrize("sizes", [[], [4096], [1] * 10_000, [2049] * 50 + [2047] * 50, [1366] * 90, [3000, 1096, 1097]])
def test_fill(sizes):
    at = fill(np.array(sizes, np.int64))
    load = np.bincount(at, weights=sizes) if sizes else np.empty(0)
    assert (load <= 4096).all() and (load > 0).all()


def test_equal_containers_on_any_cluster_and_a_third_of_copies(spark):
    rnd = random.Random(8)
    rows = [(i, 0, rnd.randint(1, 4096)) for i in range(2000)] + [(7777, 0, 1300)] * 1000
    df = spark.createDataFrame(rows, "doc_id long, piece long, n_tokens long")
    results = []
    for partitions in ("4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append(sorted(tuple(r) for r in pack_containers(df.repartition(int(partitions)), segment=300).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and len(results[0]) == 3000
    load, copies = Counter(), Counter()
    for d, _, n, c in results[0]:
        load[c] += n
        copies[c % 10] += d == 7777
    assert max(load.values()) <= 4096 and set(copies.values()) == {100}  # every segment has its share of the copies
    assert sum(load.values()) / 4096 / len(load) > 0.95


def test_tokens_and_pieces(spark):
    texts = ["", "a", None, "あ" * 5000, "x" * 4095, "x" * 4096, "𠮷" * 3000, "aé𠮷あ" * 2500]
    df = spark.createDataFrame([(i, t, 9, 9) for i, t in enumerate(texts)], "id long, body string, piece int, n_tokens int")
    rows = token_rows(df, "id", "body").collect()
    for i, t in enumerate(texts):
        own = sorted((r["piece"], r["start_byte"], r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        if t is None:
            assert own == []
            continue
        raw = t.encode()
        assert [p[0] for p in own] == list(range(len(own)))
        assert b"".join(raw[s : s + n] for _, s, n, _ in own) == raw
        for _, s, n, tokens in own:
            raw[s : s + n].decode()
            assert tokens == n + 1 <= 4096
        assert len(own) == (1 if len(raw) <= 4095 else -(-len(raw) // 4092))


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id long, body string")
    rows = pack_containers(token_rows(df, "id", "body")).collect()
    assert len(rows) == 3 and {r["container"] for r in rows} == {0}
    assert pack_containers(token_rows(df.filter(F.lit(False)), "id", "body")).count() == 0
