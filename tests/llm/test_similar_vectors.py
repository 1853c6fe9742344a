"""Neighbours against brute force, copies, ties and unusable vectors."""

import datetime as dt

import numpy as np
import pytest

from shirabe.llm.similar_vectors import Model, learn_routing, nearest_in_leaf, neighbours, route, similar_vectors, unit

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
SCHEMA = "chunk_id string, embedding array<float>, embedded_at timestamp, id long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], t, 0, "clash") for i, v, t in rows], SCHEMA)


def search(df, **kw):
    return similar_vectors(df, "chunk_id", "embedding", "embedded_at", **kw)


def brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([np.asarray(vectors[i], np.float32).astype(float) for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(x @ x.T, 6)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((-c[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out[i] = [n for _, n in order]
    return out


def test_recall_over_many_leaves(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 64))
    vectors = {f"c{i:05d}": centres[i % 60] + rng.normal(size=64) * 0.25 for i in range(3000)}
    got = {}
    for r in search(frame(spark, [(i, v, T0) for i, v in vectors.items()]), leaf_rows=400).collect():
        got.setdefault(r["id"], set()).add(r["neighbour_id"])
    want = brute(vectors, 10)
    recall = np.mean([len(got.get(i, set()) & set(w)) / 10 for i, w in want.items()])
    assert recall >= 0.9
    assert all(len(g) == 10 for g in got.values()) and len(got) == 3000


def test_exact_on_one_leaf_with_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 64))
    vectors = {f"v{i:02d}": base[i % 12] if i < 24 else base[i] for i in range(30)}
    got = {}
    for r in search(frame(spark, [(i, v, T0) for i, v in vectors.items()])).collect():
        got.setdefault(r["id"], {})[r["neighbour_id"]] = r["similarity"]
    want = brute(vectors, 10)
    assert {i: set(g) for i, g in got.items()} == {i: set(w) for i, w in want.items()}
    assert got["v00"]["v12"] == 1.0


def test_hot_vector_is_collapsed_and_whole(spark):
    hot = np.ones(64)
    rows = [(f"h{i:04d}", hot, T0) for i in range(700)] + [("z", np.arange(64) + 1.0, T0)]
    got = {}
    for r in search(frame(spark, rows)).collect():
        got.setdefault(r["id"], set()).add(r["neighbour_id"])
    first = [f"h{i:04d}" for i in range(11)]
    for i in range(700):
        own = f"h{i:04d}"
        assert got[own] == set([f for f in first if f != own][:10])
    assert got["z"] == set(first[:10])


def test_unusable_and_latest(spark):
    a, b, c = np.eye(64)[0], np.eye(64)[0] + 0.1, np.eye(64)[1]
    rows = [
        ("a", a, T0), ("b", c, T0), ("b", b, T1), ("c", c, T1), ("c", None, T0), ("gone", a, T0), ("gone", None, T1), ("short", a[:63], T0), ("zero", a * 0, T0),
        ("nan", np.r_[np.nan, a[1:]], T0), ("inf", np.r_[np.inf, a[1:]], T0), (None, a, T0), ("a", a, T0), ("old", c, None),
    ]
    got = {}
    for r in search(frame(spark, rows)).collect():
        got.setdefault(r["id"], set()).add(r["neighbour_id"])
    assert got == {i: {"a", "b", "c", "old"} - {i} for i in ("a", "b", "c", "old")}


@pytest.mark.parametrize("rows", [[], [("a", np.ones(64), T0)], [("a", None, T0)]])
def test_nothing_to_pair(spark, rows):
    assert search(frame(spark, rows)).count() == 0


def test_a_third_of_all_rows_in_one_direction(spark):
    """Copies of every length: collapsed before routing, each with its own neighbours, and no leaf holds them all."""
    rng = np.random.default_rng(3)
    way, centres = rng.normal(size=64), rng.normal(size=(40, 64))
    vectors = {f"c{i:05d}": centres[i % 40] + rng.normal(size=64) * 0.3 for i in range(1400)} | {f"h{i:05d}": way * (0.5 + i % 9) for i in range(700)}
    got = {}
    for r in search(frame(spark, [(i, v, T0) for i, v in vectors.items()]), leaf_rows=200).collect():
        got.setdefault(r["id"], {})[r["neighbour_id"]] = r["similarity"]
    assert set(got) == set(vectors)
    assert {len(g) for g in got.values()} == {10}
    assert all(s == 1.0 and n[0] == "h" for i in range(700) for n, s in got[f"h{i:05d}"].items())
    want = brute(vectors, 10)
    assert np.mean([len(set(got[i]) & set(w)) / 10 for i, w in want.items() if i[0] == "c"]) >= 0.9


def test_copies_are_bounded_whatever_the_depth():
    x = unit(np.random.default_rng(4).normal(size=(20_000, 64)))
    model = Model(x.mean(0), np.eye(64), *learn_routing(x, 50, 0.1))
    row, leaf, home = route(x, model, 4)
    assert model.leaves > 200 and len(row) <= 4 * len(x) and home.sum() == len(x) == len(set(row[home].tolist()))
    assert len(set(zip(row.tolist(), leaf.tolist()))) == len(row)


def test_a_leaf_larger_than_planned_is_divided():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(30, 64))[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 64)) * 0.2).astype(np.float32)
    model = Model(np.zeros(64), np.eye(64), *learn_routing(unit(x), 10_000, 0.1))
    parts = list(neighbours(x, np.ones(3000, bool), model, 5, 16, 200, 0.1, 4))
    assert len(parts) > 3
    q, r = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    assert np.array_equal(np.bincount(q), np.full(3000, 5))
    cos = unit(x) @ unit(x).T
    np.fill_diagonal(cos, -1)
    best = np.argsort(-cos, axis=1)[:, :5]
    assert np.mean([len(set(best[i]) & set(r[q == i].tolist())) / 5 for i in range(0, 3000, 7)]) >= 0.9


def test_few_candidates_widen_the_substrings():
    """Rows far from each other, where no two codes share a substring, still get all their neighbours, the nearest among them."""
    x = np.random.default_rng(6).normal(size=(60, 64)).astype(np.float32)
    model = Model(np.zeros(64), np.eye(64), *learn_routing(unit(x), 100, 0.1))
    q, r, cos = nearest_in_leaf(x, np.ones(60, bool), model, 10, 16)
    assert np.array_equal(np.bincount(q), np.full(60, 10))
    full = np.round(unit(x) @ unit(x).T, 6)
    np.fill_diagonal(full, -2)
    assert np.mean([len(set(np.argsort(-full[i])[:10]) & set(r[q == i].tolist())) / 10 for i in range(60)]) >= 0.9


def test_routing_keeps_neighbours_together_in_large_tables():
    """Groups that the bounded sample hardly shows, many leaves, leaves that hold several parts: few neighbours are parted, with few copies."""
    rng = np.random.default_rng(8)
    centres = unit(rng.normal(size=(1500, 64)))
    group = np.repeat(np.arange(1500), 40)
    x = unit(centres[group] + rng.normal(size=(60_000, 64)) * 0.035)
    model = Model(np.zeros(64), np.eye(64), *learn_routing(x[rng.choice(60_000, 6_000, replace=False)], 60, 0.1))
    row, leaf, home = route(x, model, 4)
    own = np.empty(60_000, np.int64)
    own[row[home]] = leaf[home]
    there = set(zip(row.tolist(), leaf.tolist()))
    a = rng.integers(0, 60_000, 4000)
    b = a // 40 * 40 + rng.integers(0, 40, 4000)
    assert model.leaves >= 100
    assert np.mean([(j, own[i]) in there for i, j in zip(a.tolist(), b.tolist())]) >= 0.97
    assert len(row) <= 2.5 * len(x)
