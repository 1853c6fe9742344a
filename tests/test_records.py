"""API records, sidecars that are written and read, settings, and approximate neighbours against exact ones."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shirabe.operators.ann import Parameters, ann_topk
from shirabe.operators.exact_knn import knn_topk
from shirabe.settings import Settings
from shirabe.sources import records as R
from shirabe.sources.files import sidecar_fields, sidecar_text


def test_list_pages(spark):
    item = lambda slug, user="me": {"slug": slug, "user": {"username": user}}
    pages = [(1, {"articles": [item("a"), item("x", "other"), item("b")], "next_page": 2}), (2, {"articles": [item("c"), item(None)], "next_page": None}), (3, {"articles": [item("late")], "next_page": None})]
    df = spark.createDataFrame([(n, json.dumps(p)) for n, p in pages] + [(4, "{broken"), (None, None)], "n int, body string")
    got = lambda **k: [tuple(r) for r in R.listed_slugs(df, "n", "body", "articles", "me", **k).orderBy("position").collect()]
    assert got() == [(1, "a"), (2, "b"), (3, "c")] and got(most=2) == [(1, "a"), (2, "b")]
    assert R.listed_slugs(df.limit(0), "n", "body", "scraps", "me").count() == 0
    with pytest.raises(ValueError):
        R.listed_slugs(df, "n", "body", "books", "me")


def test_articles_and_scraps(spark):
    a = {"article": {"slug": "s", "title": "T", "topics": [{"display_name": "D", "name": "d"}, {"display_name": "", "name": "n"}, {}], "liked_count": 3, "body_html": "<p>x</p>"}}
    s = {"scrap": {"slug": "t", "comments": [{"body_html": "<p>1</p>"}, None, {"body_html": None}, {"body_html": "<p>2</p>"}]}}
    df = spark.createDataFrame([(json.dumps(a),), (json.dumps(s),), ("junk",), (None,)], "p string")
    (row,) = R.blog_articles(df, "p").collect()
    assert (row["slug"], row["topics"], row["liked_count"]) == ("s", ["D", "n"], 3)
    (row,) = R.blog_scraps(df, "p").collect()
    assert (row["slug"], row["n_comments"], row["bodies"], row["topics"]) == ("t", 2, ["<p>1</p>", "<p>2</p>"], None)
    known = spark.createDataFrame([("s",), ("s",)], "slug string")
    assert R.not_yet_there(R.blog_articles(df, "p"), known, "slug").count() == 0 and R.not_yet_there(R.blog_articles(df, "p"), known, "slug", True).count() == 1


def test_posts_and_transcripts(spark):
    posts = spark.createDataFrame([(1, True), (2, False), (3, None), (4, False)], "n int, repost boolean")
    ns = lambda **k: [r["n"] for r in R.feed_posts_upto(posts, ["n"], F.col("repost"), 3, **k).orderBy("n").collect()]
    assert ns() == [2, 3] and ns(with_reposts=True) == [1, 2, 3]
    t = spark.createDataFrame([("v", "en", False, "a"), ("v", "ja", True, "b"), ("w", "fr", True, "c"), ("w", "en", True, "d"), ("x", "de", False, "e"), ("x", "ja", None, "f")], "id string, lang string, auto boolean, text string")
    assert {r["id"]: r["text"] for r in R.chosen_transcript(t, "id", "lang", "auto").collect()} == {"v": "a", "w": "d", "x": "e"}


def test_sidecars_read_back():
    fields = {"title": "A: b", "at": dt.date(2024, 1, 2), "tags": ["x", "y z"], "none": None, "empty": "", "lead": "- no", "hash": "#1"}
    assert sidecar_fields(sidecar_text(fields)) == {"title": "A: b", "at": "2024-01-02", "tags": "x,y z", "empty": "", "lead": "- no", "hash": "#1"}
    assert sidecar_text({}) == ""
    for bad in ({"a b": 1}, {"a": "x\ny"}):
        with pytest.raises(ValueError):
            sidecar_text(bad)


def test_settings():
    assert Settings.of({"k1": 1.2}, "k1 = 2.0\nresults = 5").k1 == 2.0
    for bad in ({"b": 1.5}, {"chunk_overlap": 200}, {"items_most": 101}, {"unknown": 1}):
        with pytest.raises(ValueError):
            Settings.of(bad)


def test_neighbours_of_outside_queries(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    vec = lambda i: (centres[i % 40] + rng.normal(size=64) * 0.4).tolist()
    rows = spark.createDataFrame([(i, vec(i), "clash") for i in range(2000)] + [(9001, None, ""), (9002, [0.0] * 64, ""), (9003, [1.0] * 63, "")], "id long, v array<float>, code string")
    asked = spark.createDataFrame([(i, vec(i)) for i in range(60)] + [(99, None)], "q long, v array<float>")
    got, want = {}, {}
    for r in ann_topk(rows, "id", "v", asked, "q", "v").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["distance"]))
    for r in knn_topk(rows, "id", "v", asked, "q", "v", 10).collect():
        want.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert set(got) == set(range(60))
    assert np.mean([len({d for _, d, _ in g} & want[q]) / 10 for q, g in got.items()]) >= 0.9
    assert all(g == sorted(g) and [d for *_, d in sorted(g)] == sorted(d for *_, d in g) for g in map(sorted, got.values()))
    assert ann_topk(rows.limit(0), "id", "v", asked, "q", "v").count() == 0
    with pytest.raises(ValueError):
        Parameters(bits=70)
