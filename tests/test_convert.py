"""Conversion by kind, rules, decoding, filters, lookups and reports."""

import json

import pytest

from shirabe.functions.filters import parse_filters, where
from shirabe.operators import convert as C
from shirabe.operators.lookups import check_urls, evaluation_dataset, report, updated_cache


def test_files(spark):
    article = json.dumps({"article": {"title": "T", "body_html": "<p>Body</p>"}}).encode()
    scrap = json.dumps({"scrap": {"comments": [{"body_html": "<p>a</p>"}, None, {"body_html": "<p>b</p>"}]}}).encode()
    talk = json.dumps({"duration": 4000, "snippets": [{"start": 1, "end": 2, "text": "x"}, {"start": "?", "text": "y"}, {"start": 3700, "text": "z"}]}).encode()
    rows = [("web/https/h.example/a.html", b"<body><div id=x>no</div><p>yes</p>"), ("local/a.md", " keep\n ".encode()), ("zenn/a.json", article), ("zenn/s.json", scrap), ("youtube/v.json", talk), ("zenn/bad.json", b"{"), ("local/p.pptx", b"junk"), ("local/x.bin", b"1"), ("local/e.txt", b""), ("local/n.txt", None), ("local/j.html", "<meta charset=Shift_JIS><p>日本</p>".encode("cp932"))]
    rules = C.site_rules('["h.example"]\ncontent = ["p"]')
    got = {r["path"]: (r["status"], r["text"]) for r in C.convert_files(spark.createDataFrame(rows, "path string, content binary"), "path", "content", rules).collect()}
    assert got["web/https/h.example/a.html"] == ("ok", "yes") and got["local/a.md"] == ("ok", " keep\n ")
    assert got["zenn/a.json"][1] == "# T\n\nBody" and got["zenn/s.json"][1] == "a\n\n---\n\nb" and got["youtube/v.json"][1] == "[0:00:01] x\n\n[1:01:40] z"
    assert got["local/j.html"][1] == "日本"
    assert {k: got[k][0] for k in ("zenn/bad.json", "local/p.pptx", "local/x.bin", "local/e.txt", "local/n.txt")} == {"zenn/bad.json": "failed", "local/p.pptx": "failed", "local/x.bin": "skipped", "local/e.txt": "skipped", "local/n.txt": "skipped"}


def test_due(spark):
    files = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9)], "path string, modified_at long")
    done = spark.createDataFrame([("a", 5), ("c", 6)], "path string, modified_at long")
    names = lambda o: {r["path"] for r in C.due(files, done, "path", o).collect()}
    assert (names("skip"), names("if_modified"), names("force")) == ({"b"}, {"b", "c"}, {"a", "b", "c"})
    with pytest.raises(ValueError):
        C.due(files, done, "path", "never")


def test_rules_and_repair():
    for bad in ('[h]\nother = ["p"]', '[h]\ncontent = [" "]', "h = 1"):
        with pytest.raises(ValueError):
            C.site_rules(bad)
    assert C.repaired("日本".encode().decode("latin-1")) == "日本" == C.repaired("日本")
    assert C.repaired("日本語".encode("cp932").decode("latin-1")) == "日本語" and C.repaired("café") == "café"


def test_filters(spark):
    assert parse_filters("a=1, b=x=y,") == {"a": "1", "b": "x=y"} and parse_filters(None) == {}
    for bad in ("a", "=1"):
        with pytest.raises(ValueError):
            parse_filters(bad)
    df = spark.createDataFrame([(1, '{"k": "V", "n": 5}', "web"), (2, '{"k": "v"}', "local"), (3, "junk", "web"), (4, None, "web")], "id long, meta string, source_type string")
    ids = lambda *a, **k: [r["id"] for r in df.filter(where("meta", *a, **k)).orderBy("id").collect()]
    assert ids({"k": "V"}) == [1] and ids({"k": "v"}, mode="loose") == [1, 2] and ids({"n": "5"}) == [] and ids({"n": "5"}, mode="loose") == [1] and ids({}, "web") == [1, 3, 4]
    with pytest.raises(ValueError):
        where("meta", {"a.b": "1"})


def test_lookups(spark, tmp_path):
    urls = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "url string")
    threats = spark.createDataFrame([("b", "malware"), ("b", "phishing"), ("c", "malware")], "url string, threat string")
    cache = spark.createDataFrame([("c", True, [], 200.0), ("a", False, ["old"], 50.0)], "url string, safe boolean, threats array<string>, expires_at double")
    res = check_urls(urls, threats, cache, 100.0)
    assert {r["url"]: (r["safe"], r["threats"], r["cached"]) for r in res.collect()} == {"a": (True, [], False), "b": (False, ["malware", "phishing"], False), "c": (True, [], True)}
    assert {r["url"]: r["expires_at"] for r in updated_cache(cache, res, 100.0).collect()} == {"a": 400.0, "b": 400.0, "c": 200.0}
    (tmp_path / "d.json").write_text(json.dumps({"queries": [{"id": "1", "query": "q", "expected_sources": ["s"]}, {"id": "2", "query": "r"}]}))
    assert [(r["id"], r["expected_sources"], r["negative_sources"]) for r in evaluation_dataset(spark, str(tmp_path / "d.json")).orderBy("id").collect()] == [("1", ["s"], []), ("2", [], [])]
    text, markdown, regressed = report({"f1": 0.5, "ndcg": 0.25}, {"f1": 0.7})
    assert regressed and json.loads(text)["regressed"] and "| ndcg | 0.2500 |" in markdown
