"""Hand-worked cases of the order-dependent operators, readers, tables and the stream."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shirabe.functions import paths as P
from shirabe.functions import text as T
from shirabe.functions import times as D
from shirabe.functions.embedding import HashedEmbedding, embed
from shirabe.operators import changes, chunkers, evaluate, fusion, html_markdown, transcripts
from shirabe.operators.bm25 import bm25_topk
from shirabe.operators.exact_knn import knn_topk
from shirabe.sources import files
from shirabe.sources.tables import SegmentedTable, VersionedTable
from shirabe.streaming.ingest import ingest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


# --- chunkers


def test_prose_chunks():
    assert chunkers.prose_chunks("  short \n", 10, 2) == ["short"]
    assert chunkers.prose_chunks(None, 10, 2) == chunkers.prose_chunks(" \n", 10, 2) == []
    assert chunkers.prose_chunks("aaaa\n\nbbbb\n\ncccc", 10, 2) == ["aaaa\n\nbbbb", "bb cccc"]
    assert chunkers.prose_chunks("abcdefghijklmnopqrstuvwxy", 10, 2)[:3] == ["abcdefgh", "gh ijklmno", "nop"]
    assert all(len(c) <= 50 for c in chunkers.prose_chunks("One sentence here. Another one! " * 40, 50, 10))
    with pytest.raises(ValueError):
        chunkers.prose_chunks("x", 5, 5)


def test_heading_chunks():
    text = "intro text here\n# A\nbody a\n## B\nbody b\n## C\n# D\n<h2>E</h2>\nbody e"
    got = chunkers.heading_chunks(text, 100, 5)
    assert got == [("", 0, "", "intro text here"), ("A", 1, "A", "body a"), ("B", 2, "A > B", "body b"), ("E", 2, "D > E", "body e")]
    long = chunkers.heading_chunks("# T\n" + "\n\n".join(["word " * 5] * 4), 60, 5)
    assert [c[0] for c in long] == ["T"] + [""] * (len(long) - 1) and all(c[2] == "T" and len(c[3]) <= 60 for c in long)
    assert chunkers.heading_chunks("", 10, 1) == []


def test_table_chunks():
    table = "| name | hp | mp |\n|---|---|---|\n| A | 1 | 2 |\n| B | 3 | 4 |\n| C | 5 | 6 |"
    got = chunkers.table_chunks(table, 1, 0)
    assert got[1] == ("B", "名前: B\nhp: 3, mp: 4\n周辺行: A, C")
    assert chunkers.table_chunks(table, 1, 20)[1] == ("B", "名前: B\nhp: 3, mp: 4")
    assert [c for _, c in chunkers.table_chunks(table, 1, 12)][:2] == ["名前: A\nhp: 1", "名前: A\nmp: 2"]
    assert chunkers.parse_table("a\tb\n1\t2") == (["a", "b"], [["1", "2"]])
    assert chunkers.parse_table("a  b\n1  2") == (["a", "b"], [["1", "2"]])
    assert chunkers.table_chunks("one line", 1, 0) == chunkers.table_chunks(None, 1, 0) == []


def test_routed_chunks():
    kinds = lambda t: {k for k, _, _ in chunkers.routed_chunks(t, 200, 30, 714, True)}
    assert kinds("plain") == {"prose"} and kinds("# h\nx") == {"heading"}
    assert kinds("|a|b|\n|-|-|\n|1|2|") == {"table"} and kinds("") == set()


# --- columns


@pytest.mark.parametrize(
    "f,v,want",
    [
        (P.url_to_path, "https://u:p@Ex.com:80/a/b/?q=1#f", "web/https/Ex.com：80/a/b？q=1"), (P.url_to_path, "http://x.y", "web/http/x.y/index"), (P.url_to_path, "ftp://x.y/z", None),
        (P.path_to_url, "web/https/x.y/a？b=1", "https://x.y/a?b=1"), (P.path_to_url, "local/a", None), (P.url_to_filename, "http://x.y/", "index.html"), (P.url_to_filename, "http://x.y/a.PHP", "a.PHP"), (P.needs_html_ending, "http://x.y/a.pdf", False), (P.needs_html_ending, "http://x.y/a.b", True),
        (P.attachment_parent, "bluesky/d/2024/01/media/k/0.jpg", "bluesky/d/2024/01/k.json"), (P.attachment_parent, "web/media/x", None), (P.source_type, "web\\a", "web"), (P.source_type, "zzz/a", None),
        (P.is_source_file, "web/a.html", True), (P.is_source_file, "web/a.html.meta", False), (P.is_source_file, "metadata.db-wal", False), (P.is_source_file, "web/docdata/x", False),
        (P.route, "https://www.youtube.com/watch?v=abcdefghijk", "youtube"), (P.route, "https://youtu.be/x", "invalid_youtube"), (P.route, "https://bsky.app/x", "skip"), (P.route, "mailto:x", None), (P.route, "http://a.b", "web"),
        (P.url_problem, "http://10.0.0.1/x", "private"), (P.url_problem, "http:///x", "host"), (P.url_problem, "ftp://a", "scheme"), (P.url_problem, "https://a.b/c", None),
        (P.prefix_problem, "web/../x", "dots"), (P.prefix_problem, "C:/x", "drive"), (P.prefix_problem, "web/x", None), (P.like_escaped, "a%b_c\\", "a\\%b\\_c\\\\"),
        (T.content_type, None, "prose"), (T.content_type, "# a\n|x|y|\n|-|-|\n|1|2|", "mixed"), (T.content_type, "a  b  c\nd  e  f", "table"),
        (T.normalise, "a  \n\n\n\nb\u3000", "a\n\nb"), (T.tokens, "The CAT。の、x  dog", ["the", "cat", "dog"]), (T.sentences, "あ。い！ b. c", ["あ。", "い！ b.", "c"]),
        (D.normalised, "2026-01-15T00:00:00", "2026-01-14T15:00:00.000000+00:00"), (D.normalised, "2026-01-15T00:00:00.123Z", "2026-01-15T00:00:00.123000+00:00"), (D.normalised, "", ""), (D.normalised, "x", "x"),
        (D.japanese_day, "2026-02-30", None), (D.japanese_day, "2026-01-15", "2026-01-14T15:00:00.000000+00:00"),
    ],
)
def test_columns(spark, f, v, want):
    assert one(spark, f, v) == want


def test_formats(spark):
    assert [one(spark, T.size_text, n, "long") for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 30)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert [one(spark, T.elapsed_text, n, "long") for n in (5, 65, 3725)] == ["5.0 秒", "1 分 5.0 秒", "1 時間 2 分 5.0 秒"]
    assert one(spark, lambda c: T.slices(c, 4, 3), "abcdefgh") == ["abcd", "defg", "gh"] and one(spark, lambda c: T.slices(c, 4), "") == []


# --- search and evaluation


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, ""), (5, "blue whale")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red"), (2, None), (3, "nothing")], "q long, t string")
    got = [(r["query_id"], r["doc_id"], r["rank"]) for r in bm25_topk(docs, "doc_id", "text", asked, "q", "t").orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 1, 2)]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, v array<double>")
    near = knn_topk(vec, "id", "v", vec.filter("id = 1"), "id", "v", 2)
    assert [(r["doc_id"], r["distance"]) for r in near.orderBy("rank").collect()] == [(1, 0.0), (3, 0.292893)]
    assert knn_topk(vec.limit(0), "id", "v", vec.filter("id = 1"), "id", "v").count() == 0 == knn_topk(vec, "id", "v", vec.limit(0), "id", "v").count()


def test_nearest_of_queries_of_several_lengths(spark):
    vec = spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [-2.0]), (5, [0.0, 3.0]), (6, [0.0, 0.0, 1.0]), (7, None)], "id long, v array<double>")
    near = knn_topk(vec, "id", "v", vec.filter("id <> 6"), "id", "v", 2)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["distance"]) for r in near.collect()}
    assert got == {
        (1, 1): (1, 0.0), (1, 2): (4, 2.0), (4, 1): (4, 0.0), (4, 2): (1, 2.0), (2, 1): (2, 0.0), (2, 2): (3, 0.292893),
        (3, 1): (3, 0.0), (3, 2): (2, 0.292893), (5, 1): (5, 0.0), (5, 2): (3, 0.292893),
    }


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.5)], "query_id long, doc_id long, distance double")
    k = spark.createDataFrame([(1, 11, 3.0)], "query_id long, doc_id long, score double")
    got = {r["doc_id"]: r["score"] for r in fusion.combine(v, k, 0.9).collect()}
    assert got == {10: 0.9, 11: 0.1}
    assert {r["doc_id"]: r["score"] for r in fusion.combine(v, k, 7).collect()} == {10: 1.0}
    assert fusion.hybrid(v, k, 1, least=0.95).count() == 0


@pytest.mark.parametrize(
    "got,want,p,r,n,m,tags",
    [
        ([], [], 1.0, 1.0, 1.0, 1.0, []), (["a"], [], 0.0, 0.0, 0.0, 0.0, ["retrieval_noise"]), ([], ["a"], 0.0, 0.0, 0.0, 0.0, ["retrieval_miss", "query_mismatch"]),
        (["a", "b"], ["a"], 0.5, 1.0, 1.0, 1.0, ["retrieval_noise"]), (["b", "a"], ["a", "c"], 0.5, 0.5, 0.386853, 0.5, ["retrieval_miss", "retrieval_noise", "chunk_fragmentation"]), (["a"], ["a", "b", "c"], 1.0, 0.333333, 1.0, 1.0, ["retrieval_miss"]),
    ],
)
def test_metrics(spark, got, want, p, r, n, m, tags):
    df = spark.createDataFrame([(got, want, ["b"])], "retrieved array<string>, expected array<string>, negative array<string>")
    row = evaluate.score(df).first()
    assert (row["precision"], row["recall"], row["ndcg"], row["mrr"], row["tags"]) == (p, r, n, m, tags)


# --- changes and transcripts


def test_manifest_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "4")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "4"), ("z", "7")], "path string, hash string")
    got = {(r["status"], r["path"], r["old_path"]) for r in changes.manifest_diff(old, new).collect()}
    assert got == {("M", "b", None), ("R", "x", "c"), ("R", "y", "d"), ("D", "e", None), ("A", "z", None)}


def test_transcripts(spark):
    s = [(0.0, 1.0, "a"), (1.5, 1.2, "b"), (None, 9.0, "skipped"), (4.0, 5.0, "c"), (5.0, 6.0, "d" * 299)]
    assert transcripts.merge(s) == [(0.0, "ab"), (4.0, "c" + "d" * 299)] and transcripts.merge([]) == []
    df = spark.createDataFrame([(1, [{"start": x, "end": y, "text": t} for x, y, t in s]), (2, None)], "id long, s array<struct<start double, end double, text string>>")
    assert [(r["id"], r["start"]) for r in transcripts.merge_transcripts(df, "id", "s").collect()] == [(1, 0.0), (1, 4.0)]
    assert one(spark, lambda c: transcripts.clock(c, F.lit(100)), 65.5, "double") == "[01:05]" and one(spark, lambda c: transcripts.clock(c, F.lit(3600)), 3665.0, "double") == "[1:01:05]"


# --- pages


def test_html_to_markdown(spark):
    page = "<html><body><nav>menu</nav><article><h1>Title</h1><p>One <a href='/x'>link</a><p>Two<br>lines<img alt='pic'><ul><li>a<li>b</ul><ruby>漢<rt>かん</rt></ruby><div class='Breadcrumb'>buy</div><table><tr><th>h<th>i<tr><td>1<td>2</table><script>x</script></article></body></html>"
    md = html_markdown.convert(page)
    assert md == "# Title\n\nOne link\n\nTwo\nlinespic\n\n- a\n- b\n\n漢(かん)\n\n| h | i |\n|---|---|\n| 1 | 2 |"
    assert html_markdown.convert("<div id=x>no</div><div class=keep>yes</div>", [".keep"]) == "yes"
    assert html_markdown.convert("<main>a<b class=drop>b</b></main>", (), [".drop"]) == "a"
    df = spark.createDataFrame([("h/a", page), ("h/b", None), ("h/c", ""), ("k/d", "<div" * 500)], "k string, b string")
    assert {r["k"]: r["status"] for r in html_markdown.html_to_markdown(df, "k", "b", {"h": {"content": ["h1"]}}).collect()}["h/a"] == "ok"


# --- readers, tables, stream


def test_readers(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/a.md").write_text("hello")
    (tmp_path / "web/a.md.meta").write_text("title: 'T'\ntags:\n  - x\n  - y\n")
    (tmp_path / "other.bin").write_text("x")
    (row,) = files.source_tree(spark, str(tmp_path)).collect()
    assert (row["source_id"], row["source_type"], row["file_size"]) == ("web/a.md", "web", 5) and "title" in row["meta"]
    assert files.sidecar_fields(row["meta"]) == {"title": "T", "tags": "x,y"}
    bad = spark.createDataFrame([(1, "- a\n- b"), (2, "a: 1")], "k long, t string")
    assert {r["k"]: r["error"] is None for r in files.sidecars(bad, "k", "t").collect()} == {1: False, 2: True}
    log = tmp_path / "log.jsonl"
    log.write_text(json.dumps({"url": "u", "title": "t", "collected_at": "c"}) + "\n\nnot json\n" + json.dumps({"url": "u"}) + "\n")
    good, rejected = files.crawl_log(spark, str(log))
    assert [(r["status"], r["depth"], r["filepath"]) for r in good.collect()] == [(200, 0, "")] and rejected.count() == 2
    csv = tmp_path / "c.csv"
    csv.write_text("id,author,title\n2,Aoi,Sea\n1,Aoi,Sky\n3,Ben,Sea\n")
    assert [r["id"] for r in files.search_catalogue(files.catalogue_csv(spark, str(csv)), "id", "Ao", None, "author", "title", 5).collect()] == ["1", "2"]
    for n, error in ((True, TypeError), ("1", TypeError), (0, ValueError)):
        with pytest.raises(error):
            files.checked_limit(n, 10)
    assert files.checked_limit(99, 10) == 10


def test_presentations(spark):
    a, p = files._A[1:-1], files._P[1:-1]
    slide = f'<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>Top</a:t></a:p></p:sp><p:sp><a:p><a:t>Body</a:t></a:p></p:sp></p:sld>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
    df = spark.createDataFrame([(1, raw.getvalue()), (2, b"junk"), (3, None)], "k long, c binary")
    got = {r["k"]: (r["status"], r["text"]) for r in files.presentations(df, "k", "c").collect()}
    assert got == {1: ("ok", "## Slide 1: Top\n\nBody"), 2: ("failed", None), 3: ("skipped", "")}


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "id long, first string, v string")
    assert t.read() is None
    t.write(rows((1, "a", "x"), (2, "b", "y")))
    t.upsert(rows((2, "c", "z"), (3, "d", "w")), "id", ("first",))
    assert {tuple(r) for r in t.read().collect()} == {(1, "a", "x"), (2, "b", "z"), (3, "d", "w")}
    t.delete(F.col("id") == 1)
    assert t.read().count() == 2 and len(t.versions()) == 2


def test_embedding(spark):
    e = HashedEmbedding(16)
    v = e(["a", "a", "b"])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and (v[0] == v[1]).all() and (v[0] != v[2]).any()
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k long, t string")
    assert [r["k"] for r in embed(df, "k", "t", e).collect()] == [1]


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    at = {k: str(tmp_path / k) for k in ("chunks", "vectors", "log")}

    def send(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("source_id", "status", "updated_at", "text"), r))) for r in rows))
        q = ingest(spark, str(inbox), at["chunks"], at["vectors"], at["log"], HashedEmbedding(8))
        q.awaitTermination(120)
        chunks = SegmentedTable(spark, at["chunks"]).read().collect()
        assert {r["chunk_id"] for r in chunks} == {r["chunk_id"] for r in SegmentedTable(spark, at["vectors"]).read().collect()}
        return {(r["source_id"], r["text"]) for r in chunks}

    assert send("1.json", ("a", "active", "1", "old text"), ("b", "active", "1", "kept")) == {("a", "old text"), ("b", "kept")}
    assert send("2.json", ("a", "active", "2", "new text"), ("c", "active", "2", "")) == {("a", "new text"), ("b", "kept")}
    assert send("3.json", ("b", "deleted", "3", "kept"), ("a", "active", "3", "newer"), ("a", "active", "1", "late")) == {("a", "newer")}
    table = SegmentedTable(spark, at["chunks"])
    table.compact(9)
    assert {(r["source_id"], r["text"]) for r in table.read().collect()} == {("a", "newer")}
    again = spark.createDataFrame([("x", "x_0", 0)], "source_id string, chunk_id string, chunk_index long")
    for _ in range(2):  # a repeated batch changes nothing
        table.write_batch(10, again, again)
        assert {r["source_id"] for r in table.read().select("source_id").collect()} == {"a", "x"}
