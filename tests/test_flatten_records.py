"""Triples, grouping and the feed's child objects against a plain recursive reading."""

import json

import pytest

from shirabe.operators.flatten_records import FEED_OBJECTS, FEED_PROSE, FEED_REPEATED, Incomplete, Paths, feed_children, feed_posts, flatten_records, group_and_pivot, read, tables, triples

NONE = frozenset()


def leaves(x, path="", ords=()):
    """All scalars of a parsed value, as triples, in document order."""
    if isinstance(x, dict):
        for k, v in x.items():
            yield from leaves(v, f"{path}.{k}" if path else k, ords)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from leaves(v, path + "[]", ords + (i,))
    else:
        yield path, ords, x


@pytest.mark.parametrize("value", [{"a": [1, {"b": ["x", None, [True]]}], "c": {"d": "q\"\\\nあ\U0001f600"}}, [], {}, [[[]]], "text", 3, {"": {"": 0}}])
def test_triples_match_a_parser(value):
    got = [(p, o, v) for p, o, v in triples(json.dumps(value), NONE, frozenset(["c", "d"])) if not isinstance(v, object.__class__) and type(v) is not object]
    want = [(p, o, v if v is None or isinstance(v, str) else json.dumps(v)) for p, o, v in leaves(value)]
    assert got == want


@pytest.mark.parametrize("text", ["", " ", "{", "[1,", '{"a"}', '{"a":1,}', "[1,]", '{"a":1}}', "[1 2]", "nul", '"abc', '{"a":"x', "{]", "1 2", '{1:2}'])
def test_incomplete(text):
    with pytest.raises(Incomplete):
        triples(text, NONE, NONE)


def test_single_and_json_in_string():
    rep = frozenset(["xs"])
    one = triples('{"xs": {"a": 1}}', rep, NONE)
    assert one == triples('{"xs": [{"a": 1}]}', rep, NONE) == triples(json.dumps({"xs": json.dumps({"a": 1})}), rep, NONE)
    assert triples(json.dumps({"text": '{"a": 1}'}), rep, frozenset(["text"])) == [("text", (), '{"a": 1}')]


def test_group_and_pivot_links_children():
    rows = group_and_pivot(read('{"id": 7, "xs": [{"a": 1, "ys": [{"b": 2}, null, {"b": 3}]}, {"a": null}]}', Paths()))
    assert rows == [("", (), {"id": "7"}), ("xs[]", (0,), {"a": "1"}), ("xs[].ys[]", (0, 0), {"b": "2"}), ("xs[].ys[]", (0, 2), {"b": "3"}), ("xs[]", (1,), {"a": None})]


def feed(*items):
    return json.dumps({"feed": list(items)})


LINK = {"$type": "x.facet#link", "uri": "https://a.example"}
POST = {
    "post": {
        "record": {
            "text": "t",
            "facets": [None, {"features": LINK}, {"features": [{"$type": "x.facet#tag", "tag": "k"}, LINK]}],
            "embed": {"$type": "app.bsky.embed.images", "images": [{"alt": "a"}, None, {"alt": "b"}]},
            "reply": {"parent": {"uri": "u"}, "root": {"uri": "u"}},
        },
        "embed": {"$type": "app.bsky.embed.images#view", "images": [{"alt": "a", "thumb": "x"}, {"alt": "b", "thumb": "y"}]},
    },
    "reason": {"by": {"handle": "h"}},
}
QUOTE = {
    "post": {
        "record": {"embed": {"record": {"uri": "q", "cid": "c"}}},
        "embed": {"record": {"$type": "app.bsky.embed.record#viewRecord", "uri": "q", "value": {"facets": [{"features": [LINK]}], "embed": json.dumps({"external": {"uri": "e"}})}, "embeds": [{"external": {"uri": "e"}}]}},
    }
}


def test_feed_children(spark):
    rows = [(1, feed(POST, QUOTE)), (2, json.dumps(feed(QUOTE))), (3, feed(POST)[:-3]), (4, None), (5, ""), (6, json.dumps([{"post": {}}, POST])), (7, json.dumps(POST))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, payload string, kind string")
    got = {tuple(r) for r in feed_children(df).collect()}

    def post(rec, pos):
        return {(rec, pos, 0, k, i) for k, n in (("link", 2), ("tag", 1), ("image", 2), ("reply", 1), ("repost", 1)) for i in range(n)}

    quote = lambda rec, pos: {(rec, pos, 0, "quote", 0), (rec, pos, 1, "link", 0), (rec, pos, 1, "external", 0)}
    assert got == post(1, 0) | quote(1, 1) | quote(2, 0) | post(6, 1) | post(7, 0)


def test_posts_empty_and_long(spark):
    df = spark.createDataFrame([(1, feed({"post": {"uri": "u", "record": {"text": "x" * 300_000}}})), (1, None)], "record_id long, payload string")
    (row,) = feed_posts(df).collect()
    assert (row["uri"], len(row["text"])) == ("u", 300_000)
    assert feed_children(df.limit(0)).count() == 0
    assert flatten_records(df.limit(0), "record_id", "payload", FEED_REPEATED, FEED_OBJECTS, FEED_PROSE).count() == 0


def test_json_in_strings_at_any_depth():
    value = {"images": [{"alt": "x"}]}
    for _ in range(9):
        value = {"embed": json.dumps(value)}
    assert triples(json.dumps(value), NONE, NONE) == [("embed." * 9 + "images[].alt", (0,), "x")]


def test_two_quotes_at_one_depth_and_their_links(spark):
    quote = lambda u, inner=(): {"record": {"$type": "app.bsky.embed.record#viewRecord", "uri": u, "author": {"handle": "h" + u}, "value": {"text": "t" + u, "createdAt": "2024"}, "embeds": list(inner)}}
    post = {"post": {"uri": "p", "record": {"text": "tp"}, "embed": quote("a", [quote("b"), quote("c", [quote("d")])])}}
    df = spark.createDataFrame([(1, feed(POST, post)), (2, json.dumps(post))], "record_id long, payload string")
    got = {(r["item_pos"], r["depth"], r["place"]): (r["uri"], r["handle"], r["text"]) for r in feed_posts(df).collect() if r["record_id"] == 1 and r["item_pos"] == 1}
    e = "embed.record"
    assert got == {
        (1, 0, ""): ("p", None, "tp"), (1, 1, e): ("a", "ha", "ta"), (1, 2, f"{e}.embeds[].record:0"): ("b", "hb", "tb"),
        (1, 2, f"{e}.embeds[].record:1"): ("c", "hc", "tc"), (1, 3, f"{e}.embeds[].record.embeds[].record:1.0"): ("d", "hd", "td"),
    }
    assert {r["uri"] for r in feed_posts(df).collect() if r["record_id"] == 2} == {"p", "a", "b", "c", "d"}


def test_typed_tables_with_parent_keys(spark):
    text = json.dumps({"id": 7, "xs": [{"a": 1, "o": {"n": 5}, "ys": [{"b": 2.5}, {"b": "x"}]}, {"a": None}]})
    df = spark.createDataFrame([(1, text)], "k long, p string")
    got = tables(flatten_records(df, "k", "p", [], ["o"]), "k", {"": {"id": "bigint"}, "xs[]": {"a": "int"}, "xs[].o": {"n": "int"}, "xs[].ys[]": {"b": "double"}}, ["o"])
    plain = {p: sorted((tuple(r) for r in t.collect()), key=repr) for p, t in got.items()}
    assert plain[""] == [(1, [], None, None, 7)]
    assert plain["xs[]"] == [(1, [0], "", [], 1), (1, [1], "", [], None)]
    assert plain["xs[].o"] == [(1, [0], "xs[]", [0], 5)]
    assert plain["xs[].ys[]"] == [(1, [0, 0], "xs[]", [0], 2.5), (1, [0, 1], "xs[]", [0], None)]
    assert got["xs[].ys[]"].schema["b"].dataType.simpleString() == "double"
