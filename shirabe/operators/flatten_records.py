"""Deeply nested semi-structured records turned into flat, linked tables.

Each record is stream-parsed into (path, ordinals, value) triples, token by token, without building its tree. A triple belongs to its innermost
ancestor that is an array element or a declared child object; the triples of one ancestor instance are pivoted into one row. Rows
carry the record's key and the ordinals of all enclosing array elements, so a child's parent is found by a prefix of its ordinals.

The whole operator is one narrow pass: a record's triples never leave its task, so nothing is shuffled and nothing grows beyond
one record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shirabe.session import spread

_WS = r"[ \t\r\n]*"
#: One token: a string with the colon or comma after it, another scalar with its comma, an opening mark, a closing mark with its comma.
_TOKEN = re.compile(rf'''(?:"([^"\\]*(?:\\.[^"\\]*)*)"{_WS}([,:])?|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null){_WS}(,)?|([\[{{])|([\]}}]){_WS}(,)?){_WS}''', re.DOTALL)
_LEADING = re.compile(_WS)
EMPTY = object()

Triple = tuple[str, tuple[int, ...], object]


class Incomplete(ValueError):
    """The text is not one complete JSON value."""


def _text(raw: str) -> str:
    if "\\" not in raw:
        return raw
    try:
        s = json.loads(f'"{raw}"', strict=False)
    except ValueError as e:
        raise Incomplete(raw[:40]) from e
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Step:
    """A path, with the paths one step below, and the table that its values belong to: anchor (the path of the innermost array element
    or declared object), the path of the cell inside it, and how many ordinals name the instance."""

    __slots__ = ("path", "prose", "below", "element", "single", "anchor", "cell", "depth", "wanted")

    def __init__(self, path: str, prose: bool, single: bool, anchor: str, cell: str, wanted: bool):
        self.path, self.prose, self.single, self.anchor, self.cell, self.wanted = path, prose, single, anchor, cell, wanted
        self.depth = anchor.count("[]")
        self.below: dict[str, Step] = {}
        self.element: Step | None = None


class Paths:
    """All paths met so far. repeated: keys whose value may be one object or a list; a lone object counts as element 0. objects: keys
    whose objects have rows of their own. prose: keys whose strings are never read as JSON. keep: a pattern of the anchors wanted."""

    MOST = 200_000  # paths kept for reuse; beyond that they are made anew, with the same results

    def __init__(self, repeated: Iterable[str] = (), objects: Iterable[str] = (), prose: Iterable[str] = (), keep: str | None = None):
        self.repeated, self.objects, self.prose = frozenset(repeated), frozenset(objects), frozenset(prose)
        self.keep = re.compile(keep) if keep else None
        self.start()

    def start(self) -> None:
        self.count = 0
        self.root = self._step("", "", "", "")

    def _step(self, path: str, key: str, anchor: str, cell: str) -> Step:
        self.count += 1
        return Step(path, key in self.prose, key in self.repeated, anchor, cell, self.keep is None or bool(self.keep.search(anchor)))

    def under(self, at: Step, key: str) -> Step:
        found = at.below.get(key)
        if found is None:
            path = f"{at.path}.{key}" if at.path else key
            own = key in self.objects
            found = at.below[key] = self._step(path, key, path if own else at.anchor, "" if own else f"{at.cell}.{key}" if at.cell else key)
        return found

    def each(self, at: Step) -> Step:
        if at.element is None:
            path = at.path + "[]"
            at.element = self._step(path, "", path, "")
            at.element.prose = at.prose
        return at.element


def read(text: str, paths: Paths, at: Step | None = None, ords: tuple[int, ...] = ()) -> list[tuple[Step, tuple[int, ...], object]]:
    """The (path, ordinals, value) triples of one JSON text in document order, from one pass over its tokens; no tree is built.

    A string that is itself complete JSON (an object or array) is read in place, however often that is nested: every level of it
    doubles the escapes, so the text itself bounds the depth. Raises Incomplete.
    """
    out: list[tuple[Step, tuple[int, ...], object]] = []
    emit = out.append
    here = paths.root if at is None else at  # the path of the value that comes next, or of the object whose key comes next
    under, each = paths.under, paths.each
    stack: list[tuple] = []  # (is array, its step, its ordinals, elements so far)
    inside, holder, count = None, here, 0  # the innermost array (True), object (False) or none (None), its step, elements so far
    close, value_due, key_due = False, True, False  # what may come: a closing mark, a value, a key
    tokens = _TOKEN.scanner(text, _LEADING.match(text).end())  # type: ignore[union-attr]
    size, end = len(text), 0
    while True:
        m = tokens.match()
        if m is None:
            raise Incomplete(text[end : end + 40])
        end = m.end()
        kind = m.lastindex
        if kind == 2 and m[2] == ":":
            if not key_due:
                raise Incomplete(text[end : end + 40])
            here = under(holder, _text(m[1]))
            close, value_due, key_due = False, True, False
            continue
        if kind == 5:
            if not value_due:
                raise Incomplete(text[end : end + 40])
            if inside:
                here, own = each(holder), ords + (count,)
            else:
                own = ords
            mark = m[5]
            if mark == "{" and here.single and not inside:
                here, own = each(here), own + (0,)
            stack.append((inside, holder, ords, count))
            inside, holder, ords, count = mark == "[", here, own, 0
            close, value_due, key_due = True, inside, not inside
            continue
        if kind >= 6:
            mark = m[6]
            if not close or inside is None or inside != (mark == "]"):
                raise Incomplete(text[end : end + 40])
            if key_due:
                emit((holder, ords, EMPTY))
            inside, holder, ords, count = stack.pop()
            comma = kind == 7
        else:
            if not value_due:
                raise Incomplete(text[end : end + 40])
            if inside:
                here, own = each(holder), ords + (count,)
            else:
                own = ords
            if kind <= 2:
                value: object = _text(m[1])
                mark = "" if here.prose else value.lstrip()[:1]  # type: ignore[union-attr]
                if mark and mark in "{[":
                    deep = mark == "{" and here.single and not inside
                    try:
                        out += read(value, paths, each(here) if deep else here, own + (0,) if deep else own)  # type: ignore[arg-type]
                    except Incomplete:
                        emit((here, own, value))
                else:
                    emit((here, own, value))
                comma = kind == 2
            else:
                raw = m[3]
                emit((here, own, None if raw == "null" else raw))
                comma = kind == 4
        count += 1
        if inside is None:
            if comma or end != size:
                raise Incomplete(text[end : end + 40])
            return out
        close, value_due, key_due = not comma, comma and inside, comma and not inside


def triples(text: str, repeated: Iterable[str], prose: Iterable[str]) -> list[Triple]:
    """The triples of one text with their paths as text. Array steps show as ``[]`` in the path and as a number in the ordinals."""
    return [(step.path, ords, value) for step, ords, value in read(text, Paths(repeated, (), prose))]


def group_and_pivot(items: Iterable[tuple[Step, tuple[int, ...], object]]) -> list[tuple[str, tuple[int, ...], dict[str, str | None]]]:
    """One row for each instance of a repeated ancestor or declared child object: (ancestor path, ordinals, its cells by relative path)."""
    rows: dict[tuple[str, tuple[int, ...]], dict[str, str | None]] = {}
    get = rows.get
    for step, ords, value in items:
        cell = step.cell
        if not step.wanted or value is None and not cell:
            continue  # (a null in place of an object)
        name = (step.anchor, ords[: step.depth])
        cells = get(name)
        if cells is None:
            cells = rows[name] = {}
        if value is not EMPTY and cell not in cells:
            cells[cell] = value  # type: ignore[assignment]
    return [(a, o, c) for (a, o), c in rows.items()]


SCHEMA = "{key} {key_type}, path string, ords array<int>, cells map<string,string>"


def flatten_records(df: DataFrame, key: str, payload: str, repeated: Iterable[str], objects: Iterable[str], prose: Iterable[str] = (), keep: str | None = None) -> DataFrame:
    """(key, path, ords, cells): the rows of all flat tables of the JSON column ``payload``; ``path`` names the table.

    keep: a regular expression on the path; other tables are not emitted. A payload that is null, empty, cut off or not JSON has no
    rows. Nulls inside a list take an ordinal but give no row. Repeated records give repeated rows. Of a key that an object repeats
    the first value counts. Further columns of ``df`` are not read, whatever their names; an empty table gives an empty table.
    """
    settings = (frozenset(repeated), frozenset(objects), frozenset(prose), keep)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Paths(*settings)
        for batch in batches:
            keys, paths, ords, cells = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                if known.count > Paths.MOST:
                    known.start()
                try:
                    rows = group_and_pivot(read(text, known))
                except Incomplete:
                    continue
                for p, o, c in rows:
                    keys.append(i)
                    paths.append(p)
                    ords.append(o)
                    cells.append(list(c.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(paths, pa.string()), pa.array(ords, pa.list_(pa.int32())), pa.array(cells, pa.map_(pa.string(), pa.string()))],
                names=[key, "path", "ords", "cells"],
            )

    return spread(df.select(key, payload)).mapInArrow(run, SCHEMA.format(key=f"`{key}`", key_type=key_type))


def tables(rows: DataFrame, key: str, shapes: dict[str, dict[str, str]], objects: Iterable[str]) -> dict[str, DataFrame]:
    """One typed table for each path of ``shapes``, {path: {cell: type}}, of rows as ``flatten_records`` gives them.

    Each has the record's key, ``ords`` (the instance), ``parent_path`` and ``parent_ords`` (the row one level up that it belongs to,
    null for the outermost) and a column for each cell, dots as underscores; a value that is not of the type is null.
    """
    own = frozenset(objects)
    out = {}
    for path, cells in shapes.items():
        steps = path.split(".") if path else []
        above = next((i for i in range(len(steps) - 1, 0, -1) if steps[i - 1].endswith("[]") or steps[i - 1] in own), 0)
        parent = ".".join(steps[:above])
        typed = [F.expr(f"try_cast(cells['{c}'] AS {kind})").alias(c.replace(".", "_")) for c, kind in cells.items()]
        link = F.lit(parent if steps else None).cast("string").alias("parent_path")
        upper = F.slice("ords", 1, parent.count("[]")) if parent.count("[]") else F.array().cast("array<int>")
        out[path] = rows.filter(F.col("path") == path).select(key, "ords", link, (upper if steps else F.lit(None).cast("array<int>")).alias("parent_ords"), *typed)
    return out


# --- the tables of a microblog feed -------------------------------------------------------------------------------------------

FEED_REPEATED = ("feed", "posts", "facets", "features", "images", "embeds")
FEED_OBJECTS = ("post", "record", "value", "embed", "media", "external", "video", "reply", "reason", "by", "author")
FEED_PROSE = ("text", "alt", "title", "description", "displayName", "handle", "uri", "cid", "tag", "cursor")
_WRAPPER = r"^(?:data\.)?(?:feed\[\]|posts\[\]|\[\])(?:\.|$)|^data(?:\.|$)"
_HOP = r"(?:embed|embeds\[\])\.record(?:\.record)?\.(?=value(?:\.|$)|embeds\[\])"


def feed_rows(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """Rows of all tables of feed payloads with ``item_pos`` (position of the post in its record), ``depth`` (quotes around the object)
    and ``tail`` (the path inside its own post: ``record``/``value`` for the record, ``embed``/``embeds[]`` for the view)."""
    rows = flatten_records(df, key, payload, FEED_REPEATED, FEED_OBJECTS, FEED_PROSE)
    listed = F.col("path").rlike(r"^(?:data\.)?(?:feed\[\]|posts\[\]|\[\])")
    inside = F.regexp_replace(F.regexp_replace("path", _WRAPPER, ""), r"^post(?:\.|$)", "")
    return rows.select(
        key,
        F.when(listed, F.get("ords", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("item_pos"),
        F.size(F.regexp_extract_all(inside, F.lit(_HOP), F.lit(0))).cast("bigint").alias("depth"),
        F.regexp_replace(inside, rf"^.*{_HOP}", "").alias("tail"),
        F.when(listed, F.slice("ords", 2, F.greatest(F.size("ords"), F.lit(1)))).otherwise(F.col("ords")).alias("ords"),
        "cells",
    )


def feed_children(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """(key, item_pos, depth, kind, child_pos): the child objects of the posts, each once though record and view both show it.

    child_pos counts the objects of one kind within one side (record or view) of a post; what both sides hold has the same position
    and falls together. The only shuffle is over these narrow rows, by record; numbering and distinct both reuse it.
    """
    tail, cells = F.col("tail"), F.col("cells")
    holder = r"^(?:(?:record|value)\.embed|embed|embeds\[\])(?:\.media)?"
    kind_of = F.element_at(cells, F.lit("$type"))
    has = lambda k: F.map_contains_key(cells, F.lit(k))
    named = lambda k: F.coalesce(F.element_at(cells, F.lit(k)), F.lit("")) != ""
    kind = (
        F.when(
            tail.rlike(r"^(?:record|value)\.facets\[\]\.features\[\]$"),
            F.when(kind_of.endswith("#link"), "link").when(kind_of.endswith("#tag"), "tag").when(kind_of.endswith("#mention"), "mention"),
        )
        .when(tail.rlike(holder + r"\.images\[\]$"), "image")
        .when(tail.rlike(holder + r"\.external$"), "external")
        .when(tail.rlike(holder + r"\.video$"), "video")
        .when(tail.rlike(r"^(?:embed|embeds\[\])(?:\.media)?$") & F.coalesce(kind_of.contains("embed.video"), kind_of.isNull() & has("cid")), "video")
        .when(
            tail.rlike(r"^(?:(?:record|value)\.embed|embed|embeds\[\])\.record(?:\.record)?$") & (has("uri") | has("notFound") | F.coalesce(kind_of.contains("embed.record#view"), F.lit(False))),
            "quote",
        )
        .when((F.col("depth") == 0) & (tail == "record.reply"), "reply")
        .when((F.col("depth") == 0) & (tail == "reason.by") & (named("handle") | named("did")), "repost")
    )
    side = F.when(tail.rlike(r"^(?:record|value)\."), "record").otherwise("view")
    found = feed_rows(df, key, payload).select(key, "item_pos", "depth", F.explode(F.array_compact(F.array(kind))).alias("kind"), side.alias("side"), "ords")
    order = Window.partitionBy(key, "item_pos", "depth", "kind", "side").orderBy("ords")
    numbered = found.repartition(key).withColumn("child_pos", F.row_number().over(order).cast("bigint") - 1)
    return numbered.select(key, "item_pos", "depth", "kind", "child_pos").distinct()


#: A quoted post as its holder's view shows it: all up to its own object, which holds its uri, value and author.
_QUOTED = r"^((?:[^.]+\.)*?(?:(?:embed|embeds\[\])\.record(?:\.record)?\.)*(?:embed|embeds\[\])\.record(?:\.record)?)(?:\.(value|author))?$"


def feed_posts(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """One row for each post, quoted ones too: (key, item_pos, depth, place, uri, handle, text, created_at, reposted_by).

    place: empty for a post of the feed, else where the quoted post stands in it, with its ordinals, so that two quotes at one depth
    are two rows; a quote inside a quote begins with the place of the outer one. Missing parts are null.
    """
    rows = flatten_records(df, key, payload, FEED_REPEATED, FEED_OBJECTS, FEED_PROSE)
    listed = F.col("path").rlike(r"^(?:data\.)?(?:feed\[\]|posts\[\]|\[\])")
    inside = F.regexp_replace(F.regexp_replace("path", _WRAPPER, ""), r"^post(?:\.|$)", "")
    rows = rows.select(key, F.when(listed, F.get("ords", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("item_pos"), inside.alias("inside"), F.when(listed, F.slice("ords", 2, F.greatest(F.size("ords"), F.lit(1)))).otherwise(F.col("ords")).alias("ords"), "cells")
    view = ~F.col("inside").rlike(r"^(?:record|value)\.|\.value\.")  # a record only names what it quotes
    quoted = F.when(view, F.regexp_extract("inside", _QUOTED, 1)).otherwise("")
    rows = rows.withColumn("quoted", quoted).withColumn("part", F.when(F.col("quoted") == "", F.col("inside")).otherwise(F.regexp_extract("inside", _QUOTED, 2)))
    own = rows.filter(F.col("part").isin("", "record", "value", "author", "reason.by"))
    lists = F.length("quoted") - F.length(F.replace("quoted", F.lit("["), F.lit("")))
    hops = F.size(F.regexp_extract_all("quoted", F.lit(r"(?:embed|embeds\[\])\.record(?:\.record)?"), F.lit(0)))
    place = F.when(F.col("quoted") == "", "").otherwise(F.concat("quoted", F.when(lists > 0, F.concat(F.lit(":"), F.array_join(F.slice("ords", F.lit(1), F.greatest(lists, F.lit(1))), "."))).otherwise("")))
    cell = lambda parts, name: F.max(F.when(F.col("part").isin(parts), F.element_at("cells", F.lit(name))))
    return own.groupBy(key, "item_pos", hops.cast("bigint").alias("depth"), place.alias("place")).agg(
        cell([""], "uri").alias("uri"),
        cell(["author"], "handle").alias("handle"),
        cell(["record", "value"], "text").alias("text"),
        cell(["record", "value"], "createdAt").alias("created_at"),
        cell(["reason.by"], "handle").alias("reposted_by"),
    )
