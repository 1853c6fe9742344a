"""Oversized texts cut into pieces under a limit: content-defined chunking over natural boundaries.

A rolling hash over the text sets landmarks that depend on the text around them alone. Each landmark within the allowed sizes snaps to
the nearest natural boundary (the start of a sentence, heading, list item, table row, timed line or code block), so an edit alters
only the pieces next to it. Everything happens inside one row: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.session import spread

LIMIT, OVERLAP, LEAST = 731, 30, 240
#: Window of the rolling hash in characters, and the mean distance of its landmarks.
WINDOW, SPACING = 32, 128
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

_BLOCK = r"""
    (?P<fence>^(?:```|~~~)[\s\S]*?(?:^(?:```|~~~)[ \t\r]*$|\Z))
  | (?P<line>^\#{1,6}[ \t][^\n]*)
  | (?P<table>^[ \t]*\|[^\n]*)
"""
_TOKEN = re.compile(
    rf"""(?m)
    {_BLOCK}
  | (?P<item>^[ \t]*(?:[-*+•‣◦][ \t]|・|\d{{1,3}}[.)][ \t])[^\n]*)
  | (?P<time>^[\[(]?\d{{1,2}}:\d{{2}}(?::\d{{2}})?[\])]?[ \t　]+)
  | (?P<gap>\n[ \t\r　]*(?=\n))
  | (?P<newline>\n)
  | (?P<bracket>[「『（【(“"])
  | (?P<wide>[。．！？♪…‥][。．！？♪…‥!?.]*[」』）”]*)
  | (?P<narrow>(?:[!?]+|\.+)[!?.]*["”’)\]]*(?=[\s]|\Z))
    """,
    re.VERBOSE,
)
_MARK = re.compile(rf"""(?m){_BLOCK} | (?P<gap>\n[ \t\r　]*(?=\n)) | (?P<number>^[ \t]*\d{{1,3}}\)(?=[ \t])) | [「」『』（）【】()“”"]""", re.VERBOSE)
_OPENING = {"」": "「", "』": "『", "）": "（", "】": "【", ")": "(", "”": "“"}
_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t\r]*$")
_SOLID = re.compile(r"\S")
_ABBREVIATION = re.compile(r"(?:^|[\s(\"“‘\[])(?:Dr|Mr|Mrs|Ms|Prof|St|Jr|Sr|No|Nos|vol|Vol|fig|Fig|cf|Cf|pp?|vs|approx|[ei]\.[eg]|[A-Z])\.$")
_ABBREVIATION_BEFORE_LOWER = re.compile(r"(?:^|[\s(\"“‘\[])(?:etc|[ap]\.m|al|Inc|Ltd|Co|Corp|dept|est|incl|min|max|sec)\.$")
_JAPANESE = re.compile(r"[぀-ヿ一-鿿]")
_COMPLETE_JA = re.compile(r"(?:ました|ません|ます|です|でした|だった|である|がある|ている|示す|した|する|れる|える|ない|たい|しい|よう)[♪☆]?$")
_PARTIAL_JA = re.compile(r"(?:と書いた|という)$")
#: Words that end no sentence: articles, pronouns before a noun, conjunctions, prepositions, auxiliaries.
_PARTIAL_EN = re.compile(
    r"(?:^|[\s(\"“])(?:the|a|an|one|every|each|any|no|his|her|my|our|your|their|its|this|that|these|those|another|such|which|whose|who|and|or|but|so|if|when|while|because|since|although|after|before|as|"
    r"of|in|on|at|by|to|for|from|with|within|without|near|behind|beside|across|between|during|under|over|into|through|throughout|than|is|are|was|were|be|been|not|has|have|had)$",
    re.IGNORECASE,
)
_DATA_GOES_ON = re.compile(r"\S{0,40}(?:\s|、|。)")
_BRACKETED = re.compile(r"[(\"“「『（\[]([^)\"”」』）\]]*)[)\"”」』）\]]\s*(.?)")
_NAME_LIKE = re.compile(r"[a-z]{1,2}[A-Z]")
_ENDED = "。．！？♪…‥.!?"


def _soft(before: str, text: str, at: int) -> bool:
    """Whether a line break between the line ``before`` (no end mark) and what stands in ``text`` from ``at`` lies inside a sentence."""
    before = before.rstrip()
    first = text[at : at + 1]
    if not before or not first:
        return False
    if len(before) > 40 and not re.search(r"[\s、。]", before) and not _DATA_GOES_ON.match(text, at):
        return True  # a run of data over several lines
    if before[-1] in ",、，;；:・-–—／/(（「『“":
        return True
    if _JAPANESE.search(before[-3:]):
        return not _COMPLETE_JA.search(before[-8:]) or bool(_PARTIAL_JA.search(before[-6:]))
    if first in ",.;:!?)）」』、。" or first.islower() and not _NAME_LIKE.match(text, at):
        return True
    if _PARTIAL_EN.search(before[-30:]):
        return True
    if first in "(\"“「『（[":
        inner = _BRACKETED.match(text, at)
        if inner and (inner[1][:1].islower() or inner[2].islower()):
            return True
    return first in "$€£%" or first.isdigit()


def _closings(text: str) -> dict[int, int]:
    """Where each quotation mark or bracket that opens is closed, however far on. Marks in code, headings and table rows do not count,
    and the bracket of a list number closes only within its paragraph."""
    closed: dict[int, int] = {}
    running: dict[str, list[int]] = {mark: [] for mark in [*_OPENING.values(), '"']}
    gap = -1
    for m in _MARK.finditer(text):
        mark, at, kind = m.group()[-1:], m.end() - 1, m.lastgroup
        if kind == "gap":
            gap = at
        elif kind == "number":
            if running["("] and running["("][-1] > gap:
                closed[running["("].pop()] = at
        elif kind:
            continue
        elif mark == '"':
            free = at == 0 or text[at - 1].isspace() or text[at - 1] in "([{（「『【“"
            tight = at + 1 < len(text) and not text[at + 1].isspace() and text[at + 1] not in ",.;:!?)]}、。）」』】”"
            if tight and free or not running[mark] and (tight or free):
                running[mark] = [at]
            elif running[mark]:
                closed[running[mark].pop()] = at
        elif mark in _OPENING:
            if running[_OPENING[mark]]:
                closed[running[_OPENING[mark]].pop()] = at
        else:
            running[mark].append(at)
    return closed


def natural_boundaries(text: str) -> list[int]:
    """Offsets (in code points, ascending, without 0) of the first character of every natural unit."""
    starts: set[int] = set()
    size = len(text)
    opened = -1  # start of the sentence that is running, or -1 between sentences
    seen = 0  # end of the last token
    last_table = -1  # end of a table row in the line before
    row_count = 0

    def begin(upto: int) -> None:
        """A sentence that begins in the plain text between the last token and ``upto``."""
        nonlocal opened
        if opened < 0:
            m = _SOLID.search(text, seen, upto)
            if m:
                opened = m.start()
                starts.add(opened)

    closed = _closings(text)
    end = 0
    while m := _TOKEN.search(text, end):
        kind, at, end = m.lastgroup, m.start(), m.end()
        if kind == "bracket":
            if at not in closed:
                continue  # plain text
            end = closed[at] + 1
        begin(at)
        if kind in ("fence", "line", "item", "table"):
            solid = _SOLID.search(text, at, end)
            first = solid.start() if solid else at
            if kind == "table":
                row_count = row_count + 1 if last_table >= 0 and not text[last_table:at].strip() and text[last_table:at].count("\n") == 1 else 1
                if not (row_count == 2 and _RULE.match(m.group())):
                    starts.add(first)
                last_table = end
                opened = -1
            else:
                starts.add(first)
                opened = first if kind == "item" and not text[at:end].rstrip().endswith(tuple(_ENDED)) else -1
        elif kind == "time":
            starts.add(at)
            opened = at
        elif kind == "gap":
            opened = -1
        elif kind == "newline":
            if opened >= 0:
                line = text[text.rfind("\n", 0, at) + 1 : at].rstrip("\r \t　")
                rest = _SOLID.search(text, end)
                if rest is None or not _soft(line, text, rest.start()):
                    opened = -1
        elif kind == "bracket":
            whole = opened < 0
            if whole:
                opened = at
                starts.add(at)
            inner = text[at + 1 : end - 1].rstrip()
            if whole and inner[-1:] and inner[-1] in _ENDED:
                ja = bool(_JAPANESE.search(inner))
                after = text[end : end + 1]
                nxt = _SOLID.search(text, end)
                follow = nxt.group() if nxt else ""
                if ja:
                    done = after in ("", "\n", "\r") or (text[at] in "（(" and len(inner) >= 12)
                else:
                    done = after in ("", "\n", "\r", " ") and not follow.islower() and len(inner.split()) >= 6
                if done:
                    opened = -1
        elif kind == "wide":
            if opened >= 0:
                opened = -1
        elif kind == "narrow":
            if opened >= 0:
                nxt = _SOLID.search(text, end)
                mark = m.group()
                lower = nxt is not None and nxt.group().islower()
                word = text[max(0, at - 12) : at + 1]
                short = mark[0] == "." and mark[:2] != ".." and (_ABBREVIATION.search(word) or lower and _ABBREVIATION_BEFORE_LOWER.search(word))
                trailing = mark.startswith("..") and lower and "\n" not in text[end : nxt.start()]
                if not trailing and not short:
                    opened = -1
        seen = end
    begin(size)
    starts.discard(0)
    return sorted(starts)


def landmarks(text: str, window: int = WINDOW, spacing: int = SPACING) -> np.ndarray:
    """Positions whose rolling hash over the ``window`` characters before them is one in ``spacing``."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n = len(c)
    if n < window:
        return np.empty(0, np.int64)
    falling = np.cumprod(np.full(n, _BASE_INVERSE, np.uint64))
    rising = np.cumprod(np.full(n, _BASE, np.uint64))
    total = np.cumsum((c * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)) * falling)
    h = (total - np.concatenate([np.zeros(window, np.uint64), total[:-window]]))[window - 1 :] * rising[window - 1 :]
    h ^= h >> np.uint64(31)
    return np.flatnonzero((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(32) < np.uint64((1 << 32) // spacing)) + window


def divide(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> tuple[list[int], np.ndarray, list[int]]:
    """(natural boundaries, landmarks, cuts) of one text: cuts are the ends of all pieces but the last.

    Each piece with its overlap stays within ``limit``. A landmark in reach snaps to the nearest natural boundary in reach; where there
    is none, the landmark itself is the cut, and where there is no landmark either, the limit.
    """
    size = len(text)
    if size <= limit:
        return [], np.empty(0, np.int64), []
    units = natural_boundaries(text)
    natural, marks = np.array(units, np.int64), landmarks(text)
    out: list[int] = []
    start = 0
    while size - start + (overlap if out else 0) > limit:
        low, high = start + min(least, limit - overlap - 1), start + limit - (overlap if out else 0)
        m = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high, side="right")]
        b = natural[np.searchsorted(natural, low) : np.searchsorted(natural, high, side="right")]
        if not len(b):  # nothing natural that far: any boundary of this piece is better than none
            b = natural[np.searchsorted(natural, start, side="right") : np.searchsorted(natural, high, side="right")][-1:]
            b = b[b - start > overlap]
        if len(b):
            cut = int(b[np.abs(b - m[0]).argmin()]) if len(m) else int(b[-1])
        else:
            cut = int(m[-1]) if len(m) else high
        out.append(cut)
        start = cut
    return units, marks, out


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[int]:
    return divide(text, limit, overlap, least)[2]


def divided(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(key, natural, landmarks, cuts): how every oversized text is divided, from one pass over it; offsets in code points.

    Null, empty and short texts have no rows; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            rows = [divide(t, limit, overlap, least) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i in range(3))], names=["key", "natural", "landmarks", "cuts"])

    key_type = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).filter(F.char_length(text) > limit).mapInArrow(run, f"key {key_type}, natural array<bigint>, landmarks array<bigint>, cuts array<bigint>")


def boundaries(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(chunk_id, cut_at): the natural boundaries to which the splitter snaps its landmarks, of the texts of more than ``limit`` characters.

    Null, empty and short texts have no rows; repeated rows give repeated results; a text without any boundary has none.
    """
    return divided(df, key, text, limit, overlap, least).select(F.col("key").alias("chunk_id"), F.explode("natural").alias("cut_at"))


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(chunk_id, piece, start_at, end_at, text): the pieces of every oversized text in order.

    start_at and end_at are offsets of the piece's own part; its text begins up to ``overlap`` characters earlier, in the piece before.
    Joined without overlaps the pieces give the text back. A text within the limit, empty texts included, is one piece; null has none.
    Repeated rows give repeated pieces. ``limit`` must exceed twice ``overlap``.
    """
    if limit <= 2 * overlap or least >= limit:
        raise ValueError("limit must exceed twice the overlap, and least must be under limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, first, last, out = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ends = [0, *cuts(t, limit, overlap, least), len(t)]
                for n, (a, b) in enumerate(zip(ends, ends[1:])):
                    rows.append(i)
                    piece.append(n)
                    first.append(a)
                    last.append(b)
                    out.append(t[max(0, a - overlap if n else 0) : b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(out, pa.string())],
                names=["chunk_id", "piece", "start_at", "end_at", "text"],
            )

    key_type = df.schema[key].dataType.simpleString()
    named = df.select(F.col(key).alias("chunk_id"), F.col(text).alias("text"))
    long = spread(named).filter(F.char_length("text") > limit).mapInArrow(run, f"chunk_id {key_type}, piece bigint, start_at bigint, end_at bigint, text string")
    zero = F.lit(0).cast("bigint")
    short = named.filter(F.char_length("text") <= limit).select("chunk_id", zero.alias("piece"), zero.alias("start_at"), F.char_length("text").cast("bigint").alias("end_at"), "text")
    return short.unionByName(long)
