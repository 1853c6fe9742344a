"""Evaluation passages that stand, whole or in part, in a large corpus.

Texts become token sequences (a word, or a character of a script without spaces, each, after escapes, markup, case and width are
undone). Windows that begin at several places of each sentence of an item are embedded by the CGK random walk, which turns edit
distance into Hamming distance: at every step the walk puts out the token under it and moves on or stays, as a random bit of (walk,
step, token) says, so that after an edit two walks soon run together again. Some steps of the walk are sampled and hashed; this is
repeated with several walks and as many windows as the sentence may hold edits and one more, so that the target recall is reached. The
windows that start at every token of a document take the same walks, dropping out as soon as their samples meet no item. Where one
meets, the sentence is verified by exact edit distance, the other sentences of its item are looked for by edit distance within three
passage lengths around it, and the pair is a leak if enough of them follow each other.

The items are few and fixed in number; they travel in blocks of at most ITEMS_MOST, each block a pass over the corpus. The corpus is
read in place: nothing of it is shuffled but the found pairs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shirabe.llm.split_items import natural_boundaries
from shirabe.session import spread

ITEMS_MOST = 20_000
#: The least lengths in tokens of the classes of windows, over which their walks are sampled, the walks of each class, and the samples of a walk.
CLASSES, WALKS, SAMPLES = (2, 4, 7, 12, 20), (4, 8, 5, 4, 4), 4
_MIX = np.uint64(0x94D049BB133111EB)
_PAD = 64

#: Scripts written without spaces, a token for each character.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u3005\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[^\W_{_SINGLE}]+|[{_SINGLE}]")
_UNICODE_ESCAPE = re.compile(r"\\u\{?([0-9a-fA-F]{4,6})\}?|\\x([0-9a-fA-F]{2})")
_PAIR = re.compile(r"\\u(d[89ab][0-9a-f]{2})\\u(d[c-f][0-9a-f]{2})", re.IGNORECASE)
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2}){2,}")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--.*?-->", re.DOTALL)
_LINK = re.compile(r"\]\([^()\s]*\)")
_DROPPED = "*_`~\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_JOINED = re.compile(rf"(?<=[^\W\d_{_SINGLE}])(?:-\s*|['’])(?=[^\W\d_{_SINGLE}])")


def undone(text: str) -> str:
    """The text without escapes, markup, invisible marks, case and width."""
    if "\\" in text:
        text = _PAIR.sub(lambda m: chr(0x10000 + ((int(m[1], 16) & 0x3FF) << 10 | int(m[2], 16) & 0x3FF)), text)
        text = _UNICODE_ESCAPE.sub(lambda m: chr(min(int(m[1] or m[2], 16), 0x10FFFF)), text)
        text = re.sub(r"\\[nrtbf\"'/\\]", " ", text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m.group(), errors="replace"), text)
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    for mark in _DROPPED:
        if mark in text:
            text = text.replace(mark, "")
    return _JOINED.sub("", text) if "-" in text or "'" in text or "’" in text else text


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(undone(text))


def _is_single(words: Sequence[str]) -> bool:
    """Whether most tokens are characters of scripts without spaces."""
    return 2 * sum(len(w) == 1 and w >= "\u0e00" for w in words) > len(words)


@dataclass
class Item:
    """A passage: its sentences as token ids, their weights in characters and the allowed edits of each."""

    sentences: list[list[int]] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    edits: list[int] = field(default_factory=list)
    masks: list[dict[int, int]] = field(default_factory=list)
    kinds: list[set[int]] = field(default_factory=list)
    length: int = 0
    single: bool = False


@dataclass
class Index:
    ids: list
    items: list[Item]
    vocabulary: dict[str, int]
    widths: np.ndarray
    flat: np.ndarray  # all passages in a row, each with _PAD zeros behind it
    sentences: np.ndarray  # of each sentence: item, number in it, first token in ``flat``, tokens, edits
    bits: np.ndarray  # [walk, step, token]: whether the walk moves on
    mixed: np.ndarray  # a random number for each token
    tables: list  # for each class of windows: (its first tokens, [(walk, sampled steps, prefixes, sorted hashes, sentences, offsets)] for each walk)


def _allowed(n: int, single: bool) -> int:
    return min(n - 1, (1 if n < 80 else 2) if single else -(-n // 8))


def sampled_steps(kind: int, walk: int) -> list[int]:
    """The steps whose output is sampled: the first, and others up to where a walk has usually passed the class's least length."""
    last = max(3, CLASSES[kind] * 2)
    rest = np.random.default_rng([kind, walk]).choice(np.arange(1, last), min(SAMPLES, last) - 1, replace=False)
    return [0, *sorted(rest.tolist())]


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """Places of hashes in a table of ``size``, a power of two."""
    return ((h * _MIX) >> np.uint64(65 - size.bit_length())).astype(np.int64)


@dataclass
class Prefixes:
    """The hashes of windows so far, as a table of bits; sent as the places that are set and spread out where it is used."""

    size: int
    places: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray) -> Prefixes:
        size = 1 << max(12, (16 * len(h)).bit_length())
        return cls(size, np.unique(_places(h, size)).astype(np.int32))

    def have(self, h: np.ndarray) -> np.ndarray:
        if not hasattr(self, "table"):
            self.table = np.zeros(self.size, bool)
            self.table[self.places] = True
        return self.table[_places(h, self.size)]

    def __getstate__(self) -> dict:
        return {"size": self.size, "places": self.places}


def take_walks(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray | None, bits: np.ndarray, mixed: np.ndarray, steps: Sequence[int], maps: Sequence[Prefixes] | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(which starts remain, their hashes, the hashes so far after each sample): one CGK walk from every start.

    ends: where a walk must not go beyond (items). maps: prefixes of items' hashes; a walk whose own is in none drops out (documents).
    """
    live, at = np.arange(len(starts)), starts.copy()
    h = np.zeros(len(starts), np.uint64)
    sampled, prefixes, n = set(steps), [], 0
    for step in range(steps[-1] + 1):
        token = flat[at]
        if step in sampled:
            if ends is not None:
                keep = at < ends[live]
                live, at, h, token = live[keep], at[keep], h[keep], token[keep]
            h = h * _MIX + mixed[token]
            if maps is not None and n:
                keep = maps[n].have(h)
                live, at, h, token = live[keep], at[keep], h[keep], token[keep]
            elif maps is None:
                prefixes.append(h.copy())
            n += 1
            if not len(live):
                break
        at += bits[step][token]
    return live, h, prefixes


def build_index(ids: Sequence, passages: Sequence[str]) -> Index:
    """The index over one block of items."""
    vocabulary: dict[str, int] = {}
    items: list[Item] = []
    flat: list[int] = []
    sentences: list[tuple[int, int, int, int, int]] = []
    windows: list[tuple[int, int, int]] = []  # sentence, offset in it, where the window ends in ``flat``
    for n, passage in enumerate(passages):
        ends = [0, *natural_boundaries(passage), len(passage)]
        item = Item()
        parts = [(tokens(passage[a:b]), len(passage[a:b].strip())) for a, b in zip(ends, ends[1:])]
        item.single = _is_single([w for p, _ in parts for w in p])
        stop = len(flat) + sum(len(p) for p, _ in parts)
        for words, weight in parts:
            if not words:
                continue
            size, edits = len(words), _allowed(len(words), _is_single(words))
            item.sentences.append([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words])
            item.masks.append(masks_of(item.sentences[-1]))
            item.kinds.append(set(item.sentences[-1]))
            item.weights.append(weight)
            item.edits.append(edits)
            item.length += sum(map(len, words)) + (0 if item.single else size)
            least = CLASSES[0] if size <= 2 * CLASSES[1] else CLASSES[1] + 2  # the ends of longer sentences are no windows of their own
            for offset in sorted({t * size // (edits + 1) for t in range(edits + 1) if not t or size - t * size // (edits + 1) >= least}):
                windows.append((len(sentences), offset, len(flat) + size if size - offset >= CLASSES[0] else stop))
            sentences.append((n, len(item.sentences) - 1, len(flat), size, edits))
            flat += item.sentences[-1]
        flat += [0] * _PAD
        items.append(item)
    table = np.array(sentences, np.int64).reshape(-1, 5)
    tokens_flat = np.array(flat, np.int32)
    rng = np.random.default_rng(5)
    size = len(vocabulary) + 1
    most = max(3, CLASSES[-1] * 2)
    bits = rng.integers(0, 2, (max(WALKS), most, size), np.int64)
    mixed = rng.integers(0, 1 << 63, size, np.uint64)
    owner, offset, end = np.array(windows, np.int64).reshape(-1, 3).T
    starts = table[owner, 2] + offset
    kind = np.searchsorted(CLASSES, end - starts, side="right") - 1
    tables = []
    for c in range(len(CLASSES)):
        own = np.flatnonzero(kind == c)
        if not len(own):
            continue
        first = np.zeros(size, bool)
        first[tokens_flat[starts[own]]] = True
        walks = []
        for w in range(WALKS[c]):
            steps = sampled_steps(c, w)
            live, h, prefixes = take_walks(tokens_flat, starts[own], end[own], bits[w], mixed, steps, None)
            maps = [Prefixes.of(p) for p in prefixes]
            order = np.argsort(h, kind="stable")
            walks.append((w, steps, maps, h[order], owner[own[live[order]]], offset[own[live[order]]]))
        tables.append((first, walks))
    widths = np.zeros(size, np.int32)
    for w, n in vocabulary.items():
        widths[n] = len(w)
    return Index(list(ids), items, vocabulary, widths, tokens_flat, table, bits, mixed, tables)


def probe(index: Index, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place where it would start, sentence): the sentences that share the samples of a walk with a window of the token array, and all
    but whose edits of their tokens are as far from their places as the edits can move them."""
    flat = np.concatenate([flat, np.zeros(_PAD, np.int32)])
    known = np.flatnonzero(flat)
    places, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first, walks in index.tables:
        starts = known[first[flat[known]]]
        for w, steps, maps, hashes, sentence, offset in walks:
            live, h, _ = take_walks(flat, starts, None, index.bits[w], index.mixed, steps, maps)
            left = np.searchsorted(hashes, h, side="left")
            n = np.searchsorted(hashes, h, side="right") - left
            rows = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            places.append(np.repeat(starts[live], n) - offset[rows])
            owners.append(sentence[rows])
    place, sentence = np.concatenate(places), np.concatenate(owners)
    once = np.sort(place * len(index.sentences) + sentence)
    once = once[np.r_[True, once[1:] != once[:-1]]] if len(once) else once
    place, sentence = once // max(1, len(index.sentences)), once % max(1, len(index.sentences))
    size = len(flat)
    _, _, first, tokens_in, edits = index.sentences[sentence].T
    missed = np.zeros(len(place), np.int64)
    live = np.arange(len(place))
    done = [live[:0]]
    step = 0
    while len(live):
        over = tokens_in[live] <= step
        done.append(live[over])
        live = live[~over]
        o = tokens_in[live] - 1 - step  # from the end, where fewer samples lie
        token, e, to = index.flat[first[live] + o], edits[live], place[live] + o
        hit = np.zeros(len(live), bool)
        for shift in range(int(e.max(initial=0)) + 1):
            for near in {shift, -shift}:
                hit |= (flat[np.clip(to + near, 0, size - 1)] == token) & (shift <= e)
        missed[live] += ~hit
        live = live[missed[live] <= e]
        step += 1
    kept = np.concatenate(done)
    return place[kept], sentence[kept]


def masks_of(a: Sequence[int]) -> dict[int, int]:
    """Where each token stands in ``a``, as bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def edit_matches(a: Sequence[int], b: Sequence[int], most: int, masks: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """(distance, end) of every place in ``b`` where all of ``a`` ends within ``most`` edits (bit-parallel); of ends in a row the best."""
    n = len(a)
    masks = masks or masks_of(a)
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    out: list[tuple[int, int]] = [(n, 0)] if n <= most else []
    for j, x in enumerate(b):
        eq = masks.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # a match may start anywhere in b
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most:
            if out and out[-1][1] >= j + 1 - 2 * most and j:
                if score < out[-1][0]:
                    out[-1] = (score, j + 1)
            else:
                out.append((score, j + 1))
    return out


def edit_distance_within(a: Sequence[int], b: Sequence[int], most: int, masks: dict[int, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the best match of all of ``a`` with a substring of ``b``; distance above ``most`` counts as none."""
    return min(edit_matches(a, b, most, masks), default=(len(a) + 1, -1))


def verify(item: Item, doc: np.ndarray, met: Sequence[tuple[int, int]], widths: np.ndarray) -> bool:
    """Whether sentences that make up half of the passage stand in order within three passage lengths.

    met: sentences with the places where they would start. Those that prove right there are kept, wherever in the document that is;
    then the others are looked for within three lengths around every one of them.
    """
    words = doc.tolist()
    places: list[set[tuple[int, int]]] = [set() for _ in item.sentences]
    for k, p in met:
        s, slack = item.sentences[k], item.edits[k]
        if p >= 0 and words[p : p + len(s)] == s:
            places[k].add((p, p + len(s)))
            continue
        lo, hi = max(0, p - slack), max(0, p + len(s) + slack)
        if len(item.kinds[k].difference(words[lo:hi])) > slack:
            continue  # every kind of token that is missing costs an edit
        _, end = edit_distance_within(s, words[lo:hi], slack, item.masks[k])
        if end >= 0:
            places[k].add((lo + end - len(s), lo + end))
    if not any(places):
        return False
    offsets = np.concatenate([[0], np.cumsum(np.maximum(1, widths[doc]) + (0 if item.single else 1))])
    if _chained(item, offsets, places):
        return True
    reach = 3 * item.length
    near = np.array(sorted({a for ps in places for a, _ in ps}))
    stretches: list[list[int]] = []
    lows = np.searchsorted(offsets, offsets[np.maximum(0, near)] - reach)
    highs = np.searchsorted(offsets, offsets[np.maximum(0, near)] + reach, side="right")
    for lo, hi in zip(lows.tolist(), highs.tolist()):
        if stretches and lo <= stretches[-1][1]:
            stretches[-1][1] = max(hi, stretches[-1][1])
        else:
            stretches.append([lo, hi])
    total = sum(item.weights)
    for lo, hi in stretches:
        part = words[lo:hi]
        have = set(part)
        possible = [k for k, kinds in enumerate(item.kinds) if len(kinds - have) <= item.edits[k]]
        if 2 * sum(item.weights[k] for k in possible) < total:
            continue
        for k in possible:
            size = len(item.sentences[k])
            places[k] |= {(lo + end - size, lo + end) for _, end in edit_matches(item.sentences[k], part, item.edits[k], item.masks[k])}
    return _chained(item, offsets, places)


def _chained(item: Item, offsets: np.ndarray, places: Sequence[Iterable[tuple[int, int]]]) -> bool:
    """Whether found sentences of half the passage's weight (two at least, where it has several) follow each other within three lengths."""
    total = sum(item.weights)
    if 2 * sum(w for w, p in zip(item.weights, places) if p) < total:
        return False
    last = len(offsets) - 1
    spans = sorted((b, a, k) for k, ps in enumerate(places) for a, b in ps)
    needed = 2 if len(item.sentences) > 1 else 1
    for first in range(len(spans)):  # the heaviest chain in order whose stretch starts at this span
        start = offsets[min(last, max(0, spans[first][1]))]
        best: dict[int, tuple[int, int]] = {}
        for b, a, k in spans[first:]:
            if offsets[min(b, last)] - start > 3 * item.length:
                break  # spans are in order of their ends, so a stretch holds a bounded number of them
            if a < spans[first][1]:
                continue
            w, c = max(((w, c) for j, (w, c) in best.items() if j < k), default=(0, 0))
            if (w + item.weights[k], c + 1) > best.get(k, (0, 0)):
                best[k] = (w + item.weights[k], c + 1)
            if 2 * best[k][0] >= total and best[k][1] >= needed:
                return True
    return False


def find_in(index: Index, texts: Sequence[str]) -> list[tuple[int, int]]:
    """(text number, item number) of all leaks in ``texts``."""
    get = index.vocabulary.get
    parts, starts, at = [], [], 0
    pad = [0] * _PAD
    for t in texts:
        ids = [get(w, 0) for w in tokens(t)]
        starts.append(at)
        parts.append(np.array(ids + pad, np.int32))
        at += len(ids) + len(pad)
    if not parts:
        return []
    place, sentence = probe(index, np.concatenate(parts))
    if not len(place):
        return []
    item, number = index.sentences[sentence, :2].T
    text = np.searchsorted(np.array(starts), np.maximum(place, 0) + np.minimum(index.sentences[sentence, 3], _PAD) // 2, side="right") - 1
    place = place - np.array(starts)[text]
    order = np.lexsort((place, number, item, text))
    text, item, number, place = text[order], item[order], number[order], place[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0)])
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(text)]):
        k, i = int(text[a]), int(item[a])
        if verify(index.items[i], parts[k][: len(parts[k]) - len(pad)], list(zip(number[a:b].tolist(), place[a:b].tolist())), index.widths):
            out.append((k, i))
    return out


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str) -> DataFrame:
    """(doc key, item key) of every document that leaks an item.

    Null and empty texts or passages leak nothing; of repeated items and documents every pair is given; texts are read whole. A
    passage of several sentences needs two of them. Empty tables give an empty table. Further columns are not read.
    """
    batch_type = to_arrow_type(items.schema[item_key].dataType)
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    rows = items.select(F.col(item_key).alias("i"), F.col(passage).alias("p")).filter(F.length("p") > 0)
    blocks = max(1, -(-rows.count() // ITEMS_MOST))
    source = spread(docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))).filter(F.length("_text") > 0)
    out = None
    for n in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == n).orderBy("i", "p").collect()
        index = build_index([r["i"] for r in block], [r["p"] for r in block])

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                doc, item = [], []
                for lo in range(0, len(texts), 500):
                    for k, i in find_in(index, texts[lo : lo + 500]):
                        doc.append(lo + k)
                        item.append(index.ids[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(item, batch_type)], names=["_doc", "_item"])

        part = source.mapInArrow(run, f"_doc {key_type}, _item {item_type}")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("_doc").alias(key), F.col("_item").alias(item_key))
