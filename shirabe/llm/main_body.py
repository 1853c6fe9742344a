"""The main body of web pages, line by line: flat text blocks classified by a decision tree.

Every line with text is a block, described by its word count, link density and form, by those of its neighbours, and by where it lies
between the page's links, headings, long sentences and template lines. A template line is one whose form (names and numbers left out)
stands on many pages of the same collection; no text of any page is stored with the operator. The tree is learned from a small
labelled table of such descriptions.

Costs at scale: one pass over the pages that counts line forms (the hashes of different pages, combined before each of its two exchanges) and one that classifies each
page within its own row. What is sent to the executors is bounded: at most 1 / SHARE_LEAST line forms can be that common.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.session import spread

#: The least share of all lines at which a line form counts as known; so there are at most 1 / SHARE_LEAST of them.
SHARE_LEAST = 1e-5
#: The share, in powers of ten above SHARE_LEAST, from which a line counts as a template line.
TEMPLATE = 1.7

_SILENT = re.compile(r"<(script|style|title)\b[^>]*>.*?(?:</\1>|$)", re.DOTALL)
_TAG = re.compile(r"</?[a-zA-Z!][^>]*>")
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)(?:</a>|$)")
_MARK_LINK = re.compile(r"!?\[([^\]]*)\]\([^)\s]*\)")
_LEAD = re.compile(r"^(?:#{1,6}\s+|[-*+•・‣]\s*|\d{1,3}[.)]\s+)")
_CODE = re.compile(r"^(?:    |\t|def |return |import |class |for |if |\}|\{)")
_HEAD = re.compile(r"<h([1-6])\b")
_FIRST_TAG = re.compile(r"<([a-z]+)")
_DIGIT = re.compile(r"\d")
_CAPITAL = re.compile(r"\b[A-Z][a-z]+\b")
_DIVIDED = re.compile(r" [›>»·|/–—-] ")
_TAGS = {"p": 1, "li": 2, "div": 3, "span": 4, "a": 5, "b": 6, "td": 7, "tr": 7, "pre": 8, "section": 9}
_ENDS = ".!?。！？…♪」』”\"）)"

#: What a block says of itself. share: how common its form is, in powers of ten above SHARE_LEAST.
OWN = ("words", "links", "sentence", "code", "bullet", "classed", "heading", "table", "tag", "digits", "capitals", "colon", "divided", "stops", "commas")
_NEAR = ("words", "links", "sentence", "bullet", "classed", "heading", "table", "tag", "share")
_AT_TEMPLATE = ("words", "links", "sentence", "heading", "share")


def block_of(raw: str) -> tuple | None:
    """What a line says of itself, in order of OWN, or None for a blank line or one of markup alone (scripts, styles and the title element count as markup)."""
    text = raw.rstrip()
    if not text:
        return None
    classed, heading, table, linked, bullet, tag = 0, 0, 0, 0, 0, 0
    code = 1 if _CODE.match(text) else 0
    if "<" in text:
        first = _FIRST_TAG.search(text)
        tag = _TAGS.get(first[1], 10) if first else 0
        if "<s" in text or "<t" in text:
            text = _SILENT.sub("", text)
        if "<a" in text:
            linked = sum(len(_TAG.sub("", a)) for a in _ANCHOR.findall(text))
        h = _HEAD.search(text)
        heading = int(h[1]) if h else (7 if text.startswith("<b>") else 0)
        table = 1 if "<td" in text or "<tr" in text else 0
        bullet = 1 if text.startswith("<li") else 0
        classed = 1 if " class=" in text else 0
        text = _TAG.sub(" ", text)
    if "](" in text:
        linked += sum(map(len, _MARK_LINK.findall(text)))
        text = _MARK_LINK.sub(r"\1", text)
    if "&" in text:
        text = html.unescape(text)
    text = text.strip()
    lead = _LEAD.match(text)
    if lead:
        if text[0] == "#":
            heading = heading or lead.end() - 1
        else:
            bullet = 1
        text = text[lead.end() :].strip()
    text = text.strip("*_` \t")
    if not text:
        return None
    if not table and text.count(" | ") + text.count("\t") >= 2:
        table = 1
    size = len(text)
    words = len(text.split()) if text.isascii() else max(1, size // 2)
    colon = text.find(":")
    if colon < 0:
        colon = text.find("：")
    return (
        words, min(1.0, linked / size), 1 if text[-1] in _ENDS else 0, code, bullet, classed, heading, table, tag,
        len(_DIGIT.findall(text)) / size, len(_CAPITAL.findall(text)) / words, 1 if 0 <= colon < 40 else 0, len(_DIVIDED.findall(text)),
        sum(map(text.count, ".!?。！？")), text.count(",") + text.count("、"),
    )


def describe(own: np.ndarray, line: np.ndarray, share: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The feature rows of the blocks of many pages at once, ``page`` ascending: of each block itself, of its neighbours up to two away,
    of the stretch around it, and of the way to the nearest links, headings, long sentences, gaps and template lines of its own page."""
    n = len(own)
    if not n:
        return np.zeros((0, 1), np.float32)
    at = np.arange(n)
    first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    lo = np.repeat(first, np.diff(np.r_[first, n]))  # the page's first block, and the place after its last
    hi = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    own = own.astype(np.float32)
    share = share.astype(np.float32)
    both = np.c_[own, share]
    pick = [([*OWN, "share"]).index(k) for k in _NEAR]
    out = [both, np.where(at > lo, line - np.r_[0, line[:-1]], 10)[:, None] - 1, np.where(at + 1 < hi, np.r_[line[1:], 0] - line, 10)[:, None] - 1]
    for off in (-2, -1, 1, 2):
        to = at + off
        inside = (to >= lo) & (to < hi)
        out.append(np.where(inside[:, None], both[np.clip(to, 0, n - 1)][:, pick], 0))
    words, links = own[:, 0].astype(np.float64), own[:, 1].astype(np.float64)
    every, linked = np.r_[0.0, np.cumsum(words)], np.r_[0.0, np.cumsum(words * links)]
    for r in (3, 6):
        a, b = np.maximum(lo, at - r), np.minimum(hi, at + r + 1)
        out += [((linked[b] - linked[a]) / np.maximum(1, every[b] - every[a]))[:, None], ((every[b] - every[a]) / (b - a))[:, None]]
    before, after, total = every[at] - every[lo], every[hi] - every[at], np.maximum(1, every[hi] - every[lo])
    out.append(
        np.c_[
            before / total, (linked[at + 1] - linked[lo]) / np.maximum(1, every[at + 1] - every[lo]), (linked[hi] - linked[at]) / np.maximum(1, after),
            np.minimum(at - lo, 99), np.minimum(hi - at, 99),
        ]
    )
    gap = out[1][:, 0] > 0

    def ways(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The last flagged block before, the next after (or -1, n outside the page), and how many there are up to here and after."""
        prior = np.r_[-1, np.maximum.accumulate(np.where(flag, at, -1))[:-1]]
        later = np.r_[np.minimum.accumulate(np.where(flag, at, n)[::-1])[::-1][1:], n]
        count = np.r_[0, np.cumsum(flag)]
        return np.where(prior >= lo, prior, -1), np.where(later < hi, later, n), count[at + 1] - count[lo], count[hi] - count[at + 1]

    for flag in (links > 0.5, own[:, 6] > 0, (words >= 12) & (links < 0.3) & (own[:, 2] > 0), gap):
        prior, later, so_far, left = ways(flag)
        out.append(np.c_[np.where(prior < 0, 99, np.minimum(99, at - prior)), np.where(later == n, 99, np.minimum(99, later - at)), np.minimum(so_far, 99), np.minimum(left, 99)])
    template = share > TEMPLATE
    prior, later, so_far, left = ways(template)
    own_text = np.r_[0.0, np.cumsum(words * (links < 0.5) * ~template)]  # words outside links and template lines
    told = np.vstack([both[:, [([*OWN, "share"]).index(k) for k in _AT_TEMPLATE]], np.zeros((1, len(_AT_TEMPLATE)), np.float32)])
    p, q = np.where(prior < 0, lo, prior), np.minimum(later, hi - 1)
    out += [told[np.where(prior < 0, n, prior)], told[later]]
    out.append(
        np.c_[
            np.where(prior < 0, 99, np.minimum(99, at - prior)), np.where(later == n, 99, np.minimum(99, later - at)),
            own_text[at] - own_text[lo], own_text[hi] - own_text[at], own_text[p] - own_text[lo], own_text[hi] - own_text[q], own_text[at] - own_text[p],
            np.minimum(so_far, 99), np.minimum(left, 99),
        ]
    )
    return np.concatenate(out, axis=1).astype(np.float32)


class Tree:
    """A binary decision tree (Gini), as arrays; grown on a small table in memory."""

    def __init__(self, depth: int = 14, least: int = 3):
        self.depth, self.least = depth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y.astype(np.float64), np.arange(len(y)), 0)
        for name, kind in (("feature", np.int32), ("threshold", np.float32), ("left", np.int32), ("right", np.int32), ("value", np.float32)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int) -> int:
        node = len(self.feature)
        share = float(y[rows].mean()) if len(rows) else 0.0
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, node), (self.right, node), (self.value, share)):
            a.append(v)
        if depth >= self.depth or len(rows) < 2 * self.least or share in (0.0, 1.0):
            return node
        best = (share * (1 - share) * len(rows) - 1e-6, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows[order], f], np.cumsum(y[rows[order]])
            n = np.arange(1, len(rows) + 1)
            cut = np.flatnonzero(v[1:] != v[:-1])
            cut = cut[(n[cut] >= self.least) & (len(rows) - n[cut] >= self.least)]
            if not len(cut):
                continue
            a, b = t[cut], t[-1] - t[cut]
            loss = a * (1 - a / n[cut]) + b * (1 - b / (len(rows) - n[cut]))
            i = int(loss.argmin())
            if loss[i] < best[0]:
                best = (float(loss[i]), f, float(v[cut[i]] + v[cut[i] + 1]) / 2)
        if best[1] < 0:
            return node
        goes = x[rows, best[1]] <= best[2]
        self.feature[node], self.threshold[node] = best[1], best[2]
        self.left[node] = self._grow(x, y, rows[goes], depth + 1)
        self.right[node] = self._grow(x, y, rows[~goes], depth + 1)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int32)
        for _ in range(self.depth + 1):
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            go = x[inner, f[inner]] <= self.threshold[at[inner]]
            at[inner] = np.where(go, self.left[at[inner]], self.right[at[inner]])
        return self.value[at] >= 0.5


def labelled_table() -> dict[str, np.ndarray]:
    """The labelled lines that come with the package, as columns: site, page, line, body (the label), share, and those of OWN. No text."""
    with resources.files("shirabe.llm").joinpath("resources/labelled_lines.parquet").open("rb") as f:
        table = pq.read_table(f)
    return {c: table[c].to_numpy() for c in table.column_names}


def learn(rows: dict[str, np.ndarray], shares: bool = True) -> Tree:
    """The tree from labelled lines, in order of their pages. Without ``shares`` every line counts as unknown to other pages."""
    own = np.stack([rows[c] for c in OWN], axis=1)
    return Tree().fit(describe(own, rows["line"], rows["share"] if shares else np.zeros(len(own)), rows["page"]), rows["body"])


def line_forms(body: Column) -> Column:
    """A hash for the form of each line: its text without markup, names and numbers. 0 for a line without text. JVM only."""
    plain = lambda t: F.regexp_replace(t, r"<[^>]*>|\]\([^)\s]*\)|^[#*\-+•・‣\[\s]+|[*_`\s]+$", "")
    form = lambda t: F.trim(F.regexp_replace(F.regexp_replace(plain(t), r"[0-9]+", "0"), r"\b[A-Z][a-z]+\b", "W"))
    return F.transform(F.transform(F.split(body, "\n"), form), lambda t: F.when(t == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(t)))


def common_forms(pages: DataFrame, body: str) -> dict[int, float]:
    """How common each line form is that stands on many pages: the pages besides one, over all lines, in powers of ten above SHARE_LEAST.

    Copies of one page, but for names and numbers, count once, so that a page that is copied often does not look like a template. The
    counts of all forms at or above SHARE_LEAST add up to no more than all lines, so at most 1 / SHARE_LEAST forms reach the driver.
    """
    texts = spread(pages.select(F.col(body).alias("b"))).filter(F.length("b") > 0)
    lines = texts.agg(F.sum(F.length("b") - F.length(F.replace("b", F.lit("\n"))) + 1).alias("n")).first()["n"] or 0
    once = texts.select(F.array_distinct(line_forms(F.col("b"))).alias("f")).withColumn("d", F.xxhash64("f")).dropDuplicates(["d"])
    forms = once.select(F.explode("f").alias("h")).filter(F.col("h") != 0).groupBy("h").agg((F.count(F.lit(1)) - 1).alias("n"))
    found = forms.filter(F.col("n") >= max(1.0, SHARE_LEAST * lines)).toArrow()
    return dict(zip(found["h"].to_pylist(), (np.log10(found["n"].to_numpy() / max(1, lines)) - np.log10(SHARE_LEAST)).tolist()))


def main_lines(pages: DataFrame, key: str, body: str, log: DataFrame, log_key: str, status: str) -> DataFrame:
    """(key, lines): the numbers, from 0, of the main-body lines of each page that has any.

    Lines are what lies between line feeds; blank lines and lines of markup alone are never part. A page that the log names only with
    other status than 200 has no body; one that the log does not name counts as 200. Null and empty bodies have none. Repeated rows
    give repeated results; empty tables give an empty table; further columns are not read.
    """
    tree = learn(labelled_table())
    shares = common_forms(pages, body)
    key_type = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shares.get
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                own, line, share, page = [], [], [], []
                for k, (text, forms) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for i, raw in enumerate(text.split("\n")):
                        b = block_of(raw)
                        if b is not None:
                            own.append(b)
                            line.append(i)
                            page.append(k)
                            share.append(known(forms[i], 0.0))
                if not own:
                    continue
                page_of, line_of = np.array(page), np.array(line)
                good = tree.predict(describe(np.array(own), line_of, np.array(share), page_of))
                row, line_of = page_of[good], line_of[good]
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(line_of, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[first], pa.int64())), lists], names=[key, "lines"])

    texts = spread(pages.select(F.col(key), F.col(body).alias("_body"))).filter(F.length("_body") > 0)
    found = texts.select(key, "_body", line_forms(F.col("_body")).alias("_forms")).mapInArrow(run, f"`{key}` {key_type}, lines array<bigint>")
    failed = log.filter(F.col(log_key).isNotNull()).groupBy(F.col(log_key).alias(key)).agg(F.max(F.coalesce(F.col(status) == 200, F.lit(False))).alias("_fine")).filter(~F.col("_fine"))
    return found.join(failed.select(key), key, "left_anti")


def judge(tree: Tree, body: str, shares: Sequence[float]) -> list[int]:
    """The main-body lines of one page, given how common each of its lines is."""
    blocks = [(i, b) for i, b in enumerate(map(block_of, body.split("\n"))) if b is not None]
    if not blocks:
        return []
    line = np.array([i for i, _ in blocks])
    good = tree.predict(describe(np.array([b for _, b in blocks]), line, np.array([shares[i] for i in line]), np.zeros(len(blocks), np.int64)))
    return line[good].tolist()
