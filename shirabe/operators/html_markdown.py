"""HTML to Markdown on the standard library's parser: the content area is chosen, boilerplate elements dropped, the rest written as text.

The area is the first that exists of: host rules, ``article``, ``main``, ``role=main``, telling ids, telling classes, the densest child
of the body that has children, the body. Headings become ``#`` lines, links their text, images their alt text, ruby ``base(reading)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.session import spread

#: Elements without content, elements that are never content, and those that the densest child may not be.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(("script", "style", "noscript", "form"))
NOT_DENSE = frozenset(("script", "style", "nav", "noscript", "link"))
#: Parts of ids and of classes that tell the content area, in order of rank, and classes that are dropped from it.
CONTENT_IDS = ("main-content", "main_content", "content-wrap", "content_wrap", "page-container", "page_container", "main-body", "main_body", "content", "main")
CONTENT_CLASSES = ("main-content", "main_content", "main_text", "main-text", "content-wrap", "content_wrap", "page-container", "page_container")
DROPPED_CLASSES = frozenset(("breadcrumb", "breadcrumbs", "topic-path", "nextprev", "pagination", "toolbar", "footer-wrapper", "footer", "scrolltofeedback", "suggest"))
_BLOCK = frozenset("p div section article main header footer aside nav ul ol table blockquote pre figure tr h1 h2 h3 h4 h5 h6 li dl dt dd hr body html details summary".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Node:
    """An element: tag, attributes, children (nodes and strings)."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: Mapping[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, dict(attrs or {}), []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").lower().split()

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in DROPPED:
                stack += reversed(n.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = _CLOSES.get(tag, {"p"} if tag in _BLOCK else set())
        while len(self.open) > 1 and self.open[-1].tag in closes:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|[#]([\w-]+)|[.]([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([\w-]+)))?\s*\]""")
_COMPOUND = re.compile(r"""\s*(>?)\s*((?:[^\s>,\["']|\[(?:[^\]"']|"[^"]*"|'[^']*')*\])+)""")


def selector(text: str) -> list[list[tuple[str, list[tuple[str, str, str]]]]]:
    """A CSS selector read: alternatives, each a list of (combinator, tests) from left to right. Tags, ids, classes and attributes in any
    combination, descendants and children, comma lists. Anything else is a ValueError."""
    out = []
    for part in text.split(","):
        chain, at = [], 0
        part = part.strip()
        while at < len(part):
            m = _COMPOUND.match(part, at)
            if not m:
                raise ValueError(f"unreadable selector {text!r}")
            tests, pos = [], 0
            while pos < len(m[2]):
                t = _SIMPLE.match(m[2], pos)
                if not t or (t[1] and pos):
                    raise ValueError(f"unreadable selector {text!r}")
                if t[1]:
                    tests.append(("tag", t[1].lower(), ""))
                elif t[2]:
                    tests.append(("id", t[2], ""))
                elif t[3]:
                    tests.append(("class", t[3].lower(), ""))
                else:
                    tests.append((t[5] or "has", t[4].lower(), t[6] if t[6] is not None else t[7] if t[7] is not None else t[8] or ""))
                pos = t.end()
            chain.append((m[1] or " ", tests))
            at = m.end()
        if not chain or chain[0][0] == ">":
            raise ValueError(f"unreadable selector {text!r}")
        out.append(chain)
    return out


def _passes(node: Node, tests: list[tuple[str, str, str]]) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            good = name in ("*", node.tag)
        elif kind == "id":
            good = node.attrs.get("id") == name
        elif kind == "class":
            good = name in node.classes()
        else:
            own = node.attrs.get(name)
            good = own is not None and (
                kind == "has" or kind == "=" and own == value or kind == "~=" and value in own.split() or kind == "|=" and (own == value or own.startswith(value + "-"))
                or bool(value) and (kind == "^=" and own.startswith(value) or kind == "$=" and own.endswith(value) or kind == "*=" and value in own)
            )
        if not good:
            return False
    return True


def matching(root: Node, text: str) -> list[Node]:
    """The elements under ``root`` that a selector names, in document order."""
    named: set[int] = set()
    for chain in selector(text):
        # for each element: after how many compounds a match may go on below it (any depth, or its children alone)
        stack: list[tuple[Node, frozenset[int], frozenset[int]]] = [(root, frozenset([0]), frozenset([0]))]
        while stack:
            node, deep, direct = stack.pop()
            reached = {i + 1 for i, (how, tests) in enumerate(chain) if i in (deep if how == " " else direct) and _passes(node, tests)}
            if len(chain) in reached:
                named.add(id(node))
            below = deep | reached
            stack += [(c, below, frozenset(reached)) for c in node.children if isinstance(c, Node)]
    return [n for n in root.walk() if id(n) in named]


def content_area(root: Node, selectors: Sequence[str] = ()) -> Node:
    nodes = list(root.walk())
    body = next((n for n in nodes if n.tag == "body"), root)
    first = lambda test: next((n for n in nodes if test(n)), None)
    for s in selectors:  # the first element of a selector counts, and where that is empty the next selector
        found = next(iter(matching(root, s)), None)
        if found and found.text().strip():
            return found
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main"):
        found = first(test)
        if found:
            return found
    for part in CONTENT_IDS:
        found = first(lambda n: part in n.attrs.get("id", "").lower() and n.text().strip())  # noqa: B023
        if found:
            return found
    for part in CONTENT_CLASSES:
        found = first(lambda n: any(part in c for c in n.classes()) and n.text().strip())  # noqa: B023
        if found:
            return found
    boxes = [c for c in body.children if isinstance(c, Node) and c.tag not in NOT_DENSE and any(isinstance(x, Node) for x in c.children)]
    return max(boxes, key=lambda n: len(n.text().strip())) if boxes else body


def markdown(node: Node, removed: Sequence[str] = (), level: int = 0) -> str:
    """The Markdown of an element, however deeply it is nested. Lists more than 40 levels deep are written as plain blocks."""
    out: list[str] = []
    gone = {id(n) for s in removed for n in matching(node, s)}

    def gap(lines: int = 2) -> None:
        while out and out[-1].strip(" \t") == "":
            out.pop()
        if out:
            out[-1] = out[-1].rstrip(" \t")
            held = len(out[-1]) - len(out[-1].rstrip("\n"))
            out.append("\n" * max(0, lines - held))

    stack: list = list(reversed(node.children))  # what is still to be written: texts, elements, and gaps after blocks
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(re.sub(r"\s+", " ", n))
            continue
        if not isinstance(n, Node):
            n()
            continue
        if n.tag in DROPPED or n.tag == "head" or id(n) in gone or any(c in DROPPED_CLASSES for c in n.classes()):
            continue
        if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            gap()
            out.append("#" * int(n.tag[1]) + " " + re.sub(r"\s+", " ", n.text()).strip())
            gap()
        elif n.tag == "br":
            out.append("\n")
        elif n.tag == "img":
            out.append(n.attrs.get("alt", ""))
        elif n.tag == "pre":
            gap()
            out.append("```\n" + n.text().strip("\n") + "\n```")
            gap()
        elif n.tag in ("ul", "ol") and level < 40:
            gap()
            items = [c for c in n.children if isinstance(c, Node) and c.tag == "li" and id(c) not in gone]
            for i, item in enumerate(items):
                out.append((f"{i + 1}. " if n.tag == "ol" else "- ") + re.sub(r"\s+", " ", markdown(item, removed, level + 1)).strip())
                out.append("\n")
            gap()
        elif n.tag == "table":
            gap()
            rows = [[re.sub(r"\s+", " ", c.text()).strip() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            for i, r in enumerate(rows):
                out.append("| " + " | ".join(r) + " |\n" + ("|" + "---|" * len(r) + "\n" if i == 0 else ""))
            gap()
        elif n.tag == "ruby":
            reading = "".join(c.text() for c in n.children if isinstance(c, Node) and c.tag == "rt").strip()
            base = "".join(c if isinstance(c, str) else c.text() if c.tag not in ("rt", "rp") else "" for c in n.children).strip()
            out.append(f"{base}({reading})" if reading else base)
        elif n.tag == "hr":
            gap()
            out.append("---")
            gap()
        else:
            if n.tag in _BLOCK:
                gap()
                stack.append(gap)
            stack += reversed(n.children)
    text = "".join(out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.MULTILINE)).strip()


def convert(html: str | None, selectors: Sequence[str] = (), removed: Sequence[str] = ()) -> str:
    return markdown(content_area(parse(html), selectors), removed) if html else ""


def html_to_markdown(df: DataFrame, key: str, html: str, rules: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> DataFrame:
    """(key, status, text): ``ok``, or ``skipped`` where nothing is left. rules: host -> {content, remove} selectors; the host is the key's first segment.

    Null and empty pages are skipped; unclosed and unknown elements are read as far as they go.
    """
    rules = {h: {k: list(v) for k, v in r.items()} for h, r in (rules or {}).items()}
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rule = rules.get(str(k).split("/", 1)[0], {})
                texts.append(convert(h, rule.get("content", ()), rule.get("remove", ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["ok" if t else "skipped" for t in texts]), pa.array(texts)], names=[key, "status", "text"])

    return spread(df.select(F.col(key), F.col(html))).mapInArrow(run, f"`{key}` {kind}, status string, text string")
