"""Chunkers whose result depends on the order of pieces: prose, headings, tables. Each works inside one row, in Arrow batches.

Results for odd input: null, empty and blank texts give no chunks; repeated rows give repeated chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.session import spread

_BLANK_LINES = re.compile(r"\n\s*\n")
_SENTENCE_END = re.compile(r"(?<=[。.!?])\s*")
_RULE = re.compile(r"\|?[\s\-:|]+\|[\s\-:|]+\|?")
_HTML_HEADING = re.compile(r"<h([1-6])[^>]*>(.*?)</h\1>", re.IGNORECASE | re.DOTALL)
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
#: Labels of table chunks.
NAME_LABEL, CONTEXT_LABEL = "名前: ", "周辺行: "


def _stripped(parts: Iterable[str]) -> list[str]:
    return [p for p in map(str.strip, parts) if p]


class _Prose:
    """Greedy filling of chunks; the tail of each finished chunk opens the next one."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.done: list[str] = []
        self.open = self.tail = ""

    def close(self) -> None:
        if self.open:
            self.done.append(self.open)
            self.tail = self.open[-self.overlap :] if self.overlap else ""
            self.open = ""

    def after_tail(self, piece: str) -> str:
        return f"{self.tail} {piece}".strip() if self.tail else piece.strip()

    def take(self, piece: str) -> None:
        if len(piece) > self.size:
            self.close()
            self.divide(piece)
            return
        longer = f"{self.open}\n\n{piece}" if self.open else self.after_tail(piece)
        if len(longer) <= self.size:
            self.open = longer
            return
        self.close()
        self.open = self.after_tail(piece)
        if len(self.open) > self.size:  # the tail made it too long: a sliding window over both
            step = self.size - self.overlap
            windows = [self.open[i : i + self.size] for i in range(0, max(1, len(self.open) - self.overlap), step)]
            self.done += windows[:-1]
            self.open, self.tail = windows[-1], ""

    def divide(self, piece: str) -> None:
        """A piece above the size, by sentences or, where it is one sentence, by characters."""
        parts = _stripped(_SENTENCE_END.split(piece))
        if len(parts) == 1 and len(parts[0]) > self.size:
            width = self.size - self.overlap
            parts = [piece[i : i + width] for i in range(0, len(piece), width)]
        inner = _Prose(self.size, self.overlap)
        for p in parts:
            inner.take(p)
        inner.close()
        if not inner.done:
            return
        joined = f"{self.tail} {inner.done[0]}" if self.tail else inner.done[0]
        self.done += [joined if len(joined) <= self.size else inner.done[0], *inner.done[1:]]
        self.tail = inner.done[-1][-self.overlap :] if self.overlap else ""


def prose_chunks(text: str | None, size: int, overlap: int) -> list[str]:
    """Paragraphs merged up to ``size`` characters; longer ones are cut at sentences, then anywhere; ``overlap`` characters repeat."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap within 0 and size")
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    filling = _Prose(size, overlap)
    for p in _stripped(_BLANK_LINES.split(text)):
        filling.take(p)
    filling.close()
    return filling.done


def _lines_within(block: str, size: int) -> Iterator[str]:
    """A long block cut between lines, and inside lines that are too long themselves."""
    held: list[str] = []
    used = 0
    for line in block.split("\n"):
        if held and (len(line) > size or used + len(line) + 1 > size):
            yield "\n".join(held)
            held, used = [], 0
        if len(line) > size:
            yield from (line[i : i + size] for i in range(0, len(line), size))
        else:
            used += len(line) + (1 if held else 0)
            held.append(line)
    if held:
        yield "\n".join(held)


def _paragraphs_within(text: str, size: int) -> Iterator[str]:
    """Paragraphs merged up to ``size``. Each counts with the divider after it, but the one that opens a chunk after an overflow without."""
    held: list[str] = []
    used = 0
    for p in _stripped(_BLANK_LINES.split(text)):
        overflow = bool(held) and (len(p) > size or used + len(p) + 2 > size)
        if overflow:
            yield "\n\n".join(held)
            held, used = [], 0
        if len(p) > size:
            yield from _lines_within(p, max(1, size))
        else:
            used += len(p) if overflow else len(p) + 2
            held.append(p)
    if held:
        yield "\n\n".join(held)


def heading_chunks(text: str | None, most: int, least: int) -> list[tuple[str, int, str, str]]:
    """(heading, level, section path, content) of each section with content; longer sections are divided, short ones without heading join the one before."""
    text = _HTML_HEADING.sub(lambda m: "#" * int(m[1]) + " " + m[2].strip(), (text or "").strip())
    if not text:
        return []
    sections: list[tuple[str, int, str]] = []
    heading, level, lines = "", 0, []
    for line in text.split("\n"):
        m = _HEADING.match(line)
        if m:
            if lines or heading:
                sections.append((heading, level, "\n".join(lines).strip()))
            heading, level, lines = m[2].strip(), len(m[1]), []
        else:
            lines.append(line)
    if lines or heading:
        sections.append((heading, level, "\n".join(lines).strip()))
    if all(not h for h, _, _ in sections) and len(sections[0][2]) > most:
        return [("", 0, "", c) for c in _paragraphs_within(sections[0][2], most)]
    out: list[tuple[str, int, str, str]] = []
    above: list[tuple[int, str]] = []
    for heading, level, content in sections:
        above = [a for a in above if a[0] < level] if level else []
        path = " > ".join([h for _, h in above] + ([heading] if heading else []))
        if heading:
            above.append((level, heading))
        if len(content) > most:
            parts = list(_paragraphs_within(content, most))
            out += [(heading if i == 0 else "", level, path, p) for i, p in enumerate(parts)]
        elif content and (heading or not out or len(content) >= least):
            out.append((heading, level, path, content))
        elif content:
            joined = f"{out[-1][3]}\n\n{content}".strip()
            if len(joined) <= most:
                out[-1] = (*out[-1][:3], joined)
            else:
                out.append((heading, level, path, content))
    return out


def parse_table(text: str | None) -> tuple[list[str], list[list[str]]] | None:
    """(header, rows) of a piped, tabbed or spaced table, or None."""
    lines = _stripped((text or "").split("\n"))
    if len(lines) < 2:
        return None
    piped = [line for line in lines if line.count("|") >= 2]
    if piped:
        if len(piped) < 2:
            return None
        cells = [[c.strip() for c in line.removeprefix("|").removesuffix("|").split("|")] for line in piped]
        rules = [i for i, line in enumerate(piped) if _RULE.fullmatch(line)]
        at = rules[0] if rules else -1
        header, start = (cells[max(0, at - 1)], at + 1) if rules else (cells[0], 1)
        rows = [c for i, c in enumerate(cells) if i >= start and i not in rules and c]
        return header, rows
    divide = next((d for d in (r"\t", r"\s{2,}") if any(re.search(d, line) for line in lines[:3])), None)
    if divide is None:
        return None
    cut = [[c.strip() for c in line.split("\t")] if divide == r"\t" else _stripped(re.split(divide, line)) for line in lines]
    rows = [c for c in cut[1:] if len(c) >= 2]
    return (cut[0], rows) if cut[0] and rows else None


def table_chunks(text: str | None, around: int, most: int) -> list[tuple[str, str]]:
    """(entity, content) of each table row with its column names; the names of ``around`` rows on both sides follow where ``most`` allows.

    A row above ``most`` first loses its neighbours, then is divided between columns, each part naming the entity.
    """
    parsed = parse_table(text)
    if not parsed:
        return []
    header, rows = parsed
    out: list[tuple[str, str]] = []
    for i, row in enumerate(rows):
        name = row[0] if row else ""
        cells = [f"{header[k]}: {v}" if k < len(header) else v for k, v in enumerate(row)][1:]
        head = [NAME_LABEL + name] if name else []
        near = [r[0] if r else "" for k, r in enumerate(rows[max(0, i - around) : i + around + 1], max(0, i - around)) if k != i]
        short = "\n".join(head + ([", ".join(cells)] if cells else []))
        full = "\n".join([x for x in [short] if x] + ([CONTEXT_LABEL + ", ".join(near)] if near else []))
        if most <= 0 or len(full) <= most:
            out.append((name, full))
        elif len(short) <= most:
            out.append((name, short))
        else:
            first = "".join(head)
            first = first if len(first) < most else first[: most - 1]
            room = max(1, most - (len(first) + 1 if first else 0))
            part = 0
            used = 0
            labelled = []
            for c in (c[:room] for c in cells):
                if used and used + 2 + len(c) > room:
                    part, used = part + 1, 0
                used += len(c) + (2 if used else 0)
                labelled.append((part, c))
            for _, group in groupby(labelled, key=lambda x: x[0]):
                body = ", ".join(c for _, c in group)
                out.append((name, f"{first}\n{body}" if first else body))
            if not labelled:
                out.append((name, (first or ", ".join(row))[:most]))
    return out


def _table(text: str) -> bool:
    from_lines = text.strip().split("\n")
    if len(from_lines) < 2:
        return False
    if sum(line.count("|") >= 2 for line in from_lines) >= 2 and any(_RULE.fullmatch(line.strip()) for line in from_lines):
        return True
    cells = [re.split(r"\t|\s{2,}", line) for line in _stripped(from_lines)]
    wide = [c for c in cells if len(c) >= 3]
    numeric = [c for c in wide if 2 * sum(bool(re.match(r"^-?\d+\.?\d*$", re.sub("[¥$€£,円%]", "", x.strip()))) for x in c) >= len(c)]
    return len(cells) >= 2 and (len(wide) / len(cells) >= 0.3 or len(numeric) / len(cells) >= 0.2)


def routed_chunks(text: str | None, size: int, overlap: int, table_size: int, fall_back: bool) -> list[tuple[str, str, str]]:
    """(kind, section path, content): by the text's content type; blocks of a mixed text go their own ways.

    fall_back: prose chunks where the chosen way gives none (the evaluation's way; the index leaves such texts out).
    """
    if not (text or "").strip():
        return []
    text = text.strip()  # type: ignore[union-attr]
    headed = bool(re.search(r"^#{1,6}\s+.+", text, re.MULTILINE) or re.search(r"<h[1-6][^>]*>.*?</h[1-6]>", text, re.IGNORECASE))
    tabular = _table(text)
    out: list[tuple[str, str, str]] = []
    if headed and tabular:
        for heading, _, path, content in heading_chunks(text, max(len(text), 1), 0):
            inner = [("table", path, c) for _, c in table_chunks(content, 1, table_size)] if _table(content) else []
            out += inner or [("prose", path, c) for c in prose_chunks(content, size, overlap)]
    elif tabular:
        out = [("table", "", c) for _, c in table_chunks(text, 1, table_size)]
    elif headed:
        out = [("heading", path, f"{h}\n{c}" if h else c) for h, _, path, c in heading_chunks(text, size, size // 4)]
    else:
        out = [("prose", "", c) for c in prose_chunks(text, size, overlap)]
    if not out and fall_back:
        out = [("prose", "", c) for c in prose_chunks(text, size, overlap)]
    return out


def explode_rows(df: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """(key, position, *columns) of the rows that ``cut`` makes of each text, in Arrow batches."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, position int, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "bigint": pa.int64()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, position, cells = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, row in enumerate(cut(t)):
                    rows.append(i)
                    position.append(n)
                    cells.append(row)
            columns_ = list(zip(*cells)) if cells else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(position, pa.int32()), *(pa.array(list(c), t) for c, t in zip(columns_, types))], names=[key, "position", *names]
            )

    return spread(df.select(key, text)).filter(F.col(text).isNotNull()).mapInArrow(run, schema)
