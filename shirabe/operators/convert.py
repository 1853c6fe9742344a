"""Conversion of source files to text by their kind, with a status for each, and the rules that pages of a host follow."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.operators.html_markdown import convert as html_text
from shirabe.operators.html_markdown import selector
from shirabe.operators.transcripts import merge
from shirabe.sources.files import slides_text

#: Endings of files that are text already, and of those that are converted.
PLAIN = ("md", "txt", "adoc")
PAGES = ("html", "htm", "xhtml")
SLIDES = ("pptx", "ppsx")
RULE_KEYS = frozenset(("content", "remove"))


def site_rules(text: str) -> dict[str, dict[str, list[str]]]:
    """host -> {content, remove}: selectors from TOML. Other keys, blank entries and unreadable selectors are errors."""
    out = {}
    for host, rule in tomllib.loads(text).items():
        if not isinstance(rule, dict) or set(rule) - RULE_KEYS:
            raise ValueError(f"unknown rule for {host}")
        for selectors in rule.values():
            if not isinstance(selectors, list) or any(not isinstance(s, str) or not s.strip() for s in selectors):
                raise ValueError(f"blank selector for {host}")
            for s in selectors:
                selector(s)  # an unreadable one is an error here, not a page without its rule
        out[host] = rule
    return out


def decoded(raw: bytes) -> str:
    """Bytes as text: by a declared charset within the first 2048 bytes (Shift_JIS in its wider form), else UTF-8, else that form."""
    m = re.search(rb"charset\s*=\s*[\"']?\s*([\w-]+)", raw[:2048], re.IGNORECASE)
    name = m[1].decode("ascii").lower() if m else ""
    if name in ("shift_jis", "shift-jis", "sjis", "x-sjis", "windows-31j", "ms932"):
        name = "cp932"
    for encoding in (name, "utf-8", "cp932"):
        if encoding:
            try:
                return raw.decode(encoding, "strict")
            except (LookupError, UnicodeDecodeError):
                continue
    return raw.decode("cp932", "replace")


def repaired(text: str) -> str:
    """A form value that was read as Latin-1: as UTF-8 where its bytes are, else as Japanese where that gives Japanese, else as it was."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        other = raw.decode("cp932")
    except UnicodeDecodeError:
        return text
    return other if re.search("[぀-ヿ一-鿿]", other) else text


def record_text(data: Mapping) -> str:
    """A JSON record as Markdown: a blog article under its title, a scrap's comments divided by rules, a transcript in timed paragraphs."""
    if "article" in data:
        a = data["article"] or {}
        body = html_text(a.get("body_html"))
        return f"# {a['title']}\n\n{body}" if a.get("title") and body else body
    if "scrap" in data:
        s = data["scrap"] or {}
        parts = [t for t in (html_text((c or {}).get("body_html")) for c in s.get("comments") or []) if t]
        body = "\n\n---\n\n".join(parts)
        return f"# {s['title']}\n\n{body}" if s.get("title") and body else body
    if "snippets" in data:
        rows = [(_number(x.get("start")), _number(x.get("end")), x.get("text")) for x in data["snippets"] or [] if isinstance(x, dict)]
        hours = (_number(data.get("duration")) or 0) >= 3600

        def clock(s: float) -> str:
            t = int(s)
            return f"[{t // 3600}:{t % 3600 // 60:02d}:{t % 60:02d}]" if hours else f"[{t // 60:02d}:{t % 60:02d}]"

        return "\n\n".join(f"{clock(s)} {t}" for s, t in merge(rows))
    return ""


def _number(v: object) -> float | None:
    try:
        return float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def file_text(path: str, raw: bytes | None, rules: Mapping[str, Mapping[str, list[str]]]) -> tuple[str, str | None, str]:
    """(status, text, message) of one file: ok, skipped (nothing to convert) or failed (broken)."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if not raw:
        return "skipped", None, "empty"
    try:
        if ending in PLAIN:
            text = decoded(raw)
            return ("ok", text, "") if text.strip() else ("skipped", None, "blank")
        if ending in PAGES:
            host = path.split("/")[2] if path.startswith("web/") and path.count("/") > 2 else ""
            rule = rules.get(host, {})
            text = html_text(decoded(raw), rule.get("content", ()), rule.get("remove", ()))
        elif ending in SLIDES:
            text = slides_text(raw)
        elif ending == "json":
            data = json.loads(decoded(raw))
            text = record_text(data) if isinstance(data, dict) else ""
        else:
            return "skipped", None, "unsupported"
    except Exception as e:  # noqa: BLE001  a broken file must not end the job; it is reported in its row
        return "failed", None, f"{type(e).__name__}: {e}"[:200]
    return ("ok", text, "") if text.strip() else ("skipped", None, "no text")


def convert_files(files: DataFrame, path: str, content: str, rules: Mapping[str, Mapping[str, list[str]]] | None = None) -> DataFrame:
    """(path, status, text, message, size_bytes) of files held as bytes. Text files pass as they are; the others become Markdown."""
    rules = dict(rules or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [file_text(p or "", c, rules) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            status, text, message = zip(*done) if done else ((), (), ())
            size = pa.array([len(t.encode()) if t else 0 for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status, pa.string()), pa.array(text, pa.string()), pa.array(message, pa.string()), size], names=[path, "status", "text", "message", "size_bytes"])

    return files.select(path, content).mapInArrow(run, f"`{path}` string, status string, text string, message string, size_bytes bigint")


def due(files: DataFrame, converted: DataFrame | None, path: str, option: str = "if_modified", modified: str = "modified_at") -> DataFrame:
    """The files to convert: all (``force``), those not yet converted (``skip``), or also those changed since (``if_modified``)."""
    if option not in ("force", "skip", "if_modified"):
        raise ValueError(option)
    if option == "force" or converted is None:
        return files
    done = converted.select(F.col(path), F.col(modified).alias("_done")).groupBy(path).agg(F.max("_done").alias("_done"))
    left = files.join(done, path, "left")
    keep = F.col("_done").isNull() if option == "skip" else F.col("_done").isNull() | (F.col(modified) > F.col("_done"))
    return left.filter(keep).drop("_done")
