"""Readers of file trees: source files with sidecars, crawl logs, feed pages, catalogues in CSV, presentations."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions.paths import is_source_file, source_type

CRAWL_SCHEMA = "url string, title string, status bigint, depth bigint, collected_at string, filepath string, _bad string"


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, source_type, content, content_hash, file_size, meta): every independent source under ``root``, its sidecar's text beside it.

    Sidecars, attachments, lock and system files are no sources. A source without sidecar has null meta.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    named = files.select(rel.alias("source_id"), "content", F.col("length").alias("file_size"))
    meta = named.filter(F.col("source_id").endswith(".meta")).select(F.regexp_replace("source_id", r"\.meta$", "").alias("source_id"), F.decode("content", "UTF-8").alias("meta"))
    own = named.filter(is_source_file(F.col("source_id")))
    return own.join(meta, "source_id", "left").select("source_id", source_type(F.col("source_id")).alias("source_type"), "content", F.sha2("content", 256).alias("content_hash"), "file_size", "meta")


def _scalar(v: str) -> str:
    v = v.strip()
    if len(v) >= 2 and v[0] == v[-1] and v[0] in "'\"":
        return v[1:-1]
    return "" if v in ("null", "~") else v


def sidecar_fields(text: str) -> dict[str, str]:
    """The top-level ``key: value`` pairs of a sidecar; list values are joined by commas. Anything but a mapping is an error."""
    out: dict[str, str] = {}
    key = ""
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.match(r"^([\w$-]+):(?:\s+(.*))?$", line)
        if m:
            key = m[1]
            out[key] = _scalar(m[2] or "")
        elif re.match(r"^\s*-\s+", line) and key:
            out[key] = ",".join(x for x in (out[key], _scalar(line.strip()[1:])) if x)
        elif not line.startswith((" ", "\t")):
            raise ValueError("a sidecar holds a mapping")
    return out


def sidecar_text(fields: Mapping[str, object]) -> str:
    """A sidecar that ``sidecar_fields`` reads back: one ``key: value`` a line in order, lists with an item a line; nulls are left out."""
    out = []
    for k, v in fields.items():
        if not re.fullmatch(r"[\w$-]+", k):
            raise ValueError(f"not a key: {k!r}")
        if isinstance(v, (list, tuple)):
            out += [f"{k}:", *(f"  - {_quoted(x)}" for x in v)]
        elif v is not None:
            out.append(f"{k}: {_quoted(v)}")
    return "\n".join(out) + "\n" if out else ""


def _quoted(v: object) -> str:
    s = v.isoformat() if hasattr(v, "isoformat") else str(v)
    if "\n" in s or "\r" in s:
        raise ValueError("a value holds one line")
    plain = s == s.strip() and s not in ("", "null", "~") and not s.startswith(("'", '"', "-", "#"))
    return s if plain else f'"{s}"'


def sidecars(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fields map, error): the fields of each sidecar; an unreadable one has an error instead."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, errors = [], []
            for t in b.column(1).to_pylist():
                try:
                    fields.append(list(sidecar_fields(t or "").items()))
                    errors.append(None)
                except ValueError as e:
                    fields.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())], names=[key, "fields", "error"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fields map<string,string>, error string")


def crawl_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of a crawl log in JSON lines.

    Blank lines are ignored; a line that is no JSON object or lacks url, title or collected_at is rejected. Missing status is 200, depth 0, filepath empty.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", CRAWL_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    fine = F.col("r").isNotNull() & F.col("r._bad").isNull() & F.col("r.url").isNotNull() & F.col("r.title").isNotNull() & F.col("r.collected_at").isNotNull()
    good = parsed.filter(fine).select("r.url", "r.title", F.coalesce("r.status", F.lit(200)).alias("status"), F.coalesce("r.depth", F.lit(0)).alias("depth"), "r.collected_at", F.coalesce("r.filepath", F.lit("")).alias("filepath"))
    return good, parsed.filter(~F.coalesce(fine, F.lit(False))).select("value")


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue of works in CSV with a header, every column as text."""
    return spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)


def search_catalogue(works: DataFrame, key: str, author: str | None, title: str | None, author_column: str, title_column: str, limit: int) -> DataFrame:
    """The first ``limit`` works (by key; at most 2000) whose author and title hold the given parts."""
    for column, part in ((author_column, author), (title_column, title)):
        if part:
            works = works.filter(F.col(column).contains(part))
    return works.orderBy(key).limit(checked_limit(limit, 2000))


def checked_limit(n: int, most: int) -> int:
    """``n`` within 1..most: above is clamped, zero and below is an error, as is anything but a whole number."""
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("a limit is a whole number")
    if n <= 0:
        raise ValueError("a limit is positive")
    return min(n, most)


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def slides_text(content: bytes) -> str:
    """The text of a presentation: ``## Slide N: title``, its shapes, tables as Markdown, and its notes."""

    def lines(element: ElementTree.Element) -> str:
        return "\n".join(x for x in ("".join(t.text or "" for t in p.iter(_A + "t")) for p in element.iter(_A + "p")) if x.strip())

    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in names:
            root = ElementTree.fromstring(z.read(name))
            title, body = "", []
            for shape in root.iter(_P + "sp"):
                kind = shape.find(f".//{_P}ph")
                text = lines(shape)
                if kind is not None and kind.get("type") in ("title", "ctrTitle") and not title:
                    title = text.replace("\n", " ")
                elif text:
                    body.append(text)
            for t in root.iter(_A + "tbl"):
                rows = [[lines(c).replace("\n", " ") for c in r.iter(_A + "tc")] for r in t.iter(_A + "tr")]
                body.append("\n".join("| " + " | ".join(r) + " |" + ("\n|" + "---|" * len(r) if i == 0 else "") for i, r in enumerate(rows)))
            notes = f"ppt/notesSlides/notesSlide{number}.xml"
            if notes in z.namelist():
                text = lines(ElementTree.fromstring(z.read(notes)))
                if text:
                    body.append("### Notes:\n" + text)
            out.append("\n\n".join([f"## Slide {number}" + (f": {title}" if title else ""), *body]))
    return "\n\n".join(out)


def presentations(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status, text) of presentations held as bytes; a broken file has status ``failed``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, texts = [], []
            for c in b.column(1).to_pylist():
                try:
                    text = slides_text(c) if c else ""
                    status.append("ok" if text else "skipped")
                    texts.append(text)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    status.append("failed")
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status), pa.array(texts, pa.string())], names=[key, "status", "text"])

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, status string, text string")
