"""URLs, stored paths, source types: all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source types, in the order of the catalogue; and the characters that paths may not hold, with their full-width stand-ins.
SOURCE_TYPES = ("web", "local", "journal", "zenn", "bluesky", "youtube", "aozora")
HALF, FULL = ':?*<>|"', "：？＊＜＞｜＂"
#: Endings that name a web page, and those that a converter knows besides.
PAGE_ENDINGS = ("html", "htm", "xhtml", "shtml", "php", "asp", "aspx", "jsp")
CONVERTED_ENDINGS = ("pdf", "json", "md", "txt", "adoc")

URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query of an absolute URL; empty where missing."""
    return F.regexp_extract(url, URL, n)


def url_to_path(url: Column) -> Column:
    """web/scheme/host/path of an http(s) URL: no user, fragment or outer slashes; an empty path is ``index``; null for other schemes."""
    scheme = F.lower(url_part(url, 1))
    host = F.regexp_replace(url_part(url, 2), "^[^@]*@", "")
    path = F.regexp_replace(url_part(url, 3), "^/+|/+$", "")
    path = F.when(path == "", "index").otherwise(path)
    query = url_part(url, 4)
    path = F.when(query == "", path).otherwise(F.concat(path, F.lit("？"), query))
    return F.when(scheme.isin("http", "https"), F.concat(F.lit("web/"), scheme, F.lit("/"), F.translate(host, HALF, FULL), F.when(host != "", "/").otherwise(""), F.translate(path, HALF, FULL)))


def path_to_url(path: Column) -> Column:
    """The URL of a stored web path; null for other paths."""
    scheme = F.regexp_extract(path, "^web/(https?)/", 1)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), F.translate(F.regexp_replace(path, "^web/https?/", ""), FULL, HALF)))


def url_to_filename(url: Column) -> Column:
    """The file that a crawled page is kept in: its path, ``index.html`` for none, ``.html`` added unless it ends like a page."""
    path = F.regexp_replace(url_part(url, 3), "^/+|/+$", "")
    return F.when(path == "", "index.html").when(path.rlike(r"(?i)\.(" + "|".join(PAGE_ENDINGS) + ")$"), path).otherwise(F.concat(path, F.lit(".html")))


def needs_html_ending(url: Column) -> Column:
    """Whether the page of a URL is kept with ``.html`` added: its path has no ending that a page or a converter knows."""
    return ~url_part(url, 3).rlike(r"(?i)\.(" + "|".join(PAGE_ENDINGS + CONVERTED_ENDINGS) + ")$")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def source_type(path: Column) -> Column:
    """The first segment, if it is a known source type, else null."""
    first = F.substring_index(F.translate(path, "\\", "/"), "/", 1)
    return F.when(first.isin(*SOURCE_TYPES), first)


def attachment_parent(path: Column) -> Column:
    """The record that a media file belongs to, or null for a path that is no attachment."""
    p = F.translate(path, "\\", "/")
    found = F.regexp_extract(p, r"^(bluesky/(?:[^/]+/)*?)media/([^/]+)(?:/.*)?$", 1)
    return F.when(found != "", F.concat(found, F.regexp_extract(p, r"^(bluesky/(?:[^/]+/)*?)media/([^/]+)(?:/.*)?$", 2), F.lit(".json")))


def is_source_file(path: Column) -> Column:
    """Whether a stored file is a source of its own: known root, no sidecar, index, lock, system or infrastructure file, no attachment."""
    out = [
        path.endswith(".meta"), path.rlike(r"^metadata\.db"), path.isin(".gitignore", ".write.lock", ".rebuild.lock", ".ingest.lock", "aozora/catalog.csv"),
        path.rlike(r"(^|/)\.git(/|$)"), path.rlike(r"(^|/)(\.DS_Store|Thumbs\.db|desktop\.ini|xrefmap\.yml)$"), path.rlike("(^|/)docdata/"),
    ]
    return source_type(path).isNotNull() & ~reduce(lambda a, b: a | b, out) & attachment_parent(path).isNull()


def route(url: Column) -> Column:
    """skip (the feed's own network), youtube, invalid_youtube, or web; null for other schemes."""
    host = F.regexp_replace(F.lower(url_part(url, 2)), r"^[^@]*@|:\d+$|^www\.|^m\.", "")
    video = F.coalesce(
        F.nullif(F.when(host == "youtu.be", F.regexp_extract(url_part(url, 3), "^/([^/]+)", 1)), F.lit("")),
        F.nullif(F.regexp_extract(url_part(url, 4), "(?:^|&)v=([^&]*)", 1), F.lit("")),
        F.nullif(F.regexp_extract(url_part(url, 3), "^/(?:shorts|embed|live)/([^/]+)", 1), F.lit("")),
        F.lit(""),
    )
    return (
        F.when(~F.lower(url_part(url, 1)).isin("http", "https"), F.lit(None))
        .when(host.isin("bsky.app", "bsky.social"), "skip")
        .when(host.isin("youtube.com", "youtu.be"), F.when(video.rlike("^[A-Za-z0-9_-]{11}$"), "youtube").otherwise("invalid_youtube"))
        .otherwise("web")
    )


def url_problem(url: Column) -> Column:
    """Why a URL may not be fetched (scheme, host, private), or null where it may; names are not resolved."""
    host = F.regexp_replace(F.lower(url_part(url, 2)), r"^[^@]*@|:\d+$", "")
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|\[?::1\]?$|\[?f[cd][0-9a-f]{2}:|\[?fe80:)")
    return F.when(~F.lower(url_part(url, 1)).isin("http", "https"), "scheme").when(host == "", "host").when(private, "private")


def like_escaped(text: Column) -> Column:
    """The text with the wildcards of LIKE escaped by a backslash."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def prefix_problem(prefix: Column) -> Column:
    """Why a path prefix is not acceptable (empty, absolute, drive, double, dots, root), or null where it is."""
    p = F.translate(prefix, "\\", "/")
    return (
        F.when(F.trim(p) == "", "empty")
        .when(p.startswith("/"), "absolute")
        .when(p.rlike("^[A-Za-z]:"), "drive")
        .when(p.contains("//"), "double")
        .when(p.rlike(r"(^|/)\.{1,2}(/|$)"), "dots")
        .when(source_type(p).isNull(), "root")
    )
