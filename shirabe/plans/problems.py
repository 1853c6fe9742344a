"""Queries of the general problems (3 and 4) over the project's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions.instants import ABBREVIATIONS, MONTHS, NOTATIONS
from shirabe.operators.flatten_records import feed_children, feed_posts
from shirabe.operators.normalise_times import normalise_times
from shirabe.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = normalise_times(table(spark, sf_dir, "sources"), "row_id", ["collected_at", "published_at"], F.get_json_object("meta", "$.tz"), "sources")
    videos = normalise_times(table(spark, sf_dir, "videos"), "row_id", ["upload_date"], F.lit("UTC"), "videos")
    return sources.unionByName(videos)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_children(table(spark, sf_dir, "feed_records"))


def p3_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_posts(table(spark, sf_dir, "feed_records"))


def _sql_instants() -> str:
    """The instants of problem 4 in DuckDB: one branch a notation; dates, zones and daylight saving by DuckDB's own calendar."""
    wide, narrow = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000", "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    branches = []
    for notation in NOTATIONS.values():
        pattern = re.sub(r"\(\?<([a-z]+)>", r"(?P<\1>", notation.format(""))
        names = re.findall(r"\(\?P<([a-z]+)>", pattern)
        part = lambda *k: "coalesce(" + ", ".join([f"nullif(g.{x}, '')" for x in k if x in names] + ["NULL"]) + ")"  # noqa: B023, E731
        columns = ", ".join(f"{part(*k)} AS {k[0]}" for k in (("y",), ("n", "nn"), ("d", "dd"), ("b",), ("h",), ("m",), ("s",), ("f",), ("p",), ("o",), ("r",), ("a",), ("c",), ("e",)))
        whole = quoted(f"^(?:{pattern})$")
        branches.append(f"SELECT tab, row_id, field, tz, {columns} FROM (SELECT *, regexp_extract(t, {whole}, [{', '.join(map(quoted, names))}]) AS g FROM v WHERE regexp_full_match(t, {whole}))")
    short = "CASE upper(a) " + " ".join(f"WHEN '{k}' THEN {m}" for k, m in ABBREVIATIONS.items()) + " END"
    hour = "CASE WHEN lower(p) IN ('p', '午後') THEN h::INT % 12 + 12 WHEN p IS NOT NULL THEN h::INT % 12 ELSE coalesce(h, '0')::INT END"
    month = "coalesce(n::INT, CASE lower(b[1:3]) " + " ".join(f"WHEN '{MONTHS[3 * i : 3 * i + 3]}' THEN {i + 1}" for i in range(12)) + " END)"
    stamp = f"try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d.%06d', y::INT, {month}, d::INT, {hour}, coalesce(m, '0')::INT, coalesce(s, '0')::INT, coalesce(rpad(f, 6, '0')[1:6], '0')::INT) AS TIMESTAMP)"
    count = "try_cast(c AS HUGEINT)"
    us = "coalesce(rpad(e, 6, '0')[1:6], '0')::HUGEINT"
    spans = [f"CASE WHEN length(c) <= 11 THEN {count} * 1000000 + {us} END", f"CASE WHEN length(c) <= 14 THEN {count} * 1000 + coalesce(rpad(e, 6, '0')[1:3], '0')::HUGEINT END", count]
    bare = "coalesce(" + ", ".join(f"CASE WHEN {x} >= 1420070400000000 AND {x} < 1830297600000000 THEN {x} END" for x in spans) + ")"
    off = "CASE WHEN o[1] = '-' THEN -1 ELSE 1 END * (replace(o, ':', '')[2:3]::INT * 60 + coalesce(nullif(replace(o, ':', '')[4:5], ''), '0')::INT)"
    return f"""WITH raw AS (SELECT 'sources' AS tab, row_id, 'collected_at' AS field, collected_at AS x, meta->>'$.tz' AS tz FROM sources UNION ALL SELECT 'sources', row_id, 'published_at', published_at, meta->>'$.tz' FROM sources UNION ALL SELECT 'videos', row_id, 'upload_date', upload_date, 'UTC' FROM videos),
    zones AS (SELECT name FROM pg_timezone_names() WHERE contains(name, '/') OR name IN ('UTC', 'GMT')), v AS (SELECT *, trim(translate(x, {quoted(wide)}, {quoted(narrow)}), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM raw), k AS ({" UNION ALL ".join(branches)}),
    l AS (SELECT *, {stamp} AS local, coalesce(r, CASE WHEN tz IN (SELECT name FROM zones) THEN tz ELSE 'Asia/Tokyo' END) AS zone FROM k WHERE c IS NULL AND (p IS NULL OR h::INT <= 12)),
    z AS (SELECT *, CASE WHEN o IS NULL AND a IS NULL AND zone IN (SELECT name FROM zones) THEN timezone(zone, local) END AS inst FROM l),
    i AS (SELECT tab, row_id, field, CASE WHEN o IS NOT NULL THEN epoch_us(local) - ({off}) * 60000000::BIGINT WHEN a IS NOT NULL THEN epoch_us(local) - {short} * 60000000::BIGINT WHEN timezone(zone, inst - INTERVAL 1 HOUR) = local THEN epoch_us(inst - INTERVAL 1 HOUR) ELSE epoch_us(inst) END AS utc_us FROM z
    UNION ALL SELECT tab, row_id, field, {bare} FROM k WHERE c IS NOT NULL) SELECT DISTINCT tab, row_id, field, utc_us::BIGINT AS utc_us FROM i WHERE utc_us IS NOT NULL"""


QUERIES = {"p3_found": p3_found, "p3_posts": p3_posts, "p4_found": p4_found}
SQL = {"p4_found": _sql_instants()}
