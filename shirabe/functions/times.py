"""ISO timestamps as sortable UTC text, day ranges and resolution rules of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(Z|[+-]\d{2}:\d{2})?\z"


def iso_instant(text: Column) -> Column:
    """The instant of an ISO text; without offset it is Japanese time (UTC+9 all year); null where it is none."""
    local = F.try_to_timestamp(F.concat(F.regexp_extract(text, ISO, 1), F.lit(" "), F.regexp_extract(text, ISO, 2)))
    zone = F.regexp_extract(text, ISO, 3)
    minutes = F.when(zone == "", 540).when(zone == "Z", 0).otherwise(F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 5, 2).cast("int")))
    return F.timestamp_micros(F.unix_micros(local) - minutes.cast("bigint") * 60_000_000)


def iso_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def normalised(text: Column) -> Column:
    """The sortable UTC text of an ISO timestamp; an empty or unreadable one stays as it is."""
    return F.coalesce(iso_text(iso_instant(text)), text)


def japanese_day(day: Column, end: bool = False) -> Column:
    """The first (or last) microsecond of a day in Japan, as sortable UTC text; null for an impossible date."""
    us = F.unix_micros(F.try_to_timestamp(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day))) - 9 * 3_600_000_000
    return iso_text(F.timestamp_micros(us + (86_400_000_000 - 1 if end else 0)))


def published(kind: Column, meta: Column, collected: Column) -> Column:
    """When a source was published: its type's own field where it holds something (eight digits are a date), else when it was collected."""
    raw = F.when(kind == "bluesky", F.get_json_object(meta, "$.created_at")).when(kind == "zenn", F.get_json_object(meta, "$.published_at")).when(kind == "youtube", F.get_json_object(meta, "$.upload_date"))
    day = F.when((kind == "youtube") & raw.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.concat(F.substring(raw, 7, 2), F.lit("T00:00:00+00:00"))))
    return F.coalesce(day, F.nullif(raw, F.lit("")), collected)
