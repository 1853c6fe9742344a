"""Metadata filters: parsed from ``k=v,k=v``, and applied in each of the three ways of comparing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = re.compile(r"^[A-Za-z_]\w*$")


def parse_filters(text: str | None) -> dict[str, str]:
    """The pairs of ``k=v,k=v``; a value may hold ``=``. An empty text gives none; a part without ``=`` or key is an error."""
    out: dict[str, str] = {}
    for part in (text or "").split(","):
        if not part.strip():
            continue
        key, found, value = part.partition("=")
        if not found or not key.strip():
            raise ValueError(f"not a filter: {part!r}")
        out[key.strip()] = value.strip()
    return out


def where(meta: str, filters: dict[str, str], source_type: str | None = None, mode: str = "typed") -> Column:
    """The condition that all filters hold on the JSON column ``meta``.

    typed: the value is a text and equal (numbers and truth values never match); loose: the value's text is equal without case.
    Keys that are no plain names are an error, since they would reach into the path.
    """
    conditions = [F.col("source_type") == source_type] if source_type else []
    variant = F.try_parse_json(meta)
    for key, value in filters.items():
        if not _KEY.match(key):
            raise ValueError(f"not a key: {key!r}")
        path = f"$.{key}"
        if mode == "typed":
            conditions.append((F.schema_of_variant(F.try_variant_get(variant, path, "variant")) == "STRING") & (F.try_variant_get(variant, path, "string") == value))
        else:
            conditions.append(F.upper(F.get_json_object(meta, path)) == value.upper())
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
