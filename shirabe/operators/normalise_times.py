"""Mixed timestamp formats and time zones: one UTC instant for each value that names one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.functions.instants import components, with_instant, zone_names
from shirabe.session import spread


def normalise_times(df: DataFrame, key: str, fields: Sequence[str], default_zone: Column, tab: str) -> DataFrame:
    """(tab, key, field, utc_us) for each value of ``fields`` that names a possible time.

    ``default_zone`` is the zone of values that name none. Null, empty, worded and impossible values have no row; repeated rows
    give repeated results; an empty table gives none; further columns are not read. Narrow: no shuffle, and one pass over the rows.
    """
    zones = zone_names(df.sparkSession)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    values = spread(df.select(F.col(key), default_zone.alias("_zone"), pairs.alias("_pairs"))).select(key, "_zone", F.explode("_pairs").alias("_v"))
    # explode over a compacted one-value array drops nulls without repeating the expression, as a filter pushed below would
    parsed = values.select(key, "_zone", F.col("_v.field").alias("field"), F.explode(F.array_compact(F.array(components(F.col("_v.value"))))).alias("_parts"))
    out = with_instant(parsed, "_parts", "_zone", "_us", zones)
    return out.select(F.lit(tab).alias("tab"), key, "field", F.explode(F.array_compact(F.array("_us"))).alias("utc_us"))
