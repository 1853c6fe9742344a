"""Timestamps in many notations and zones, normalised to UTC microseconds.

All notations are compiled into one alternation of named groups. A single ``regexp_replace`` rewrites a value into its components,
divided by U+0001, so the pattern runs once for each value inside the JVM; everything after it is integer arithmetic on columns.

Results for odd input: null, empty, blank, worded or impossible values give null. Fractions finer than a microsecond are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "\u0001"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

#: Zone abbreviations and their own offsets from UTC in minutes, in any season.
ABBREVIATIONS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "PKT": 300, "WIB": 420, "ICT": 420, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_TIME = r"(?<h{0}>\d{{1,2}}):(?<m{0}>\d{{2}})(?::(?<s{0}>\d{{2}})(?:[.,](?<f{0}>\d+))?)?"
_OFFSET = r"(?<o{0}>[+-]\d{{2}}(?::?\d{{2}})?)(?:\[[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+\])?"
_REGION = r"(?<r{0}>[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)"
_ABBR = r"(?<a{0}>[A-Za-z]{{1,5}})"
_ZONE = rf"(?:\s*(?:{_OFFSET}|{_REGION}|{_ABBR}))?"
_HALF = r"\s*(?<p{0}>[AaPp])\.?[Mm]\.?"

#: name -> pattern; ``{0}`` is the notation's number, which keeps the group names apart.
NOTATIONS = {
    "year first": r"(?<y{0}>\d{{4}})(?:-(?<n{0}>\d{{1,2}})-(?<d{0}>\d{{1,2}})|/(?<nn{0}>\d{{1,2}})/(?<dd{0}>\d{{1,2}}))(?:[Tt\s]\s*" + _TIME + _ZONE + ")?",
    "compact": r"(?<y{0}>\d{{4}})(?<n{0}>\d{{2}})(?<d{0}>\d{{2}})(?:[Tt_\s-](?<h{0}>\d{{2}})(?<m{0}>\d{{2}})(?<s{0}>\d{{2}})(?:[.,](?<f{0}>\d+))?" + _ZONE + ")?",
    "japanese": r"(?<y{0}>\d{{4}})\s*年\s*(?<n{0}>\d{{1,2}})\s*月\s*(?<d{0}>\d{{1,2}})\s*日(?:\s*(?<p{0}>午前|午後)?\s*(?<h{0}>\d{{1,2}})\s*時(?:\s*(?<m{0}>\d{{1,2}})\s*分(?:\s*(?<s{0}>\d{{1,2}})\s*秒)?)?)?",
    "day, month name": r"(?:[A-Za-z]{{3,9}},\s*)?(?<d{0}>\d{{1,2}})[\s-](?<b{0}>[A-Za-z]{{3,9}})[\s-](?<y{0}>\d{{4}})(?:,?\s+" + _TIME + "(?:" + _HALF + "|" + _ZONE + "))?",
    "month name, day": r"(?:[A-Za-z]{{3,9}},\s*)?(?<b{0}>[A-Za-z]{{3,9}})\.?\s+(?<d{0}>\d{{1,2}}),\s*(?<y{0}>\d{{4}})(?:,?\s+" + _TIME + "(?:" + _HALF + "|" + _ZONE + "))?",
    "dotted": r"(?<d{0}>\d{{1,2}})\.(?<n{0}>\d{{1,2}})\.(?<y{0}>\d{{4}})(?:,?\s+" + _TIME + _ZONE + ")?",
    "count": r"(?<c{0}>\d{{9,19}})(?:\.(?<e{0}>\d+))?",
}
FIELDS = {"y": "y", "n": "n", "nn": "n", "d": "d", "dd": "d", "b": "b", "h": "h", "m": "m", "s": "s", "f": "f", "p": "p", "o": "o", "r": "r", "a": "a", "c": "c", "e": "e"}


def pattern() -> tuple[str, str]:
    """The alternation over all notations and the replacement that lays out its named groups, one slot for each component."""
    import re

    parts = [p.format(i) for i, p in enumerate(NOTATIONS.values())]
    whole = r"^(?:" + "|".join(f"(?:{p})" for p in parts) + ")$"
    slots: dict[str, list[str]] = {v: [] for v in FIELDS.values()}
    for name in re.findall(r"\(\?<([a-z]+\d+)>", whole):
        slots[FIELDS[name.rstrip("0123456789")]].append("${" + name + "}")
    return whole, SEP + SEP.join("".join(slots[k]) for k in slots)


def zone_names(spark: SparkSession) -> list[str]:
    """The region names that this JVM's time-zone rules know (about 600, fixed by the JVM)."""
    return sorted(z for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z or z in ("UTC", "GMT"))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, by integer arithmetic alone (years from March, eras of 400 years)."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def components(value: Column) -> Column:
    """A value's components as an array (slots as in ``pattern()``), or null where no notation fits. The pattern runs here, once."""
    whole, layout = pattern()
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    text = F.regexp_replace(F.translate(value, wide, narrow), r"(?U)^\s+|\s+$", "")
    out = F.split(F.regexp_replace(text, whole, layout), SEP, -1)
    return F.when(F.size(out) > 1, out)


def with_instant(df: DataFrame, parts: str, zone: str, out: str, zones: list[str]) -> DataFrame:
    """``df`` with ``out``: UTC microseconds of the components in ``parts``, or null where they name no possible time.

    A region's local time that occurs twice is the earlier instant; one that is skipped moves on by the length of the gap.
    A default zone that is null or that ``zones`` does not hold counts as Asia/Tokyo. The steps are separate projections, so that
    each value is computed once and the generated code stays small.
    """
    c = lambda name: F.col(f"_t_{name}")
    names = list(dict.fromkeys(FIELDS.values()))
    steps: list[dict[str, Column]] = [
        {k: F.nullif(F.get(F.col(parts), F.lit(i + 1)), F.lit("")) for i, k in enumerate(names)},
        {
            "y": c("y").cast("long"),
            "d": c("d").cast("long"),
            "at": F.call_function("instr", F.lit(MONTHS), F.lower(F.substring(c("b"), 1, 3))),
            "h": F.coalesce(c("h").cast("long"), F.lit(0)),
            "m": F.coalesce(c("m").cast("long"), F.lit(0)),
            "s": F.coalesce(c("s").cast("long"), F.lit(0)),
            "p": F.lower(c("p")),
            "f": F.coalesce(F.rpad(F.substring(c("f"), 1, 6), 6, "0").cast("long"), F.lit(0)),
            "od": F.regexp_replace(c("o"), ":", ""),
            "e": F.rpad(F.substring(F.coalesce(c("e"), F.lit("")), 1, 6), 6, "0"),
            "count": c("c").cast("long"),
            "short": F.element_at(F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv)), F.upper(c("a"))).cast("long"),
            "zone": F.when(F.col(zone).isin(zones), F.col(zone)).otherwise(F.lit("Asia/Tokyo")),
            "region": F.when(c("r").isin(zones), c("r")),
        },
        {
            "n": F.coalesce(c("n").cast("long"), F.when(c("at") % 3 == 1, F.floor((c("at") + 2) / 3))),
            "oh": F.substring(c("od"), 2, 2).cast("long"),
            "om": F.coalesce(F.nullif(F.substring(c("od"), 4, 2), F.lit("")).cast("long"), F.lit(0)),
            "hour": F.when(c("p").isin("p", "午後"), c("h") % 12 + 12).when(c("p").isin("a", "午前"), c("h") % 12).otherwise(c("h")),
        },
        {
            "days": _days(c("y"), c("n"), c("d")),
            "longest": F.when(c("n").isin(4, 6, 9, 11), 30)
            .when(c("n") == 2, F.when(((c("y") % 4 == 0) & (c("y") % 100 != 0)) | (c("y") % 400 == 0), 29).otherwise(28))
            .otherwise(31),
            "offset": F.when((c("oh") <= 18) & (c("om") <= 59), F.when(F.startswith(c("od"), F.lit("-")), -1).otherwise(1) * (c("oh") * 60 + c("om"))),
        },
        {
            "local": ((c("days") * 86400 + c("hour") * 3600 + c("m") * 60 + c("s")) * 1_000_000 + c("f")),
            "possible": (c("y") >= 1)
            & c("n").between(1, 12)
            & (c("d") >= 1)
            & (c("d") <= c("longest"))
            & (c("h") <= F.when(c("p").isNotNull(), 12).otherwise(23))
            & (c("m") <= 59)
            & (c("s") <= 59),
            "seconds": F.when(F.length(c("c")) <= 11, c("count") * 1_000_000 + c("e").cast("long")),
            "millis": F.when(F.length(c("c")) <= 14, c("count") * 1000 + F.substring(c("e"), 1, 3).cast("long")),
        },
    ]
    for step in steps:
        df = df.withColumns({f"_t_{k}": v for k, v in step.items()})
    where = F.when(c("r").isNotNull(), c("region")).otherwise(c("zone"))
    civil = (
        F.when(c("o").isNotNull(), c("local") - c("offset") * 60_000_000)
        .when(c("a").isNotNull(), c("local") - c("short") * 60_000_000)
        .otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c("local")), where)))
    )
    low, high = 1_420_070_400_000_000, 1_830_297_600_000_000  # 2015-01-01 and 2028-01-01
    bare = F.coalesce(*(F.when((v >= low) & (v < high), v) for v in (c("seconds"), c("millis"), c("count"))))
    df = df.withColumn(out, F.when(c("c").isNotNull(), bare).when(c("possible"), civil))
    return df.drop(*(x for x in df.columns if x.startswith("_t_")))
