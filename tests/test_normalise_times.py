"""Instants against Python's own zone rules, and the odd inputs."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from shirabe.operators.normalise_times import normalise_times

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*a, zone="UTC", micro=0, fold=0):
    local = datetime(*a, microsecond=micro, tzinfo=ZoneInfo(zone), fold=fold)
    return (local.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


CASES = [
    ("2024-02-02T14:19:15Z", None, us(2024, 2, 2, 14, 19, 15)),
    ("2024-02-02t14:19:15.123456789z", None, us(2024, 2, 2, 14, 19, 15, micro=123456)),
    ("2021-12-16T01:57:15,675+01:00", None, us(2021, 12, 16, 0, 57, 15, micro=675000)),
    ("2020-10-19 05:40:30-08", None, us(2020, 10, 19, 13, 40, 30)),
    ("2019-02-17T16:25:10 UTC", None, us(2019, 2, 17, 16, 25, 10)),
    ("2018-10-04T05:14:53+02:00[Europe/Berlin]", None, us(2018, 10, 4, 3, 14, 53)),
    ("2018-04-17 17:47:19 America/Los_Angeles", "UTC", us(2018, 4, 17, 17, 47, 19, zone="America/Los_Angeles")),
    ("2024-07-01 08:00:00", "Europe/London", us(2024, 7, 1, 8, zone="Europe/London")),
    ("2024-07-01 08:00:00", "Nowhere/Else", us(2024, 7, 1, 8, zone="Asia/Tokyo")),
    ("2020-02-29", None, us(2020, 2, 29, zone="Asia/Tokyo")),
    ("2020/7/4 01:18", None, us(2020, 7, 4, 1, 18, zone="Asia/Tokyo")),
    ("20230114T080304Z", None, us(2023, 1, 14, 8, 3, 4)),
    ("20210731-222748", "UTC", us(2021, 7, 31, 22, 27, 48)),
    ("20180326", "UTC", us(2018, 3, 26)),
    ("2017年06月25日 午後8時08分", None, us(2017, 6, 25, 20, 8, zone="Asia/Tokyo")),
    ("2017年6月5日 午前12時05分", None, us(2017, 6, 5, 0, 5, zone="Asia/Tokyo")),
    ("2019年3月6日", None, us(2019, 3, 6, zone="Asia/Tokyo")),
    ("Mon, 06 Jun 2016 10:01:22 EDT", None, us(2016, 6, 6, 14, 1, 22)),
    ("05 Apr 2016 21:29:18 CEST", None, us(2016, 4, 5, 19, 29, 18)),
    ("08 Jan 2025 22:13:55 EDT", None, us(2025, 1, 9, 2, 13, 55)),  # its own offset, in winter too
    ("27.10.2018 03:07", "UTC", us(2018, 10, 27, 3, 7)),
    ("21-Jul-2020 11:52", "UTC", us(2020, 7, 21, 11, 52)),
    ("Nov 1, 2020 3:37 AM", "UTC", us(2020, 11, 1, 3, 37)),
    ("2 Dec 2017, 12:17 pm", "UTC", us(2017, 12, 2, 12, 17)),
    ("２０２２-０１-０８ １２:２３:２３", "UTC", us(2022, 1, 8, 12, 23, 23)),
    ("1723913818", None, 1723913818000000),
    ("1685288462.43", None, 1685288462430000),
    ("1666751754564", None, 1666751754564000),
    ("1558914027384527", None, 1558914027384527),
    ("2024-11-03 01:30:00", "America/New_York", us(2024, 11, 3, 1, 30, zone="America/New_York", fold=0)),  # twice: the earlier
    ("2024-03-10 02:30:00", "America/New_York", us(2024, 3, 10, 3, 30, zone="America/New_York")),  # skipped: moves on
    (" \t2018-03-17 07:14:31Z\n", None, us(2018, 3, 17, 7, 14, 31)),
    *((v, None, None) for v in (None, "", "  ", "2025-04-31", "2023-02-29", "1900-02-29", "0000-00-00", "2026-06-10T25:10:00+09:00", "2024-13-01", "yesterday", "TBD", "12", "9999999999", "2020-01-01T10:61:00Z", "2018-04-17 17:47:19 Mars/Base", "x" * 5000)),
]


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, v, z, "clash") for i, (v, z, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row_id long, when_ string, tz string, utc_us string")
    return {r["row_id"]: r["utc_us"] for r in normalise_times(df, "row_id", ["when_"], F.col("tz"), "t").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_instant(result, i):
    assert result.get(i) == CASES[i][2], CASES[i]


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "20180326"), (1, "20180326")], "row_id long, v string")
    assert normalise_times(df, "row_id", ["v"], F.lit("UTC"), "t").count() == 2
    assert normalise_times(df.limit(0), "row_id", ["v"], F.lit("UTC"), "t").count() == 0
