"""Dates as columns against the standard library's zones."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from feedweave.functions import dates, postprocess


def expected(local, zone):
    """Standard time of a repeated local time, UTC for a skipped one: by trying both readings."""
    z = ZoneInfo(zone)
    real = [t for f in (0, 1) if (t := local.replace(tzinfo=z, fold=f)).astimezone(timezone.utc).astimezone(z).replace(tzinfo=None) == local]
    return max(real, key=lambda t: t.astimezone(timezone.utc)) if real else local.replace(tzinfo=timezone.utc)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata", "UTC"])
def test_local_times_around_changes(spark, zone):
    starts = [datetime(2024, m, d) for m, d in ((3, 31), (10, 27), (3, 10), (11, 3), (4, 7), (10, 6), (7, 1))]
    times = [s + timedelta(minutes=15 * k) for s in starts for k in range(24)]
    rows = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M"),) for t in times], "x string")
    got = [r.i for r in rows.select(dates.iso(dates.moment(F.col("x"), zone)).alias("i")).collect()]
    assert got == [expected(t, zone).isoformat(timespec="seconds") for t in times]
    assert [postprocess.parse_date(t.strftime("%Y-%m-%d %H:%M"), zone).isoformat(timespec="seconds") for t in times] == got


@pytest.mark.parametrize(("text", "want"), [
    ("2024-01-02", "2024-01-02T00:00:00+01:00"), ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00"), ("2024-01-02T03:04:05.678-0530", "2024-01-02T03:04:05-05:30"), ("2024-1-2 3:04", "2024-01-02T03:04:00+01:00"),
    ("Tue, 02 Jan 2024 03:04:05 +0200", "2024-01-02T03:04:05+02:00"), ("January 2, 2024 at 3:04 pm", "2024-01-02T15:04:00+01:00"), ("Jan. 2 , 2024", "2024-01-02T00:00:00+01:00"), ("2nd January 2024", "2024-01-02T00:00:00+01:00"),
    ("02.01.2024 12:30 AM", "2024-01-02T00:30:00+01:00"), ("2/1/2024", "2024-01-02T00:00:00+01:00"), ("70-01-02", "1970-01-02T00:00:00+01:00"), (" Tuesday,\n January 2,  2024 ", "2024-01-02T00:00:00+01:00"),
    ("2024-02-30", None), ("24:61", None), ("10:30", None), ("", None), (None, None), ("2024", None), ("2 Foo 2024", None), ("x" * 200 + " 2024-01-02", None),
])
def test_shapes(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(dates.iso(dates.moment(F.col("x"), "Europe/Berlin"))).first()[0] == want


def test_earliest_and_mail(spark):
    rows = spark.createDataFrame([(["no date", "2024-05-05", "2024-05-04T23:30:00Z"],), (["2024-05-05T01:00:00+02:00", "2024-05-04 12:00"],), (["x", None],), ([],), (None,)], "x array<string>")
    got = rows.select(dates.earliest(F.col("x"), "Europe/Berlin").alias("m")).select(dates.iso(F.col("m")), dates.mail(F.col("m"))).collect()
    assert [r[0] for r in got] == ["2024-05-05T00:00:00+02:00", "2024-05-04T12:00:00+02:00", None, None, None]
    assert got[0][1] == "Sun, 05 May 2024 00:00:00 +0200"
    assert dates.known_zone("No/Where") == dates.known_zone(None) == "UTC"
