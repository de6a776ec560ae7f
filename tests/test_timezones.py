import datetime as dt
import random
import zoneinfo

import pytest
from pyspark.sql import functions as F

from doclake.operators.timezones import offset_changes, to_utc

CASES = [
    # text, zone, order, UTC or what it is
    ("2025-04-15T13:04:54.483Z", None, None, "2025-04-15 13:04:54.483"),
    ("2025-04-15t13:04:54,483z", None, None, "2025-04-15 13:04:54.483"),
    ("2024-01-28T09:51:09.492918999Z", None, None, "2024-01-28 09:51:09.492918"),
    ("2025-04-15T13:04+05:45", None, None, "2025-04-15 07:19:00"),
    ("2025-04-15T13:04:05-0330[America/St_Johns]", "UTC", None, "2025-04-15 16:34:05"),
    ("2025-04-15T13:04:05+02", "UTC", None, "2025-04-15 11:04:05"),
    ("2025-04-15 13:04:05[Europe/Berlin]", "UTC", None, "2025-04-15 11:04:05"),
    ("2025-04-15 13:04:05", "Europe/Berlin", None, "2025-04-15 11:04:05"),
    ("2023-10-29 02:30:00", "Europe/Berlin", None, "ambiguous"),
    ("2023-10-29 03:00:00", "Europe/Berlin", None, "2023-10-29 02:00:00"),
    ("2023-10-29 01:59:59.999", "Europe/Berlin", None, "2023-10-28 23:59:59.999"),
    ("2023-03-26 02:00:00", "Europe/Berlin", None, "never"),
    ("2023-03-26 03:00:00", "Europe/Berlin", None, "2023-03-26 01:00:00"),
    ("2024-04-07 02:15", "Australia/Lord_Howe", None, "2024-04-06 15:45:00"),
    ("2024-04-07 01:45", "Australia/Lord_Howe", None, "ambiguous"),
    ("31/12/2023 23:05", "UTC", "dmy", "2023-12-31 23:05:00"),
    ("12/31/2023 11:05 pm", "UTC", "mdy", "2023-12-31 23:05:00"),
    ("31/12/2023 23:05", "UTC", "mdy", "no_time"),
    ("31/12/2023 23:05", "UTC", None, "no_time"),
    ("01.02.2024 07:16:35", "UTC", "dmy", "2024-02-01 07:16:35"),
    ("2024/1/2 3:04", "UTC", None, "2024-01-02 03:04:00"),
    ("20240426T100756Z", None, None, "2024-04-26 10:07:56"),
    ("Fri, 03 Mar 2023 07:56:17 +0100", None, None, "2023-03-03 06:56:17"),
    ("Mon, 08 Jul 2024 20:59:35 GMT", None, None, "2024-07-08 20:59:35"),
    ("Jul 4, 2024 12:05:01 AM", "UTC", None, "2024-07-04 00:05:01"),
    ("10 August 2023, 02:17:24", "UTC", None, "2023-08-10 02:17:24"),
    ("2024年5月25日 下午9:39", "UTC", None, "2024-05-25 21:39:00"),
    ("2024年5月25日 上午12:07", "UTC", None, "2024-05-25 00:07:00"),
    ("2023年09月05日 04:42:56", "UTC", None, "2023-09-05 04:42:56"),
    ("1725057628", None, None, "2024-08-30 22:40:28"),
    (" +1725057628\n", None, None, "2024-08-30 22:40:28"),
    ("1737289906.671", None, None, "2025-01-19 12:31:46.671"),
    ("1725057628123", None, None, "2024-08-30 22:40:28.123"),
    ("1725057628123456", None, None, "2024-08-30 22:40:28.123456"),
    ("1725057628123456789", None, None, "2024-08-30 22:40:28.123456"),
    (" 2025-01-10T17:29:51Z ", None, None, "2025-01-10 17:29:51"),
    ("2025-06-31T10:00:00Z", None, None, "no_time"),
    ("2023-02-29 00:00:00", "UTC", None, "no_time"),
    ("2024-02-29 00:00:00", "UTC", None, "2024-02-29 00:00:00"),
    ("0000-00-00T00:00:00Z", None, None, "no_time"),
    ("2025-01-01T24:00:00Z", None, None, "no_time"),
    ("2025-01-01T10:00:00+25:00", None, None, "no_time"),
    ("2025-01-01", "UTC", None, "no_time"),
    ("30 Aug 2025", "UTC", None, "no_time"),
    ("13:05 PM", "UTC", None, "no_time"),
    ("17O9647402", "UTC", None, "no_time"),
    ("yesterday", "UTC", None, "no_time"),
    ("", "UTC", None, "no_time"),
    (None, "UTC", None, "no_time"),
    ("2025-01-01 10:00", None, None, "no_zone"),
    ("2025-01-01 10:00", "Mars/Base", None, "no_zone"),
]


def test_every_case(spark):
    df = spark.createDataFrame([(i, *c[:3], "clash") for i, c in enumerate(CASES)], "n int, s string, z string, o string, time_case string")
    got = {r.n: r for r in to_utc(df, F.col("s"), F.col("z"), F.col("o")).collect()}
    assert len(got) == len(CASES)
    for i, (text, zone, _, want) in enumerate(CASES):
        r = got[i]
        if want[0].isdigit():
            at = dt.datetime.fromisoformat(want).replace(tzinfo=dt.timezone.utc)
            assert r.utc_us == (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1), (text, zone, r)
        else:
            assert (r.utc_us, r.time_case) == (None, want), (text, zone, r)


def test_repeated_and_no_rows(spark):
    df = spark.createDataFrame([("2025-01-01 10:00", "UTC", None)] * 3, "s string, z string, o string")
    assert to_utc(df, F.col("s"), F.col("z"), F.col("o")).count() == 3
    assert to_utc(df.limit(0), F.col("s"), F.col("z"), F.col("o")).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca"])
def test_changes_agree_with_the_zone(zone):
    tz = zoneinfo.ZoneInfo(zone)
    changes = offset_changes(zone, 2000, 2030)
    for at, off in changes[1:]:
        t = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=at)
        assert t.astimezone(tz).utcoffset().total_seconds() == off
        assert (t - dt.timedelta(seconds=1)).astimezone(tz).utcoffset().total_seconds() != off


def _truth(zone, local):
    """UTC of a local time by the zone database, or ``ambiguous`` or ``never``."""
    tz = zoneinfo.ZoneInfo(zone)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    fits = set()
    for fold in (0, 1):
        u = local.replace(tzinfo=tz, fold=fold).astimezone(dt.timezone.utc)
        if u.astimezone(tz).replace(tzinfo=None) == local:
            fits.add((u - epoch) // dt.timedelta(microseconds=1))
    return fits.pop() if len(fits) == 1 else "ambiguous" if fits else "never"


def test_years_from_1900_to_2200_in_fifty_zones(spark):
    rng = random.Random(3)
    zones = rng.sample(sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix", "right", "Etc"))), 46)
    zones += ["America/New_York", "Europe/London", "Australia/Lord_Howe", "Africa/Casablanca"]
    data = []
    for zone in zones:
        changes = [c for c in offset_changes(zone) if c[0] > -2_200_000_000]
        for _ in range(60):
            data.append((zone, dt.datetime(rng.randint(1900, 2200), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59))))
        for at, off in rng.sample(changes, min(20, len(changes))):  # near the changes
            data.append((zone, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=at + off + rng.randint(-7300, 7300))))
        for year in (2037, 2100, 2101, 2129, 2200, 2400, 9998):
            data.append((zone, dt.datetime(year, rng.choice((3, 4, 10, 11)), rng.randint(1, 28), 2, 30)))
        data += [(zone, dt.datetime(2199, 12, 31, 23, 59, 59)), (zone, dt.datetime(2200, 1, 1)), (zone, dt.datetime(1900, 1, 1))]
    df = spark.createDataFrame([(i, z, t.isoformat(sep=" ")) for i, (z, t) in enumerate(data)], "i int, z string, s string")
    got = {r["i"]: r["utc_us"] if r["time_case"] == "zone" else r["time_case"] for r in to_utc(df, F.col("s"), F.col("z"), F.lit("dmy")).collect()}
    wrong = [(z, t, got[i]) for i, (z, t) in enumerate(data) if got[i] != _truth(z, t)]
    assert not wrong
    assert {"ambiguous", "never"} <= set(got.values())
