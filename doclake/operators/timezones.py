"""Local times to instants: an as-of join with the intervals in which each zone kept one offset.

Every interval between two changes of a zone's offset covers a stretch of that zone's clocks. Stretches overlap where
clocks were set back and leave gaps where they were set forward. A local time that lies in one stretch has that one's
offset; in two it is ambiguous, in none it never was.

The intervals of the zones that occur are exploded to the local years they touch and gathered per (zone, year), so the
as-of join is an equality join on a unique key followed by a scan of the few intervals of that year. All years have
intervals: before FIRST_YEAR no zone had changed yet, and after LAST_YEAR only the zones' yearly rules are left, which go
by the weekday of New Year and by leap years, so such a year is looked up as one of the RULE_YEARS with the same calendar.
The number of intervals is bounded by the zone database (about 600 zones times FIRST_YEAR to LAST_YEAR, about 20 MB), so
that side is broadcast whatever the size of the data.
"""

from __future__ import annotations

import bisect
import datetime as dt
import struct
import zoneinfo
from collections.abc import Iterator
from importlib import resources
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.timeparse import once, split_time

#: The zone database tells no change before 1840, and after 2087 only yearly rules.
FIRST_YEAR, LAST_YEAR = 1840, 2128
#: Twenty-eight years in which every calendar occurs: both kinds of year, New Year on each weekday.
RULE_YEARS = range(2101, 2129)
_US = 1_000_000
_DAY_US = 86_400 * _US
#: A zone name at the end of a time text.
_BRACKETS = r"\[([^\]]+)\]\s*$"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _listed_changes(zone: str) -> list[int]:
    """The seconds since 1970 of the changes that the zone's file lists; later ones follow from its yearly rule."""
    held = next((f for f in (Path(root, zone) for root in zoneinfo.TZPATH) if f.is_file()), None)
    data = held.read_bytes() if held else resources.files("tzdata.zoneinfo").joinpath(zone).read_bytes()
    counts = lambda at: struct.unpack_from(">6l", data, at + 20)
    at, width = 0, 4
    if data[4:5] >= b"2":  # a block of 32-bit times, then the same with 64-bit times
        utc, std, leaps, times, types, chars = counts(0)
        at, width = 44 + times * 5 + types * 6 + chars + leaps * 8 + std + utc, 8
    times = counts(at)[3]
    return list(struct.unpack_from(f">{times}{'q' if width == 8 else 'l'}", data, at + 44))


def offset_changes(zone: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[tuple[int, int]]:
    """(second since 1970 from which it holds, offset in seconds) of a zone; the first holds from ever."""
    tz = zoneinfo.ZoneInfo(zone)

    def offset(second: int) -> int:
        return int((_EPOCH + dt.timedelta(seconds=second)).astimezone(tz).utcoffset().total_seconds())

    at = int((dt.datetime(first, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds()) - 2 * 86400
    end = int((dt.datetime(last + 1, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds()) + 2 * 86400
    now = offset(at)
    out = [(at, now)]
    for t in _listed_changes(zone):
        if at < t < end:
            at = t
            if (then := offset(t)) != now:
                out.append((t, then))
                now = then
    step = 7 * 86400  # a yearly rule keeps each offset for longer
    while at < end:
        then = offset(at + step)
        if then != now:
            k = bisect.bisect_left(range(at, at + step + 1), True, key=lambda t, old=now: offset(t) != old)
            out.append((at + k, then))
        at, now = at + step, then
    return out


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    far = 10**18
    known = zoneinfo.available_timezones()
    for batch in batches:
        for zone in batch["tz"]:
            if zone not in known:
                continue
            rows = []
            changes = offset_changes(zone)
            for i, (start, off) in enumerate(changes):
                lo = (start + off) * _US if i else -far
                hi = (changes[i + 1][0] + off) * _US if i + 1 < len(changes) else far
                years = range(
                    FIRST_YEAR if i == 0 else max(FIRST_YEAR, (_EPOCH + dt.timedelta(seconds=start + off)).year),
                    (LAST_YEAR if i + 1 == len(changes) else min(LAST_YEAR, (_EPOCH + dt.timedelta(seconds=changes[i + 1][0] + off)).year)) + 1,
                )
                rows += [(zone, y, lo, hi, off * _US) for y in years]
            yield pd.DataFrame(rows, columns=["tz", "local_year", "from_us", "to_us", "off_us"])


def _looked_up(year: Column, new_year: Column) -> tuple[Column, Column]:
    """(the year whose intervals hold in ``year``, the days from its New Year to ``new_year``, that of ``year``)."""
    leap = ((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))).cast("int")
    alike = {(y % 4 == 0) * 7 + dt.date(y, 1, 1).weekday(): y for y in RULE_YEARS}
    by_calendar = lambda values: F.get(F.array(*(F.lit(v) for v in values)), leap * 7 + F.weekday(new_year))
    ruled = year > LAST_YEAR
    stands = F.when(ruled, by_calendar([alike[k] for k in range(14)])).otherwise(F.greatest(year, F.lit(FIRST_YEAR)))
    first_day = by_calendar([dt.date(alike[k], 1, 1).toordinal() - _EPOCH.toordinal() for k in range(14)])
    return stands, F.when(ruled, F.unix_date(new_year) - first_day).otherwise(0)


def zone_offsets(zones: DataFrame) -> DataFrame:
    """Per zone in column ``tz`` of ``zones`` and local year: ``stretches``, the array of (from_us, to_us, off_us) that touch
    it. Null and names outside the zone database give no rows."""
    return (
        zones.select("tz").where("tz IS NOT NULL").distinct().mapInPandas(_intervals, "tz string, local_year int, from_us bigint, to_us bigint, off_us bigint")
        .groupBy("tz", "local_year")
        .agg(F.array_sort(F.collect_list(F.struct("from_us", "to_us", "off_us"))).alias("stretches"))
    )


def to_utc(df: DataFrame, text: Column, zone: Column, date_order: Column) -> DataFrame:
    """``df`` with ``utc_us`` (the one instant, or null) and ``time_case``.

    ``time_case`` is ``number``, ``offset`` (written in the text), ``zone`` (one interval), ``ambiguous`` (two), ``never``
    (none), ``no_zone`` (none known) or ``no_time`` (null or no real date with a time of day). An offset in the text
    holds before a zone in the text, which holds before ``zone``; zone names outside the zone database are unknown.
    Every row of ``df`` comes out once; columns of ``df`` named like the added ones are replaced.
    """
    named = df.where(text.rlike(_BRACKETS)).select(F.regexp_extract(text, _BRACKETS, 1).alias("tz"))
    zones = df.select(zone.alias("tz")).distinct().unionByName(named.distinct())
    parsed = split_time(df.drop("utc_us", "time_case").withColumns({"_text_zone": zone}), text, date_order)
    t = F.col("_local_us")
    parsed = once(parsed, _tz=F.when(t.isNotNull() & F.col("_offset_us").isNull(), F.coalesce("_zone", "_text_zone")))
    day = F.date_add(F.lit(dt.date(1970, 1, 1)), ((t - F.pmod(t, F.lit(_DAY_US))) / F.lit(_DAY_US)).cast("int"))
    parsed = once(parsed, _new_year=F.when(F.col("_tz").isNotNull(), F.trunc(day, "year")))
    stands, moved = _looked_up(F.year("_new_year"), F.col("_new_year"))
    parsed = once(parsed, _year=stands, _at=t - moved.cast("bigint") * _DAY_US)
    offsets = zone_offsets(zones).select(F.col("tz").alias("_otz"), F.col("local_year").alias("_oyear"), "stretches")
    joined = parsed.join(F.broadcast(offsets), (F.col("_tz") == F.col("_otz")) & (F.col("_year") == F.col("_oyear")), "left")
    joined = once(joined, _fits=F.filter("stretches", lambda x: (x["from_us"] <= F.col("_at")) & (F.col("_at") < x["to_us"])))
    case = (
        F.when(F.col("_epoch_us").isNotNull(), "number")
        .when(t.isNull(), "no_time")
        .when(F.col("_offset_us").isNotNull(), "offset")
        .when(F.col("_fits").isNull(), "no_zone")
        .when(F.size("_fits") == 1, "zone")
        .when(F.size("_fits") > 1, "ambiguous")
        .otherwise("never")
    )
    joined = once(joined, time_case=case)
    utc = (
        F.when(F.col("time_case") == "number", F.col("_epoch_us"))
        .when(F.col("time_case") == "offset", t - F.col("_offset_us"))
        .when(F.col("time_case") == "zone", t - F.col("_fits")[0]["off_us"])
    )
    return joined.select(*(c for c in df.columns if c not in ("utc_us", "time_case")), utc.alias("utc_us"), "time_case")
