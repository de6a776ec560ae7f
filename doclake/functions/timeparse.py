"""Times written as text: what the text says, before any zone is applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.ids import strip

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*(Z|z|UTC|GMT|[+\-\x{2212}]\d{2}(?::?\d{2})?)?\s*(?:\[([^\]]+)\])?"
_WEEKDAY = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
_MONTH = r"([A-Za-z]{3,9})\.?"
_ORDINAL = r"(?:st|nd|rd|th)?"

#: Writings, tried in order: name, pattern (Java and RE2), and the group numbers of
#: year, month, day, hour, minute, second, fraction, half of the day, offset, zone (0: not written).
WRITINGS = (
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|,?\s+){_CLOCK}{_HALF}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("han", rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*(上午|下午)?\s*(\d{{1,2}})[:时](\d{{1,2}})分?(?::?(\d{{1,2}})秒?(?:[.,](\d+))?)?{_ZONE}$", (1, 2, 3, 5, 6, 7, 8, 4, 9, 10)),
    ("numeric", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(?:[Tt]|,?\s+){_CLOCK}{_HALF}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    ("day_month", rf"^{_WEEKDAY}(\d{{1,2}}){_ORDINAL}[\s-]+{_MONTH},?[\s-]+(\d{{4}}),?\s+(?:at\s+)?{_CLOCK}{_HALF}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    ("month_day", rf"^{_WEEKDAY}{_MONTH}\s+(\d{{1,2}}){_ORDINAL},?\s+(\d{{4}}),?\s+(?:at\s+)?{_CLOCK}{_HALF}{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
)
EPOCH = r"^([+-]?)(\d{1,30})(?:\.(\d+))?$"
#: Seconds since 1970 of the earliest and the first too late date that a bare number may mean in a finer unit.
PRESENT = (946_684_800, 4_102_444_800)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each evaluated once per row: a generator keeps the optimizer from copying the expressions
    into every place that uses them, which for chains of regular expressions grows without bound."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def split_time(df: DataFrame, text: Column, date_order: Column) -> DataFrame:
    """``df`` with what a time text says: ``_epoch_us`` (a bare number), or ``_local_us`` with ``_offset_us`` or ``_zone``.

    ``_local_us`` counts microseconds from 1970-01-01 00:00 on the clock that the text shows. All four are null for null,
    for text that is no time, that has no time of day, or whose fields aren't a real date and time. Finer digits than
    microseconds are cut off; parts of the time that aren't written are 0. All-numeric dates that don't begin with the
    year need ``date_order`` (``dmy`` or ``mdy``).
    """
    columns = df.columns
    df = once(df, _s=strip(text), _order=date_order)
    s = F.col("_s")
    flat = F.lit(None).cast("string")
    for name, pattern, groups in reversed(WRITINGS):
        parts = "|".join([name, *(f"${g}" if g else "" for g in groups)])
        flat = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, parts)).otherwise(flat)
    df = once(df, _p=F.split(flat, r"\|", 11))
    p = F.col("_p")
    first, second = p[2], p[3]
    swap = (p[0] == "numeric") & (F.col("_order") == "mdy")
    word = F.lower(first)
    named = F.coalesce(*(F.when(word.isin(m, m[:3], "sept" if m == "september" else m), F.lit(i)) for i, m in enumerate(MONTHS, 1)))
    half = F.lower(p[8])
    hour12 = p[4].try_cast("int")
    off = F.upper(F.replace(p[9], F.lit("\u2212"), F.lit("-")))
    is_number = s.rlike(EPOCH)
    digits, fraction = F.regexp_extract(s, EPOCH, 2), F.regexp_extract(s, EPOCH, 3)
    df = once(
        df,
        _year=p[1].try_cast("int"),
        _month=F.when(p[0].isin("day_month", "month_day"), named).when(swap, second.try_cast("int")).otherwise(first.try_cast("int")),
        _day=F.when(swap, first.try_cast("int")).otherwise(second.try_cast("int")),
        _hour=F.when(half == "", hour12).when(hour12.between(1, 12), (hour12 % 12) + F.when(half.isin("p", "\u4e0b\u5348"), 12).otherwise(0)),
        _minute=p[5].try_cast("int"),
        _second=F.when(p[6] == "", 0).otherwise(p[6].try_cast("int")),
        _micro=F.when(p[7] == "", 0).otherwise(F.rpad(F.substring(p[7], 1, 6), 6, "0").try_cast("int")),
        _ordered=(p[0] != "numeric") | F.col("_order").isin("dmy", "mdy"),
        _off=off,
        _off_h=F.substring(off, 2, 2).try_cast("int"),
        _off_m=F.coalesce(F.substring(F.replace(off, F.lit(":"), F.lit("")), 4, 2).try_cast("int"), F.lit(0)),
        _sign=F.when(is_number, F.when(F.regexp_extract(s, EPOCH, 1) == "-", -1).otherwise(1)),
        _whole=F.when(is_number, digits).try_cast("decimal(30,0)"),
        _exact=F.when(is_number, F.concat(digits, F.lit("."), F.rpad(F.substring(fraction, 1, 7), 7, "0"))).try_cast("decimal(37,7)"),
    )
    real_month = F.col("_year").between(1, 9999) & F.col("_month").between(1, 12)
    df = once(df, _first_day=F.when(real_month, F.make_date(F.when(real_month, F.col("_year")), F.when(real_month, F.col("_month")), F.lit(1))))
    off_sign = F.when(F.col("_off").startswith("-"), -1).otherwise(1)
    lo, hi = PRESENT
    w = F.col("_whole")
    up = F.col("_sign") > 0
    unit = F.when(up & w.between(lo * 10**3, hi * 10**3 - 1), 3).when(up & w.between(lo * 10**6, hi * 10**6 - 1), 6).when(up & w.between(lo * 10**9, hi * 10**9 - 1), 9).otherwise(0)
    scaled = F.col("_exact") * F.col("_sign")
    df = once(
        df,
        _good=F.col("_ordered") & (F.col("_day") >= 1) & (F.col("_day") <= F.dayofmonth(F.last_day("_first_day"))) & F.col("_hour").between(0, 23) & F.col("_minute").between(0, 59) & F.col("_second").between(0, 59),
        _offset_all=F.when(F.col("_off").isin("Z", "UTC", "GMT"), F.lit(0).cast("bigint")).when((F.col("_off") != "") & (F.col("_off_h") <= 18) & (F.col("_off_m") < 60), (F.col("_off_h") * 3600 + F.col("_off_m") * 60).cast("bigint") * off_sign * 1_000_000),
        _unit=unit,
        _scaled=scaled,
    )
    good = F.col("_good") & ~((F.col("_off") != "") & F.col("_offset_all").isNull())
    seconds = (F.unix_date("_first_day").cast("bigint") + F.col("_day") - 1) * 86400 + F.col("_hour") * 3600 + F.col("_minute") * 60 + F.col("_second")
    x = F.col("_scaled")
    us = (
        F.when(F.col("_unit") == 0, F.floor(x * F.lit(1_000_000).cast("decimal(7,0)")))
        .when(F.col("_unit") == 3, F.floor(x * F.lit(1000).cast("decimal(4,0)")))
        .when(F.col("_unit") == 6, F.floor(x))
        .otherwise(F.floor(x / F.lit(1000).cast("decimal(4,0)")))
    )
    out = once(
        df,
        _epoch_us=us.try_cast("bigint"),
        _local_us=F.when(good, seconds * 1_000_000 + F.col("_micro")),
        _offset_us=F.when(good, F.col("_offset_all")),
        _zone=F.when(good & (p[10] != ""), p[10]),
    )
    return out.select(*columns, "_epoch_us", "_local_us", "_offset_us", "_zone")
