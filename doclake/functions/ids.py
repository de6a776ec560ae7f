"""Identifiers: which writings name the same record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may stand around an id: ASCII and Unicode white space. Written so that Java and RE2 read it alike.
BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: The same characters, one by one.
_BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip(c: Column) -> Column:
    """``c`` without the blanks around it."""
    return F.btrim(c, F.lit(_BLANKS))


def canonical_id(c: Column) -> Column:
    """One writing per id; null for null and blank.

    32 hex digits, with or without hyphens and in any case, become lower case hyphenated 8-4-4-4-12;
    every other id stays as written, without the blanks around it.
    """
    bare = strip(c)
    digits = F.lower(F.replace(bare, F.lit("-"), F.lit("")))
    dashed = F.concat_ws("-", *(F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    # The length is tested first: most ids of other kinds need no pattern.
    return F.when((F.length(digits) == 32) & digits.rlike("^[0-9a-f]{32}$"), dashed).when(bare != "", bare)


def canonical_id_sql(col: str) -> str:
    """:func:`canonical_id` in DuckDB's SQL."""
    bare = f"regexp_replace({col}, '^{BLANK}+|{BLANK}+$', '', 'g')"
    digits = f"lower(replace({bare}, '-', ''))"
    return (
        f"CASE WHEN regexp_full_match({digits}, '[0-9a-f]{{32}}') THEN "
        f"regexp_replace({digits}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') "
        f"WHEN {bare} <> '' THEN {bare} END"
    )
