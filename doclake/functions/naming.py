"""File-system names from titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake.functions.ids import strip

ID_PREFIX = 8
MAX_BYTES = 200
#: Base names that never stand bare, compared in lower case.
RESERVED = ("readme", "_index", "index", "assets", "_orphans", ".internal", "claude", "agents")
_ILLEGAL = r'[/\\:*?"<>|\x00-\x1F]'


def slug(title: Column) -> Column:
    """The title without characters that file systems forbid and without the blanks around it; '' for null."""
    return strip(F.regexp_replace(F.coalesce(title, F.lit("")), _ILLEGAL, ""))


def id_prefix(id_: Column) -> Column:
    """The first 8 characters of what follows the id's last ':' (of the whole id when that ends it), as a slug."""
    tail = F.substring_index(id_, ":", -1)
    return F.left(slug(F.when(tail == "", id_).otherwise(tail)), F.lit(ID_PREFIX))


def truncate_bytes(text: Column, n: Column) -> Column:
    """The longest start of ``text`` that takes at most ``n`` bytes of UTF-8 and splits no character."""
    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.octet_length(F.left(text, i)) <= n)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.left(text, F.coalesce(F.array_max(fits), F.lit(0))))


def base_name(title: Column, id_: Column) -> tuple[Column, Column]:
    """(name before siblings are looked at, whether it carries the id already)."""
    base = slug(title)
    suffix = F.concat(F.lit("-"), id_prefix(id_))
    long = F.octet_length(base) > MAX_BYTES
    forced = (base == "") | F.lower(base).isin(*RESERVED) | long
    name = (
        F.when(base == "", F.concat(F.lit("untitled"), suffix))
        .when(long, F.concat(truncate_bytes(base, F.lit(MAX_BYTES) - F.octet_length(suffix)), suffix))
        .when(forced, F.concat(base, suffix))
        .otherwise(base)
    )
    return name, forced
