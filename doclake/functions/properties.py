"""Typed property values and table cells as plain text."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from doclake.functions.ids import canonical_id
from doclake.functions.text import number_text

_DATE = "start: string, `end`: string"
_PERSON = "id: string, name: string"
#: Every arm of a property value; rollup members stay JSON text.
VALUE = (
    "type string, rich_text array<struct<plain_text: string>>, number double, select struct<name: string>, status struct<name: string>, "
    f"multi_select array<struct<name: string>>, date struct<{_DATE}>, checkbox boolean, url string, email string, phone_number string, "
    f"people array<struct<{_PERSON}>>, files array<struct<name: string>>, relation array<struct<id: string>>, "
    f"formula struct<type: string, string: string, number: double, boolean: boolean, date: struct<{_DATE}>>, "
    f"rollup struct<type: string, number: double, date: struct<{_DATE}>, array: array<string>>, created_time string, last_edited_time string, "
    f"created_by struct<{_PERSON}>, last_edited_by struct<{_PERSON}>, unique_id struct<prefix: string, number: bigint>"
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bracketed(items: Column) -> Column:
    """``[a, b]``; ``[]`` for none and for null."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(items, ", ", ""), F.lit("")), F.lit("]"))


def _date(d: Column) -> Column:
    start, end = _text(d["start"]), _text(d["end"])
    return F.when(start == "", "").when(end == "", start).otherwise(F.concat(start, F.lit("/"), end))


def _person(p: Column) -> Column:
    return F.coalesce(F.nullif(p["name"], F.lit("")), p["id"], F.lit(""))


def render_value(raw: Column) -> Column:
    """One property value (JSON text) as plain text, by its type.

    Null values give ''; types that aren't known give ``<unsupported: T>``. The members of a
    rollup are rendered alike, at any depth; only those leave the JVM.
    """
    v = F.from_json(raw, VALUE)
    t = _text(v["type"])
    f, r, u = v["formula"], v["rollup"], v["unique_id"]
    formula = (
        F.when(f.isNull(), "")
        .when(f["type"] == "string", _text(f["string"]))
        .when(f["type"] == "number", number_text(f["number"]))
        .when(f["type"] == "boolean", F.when(f["boolean"], "true").otherwise("false"))
        .when(f["type"] == "date", _date(f["date"]))
        .otherwise(F.concat(F.lit("<unsupported: formula/"), _text(f["type"]), F.lit(">")))
    )
    rollup = (
        F.when(r.isNull(), "")
        .when(r["type"] == "number", number_text(r["number"]))
        .when(r["type"] == "date", _date(r["date"]))
        .when(r["type"] == "array", render_nested(F.when(r["type"] == "array", raw)))
        .otherwise(F.concat(F.lit("<rollup: "), _text(r["type"]), F.lit(">")))
    )
    unique = F.when(u["number"].isNull(), "").when(_text(u["prefix"]) != "", F.concat(u["prefix"], F.lit("-"), u["number"].cast("string"))).otherwise(u["number"].cast("string"))
    plain = ("url", "email", "phone_number", "created_time", "last_edited_time")
    out = F.when(~F.coalesce(raw.startswith("{"), F.lit(False)) | v.isNull(), "<unsupported: unparseable>").when(t == "rich_text", _text(F.array_join(F.transform(v["rich_text"], lambda x: _text(x["plain_text"])), "")))
    out = out.when(t == "number", number_text(v["number"]))
    for k in ("select", "status"):
        out = out.when(t == k, _text(v[k]["name"]))
    for k in ("multi_select", "files"):
        out = out.when(t == k, bracketed(F.transform(v[k], lambda x: _text(x["name"]))))
    out = out.when(t == "people", bracketed(F.transform(v["people"], lambda x: _person(x))))
    out = out.when(t == "relation", bracketed(F.transform(v["relation"], lambda x: _text(canonical_id(x["id"])))))
    out = out.when(t == "date", _date(v["date"])).when(t == "checkbox", F.when(v["checkbox"], "true").otherwise("false"))
    for k in plain:
        out = out.when(t == k, _text(v[k]))
    for k in ("created_by", "last_edited_by"):
        out = out.when(t == k, _person(v[k]))
    out = out.when(t == "formula", formula).when(t == "rollup", rollup).when(t == "unique_id", unique)
    return out.otherwise(F.concat(F.lit("<unsupported: "), t, F.lit(">")))


def shortest_number(x) -> str:
    """A number in plain decimal notation."""
    if x is None:
        return ""
    s = format(Decimal(repr(float(x))), "f")
    s = s.rstrip("0").rstrip(".") if "." in s else s
    return "0" if s == "-0" else s


def _name(p) -> str:
    return (p.get("name") or p.get("id") or "") if isinstance(p, dict) else ""


def _span(d) -> str:
    start, end = (d.get("start") or "", d.get("end") or "") if isinstance(d, dict) else ("", "")
    return "" if not start else f"{start}/{end}" if end else start


def _canonical(s) -> str:
    s = (s or "").strip()
    h = s.replace("-", "").lower()
    if len(h) == 32 and not set(h) - set("0123456789abcdef"):
        return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    return s


def _listed(items) -> str:
    return "[" + ", ".join(items) + "]"


def render_parsed(v) -> str:
    """:func:`render_value` for a parsed value, to any depth."""
    if not isinstance(v, dict):
        return "<unsupported: unparseable>"
    t = v.get("type") or ""
    x = v.get(t)
    match t:
        case "rich_text":
            return "".join((r.get("plain_text") or "") for r in x if isinstance(r, dict)) if isinstance(x, list) else ""
        case "number":
            return shortest_number(x)
        case "select" | "status":
            return (x.get("name") or "") if isinstance(x, dict) else ""
        case "multi_select" | "files":
            return _listed((i.get("name") or "") if isinstance(i, dict) else "" for i in x or [])
        case "people":
            return _listed(_name(i) for i in x or [])
        case "relation":
            return _listed(_canonical(i.get("id")) if isinstance(i, dict) else "" for i in x or [])
        case "date":
            return _span(x)
        case "checkbox":
            return "true" if x is True else "false"
        case "url" | "email" | "phone_number" | "created_time" | "last_edited_time":
            return x or ""
        case "created_by" | "last_edited_by":
            return _name(x)
        case "unique_id":
            n = x.get("number") if isinstance(x, dict) else None
            return "" if n is None else f"{x['prefix']}-{n}" if x.get("prefix") else str(n)
        case "formula" | "rollup":
            if not isinstance(x, dict):
                return ""
            k = x.get("type") or ""
            if k == "number":
                return shortest_number(x.get("number"))
            if k == "date":
                return _span(x.get("date"))
            if t == "formula":
                return (x.get("string") or "") if k == "string" else ("true" if x.get("boolean") is True else "false") if k == "boolean" else f"<unsupported: formula/{k}>"
            return _listed(render_parsed(i) for i in x.get("array") or []) if k == "array" else f"<rollup: {k}>"
    return f"<unsupported: {t}>"


def _rendered(s: str | None) -> str | None:
    if s is None:
        return None
    try:
        return render_parsed(json.loads(s))
    except (ValueError, RecursionError):
        return "<unsupported: unparseable>"


@pandas_udf(T.StringType())
def render_nested(s: pd.Series) -> pd.Series:
    return s.map(_rendered, na_action="ignore")


#: The keys of a cell's object that hold its text, first one first.
CELL_KEYS = ("text", "name", "en_name", "link", "url", "full_address")


def flatten_cell(v) -> str:
    """A table cell's value as text."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(int(v)) if float(v).is_integer() and abs(v) < 2**63 else repr(float(v))
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return " ".join(s for s in map(flatten_cell, v) if s)
    for k in CELL_KEYS:
        if isinstance(v.get(k), str) and v[k]:
            return v[k]
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _cell(s: str | None) -> str:
    if not s:
        return ""
    try:
        return flatten_cell(json.loads(s))
    except (ValueError, RecursionError):
        return s.strip()


@pandas_udf(T.StringType())
def cell_text(s: pd.Series) -> pd.Series:
    return s.map(_cell)


def canonical_entries(entries: Column) -> Column:
    """(key, value) entries as one text that tells them apart: ``<bytes of key>:<key>=<value>`` a line."""
    line = lambda e: F.concat(F.octet_length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit("="), e["value"], F.lit("\n"))
    return F.array_join(F.transform(entries, line), "")


#: Between a row's body and its properties in what is hashed.
ROW_SEPARATOR = "\x00doclake:properties\x00"


def row_hash(body: Column, canonical: Column) -> Column:
    """The hash of a document's body, for database rows with known properties together with these; null counts as empty body."""
    text = F.coalesce(body, F.lit(""))
    return F.sha2(F.when(canonical.isNull(), text).otherwise(F.concat(text, F.lit(ROW_SEPARATOR), canonical)), 256)
