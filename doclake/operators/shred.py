"""Nested JSON records as columns with repetition and definition levels, and back to related flat tables.

A record is striped into one column per leaf path, in one pass. A path is a list of steps: ``/name`` for a field of an object, ``*``
for the members of an array. Each entry of a column has a repetition level (the count of the ``*`` step at which it
repeats, 0 for the first entry of a record), a definition level (how many steps of the path exist) and, where the whole
path exists, a value; neighbouring entries that tell the same absence are one with a count. The tables are rebuilt from these sequences alone: counting repetitions gives each member's
index, the definition level gives the ancestors that exist.

Defined cases: null, blank, broken or truncated text, text after the value, bare ``NaN``/``Infinity`` and any top
value that isn't an object give no record; a JSON string whose content is one whole object counts as that object;
of repeated names in one object the last counts; lone surrogates become U+FFFD; the same content under two record
keys counts for each; an empty table gives an empty table. Nesting and number length aren't limited. A record is
handled in one task: its work grows with its values, and with the runs of absence between those of a rare path.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER = "*"
#: Kinds of an entry's value: scalar kinds, the two empty containers, and '' where the path isn't wholly there.
NULL, STRING, NUMBER, BOOLEAN, EMPTY_OBJECT, EMPTY_ARRAY, ABSENT = "n", "s", "d", "b", "o", "a", ""
_SCALARS = frozenset((NULL, STRING, NUMBER, BOOLEAN))


class _Number(str):
    """A number, as it is written."""


def _refuse(text: str) -> None:
    raise ValueError(text)


_decoder = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_LITERALS = {"true": True, "false": False, "null": None}


def _loads_deep(s: str):
    """Strict JSON without recursion, for nesting deeper than the library's parser goes."""
    at = _SPACE.match(s, 0).end()
    stack: list = []  # [container, pending name]
    while True:
        ch = s[at : at + 1]
        if ch == "{" or ch == "[":
            box = {} if ch == "{" else []
            at = _SPACE.match(s, at + 1).end()
            stack.append([box, None])
            if s[at : at + 1] == ("}" if ch == "{" else "]"):
                at += 1
                value = stack.pop()[0]
            else:
                if ch == "{":
                    at = _name(s, at, stack)
                continue
        elif ch == '"':
            value, at = scanstring(s, at + 1, True)
        elif m := _NUMBER.match(s, at):
            value, at = _Number(m[0]), m.end()
        else:
            word = next((w for w in _LITERALS if s.startswith(w, at)), None)
            if word is None:
                raise ValueError("value")
            value, at = _LITERALS[word], at + len(word)
        while True:
            at = _SPACE.match(s, at).end()
            if not stack:
                if at != len(s):
                    raise ValueError("more text")
                return value
            box, name = stack[-1]
            if isinstance(box, dict):
                box[name] = value
            else:
                box.append(value)
            ch = s[at : at + 1]
            at = _SPACE.match(s, at + 1).end()
            if ch == ",":
                if isinstance(box, dict):
                    at = _name(s, at, stack)
                break
            if ch != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("end")
            value = stack.pop()[0]


def _name(s: str, at: int, stack: list) -> int:
    if s[at : at + 1] != '"':
        raise ValueError("name")
    stack[-1][1], at = scanstring(s, at + 1, True)
    at = _SPACE.match(s, at).end()
    if s[at : at + 1] != ":":
        raise ValueError("colon")
    return _SPACE.match(s, at + 1).end()


def _loads(s: str):
    try:
        at = _SPACE.match(s, 0).end()
        value, end = _decoder.raw_decode(s, at)
    except RecursionError:
        return _loads_deep(s)
    if _SPACE.match(s, end).end() != len(s):
        raise ValueError("more text")
    return value


def parse_record(text: str | None) -> dict | None:
    """The object that ``text`` holds, directly or as the content of one JSON string; None if it holds none."""
    if not text:
        return None
    try:
        value = _loads(text)
        if type(value) is str:
            value = _loads(value)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _clean(s: str) -> str:
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _scalar(v) -> tuple[str, str | None]:
    if v is None:
        return NULL, None
    if v is True or v is False:
        return BOOLEAN, "true" if v else "false"
    if isinstance(v, _Number):
        return NUMBER, str(v)
    return STRING, _clean(v)


class Column:
    """One leaf path of a record: ``path`` and, entry by entry, repetition level, definition level, kind, value and count.

    Neighbouring entries that say the same absence are one, counted in ``runs``; of all others the count is 1.
    """

    __slots__ = ("path", "reps", "defs", "kinds", "vals", "runs")

    def __init__(self, path: list[str]):
        self.path = path
        self.reps: list[int] = []
        self.defs: list[int] = []
        self.kinds: list[str] = []
        self.vals: list[str | None] = []
        self.runs: list[int] = []

    def absent(self, rep: int, depth: int, n: int) -> None:
        if self.runs and self.kinds[-1] == ABSENT and self.reps[-1] == rep and self.defs[-1] == depth:
            self.runs[-1] += n
        else:
            self.add(rep, depth, ABSENT, None, n)

    def add(self, rep: int, depth: int, kind: str, value: str | None, n: int = 1) -> None:
        self.reps.append(rep)
        self.defs.append(depth)
        self.kinds.append(kind)
        self.vals.append(value)
        self.runs.append(n)


class _Place:
    """A step of the record's schema: how often it was passed, and what of that its children have taken over.

    ``log`` holds runs [repetition level, definition level, whether it is there, count]. A child takes over what it missed
    only when it is there again, so a field that is rare costs its own entries and the runs between them.
    """

    __slots__ = ("parent", "step", "kids", "column", "log", "run", "off", "leaf_run", "leaf_off")

    def __init__(self, parent: _Place | None, step: str):
        self.parent, self.step = parent, step
        self.kids: dict[str, _Place] = {}
        self.column: Column | None = None
        self.log: list[list] = []
        self.run = self.off = self.leaf_run = self.leaf_off = 0

    def passed(self, rep: int, depth: int, there: bool, n: int = 1) -> None:
        log = self.log
        if log and (last := log[-1])[0] == rep and last[1] == depth and last[2] == there:
            last[3] += n
        else:
            log.append([rep, depth, there, n])

    def path(self) -> list[str]:
        steps, at = [], self
        while at.parent is not None:
            steps.append(at.step)
            at = at.parent
        return steps[::-1]


def _missed(log: list[list], run: int, off: int, keep: int) -> Iterator[tuple[int, int, bool, int]]:
    """The runs of ``log`` from (run, off) on, but for the last ``keep`` entries."""
    last = len(log) - 1
    for r in range(run, last + 1):
        rep, depth, there, n = log[r]
        n -= (off if r == run else 0) + (keep if r == last else 0)
        if n > 0:
            yield rep, depth, there, n


def _take_over(place: _Place, keep: int) -> None:
    log = place.parent.log
    for rep, depth, _, n in _missed(log, place.run, place.off, keep):
        place.passed(rep, depth, False, n)
    place.run, place.off = len(log) - 1, log[-1][3]


def _take_over_leaf(place: _Place, keep: int) -> None:
    log = place.log
    for rep, depth, there, n in _missed(log, place.leaf_run, place.leaf_off, keep):
        # There in another shape: all but the last step is told by this column.
        place.column.absent(rep, max(depth - 1, 0) if there else depth, n)
    place.leaf_run, place.leaf_off = len(log) - 1, log[-1][3]


_steps: dict[str, str] = {}


def _step(name: str) -> str:
    step = _steps.get(name)
    if step is None:
        if len(_steps) > 100_000:
            _steps.clear()
        step = _steps[name] = "/" + _clean(name)
    return step


def stripe(record: dict, ends: bool = True) -> list[Column]:
    """The columns of one record, in order of first sight; one pass, without recursion, linear in the record's values.

    The schema is the record's own: every shape that a path takes anywhere in it is a path. Without ``ends`` columns stop
    at their last value: absences after it tell of nothing that another column doesn't hold.
    """
    root = _Place(None, "")
    columns: list[Column] = []
    places = [root]
    # (value, place, repetition level, definition level, depth of '*')
    walk: list[tuple] = [(record, root, 0, 0, 0)]
    pop, push = walk.pop, walk.append
    while walk:
        v, place, rep, depth, stars = pop()
        parent = place.parent
        if parent is not None:
            log = parent.log
            passed = log[-1][3]
            if place.run != len(log) - 1 or place.off < passed - 1:
                _take_over(place, 1)
            else:
                place.off = passed
        place.passed(rep, depth, True)
        kind = type(v)
        if kind is dict and v:
            kids = place.kids
            for name, x in reversed(v.items()):
                step = _steps.get(name) or _step(name)
                kid = kids.get(step)
                if kid is None:
                    kid = kids[step] = _Place(place, step)
                    places.append(kid)
                push((x, kid, rep, depth + 1, stars))
        elif kind is list and v:
            kid = place.kids.get(MEMBER)
            if kid is None:
                kid = place.kids[MEMBER] = _Place(place, MEMBER)
                places.append(kid)
            again = stars + 1
            for x in reversed(v[1:]):
                push((x, kid, again, depth + 1, again))
            push((v[0], kid, rep, depth + 1, again))
        else:
            if place.column is None:
                place.column = Column(place.path())
                columns.append(place.column)
            if place.leaf_run != len(place.log) - 1 or place.leaf_off != place.log[-1][3] - 1:
                _take_over_leaf(place, 1)
            else:
                place.leaf_off += 1
            if kind is _Number:
                place.column.add(rep, depth, NUMBER, str(v))
            elif kind is str:
                place.column.add(rep, depth, STRING, v if v.isascii() else _clean(v))
            elif v is None:
                place.column.add(rep, depth, NULL, None)
            elif kind is bool:
                place.column.add(rep, depth, BOOLEAN, "true" if v else "false")
            else:
                place.column.add(rep, depth, EMPTY_OBJECT if kind is dict else EMPTY_ARRAY, None)
    if ends:
        for place in places:  # parents come first
            if place.parent is not None:
                _take_over(place, 0)
            if place.column is not None:
                _take_over_leaf(place, 0)
    return columns


def _escape(step: str) -> str:
    return "/" + step[1:].replace("~", "~0").replace("/", "~1")


def assemble(columns: list[Column], scalars: bool = True) -> Iterator[tuple[str, str, str, int | None, str | None, str, str | None]]:
    """What the level sequences hold: (table, node, parent node, index, field, kind, value), one for each inner object
    and array member where it first appears (field None) and, if asked, one for each scalar, at its nearest node.

    The table of a node is its path with ``*`` for indices. Scalars of the record itself belong to the node ''. Absences
    only move the counters: what an absent path ends at has a value in another column, or is empty, which is one.
    """
    seen: set[str] = set()
    for column in columns:
        path = column.path
        n = len(path)
        stars = [i for i, s in enumerate(path) if s == MEMBER]
        names = ["/*" if s == MEMBER else _escape(s) for s in path]
        # The prefixes of the path that are nodes: members, and fields that hold an object. Of each: the '*' steps in it,
        # what follows the last of them, its table.
        at_nodes, passed, since = [], 0, 0
        for i in range(n):
            if path[i] == MEMBER:
                passed, since = passed + 1, i + 1
            if path[i] == MEMBER or i + 1 == n or path[i + 1] != MEMBER:
                at_nodes.append((i, passed, "".join(names[since : i + 1]), "".join(names[: i + 1])))
        between, since = [], 0
        for i in stars:
            between.append("".join(names[since:i]))
            since = i + 1
        index = [0] * len(stars)
        base = [""] * (len(stars) + 1)  # pointers up to each '*' step
        pointer = [""] * len(at_nodes)
        stale = 0  # from which '*' step on the pointers aren't up to date; -1 at first: all nodes
        first = True
        ends_in_member = n > 0 and path[-1] == MEMBER
        for rep, kind, value, count in zip(column.reps, column.kinds, column.vals, column.runs, strict=True):
            if rep:
                index[rep - 1] += count
                if rep < len(stars):
                    index[rep:] = [0] * (len(stars) - rep)
                if rep - 1 < stale:
                    stale = rep - 1
            else:
                stale = 0
            if kind == ABSENT:
                continue
            for k in range(stale, len(stars)):
                base[k + 1] = f"{base[k]}{between[k]}/{index[k]}"
            for j, (i, passed, rest, table) in enumerate(at_nodes):
                if passed <= stale and not first:
                    continue
                node = pointer[j] = base[passed] + rest
                if i + 1 == n and not ends_in_member and kind != EMPTY_OBJECT:
                    break  # a field with a scalar or an empty array is no node
                if node not in seen:
                    seen.add(node)
                    member = path[i] == MEMBER
                    yield table, node, (pointer[j - 1] if j else ""), (index[passed - 1] if member else None), None, (kind if i + 1 == n else ""), None
            first = False
            stale = len(stars)
            if scalars and kind in _SCALARS:
                if ends_in_member:
                    yield at_nodes[-1][3], pointer[-1], "", None, "", kind, value
                else:
                    above = len(at_nodes) - 2  # the last one is the scalar's own path
                    yield (at_nodes[above][3] if above >= 0 else ""), (pointer[above] if above >= 0 else ""), "", None, (path[-1][1:] if n else ""), kind, value


_STRINGS, _INTS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
_COLUMNS = T.ArrayType(T.StructType([T.StructField(f, t) for f, t in (("path", _STRINGS), ("reps", _INTS), ("defs", _INTS), ("kinds", _STRINGS), ("vals", _STRINGS), ("runs", _INTS))]))
_PA_COLUMNS = pa.list_(
    pa.struct([("path", pa.list_(pa.string())), ("reps", pa.list_(pa.int32())), ("defs", pa.list_(pa.int32())), ("kinds", pa.list_(pa.string())), ("vals", pa.list_(pa.string())), ("runs", pa.list_(pa.int32()))])
)
#: Rows of output held at a time by a Python worker.
_ROWS = 20_000


def _per_record(df: DataFrame, keys: list[str], text: str, fields: list[T.StructField], types: list[pa.DataType], rows_of) -> DataFrame:
    """``keys`` and ``fields`` of every row that ``rows_of`` gives for the records of ``df``."""
    schema = T.StructType([*(df.schema[k] for k in keys), *fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_columns = batch.select(list(range(len(keys))))
            source: list[int] = []
            out: list[tuple] = []

            def flush():
                cols = list(zip(*out, strict=True)) if out else [()] * len(types)
                made = pa.RecordBatch.from_arrays([*key_columns.take(pa.array(source, pa.int64())).columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)
                source.clear()
                out.clear()
                return made

            for i, s in enumerate(batch.column(len(keys))):
                record = parse_record(s.as_py())
                if record is None:
                    continue
                before = len(out)
                for row in rows_of(record):
                    out.append(row)
                    if len(out) >= _ROWS:
                        source.extend([i] * (len(out) - before))
                        yield flush()
                        before = 0
                source.extend([i] * (len(out) - before))
            if out:
                yield flush()

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def shred(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per valid record of ``df``: its ``keys`` and ``columns``, its leaf columns with their levels."""
    columns_of = lambda record: [([{f: getattr(c, f) for f in Column.__slots__} for c in stripe(record)],)]
    return _per_record(df, keys, text, [T.StructField("columns", _COLUMNS)], [_PA_COLUMNS], columns_of)


def nodes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every inner object and array member of the records in column ``text``: ``keys``, ``node`` and ``parent_node`` (JSON
    Pointers), from the records' columns."""
    string = T.StringType()
    pairs = lambda record: ((row[1], row[2]) for row in assemble(stripe(record, ends=False), scalars=False))
    return _per_record(df, keys, text, [T.StructField("node", string), T.StructField("parent_node", string)], [pa.string(), pa.string()], pairs)


def _table_rows(record: dict):
    rows: dict[str, list] = {"": ["", "", None, None, {}]}
    for table, node, parent, index, field, _, value in assemble(stripe(record, ends=False)):
        if field is None:
            row = rows.setdefault(node, [table, node, parent, index, {}])
            row[2], row[3] = parent, index
        else:
            rows.setdefault(node, [table, node, None, None, {}])[4][field] = value
    for table, node, parent, index, fields in rows.values():
        yield table, node, parent, index, list(fields.items())


def tables(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The related flat tables, one row per record, inner object and array member.

    ``table_path`` names the table ('' for the records), ``node``/``parent_node`` link the rows, ``ord`` is a member's
    index and ``fields`` holds the scalars that stand directly in the row ('' names a scalar member's own value).
    """
    string = T.StringType()
    return _per_record(
        df,
        keys,
        text,
        [T.StructField("table_path", string), T.StructField("node", string), T.StructField("parent_node", string), T.StructField("ord", T.IntegerType()), T.StructField("fields", T.MapType(string, string))],
        [pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())],
        _table_rows,
    )
