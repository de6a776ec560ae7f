import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doclake.operators import shred as S


def brute(record):
    out = {}

    def walk(v, pointer, parent, member, top=False):
        if member or (isinstance(v, dict) and not top):
            out[pointer] = parent
            parent = pointer
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, pointer + "/" + k.replace("~", "~0").replace("/", "~1"), parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{pointer}/{i}", parent, True)

    walk(record, "", "", False, True)
    return out


names = st.sampled_from(["a", "b", "c/d", "~", "", "*", "[]", "状态"])
values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=4) | st.dictionaries(names, x, max_size=4), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(names, values, max_size=4))
def test_nodes_come_back_from_the_levels(record):
    text = json.dumps(record)
    got = {node: parent for _, node, parent, _, field, _, _ in S.assemble(S.stripe(S.parse_record(text))) if field is None}
    assert got == brute(record)


def plain_columns(record):
    """All columns with every entry written out, by the definition: path by path over the whole record."""
    paths = {}

    def shapes(v, path):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                shapes(x, (*path, "/" + k))
        elif isinstance(v, list) and v:
            for x in v:
                shapes(x, (*path, "*"))
        else:
            paths[path] = None

    def entries(v, path, at, rep, stars):
        if at == len(path):
            here = not (isinstance(v, (dict, list)) and v)
            return [(rep, at if here else max(at - 1, 0), here)]
        if path[at] == "*":
            if not (isinstance(v, list) and v):
                return [(rep, at, False)]
            return [e for i, x in enumerate(v) for e in entries(x, path, at + 1, rep if i == 0 else stars + 1, stars + 1)]
        name = path[at][1:]
        return entries(v[name], path, at + 1, rep, stars) if isinstance(v, dict) and name in v else [(rep, at, False)]

    shapes(record, ())
    return {p: entries(record, p, 0, 0, 0) for p in paths}


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(names, values, max_size=4))
def test_levels_by_definition(record):
    record = S.parse_record(json.dumps(record))
    got = {tuple(c.path): [(r, d, k != S.ABSENT) for r, d, k, n in zip(c.reps, c.defs, c.kinds, c.runs) for _ in range(n)] for c in S.stripe(record)}
    assert got == plain_columns(record)
    assert list(S.assemble(S.stripe(record))) == list(S.assemble(S.stripe(record, ends=False)))


def test_an_array_of_objects_without_a_common_name_is_linear():
    record = {"a": [{f"n{i}": i} for i in range(20_000)]}
    columns = S.stripe(record)
    assert sum(len(c.runs) for c in columns) <= 4 * 20_000
    assert sum(1 for _ in S.assemble(columns, scalars=False)) == 20_000


def test_columns_as_a_table(spark):
    df = spark.createDataFrame([(1, '{"a":[{"x":1},{},{"x":2}]}'), (2, "no")], "raw_id int, text string")
    got = {tuple(c.path): (c.reps, c.defs, c.kinds, c.vals, c.runs) for r in S.shred(df, ["raw_id"], "text").collect() for c in r["columns"]}
    assert got == {
        ("/a", "*", "/x"): ([0, 1, 1], [3, 2, 3], ["d", "", "d"], ["1", None, "2"], [1, 1, 1]),
        ("/a", "*"): ([0, 1, 1], [1, 2, 1], ["", "o", ""], [None, None, None], [1, 1, 1]),
    }


@settings(max_examples=100, deadline=None)
@given(values)
def test_deep_parser_agrees(value):
    text = json.dumps(value)
    assert S._loads_deep(text) == S._decoder.decode(text)


@pytest.mark.parametrize("text", [None, "", " ", "null", "[1]", "1", "true", '{"a":1}x', '{"a":NaN}', '{"a":Infinity}', "{a:1}", '{"a":1,}', '{"a":01}', '{"a":"\n"}', '"x"', '"[1]"', '"\\"{}\\""', '{"a":', "﻿{}"])
def test_other_texts_are_no_records(text):
    assert S.parse_record(text) is None


def test_what_is_a_record():
    assert S.parse_record(' {"a":{}} \n') == {"a": {}}
    assert S.parse_record('"{\\"a\\":1}"') == {"a": "1"}
    assert S.parse_record('{"a":1,"a":2}') == {"a": "2"}
    assert S.parse_record('{"n":' + "9" * 5000 + "}") is not None
    assert S.parse_record('{"a":' + "[" * 20_000 + "]" * 20_000 + "}") is not None


def test_tables_keep_parents_and_scalars(spark):
    text = '{"p":{"k":"v","list":[1,null,{"x":true,"deep":[[2]]}]},"n":1.50,"e":[],"o":{}}'
    df = spark.createDataFrame([(1, text, "extra"), (2, text, "extra"), (3, "broken{", None), (4, None, None)], "raw_id bigint, text string, node string")
    got = {(r.raw_id, r.table_path, r.node, r.parent_node, r.ord, tuple(sorted(r.fields.items()))) for r in S.tables(df, ["raw_id"], "text").collect()}
    one = {
        ("", "", None, None, (("n", "1.50"),)),
        ("/p", "/p", "", None, (("k", "v"),)),
        ("/p/list/*", "/p/list/0", "/p", 0, (("", "1"),)),
        ("/p/list/*", "/p/list/1", "/p", 1, (("", None),)),
        ("/p/list/*", "/p/list/2", "/p", 2, (("x", "true"),)),
        ("/p/list/*/deep/*", "/p/list/2/deep/0", "/p/list/2", 0, ()),
        ("/p/list/*/deep/*/*", "/p/list/2/deep/0/0", "/p/list/2/deep/0", 0, (("", "2"),)),
        ("/o", "/o", "", None, ()),
    }
    assert got == {(i, *r) for i in (1, 2) for r in one}


def test_lone_surrogates_and_empty_table(spark):
    df = spark.createDataFrame([(1, '{"\\ud800":{"a":"\\udc00"}}')], "raw_id bigint, text string")
    assert [r.node for r in S.nodes(df, ["raw_id"], "text").collect()] == ["/�"]
    assert S.nodes(df.limit(0), ["raw_id"], "text").count() == 0
