import json
import random

import pytest
from pyspark.sql import functions as F

from doclake.functions import markup as M
from doclake.functions import naming as N
from doclake.functions import properties as P
from doclake.functions import text as X
from doclake.functions import urls as U
from doclake.operators import changes, ledger, links, placement, runs
from doclake.plans import library, round_queries
from doclake.sources import landed


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c).first()[0]


def value(spark, f, *args):
    df = spark.createDataFrame([args], ", ".join(f"a{i} string" for i in range(len(args))))
    return df.select(f(*(F.col(f"a{i}") for i in range(len(args))))).first()[0]


@pytest.mark.parametrize(("title", "want"), [("what? <why> | 5*2:10", "what why  5210"), ('"C:\\tmp/x"', "Ctmpx"), ("one\x01two\r\n", "onetwo"), ("?*?", ""), ("\u3000日誌 – März\u00a0", "日誌 – März"), (None, "")])
def test_slug(spark, title, want):
    assert value(spark, N.slug, title) == want


@pytest.mark.parametrize(("id_", "want"), [("left:middle:quitelongtoken", "quitelon"), ("abc", "abc"), ("tail:", "tail")])
def test_id_prefix(spark, id_, want):
    assert value(spark, N.id_prefix, id_) == want


def test_truncation_keeps_characters_whole(spark):
    assert value(spark, lambda t: N.truncate_bytes(t, F.lit(4)), "a汉汉") == "a汉"
    assert value(spark, lambda t: N.truncate_bytes(t, F.lit(3)), "🙂🙂") == ""


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("p/a.md", "p/b.md", "b.md"), ("shelf/box/lid/note.md", "pool/7c/pic.webp", "../../../pool/7c/pic.webp"), ("p/x/a.md", "p/x/y/b.md", "y/b.md"), ("a.md", "b/c.md", "b/c.md"), ("p/q/a.md", "p/r/b.md", "../r/b.md")],
)
def test_relative_path(spark, a, b, want):
    assert value(spark, X.relative_path, a, b) == want


def test_text_helpers(spark):
    assert value(spark, X.yaml_quote, 'a"b\\c\n') == '"a\\"b\\\\c\\n"'
    assert value(spark, X.yaml_key, "ship at: noon") == '"ship at: noon"'
    assert value(spark, X.yaml_key, "Name") == "Name"
    assert value(spark, X.link_dest, "a b.md") == "<a b.md>"
    assert value(spark, X.bitable_cell, "a|b\\c\r\n") == "a\\|b\\\\c  "
    assert value(spark, X.bitable_cell, "") == " "
    assert value(spark, lambda c: X.xml_unescape(X.xml_escape(c)), "<a href=\"x&y\">'") == "<a href=\"x&y\">'"
    assert value(spark, X.clock_times, "8:30, 21:05 ,08:30") == ["08:30", "21:05"]
    assert value(spark, X.clock_times, "24:00") is None
    assert [value(spark, X.retry_after, s) for s in ("", "5", "0", "abc", "  3 ")] == [0, 5, 0, 0, 3]
    assert value(spark, X.first_semver, "engine v1.2 (x)") == [1, 2, 0]
    head, body = X.split_front_matter(F.col("a0"))
    assert tuple(spark.createDataFrame([("---\na: 1\n---\nx\n---\n",)], "a0 string").select(head, body).first()) == ("---\na: 1\n---\n", "x\n---\n")


@pytest.mark.parametrize(("x", "want"), [(0.0, "0"), (-0.5, "-0.5"), (42.0, "42"), (1e21, "1000000000000000000000"), (1e-7, "0.0000001"), (259.47, "259.47"), (1.5e12, "1500000000000"), (1e26, "1" + "0" * 26), (-2.5e-31, "-0." + "0" * 30 + "25"), (1e300, "1" + "0" * 300), (5e-324, "0." + "0" * 323 + "5"), (0.1 + 0.2, "0.30000000000000004"), (None, "")])
def test_numbers(spark, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(X.number_text(F.col("x"))).first()[0]
    assert (got, P.shortest_number(x)) == (want, want)


PROPERTIES = [
    ({"type": "rich_text", "rich_text": [{"plain_text": "a"}, {"plain_text": "b"}]}, "ab"),
    ({"type": "rich_text", "rich_text": {}}, ""),
    ({"type": "number", "number": 42.0}, "42"),
    ({"type": "number", "number": None}, ""),
    ({"type": "select", "select": {"name": "x"}}, "x"),
    ({"type": "status", "status": None}, ""),
    ({"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]}, "[a, b]"),
    ({"type": "multi_select", "multi_select": []}, "[]"),
    ({"type": "date", "date": {"start": "2024-01-01", "end": "2024-01-02"}}, "2024-01-01/2024-01-02"),
    ({"type": "date", "date": {"start": "2024-01-01", "end": None}}, "2024-01-01"),
    ({"type": "checkbox", "checkbox": None}, "false"),
    ({"type": "checkbox", "checkbox": True}, "true"),
    ({"type": "email", "email": None}, ""),
    ({"type": "people", "people": [{"id": "u1", "name": "N"}, {"id": "u2"}]}, "[N, u2]"),
    ({"type": "files", "files": [{"name": "f.png"}]}, "[f.png]"),
    ({"type": "relation", "relation": [{"id": "354A4F41BF47B1738E4DE4C8110D25A8"}]}, "[354a4f41-bf47-b173-8e4d-e4c8110d25a8]"),
    ({"type": "formula", "formula": {"type": "boolean", "boolean": True}}, "true"),
    ({"type": "formula", "formula": {"type": "odd"}}, "<unsupported: formula/odd>"),
    ({"type": "formula", "formula": None}, ""),
    ({"type": "rollup", "rollup": {"type": "array", "array": [{"type": "number", "number": 1}, {"type": "rollup", "rollup": {"type": "array", "array": [{"type": "select", "select": {"name": "q"}}]}}, "x"]}}, "[1, [q], <unsupported: unparseable>]"),
    ({"type": "rollup", "rollup": {"type": "incomplete"}}, "<rollup: incomplete>"),
    ({"type": "created_by", "created_by": {"id": "u", "name": ""}}, "u"),
    ({"type": "unique_id", "unique_id": {"prefix": "T", "number": 7}}, "T-7"),
    ({"type": "unique_id", "unique_id": {"prefix": None, "number": 7}}, "7"),
    ({"type": "verification", "verification": {}}, "<unsupported: verification>"),
    ("text", "<unsupported: unparseable>"),
]


def test_properties_in_the_jvm_and_below(spark):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(PROPERTIES)], "i int, raw string")
    got = {r.i: r.text for r in df.select("i", P.render_value(F.col("raw")).alias("text")).collect()}
    for i, (p, want) in enumerate(PROPERTIES):
        assert (got[i], P.render_parsed(p)) == (want, want), p


@pytest.mark.parametrize(
    ("v", "want"),
    [([{"text": "hello "}, {"text": "world"}], "hello  world"), (3, "3"), (2.5, "2.5"), (True, "true"), (None, ""), ({"link": "u", "text": ""}, "u"), ({"b": 1, "a": [2]}, '{"a":[2],"b":1}'), ([1, [], None, "x"], "1 x")],
)
def test_cells(v, want):
    assert P._cell(json.dumps(v)) == want


def test_mask_and_tags(spark):
    body = "<foo> `<bar>` \n```\n<baz>\n```\n<!-- <qux> --> <p>\n```\n<open>"
    masked = M.mask_text(body)
    assert len(masked) == len(body) and masked.count("\n") == body.count("\n")
    got = spark.createDataFrame([(body,), (None,), ("",)], "b string").select(M.unknown_tags(M.mask_regions(F.col("b")))).collect()
    assert [r[0] for r in got] == [["foo", "open"], None, []]


def test_markup_rewrites(spark):
    once = value(spark, lambda b: M.pending_marker(b, F.lit("u")), "![x](u) ![y](v)")
    assert once == "![x](u)<!-- doclake:pending --> ![y](v)"
    assert value(spark, lambda b: M.pending_marker(b, F.lit("u")), once) == once
    assert value(spark, lambda b: M.swap_destination(b, F.lit("a b"), F.lit("c")), "[x](a b) [y](<a b>)") == "[x](c) [y](<c>)"
    assert value(spark, lambda b: M.attributes(b), '<t a="1" b="2" a="3">') == {"b": "2", "a": "3"}
    assert value(spark, lambda b: M.annotate_fences(b, F.array(F.lit("t1"))), "x\n```mermaid\ng\n```\n```mermaid\n") == "x\n<!-- doclake:board t1 -->\n```mermaid\ng\n```\n```mermaid\n"


def test_front_matter(spark):
    df = spark.createDataFrame([("x\n", None, [("b: c", 'q"'), ("状态", ""), ("-a", "1")]), ("y", "2024-01-02T03:04:05Z", [])], "id string, t string, p array<struct<key: string, value: string>>")
    got = [r[0] for r in df.select(X.front_block({"id": F.col("id"), "url": F.lit(None)}, {"updated": F.col("t")}, F.col("p"))).collect()]
    assert got[0] == f'---\n{X.FRONT_WARNING}\nid: "x\\n"\nurl: ""\nupdated: null\nproperties:\n  "b: c": "q\\""\n  状态: ""\n  "-a": "1"\n---\n'
    assert got[1] == f'---\n{X.FRONT_WARNING}\nid: "y"\nurl: ""\nupdated: 2024-01-02T03:04:05Z\n---\n'
    assert [value(spark, X.yaml_key, k) for k in ("plain one", " a", "a#b", "")] == ["plain one", '" a"', '"a#b"', '""']


def test_row_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("b", "1:k=v\n"), ("b", None), (None, "")], "body string, canonical string")
    got = [r[0] for r in df.select(P.row_hash(F.col("body"), F.col("canonical"))).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ("b\0doclake:properties\x001:k=v\n", "b", "\0doclake:properties\0")]


def test_orders_of_paths(spark):
    df = spark.createDataFrame([("a/b",), ("a/é",), (None,), ("a/b/c/d",), ("long-name",)], "path string")
    assert [r.path for r in changes.deepest_first(df, "path").collect()] == ["long-name", "a/b/c/d", "a/é", "a/b", None]
    assert [r.path for r in changes.shallow_first(df, "path").collect()][0] == "long-name"


def test_what_bodies_refer_to(spark):
    hexed = "00112233445566778899aabbccddeeff"
    body = f'<page\n icon="i" url="https://www.notion.so/T-{hexed.upper()}"/> <pagex url="{hexed}"> <page url="none"> <page url="x/{hexed}"><database url="d" data-source-url="collection://{hexed}"> <database url="d">'
    assert [r["target"] for r in value(spark, M.page_links, body)] == ["00112233-4455-6677-8899-aabbccddeeff"]
    hrefs = '<a href="https://q.larksuite.com/docx/Ab1?x=1&amp;y=2">t</a><a href="https://q.feishu.cn/wiki/W2"><a href="https://q.feishu.cn/docx/Ab1"><a href="https://else.example/docx/No">'
    assert [tuple(r) for r in value(spark, M.href_links, hrefs)] == [("Ab1", "https://q.larksuite.com/docx/Ab1?x=1&y=2"), ("W2", "https://q.feishu.cn/wiki/W2")]
    assert value(spark, M.whiteboard_tokens, '<whiteboard a="1" token="w1"></whiteboard><whiteboard><whiteboard token="w2"/>') == ["w1", "w2"]
    xml = '<img src="k1" href="u?a&amp;b" name="n"/><img href="u"><img src="k3">'
    got = value(spark, lambda b: M.matched_images(b, F.lit(xml)), "![a](m1) ![b [c]](m2 'title') ![c](<m3>) ![d](m4)")
    assert [(r["key"], r["url"], r["body_url"], r["name"]) for r in got] == [("k1", "u?a&b", "m1", "n"), ("k3", None, "m3", None)]
    assert value(spark, M.page_links, "") == [] and value(spark, M.href_links, None) is None


@pytest.mark.parametrize(
    ("url", "token"),
    [
        ("https://www.notion.so/p/My-Page-00112233445566778899AABBCCDDEEFF?v=1#x", "00112233445566778899aabbccddeeff"), ("http://notion.so/00112233445566778899aabbccddeeff", "00112233445566778899aabbccddeeff"),
        ("https://notion.example/00112233445566778899aabbccddeeff", None), ("https://www.notion.so/00112233", None), ("https://a.b.feishu.cn/base/Tok9-x", "Tok9"), ("https://evilfeishu.cn/base/Tok9", None),
        ("https://a.larksuite.com/drive/Tok9", None), ("https://a.larksuite.com/docx/", None), ("https://a.larksuite.com", None), ("no url", None), (None, None),
    ],
)
def test_tokens_of_urls(spark, url, token):
    assert value(spark, U.doc_token, url) == token


def test_asset_hosts(spark):
    yes = ("https://S3.us-west-2.amazonaws.com/x?y", "https://file.notion.so/f/a.png", "https://prod-files-secure.s3.example/a")
    assert all(value(spark, U.is_asset, u) for u in yes) and not value(spark, U.is_asset, "https://x.example/amazonaws.com")


def test_names_never_collide(spark):
    rnd = random.Random(4)
    titles = ["Notes", "notes", "Notes-aaaabbbb", "Notes-aaaabbbb-2", "", None, "README", "x" * 300]
    data = [("p", f"aaaabbbb{i:04d}" if rnd.random() < 0.5 else f"id{i:06d}", None, "docx", rnd.choice(titles), i) for i in range(120)]
    docs = spark.createDataFrame(data, "platform string, id string, parent string, type string, title string, ord int")
    got = placement.sibling_names(docs).collect()
    assert len(got) == 120 and len({r.name.lower() for r in got}) == 120
    assert all(len(r.name.encode()) <= 204 for r in got)
    first = min((r for r in got if (r.title or "").lower() == "notes"), key=lambda r: r.ord)
    assert first.name == first.title


def test_placement(spark):
    data = [("p", "root", "", "folder", "Root", 1), ("p", "a", "root", "docx", "A", 2), ("p", "b", "root", "docx", "a", 3), ("p", "c", "a", "docx", "C", 4), ("p", "o", "gone", "docx", "O", 5), ("p", "l1", "l2", "docx", "L", 6), ("p", "l2", "l1", "docx", "L", 7)]
    got = {r.id: (r.dir_path, r.body_path, r.breadcrumb) for r in placement.place(spark.createDataFrame(data, "platform string, id string, parent_id string, type string, title string, ord int")).collect()}
    assert got == {
        "root": ("p/Root", None, ""), "a": ("p/Root/A", "p/Root/A/README.md", "Root"), "b": (None, "p/Root/a-b.md", "Root"), "c": (None, "p/Root/A/C.md", "Root / A"),
        "p:_orphans": ("p/_orphans", None, ""), "o": (None, "p/_orphans/O.md", "_orphans"),
    }


def test_ledger_functions(spark, rows):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "k string, v int, seq int")
    assert rows(ledger.upsert(old, new, ["k"], "seq")) == [("a", 1), ("b", 6), ("c", 7)]
    assert rows(ledger.insert_ignore(old, new.drop("seq"), ["k"]).where("k <> 'c'")) == [("a", 1), ("b", 2)]
    docs = spark.createDataFrame([("a", "trashed", "2024"), ("b", "trashed", None), ("c", "active", "2024")], "id string, status string, synced_at string")
    assert [r[0] for r in rows(ledger.purge_trashed(docs, "2025"))] == ["b", "c"]
    assert rows(ledger.mark(docs, spark.createDataFrame([("c",)], "id string"), "id", status=F.lit("trashed")).select("id", "status")) == [("a", "trashed"), ("b", "trashed"), ("c", "trashed")]


def test_guard(spark):
    """Platforms of several sizes at once, each just at four fifths of what is active and one short of it."""
    sizes = (1, 6, 15, 45, 130)
    led, inv, gone = [], [], 0
    for n in sizes:
        for short in (0, 1):
            platform, seen = f"p{n}-{short}", -(-4 * n // 5) - short
            led += [(f"{platform}/{i}", platform, "x", "active") for i in range(n)] + [(f"{platform}/old", platform, "x", "trashed")]
            inv += [(f"{platform}/{i}", platform) for i in range(seen)]
            gone += 0 if short else n - seen
    got = changes.guarded_deletes(spark.createDataFrame(inv, "id string, platform string"), spark.createDataFrame(led, "id string, platform string, path string, status string")).collect()
    assert len(got) == gone and all(r.platform.endswith("-0") for r in got)


def test_classify(spark):
    cols = "id string, platform string, path string, edited string, hash string"
    led = spark.createDataFrame([("same", "p", "x", "1", "h", "active"), ("hash", "p", "y", "1", "h", "active"), ("upd", "p", "z", "1", "h", "active"), ("back", "p", "t", "1", "h", "trashed"), ("gone", "p", "g", "1", "h", "active"), ("old", "p", "o", "1", "h", "trashed")], cols + ", status string")
    inv = spark.createDataFrame([("same", "p", "x2", "1", "i"), ("hash", "p", "y", "2", "h"), ("upd", "p", "z", "2", "i"), ("back", "p", "t", "1", "h"), ("new", "p", "n", "1", "h")], cols)
    got = {r.id: (r.outcome, r.moved) for r in changes.classify(inv, led).collect()}
    assert got == {"same": ("skipped", True), "hash": ("skipped", False), "upd": ("updated", False), "back": ("updated", False), "gone": ("gone", False), "new": ("added", False)}
    assert {r.outcome for r in changes.classify(inv, led, full=True).collect()} == {"added", "updated", "gone"}


def test_modes(spark):
    import datetime as dt

    now = dt.datetime(2024, 5, 5, 12)

    def mode(history, every, ck="c"):
        data = [(i, "p", at, ck, json.dumps({"mode": m})) for i, (at, m) in enumerate(history)]
        df = spark.createDataFrame(data, "id int, platform string, started_at timestamp, checkpoint string, stats string")
        return runs.modes(df, F.lit(now).cast("timestamp"), every).first()["mode"]

    t = now - dt.timedelta(hours=1)
    assert mode([(t, "full")], 0) == "incremental"
    assert mode([(t, "full")], 1) == "full"
    assert mode([(t, "full"), (t, "incremental")], 2) == "full"
    assert mode([(t, "full"), (t, "incremental")], 3) == "incremental"
    assert mode([(t - dt.timedelta(days=1), "full")], 0) == "full"
    assert mode([(t, "full")], 0, "") == "full"


def test_token_bucket_waits_one_gap(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 2), (0.1, 3), (5.0, 4)], "at double, event_id int").withColumn("lane", F.lit(0))
    got = [round(r.slot, 6) for r in runs.token_bucket(df, 2.0, ["lane"]).orderBy("event_id").collect()]
    assert got == [0.0, 0.5, 1.0, 5.0]


def test_resolution_order(spark):
    docs = spark.createDataFrame([("a", "pa", "active"), ("b", None, "active"), ("t", "pt", "trashed")], "id string, local_path string, status string")
    al = spark.createDataFrame([("b", "a"), ("x", "a"), ("y", "t")], "alias string, doc_id string")
    refs = spark.createDataFrame([(r,) for r in "abxyz"], "ref string")
    got = {r.ref: (r.doc_id, r.matched_by) for r in links.resolve(refs, docs, al).collect()}
    assert got == {"a": ("a", "id"), "b": ("a", "alias"), "x": ("a", "alias"), "y": (None, None), "z": (None, None)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"ok":true,"data":{}}', "ok"), ('{"ok":false,"error":{"code":1,"message":"m"}}', "error"), ("", "empty"), ("{", "malformed"), ("[]", "not_an_object"), ('{"data":1}', "no_ok"), ('{"ok":"yes","data":1}', "ok_not_boolean"), ('{"ok":true}', "no_data"), ('{"ok":false}', "no_error")],
)
def test_envelopes(spark, raw, want):
    assert value(spark, landed.envelope_case, raw) == want


def test_env_lines(spark):
    text = ["# c", "A=1", "export B = 'x # y'", 'C="q" # note', "D=v # note", "E=", "A=2", "bad line", "F=#all"]
    df = spark.createDataFrame(list(enumerate(text)), "n int, value string")
    assert {r.key: r.value for r in landed.env_lines(df).collect()} == {"A": "2", "B": "x # y", "C": "q", "D": "v", "E": "", "F": ""}


def test_python_source_and_binary(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","edited_at":"2024"}\n{"id":"2","edited_at":"2020"}\n\n')
    landed.register(spark)
    df = spark.read.format("doclake_inventory").option("path", str(tmp_path / "*.jsonl")).option("since", "2022").load()
    assert [r.id for r in df.collect()] == ["1"]
    (tmp_path / "x.bin").write_bytes(b"\x89PNG\r\n\x1a\n1234")
    r = landed.assets(spark, str(tmp_path / "x.bin")).first()
    assert r.ext == ".png" and len(r.digest) == 64


def test_search_pages(spark, tmp_path):
    page = {"results": [{"object": "page", "id": "1", "title": [{"plain_text": "a"}, {"plain_text": "b"}], "extra": 1}], "has_more": False}
    (tmp_path / "p.json").write_text(json.dumps(page) + "\n" + json.dumps({"results": []}))
    got = landed.search_pages(spark, str(tmp_path / "p.json")).collect()
    assert [(r.id, r.title) for r in got] == [("1", "ab")]


def test_stream_keeps_the_ledger(spark, tmp_path):
    from doclake.streaming import rounds

    land = str(tmp_path / "land")
    schema = "id string, v int, seq int"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).coalesce(1).write.mode("append").parquet(land)
    run = lambda: rounds.keep_ledger(rounds.landed(spark, land, schema, 1), str(tmp_path / "ledger"), str(tmp_path / "ck"), ["id"], "seq").awaitTermination()
    run()
    spark.createDataFrame([("a", 5, 2), ("c", 1, 1)], schema).coalesce(1).write.mode("append").parquet(land)
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "ledger" / "v=1")).collect())) == [("a", 5), ("b", 1), ("c", 1)]


def test_stream_windows(spark, tmp_path):
    import datetime as dt

    from doclake.streaming import rounds

    land = str(tmp_path / "land")
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t), (1, t), (2, t + dt.timedelta(minutes=30)), (3, t + dt.timedelta(hours=5))], "k int, at timestamp").write.parquet(land)
    s = rounds.landed(spark, land, "k int, at timestamp")
    q = rounds.counts(rounds.distinct_within(s, ["k"], "at"), "at", [], "1 hour").writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("win").collect()] == [2]


def test_texts_are_quoted_whole(spark, tmp_path):
    long = "x" * 500 + '[a] "b"\\\n'
    spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.quoted, r.label) for r in library.quoted_texts(spark, str(tmp_path)).collect()}
    assert got == {1: ('"' + "x" * 500 + '[a] \\"b\\"\\\\\\n"', "x" * 500 + '\\[a\\] "b"\\\n'), 3: ('""', "")}


def test_loss_markers_keep_rows_with_nulls(spark, tmp_path):
    data = [(1, "a", 7000, 13, "r"), (2, "b", 7000, None, "r"), (3, "c", None, 13, "r"), (4, "d", 7000, 13, None), (5, "e", None, None, None), (6, None, 7000, 13, "r"), (7, "f", 1, 1, "r")]
    spark.createDataFrame(data, "doc_id bigint, text string, n_chars bigint, n_cells int, repo string").write.parquet(f"{tmp_path}/documents.parquet")
    cut, blocks = "<!-- doclake:truncated -->\n", '<!-- doclake:unknown-blocks n="1" ids="r" -->\n'
    got = {r.doc_id: r.body for r in library.loss_markers(spark, str(tmp_path)).collect()}
    assert got == {1: cut + blocks + "a", 2: cut + "b", 3: blocks + "c", 4: cut + "d", 5: "e", 7: "f"}


def test_empty_relations_are_shown(spark, tmp_path):
    props = {"none": {"type": "relation", "relation": []}, "null": {"type": "relation", "relation": None}, "two": {"type": "relation", "relation": [{"id": "b"}, None, {"id": "a"}]}, "no": {"type": "url", "url": None}}
    spark.createDataFrame([(1, json.dumps(props))], "raw_id bigint, properties string").write.parquet(f"{tmp_path}/query_rows.parquet")
    spark.createDataFrame([("a", "A", ""), ("b", "", "")], "id string, title string, parent_id string").write.parquet(f"{tmp_path}/ledger_documents.parquet")
    got = {(r.raw_id, r.name): r.text for r in library.relation_titles(spark, str(tmp_path)).collect()}
    assert got == {(1, "none"): "[]", (1, "null"): "[]", (1, "two"): "[b, , A]"}


def test_objects_within_strings_and_empty_records(spark, tmp_path):
    props = {"a": {"type": "url", "url": "u"}, "t": {"type": "title", "title": []}}
    rows = [(1, "db", json.dumps(props)), (2, "db", json.dumps(json.dumps(props))), (3, "db", '""'), (4, "db", '"{"'), (5, "db", None), (6, "db", json.dumps(json.dumps(props)) + ' "x"')]
    spark.createDataFrame(rows, "raw_id bigint, data_source_id string, properties string").write.parquet(f"{tmp_path}/query_rows.parquet")
    d = str(tmp_path)
    assert sorted((r.raw_id, r.name, r.text) for r in library.render_properties(spark, d).collect()) == [(1, "a", "u"), (2, "a", "u")]
    assert sorted((r.raw_id, r.n, r.types) for r in library.property_types(spark, d).collect()) == [(1, 2, 2), (2, 2, 2)]
    fields = ['{"x":1}', json.dumps('{"y": "z"}'), "{}", "{", None, '""', "[1]"]
    spark.createDataFrame([(i, "s", "t", f) for i, f in enumerate(fields)], "raw_id bigint, space_id string, table_id string, fields string").write.parquet(f"{tmp_path}/bitable_records.parquet")
    assert sorted((r.raw_id, r.field, r.text) for r in library.bitable_cells(spark, d).collect()) == [(0, "x", "1"), (1, "y", "z")]
    assert sorted((r.field, r.n) for r in library.bitable_schema(spark, d).collect()) == [("x", 1), ("y", 1)]
    got = {r.raw_id: r.line for r in round_queries.bitable_tables(spark, d).collect()}
    assert got == {None: "| x | y |\n| --- | --- |", 0: "| 1 |   |", 1: "|   | z |"} | dict.fromkeys(range(2, 7), "|   |   |")
