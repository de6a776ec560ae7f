from pyspark.sql import functions as F

from doclake.operators import assets, incremental, indexes, reports, rewrite, rounds
from doclake.sources import config
from doclake.sources.inventory import REMOTE_DOC

LEDGER = "id string, platform string, type string, parent_id string, title string, local_path string, remote_edited string, content_hash string, synced_at string, status string"


def test_two_rounds(spark):
    def inventory(docs):
        return spark.createDataFrame([(i, f"alias-{i}", "p", t, parent, title, edited, "", n) for n, (i, t, parent, title, edited) in enumerate(docs)], REMOTE_DOC)

    def bodies(**b):
        return spark.createDataFrame(list(b.items()), "id string, body string")

    old = {"documents": spark.createDataFrame([], LEDGER), "links": spark.createDataFrame([], "from_id string, to_id string"), "aliases": spark.createDataFrame([], "alias string, doc_id string")}
    first = [("f", "folder", "", "F", ""), ("a", "docx", "f", "A", "1"), ("b", "docx", "f", "B", "1"), ("c", "docx", "f", "C", "1"), ("d", "docx", "f", "D", "1"), ("e", "docx", "f", "E", "1")]
    text = {i: f"body {i}" for i in "abcde"} | {"a": "[b](https://h.feishu.cn/docx/b) [again](https://h.feishu.cn/docx/b)"}
    r1 = rounds.run_round(inventory(first), bodies(**text), old, "2024-01-01T00:00:00Z")
    assert {r.id: r.outcome for r in r1.outcomes.collect()} == dict.fromkeys("fabcde", "added")
    assert [tuple(r) for r in r1.links.collect()] == [("a", "b")]
    one = {"documents": r1.documents, "links": r1.links, "aliases": r1.aliases}

    again = rounds.run_round(inventory(first), bodies(**text), one, "2024-01-02T00:00:00Z")
    assert {r.outcome for r in again.outcomes.where("id <> 'f'").collect()} == {"skipped"}
    assert again.deletes.count() == 0 and again.links.count() == 1

    second = [*first[:2], ("b", "docx", "f", "Beta", "2"), *first[3:5], ("n", "docx", "b", "New", "1")]
    r2 = rounds.run_round(inventory(second), bodies(**(text | {"b": "changed", "n": "x"})), one, "2024-01-03T00:00:00Z")
    got = {r.id: (r.outcome, r.moved) for r in r2.outcomes.collect()}
    assert got["b"] == ("updated", True) and got["n"] == ("added", False) and got["e"] == ("gone", False) and got["c"] == ("skipped", False)
    docs = {r.id: r for r in r2.documents.collect()}
    assert docs["e"].status == "trashed" and docs["b"].local_path == "p/F/Beta/README.md" and docs["n"].local_path == "p/F/Beta/New.md"
    s = r2.stats.first()
    assert (s.added, s.gone, s.moved) == (1, 1, 1)
    runs = spark.createDataFrame([(7, "p", "", "", "", "{}")], "id bigint, platform string, started_at string, finished_at string, checkpoint string, stats string")
    assert sorted(r.id for r in rounds.run_record(runs, r2.stats, "a", "b", "full").collect()) == [7, 8]


def test_rewriting(spark):
    docs = spark.createDataFrame([("T1", "p/x/one.md", "active"), ("T12", "p/two.md", "active"), ("T3", "p/z.md", "trashed"), ("354a4f41-bf47-b173-8e4d-e4c8110d25a8", "p/q.md", "active")], "id string, local_path string, status string")
    al = spark.createDataFrame([("W9", "T1"), ("354a4f41bf47b1738e4de4c8110d25a8", "354a4f41-bf47-b173-8e4d-e4c8110d25a8")], "alias string, doc_id string")
    u = "https://h.feishu.cn/docx/"
    data = [
        ("a", "p/y/a.md", f"[1]({u}T1) [2]({u}T12) [3]({u}T3) [1]({u}T1)"), ("b", "p/b.md", f"<{u.replace('docx', 'wiki')}W9>"), ("c", "p/c.md", "https://www.notion.so/Page-354A4F41BF47B1738E4DE4C8110D25A8?v=1"),
        ("d", "p/d.md", None), ("e", "p/e.md", "plain"), ("f", "p/f.md", f"{u}T1 {u}T1more {u}T1?a=1 {u}T1"), ("g", "p/g.md", f"---\nurl: {u}T1\n---\n{u}T1"), ("h", "p/h.md", ""), ("i", "p/i.md", f"https://x.example/{u}T1"),
    ]
    got = {r.id: (r.body, r.rewritten) for r in rewrite.rewrite_bodies(spark.createDataFrame(data, "id string, path string, body string"), docs, al).collect()}
    assert got["a"] == (f"[1](../x/one.md) [2](../two.md) [3]({u}T3) [1](../x/one.md)", 3)
    assert got["b"] == ("<x/one.md>", 1) and got["c"] == ("q.md", 1) and got["d"] == (None, 0) and got["e"] == ("plain", 0) and got["h"] == ("", 0)
    assert got["f"] == (f"x/one.md {u}T1more x/one.md x/one.md", 3)
    assert got["g"] == (f"---\nurl: {u}T1\n---\nx/one.md", 1) and got["i"][1] == 0


def test_links_follow_moves(spark):
    paths = lambda *rows: spark.createDataFrame(rows, "id string, path string")
    before = paths(("a", "p/a.md"), ("b", "p/b c.md"), ("c", "p/c.md"), ("d", "p/d.md"), ("s", "p/s.md"))
    # b takes the path that c had: a target that was just written isn't moved on.
    after = paths(("a", "p/a.md"), ("b", "p/c.md"), ("c", "q/c.md"), ("d", "p/d.md"), ("s", "q/s.md"))
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "b"), ("s", "d"), ("a", "gone")], "from_id string, to_id string")
    bodies = spark.createDataFrame([("a", "[1](b c.md) [2](<b c.md>) [3](c.md) [4](<c.md>) [5](d.md) [6](c.mdx) c.md"), ("s", "---\nx: [d](d.md)\n---\n![d](d.md)"), ("d", None), ("z", "[c](c.md)")], "id string, body string")
    got = {r.id: (r.body, r.applied) for r in rewrite.moved_bodies(bodies, links, before, after).collect()}
    assert got == {
        "a": ("[1](c.md) [2](<c.md>) [3](../q/c.md) [4](<../q/c.md>) [5](d.md) [6](c.mdx) c.md", 4), "s": ("---\nx: [d](d.md)\n---\n![d](../p/d.md)", 1), "d": (None, 0), "z": ("[c](c.md)", 0),
    }


def test_database_lines(spark):
    rows = spark.createDataFrame([("db", "p/db/_index.md", "2", "B|x", "p/db/b c.md"), ("db", "p/db/_index.md", "1", "A", None), ("db", "p/db/_index.md", "3", None, "p/db/n.md"), ("none", "q/_index.md", "9", "Z", "q/z.md")], "db_id string, index_path string, row_id string, title string, path string")
    props = spark.createDataFrame([("db", r, k, f"{k}{r}") for r in "12" for k in "edcba"], "db_id string, row_id string, key string, value string")
    lines = [r.line for r in indexes.database_lines(rows, props).where("db_id = 'db'").orderBy("part", "title", "row_id").collect()]
    assert lines == [
        "> 3 rows total\n\n| Title | a | b | c | d |\n|---|---|---|---|---|", "| [3](n.md) |  |  |  |  |", "| **A** | a1 | b1 | c1 | d1 |", "| [B\\|x](<b c.md>) | a2 | b2 | c2 | d2 |",
    ]


def test_bitable_lines(spark):
    data = [("t", i, {"a": f"{i}|", "b": ""}) for i in (1, 2)] + [("big", i, {"k": "v"}) for i in range(4)]
    got = indexes.bitable_lines(spark.createDataFrame(data, "table string, raw_id int, cells map<string,string>"), threshold=3).orderBy("table", "part", "raw_id").collect()
    assert [r.line for r in got] == ["Bitable (4 rows, over the inline threshold; showing structure only):\n\n- Columns: k", "| a | b |\n| --- | --- |", "| 1\\| |   |", "| 2\\| |   |"]


PLACED = "id string, platform string, parent_id string, type string, local_path string, status string"
NEW = "platform string, id string, parent_id string, type string, title string, ord int"


def test_incremental_placement(spark):
    led = spark.createDataFrame(
        [("r", "p", None, "folder", "p/R", "active"), ("leaf", "p", "r", "docx", "p/R/Leaf.md", "active"), ("dead", "p", None, "folder", "p/D", "trashed"), ("cut", "p", "dead", "folder", "p/D/Cut", "active")], PLACED
    )
    docs = spark.createDataFrame(
        [("p", "n1", "r", "docx", "leaf", 1), ("p", "n2", "r", "docx", "New", 2), ("p", "n3", "r", "docx", "new", 3), ("p", "n4", "dead", "docx", "X", 4), ("p", "n5", "", "folder", "Top", 5), ("p", "n6", "leaf", "docx", "Child", 6), ("p", "leaf", "r", "docx", "Leaf", 7),
         ("p", "n7", "n5", "docx", "In", 8), ("p", "n8", "n7", "docx", "Deep", 9), ("p", "n9", "cut", "docx", "Lost", 10), ("p", "l1", "l2", "docx", "L", 11), ("p", "l2", "l1", "docx", "L", 12)], NEW
    )
    got = {r.id: r.path for r in incremental.place_new(docs, led).collect()}
    assert got == {
        "n1": "p/R/leaf-n1.md", "n2": "p/R/New.md", "n3": "p/R/new-n3.md", "n4": "p/_orphans/X.md", "n5": "p/Top", "n6": "p/R/Leaf/Child.md",
        "n7": "p/Top/In/README.md", "n8": "p/Top/In/Deep.md", "n9": "p/_orphans/Lost.md", "l1": "p/_orphans/L.md", "l2": "p/_orphans/L-l2.md",
    }
    assert [tuple(r) for r in incremental.new_directories(docs, led).collect()] == [("leaf", "p/R/Leaf.md", "p/R/Leaf/README.md")]


def test_newcomers_never_take_a_name(spark):
    """The name with the id is taken too, by a ledger row and among newcomers whose ids begin alike: numbers follow."""
    led = spark.createDataFrame([("r", "p", None, "folder", "p", "active"), ("x", "p", None, "docx", "p/Notes.md", "active"), ("y", "p", None, "docx", "p/notes-newdoc01.md", "active"), ("d", "p", None, "page", "p/Sub/README.md", "active")], PLACED)
    docs = spark.createDataFrame([("p", f"newdoc01{i}", None, "docx", t, 1) for i, t in enumerate(["Notes", "Notes", "NOTES", "sub", "Notes-newdoc01"])], NEW)
    got = {r.id: r.path for r in incremental.place_new(docs, led).collect()}
    names = [p.lower() for p in got.values()] + ["p/notes.md", "p/notes-newdoc01.md", "p/sub.md"]
    assert len(set(names)) == len(names) == 8
    assert got["newdoc010"] == "p/Notes-newdoc01-2.md" and got["newdoc013"] == "p/sub-newdoc01.md"
    none = spark.createDataFrame([], NEW)
    assert incremental.place_new(none, led).count() == 0


def test_assets(spark):
    led = spark.createDataFrame([("a", "s1", "p1", "done"), ("b", None, None, "pending"), ("c", "s3", "p3", "done"), ("d", "s4", "", "done")], "remote_key string, sha256 string, local_path string, status string")
    refs = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "b"), ("2", "c"), ("2", "d"), ("3", "e"), ("4", None), (None, "z")], "id string, key string")
    got = spark.createDataFrame([("b", "s2", "p2"), ("a", "other", "p"), ("x", "s", "p")], "key string, sha256 string, path string")
    files = spark.createDataFrame([("p1",)], "path string")
    nxt, out = assets.settle(led, refs, got, files)
    assert sorted(map(tuple, out.collect())) == [("1", "a", "reused"), ("1", "b", "downloaded"), ("2", "c", "pending"), ("2", "d", "pending"), ("3", "e", "pending")]
    assert sorted(map(tuple, nxt.collect())) == [("a", "s1", "p1", "done"), ("b", "s2", "p2", "done"), ("c", "s3", "p3", "pending"), ("d", "s4", "", "pending"), ("e", None, None, "pending")]
    docs = spark.createDataFrame([("1",), ("2",), ("4",)], "id string")
    assert sorted(map(tuple, assets.statuses_after(docs, out).collect())) == [("1", "active"), ("2", "pending_assets"), ("4", "active")]
    assert assets.register(led, refs).where("status = 'done'").count() == 3


def test_reports(spark):
    row = spark.createDataFrame([("p", 1, None), ("q", 2, 5), ("p", 3, 1)], "platform string, unknown_blocks int, truncated_pages int")
    for c in reports.LOSSES:
        if c not in row.columns:
            row = row.withColumn(c, F.lit(0))
    assert {r.platform: (r.unknown_blocks, r.truncated_pages, r.degradations) for r in reports.losses(row).collect()} == {"p": (4, 1, 5), "q": (2, 5, 7)}
    stats = spark.createDataFrame([("q", 1, ["x"], None), ("p", 2, ["y", "z"], ["w"])], "platform string, added int, failures array<string>, warnings array<string>")
    assert tuple(reports.merge_stats(stats).first()) == (3, ["y", "z", "x"], ["w"], ["p", "q"])
    assert tuple(reports.merge_stats(stats.limit(0)).first()) == (0, [], [], [])
    modes = spark.createDataFrame([("p", "incremental", "t1"), ("q", "incremental", "t2"), ("r", "full", None)], "platform string, mode string, checkpoint string")
    assert sorted(map(tuple, reports.plan_round(modes, ("p", "r")).collect())) == [("p", "incremental", "t1", False, False), ("q", "full", "", True, True), ("r", "full", "", True, True)]


def test_health(spark):
    schema = "name string, status string, detail string"
    down = spark.createDataFrame([("lark-engine", "fail", "none"), ("lark-auth", "pass", "?"), ("config", "pass", ""), ("config", "warn", "old")], schema)
    rows = reports.health(down, ("feishu",))
    got = {r.name: (r.status, r.detail) for r in rows.collect()}
    assert len(got) == 13 and [r.nth for r in rows.orderBy("nth").collect()] == list(range(1, 14))
    assert got["lark-auth"] == ("skip", "lark engine unavailable (see F1)") and got["notion-env"] == ("skip", "notion not configured") and got["config"] == ("warn", "old") and got["quota"] == ("skip", "")
    assert tuple(reports.verdict(rows).first()) == (False, "F1")
    up = spark.createDataFrame([("lark-engine", "pass", ""), ("lark-auth", "fail", "no")], schema)
    assert {r.name: r.status for r in reports.health(up, ("feishu", "notion")).collect()}["lark-auth"] == "fail"
    assert tuple(reports.verdict(reports.health(up.limit(0), ())).first()) == (True, "")


def test_embedded_tables(spark):
    shown = spark.createDataFrame([("1", "T", "t", "| a |", False), ("1", "T", "big", "cols", True)], "id string, token string, table_id string, text string, oversize boolean")
    body = 'x <bitable token="T" table-id="t" view-id="v w"></bitable> <base_refer token="T"/>\n<base_refer table-id="big" token="T"> </base_refer><bitable token="T" table-id="no">end'
    bodies = spark.createDataFrame([("1", body, "https://h.feishu.cn/docx/D?x"), ("2", "plain", None), ("3", None, None)], "id string, body string, url string")
    got = {r.id: (r.body, r.outcomes) for r in indexes.embed_bitables(bodies, shown).collect()}
    link = "[Open the bitable in Feishu](https://h.feishu.cn/base/T"
    assert got["1"][1] == ["rendered", "failed", "oversize", "failed"]
    assert got["1"][0] == (
        f'x <!-- doclake:base_refer table-id="t" token="T" view-id="v w" -->\n\n| a |\n\n{link}?table=t&view=v+w) <!-- doclake:base_refer token="T" -->\n\n{link})\n'
        f'<!-- doclake:base_refer table-id="big" token="T" -->\n\ncols\n\n{link}?table=big)<!-- doclake:base_refer table-id="no" token="T" -->\n\n> Failed to fetch the bitable; open it online to view. {link}?table=no)end'
    )
    assert got["2"] == ("plain", []) and got["3"] == (None, [])


def test_empty_dirs_and_files(spark, tmp_path):
    before, after = (spark.createDataFrame([(p,) for p in x], "path string") for x in (["a/b/c.md", "a/d.md", "top.md"], ["a/d.md"]))
    assert [r.dir for r in rewrite.dirs_left_empty(before, after).collect()] == ["a/b"]
    files = spark.createDataFrame([("x/y.md", "é"), ("z.md", None)], "path string, content string")
    assert sorted(r.bytes for r in rewrite.write_files(files, str(tmp_path)).collect()) == [0, 2]
    assert (tmp_path / "x" / "y.md").read_text() == "é" and not list(tmp_path.rglob("*.tmp*"))


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "c.toml"
    assert config.load(p) == config.DEFAULTS
    p.write_text("inline_rows = 5\n[platforms.notion]\nenabled = true\n")
    c = config.load(p)
    assert c["inline_rows"] == 5 and c["platforms"]["notion"] == {"enabled": True, "token_env": ""} and c["retention_days"] == 30
    monkeypatch.setenv("DOCLAKE_T", "e")
    assert config.resolve_env("DOCLAKE_T", {"DOCLAKE_T": "f"}) == ("e", "environment")
    monkeypatch.delenv("DOCLAKE_T")
    assert config.resolve_env("DOCLAKE_T", {"DOCLAKE_T": "f"}) == ("f", "file")
    assert config.resolve_env("DOCLAKE_T", {}) == ("", "unset")
