"""Queries of rounds: bodies rewritten, files assembled, indexes, incremental placement, assets, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclake.functions import markup as M
from doclake.functions import properties as P
from doclake.functions import text as X
from doclake.functions import urls as U
from doclake.functions.ids import canonical_id
from doclake.functions.text import relative_path
from doclake.operators import assets, incremental, indexes, reports, rewrite, runs
from doclake.plans.library import _ALIASES, _CDC, _LEDGER, _LINKS, _NOTION, _RUNS, _aliases, _fields, _ledger, _links, _records, _runs, _snap_sql, _snapshot, _snapshot_rows, cdc_classify, front_matter, mode_decision, notion_inventory, quota_usage, render_properties
from doclake.plans.library import ORACLES as _LIBRARY_SQL
from doclake.session import ship, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The hosts of the test tables beside the real ones.
_HOSTS, _DOMAINS = (*U.PAGE_HOSTS, "notes.example"), (*U.DOC_DOMAINS, "lark.example")


def _bodies(spark, d):
    """One body per link, after front matter: URLs of its target on several hosts, a longer one that begins alike, others."""
    docs = _ledger(spark, d).where("local_path IS NOT NULL").select(F.col("id").alias("from_id"), F.col("local_path").alias("path"))
    l = _links(spark, d).where("from_id IS NOT NULL AND to_id IS NOT NULL").join(docs, "from_id")
    token = F.replace("to_id", F.lit("-"), F.lit(""))
    hexed = token.rlike("^[0-9a-f]{32}$")
    lit = F.lit
    page = F.concat(lit("[it](https://www.notion.so/Some-Title-"), F.upper(token), lit("?v=1) <https://notes.example/p/"), token, lit("#a> https://notion.example/"), token, lit(" "))
    doc = F.concat(lit("[it](https://acme.feishu.cn/docx/"), token, lit(") <https://lark.example/wiki/"), token, lit("?from=x> https://acme.feishu.cn/docx/"), token, lit("DEF https://acme.feishu.cn/other/"), token, lit(" "))
    body = F.concat(lit("---\nurl: https://acme.feishu.cn/docx/"), token, lit("\n---\nsee "), F.when(hexed, page).otherwise(doc), lit("[more](https://other.example/x)"))
    return l.select(F.col("link_id").alias("id"), "path", body.alias("body"))


_REL = """repeat('../', CAST(len({x}) - 1 - len(list_filter(range(1, least(len({x}), len({y}))), lambda i: {x}[1:i] = {y}[1:i])) AS INTEGER)) ||
  array_to_string({y}[len(list_filter(range(1, least(len({x}), len({y}))), lambda i: {x}[1:i] = {y}[1:i])) + 1:], '/')"""


@query(
    f"""WITH {_LEDGER}, {_LINKS}, {_ALIASES}, live AS (SELECT id, local_path FROM led WHERE status = 'active' AND local_path IS NOT NULL),
b AS (SELECT link_id AS id, led.local_path AS path, to_id, replace(to_id, '-', '') AS token FROM li JOIN led ON led.id = li.from_id WHERE to_id IS NOT NULL AND led.local_path IS NOT NULL),
u AS (SELECT *, regexp_full_match(token, '[0-9a-f]{{32}}') AS hex FROM b),
dash AS (SELECT replace(id, '-', '') AS token, local_path FROM live WHERE regexp_full_match(replace(id, '-', ''), '[0-9a-f]{{32}}')),
t AS (SELECT u.*, coalesce(l.local_path, CASE WHEN hex THEN dash.local_path END, al2.local_path) AS target FROM u LEFT JOIN live l ON NOT hex AND l.id = u.token LEFT JOIN dash ON dash.token = u.token
  LEFT JOIN (SELECT alias, arg_min(local_path, doc_id) AS local_path FROM al JOIN live ON live.id = al.doc_id GROUP BY alias) al2 ON al2.alias = u.token),
s AS (SELECT *, string_split(path, '/') AS x, string_split(target, '/') AS y FROM t),
c AS (SELECT *, {_REL.format(x='x', y='y')} AS rel FROM s)
SELECT id, '---' || chr(10) || 'url: https://acme.feishu.cn/docx/' || token || chr(10) || '---' || chr(10) || 'see ' || CASE WHEN hex
  THEN '[it](' || coalesce(rel, 'https://www.notion.so/Some-Title-' || upper(token) || '?v=1') || ') <' || coalesce(rel, 'https://notes.example/p/' || token || '#a') || '> https://notion.example/' || token || ' '
  ELSE '[it](' || coalesce(rel, 'https://acme.feishu.cn/docx/' || token) || ') <' || coalesce(rel, 'https://lark.example/wiki/' || token || '?from=x') || '> https://acme.feishu.cn/docx/' || token || 'DEF https://acme.feishu.cn/other/' || token || ' ' END
  || '[more](https://other.example/x)' AS body, CASE WHEN rel IS NULL THEN 0 ELSE 2 END AS rewritten FROM c"""
)
def rewrite_links(spark, d):
    """Document URLs in bodies as relative paths, by id or alias; a URL that only begins like a known one stays."""
    docs = _ledger(spark, d)
    dashless = docs.where(F.length("id") == 36).select(F.replace("id", F.lit("-"), F.lit("")).alias("alias"), F.col("id").alias("doc_id"))
    return rewrite.rewrite_bodies(_bodies(spark, d), docs, _aliases(spark, d).unionByName(dashless), _HOSTS, _DOMAINS).select("id", "body", "rewritten")


def _paths(df):
    return df.where("status = 'active' AND coalesce(path, '') <> ''").select("id", "path")


@query(
    f"""WITH {_snap_sql('now', 0)}, {_snap_sql('old', 1)}, {_LINKS}, e AS (SELECT DISTINCT from_id, to_id FROM li WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id),
o AS (SELECT * FROM old WHERE status = 'active' AND coalesce(path, '') <> ''), p AS (SELECT o.id, o.path AS old_path, n.path AS new_path FROM o JOIN now n ON n.id = o.id WHERE n.status = 'active' AND coalesce(n.path, '') <> ''),
s AS (SELECT e.*, string_split(fo.path, '/') AS fx, string_split(t.path, '/') AS ty, string_split(a.new_path, '/') AS fn, string_split(b.new_path, '/') AS tn FROM e JOIN o fo ON fo.id = e.from_id JOIN o t ON t.id = e.to_id
  LEFT JOIN p a ON a.id = e.from_id LEFT JOIN p b ON b.id = e.to_id),
r AS (SELECT from_id, to_id, {_REL.format(x='fx', y='ty')} AS was, CASE WHEN fn IS NOT NULL AND tn IS NOT NULL THEN {_REL.format(x='fn', y='tn')} END AS now FROM s)
SELECT from_id AS id, string_agg('[a](' || coalesce(now, was) || ') [b](<' || coalesce(now, was) || '>) [c](' || was || 'x)', chr(10) ORDER BY to_id) AS body, sum(CASE WHEN now <> was THEN 2 ELSE 0 END)::INTEGER AS applied FROM r GROUP BY from_id"""
)
def moved_bodies(spark, d):
    """Bodies whose links follow the documents that moved between the last two snapshots: as many links as the document has."""
    before, after = _paths(_snapshot(spark, d, 1)), _paths(_snapshot(spark, d, 0))
    edges = _links(spark, d).where("from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id").select("from_id", "to_id").distinct()
    of = lambda n: before.select(F.col("id").alias(f"{n}_id"), F.col("path").alias(f"{n}_path"))
    was = relative_path(F.col("from_path"), F.col("to_path"))
    line = F.concat(F.lit("[a]("), was, F.lit(") [b](<"), was, F.lit(">) [c]("), was, F.lit("x)"))
    lines = edges.join(of("from"), "from_id").join(of("to"), "to_id").select(F.col("from_id").alias("id"), "to_id", line.alias("line"))
    bodies = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("to_id", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return rewrite.moved_bodies(bodies, edges, before, after)


@query(
    f"""WITH {_LINKS}, t AS (SELECT link_id, from_id, to_id, replace(to_id, '-', '') AS token FROM li WHERE from_id IS NOT NULL AND to_id IS NOT NULL), h AS (SELECT *, regexp_full_match(token, '[0-9a-f]{{32}}') AS hex FROM t)
SELECT link_id, 'page' AS kind, to_id AS target FROM h WHERE hex UNION ALL SELECT link_id, 'href', regexp_extract(token, '^[A-Za-z0-9]+') FROM h WHERE NOT hex AND regexp_matches(token, '^[A-Za-z0-9]')
UNION ALL SELECT link_id, 'board', token FROM h UNION ALL SELECT link_id, 'image', token FROM h"""
)
def extracted_links(spark, d):
    """What bodies refer to: pages, databases, hyperlinks, whiteboards and images, each target once a body."""
    lit, token = F.lit, F.replace("to_id", F.lit("-"), F.lit(""))
    body = F.concat(
        lit('<page icon="x" url="https://www.notion.so/T-'), token, lit('"/>\n<pages url="https://www.notion.so/00000000000000000000000000000000">\n<database url="u" data-source-url="collection://'), F.col("to_id"), lit('">x</database>\n'),
        lit('<a href="https://acme.larksuite.com/docx/'), token, lit('?a=1&amp;b=2">x</a> <a href="https://acme.larksuite.com/wiki/'), token, lit('">again</a> <whiteboard align="1" token="'), token, lit('"></whiteboard>\n![i](https://x.example/a?b=1&amp;c=2)'),
    )
    xml = F.concat(lit('<img src="'), token, lit('" href="https://x.example/1?a=1&amp;b=2" name="n.png"/><img href="h"/>'))
    b = _links(spark, d).where("from_id IS NOT NULL AND to_id IS NOT NULL").select("link_id", body.alias("body"), xml.alias("xml"))
    hexed = b.select("link_id", F.explode(M.page_links(F.col("body"))).alias("l")).select("link_id", lit("page").alias("kind"), "l.target")
    href = b.select("link_id", lit("href").alias("kind"), F.explode(F.transform(M.href_links(F.col("body")), lambda l: l["target"])).alias("target"))
    boards = b.select("link_id", lit("board").alias("kind"), F.explode(M.whiteboard_tokens(F.col("body"))).alias("target"))
    pictures = b.select("link_id", lit("image").alias("kind"), F.explode(F.transform(M.matched_images(F.col("body"), F.col("xml")), lambda p: p["key"])).alias("target"))
    return hexed.unionByName(href.where(~F.col("target").rlike("^[0-9a-f]{32}$"))).unionByName(boards).unionByName(pictures)


@query(f"SELECT id, front || chr(10) || coalesce(title, '') || chr(10) AS file FROM ({_LIBRARY_SQL['front_matter']}) JOIN (SELECT id, title FROM ledger_documents) USING (id)")
def assembled_files(spark, d):
    """Front matter, an empty line, the body and a line end."""
    bodies = table(spark, d, "ledger_documents").select("id", F.coalesce("title", F.lit("")).alias("body"))
    return front_matter(spark, d).join(bodies, "id").select("id", F.concat("front", F.lit("\n"), "body", F.lit("\n")).alias("file"))


@query(
    f"""WITH {_snap_sql('now', 0)}, {_snap_sql('old', 1)},
a AS (SELECT DISTINCT unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS dir FROM (SELECT string_split(path, '/') AS s FROM old WHERE path IS NOT NULL)),
b AS (SELECT DISTINCT unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS dir FROM (SELECT string_split(path, '/') AS s FROM now WHERE path IS NOT NULL))
SELECT dir FROM a EXCEPT SELECT dir FROM b"""
)
def dirs_left_empty(spark, d):
    """Directories that the newest snapshot no longer fills."""
    return rewrite.dirs_left_empty(_snapshot(spark, d, 1), _snapshot(spark, d, 0))


_IMG = M.IMAGE.replace("'", "''")
_ASSETS = f"""half AS (SELECT quantile_cont(epoch_us(crawled_at), 0.5) AS t FROM documents),
refs AS (SELECT doc_id, coalesce(epoch_us(crawled_at) < t, false) AS before, regexp_replace(unnest(regexp_extract_all(text, '{_IMG}', 2)), '[?#].*$', '') AS key FROM documents, half),
ledger AS (SELECT DISTINCT key AS remote_key, sha256(key) AS sha256, 'assets/' || left(sha256(key), 2) || '/' || sha256(key) AS local_path FROM refs WHERE before),
got AS (SELECT DISTINCT key FROM refs WHERE NOT before AND (starts_with(key, 'attachment:') OR starts_with(key, 'data:'))),
outcomes AS (SELECT DISTINCT doc_id AS id, key, CASE WHEN l.remote_key IS NOT NULL THEN 'reused' WHEN got.key IS NOT NULL THEN 'downloaded' ELSE 'pending' END AS outcome
  FROM (SELECT * FROM refs WHERE NOT before) r LEFT JOIN ledger l ON l.remote_key = r.key LEFT JOIN got USING (key))"""


def _asset_round(spark, d):
    """(ledger of what the documents of the earlier half show, references of the later half, what came with a document
    itself, documents of the later half)."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.unix_micros("crawled_at").alias("t"))
    half = docs.agg(F.percentile(F.col("t"), F.lit(0.5)).alias("h")).first()["h"]
    docs = docs.withColumn("before", F.coalesce(F.col("t") < F.lit(half), F.lit(False)))
    refs = docs.select(F.col("doc_id").alias("id"), "before", F.explode(M.images(F.col("text"))).alias("t")).select("id", "before", M.asset_key(F.col("t")).alias("key"))
    digest = F.sha2("key", 256)
    with_content = lambda keys: keys.select("key", digest.alias("sha256"), X.content_path(digest, F.lit("")).alias("path"))
    empty = spark.createDataFrame([], "remote_key string, sha256 string, local_path string, status string")
    ledger = assets.mark_done(empty, with_content(refs.where("before")))
    later = refs.where("NOT before").select("id", "key")
    return ledger, later, with_content(later.where(F.col("key").startswith("attachment:") | F.col("key").startswith("data:"))), docs.where("NOT before").select(F.col("doc_id").alias("id"))


@query(f"WITH {_ASSETS} SELECT id, key, outcome FROM outcomes")
def asset_outcomes(spark, d):
    """What becomes of the assets of the later half of the documents."""
    ledger, refs, got, _ = _asset_round(spark, d)
    return assets.settle(ledger, refs, got)[1]


@query(
    f"""WITH {_ASSETS} SELECT remote_key, sha256, local_path, 'done' AS status FROM ledger
UNION ALL SELECT DISTINCT key, CASE outcome WHEN 'downloaded' THEN sha256(key) END, CASE outcome WHEN 'downloaded' THEN 'assets/' || left(sha256(key), 2) || '/' || sha256(key) END, CASE outcome WHEN 'downloaded' THEN 'done' ELSE 'pending' END FROM outcomes WHERE outcome <> 'reused'"""
)
def assets_next(spark, d):
    """The ledger of assets after that round."""
    ledger, refs, got, _ = _asset_round(spark, d)
    return assets.settle(ledger, refs, got)[0]


@query(f"WITH {_ASSETS}, n AS (SELECT 'done' AS status FROM ledger UNION ALL SELECT CASE outcome WHEN 'downloaded' THEN 'done' ELSE 'pending' END FROM (SELECT DISTINCT key, outcome FROM outcomes WHERE outcome <> 'reused')) SELECT status, count(*) AS n FROM n GROUP BY status")
def assets_by_status(spark, d):
    return assets_next(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_ASSETS} SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT id FROM outcomes WHERE outcome = 'pending') THEN 'pending_assets' ELSE 'active' END AS status FROM documents, half WHERE NOT coalesce(epoch_us(crawled_at) < t, false)")
def doc_status_after_run(spark, d):
    """The documents of that round with their status."""
    ledger, refs, got, docs = _asset_round(spark, d)
    return assets.statuses_after(docs, assets.settle(ledger, refs, got)[1])


@query(
    f"""WITH {_LEDGER}, {_NOTION}, dbs AS (SELECT id FROM notion WHERE type = 'db'), known AS (SELECT id FROM led WHERE status = 'active' AND type = 'db' UNION SELECT id FROM dbs)
SELECT id FROM dbs UNION SELECT parent_id FROM notion WHERE type = 'db_row' AND parent_id IN (SELECT id FROM known)"""
)
def dirty_databases(spark, d):
    return incremental.dirty_databases(notion_inventory(spark, d), _ledger(spark, d))


def _with_parents(spark, d, back):
    s = _snapshot_rows(spark, d, back).select(canonical_id(F.col("id")).alias("id"), canonical_id(F.col("parent_id")).alias("parent_id"), "loaded_at").where("id IS NOT NULL")
    parent = s.groupBy("id").agg(F.max_by(F.struct("parent_id"), F.struct("loaded_at", "parent_id")).alias("p")).select("id", F.col("p.parent_id").alias("parent_id"))
    return _snapshot(spark, d, back).join(parent, "id").withColumn("ord", F.xxhash64("id"))


@query()
def incremental_placement(spark, d):
    """Where the newest snapshot's new documents go beside those of the one before."""
    ship(spark)
    old = _with_parents(spark, d, 1).withColumnRenamed("path", "local_path")
    return incremental.place_new(_with_parents(spark, d, 0), old)


@query()
def new_directories(spark, d):
    """Leaves that become directories as they get their first child."""
    old = _snapshot(spark, d, 1).withColumnRenamed("path", "local_path")
    fresh = _with_parents(spark, d, 0).join(old.select("id"), "id", "left_anti")
    return incremental.new_directories(fresh, old)


@query()
def database_index(spark, d):
    """The lines of each database's row index."""
    ship(spark)
    p = render_properties(spark, d).select("raw_id", F.col("name").alias("key"), F.col("text").alias("value"))
    rows = table(spark, d, "query_rows").select("raw_id", F.col("data_source_id").alias("db_id"), canonical_id(F.col("id")).alias("doc"))
    docs = _ledger(spark, d).select(F.col("id").alias("doc"), "title", F.col("local_path").alias("path"))
    listed = rows.join(docs, "doc", "left").select("db_id", F.concat("db_id", F.lit("/_index.md")).alias("index_path"), F.col("raw_id").cast("string").alias("row_id"), "title", "path")
    props = p.join(rows, "raw_id").select("db_id", F.col("raw_id").cast("string").alias("row_id"), "key", "value")
    return indexes.database_lines(listed, props)


@query()
def bitable_tables(spark, d):
    """Bitable records as Markdown tables, or their structure alone when there are many. Every record counts and has its line; one without an object has blank cells."""
    ship(spark)
    cells = _records(spark, d).select("space_id", "table_id", "raw_id", F.explode_outer(_fields(F.col("fields"))).alias("k", "v")).withColumn("v", P.cell_text(F.col("v")))
    records = cells.groupBy("space_id", "table_id", "raw_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("cells"))
    return indexes.bitable_lines(records.select(F.concat_ws("/", "space_id", "table_id").alias("table"), "raw_id", "cells"))


@query(
    """SELECT event_id, CASE WHEN status = 429 OR status >= 500 THEN 'retry' WHEN code BETWEEN 99991661 AND 99991668 THEN 'auth' WHEN code IN (99991672, 99991679) OR regexp_matches(lower(message), 'permission|forbidden|access denied|no access|scope') THEN 'permission' WHEN regexp_matches(lower(message), '429|rate limit|too many request|frequency limit') THEN 'rate' ELSE 'other' END AS kind
FROM (SELECT event_id, 400 + event_id % 120 AS status, 99991650 + event_id % 40 AS code, CASE event_type WHEN 'error' THEN 'Access Denied for ' || user_id WHEN 'click' THEN 'Too Many Requests' ELSE event_type END AS message FROM events)"""
)
def classify_errors(spark, d):
    """Errors told apart by status, code and words."""
    e = table(spark, d, "events").select(
        "event_id", (400 + F.col("event_id") % 120).alias("status"), (99991650 + F.col("event_id") % 40).alias("code"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Access Denied for "), F.col("user_id").cast("string"))).when(F.col("event_type") == "click", "Too Many Requests").otherwise(F.col("event_type")).alias("message"),
    )
    m = F.lower("message")
    kind = (
        F.when((F.col("status") == 429) | (F.col("status") >= 500), "retry")
        .when(F.col("code").between(99991661, 99991668), "auth")
        .when(F.col("code").isin(99991672, 99991679) | m.rlike("permission|forbidden|access denied|no access|scope"), "permission")
        .when(m.rlike("429|rate limit|too many request|frequency limit"), "rate")
        .otherwise("other")
    )
    return e.select("event_id", kind.alias("kind"))


@query(
    """WITH l AS (SELECT coalesce(source, '') AS platform, len(list_filter(coalesce(cells, []), lambda c: c.cell_type = 'error')) AS u, CASE WHEN n_cells IS NULL THEN 1 ELSE 0 END AS b FROM documents)
SELECT platform, sum(u)::BIGINT AS unknown_blocks, 0::BIGINT AS bitables_rendered, 0::BIGINT AS bitables_oversize, 0::BIGINT AS bitables_failed, sum(b)::BIGINT AS truncated_pages, 0::BIGINT AS unknown_block_ids, (sum(u) + sum(b))::BIGINT AS degradations FROM l GROUP BY platform"""
)
def degradations(spark, d):
    """Losses per source: error cells as blocks that aren't known, notebooks without a cell count as truncated."""
    docs = table(spark, d, "documents")
    errors = F.size(F.filter(F.coalesce("cells", F.array().cast(docs.schema["cells"].dataType)), lambda c: c["cell_type"] == "error"))
    none = F.lit(0)
    each = docs.select(F.coalesce("source", F.lit("")).alias("platform"), errors.alias("unknown_blocks"), none.alias("bitables_rendered"), none.alias("bitables_oversize"), none.alias("bitables_failed"), F.col("n_cells").isNull().cast("int").alias("truncated_pages"), none.alias("unknown_block_ids"))
    return reports.losses(each)


@query(
    f"""WITH {_CDC}, p AS (SELECT platform, count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'gone') AS deleted, count(*) FILTER (moved) AS moved,
  count(*) FILTER (outcome = 'gone') AS f FROM cdc WHERE outcome IS NOT NULL GROUP BY platform)
SELECT sum(added)::BIGINT AS added, sum(updated)::BIGINT AS updated, sum(skipped)::BIGINT AS skipped, sum(deleted)::BIGINT AS deleted, sum(moved)::BIGINT AS moved, list(platform || ': ' || f ORDER BY platform) AS failures, []::VARCHAR[] AS warnings, list(platform ORDER BY platform) AS adapters FROM p"""
)
def merged_stats(spark, d):
    """What the last round did on all platforms together."""
    c = cdc_classify(spark, d)
    n = lambda cond: F.count(F.when(cond, 1))
    per = c.groupBy("platform").agg(*(n(F.col("outcome") == o).alias(a) for o, a in (("added", "added"), ("updated", "updated"), ("skipped", "skipped"), ("gone", "deleted"))), n(F.col("moved")).alias("moved"))
    told = per.withColumns({"failures": F.array(F.concat("platform", F.lit(": "), F.col("deleted").cast("string"))), "warnings": F.array().cast("array<string>")})
    return reports.merge_stats(told)


@query(f"WITH m AS ({_LIBRARY_SQL['mode_decision']}) SELECT platform, CASE WHEN platform = 'notion' THEN mode ELSE 'full' END AS mode, CASE WHEN platform = 'notion' AND mode <> 'full' THEN checkpoint ELSE '' END AS since, platform <> 'notion' OR mode = 'full' AS deletes, platform <> 'notion' OR mode = 'full' AS indexes FROM m")
def round_plan(spark, d):
    """How the next round of each platform runs: only one of them can scan incrementally."""
    return reports.plan_round(mode_decision(spark, d), ("notion",))


@query(f"WITH {_RUNS}, r AS (SELECT platform, id, checkpoint FROM runs) SELECT id, platform, coalesce(CASE WHEN checkpoint = '' THEN lag(checkpoint) OVER (PARTITION BY platform ORDER BY id) ELSE checkpoint END, '') AS checkpoint FROM r")
def checkpoints_kept(spark, d):
    """The checkpoint that each run leaves: a failed one that of the run before it."""
    before = runs.before(_runs(spark, d), "checkpoint")
    return before.select("id", "platform", reports.kept_checkpoint(F.col("before"), F.col("checkpoint"), F.col("checkpoint") == "").alias("checkpoint"))


@query(
    """SELECT id, CASE WHEN type IN ('docx', 'page', 'db_row') THEN coalesce(title, '') ELSE '> Standalone resource node (' || type || '): this content is not expanded in the mirror; drill down or open the original online to view it.' || chr(10) || '>' || chr(10)
  || '> Drill-down token: `' || id || '`' || CASE WHEN coalesce(local_path, '') <> '' THEN chr(10) || '>' || chr(10) || '> View online: https://notes.example/' || local_path ELSE '' END END AS body FROM ledger_documents WHERE type IS NOT NULL"""
)
def selected_bodies(spark, d):
    """The body of each document: what was fetched for kinds that have text, else a note of where it is."""
    t = table(spark, d, "ledger_documents").where("type IS NOT NULL")
    url = F.when(F.coalesce("local_path", F.lit("")) != "", F.concat(F.lit("https://notes.example/"), "local_path"))
    return t.select("id", M.selected_body(F.col("type"), F.coalesce("title", F.lit("")), F.lit(None).cast("string"), F.col("id"), url).alias("body"))


@query(
    """WITH e AS (SELECT raw_id, space_id AS token, table_id, 'v' || raw_id % 3 AS view_id, raw_id % 4 AS k FROM bitable_records)
SELECT raw_id, 'a' || chr(10) || '<!-- doclake:base_refer ' || CASE WHEN k = 0 THEN '' ELSE 'table-id="' || table_id || '" ' END || 'token="' || token || '" view-id="' || view_id || '" -->' || chr(10) || chr(10)
  || CASE k WHEN 0 THEN '' WHEN 1 THEN '> Failed to fetch the bitable; open it online to view. ' ELSE 'T' || raw_id || chr(10) || chr(10) END
  || '[Open the bitable in Feishu](https://acme.feishu.cn/base/' || token || '?' || CASE WHEN k = 0 THEN '' ELSE 'table=' || table_id || '&' END || 'view=' || view_id || ')' || ' z' AS body,
  CASE k WHEN 0 THEN 'failed' WHEN 1 THEN 'failed' WHEN 2 THEN 'rendered' ELSE 'oversize' END AS outcome FROM e"""
)
def embedded_bitables(spark, d):
    """Tables embedded in bodies, in all four outcomes: not named in full, not fetched, shown, too long to be shown."""
    k, lit = F.col("raw_id") % 4, F.lit
    e = table(spark, d, "bitable_records").select("raw_id", "space_id", "table_id", k.alias("k"))
    tag = F.concat(lit('<base_refer view-id="v'), (F.col("raw_id") % 3).cast("string"), lit('" token="'), "space_id", F.when(F.col("k") == 0, lit("")).otherwise(F.concat(lit('" table-id="'), "table_id")), lit('"> </base_refer>'))
    bodies = e.select(F.col("raw_id").alias("id"), F.concat(lit("a\n"), tag, lit(" z")).alias("body"), lit("https://acme.feishu.cn/docx/x").alias("url"))
    known = e.where("k > 1").groupBy("space_id", "table_id", "raw_id").agg(F.max("k").alias("k"))
    shown = known.select(F.col("raw_id").alias("id"), F.col("space_id").alias("token"), "table_id", F.concat(lit("T"), F.col("raw_id").cast("string")).alias("text"), (F.col("k") == 3).alias("oversize"))
    got = indexes.embed_bitables(bodies, shown)
    return got.select(F.col("id").alias("raw_id"), "body", F.get("outcomes", lit(0)).alias("outcome"))


@query(
    f"""WITH q AS ({_LIBRARY_SQL['quota_usage']}), r AS (SELECT min(remaining) AS r FROM q), n AS (SELECT count(*) AS n FROM notion_objects),
c AS (SELECT * FROM (VALUES (1, 'G0', 'config'), (2, 'G1', 'mirror-root'), (3, 'G2', 'quota'), (4, 'F1', 'lark-engine'), (5, 'F2', 'lark-auth'), (6, 'F3', 'lark-scope-wiki'), (7, 'F3', 'lark-scope-docs'), (8, 'F3', 'lark-scope-drive'),
  (9, 'F4', 'lark-output-format'), (10, 'F5', 'feishu-mirror-scope'), (11, 'N1', 'notion-env'), (12, 'N2', 'notion-token'), (13, 'N3', 'notion-visible')) t(nth, code, name))
SELECT nth, code, name, CASE name WHEN 'quota' THEN CASE WHEN r <= 0 THEN 'fail' WHEN r < 2000 THEN 'warn' ELSE 'pass' END WHEN 'notion-visible' THEN CASE WHEN n = 0 THEN 'warn' ELSE 'pass' END ELSE 'skip' END AS status,
  CASE WHEN code LIKE 'F%' THEN 'feishu not configured' WHEN name = 'quota' THEN 'remaining ' || r WHEN name = 'notion-visible' THEN n::VARCHAR ELSE '' END AS detail FROM c, r, n"""
)
def health_rows(spark, d):
    """The fixed rows of a health report from what the tables tell: quota and visible objects are measured, the rest skipped."""
    left = quota_usage(spark, d).agg(F.min("remaining").alias("r"))
    quota = left.select(F.lit("quota").alias("name"), F.when(F.col("r") <= 0, "fail").when(F.col("r") < 2_000, "warn").otherwise("pass").alias("status"), F.concat(F.lit("remaining "), F.col("r").cast("string")).alias("detail"))
    seen = table(spark, d, "notion_objects").agg(F.count("*").alias("n"))
    visible = seen.select(F.lit("notion-visible").alias("name"), F.when(F.col("n") == 0, "warn").otherwise("pass").alias("status"), F.col("n").cast("string").alias("detail"))
    return reports.health(quota.unionByName(visible), ("notion",))
