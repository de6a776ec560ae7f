"""Queries of the document library, each with its SQL: inventories, placement, changes, runs, links, properties, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions import markup as M
from doclake.functions import naming as N
from doclake.functions import properties as P
from doclake.functions import text as X
from doclake.functions.ids import BLANK, canonical_id, canonical_id_sql, strip
from doclake.operators import changes, ledger, links, placement, runs
from doclake.session import cut, ship, table
from doclake.sources import inventory as I
from doclake.sources import landed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


_id = canonical_id_sql

# ---------------------------------------------------------------- relations


def _object_sql(c: str) -> str:
    """The object that a JSON text holds, directly or as the content of a string, else '{}'. DuckDB's parser lets a comma
    before a closing bracket pass, which isn't JSON."""
    held = f"CASE WHEN json_valid({c}) AND json_type({c}) = 'VARCHAR' THEN json_extract_string({c}, '$') ELSE {c} END"
    return f"CASE WHEN json_valid({held}) AND json_type({held}) = 'OBJECT' AND NOT regexp_matches({held}, ',\\s*[}}\\]]') THEN {held} ELSE '{{}}' END"


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger_documents").withColumns({"id": canonical_id(F.col("id")), "parent_id": canonical_id(F.col("parent_id"))})


_LEDGER = f"led AS (SELECT * REPLACE ({_id('id')} AS id, {_id('parent_id')} AS parent_id) FROM ledger_documents)"


def _snapshot_rows(spark: SparkSession, d: str, back: int) -> DataFrame:
    """The rows of the newest snapshot (``back`` 0) or of the one before it (1); none where there are too few."""
    s = table(spark, d, "ledger_snapshots")
    numbers = [r[0] for r in s.select("snap_no").where("snap_no IS NOT NULL").distinct().orderBy(F.desc("snap_no")).limit(back + 1).collect()]
    return s.where(F.col("snap_no") == numbers[back] if len(numbers) > back else F.lit(False))


def _snapshot(spark: SparkSession, d: str, back: int) -> DataFrame:
    """One full snapshot as rows of the ledger; of repeated ids the latest load."""
    s = _snapshot_rows(spark, d, back).withColumn("id", canonical_id(F.col("id"))).where("id IS NOT NULL")
    cols = ["loaded_at", "local_path", "remote_edited", "content_hash", "status", "platform", "title", "type"]
    best = s.groupBy("id").agg(F.max(F.struct(*cols)).alias("r"))
    return best.select("id", F.col("r.platform").alias("platform"), F.col("r.local_path").alias("path"), F.col("r.remote_edited").alias("edited"), F.col("r.content_hash").alias("hash"), F.col("r.status").alias("status"), F.col("r.title").alias("title"), F.col("r.type").alias("type"))


def _snap_sql(name: str, back: int) -> str:
    return f"""{name} AS (SELECT id, r.platform AS platform, r.local_path AS path, r.remote_edited AS edited, r.content_hash AS hash, r.status AS status, r.title AS title, r.type AS type FROM (
  SELECT {_id('id')} AS id, arg_max(struct_pack(platform := platform, local_path := local_path, remote_edited := remote_edited, content_hash := content_hash, status := status, title := title, type := type),
    [epoch_us(loaded_at)::VARCHAR, coalesce(local_path, ''), coalesce(remote_edited, ''), coalesce(content_hash, ''), coalesce(status, ''), coalesce(platform, ''), coalesce(title, ''), coalesce(type, '')]) AS r
  FROM ledger_snapshots WHERE snap_no = (SELECT DISTINCT snap_no FROM ledger_snapshots WHERE snap_no IS NOT NULL ORDER BY 1 DESC LIMIT 1 OFFSET {back}) GROUP BY 1) WHERE id IS NOT NULL)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """The event stream read as run records."""
    e = table(spark, d, "events")
    mode = F.when(F.col("event_type") == "signup", "full").when(F.col("event_type") == "click", "").otherwise("incremental")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    return e.select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "notion").otherwise("feishu").alias("platform"), F.col("ts").alias("started_at"),
        F.when(F.col("event_type") == "error", "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("checkpoint"),
        F.concat(F.lit('{"mode":"'), mode, F.lit('","assets_downloaded":'), k, F.lit("}")).alias("stats"),
    )


_RUNS = """runs AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'notion' ELSE 'feishu' END AS platform, ts AS started_at,
  CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS checkpoint,
  CASE WHEN event_type IN ('signup', 'click') THEN 'full' ELSE 'incremental' END AS mode, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS assets FROM events)"""


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki_nodes").select(strip(F.col("node_token")).alias("alias"), canonical_id(F.col("obj_token")).alias("doc_id")).where("alias <> '' AND doc_id IS NOT NULL").distinct()


_ALIASES = f"al AS (SELECT DISTINCT {_strip('node_token')} AS alias, {_id('obj_token')} AS doc_id FROM wiki_nodes WHERE {_strip('node_token')} <> '' AND {_id('obj_token')} IS NOT NULL)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").select("link_id", canonical_id(F.col("from_id")).alias("from_id"), canonical_id(F.col("to_id")).alias("to_id"))


_LINKS = f"li AS (SELECT link_id, {_id('from_id')} AS from_id, {_id('to_id')} AS to_id FROM links)"

# ---------------------------------------------------------------- ledger reports


@query("SELECT platform, status, count(*) AS n FROM ledger_documents GROUP BY ALL")
def docs_by_platform_status(spark, d):
    return table(spark, d, "ledger_documents").groupBy("platform", "status").agg(F.count("*").alias("n"))


@query("SELECT platform, status, count(*) AS n FROM ledger_documents GROUP BY GROUPING SETS ((), (platform), (status))")
def docs_grouping_sets(spark, d):
    t = table(spark, d, "ledger_documents")
    return t.groupingSets([[], [t["platform"]], [t["status"]]], t["platform"], t["status"]).agg(F.count("*").alias("n"))


@query(f"WITH {_LEDGER} SELECT platform, parent_id, count(*) AS n FROM led WHERE status = 'active' AND parent_id IS NOT NULL GROUP BY ALL")
def children_count(spark, d):
    return _ledger(spark, d).where("status = 'active' AND parent_id IS NOT NULL").groupBy("platform", "parent_id").agg(F.count("*").alias("n"))


@query(f"WITH {_LEDGER} SELECT id, parent_id FROM led l WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM led p WHERE p.id = l.parent_id)")
def orphan_documents(spark, d):
    docs = _ledger(spark, d)
    there = docs.select(F.col("id").alias("_p"))
    return docs.where("parent_id IS NOT NULL").join(there, F.col("parent_id") == F.col("_p"), "left_anti").select("id", "parent_id")


@query(f"WITH {_LEDGER} SELECT id, type IN ('folder', 'db') OR EXISTS (SELECT 1 FROM led c WHERE c.parent_id = l.id) AS is_dir, type NOT IN ('folder', 'db') AS has_body FROM led l")
def is_dir_has_body(spark, d):
    docs = _ledger(spark, d)
    parents = docs.select(F.col("parent_id").alias("_p")).where("_p IS NOT NULL").distinct()
    box = F.col("type").isin(*placement.CONTAINERS)
    return docs.join(parents, F.col("id") == F.col("_p"), "left").select("id", (box | F.col("_p").isNotNull()).alias("is_dir"), (~box).alias("has_body"))


@query("SELECT local_path, count(*) AS n FROM ledger_documents WHERE local_path IS NOT NULL GROUP BY local_path HAVING count(*) > 1")
def uniqueness_violations(spark, d):
    return ledger.duplicates(table(spark, d, "ledger_documents"), ["local_path"])


@query("SELECT platform, title, count(*) AS n FROM ledger_documents WHERE platform IS NOT NULL AND title IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def repeated_titles(spark, d):
    """Titles that several documents of a platform share."""
    return ledger.duplicates(table(spark, d, "ledger_documents"), ["platform", "title"])


@query("SELECT platform, string_agg(status || '=' || n, ' ' ORDER BY status) AS counts FROM (SELECT platform, status, count(*) AS n FROM ledger_documents WHERE status IS NOT NULL GROUP BY ALL) GROUP BY platform")
def status_line(spark, d):
    c = table(spark, d, "ledger_documents").where("status IS NOT NULL").groupBy("platform", "status").agg(F.count("*").alias("n"))
    return c.groupBy("platform").agg(F.array_join(F.array_sort(F.collect_list(F.concat("status", F.lit("="), F.col("n").cast("string")))), " ").alias("counts"))


_INDEXED = "FROM ledger_documents WHERE status = 'active' AND coalesce(local_path, '') <> ''"


@query(f"SELECT platform, count(*) AS n {_INDEXED} AND type <> 'folder' GROUP BY platform UNION ALL SELECT 'total', count(*) {_INDEXED} AND type <> 'folder'")
def index_header(spark, d):
    t = table(spark, d, "ledger_documents").where("status = 'active' AND coalesce(local_path, '') <> '' AND type <> 'folder'")
    return t.groupBy("platform").agg(F.count("*").alias("n")).unionByName(t.agg(F.count("*").alias("n")).withColumn("platform", F.lit("total")))


@query(
    f"""WITH e AS (SELECT local_path AS path, type, regexp_replace(local_path, '/README\\.md$', '') AS slot, coalesce(title, '') AS title {_INDEXED}),
f AS (SELECT *, CASE WHEN title <> '' THEN title ELSE string_split(regexp_replace(slot, '\\.md$', ''), '/')[-1] END AS label, CASE WHEN type = 'folder' THEN NULL WHEN type = 'db' THEN path || '/_index.md' ELSE path END AS target FROM e)
SELECT slot, len(string_split(slot, '/')) - 1 AS depth,
  CASE WHEN target IS NULL THEN replace(replace(label, '[', '\\['), ']', '\\]') ELSE '[' || replace(replace(label, '[', '\\['), ']', '\\]') || '](' || CASE WHEN regexp_matches(target, '[ ()]') THEN '<' || target || '>' ELSE target END || ')' END AS entry FROM f"""
)
def index_entries(spark, d):
    """One line of the library's index per active document."""
    t = table(spark, d, "ledger_documents").where("status = 'active' AND coalesce(local_path, '') <> ''")
    slot = X.container_dir(F.col("local_path"))
    title = F.coalesce("title", F.lit(""))
    label = X.link_text(F.when(title != "", title).otherwise(F.element_at(F.split(F.regexp_replace(slot, r"\.md$", ""), "/"), -1)))
    target = F.when(F.col("type") == "folder", F.lit(None)).when(F.col("type") == "db", F.concat("local_path", F.lit("/_index.md"))).otherwise(F.col("local_path"))
    entry = F.when(target.isNull(), label).otherwise(F.concat(F.lit("["), label, F.lit("]("), X.link_dest(target), F.lit(")")))
    return t.select(slot.alias("slot"), (F.size(F.split(slot, "/")) - 1).cast("bigint").alias("depth"), entry.alias("entry"))


# ---------------------------------------------------------------- inventories

_NOTION = f"""notion AS (SELECT {_id('id')} AS id, CASE WHEN object = 'page' THEN lower(replace({_strip('id')}, '-', '')) ELSE coalesce(lower(replace({_strip('parent.database_id')}, '-', '')), '') END AS alt_id, 'notion' AS platform,
  CASE WHEN object = 'data_source' THEN 'db' WHEN parent.type = 'data_source_id' THEN 'db_row' ELSE 'page' END AS type,
  CASE parent.type WHEN 'workspace' THEN '' WHEN 'page_id' THEN coalesce({_id('parent.page_id')}, '') WHEN 'data_source_id' THEN coalesce({_id('parent.data_source_id')}, '')
    ELSE coalesce({_id('parent.page_id')}, {_id('parent.data_source_id')}, {_id('parent.database_id')}, 'notion:unresolved') END AS parent_id,
  CASE WHEN object = 'page' THEN coalesce(title, '') ELSE coalesce(nullif(title, ''), 'Untitled Database') END AS title,
  CASE WHEN regexp_full_match(last_edited_time, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})') THEN coalesce(strftime(TRY_CAST(last_edited_time AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), '') ELSE '' END AS edited_at,
  coalesce(url, '') AS url, rec_id AS ord FROM notion_objects WHERE object IN ('page', 'data_source') AND NOT (coalesce(in_trash, false) OR coalesce(is_archived, false)))"""


@query(f"WITH {_NOTION} SELECT * FROM notion")
def notion_inventory(spark, d):
    return I.notion(table(spark, d, "notion_objects"))


def _type_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.OBJECT_TYPES.items()) + " ELSE 'file' END"


_WIKI = f"""n AS (SELECT DISTINCT * REPLACE ({_strip('node_token')} AS node_token, {_strip('parent_node_token')} AS parent_node_token) FROM wiki_nodes),
up AS (SELECT node_token, min({_strip('obj_token')}) AS o FROM n GROUP BY 1),
wiki AS (SELECT {_strip('obj_token')} AS id, n.node_token AS alt_id, 'feishu' AS platform, {_type_sql('obj_type')} AS type, coalesce(up.o, 'feishu:wiki:' || space_id) AS parent_id, coalesce(title, '') AS title, '' AS edited_at, '' AS url, 1::BIGINT AS ord
  FROM n LEFT JOIN up ON up.node_token = n.parent_node_token
  UNION ALL SELECT 'feishu:wiki:' || s.space_id, '', 'feishu', 'folder', '', 'wiki-' || coalesce(nullif(name, ''), s.space_id), '', '', 0 FROM (SELECT DISTINCT space_id FROM n) s LEFT JOIN spaces USING (space_id))"""
_UNIX = "CASE WHEN regexp_full_match({0}, '[0-9]{{1,11}}') THEN strftime(make_timestamp(CAST({0} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END"
_DRIVE = f"""drive AS (SELECT {_strip('token')} AS id, '' AS alt_id, 'feishu' AS platform, {_type_sql('type')} AS type, coalesce(nullif({_strip('parent_token')}, ''), 'feishu:drive:' || space_id) AS parent_id, coalesce(name, '') AS title,
  coalesce({_UNIX.format('modified_time')}, '') AS edited_at, coalesce(url, '') AS url, rec_id AS ord FROM drive_files
  UNION ALL SELECT DISTINCT 'feishu:drive:' || space_id, '', 'feishu', 'folder', '', 'drive-' || space_id, '', '', 0 FROM drive_files)"""
_FEISHU = f"""metas AS (SELECT {_strip('doc_token')} AS t, arg_max(struct_pack(url := url, m := latest_modify_time), rec_id) AS r FROM feishu_metas GROUP BY 1),
feishu AS (SELECT f.* REPLACE (coalesce(nullif(r.url, ''), f.url) AS url, coalesce(nullif({_UNIX.format('r.m')}, ''), f.edited_at) AS edited_at) FROM (SELECT * FROM wiki UNION ALL SELECT * FROM drive) f LEFT JOIN metas ON metas.t = f.id)"""


@query(f"WITH {_WIKI} SELECT * FROM wiki")
def wiki_inventory(spark, d):
    return I.wiki(table(spark, d, "wiki_nodes"), table(spark, d, "spaces"))


@query(f"WITH {_DRIVE} SELECT * FROM drive")
def drive_inventory(spark, d):
    return I.drive(table(spark, d, "drive_files"))


@query(f"WITH {_WIKI}, {_DRIVE}, {_FEISHU} SELECT * FROM feishu")
def feishu_inventory(spark, d):
    return I.feishu(table(spark, d, "wiki_nodes"), table(spark, d, "drive_files"), table(spark, d, "feishu_metas"), table(spark, d, "spaces"))


def _all_docs(spark, d):
    return I.notion(table(spark, d, "notion_objects")).unionByName(feishu_inventory(spark, d))


@query(f"WITH {_NOTION}, {_WIKI}, {_DRIVE}, {_FEISHU} SELECT platform, type, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT * FROM notion UNION ALL SELECT * FROM feishu) GROUP BY ALL")
def inventory_summary(spark, d):
    return _all_docs(spark, d).groupBy("platform", "type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(
    """SELECT space_id, table_id, raw_id FROM (SELECT space_id, table_id, raw_id, row_number() OVER (PARTITION BY space_id, table_id ORDER BY raw_id) AS nth FROM bitable_records) WHERE nth <= 201"""
)
def bitable_bounded(spark, d):
    """At most one row more than the inline threshold of each table, which tells that it is over."""
    nth = F.row_number().over(Window.partitionBy("space_id", "table_id").orderBy("raw_id"))
    return table(spark, d, "bitable_records").select("space_id", "table_id", "raw_id").withColumn("nth", nth).where("nth <= 201").drop("nth")


# ---------------------------------------------------------------- placement


def _placeable(spark, d):
    docs = _ledger(spark, d)
    # The order of enumeration: when the document first came in.
    return docs.where("id IS NOT NULL").select("platform", "id", "parent_id", "type", "title", F.unix_micros("first_seen_at").alias("ord"))


_PLACE = f"""{_LEDGER}, nodes AS (SELECT platform, id, parent_id, type, coalesce(title, '') AS title, epoch_us(first_seen_at) AS ord FROM led WHERE id IS NOT NULL),
up AS (SELECT n.*, CASE WHEN n.parent_id IS NULL THEN NULL WHEN p.id IS NULL THEN n.platform || ':_orphans' ELSE n.parent_id END AS parent FROM nodes n LEFT JOIN nodes p ON p.platform = n.platform AND p.id = n.parent_id),
based AS (SELECT *, {_strip("regexp_replace(title, '[/\\\\:*?\"<>|\\x00-\\x1F]', '', 'g')")} AS slug, '-' || left(id, 8) AS suffix FROM up),
bases AS (SELECT *, CASE WHEN slug = '' THEN 'untitled' || suffix WHEN lower(slug) IN ('readme', '_index', 'index', 'assets', '_orphans', '.internal', 'claude', 'agents') THEN slug || suffix ELSE slug END AS base,
  slug = '' OR lower(slug) IN ('readme', '_index', 'index', 'assets', '_orphans', '.internal', 'claude', 'agents') AS forced FROM based),
named AS (SELECT *, CASE WHEN forced OR row_number() OVER (PARTITION BY platform, parent, lower(base) ORDER BY ord, id) = 1 THEN base ELSE base || suffix END AS name FROM bases),
sib AS (SELECT platform, id, parent, type, title, name FROM named
  UNION ALL SELECT DISTINCT platform, platform || ':_orphans', CAST(NULL AS VARCHAR), 'folder', '_orphans', '_orphans' FROM named WHERE parent = platform || ':_orphans'),
dirs AS (SELECT s.*, type IN ('folder', 'db') OR EXISTS (SELECT 1 FROM sib c WHERE c.platform = s.platform AND c.parent = s.id) AS is_dir, type NOT IN ('folder', 'db') AS has_body FROM sib s),
walk AS (SELECT platform, id, title, is_dir, has_body, platform || '/' || name AS place, '' AS breadcrumb, 0 AS depth FROM dirs WHERE parent IS NULL
  UNION ALL SELECT c.platform, c.id, c.title, c.is_dir, c.has_body, w.place || '/' || c.name, CASE WHEN w.title = '' THEN w.breadcrumb WHEN w.breadcrumb = '' THEN w.title ELSE w.breadcrumb || ' / ' || w.title END, w.depth + 1
  FROM walk w JOIN dirs c ON c.platform = w.platform AND c.parent = w.id)"""


@query(f"WITH RECURSIVE {_PLACE} SELECT platform, id, depth, CASE WHEN is_dir THEN place END AS dir_path, CASE WHEN NOT is_dir THEN place || '.md' WHEN has_body THEN place || '/README.md' END AS body_path, breadcrumb FROM walk")
def placement_paths(spark, d):
    """Path and breadcrumb of every document that hangs on a root."""
    ship(spark)
    return placement.place(_placeable(spark, d)).select("platform", "id", "depth", "dir_path", "body_path", "breadcrumb")


@query(
    f"""WITH RECURSIVE {_LEDGER}, e AS (SELECT l.platform, l.id, p.id AS parent FROM led l LEFT JOIN led p ON p.platform = l.platform AND p.id = l.parent_id WHERE l.id IS NOT NULL),
w AS (SELECT platform, id FROM e WHERE parent IS NULL UNION ALL SELECT e.platform, e.id FROM w JOIN e ON e.platform = w.platform AND e.parent = w.id)
SELECT platform, id FROM e EXCEPT SELECT platform, id FROM w"""
)
def cycle_audit(spark, d):
    """Documents that can't be placed because their parents run in a loop."""
    return placement.on_loops(_placeable(spark, d))


@query(f"WITH {_LEDGER} SELECT id, {_strip('regexp_replace(title, ' + chr(39) + '[/' + chr(92) * 2 + ':*?' + chr(34) + '<>|' + chr(92) + 'x00-' + chr(92) + 'x1F]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS slug, left(id, 8) AS prefix FROM led WHERE title IS NOT NULL")
def slugs(spark, d):
    return _ledger(spark, d).where("title IS NOT NULL").select("id", N.slug(F.col("title")).alias("slug"), N.id_prefix(F.col("id")).alias("prefix"))


# ---------------------------------------------------------------- changes

_CDC = f"""{_snap_sql('now', 0)}, {_snap_sql('old', 1)}, j AS (SELECT coalesce(now.id, old.id) AS id, coalesce(now.platform, old.platform) AS platform, now.id AS new_id, old.id AS old_id, coalesce(old.status = 'active', false) AS active, old.status AS old_status,
  old.path AS old_path, now.path AS new_path, now.edited AS ne, old.edited AS oe, now.hash AS nh, old.hash AS oh FROM now FULL JOIN old ON now.id = old.id),
cdc AS (SELECT id, platform, CASE WHEN new_id IS NULL THEN CASE WHEN active THEN 'gone' END WHEN old_id IS NULL THEN 'added'
   WHEN (active AND coalesce(ne, '') <> '' AND ne IS NOT DISTINCT FROM oe) OR (active AND nh IS NOT NULL AND nh IS NOT DISTINCT FROM oh) THEN 'skipped' ELSE 'updated' END AS outcome,
  new_id IS NOT NULL AND old_id IS NOT NULL AND coalesce(old_status, '') <> 'trashed' AND coalesce(old_path, '') <> '' AND old_path IS DISTINCT FROM new_path AS moved, old_path, new_path FROM j)"""


@query(f"WITH {_CDC} SELECT * FROM cdc WHERE outcome IS NOT NULL")
def cdc_classify(spark, d):
    """The newest snapshot as an inventory against the one before as the ledger."""
    return changes.classify(_snapshot(spark, d, 0), _snapshot(spark, d, 1))


@query(f"WITH {_CDC} SELECT platform, outcome, moved, count(*) AS n FROM cdc WHERE outcome IS NOT NULL GROUP BY ALL")
def cdc_summary(spark, d):
    return cdc_classify(spark, d).groupBy("platform", "outcome", "moved").agg(F.count("*").alias("n"))


@query(f"WITH {_CDC} SELECT id, old_path, new_path FROM cdc WHERE moved")
def moves(spark, d):
    return cdc_classify(spark, d).where("moved").select("id", "old_path", "new_path")


@query(
    f"""WITH {_snap_sql('now', 0)}, {_snap_sql('old', 1)}, a AS (SELECT platform, count(*) AS n FROM old WHERE status = 'active' GROUP BY 1), s AS (SELECT platform, count(*) AS n FROM now GROUP BY 1)
SELECT o.platform, o.id, o.path FROM old o JOIN a USING (platform) LEFT JOIN s USING (platform) WHERE o.status = 'active' AND coalesce(s.n, 0) >= a.n * 0.8 AND o.id NOT IN (SELECT id FROM now)"""
)
def deletes_guarded(spark, d):
    """What is to be trashed, the longest paths first, so that a directory is empty when its turn comes."""
    return changes.deepest_first(changes.guarded_deletes(_snapshot(spark, d, 0), _snapshot(spark, d, 1)), "path")


#: Days that trashed documents are kept.
RETENTION = 30


def _retention_cutoff(rows: DataFrame) -> str:
    """RETENTION days before the last sync, as the ledger writes times."""
    last = rows.agg(F.max(F.to_timestamp("synced_at")).alias("t"))
    return last.select(F.date_format(F.col("t") - F.expr(f"INTERVAL {RETENTION} DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0] or ""


_CUTOFF = f"c AS (SELECT strftime(max(CAST(synced_at AS TIMESTAMP)) - INTERVAL {RETENTION} DAY, '%Y-%m-%dT%H:%M:%SZ') AS cutoff FROM ledger_snapshots)"


@query(f"WITH {_CUTOFF} SELECT snap_no, id, status, synced_at FROM ledger_snapshots, c WHERE NOT (coalesce(status, '') = 'trashed' AND coalesce(synced_at, '~') < cutoff)")
def trash_purged(spark, d):
    """All snapshots after the retention cutoff."""
    rows = table(spark, d, "ledger_snapshots")
    return ledger.purge_trashed(rows, _retention_cutoff(rows)).select("snap_no", "id", "status", "synced_at")


@query(f"WITH {_CUTOFF} SELECT left(synced_at, 10) AS day, count(*) AS n FROM ledger_snapshots, c WHERE status = 'trashed' AND left(synced_at, 10) < left(cutoff, 10) GROUP BY 1")
def trash_buckets(spark, d):
    """Day buckets of the trash, over all snapshots, that are older than the cutoff's day."""
    rows = table(spark, d, "ledger_snapshots")
    day = F.left("synced_at", F.lit(10))
    return rows.where((F.col("status") == "trashed") & (day < _retention_cutoff(rows)[:10])).groupBy(day.alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {_snap_sql('now', 0)}, {_snap_sql('old', 1)} SELECT id, platform, path, status FROM now UNION ALL SELECT id, platform, path, status FROM old WHERE id NOT IN (SELECT id FROM now)")
def snapshot_merge(spark, d):
    cols = ["id", "platform", "path", "status"]
    return ledger.upsert(_snapshot(spark, d, 1).select(*cols), _snapshot(spark, d, 0).select(*cols), ["id"])


@query(f"WITH {_LINKS} SELECT DISTINCT from_id, to_id FROM li WHERE from_id IS NOT NULL AND to_id IS NOT NULL")
def links_inserted(spark, d):
    rows = _links(spark, d).where("from_id IS NOT NULL AND to_id IS NOT NULL").select("from_id", "to_id")
    empty = spark.createDataFrame([], rows.schema)
    return ledger.insert_ignore(empty, rows, ["from_id", "to_id"])


@query(f"SELECT alias, arg_max(doc_id, doc_id) AS doc_id FROM (WITH {_ALIASES} SELECT * FROM al) GROUP BY alias")
def aliases_upserted(spark, d):
    rows = _aliases(spark, d).withColumn("seq", F.col("doc_id"))
    empty = spark.createDataFrame([], "alias string, doc_id string")
    return ledger.upsert_alias(empty, rows, "seq")


# ---------------------------------------------------------------- runs


@query(f"WITH {_RUNS} SELECT platform, id, nth FROM (SELECT platform, id, row_number() OVER (PARTITION BY platform ORDER BY id DESC) AS nth FROM runs) WHERE nth <= 64")
def recent_runs(spark, d):
    return runs.recent(_runs(spark, d)).select("platform", "id", "nth")


@query(f"WITH {_RUNS} SELECT platform, max(id) AS id, arg_max(started_at, id) AS started_at FROM runs GROUP BY platform")
def latest_run_per_platform(spark, d):
    return runs.latest(_runs(spark, d)).select("platform", "id", "started_at")


@query(f"WITH {_RUNS} SELECT platform, arg_max(checkpoint, id) AS checkpoint FROM runs WHERE checkpoint <> '' GROUP BY platform")
def latest_checkpoint(spark, d):
    return runs.latest_checkpoint(_runs(spark, d))


_STREAK = f"""{_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY id DESC) AS nth FROM runs),
s AS (SELECT platform, sum(CASE WHEN mode = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY platform ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS fulls FROM r WHERE nth <= 64),
streak AS (SELECT platform, count(*) FILTER (fulls = 0) AS streak FROM s GROUP BY platform)"""


@query(f"WITH {_STREAK} SELECT * FROM streak")
def incremental_streak(spark, d):
    return runs.streak(_runs(spark, d))


@query(
    f"""WITH {_STREAK}, l AS (SELECT platform, arg_max(started_at, id) AS last FROM runs GROUP BY 1), c AS (SELECT platform, arg_max(checkpoint, id) AS checkpoint FROM runs WHERE checkpoint <> '' GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT platform, CASE WHEN checkpoint IS NULL OR CAST(last AS DATE) <> CAST(now AS DATE) OR streak + 1 >= 4 THEN 'full' ELSE 'incremental' END AS mode, streak, coalesce(checkpoint, '') AS checkpoint
FROM l LEFT JOIN c USING (platform) LEFT JOIN streak USING (platform), m"""
)
def mode_decision(spark, d):
    """Whether the next round of each platform is a full one, every fourth at least, as of the last event."""
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    return runs.modes(_runs(spark, d), F.lit(now).cast("timestamp"), 4)


@query(f"WITH {_RUNS}, f AS (SELECT platform, id, CAST(started_at AS DATE) AS day, lag(CAST(started_at AS DATE)) OVER (PARTITION BY platform ORDER BY id) AS before FROM runs) SELECT platform, id FROM f WHERE before IS NULL OR before <> day")
def daily_first_runs(spark, d):
    return runs.first_of_day(_runs(spark, d)).where("first").select("platform", "id")


@query("SELECT event_id FROM events, (SELECT max(ts) - INTERVAL 1 DAY AS ck FROM events) WHERE ts >= ck - INTERVAL 5 MINUTES")
def incremental_scan(spark, d):
    """Events not older than a checkpoint less the look-back; a plain filter on the scan."""
    e = table(spark, d, "events")
    ck = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("ck")).first()["ck"]
    return e.where(runs.in_window(F.col("ts"), F.lit(ck).cast("timestamp"))).select("event_id")


@query("SELECT greatest(max(edited), '2025-01-01T00:00:00Z') AS checkpoint FROM (SELECT remote_edited AS edited FROM ledger_documents WHERE regexp_full_match(remote_edited, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z'))")
def next_checkpoint(spark, d):
    """The latest edit time seen, not before the checkpoint so far; unparseable times don't count."""
    t = table(spark, d, "ledger_documents").where(F.col("remote_edited").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"))
    return t.agg(F.greatest(F.max("remote_edited"), F.lit("2025-01-01T00:00:00Z")).alias("checkpoint"))


@query(f"WITH {_RUNS}, m AS (SELECT date_trunc('day', max(started_at)) AS midnight FROM runs) SELECT platform, sum(assets)::BIGINT AS used, 10000 - sum(assets)::BIGINT AS remaining FROM runs, m WHERE started_at >= midnight GROUP BY platform")
def quota_usage(spark, d):
    r = _runs(spark, d)
    midnight = r.agg(F.date_trunc("day", F.max("started_at")).alias("m")).first()["m"]
    used = r.where(F.col("started_at") >= F.lit(midnight).cast("timestamp")).groupBy("platform").agg(F.sum(F.get_json_object("stats", "$.assets_downloaded").cast("bigint")).alias("used"))
    return used.withColumn("remaining", F.lit(10_000) - F.col("used"))


@query(f"WITH {_RUNS} SELECT platform, mode, count(*) AS n, sum(assets)::BIGINT AS assets FROM runs GROUP BY ALL")
def stats_rollup(spark, d):
    s = F.from_json("stats", "mode string, assets_downloaded bigint")
    r = _runs(spark, d).select("platform", runs.run_mode(F.col("stats")).alias("mode"), s["assets_downloaded"].alias("a"))
    return r.groupBy("platform", "mode").agg(F.count("*").alias("n"), F.sum("a").alias("assets"))


@query(
    """WITH a AS (SELECT user_id % 8 AS lane, event_id, epoch_us(ts) / 1e6 AS came FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY came, event_id) AS k FROM a)
SELECT event_id, CAST(round((max(came - k / 3.0) OVER (PARTITION BY lane ORDER BY came, event_id ROWS UNBOUNDED PRECEDING) + k / 3.0 - came) * 1000) AS BIGINT) AS wait_ms FROM n"""
)
def token_bucket_replay(spark, d):
    """How long each event would wait under three a second per lane."""
    a = table(spark, d, "events").select((F.col("user_id") % 8).alias("lane"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return runs.token_bucket(a, 3.0, ["lane"]).select("event_id", F.round((F.col("slot") - F.col("at")) * 1000).cast("bigint").alias("wait_ms"))


@query("SELECT k AS attempt, least(0.5 * pow(2.0, k), 30.0) AS seconds FROM range(0, 12) t(k)")
def backoff_schedule(spark, d):
    return spark.range(12).select(F.col("id").alias("attempt"), runs.backoff(F.col("id")).alias("seconds"))


# ---------------------------------------------------------------- links

_RESOLVE = f"""{_LEDGER}, {_ALIASES}, {_LINKS}, live AS (SELECT id, local_path FROM led WHERE status = 'active'),
byalias AS (SELECT alias, min(doc_id) AS doc_id FROM al JOIN live ON live.id = al.doc_id GROUP BY alias),
res AS (SELECT li.link_id, li.to_id, coalesce(l.id, a.doc_id) AS doc_id, CASE WHEN l.id IS NOT NULL THEN 'id' WHEN a.alias IS NOT NULL THEN 'alias' END AS matched_by
  FROM li LEFT JOIN live l ON l.id = li.to_id AND l.local_path IS NOT NULL LEFT JOIN byalias a ON a.alias = li.to_id WHERE li.to_id IS NOT NULL)"""


@query(f"WITH {_RESOLVE} SELECT * FROM res")
def resolve_links(spark, d):
    refs = _links(spark, d).where("to_id IS NOT NULL").select("link_id", "to_id")
    return links.resolve(refs, _ledger(spark, d), _aliases(spark, d), "to_id").drop("path")


@query(f"WITH {_RESOLVE} SELECT to_id, count(*) AS n FROM res WHERE matched_by IS NULL GROUP BY to_id")
def unresolved_links(spark, d):
    return resolve_links(spark, d).where("matched_by IS NULL").groupBy("to_id").agg(F.count("*").alias("n"))


@query(f"WITH {_LEDGER}, {_LINKS} SELECT DISTINCT led.platform, li.from_id FROM li JOIN led ON led.id = li.from_id WHERE led.status = 'active'")
def link_sources(spark, d):
    return links.sources(_links(spark, d), _ledger(spark, d))


@query(f"WITH {_CDC}, {_LINKS}, m AS (SELECT id, old_path, new_path FROM cdc WHERE moved) SELECT l.from_id, l.to_id, a.new_path AS from_new, b.new_path AS to_new FROM (SELECT DISTINCT from_id, to_id FROM li) l LEFT JOIN m a ON a.id = l.from_id LEFT JOIN m b ON b.id = l.to_id WHERE a.new_path IS NOT NULL OR b.new_path IS NOT NULL")
def moved_edges(spark, d):
    return links.touched(_links(spark, d), moves(spark, d)).select("from_id", "to_id", "from_new", "to_new")


@query(f"WITH {_ALIASES} SELECT n.qid, n.query, CASE WHEN al.alias IS NOT NULL AND l.id IS NULL THEN al.doc_id ELSE l.id END AS doc_id, CASE WHEN l.id IS NOT NULL THEN 'id' WHEN al.alias IS NOT NULL THEN 'alias' END AS matched_by FROM (SELECT link_id AS qid, to_id AS query, {_id('to_id')} AS c FROM links WHERE {_id('to_id')} IS NOT NULL) n LEFT JOIN (SELECT DISTINCT {_id('id')} AS id FROM ledger_documents) l ON l.id = n.c LEFT JOIN (SELECT alias, min(doc_id) AS doc_id FROM al GROUP BY 1) al ON al.alias = n.c")
def resolve_batch(spark, d):
    """Link targets as they are written, looked up in any of their forms."""
    q = table(spark, d, "links").where(canonical_id(F.col("to_id")).isNotNull()).select(F.col("link_id").alias("qid"), F.col("to_id").alias("query"))
    return links.resolve_batch(q, _ledger(spark, d), _aliases(spark, d))


@query(
    """WITH p AS (SELECT id, local_path AS a, lead(local_path) OVER (ORDER BY local_path, id) AS b FROM ledger_documents WHERE local_path IS NOT NULL),
s AS (SELECT id, a, b, string_split(a, '/') AS x, string_split(b, '/') AS y FROM p WHERE b IS NOT NULL),
c AS (SELECT *, len(list_filter(range(1, least(len(x), len(y))), lambda i: x[1:i] = y[1:i])) AS same FROM s)
SELECT id, repeat('../', CAST(len(x) - 1 - same AS INTEGER)) || array_to_string(y[same + 1:], '/') AS rel FROM c"""
)
def relative_paths(spark, d):
    """From each document's file to that of the next in path order."""
    t = table(spark, d, "ledger_documents").where("local_path IS NOT NULL").select("id", "local_path")
    # The partition is written down: another pass might number partitions otherwise.
    ranged = cut(t.repartitionByRange("local_path", "id").sortWithinPartitions("local_path", "id").withColumn("part", F.spark_partition_id()), "paths")
    w = Window.partitionBy("part").orderBy("local_path", "id")
    heads = ranged.groupBy("part").agg(F.min("local_path").alias("head"))  # a row per partition that isn't empty
    after = heads.select("part", F.lead("head").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("head"))
    nxt = ranged.withColumn("b", F.lead("local_path").over(w)).join(after, "part", "left").withColumn("b", F.coalesce("b", "head"))
    return nxt.where("b IS NOT NULL").select("id", X.relative_path(F.col("local_path"), F.col("b")).alias("rel"))


# ---------------------------------------------------------------- scalars


@query("SELECT doc_id, sha256(text) AS content_hash, 'assets/' || left(sha256(text), 2) || '/' || sha256(text) || '.md' AS path FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    h = F.sha2("text", 256)
    return t.select("doc_id", h.alias("content_hash"), X.content_path(h, F.lit(".md")).alias("path"))


@query(
    """SELECT doc_id, '"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' AS quoted,
  replace(replace(text, '[', '\\['), ']', '\\]') AS label FROM documents WHERE text IS NOT NULL"""
)
def quoted_texts(spark, d):
    """The whole texts, quoted for YAML and escaped for a link."""
    text = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.yaml_quote(text).alias("quoted"), X.link_text(text).alias("label"))


@query(
    f"""SELECT id, replace(replace(replace(replace({_strip('title')}, '|', '\\|'), chr(13) || chr(10), ' '), chr(10), ' '), chr(13), ' ') AS cell,
  CASE WHEN regexp_matches(local_path, '[ ()]') THEN '<' || local_path || '>' ELSE local_path END AS dest FROM ledger_documents WHERE title IS NOT NULL"""
)
def table_cells(spark, d):
    return table(spark, d, "ledger_documents").where("title IS NOT NULL").select("id", X.md_cell(F.col("title")).alias("cell"), X.link_dest(F.col("local_path")).alias("dest"))


def _quoted_sql(c: str) -> str:
    return f"""'"' || replace(replace(replace(replace(replace(coalesce({c}, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' || chr(10)"""


_TIME_SQL = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z') THEN {0} ELSE 'null' END || chr(10)"


@query(
    f"""SELECT id, '---' || chr(10) || '{X.FRONT_WARNING}' || chr(10) || 'id: ' || {_quoted_sql('id')} || 'source: ' || {_quoted_sql('platform')} || 'type: ' || {_quoted_sql('type')} || 'url: ' || {_quoted_sql("''")}
  || 'title: ' || {_quoted_sql('title')} || 'breadcrumb: ' || {_quoted_sql("''")} || 'updated: ' || {_TIME_SQL.format('remote_edited')} || 'synced: ' || {_TIME_SQL.format('synced_at')} || '---' || chr(10) AS front FROM ledger_documents"""
)
def front_matter(spark, d):
    """The front matter block of each document, in fixed key order; times that aren't whole seconds of UTC are null."""
    none = F.lit("")
    time = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.col(c))
    texts = {"id": F.col("id"), "source": F.col("platform"), "type": F.col("type"), "url": none, "title": F.col("title"), "breadcrumb": none}
    return table(spark, d, "ledger_documents").select("id", X.front_block(texts, {"updated": time("remote_edited"), "synced": time("synced_at")}).alias("front"))


@query(f"SELECT rec_id, coalesce({_UNIX.format('modified_time')}, '') AS utc FROM drive_files")
def unix_times(spark, d):
    return table(spark, d, "drive_files").select("rec_id", I.unix_time(F.col("modified_time")).alias("utc"))


# ---------------------------------------------------------------- properties


def _fields(c: Column) -> Column:
    """name -> value (JSON text) of a whole JSON object, else null. As the one member of an array it can't be followed by more
    text, which the parser would let pass; variants keep a string apart from what it holds."""
    one = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<map<string,variant>>")
    return F.transform_values(F.when(F.size(one) == 1, one[0]), lambda _, v: F.to_json(v))


def _unwrapped(text: str) -> Column:
    """The content of a text that is one JSON string, other texts as they are. Of what is no object then (null, empty, broken,
    another kind of value) :func:`_fields` gives null."""
    c = F.col(text)
    one = F.from_json(F.when(c.rlike(r'^\s*"'), F.concat(F.lit("["), c, F.lit("]"))), "array<string>")
    return F.when(c.rlike(r'^\s*"'), F.when(F.size(one) == 1, one[0])).otherwise(c)


def _properties(spark, d):
    """(raw_id, name, value) of each property of the database rows, values as JSON text; rows that hold no object give none."""
    return table(spark, d, "query_rows").select("raw_id", _unwrapped("properties").alias("properties")).select("raw_id", F.explode(_fields(F.col("properties"))).alias("name", "value"))


@query()
def render_properties(spark, d):
    """Every property of the database rows as plain text; titles are shown elsewhere. Rows may be an object or a string that holds one; others have no property."""
    ship(spark)
    p = _properties(spark, d).withColumn("type", F.get_json_object("value", "$.type")).where("type IS DISTINCT FROM 'title'")
    return p.select("raw_id", "name", "type", P.render_value(F.col("value")).alias("text"))


@query(
    f"""SELECT e.raw_id, count(*) AS n, count(DISTINCT e.type) AS types FROM (SELECT raw_id, json_extract_string(u.value, '$.type') AS type
FROM query_rows, json_each({_object_sql('properties')}) u) e GROUP BY e.raw_id"""
)
def property_types(spark, d):
    return _properties(spark, d).groupBy("raw_id").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("value", "$.type")).alias("types"))


_FLAT = f"""SELECT raw_id, u.key AS name, u.value AS value, json_extract_string(u.value, '$.type') AS type
FROM query_rows, json_each({_object_sql('properties')}) u"""


@query(
    f"""SELECT raw_id, name, type, CASE type
  WHEN 'select' THEN coalesce(json_extract_string(value, '$.select.name'), '') WHEN 'status' THEN coalesce(json_extract_string(value, '$.status.name'), '')
  WHEN 'checkbox' THEN CASE WHEN json_extract_string(value, '$.checkbox') = 'true' THEN 'true' ELSE 'false' END
  WHEN 'url' THEN coalesce(json_extract_string(value, '$.url'), '') WHEN 'email' THEN coalesce(json_extract_string(value, '$.email'), '') WHEN 'phone_number' THEN coalesce(json_extract_string(value, '$.phone_number'), '')
  WHEN 'created_time' THEN coalesce(json_extract_string(value, '$.created_time'), '') WHEN 'last_edited_time' THEN coalesce(json_extract_string(value, '$.last_edited_time'), '')
  WHEN 'date' THEN CASE WHEN coalesce(json_extract_string(value, '$.date.start'), '') = '' THEN '' WHEN coalesce(json_extract_string(value, '$.date.end'), '') = '' THEN json_extract_string(value, '$.date.start') ELSE json_extract_string(value, '$.date.start') || '/' || json_extract_string(value, '$.date.end') END
  WHEN 'created_by' THEN coalesce(nullif(json_extract_string(value, '$.created_by.name'), ''), json_extract_string(value, '$.created_by.id'), '') WHEN 'last_edited_by' THEN coalesce(nullif(json_extract_string(value, '$.last_edited_by.name'), ''), json_extract_string(value, '$.last_edited_by.id'), '')
  WHEN 'unique_id' THEN CASE WHEN json_extract_string(value, '$.unique_id.number') IS NULL THEN '' WHEN coalesce(json_extract_string(value, '$.unique_id.prefix'), '') = '' THEN json_extract_string(value, '$.unique_id.number') ELSE json_extract_string(value, '$.unique_id.prefix') || '-' || json_extract_string(value, '$.unique_id.number') END
  WHEN 'multi_select' THEN '[' || array_to_string(list_transform(json_extract_string(value, '$.multi_select[*].name'), lambda x: coalesce(x, '')), ', ') || ']'
  WHEN 'files' THEN '[' || array_to_string(list_transform(json_extract_string(value, '$.files[*].name'), lambda x: coalesce(x, '')), ', ') || ']'
  WHEN 'rich_text' THEN array_to_string(list_transform(json_extract_string(value, '$.rich_text[*].plain_text'), lambda x: coalesce(x, '')), '') END AS text
FROM ({_FLAT}) WHERE type IN ('select', 'status', 'checkbox', 'url', 'email', 'phone_number', 'created_time', 'last_edited_time', 'date', 'created_by', 'last_edited_by', 'unique_id', 'multi_select', 'files', 'rich_text')"""
)
def render_plain_properties(spark, d):
    """The property types that SQL can render."""
    kinds = "select status checkbox url email phone_number created_time last_edited_time date created_by last_edited_by unique_id multi_select files rich_text".split()
    p = _properties(spark, d).withColumn("type", F.get_json_object("value", "$.type")).where(F.col("type").isin(*kinds))
    return p.select("raw_id", "name", "type", P.render_value(F.col("value")).alias("text"))


@query()
def row_hashes(spark, d):
    """A hash of each database row's rendered properties, in order of their names, that tells real changes."""
    p = render_properties(spark, d)
    entries = F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), F.col("text").alias("value"))))
    return p.groupBy("raw_id").agg(P.canonical_entries(entries).alias("canonical")).select("raw_id", F.sha2("canonical", 256).alias("row_hash"))


@query()
def row_document_hashes(spark, d):
    """The content hash of every database row of the ledger: its text with the properties of its last delivery, if there are any."""
    p = render_properties(spark, d)
    entries = F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), F.col("text").alias("value"))))
    canonical = p.groupBy("raw_id").agg(P.canonical_entries(entries).alias("canonical"))
    rows = table(spark, d, "query_rows").select("raw_id", canonical_id(F.col("id")).alias("_id"), "fetched_at").join(canonical, "raw_id")
    last = rows.groupBy("_id").agg(F.max_by("canonical", F.struct("fetched_at", "raw_id")).alias("canonical"))
    docs = _ledger(spark, d).where("type = 'db_row'").select("id", "title")
    return docs.join(last, F.col("id") == F.col("_id"), "left").select("id", P.row_hash(F.col("title"), F.col("canonical")).alias("content_hash"))


@query(f"SELECT data_source_id, list_sort(list(DISTINCT name))[1:4] AS columns FROM (SELECT q.data_source_id, f.name FROM ({_FLAT}) f JOIN query_rows q USING (raw_id) WHERE f.type IS DISTINCT FROM 'title') GROUP BY data_source_id")
def index_columns(spark, d):
    """The columns of each database's index: the first four property names."""
    rows = table(spark, d, "query_rows").select("data_source_id", _unwrapped("properties").alias("properties")).select("data_source_id", F.explode(_fields(F.col("properties"))).alias("name", "value"))
    names = rows.where(F.get_json_object("value", "$.type").isNull() | (F.get_json_object("value", "$.type") != "title")).select("data_source_id", "name").distinct()
    # Each partition's and each key's first four are enough: no list of all names is built.
    nth = F.row_number().over(Window.partitionBy("data_source_id").orderBy("name"))
    return names.withColumn("nth", nth).where("nth <= 4").groupBy("data_source_id").agg(F.array_sort(F.collect_list("name")).alias("columns"))


def _records(spark, d):
    return table(spark, d, "bitable_records").select("raw_id", "space_id", "table_id", _unwrapped("fields").alias("fields"))


@query()
def bitable_cells(spark, d):
    """Every cell of the bitable records as text. Records may be an object or a string that holds one; others have no cell."""
    ship(spark)
    cells = _records(spark, d).select("raw_id", F.explode(_fields(F.col("fields"))).alias("field", "value"))
    return cells.select("raw_id", "field", P.cell_text(F.col("value")).alias("text"))


@query(f"""SELECT table_id, space_id, u.key AS field, count(*) AS n FROM bitable_records, json_each({_object_sql('fields')}) u GROUP BY ALL""")
def bitable_schema(spark, d):
    """The fields of each table and how many records have them."""
    cells = _records(spark, d).select("space_id", "table_id", F.explode(F.map_keys(_fields(F.col("fields")))).alias("field"))
    return cells.groupBy("space_id", "table_id", "field").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_LEDGER}, r AS (SELECT raw_id, name, json_extract(value, '$.relation') AS rel FROM ({_FLAT}) WHERE type = 'relation'),
e AS (SELECT raw_id, name, i, CASE WHEN json_type(rel) = 'ARRAY' THEN json_extract_string(rel, '$[' || i || '].id') END AS raw FROM r, LATERAL (SELECT unnest(range(0, coalesce(CASE WHEN json_type(rel) = 'ARRAY' THEN json_array_length(rel) END, 0)::BIGINT)) AS i) x),
s AS (SELECT e.raw_id, e.name, e.i, coalesce(nullif(l.title, ''), {_id('raw')}, '') AS shown FROM e LEFT JOIN led l ON l.id = {_id('raw')})
SELECT r.raw_id, r.name, '[' || coalesce(string_agg(s.shown, ', ' ORDER BY s.i), '') || ']' AS text FROM r LEFT JOIN s USING (raw_id, name) GROUP BY r.raw_id, r.name"""
)
def relation_titles(spark, d):
    """Relations of the database rows with the titles of what they name, else its id; ``[]`` for an empty or null one."""
    rel = _properties(spark, d).where(F.get_json_object("value", "$.type") == "relation")
    ids = rel.select("raw_id", "name", F.posexplode_outer(F.from_json(F.get_json_object("value", "$.relation"), "array<struct<id: string>>")).alias("pos", "r"))
    ids = ids.select("raw_id", "name", "pos", canonical_id(F.col("r.id")).alias("ref"))
    titles = _ledger(spark, d).select(F.col("id").alias("_id"), "title")
    named = ids.join(titles, F.col("ref") == F.col("_id"), "left").withColumn("shown", F.coalesce(F.nullif("title", F.lit("")), "ref", F.lit("")))
    lists = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "shown"))))
    return named.groupBy("raw_id", "name").agg(P.bracketed(F.transform(lists, lambda x: x["shown"])).alias("text"))


# ---------------------------------------------------------------- markup

_IMG = M.IMAGE.replace("'", "''")


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{_IMG}', 2)) AS target FROM documents")
def image_targets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(M.images(F.col("text"))).alias("target"))


@query(f"SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{M.TAG}', 1)) AS tag FROM documents) GROUP BY 1")
def tags(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(M.TAG), F.lit(1))).alias("tag"))
    return t.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query()
def unknown_blocks(spark, d):
    """Opening tags outside code and comments that aren't known, per document."""
    ship(spark)
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", M.unknown_tags(M.mask_regions(F.col("text"))).alias("tags"))
    return t.where("size(tags) > 0").select("doc_id", F.size("tags").alias("n"))


@query(
    """SELECT doc_id, CASE WHEN mark = '' THEN text ELSE mark || chr(10) || text END AS body FROM (SELECT doc_id, text,
  concat_ws(chr(10), CASE WHEN n_chars > 6000 THEN '<!-- doclake:truncated -->' END, CASE WHEN n_cells > 12 THEN '<!-- doclake:unknown-blocks n="1" ids="' || repo || '" -->' END) AS mark FROM documents WHERE text IS NOT NULL)"""
)
def loss_markers(spark, d):
    """Bodies after the markers of what they lost, of every row with a text: a null gives no marker."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    ids = F.when((F.col("n_cells") > 12) & F.col("repo").isNotNull(), F.array("repo")).otherwise(F.array().cast("array<string>"))
    return t.select("doc_id", M.loss_markers(F.col("text"), F.coalesce(F.col("n_chars") > 6000, F.lit(False)), ids).alias("body"))


# ---------------------------------------------------------------- probes and parsers


@query()
def envelope_cases(spark, d):
    """How raw records would pass as responses."""
    t = table(spark, d, "query_rows").select(landed.envelope_case(F.concat(F.lit('{"ok":true,"data":'), F.col("properties"), F.lit("}"))).alias("envelope_case"))
    return t.groupBy("envelope_case").agg(F.count("*").alias("n"))


@query(
    """SELECT r_name, list_sort(list_distinct(list_transform(string_split('8:30, 21:05 ,08:30,7:' || lpad(CAST(r_regionkey * 7 AS VARCHAR), 2, '0'), ','), lambda x: lpad(trim(x), 5, '0')))) AS times FROM region"""
)
def schedule_times(spark, d):
    text = F.concat(F.lit("8:30, 21:05 ,08:30,7:"), F.lpad((F.col("r_regionkey") * 7).cast("string"), 2, "0"))
    return table(spark, d, "region").select("r_name", X.clock_times(text).alias("times"))


@query("SELECT n_name, [1, n_nationkey % 5, n_regionkey] < [1, 3, 0] AS older FROM nation")
def semver_compare(spark, d):
    v = F.concat(F.lit("engine v1."), (F.col("n_nationkey") % 5).cast("string"), F.lit("."), F.col("n_regionkey").cast("string"), F.lit(" (build 7)"))
    return table(spark, d, "nation").select("n_name", (X.first_semver(v) < F.array(F.lit(1), F.lit(3), F.lit(0))).alias("older"))
