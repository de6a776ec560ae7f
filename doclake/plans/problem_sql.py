"""SQL counterparts of the queries in :mod:`doclake.plans.problems`, for DuckDB."""

from __future__ import annotations

from doclake.functions.ids import canonical_id_sql as _id

_P3 = f"""
WITH led AS (SELECT {_id('id')} AS id, {_id('parent_id')} AS parent_id, status, first_seen_at FROM ledger_documents),
refs AS (
  SELECT 'links.from_id' AS src, CAST(link_id AS VARCHAR) AS holder, {_id('from_id')} AS ref_id, seen_at AS t FROM links
  UNION ALL SELECT 'links.to_id', CAST(link_id AS VARCHAR), {_id('to_id')}, seen_at FROM links
  UNION ALL SELECT 'ledger_documents.parent_id', id, parent_id, first_seen_at FROM led WHERE status IS DISTINCT FROM 'trashed'),
found AS (
  SELECT r.src, r.holder, r.ref_id, coalesce(strftime(r.t AT TIME ZONE 'UTC', '%Y-%m'), '') AS period,
    CASE WHEN l.id IS NULL THEN 'missing' WHEN l.status = 'trashed' THEN 'deleted' WHEN l.first_seen_at > r.t THEN 'late' END AS kind
  FROM refs r LEFT JOIN led l ON l.id = r.ref_id WHERE r.ref_id IS NOT NULL)
"""
_P4 = f"""
WITH ranked AS (
  SELECT snap_no, {_id('id')} AS id, coalesce(title, '') AS title, coalesce(local_path, '') AS local_path, coalesce(status, '') AS status,
    row_number() OVER (PARTITION BY snap_no, {_id('id')} ORDER BY loaded_at DESC NULLS LAST, coalesce(title, '') DESC, coalesce(local_path, '') DESC, coalesce(status, '') DESC) AS rn
  FROM ledger_snapshots),
held AS (SELECT * FROM ranked WHERE rn = 1 AND id IS NOT NULL AND snap_no IS NOT NULL),
snaps AS (SELECT snap_no, lead(snap_no) OVER (ORDER BY snap_no) AS nxt FROM (SELECT DISTINCT snap_no FROM held)),
before AS (SELECT s.nxt, h.* FROM held h JOIN snaps s USING (snap_no) WHERE s.nxt IS NOT NULL),
pairs AS (
  SELECT coalesce(a.snap_no, b.nxt) AS snap_no, coalesce(a.id, b.id) AS id, a.id AS now_id, b.id AS old_id,
    a.title AS t1, b.title AS t0, a.local_path AS l1, b.local_path AS l0, a.status AS s1, b.status AS s0
  FROM (SELECT * FROM held WHERE snap_no > (SELECT min(snap_no) FROM held)) a FULL JOIN before b ON a.id = b.id AND a.snap_no = b.nxt),
found AS (
  SELECT snap_no, id, 'added' AS change, '' AS field FROM pairs WHERE old_id IS NULL
  UNION ALL SELECT snap_no, id, 'removed', '' FROM pairs WHERE now_id IS NULL
  UNION ALL SELECT snap_no, id, 'changed', 'title' FROM pairs WHERE t1 <> t0
  UNION ALL SELECT snap_no, id, 'changed', 'local_path' FROM pairs WHERE l1 <> l0
  UNION ALL SELECT snap_no, id, 'changed', 'status' FROM pairs WHERE s1 <> s0)
"""
_P5 = f"""
WITH RECURSIVE rows AS (
  SELECT 'ledger_documents' AS src, {_id('id')} AS node, {_id('parent_id')} AS parent FROM ledger_documents
  UNION ALL SELECT 'wiki_nodes', {_id('node_token')}, {_id('parent_node_token')} FROM wiki_nodes),
nodes AS (SELECT src, node, min(parent) AS parent FROM rows WHERE node IS NOT NULL GROUP BY src, node),
edges AS (SELECT n.src, n.node, p.node AS parent FROM nodes n LEFT JOIN nodes p ON p.src = n.src AND p.node = n.parent),
walk AS (
  SELECT src, node, node AS root, 0 AS depth, [node] AS path FROM edges WHERE parent IS NULL
  UNION ALL SELECT e.src, e.node, w.root, w.depth + 1, list_append(w.path, e.node) FROM walk w JOIN edges e ON e.src = w.src AND e.parent = w.node),
below AS (SELECT src, above, count(*) - 1 AS n FROM (SELECT src, unnest(path) AS above FROM walk) GROUP BY src, above)
"""

ORACLES = {
    "p3_found": _P3 + "SELECT * FROM found WHERE kind IS NOT NULL",
    "p3_counts": _P3 + "SELECT src, period, kind, count(*) AS n FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_counts": _P4 + "SELECT snap_no, change, field, count(*) AS n FROM found GROUP BY ALL",
    "p5_found": _P5
    + """SELECT e.src, e.node AS node_id, coalesce(w.root, '') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth, CAST(coalesce(b.n, -1) AS INTEGER) AS n_desc
FROM edges e LEFT JOIN walk w ON w.src = e.src AND w.node = e.node LEFT JOIN below b ON b.src = e.src AND b.above = e.node""",
    "p5_paths": _P5 + "SELECT src, node AS node_id, array_to_string(path, '/') AS path FROM walk",
    "p5_descendants": _P5
    + """SELECT src, path[i] AS node_id, node AS desc_id, CAST(len(path) - i AS INTEGER) AS dist
FROM (SELECT src, node, path, unnest(range(1, len(path))) AS i FROM walk)""",
}
