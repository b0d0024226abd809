"""Queries on scopes, included files and the functions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..operators import includes, scopes

#: One text for both engines: users' events as groups, definitions and uses of three names.
STREAM = """
SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' WHEN 'click' THEN 'def' WHEN 'error' THEN 'provide' ELSE 'use' END AS kind,
  concat('m', CAST(event_id % 3 AS VARCHAR(9))) AS name, CAST(event_id AS VARCHAR(19)) AS value FROM events
"""
#: One text for both engines: a file for each part; it includes two others (the second by its whole name) and, now and then, the one that includes it.
LINES = """
SELECT concat('f', CAST(p_partkey AS VARCHAR(19)), '.tex') AS file, pos, CASE pos WHEN 1 THEN p_name WHEN 3 THEN p_type END AS text,
  CASE pos WHEN 2 THEN concat('f', CAST(2 * p_partkey AS VARCHAR(19))) WHEN 4 THEN concat('f', CAST(2 * p_partkey + 1 AS VARCHAR(19)), '.tex') WHEN 5 THEN concat('f', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(19))) END AS include
FROM part, (SELECT 1 AS pos UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) x WHERE pos < 5 OR p_partkey % 5 = 0
"""
SHOWN = """
SELECT conv_id, turn, tex_ligatures(concat('``', text, '\\'\\'--')) AS ligated, xml_escape(concat('<', role, '>')) AS escaped, fmt_sep_by(CASE WHEN turn % 2 = 0 THEN role ELSE '' END, fmt_wrap(role, '(', ')'), ', ') AS joined,
  fmt_end_with_dot(role) AS ended, fmt_extra_year(conv_id * 37 - 1) AS suffix, anchor_id(CASE turn % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'main' ELSE 'back' END, array(conv_id, turn % 4, turn % 2, 0)) AS anchor, section_file(CAST(turn AS INT)) AS file
FROM {rows}
"""


def scoped_macros(spark, sf_dir):
    """What each use of a name sees: the newest definition in the innermost group that is still open."""
    rows = spark.sql(STREAM.replace("FROM events", "FROM {rows}"), rows=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return scopes.looked_up(rows)


def spliced(spark, sf_dir):
    """Every file with what it includes, line by line."""
    lines = spark.sql(LINES.replace("FROM part", "FROM {rows}"), rows=spark.read.parquet(f"{sf_dir}/part.parquet"))
    listing = lines.select("file").distinct()
    return includes.spliced(includes.resolved(lines, listing), listing)


def sql_functions(spark, sf_dir):
    """Texts of conversations through the functions in SQL."""
    sql.register(spark)
    return spark.sql(SHOWN, rows=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (scoped_macros, spliced, sql_functions)}
SQL = {
    "scoped_macros": f"""WITH s AS ({STREAM}),
c AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS level FROM s),
l AS (SELECT *, level - least(0, min(level) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS inside FROM c),
d AS (SELECT l.*, (SELECT min(x.seq) FROM l x WHERE x.doc_id = l.doc_id AND x.seq > l.seq AND x.inside < l.inside) AS until FROM l WHERE kind IN ('def', 'provide')),
f AS (SELECT * FROM d WHERE kind = 'def' OR NOT EXISTS (SELECT 1 FROM d x WHERE x.doc_id = d.doc_id AND x.name = d.name AND x.seq < d.seq AND (x.until IS NULL OR x.until > d.seq)))
SELECT u.doc_id, u.seq, u.name, arg_max(f.value, f.seq) AS value, max(f.seq) AS defined_at FROM s u LEFT JOIN f ON f.doc_id = u.doc_id AND f.name = u.name AND f.seq < u.seq AND (f.until IS NULL OR f.until > u.seq) WHERE u.kind = 'use' GROUP BY ALL""",
    "spliced": f"""WITH RECURSIVE l AS ({LINES}),
n AS (SELECT DISTINCT file FROM l),
r AS (SELECT l.*, coalesce(a.file, b.file) AS target FROM l LEFT JOIN n a ON a.file = l.include LEFT JOIN n b ON b.file = l.include || '.tex'),
w AS (SELECT file AS root, file AS here, CAST([] AS INTEGER[]) AS way, [file] AS opened, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS include, CAST(NULL AS VARCHAR) AS error, 0 AS done FROM n
 UNION ALL SELECT w.root, CASE WHEN r.include IS NULL OR r.target IS NULL OR list_contains(w.opened, r.target) THEN w.here ELSE r.target END, list_append(w.way, CAST(r.pos AS INTEGER)), CASE WHEN r.include IS NULL OR r.target IS NULL OR list_contains(w.opened, r.target) THEN w.opened ELSE list_append(w.opened, r.target) END,
  r.text, r.include, CASE WHEN r.include IS NULL THEN NULL WHEN r.target IS NULL THEN 'missing' WHEN list_contains(w.opened, r.target) THEN 'cycle' END, CASE WHEN r.include IS NULL OR r.target IS NULL OR list_contains(w.opened, r.target) THEN 1 ELSE 0 END FROM w JOIN r ON r.file = w.here WHERE w.done = 0)
SELECT root, CAST(row_number() OVER (PARTITION BY root ORDER BY way) AS INTEGER) AS line, here AS file, CASE WHEN include IS NULL THEN text END AS text, CAST(len(opened) AS INTEGER) AS depth, error FROM w WHERE done = 1""",
    "sql_functions": """WITH RECURSIVE y AS (SELECT conv_id, CAST(conv_id * 37 AS BIGINT) AS n, '' AS s FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, (n - 1) // 26, chr(CAST(97 + (n - 1) % 26 AS INTEGER)) || s FROM y WHERE n > 0)
SELECT c.conv_id, turn, '“' || replace(replace(replace(replace(replace(replace(replace(replace(text, '?`', '¿'), '!`', '¡'), '---', '—'), '--', '–'), '``', '“'), '''''', '”'), '`', '‘'), '''', '’') || '”–' AS ligated, '&lt;' || role || '&gt;' AS escaped,
 CASE WHEN turn % 2 = 0 THEN role || ', ' ELSE '' END || '(' || role || ')' AS joined, role || '.' AS ended, y.s AS suffix,
 'sec-' || CASE turn % 3 WHEN 0 THEN 'front-' WHEN 1 THEN '' ELSE 'back-' END || regexp_replace(c.conv_id || '-' || turn % 4 || '-' || turn % 2 || '-0', '(^|-)0(-0)*$', '') AS anchor, format('section-{:03d}.xhtml', CAST(turn AS BIGINT)) AS file
FROM conversations c JOIN y ON y.conv_id = c.conv_id AND y.n <= 0""",
}
