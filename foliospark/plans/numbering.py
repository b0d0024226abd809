"""Queries on numbering: user streams read as documents (sign-up a chapter, view a section, click a figure, purchase a note, error a region or an unnumbered header)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import numbering as ops

#: One text for both engines.
EVENTS = """
SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'signup' THEN 'header' WHEN 'view' THEN 'header' WHEN 'click' THEN 'figure' WHEN 'purchase' THEN 'note' ELSE CASE WHEN event_id % 3 = 0 THEN 'region' ELSE 'header' END END AS kind,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END WHEN event_type = 'view' THEN CAST(3 + event_id % 3 AS INT) WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 2 END AS level,
  event_type = 'error' AND event_id % 3 <> 0 AS starred,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'front' WHEN event_id % 4 = 1 THEN 'back' ELSE 'main' END END AS region,
  CASE WHEN event_id % 7 = 0 THEN concat('l', CAST(event_id % 50 AS VARCHAR(9))) END AS label,
  CASE WHEN event_id % 11 = 0 THEN concat('l', CAST(event_id % 60 AS VARCHAR(9))) END AS pointer
FROM events
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS.replace("FROM events", "FROM {rows}"), rows=spark.read.parquet(f"{sf_dir}/events.parquet"))


def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.section_numbers(events(spark, sf_dir))


def phantom_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.phantom_headers(events(spark, sf_dir))


def figure_note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chapter_counters(events(spark, sf_dir))


def current_anchor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.labels(events(spark, sf_dir))


def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    pointers = rows.filter("pointer IS NOT NULL").select("doc_id", "seq", F.col("pointer").alias("label"))
    return ops.resolved(pointers, ops.labels(rows))


def item_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("seq"), F.floor((F.col("l_linenumber") - 1) / 4).alias("chapter"), F.floor((F.col("l_linenumber") - 1) / 2).alias("list_id"), (F.col("l_linenumber") % 2 == 0).alias("sub"))
    return ops.item_paths(items)


_R = f"""WITH e AS ({EVENTS}),
r AS (SELECT *, coalesce(last_value(region IGNORE NULLS) OVER w, 'front') AS in_region FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, in_region <> coalesce(lag(in_region) OVER (PARTITION BY doc_id ORDER BY seq), 'front') AS changed, kind = 'header' AND NOT starred AS num FROM r),
k AS (SELECT *, {', '.join(f"sum(CASE WHEN changed{f' OR (num AND level BETWEEN 2 AND {i - 1})' if i > 2 else ''} THEN 1 ELSE 0 END) OVER w AS g{i}" for i in range(1, 8))}, sum(CASE WHEN num AND level = 2 THEN 1 ELSE 0 END) OVER w AS ch, sum(CASE WHEN kind = 'header' AND starred THEN 1 ELSE 0 END) OVER w AS phantom FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, {', '.join(f"sum(CASE WHEN num AND level = {i} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g{i} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n{i}" for i in range(1, 8))}, {', '.join(f"sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ch ORDER BY seq ROWS UNBOUNDED PRECEDING) AS {k}_n" for k in ('figure', 'note'))} FROM k),
x AS (SELECT *, coalesce(last_value(CASE WHEN num AND level = 2 THEN n2 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS chapter, concat_ws('.', n1, n2, n3, n4, n5, n6, n7) AS number,
  regexp_replace(concat('sec-', CASE in_region WHEN 'front' THEN 'front-' WHEN 'back' THEN 'back-' ELSE '' END, concat_ws('-', n2, n3, n4, n5, n6, n7)), '(?:(?:^|-)0)+$', CASE WHEN n2 + n3 + n4 + n5 + n6 + n7 = 0 THEN '-' ELSE '' END) AS sec FROM n),
a AS (SELECT *, coalesce(last_value(CASE WHEN num THEN sec WHEN kind = 'figure' THEN concat('figure-', chapter, '-', figure_n) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'start') AS anchor FROM x),
l AS (SELECT doc_id, label, arg_max(anchor, seq) AS anchor FROM a WHERE label IS NOT NULL GROUP BY doc_id, label)
"""
QUERIES = {f.__name__: f for f in (section_numbers, phantom_headers, figure_note_numbers, current_anchor_labels, resolve_refs, item_paths)}
SQL = {
    "section_numbers": _R + "SELECT doc_id, seq, level, in_region AS region, number FROM x WHERE num",
    "phantom_headers": _R + "SELECT doc_id, seq, phantom, number FROM x WHERE kind = 'header' AND starred",
    "figure_note_numbers": _R + "SELECT doc_id, seq, kind, chapter, CASE kind WHEN 'figure' THEN figure_n ELSE note_n END AS n FROM x WHERE kind IN ('figure', 'note')",
    "current_anchor_labels": _R + "SELECT doc_id, label, anchor FROM l",
    "resolve_refs": _R + "SELECT e.doc_id, e.seq, e.pointer AS label, coalesce(l.anchor, '???') AS text, coalesce('#' || l.anchor, '') AS target FROM e LEFT JOIN l ON l.doc_id = e.doc_id AND l.label = e.pointer WHERE e.pointer IS NOT NULL",
    "item_paths": """WITH i AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq, (l_linenumber - 1) // 4 AS chapter, (l_linenumber - 1) // 2 AS list_id, l_linenumber % 2 = 0 AS sub FROM lineitem)
SELECT doc_id, seq, concat_ws('.', chapter, sum(CASE WHEN sub THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, chapter ORDER BY seq ROWS UNBOUNDED PRECEDING), CASE WHEN sub THEN sum(CASE WHEN sub THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chapter, list_id ORDER BY seq ROWS UNBOUNDED PRECEDING) END) AS path FROM i""",
}
