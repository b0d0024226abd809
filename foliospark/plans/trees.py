"""Queries on trees: the pages' tags as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees as ops
from ..operators.bibliography import checkpointed
from ..sources import markup

#: Elements that lay out text only.
INLINE = ("a", "b", "div", "nav", "p", "ul")


def _tree(spark, sf_dir):
    """The nodes of all pages; written once, as most queries read them several times."""
    return checkpointed(ops.nodes(markup.tokens(markup.dealt(spark.read.parquet(f"{sf_dir}/pages.parquet")))))


def _paged(rows):
    return rows.withColumnRenamed("doc_id", "page_id")


def tree_nodes(spark, sf_dir):
    return _paged(_tree(spark, sf_dir).select("doc_id", "node_id", "last_id", "parent_id", "depth", "kind", "name"))


def subtree_pairs(spark, sf_dir):
    """Every node with each of its ancestors."""
    return _paged(ops.ancestors(_tree(spark, sf_dir)))


def unwrapped(spark, sf_dir):
    """The pages' trees without elements that lay out text."""
    return _paged(ops.unwrapped(_tree(spark, sf_dir), F.col("name").isin(*INLINE)).select("doc_id", "node_id", "last_id", "parent_id", "depth", "name"))


def tree_to_html(spark, sf_dir):
    """Pages written back from their nodes: every element has its end, ends without a start are gone."""
    end = F.when(F.col("role") == "open", markup.escaped_end(F.col("name")))
    tree = _tree(spark, sf_dir).withColumn("role", F.when((F.col("kind") == "element") & ~F.col("name").isin(*markup.VOID) & ~F.col("text").endswith("/>"), "open"))
    return _paged(ops.serialised(tree, F.col("text"), end)).withColumnRenamed("text", "html")


def node_text(spark, sf_dir):
    """The text of each element and all below it: entities for &, < and > become characters, a br is a line feed, nothing else shows."""
    shown = F.col("text")
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        shown = F.replace(shown, F.lit(name), F.lit(character))
    tree = _tree(spark, sf_dir)
    texts = ops.subtree_texts(tree, F.when(F.col("kind") == "text", shown).when(F.col("name") == "br", "\n"))
    return _paged(texts.join(tree.filter("kind = 'element'").select("doc_id", "node_id", "name"), ["doc_id", "node_id"]))


def nested_lists(spark, sf_dir):
    """What stands between the br of each element, each item with its first and last node."""
    return _paged(ops.lists(_tree(spark, sf_dir), F.col("name") == "br"))


QUERIES = {f.__name__: f for f in (tree_nodes, subtree_pairs, unwrapped, tree_to_html, node_text, nested_lists)}
#: The other engine's patterns never go back, and have no sign for it.
_PATTERN = markup.TOKEN.replace("*+", "*").replace("'", "''")
_VOID, _RAW, _INLINE = (", ".join(f"'{n}'" for n in names) for names in (markup.VOID, markup.RAW, INLINE))
#: The tags of a page one after another, with a stack of open elements.
_T = rf"""WITH RECURSIVE k AS (SELECT page_id, unnest(x) AS text, unnest(range(len(x))) AS seq FROM (SELECT page_id, regexp_extract_all(html, '{_PATTERN}', 0) AS x FROM pages)),
c AS (SELECT page_id, seq, text, lower(regexp_extract(text, '^</?([A-Za-z][^\s/>]*)', 1)) AS name FROM k),
d AS (SELECT *, CASE WHEN name IN ({_RAW}) AND regexp_matches(text, '(?s)^<[A-Za-z].*</') THEN 'raw' WHEN name <> '' THEN 'element' WHEN regexp_matches(text, '^<[!?]') THEN 'other' ELSE 'text' END AS kind FROM c),
e AS (SELECT *, CASE WHEN starts_with(text, '</') THEN 'close' WHEN kind <> 'element' OR name IN ({_VOID}) OR ends_with(text, '/>') THEN 'leaf' ELSE 'open' END AS role FROM d),
s AS (SELECT page_id, CAST(-1 AS BIGINT) AS seq, CAST([] AS INTEGER[]) AS path, CAST([] AS INTEGER[]) AS ids, CAST([] AS VARCHAR[]) AS names, 0 AS n FROM pages
 UNION ALL SELECT page_id, seq, ids, CASE role WHEN 'open' THEN list_append(ids, n + 1) WHEN 'close' THEN CASE WHEN place > 0 THEN ids[:place - 1] ELSE ids END ELSE ids END,
  CASE role WHEN 'open' THEN list_append(names, name) WHEN 'close' THEN CASE WHEN place > 0 THEN names[:place - 1] ELSE names END ELSE names END, n + CASE role WHEN 'close' THEN 0 ELSE 1 END
 FROM (SELECT e.page_id, e.seq, e.role, e.name, s.ids, s.names, s.n, CASE WHEN list_contains(s.names, e.name) THEN len(s.names) + 1 - list_position(list_reverse(s.names), e.name) ELSE 0 END AS place FROM s JOIN e ON e.page_id = s.page_id AND e.seq = s.seq + 1)),
p AS (SELECT e.page_id, s.n AS node_id, s.path, coalesce(s.path[-1], 0) AS parent_id, CAST(len(s.path) AS INTEGER) AS depth, e.kind, e.name, e.role, e.text FROM e JOIN s ON s.page_id = e.page_id AND s.seq = e.seq WHERE e.role <> 'close'),
a AS (SELECT page_id, unnest(path) AS ancestor_id, unnest(range(len(path))) AS above, node_id, depth FROM p),
t AS (SELECT p.*, coalesce(l.last_id, p.node_id) AS last_id FROM p LEFT JOIN (SELECT page_id, ancestor_id, max(node_id) AS last_id FROM a GROUP BY ALL) l ON l.page_id = p.page_id AND l.ancestor_id = p.node_id)
"""
SQL = {
    "tree_nodes": _T + "SELECT page_id, node_id, last_id, parent_id, depth, kind, name FROM t",
    "subtree_pairs": _T + "SELECT page_id, ancestor_id, node_id, CAST(depth - above AS INTEGER) AS distance FROM a",
    "unwrapped": _T + f""", g AS (SELECT *, name IN ({_INLINE}) AS gone, sum(CASE WHEN name IN ({_INLINE}) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY node_id) AS m FROM t),
u AS (SELECT a.page_id, a.node_id, max(CASE WHEN NOT g.gone THEN g.m END) AS up, count(*) FILTER (WHERE g.gone) AS less FROM a JOIN g ON g.page_id = a.page_id AND g.node_id = a.ancestor_id GROUP BY ALL)
SELECT g.page_id, CAST(g.m AS INTEGER) AS node_id, CAST(z.m AS INTEGER) AS last_id, CAST(coalesce(u.up, 0) AS INTEGER) AS parent_id, CAST(g.depth - coalesce(u.less, 0) AS INTEGER) AS depth, g.name
FROM g JOIN g z ON z.page_id = g.page_id AND z.node_id = g.last_id LEFT JOIN u ON u.page_id = g.page_id AND u.node_id = g.node_id WHERE NOT g.gone""",
    "tree_to_html": _T + """, v AS (SELECT page_id, node_id AS place, 0 AS back, text FROM t UNION ALL SELECT page_id, last_id, 1000000 - depth, '</' || name || '>' FROM t WHERE role = 'open')
SELECT page_id, string_agg(text, '' ORDER BY place, back) AS html FROM v GROUP BY page_id""",
    "node_text": _T + """, w AS (SELECT page_id, node_id, CASE WHEN kind = 'text' THEN replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') WHEN name = 'br' THEN chr(10) ELSE '' END AS own FROM t),
b AS (SELECT page_id, node_id, node_id AS place FROM t UNION ALL SELECT page_id, ancestor_id, node_id FROM a)
SELECT t.page_id, t.node_id, string_agg(w.own, '' ORDER BY b.place) AS text, t.name FROM t JOIN b ON b.page_id = t.page_id AND b.node_id = t.node_id JOIN w ON w.page_id = b.page_id AND w.node_id = b.place WHERE t.kind = 'element' GROUP BY ALL""",
    "nested_lists": _T + """, h AS (SELECT page_id, parent_id, count(*) AS seps, max(node_id) AS final FROM t WHERE name = 'br' GROUP BY ALL),
i AS (SELECT h.page_id, h.parent_id, unnest(range(1, h.seps + 1 + CASE WHEN EXISTS (SELECT 1 FROM t x WHERE x.page_id = h.page_id AND x.parent_id = h.parent_id AND x.node_id > h.final) THEN 1 ELSE 0 END)) AS item FROM h),
j AS (SELECT t.*, (SELECT count(*) FROM t x WHERE x.page_id = t.page_id AND x.parent_id = t.parent_id AND x.name = 'br' AND x.node_id < t.node_id) + 1 AS item FROM t WHERE name <> 'br')
SELECT i.page_id, i.parent_id, CAST(i.item AS INTEGER) AS item, min(j.node_id) AS first_id, max(j.last_id) AS last_id, count(j.node_id) AS n FROM i LEFT JOIN j ON j.page_id = i.page_id AND j.parent_id = i.parent_id AND j.item = i.item GROUP BY ALL""",
}
