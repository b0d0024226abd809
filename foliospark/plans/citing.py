"""Queries on citations and bibliographies: orders cite parts (line pairs are commands, parts are works), some works unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import bibliography as bib
from ..operators import citations as ops


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.floor((F.col("l_linenumber") + 1) / 2).alias("cmd_seq"), ((F.col("l_linenumber") + 1) % 2).alias("pos"), (F.col("l_partkey") % 500).alias("key"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 7 <> 0")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("book", "article", "collection", "misc"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return rows.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("author"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Ed "), F.col("p_brand"))).alias("editor"), (2000 + F.col("p_size") % 3).cast("string").alias("year"), F.col("p_name").alias("title"), kind.alias("type"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.disambiguated(ops.resolved(ops.cite_map(_keys(spark, sf_dir)), _entries(spark, sf_dir)))


def cite_map(spark, sf_dir):
    return ops.cite_map(_keys(spark, sf_dir))


def resolve_citations(spark, sf_dir):
    return ops.resolved(ops.cite_map(_keys(spark, sf_dir)), _entries(spark, sf_dir))


def extra_year(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", "key", F.concat("year", "suffix").alias("label"))


def cite_groups(spark, sf_dir):
    rows = _cited(spark, sf_dir).select("doc_id", (F.col("ord") * 1000 + F.col("key")).alias("seq"), "agents", F.concat("year", "suffix").alias("label"))
    return ops.written(ops.grouped(rows))


def cite_last_names(spark, sf_dir):
    """Citations in groups of equal last names, whatever the first names; some works have three names."""
    brand = F.regexp_replace("p_brand", "#", "N")
    first = F.when(F.col("p_partkey") % 2 == 0, "Al ").otherwise("Bo ")
    names = F.concat(first, brand, F.lit(" and Jo von Roe"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" and Li, X.")).otherwise(""))
    works = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), names.alias("names"))
    cites = _cited(spark, sf_dir).select("doc_id", (F.col("ord") * 1000 + F.col("key")).alias("seq"), "key", F.concat("year", "suffix").alias("label"))
    return ops.written(ops.grouped_by_names(cites, bib.agents(works)))


def cite_modes(spark, sf_dir):
    """The same citations in every mode."""
    rows = ops.grouped(_cited(spark, sf_dir).select("doc_id", (F.col("ord") * 1000 + F.col("key")).alias("seq"), "agents", F.concat("year", "suffix").alias("label")))
    return ops.written_in(rows, ("author_in_parentheses", "textual", "year", "author", "bare"))


def bibliography(spark, sf_dir):
    """Every document's references in order: rank and text."""
    full = ops.full_reference(F.col("agents"), F.concat("year", "suffix"), F.col("title"), F.col("type"), F.lit("Berlin"))
    rows = _cited(spark, sf_dir).select("doc_id", "key", full.alias("reference"))
    return rows.select("doc_id", "key", F.row_number().over(Window.partitionBy("doc_id").orderBy("reference", "key")).cast("bigint").alias("place"), "reference")


def entry_accessors(spark, sf_dir):
    return _entries(spark, sf_dir).select("key", F.coalesce("author", "editor").alias("agents"), F.coalesce("editor", F.lit("")).alias("editor_or_empty"), F.coalesce("author", "editor", "title").alias("first_of"))


def bib_dedupe(spark, sf_dir):
    """First entry of a key wins, last value of a field wins: customers as keys, their orders as entries with two fields."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = orders.select((F.col("o_custkey") % 300).alias("key"), F.col("o_orderkey").alias("seq"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("note").alias("name"), F.col("o_orderstatus").alias("value")), F.struct(F.lit(1).alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, "note").otherwise("title").alias("name"), F.col("o_orderpriority").alias("value")))).alias("f")).select("key", "seq", "f.*")
    return bib.deduplicated(raw)


def bib_normalise(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    fields = part.select(F.col("p_partkey").alias("key"), F.explode(F.array(F.struct(F.when(F.col("p_partkey") % 2 == 0, "journal").otherwise("address").alias("name"), F.col("p_name").alias("value")), F.struct(F.when(F.col("p_partkey") % 3 == 0, "journaltitle").when(F.col("p_partkey") % 3 == 1, "location").otherwise("school").alias("name"), F.col("p_brand").alias("value")), F.struct(F.when(F.col("p_partkey") % 5 == 0, "editor").otherwise("institution").alias("name"), F.col("p_type").alias("value")))).alias("f")).select("key", "f.*")
    entries = part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, "book").otherwise("article").alias("type"))
    types = bib.normalised_types(entries, fields)
    return bib.normalised_fields(fields).join(types, "key").select("key", "type", "name", "value")


def xdata_inherit(spark, sf_dir):
    """Customers inherit from nations, nations from regions; every node has a name, nations and regions a note."""
    c, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
    own = c.select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"))
    own = own.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("nation"), "n_name")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("place"), "n_name"))
    own = own.union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("region"), "r_name")).union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("place"), "r_name"))
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit(1).alias("ord"))
    edges = edges.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(1))).union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), F.col("r_regionkey")), F.lit(1)))
    return bib.xdata(own, edges)


def crossref_inherit(spark, sf_dir):
    """Orders inherit from their customers: private fields stay away, titles are renamed, own values win."""
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = o.select(F.concat(F.lit("o"), "o_orderkey").alias("key"), F.explode(F.array(F.struct(F.lit("title").alias("name"), F.col("o_orderpriority").alias("value")), F.struct(F.when(F.col("o_orderkey") % 3 == 0, "booktitle").otherwise("note").alias("name"), F.col("o_orderstatus").alias("value")))).alias("f")).select("key", "f.*")
    own = own.union(c.select(F.concat(F.lit("c"), "c_custkey"), F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(v).alias("value")) for k, v in (("title", "c_name"), ("booktitle", "c_mktsegment"), ("author", "c_name"), ("keywords", "c_mktsegment"))))).alias("f")).select("concat(c, c_custkey)", "f.*"))
    edges = o.select(F.concat(F.lit("o"), "o_orderkey").alias("child"), F.concat(F.lit("c"), "o_custkey").alias("parent"))
    return bib.crossref(own, edges).filter(F.col("key").startswith("o"))


def string_macros_asof(spark, sf_dir):
    """Macro uses take the last definition before them: sign-ups define a user's macro, later events use it."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    stream = rows.select(F.col("user_id").alias("doc_id"), seq.alias("seq"), F.when(F.col("event_type") == "signup", "def").otherwise("use").alias("kind"), F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("name"), F.col("event_id").cast("string").alias("value"))
    return bib.expanded_macros(stream)


def agents_parse(spark, sf_dir):
    c, s = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("van Last"), F.col("c_custkey").cast("string"), F.lit(", Jr, First and Ann de la Roe"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("First"), F.col("c_custkey").cast("string"), F.lit(" von der Last and Plain"))).otherwise(F.concat(F.lit("Last, First"), F.col("c_custkey").cast("string"))).alias("names"))
    rows = rows.union(s.select(F.col("s_suppkey") + 10000000, F.concat(F.lit("de Supp"), F.col("s_suppkey").cast("string"), F.lit(", Al B."))))
    return bib.agents(rows)


def agent_lines(spark, sf_dir):
    """Names as bibliographies and citations write them."""
    return ops.agent_lines(agents_parse(spark, sf_dir))


QUERIES = {f.__name__: f for f in (cite_map, resolve_citations, extra_year, cite_groups, cite_last_names, cite_modes, bibliography, entry_accessors, bib_dedupe, bib_normalise, xdata_inherit, crossref_inherit, string_macros_asof, agents_parse, agent_lines)}
_C = """WITH k AS (SELECT l_orderkey AS doc_id, (l_linenumber + 1) // 2 AS cmd_seq, (l_linenumber + 1) % 2 AS pos, l_partkey % 500 AS key FROM lineitem),
o AS (SELECT doc_id, cmd_seq, coalesce(sum(count(*)) OVER (PARTITION BY doc_id ORDER BY cmd_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM k GROUP BY doc_id, cmd_seq),
f AS (SELECT doc_id, key, min(cmd_seq) AS cmd_seq FROM k GROUP BY doc_id, key),
m AS (SELECT f.doc_id, f.key, CAST(o.off + max(k.pos) AS BIGINT) AS ord FROM f JOIN k USING (doc_id, key, cmd_seq) JOIN o USING (doc_id, cmd_seq) GROUP BY f.doc_id, f.key, o.off),
b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS author, CASE WHEN p_partkey % 5 = 0 THEN 'Ed ' || p_brand END AS editor, CAST(2000 + p_size % 3 AS VARCHAR) AS year, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'article' WHEN 2 THEN 'collection' ELSE 'misc' END AS type FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT m.doc_id, m.key, m.ord, coalesce(author, editor, '') AS agents, year, title, type FROM m JOIN b USING (key)),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, agents, year ORDER BY title NULLS FIRST, key) - 1 AS rk, count(*) OVER (PARTITION BY doc_id, agents, year) AS n FROM r),
x AS (SELECT *, CASE WHEN n > 1 THEN chr(CAST(97 + rk AS INT)) ELSE '' END AS suffix FROM y)
"""
SQL = {
    "cite_map": _C + "SELECT doc_id, key, ord FROM m",
    "resolve_citations": _C + "SELECT * FROM r",
    "extra_year": _C + "SELECT doc_id, key, year || suffix AS label FROM x",
    "cite_groups": _C + """, g AS (SELECT doc_id, ord, key, agents, year || suffix AS label, CASE WHEN lag(agents) OVER w IS DISTINCT FROM agents THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY ord, key)),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord, key ROWS UNBOUNDED PRECEDING) AS grp FROM g),
i AS (SELECT doc_id, grp, agents || ' ' || string_agg(label, ', ' ORDER BY ord, key) AS t FROM h GROUP BY doc_id, grp, agents)
SELECT doc_id, '(' || string_agg(t, '; ' ORDER BY grp) || ')' AS citation FROM i GROUP BY doc_id""",
    "cite_last_names": _C + """, last_names AS (SELECT p_partkey AS key, replace(p_brand, '#', 'N') || CASE WHEN p_partkey % 3 = 0 THEN ', Roe & Li' ELSE ' & Roe' END AS names FROM part),
g AS (SELECT x.doc_id, x.ord, x.key, m.names, x.year || x.suffix AS label, CASE WHEN lag(m.names) OVER w IS DISTINCT FROM m.names THEN 1 ELSE 0 END AS new FROM x JOIN last_names m ON m.key = x.key WINDOW w AS (PARTITION BY x.doc_id ORDER BY x.ord, x.key)),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord, key ROWS UNBOUNDED PRECEDING) AS grp FROM g),
i AS (SELECT doc_id, grp, names || ' ' || string_agg(label, ', ' ORDER BY ord, key) AS t FROM h GROUP BY doc_id, grp, names)
SELECT doc_id, '(' || string_agg(t, '; ' ORDER BY grp) || ')' AS citation FROM i GROUP BY doc_id""",
    "cite_modes": _C + """, g AS (SELECT doc_id, ord, key, agents, year || suffix AS label, CASE WHEN lag(agents) OVER w IS DISTINCT FROM agents THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY ord, key)),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord, key ROWS UNBOUNDED PRECEDING) AS grp FROM g),
i AS (SELECT doc_id, grp, agents AS a, string_agg(label, ', ' ORDER BY ord, key) AS y FROM h GROUP BY doc_id, grp, agents),
mo AS (SELECT doc_id, grp, unnest(['author_in_parentheses', 'textual', 'year', 'author', 'bare']) AS mode, unnest([a || ' ' || y, a || ' (' || y || ')', y, a, a || ' ' || y]) AS t FROM i),
li AS (SELECT doc_id, mode, list(t ORDER BY grp) AS l FROM mo GROUP BY doc_id, mode)
SELECT doc_id, mode, CASE WHEN mode = 'author_in_parentheses' THEN '(' || array_to_string(l, '; ') || ')' WHEN mode IN ('textual', 'author') THEN CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END ELSE array_to_string(l, '; ') END AS citation FROM li""",
    "bibliography": _C + """, z AS (SELECT doc_id, key, CASE type WHEN 'book' THEN agents || '. ' || year || suffix || '. ' || title || '. Berlin.' WHEN 'article' THEN agents || '. ' || year || suffix || '. ' || title || '. Berlin, in press.' WHEN 'collection' THEN agents || ' (ed.). ' || year || suffix || '. ' || title || '. Berlin.' ELSE agents || '. ' || year || suffix || '. ' || title || '.' END AS reference FROM x)
SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY reference, key) AS place, reference FROM z""",
    "entry_accessors": _C + "SELECT key, coalesce(author, editor) AS agents, coalesce(editor, '') AS editor_or_empty, coalesce(author, editor, title) AS first_of FROM b",
    "bib_dedupe": """WITH w AS (SELECT o_custkey % 300 AS key, o_orderkey AS seq, 0 AS pos, 'note' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey % 300, o_orderkey, 1, CASE WHEN o_orderkey % 2 = 0 THEN 'note' ELSE 'title' END, o_orderpriority FROM orders),
f AS (SELECT key, min(seq) AS seq FROM w GROUP BY key) SELECT key, name, arg_max(value, pos) AS value FROM w JOIN f USING (key, seq) GROUP BY key, name""",
    "bib_normalise": """WITH f AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'journal' ELSE 'address' END AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'journaltitle' WHEN 1 THEN 'location' ELSE 'school' END, p_brand FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'editor' ELSE 'institution' END, p_type FROM part),
m AS (SELECT key, CASE name WHEN 'journal' THEN 'journaltitle' WHEN 'address' THEN 'location' WHEN 'school' THEN 'institution' ELSE name END AS to_name, arg_max(value, name) AS value FROM f GROUP BY key, to_name)
SELECT m.key, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'collection' ELSE 'book' END ELSE 'article' END AS type, m.to_name AS name, m.value FROM m JOIN part ON p_partkey = m.key""",
    "xdata_inherit": """WITH c AS (SELECT 'c' || c_custkey AS key, c_mktsegment, 'n' || c_nationkey AS n FROM customer), n AS (SELECT 'n' || n_nationkey AS key, n_name, 'r' || n_regionkey AS r, n_regionkey FROM nation), r AS (SELECT 'r' || r_regionkey AS key, r_name, 'n' || r_regionkey AS n FROM region),
x AS (SELECT n.key, 'nation' AS name, n_name AS value FROM n UNION ALL SELECT key, 'place', n_name FROM n UNION ALL SELECT n.key, 'region', r_name FROM n JOIN r ON r.key = n.r)
SELECT key, name, value FROM x UNION ALL SELECT c.key, 'segment', c_mktsegment FROM c UNION ALL SELECT c.key, x.name, x.value FROM c JOIN x ON x.key = c.n
UNION ALL SELECT key, 'region', r_name FROM r UNION ALL SELECT key, 'place', r_name FROM r UNION ALL SELECT r.key, 'nation', n_name FROM r JOIN n ON n.key = r.n""",
    "crossref_inherit": """WITH w AS (SELECT 'o' || o_orderkey AS key, 'title' AS name, o_orderpriority AS value FROM orders UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'booktitle' ELSE 'note' END, o_orderstatus FROM orders)
SELECT * FROM w UNION ALL SELECT 'o' || o_orderkey, 'booktitle', c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'o' || o_orderkey, 'bookauthor', c_name FROM orders JOIN customer ON c_custkey = o_custkey""",
    "string_macros_asof": """WITH e AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type = 'signup' AS def, 'm' || (event_id % 2) AS name, CAST(event_id AS VARCHAR) AS value FROM events)
SELECT u.doc_id, u.seq, u.name, coalesce((SELECT arg_max(d.value, d.seq) FROM e d WHERE d.def AND d.doc_id = u.doc_id AND d.name = u.name AND d.seq < u.seq), '') AS value FROM e u WHERE NOT u.def""",
    "agents_parse": """SELECT c_custkey AS key, 1 AS place, 'First' AS first, 'van' AS prefix, 'Last' || c_custkey AS last, 'Jr' AS suffix FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 2, 'Ann', 'de la', 'Roe', '' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 1, 'First' || c_custkey, 'von der', 'Last', '' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, 2, '', '', 'Plain', '' FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, 1, 'First' || c_custkey, '', 'Last', '' FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT s_suppkey + 10000000, 1, 'Al B.', 'de', 'Supp' || s_suppkey, '' FROM supplier""",
    "agent_lines": """SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'Last' || c_custkey || ', First van, Jr & Ann de la Roe' WHEN 1 THEN 'Last, First' || c_custkey || ' von der & Plain' ELSE 'Last, First' || c_custkey END AS "outer",
CASE c_custkey % 3 WHEN 0 THEN 'First van Last' || c_custkey || ', Jr & Ann de la Roe' WHEN 1 THEN 'First' || c_custkey || ' von der Last & Plain' ELSE 'First' || c_custkey || ' Last' END AS "inner",
CASE c_custkey % 3 WHEN 0 THEN 'Last' || c_custkey || ' & Roe' WHEN 1 THEN 'Last & Plain' ELSE 'Last' END AS citing, CASE c_custkey % 3 WHEN 2 THEN '(ed.)' ELSE '(eds.)' END AS editors FROM customer
UNION ALL SELECT s_suppkey + 10000000, 'Supp' || s_suppkey || ', Al B. de', 'Al B. de Supp' || s_suppkey, 'Supp' || s_suppkey, '(ed.)' FROM supplier""",
}
