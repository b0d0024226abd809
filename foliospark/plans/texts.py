"""Queries on text functions: rewriting, white space, tokens, formats, tables, inlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn

#: Fixed values of the symbol query: command, character.
_SYMBOLS = (("alpha", "α"), ("beta", "β"), ("ss", "ß"), ("times", "×"), ("infty", "∞"))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ligatures(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("?`"), "text", F.lit("``q''--"), "role", F.lit("---!`'x`"))
    return rows.select("conv_id", "turn", fn.ligated(raw).alias("text"))


def symbols(spark, sf_dir):
    """Commands of nodes become characters through a small table; unknown ones stay."""
    dim = spark.createDataFrame(list(_SYMBOLS), "name string, character string")
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.element_at(F.array(*(F.lit(x) for x in ("alpha", "beta", "ss", "times", "infty", "unknown"))), (F.col("p_partkey") % 6 + 1).cast("int")).alias("name"))
    return rows.join(F.broadcast(dim), "name", "left").select("node", F.coalesce("character", F.concat(F.lit("\\"), "name")).alias("text"))


def accents(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer")
    return rows.select("c_custkey", fn.accented(F.col("c_mktsegment"), "\u0301").alias("acute"), fn.accented(F.lit(""), "\u0308").alias("bare"))


def whitespace_collapse(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", fn.white_collapsed(F.concat("text", F.lit(" % gone\n   next\n\n \n end  "))).alias("text"))


def tokenize_catcodes(spark, sf_dir):
    """Runs of characters of one category over whole texts: how many runs and characters of each category a document has."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    kinds = (("letter", r"\p{L}+"), ("space", r"[ \t]+"), ("eol", r"\n+"), ("special", r"[\\{}$&#^_~%]+"), ("other", r"[^\p{L} \t\n\\{}$&#^_~%]+"))
    cols = [F.struct(F.lit(k).alias("kind"), F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))).cast("bigint").alias("runs"), F.length(F.array_join(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)), "")).cast("bigint").alias("chars")) for k, p in kinds]
    return rows.select("conv_id", "turn", F.explode(F.array(*cols)).alias("x")).groupBy("conv_id", "x.kind").agg(F.sum("x.runs").alias("runs"), F.sum("x.chars").alias("chars"))


def group_balance(spark, sf_dir):
    """Whether a page's div tags balance: the running depth never falls below zero and ends there."""
    rows = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(</?div)"), F.lit(1))).alias("pos", "tag"))
    step = F.when(F.col("tag") == "<div", 1).otherwise(-1)
    depth = F.sum(step).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("depth", depth)
    return rows.groupBy("page_id").agg(F.min("depth").alias("lowest"), F.max("depth").alias("deepest"), F.max_by("depth", "pos").alias("last")).select("page_id", "lowest", "deepest", ((F.col("lowest") >= 0) & (F.col("last") == 0)).alias("balanced"))


def plain_text(spark, sf_dir):
    """Markup dropped, blanks collapsed and trimmed."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(bare, r"[ \t\r\n]+", " "), r"^ | $", "").alias("text"))


def fmt_helpers(spark, sf_dir):
    rows = _table(spark, sf_dir, "part")
    empty = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand"))
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("."))).otherwise(F.col("p_name"))
    agents = F.slice(F.array("p_brand", "p_type", "p_name"), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))
    return rows.select("p_partkey", fn.sep_by(empty, F.col("p_type"), ", ").alias("sep_by"), fn.sep_by_dot(empty, title).alias("by_dot"), fn.dotted(title).alias("dotted"), fn.wrapped(empty, "(", ")").alias("wrapped"), fn.sep_end_by(agents, ", ", " & ").alias("agents"), F.when(F.size(agents) == 1, "(ed.)").otherwise("(eds.)").alias("editors"), fn.letters(F.col("p_partkey") % 750).alias("letters"))


def table_cells(spark, sf_dir):
    """Typeset rows and cells: orders as tables, their priority and status as cells; ragged rows stay so."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("&"), "o_orderstatus", F.lit("\\\\"), "o_orderpriority", F.lit("\\\\")).alias("body"))
    cells = rows.select("o_orderkey", F.posexplode(F.filter(F.split("body", r"\\\\"), lambda x: x != "")).alias("row", "line")).select("o_orderkey", "row", F.posexplode(F.split("line", "&")).alias("cell", "text"))
    return cells.select("o_orderkey", "row", "cell", F.trim("text").alias("text"))


def gloss_align(spark, sf_dir):
    """Interlinear lines: the words of all turns of a conversation by their place, as wide as the longest turn."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"[ \n\t]+"), lambda x: x != "")).alias("pos", "word"))
    wide = rows.groupBy("conv_id").agg((F.max("pos") + 1).cast("bigint").alias("columns"))
    return rows.join(wide, "conv_id").select("conv_id", "turn", "pos", "word", "columns")


def inline_dispatch(spark, sf_dir):
    """Citation commands: keys split at commas and trimmed, empty ones dropped, the command's mode from a small table."""
    modes = spark.createDataFrame([("cite", "inline"), ("citet", "text"), ("citep", "parentheses")], "command string, mode string")
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(F.lit("cite"), F.lit("citet"), F.lit("citep"), F.lit("other")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("command"), F.concat(F.lit(" k"), F.col("s_suppkey").cast("string"), F.lit(", ,k"), F.col("s_nationkey").cast("string"), F.lit(",")).alias("keys"))
    rows = rows.select("s_suppkey", "command", F.posexplode(F.filter(F.transform(F.split("keys", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "key"))
    return rows.join(F.broadcast(modes), "command", "left").select("s_suppkey", F.coalesce("mode", F.lit("unknown")).alias("mode"), "pos", "key")


def mime_ncname(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages")
    path = F.concat("url", F.element_at(F.array(F.lit(".png"), F.lit(".JPG"), F.lit(".svg"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")))
    return rows.select("page_id", fn.nc_name(F.concat(F.element_at(F.array(F.lit("1"), F.lit("")), (F.col("page_id") % 2 + 1).cast("int")), "url")).alias("id"), fn.media_type(path).alias("type"))


def date_format(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    text = F.when(n % 4 == 0, "1996").when(n % 4 == 1, F.concat(F.lit("1996-"), (n % 15).cast("string"))).when(n % 4 == 2, F.concat(F.lit("1996-"), (n % 12 + 1).cast("string"), F.lit("-"), (n % 35).cast("string"))).otherwise("soon")
    return rows.select("o_orderkey", fn.user_date(text, F.lit("2020-02-02")).alias("date"))


def number_bases(spark, sf_dir):
    n = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part")
    hexa = F.hex(n)
    return rows.select("p_partkey", hexa.alias("hexadecimal"), F.conv(hexa, 16, 10).cast("bigint").alias("back"), F.when(F.rlike("p_name", F.lit("^[0-9]+$")), F.expr("try_cast(p_name AS bigint)")).alias("digits"), F.expr("try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS bigint)").alias("number"))


QUERIES = {f.__name__: f for f in (ligatures, symbols, accents, whitespace_collapse, tokenize_catcodes, group_balance, plain_text, fmt_helpers, table_cells, gloss_align, inline_dispatch, mime_ncname, date_format, number_bases)}
_LIG = "replace(replace(replace(replace(replace(replace(replace(replace({}, '?`', '¿'), '!`', '¡'), '---', '—'), '--', '–'), '``', '“'), '''''', '”'), '`', '‘'), '''', '’')"
_KINDS = (("letter", r"\p{L}+"), ("space", r"[ \t]+"), ("eol", r"\n+"), ("special", r"[\\{}$&#^_~%]+"), ("other", r"[^\p{L} \t\n\\{}$&#^_~%]+"))
_EMPTY, _TITLE = "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END", "CASE WHEN p_partkey % 2 = 0 THEN p_name || '.' ELSE p_name END"
_DOT = f"CASE WHEN ends_with({_TITLE}, '.') THEN {_TITLE} ELSE {_TITLE} || '.' END"
_N = "(p_partkey % 750)"
_D = "CASE WHEN o_orderkey % 4 = 0 THEN '1996' WHEN o_orderkey % 4 = 1 THEN '1996-' || lpad(CAST(least(greatest(o_orderkey % 15, 1), 12) AS VARCHAR), 2, '0') WHEN o_orderkey % 4 = 2 THEN '1996-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(least(greatest(o_orderkey % 35, 1), day(last_day(make_date(1996, CAST(o_orderkey % 12 + 1 AS INT), 1)))) AS VARCHAR), 2, '0') ELSE '2020-02-02' END"
SQL = {
    "ligatures": "SELECT conv_id, turn, " + _LIG.format("'?`' || text || '``q''''--' || role || '---!`''x`'") + " AS text FROM conversations",
    "symbols": "SELECT p_partkey AS node, CASE p_partkey % 6 WHEN 0 THEN 'α' WHEN 1 THEN 'β' WHEN 2 THEN 'ß' WHEN 3 THEN '×' WHEN 4 THEN '∞' ELSE '\\unknown' END AS text FROM part",
    "accents": "SELECT c_custkey, substr(c_mktsegment, 1, 1) || '\u0301' || substr(c_mktsegment, 2) AS acute, ' \u0308' AS bare FROM customer",
    "whitespace_collapse": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' % gone' || chr(10) || '   next' || chr(10) || chr(10) || ' ' || chr(10) || ' end  ', '%[^\n]*\n[ \t]*', '', 'g'), '^[ \t\n]+', ''), '[ \t]*\n[ \t]*\n[ \t\n]*', '¶', 'g'), '[ \t\n]+', ' ', 'g') AS text FROM documents""",
    "tokenize_catcodes": "WITH k AS (" + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS runs, length(array_to_string(regexp_extract_all(text, '{p}'), '')) AS chars FROM conversations" for k, p in _KINDS) + ") SELECT conv_id, kind, sum(runs) AS runs, sum(chars) AS chars FROM k GROUP BY ALL",
    "group_balance": "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '</?div')) AS tag, generate_subscripts(regexp_extract_all(html, '</?div'), 1) AS pos FROM pages), d AS (SELECT *, sum(CASE WHEN tag = '<div' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM t) SELECT page_id, min(depth) AS lowest, max(depth) AS deepest, min(depth) >= 0 AND arg_max(depth, pos) = 0 AS balanced FROM d GROUP BY page_id",
    "plain_text": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM pages",
    "fmt_helpers": f"""SELECT p_partkey, concat_ws(', ', nullif({_EMPTY}, ''), p_type) AS sep_by, CASE WHEN p_partkey % 3 = 0 THEN {_TITLE} ELSE CASE WHEN ends_with(p_brand, '.') THEN p_brand ELSE p_brand || '.' END || ' ' || {_TITLE} END AS by_dot, {_DOT} AS dotted, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '(' || p_brand || ')' END AS wrapped,
CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' & ' || p_type ELSE p_brand || ', ' || p_type || ' & ' || p_name END AS agents, CASE WHEN p_partkey % 3 = 0 THEN '(ed.)' ELSE '(eds.)' END AS editors,
CASE WHEN {_N} < 26 THEN chr(CAST(97 + {_N} AS INT)) WHEN {_N} < 702 THEN chr(CAST(97 + ({_N} - 26) // 26 AS INT)) || chr(CAST(97 + ({_N} - 26) % 26 AS INT)) ELSE chr(CAST(97 + ({_N} - 702) // 676 AS INT)) || chr(CAST(97 + ({_N} - 702) // 26 % 26 AS INT)) || chr(CAST(97 + ({_N} - 702) % 26 AS INT)) END AS letters FROM part""",
    "table_cells": 'SELECT o_orderkey, 0 AS "row", 0 AS cell, trim(o_orderpriority) AS text FROM orders UNION ALL SELECT o_orderkey, 0, 1, trim(o_orderstatus) FROM orders UNION ALL SELECT o_orderkey, 1, 0, trim(o_orderpriority) FROM orders',
    "gloss_align": r"""WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda x: x <> '') AS w FROM conversations), u AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM s)
SELECT conv_id, turn, pos, word, max(pos + 1) OVER (PARTITION BY conv_id) AS columns FROM u""",
    "inline_dispatch": "WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'inline' WHEN 1 THEN 'text' WHEN 2 THEN 'parentheses' ELSE 'unknown' END AS mode, s_nationkey FROM supplier) SELECT s_suppkey, mode, 0 AS pos, 'k' || s_suppkey AS key FROM c UNION ALL SELECT s_suppkey, mode, 1, 'k' || s_nationkey FROM c",
    "mime_ncname": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '_1' ELSE '' END || regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS id, CASE WHEN page_id % 4 = 0 THEN 'image/png' WHEN page_id % 4 = 1 THEN 'image/jpeg' WHEN page_id % 4 = 2 THEN 'image/svg+xml' ELSE 'application/xhtml+xml' END AS type FROM pages",
    "date_format": f"SELECT o_orderkey, {_D} AS date FROM orders",
    "number_bases": "SELECT p_partkey, printf('%X', p_partkey) AS hexadecimal, p_partkey AS back, CASE WHEN regexp_matches(p_name, '^[0-9]+$') THEN TRY_CAST(p_name AS BIGINT) END AS digits, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS number FROM part",
}
