"""Queries on parsed documents with their anchors and links, and on the works that documents cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors as ops
from ..operators import corpus, sections, works
from ..operators.bibliography import written
from ..sources import files
from .numbering import events
from .sections import _H

#: Commands of headers by level, as in the events.
_HEADERS = ("part", "chapter", "section", "subsection", "subsubsection")


def _sources(spark, sf_dir):
    """A TeX document for each user: its events as parts and chapters, figures, notes, regions, with their labels and references."""
    rows = events(spark, sf_dir)
    header = F.element_at(F.array(*map(F.lit, _HEADERS)), F.col("level").cast("int"))
    label = F.coalesce(F.concat(F.lit("\\label{"), "label", F.lit("}")), F.lit(""))
    ref = F.coalesce(F.concat(F.lit("See \\ref{"), "pointer", F.lit("}.")), F.lit(""))
    made = (
        F.when((F.col("kind") == "header") & F.col("starred"), F.concat(F.lit("\\"), header, F.lit("*{Aside}"), label))
        .when(F.col("kind") == "header", F.concat(F.lit("\\"), header, F.lit("[short]{One \\emph{more}}"), label))
        .when(F.col("kind") == "figure", F.concat(F.lit("\\begin{figure}\\includegraphics{x/f"), (F.col("seq") % 5).cast("string"), F.lit(".png}\\caption{Shown}"), label, F.lit("\\end{figure}")))
        .when(F.col("kind") == "note", F.concat(F.lit("Text\\footnote{A note}"), label))
        .otherwise(F.concat(F.lit("\\"), "region", F.lit("matter"), label, F.lit(" By \\citet{k"), F.col("seq").cast("string"), F.lit(",k0}.")))
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(made, F.lit("\n"), ref).alias("t")))), lambda x: x["t"])
    docs = rows.groupBy("doc_id").agg(F.concat(F.lit("\\documentclass{book}\\begin{document}\n"), F.array_join(texts, "\n\n"), F.lit("\n\\end{document}\n")).alias("text"))
    return docs.select(F.col("doc_id").cast("string").alias("path"), "text").transform(corpus.spread)


def _nodes(spark, sf_dir):
    """What anchors and counts need of the syntax trees of the documents, parsed once."""
    return written(ops.tree(corpus.atoms(_sources(spark, sf_dir), named=ops.NAMED, whole=ops.TEXTS)))


def _read(spark, sf_dir):
    return written(ops.events(_nodes(spark, sf_dir)))


def parsed_anchors(spark, sf_dir):
    """Everything with an anchor in the parsed documents, and the first file that holds it."""
    from ..operators.sections import anchor_files

    return anchor_files(ops.extracted(_read(spark, sf_dir))).select(F.col("doc_id").cast("bigint").alias("doc_id"), "anchor", "file")


def link_targets(spark, sf_dir):
    """What the references of the parsed documents point to, by file."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return ops.link_targets(_read(spark, sf_dir)).select(F.col("doc_id").cast("bigint").alias("doc_id"), place.alias("place"), "label", "target")


def document_counts(spark, sf_dir):
    """How many works, images, notes and unnumbered headers a document has."""
    return ops.counts(_nodes(spark, sf_dir)).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def derived_sections(spark, sf_dir):
    """Sections of notes and of works after the last header, where there is something for them to hold."""
    nodes = _nodes(spark, sf_dir)
    headers = ops.events(nodes).filter("kind = 'header'").select("doc_id", "seq", "starred")
    made = sections.appended(headers, ops.derived(ops.counts(nodes)))
    return made.select(F.col("doc_id").cast("bigint").alias("doc_id"), "title", "anchor")


def figure_media(spark, sf_dir):
    """Where the image of each figure is; nothing for those that aren't anywhere."""
    media = corpus.parsed(_sources(spark, sf_dir), whole=False).select(F.col("path").cast("bigint").alias("doc_id"), F.posexplode("media").alias("media_id", "name"))
    listing = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("media/f"), (F.col("p_partkey") % 4).cast("string"), F.lit(".png")).alias("path")).distinct()
    return files.located(media, listing)


#: One text for both engines: a work for each part, of twelve types, some fields empty or absent.
WORKS = """
SELECT concat('k', CAST(p_partkey AS VARCHAR(19))) AS key, CASE p_partkey % 12 WHEN 0 THEN 'book' WHEN 1 THEN 'article' WHEN 2 THEN 'collection' WHEN 3 THEN 'proceedings' WHEN 4 THEN 'incollection' WHEN 5 THEN 'inproceedings'
  WHEN 6 THEN 'phdthesis' WHEN 7 THEN 'mastersthesis' WHEN 8 THEN 'report' WHEN 9 THEN 'online' WHEN 10 THEN 'inbook' ELSE 'manual' END AS type,
  CASE WHEN p_partkey % 12 IN (2, 3) AND p_size % 3 = 0 THEN '' ELSE concat('Author ', CAST(p_size % 7 AS VARCHAR(9))) END AS author, CASE WHEN p_size % 2 = 0 THEN concat('Editor ', CAST(p_size % 5 AS VARCHAR(9))) ELSE '' END AS editor,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(1990 + p_size % 3 AS VARCHAR(9)) END AS year, CAST(1990 + p_size % 3 AS VARCHAR(9)) AS day, CASE WHEN p_size % 9 = 0 THEN concat(p_name, '?') ELSE p_name END AS title, p_brand AS publisher,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS location, CAST(p_size AS VARCHAR(9)) AS volume, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size % 4 AS VARCHAR(9)) END AS number
FROM part
"""


def works_cited(spark, sf_dir):
    """The references of the works that each order cites (its parts), told apart within the order."""
    rows = spark.sql(WORKS.replace("FROM part", "FROM {rows}"), rows=spark.read.parquet(f"{sf_dir}/part.parquet"))
    shared = {"booktitle": "title", "journaltitle": "publisher", "institution": "publisher", "url": "publisher", "pages": "volume", "date": "day"}
    names = {c: c for c in ("author", "editor", "year", "title", "publisher", "location", "volume", "number")} | shared
    fields = rows.select("key", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in names.items()))).alias("x")).select("key", "x.*")
    cited = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("key"))
    return works.by_document(cited, works.described(rows.select("key", "type"), fields)).select("doc_id", "key", "year", "full")


def _sentence(text):
    return f"CASE WHEN regexp_matches({text}, '(^|[.?!])$') THEN {text} ELSE ({text}) || '.' END"


QUERIES = {f.__name__: f for f in (parsed_anchors, link_targets, document_counts, derived_sections, figure_media, works_cited)}
_A = _H + """, o AS (SELECT x.doc_id, x.seq, last_value(fl.file IGNORE NULLS) OVER (PARTITION BY x.doc_id ORDER BY x.seq ROWS UNBOUNDED PRECEDING) AS file,
  CASE WHEN x.num THEN x.sec WHEN x.kind = 'header' THEN 'sec-' || CASE x.in_region WHEN 'front' THEN 'front-' WHEN 'back' THEN 'back-' ELSE '' END || 'unnumbered-' || x.phantom WHEN x.kind IN ('figure', 'note') THEN x.kind || '-' || x.chapter || '-' || CASE x.kind WHEN 'figure' THEN x.figure_n ELSE x.note_n END END AS anchor
 FROM x LEFT JOIN fl ON fl.doc_id = x.doc_id AND fl.seq = x.seq),
af AS (SELECT doc_id, anchor, min(file) AS file FROM o WHERE anchor IS NOT NULL GROUP BY doc_id, anchor)
"""
_D = _A + """, q AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'region') + CAST(count(*) FILTER (WHERE kind = 'region') > 0 AS BIGINT) AS n_works, count(DISTINCT CASE WHEN kind = 'figure' THEN seq % 5 END) AS n_media, count(*) FILTER (WHERE kind = 'note') AS n_notes,
 count(*) FILTER (WHERE kind = 'header' AND starred) AS n_unnumbered FROM e GROUP BY doc_id)
"""
_PLACE = "concat_ws(': ', nullif(location, ''), publisher)"
SQL = {
    "parsed_anchors": _A + "SELECT doc_id, anchor, file FROM af",
    "link_targets": _A + """SELECT e.doc_id, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY e.seq) AS INTEGER) AS place, e.pointer AS label, coalesce(coalesce(format('section-{:03d}.xhtml', CAST(af.file AS BIGINT)), '') || '#' || l.anchor, '') AS target
FROM e LEFT JOIN l ON l.doc_id = e.doc_id AND l.label = e.pointer LEFT JOIN af ON af.doc_id = l.doc_id AND af.anchor = l.anchor WHERE e.pointer IS NOT NULL""",
    "document_counts": _D + "SELECT doc_id, n_works, n_media, n_notes, n_unnumbered FROM q",
    "derived_sections": _D + """SELECT doc_id, 'Notes' AS title, 'sec-back-unnumbered-' || (n_unnumbered + 1) AS anchor FROM q WHERE n_notes > 0
UNION ALL SELECT doc_id, 'Bibliography', 'sec-back-unnumbered-' || (n_unnumbered + CASE WHEN n_notes > 0 THEN 2 ELSE 1 END) FROM q WHERE n_works > 0""",
    "figure_media": _D + """, i AS (SELECT DISTINCT doc_id, 'x/f' || seq % 5 || '.png' AS name FROM e WHERE kind = 'figure')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY name) - 1 AS INTEGER) AS media_id, name, CASE WHEN name IN (SELECT 'x/f' || p_partkey % 4 || '.png' FROM part) THEN 'media/' || split_part(name, '/', 2) ELSE '' END AS location FROM i""",
    "works_cited": f"""WITH w AS ({WORKS}),
c AS (SELECT DISTINCT l_orderkey AS doc_id, 'k' || l_partkey AS key FROM lineitem),
a AS (SELECT *, CASE WHEN author <> '' THEN author ELSE editor END AS agents, CASE WHEN year <> '' THEN year ELSE day END AS y, {_sentence(_PLACE)} AS place,
 concat_ws(', ', CASE WHEN editor <> '' THEN editor || ' (ed.)' END, title) AS source FROM w),
b AS (SELECT *, CASE type WHEN 'article' THEN publisher || ' ' || volume || CASE WHEN number <> '' THEN '(' || number || ')' ELSE '' END || ', ' || volume || '.'
 WHEN 'incollection' THEN 'In ' || source || ', ' || volume || '. ' || place WHEN 'inproceedings' THEN 'In ' || source || ', ' || volume || '. ' || place WHEN 'inbook' THEN 'In ' || source || ', ' || volume || '. ' || place
 WHEN 'phdthesis' THEN 'Dissertation, ' || publisher || '.' WHEN 'mastersthesis' THEN 'MA thesis, ' || publisher || '.' WHEN 'report' THEN 'Report' || CASE WHEN number <> '' THEN ' ' || number ELSE '' END || ', ' || publisher || '.' WHEN 'online' THEN publisher || '.' ELSE place END AS tail,
 CASE WHEN type IN ('collection', 'proceedings') AND author = '' AND agents <> '' THEN agents || ' (ed.).' WHEN agents = '' THEN NULL ELSE agents || '.' END AS head FROM a),
d AS (SELECT c.doc_id, b.*, CASE WHEN count(*) OVER g > 1 THEN chr(CAST(96 + row_number() OVER (PARTITION BY c.doc_id, agents, y ORDER BY title, b.key) AS INTEGER)) ELSE '' END AS suffix FROM c JOIN b USING (key) WINDOW g AS (PARTITION BY c.doc_id, agents, y))
SELECT doc_id, key, y || suffix AS year, concat_ws(' ', head, y || suffix || '.', {_sentence("title")}, tail) AS full FROM d""",
}
