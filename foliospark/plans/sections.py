"""Queries on sections, files, regions and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import numbering
from ..operators import sections as ops
from .numbering import _R, events


def _headers(spark, sf_dir):
    return events(spark, sf_dir).filter("kind = 'header'").select("doc_id", "seq", "level", "starred")


def section_tree(spark, sf_dir):
    return ops.tree(_headers(spark, sf_dir)).select("doc_id", "seq", "level", "parent", "before_next")


def toc(spark, sf_dir):
    rows = ops.with_depth(_headers(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.max("depth").cast("bigint").alias("depth"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "depth"))), lambda x: F.concat(x["seq"].cast("string"), F.lit("@"), x["depth"].cast("string"))), " ").alias("entries"))


def split_files(spark, sf_dir):
    rows = ops.files(_headers(spark, sf_dir), 3)
    return rows.select("doc_id", "seq", "level", "file", fn.file_name(F.col("file").cast("int")).alias("name"))


def anchor_files(spark, sf_dir):
    rows = ops.files(_headers(spark, sf_dir), 3).select("doc_id", F.concat(F.lit("a"), (F.col("seq") % 20).cast("string")).alias("anchor"), "file")
    return ops.anchor_files(rows)


def region_split(spark, sf_dir):
    rows = numbering.with_regions(events(spark, sf_dir)).filter(numbering.numbered()).select("doc_id", "seq", F.col("in_region").alias("region"))
    return ops.region_runs(rows)


def notes_section(spark, sf_dir):
    rows = numbering.chapter_counters(events(spark, sf_dir)).filter("kind = 'note'")
    return ops.notes_section(rows.select("doc_id", "seq", "chapter", "n", F.concat(F.lit("note "), F.col("seq").cast("string")).alias("body")))


def append_sections(spark, sf_dir):
    rows = _headers(spark, sf_dir)
    extra = rows.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("place"), F.lit("Notes").alias("title")), F.struct(F.lit(2).alias("place"), F.lit("Bibliography").alias("title")))).alias("x")).select("doc_id", "x.*")
    return ops.appended(rows, extra)


def _paragraphs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def render_html(spark, sf_dir):
    rows = _paragraphs(spark, sf_dir).select("doc_id", "pos", F.concat(F.lit("<p>"), fn.xml_escaped(F.col("line")), F.lit("</p>")).alias("text"))
    out = ops.rendered(rows)
    return out.select("doc_id", F.concat(F.lit("<main>"), "rendered", F.lit("</main>")).alias("html"))


def render_xml(spark, sf_dir):
    rows = _paragraphs(spark, sf_dir).select("doc_id", "pos", F.concat(F.format_string('<p n="%d">', F.col("pos") + 1), fn.xml_escaped(F.col("line")), F.lit("</p>")).alias("text"))
    return ops.rendered(rows).select("doc_id", F.concat(F.lit("<body>"), "rendered", F.lit("</body>")).alias("xml"))


QUERIES = {f.__name__: f for f in (section_tree, toc, split_files, anchor_files, region_split, notes_section, append_sections, render_html, render_xml)}
_H = _R + """, h AS (SELECT doc_id, seq, level, starred FROM e WHERE kind = 'header'),
t AS (SELECT *, (SELECT max(p.seq) FROM h p WHERE p.doc_id = h.doc_id AND p.seq < h.seq AND p.level < h.level) AS parent, coalesce((SELECT min(p.seq) FROM h p WHERE p.doc_id = h.doc_id AND p.seq > h.seq AND p.level <= h.level) - 1, max(seq) OVER (PARTITION BY doc_id)) AS before_next FROM h),
fl AS (SELECT t.*, sum(CASE WHEN t.level < 3 OR t.parent IS NULL OR p.level < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.seq ROWS UNBOUNDED PRECEDING) AS file FROM t LEFT JOIN h p ON p.doc_id = t.doc_id AND p.seq = t.parent)
"""
_ESC = "replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_P = "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)\n"
SQL = {
    "section_tree": _H + "SELECT doc_id, seq, level, parent, before_next FROM t",
    "toc": _H.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """, d AS (SELECT doc_id, seq, parent, 1 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.seq, t.parent, d.depth + 1 FROM t JOIN d ON d.doc_id = t.doc_id AND d.seq = t.parent)
SELECT doc_id, CAST(max(depth) AS BIGINT) AS depth, string_agg(seq || '@' || depth, ' ' ORDER BY seq) AS entries FROM d GROUP BY doc_id""",
    "split_files": _H + "SELECT doc_id, seq, level, file, format('section-{:03d}.xhtml', CAST(file AS BIGINT)) AS name FROM fl",
    "anchor_files": _H + "SELECT doc_id, 'a' || (seq % 20) AS anchor, min(file) AS file FROM fl GROUP BY ALL",
    "region_split": _R + "SELECT doc_id, seq, in_region AS region, CASE max(CASE in_region WHEN 'front' THEN 0 WHEN 'main' THEN 1 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) WHEN 0 THEN 'front' WHEN 1 THEN 'main' ELSE 'back' END AS run FROM x WHERE num",
    "notes_section": _R + ", q AS (SELECT doc_id, chapter, note_n AS n, arg_max('note ' || seq, seq) AS body FROM x WHERE kind = 'note' GROUP BY doc_id, chapter, note_n) SELECT doc_id, chapter, string_agg(body, ' | ' ORDER BY n) AS notes, count(*) AS n_notes FROM q GROUP BY doc_id, chapter",
    "append_sections": _H + ", b AS (SELECT doc_id, max(seq) AS last, sum(CASE WHEN starred THEN 1 ELSE 0 END) AS ph FROM h GROUP BY doc_id) SELECT doc_id, last + 1 AS seq, 'Notes' AS title, 'sec-back-unnumbered-' || (ph + 1) AS anchor FROM b UNION ALL SELECT doc_id, last + 2, 'Bibliography', 'sec-back-unnumbered-' || (ph + 2) FROM b",
    "render_html": _P + f"SELECT doc_id, '<main>' || string_agg('<p>' || {_ESC} || '</p>', '' ORDER BY pos) || '</main>' AS html FROM p GROUP BY doc_id",
    "render_xml": _P + f"SELECT doc_id, '<body>' || string_agg('<p n=\"' || pos || '\">' || {_ESC} || '</p>', '' ORDER BY pos) || '</body>' AS xml FROM p GROUP BY doc_id",
}
