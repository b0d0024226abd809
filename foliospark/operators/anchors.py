"""Anchors of parsed documents: rows of syntax trees become the events that numbering reads, and anchors meet files and links.

A header, figure, table, note or item and the labels after it are a pattern in the preorder of a tree; that each label binds to the last of those before it
is what the windows of numbering do, so a tree only has to be read off: each such node is an event at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from . import numbering, sections, trees

#: Levels of headers, and the regions that commands begin.
LEVELS = {"part": 1, "chapter": 2, "addchap": 2, "section": 3, "addsec": 3, "subsection": 4, "subsubsection": 5, "paragraph": 6, "subparagraph": 7}
REGIONS = {"frontmatter": "front", "mainmatter": "main", "appendix": "back", "backmatter": "back"}


#: Patterns of the names whose text is read, and of all that events() and counts() read.
TEXTS = "label|ref|nocite|parencite|textcite|autocite|cite.*|includegraphics"
NAMED = "|".join((TEXTS, *LEVELS, *REGIONS, "figure|table|footnote|ex|xlist"))


def _mapped(name: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), name)


def tree(atoms: DataFrame) -> DataFrame:
    """atoms of corpus.atoms() as nodes of trees; documents with errors are left out."""
    shift = [(F.col(c) + 1).alias(c) for c in ("node_id", "last_id", "parent_id")]
    return atoms.filter("error IS NULL").select(F.col("path").alias("doc_id"), *shift, "depth", "kind", "name", "text", "arg_kind", "arg_ord")


def literal() -> Column:
    """What a node adds to the literal text above it."""
    kind = F.col("kind")
    return F.when(kind == "plain", F.col("text")).when(kind.isin("white", "newline"), " ").when(kind == "sub", "_").when(kind == "sup", "^").when(kind == "align", "&")


def item_paths(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, in_list (numbers in the inner lists around, outermost first; empty for items of an outer list) of each numbered example."""
    items = nodes.filter("kind = 'command' AND name = 'ex'").select("doc_id", "node_id", "parent_id")
    inner = nodes.filter("kind = 'group' AND name = 'xlist'")
    spans = inner.select("doc_id", F.col("node_id").alias("low"), F.col("last_id").alias("high"), F.col("node_id").alias("list_id"))
    around = trees.contained(spans, items.withColumnRenamed("node_id", "at")).select("doc_id", "list_id", F.col("at").alias("node_id"), "parent_id")
    w = Window.partitionBy("doc_id", "list_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    numbers = around.withColumn("n", F.sum((F.col("parent_id") == F.col("list_id")).cast("int")).over(w))
    path = F.transform(F.array_sort(F.collect_list(F.struct("list_id", "n"))), lambda x: x["n"])
    return items.join(numbers.groupBy("doc_id", "node_id").agg(path.alias("in_list")), ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("in_list", F.array().cast("array<bigint>")).alias("in_list"))


def events(nodes: DataFrame) -> DataFrame:
    """Events of numbering.py from trees, with pointer (the label of a reference) and in_list (of items); seq is the node's place."""
    command, name = F.col("kind") == "command", F.col("name")
    level, region = F.when(command, _mapped(name, LEVELS)), F.when(command, _mapped(name, REGIONS))
    kind = (
        F.when(level.isNotNull(), "header").when(region.isNotNull(), "region").when((F.col("kind") == "group") & name.isin("figure", "table"), name)
        .when(command & (name == "footnote"), "note").when(command & (name == "ex"), "item").when(command & name.isin("label", "ref"), name)
    )
    starred = (F.col("text") == "*") | name.startswith("add")
    # the ids of labels are in the nodes below them
    within = nodes.withColumn("_id", F.max(F.when(command & name.isin("label", "ref"), F.col("last_id"))).over(Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)))
    texts = trees.subtree_texts(within.filter("node_id <= _id").drop("_id"), literal())
    rows = nodes.select("doc_id", F.col("node_id").alias("seq"), kind.alias("kind"), level.alias("level"), (level.isNotNull() & starred).alias("starred"), region.alias("region")).filter("kind IS NOT NULL")
    rows = rows.join(texts.withColumnRenamed("node_id", "seq"), ["doc_id", "seq"], "left").join(item_paths(nodes).withColumnRenamed("node_id", "seq"), ["doc_id", "seq"], "left")
    return rows.select("doc_id", "seq", "kind", "level", "starred", "region", F.when(F.col("kind") == "label", F.col("text")).alias("label"), F.when(F.col("kind") == "ref", F.col("text")).alias("pointer"), "in_list")


def extracted(rows: DataFrame, level: int = 3) -> DataFrame:
    """doc_id, seq, anchor, file of everything that has an anchor, notes and unnumbered headers too; file is null before the first header."""
    numbers = numbering.with_items(numbering.with_numbers(rows))
    region = F.when(F.col("in_region") == "front", "front-").when(F.col("in_region") == "back", "back-").otherwise("")
    unnumbered = F.concat(F.lit("sec-"), region, F.lit("unnumbered-"), F.col("phantom").cast("string"))
    note = F.concat_ws("-", F.lit("note"), F.col("chapter").cast("string"), F.col("note_n").cast("string"))
    anchor = F.when((F.col("kind") == "header") & F.col("starred"), unnumbered).when(F.col("kind") == "note", note).otherwise(numbering.own_anchor(numbers))
    starts = sections.files(rows.filter("kind = 'header'").select("doc_id", "seq", "level"), level).select("doc_id", "seq", "file")
    numbers = numbers.join(starts, ["doc_id", "seq"], "left").withColumn("file", F.last("file", ignorenulls=True).over(numbering.so_far()))
    return numbers.select("doc_id", "seq", anchor.alias("anchor"), "file").filter("anchor IS NOT NULL")


def link_targets(rows: DataFrame, level: int = 3) -> DataFrame:
    """doc_id, seq, label, target of every reference: the file that holds the anchor of its label, if any, and the anchor; empty where nothing binds the label."""
    pointers = rows.filter("pointer IS NOT NULL").select("doc_id", "seq", F.col("pointer").alias("label"))
    files = sections.anchor_files(extracted(rows, level))
    found = pointers.join(numbering.labels(rows), ["doc_id", "label"], "left").join(files, ["doc_id", "anchor"], "left")
    target = F.concat(F.when(F.col("file").isNotNull(), file_name(F.col("file").cast("int"))).otherwise(""), F.lit("#"), F.col("anchor"))
    return found.select("doc_id", "seq", "label", F.coalesce(target, F.lit("")).alias("target"))


def counts(nodes: DataFrame) -> DataFrame:
    """doc_id, n_works (that citations name), n_media (images), n_notes, n_unnumbered (headers) of every document."""
    command, name = F.col("kind") == "command", F.col("name")
    naming = command & (name.isin("nocite", "parencite", "textcite", "autocite") | name.startswith("cite") | (name == "includegraphics"))
    inner = nodes.withColumn("_until", F.max(F.when(naming, F.col("last_id"))).over(Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)))
    # what is said before or after a citation stands in its optional arguments
    own = F.when(F.coalesce(F.col("arg_kind"), F.lit("m")) == "m", literal())
    named = trees.subtree_texts(inner.filter("node_id <= _until"), own).join(nodes.filter(naming).select("doc_id", "node_id", "name"), ["doc_id", "node_id"])
    parts = F.when(name == "includegraphics", F.array("text")).otherwise(F.filter(F.transform(F.split("text", ","), lambda k: F.trim(k)), lambda k: k != ""))
    sets = named.select("doc_id", (name == "includegraphics").alias("_image"), F.explode(parts).alias("_part")).groupBy("doc_id")
    sets = sets.agg(F.count_distinct(F.when(~F.col("_image"), F.col("_part"))).alias("n_works"), F.count_distinct(F.when(F.col("_image"), F.col("_part"))).alias("n_media"))
    unnumbered = command & name.isin(*LEVELS) & ((F.col("text") == "*") | name.startswith("add"))
    rows = nodes.groupBy("doc_id").agg(F.count(F.when(command & (name == "footnote"), 1)).alias("n_notes"), F.count(F.when(unnumbered, 1)).alias("n_unnumbered"))
    return rows.join(sets, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_works", "n_media", "n_notes", "n_unnumbered")))


def derived(rows: DataFrame) -> DataFrame:
    """counts() to the sections that follow from them (doc_id, place, title): one of notes and one of works, none for what there isn't."""
    both = F.array(F.when(F.col("n_notes") > 0, F.struct(F.lit(1).alias("place"), F.lit("Notes").alias("title"))), F.when(F.col("n_works") > 0, F.struct(F.lit(2).alias("place"), F.lit("Bibliography").alias("title"))))
    return rows.select("doc_id", F.explode(F.array_compact(both)).alias("x")).select("doc_id", "x.*")
