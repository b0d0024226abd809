"""Counters of a document as windows over its events.

`events` has one row for each state-changing event: doc_id, seq (document order), kind (region, header, figure, table, note, item, label),
level (1 part to 7 subparagraph), starred, region. All counters of a document share one window (partition doc_id, order seq, rows from
the beginning), so they cost one shuffle and one sort together. A counter that restarts is a running count less its value at the
last restart: running counts only grow, so that value is a running maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 7
#: What labels bind to: everything numbered but notes.
ANCHORS = ("header", "figure", "table", "item")


def so_far():
    return Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).over(so_far())


def since(count: Column, restart: Column) -> Column:
    """A running count from its last restart on."""
    return count - F.coalesce(F.max(F.when(restart, count)).over(so_far()), F.lit(0))


def numbered(level: int | None = None) -> Column:
    own = (F.col("kind") == "header") & ~F.col("starred")
    return own if level is None else own & (F.col("level") == level)


def with_regions(events: DataFrame) -> DataFrame:
    """Adds the region in force (front at first) and whether the row really changes it."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    here = F.coalesce(F.last("region", ignorenulls=True).over(so_far()), F.lit("front"))
    rows = events.withColumn("in_region", here)
    return rows.withColumn("changed", F.col("in_region") != F.coalesce(F.lag("in_region").over(w), F.lit("front")))


def with_numbers(events: DataFrame) -> DataFrame:
    """Adds n1 .. n7, the section number in force, phantom (headers without number so far), and chapter, figure, table and note counters."""
    rows = with_regions(events)
    rows = rows.select("*", *(running(numbered(k)).alias(f"_c{k}") for k in range(1, LEVELS + 1)), *(running(F.col("kind") == k).alias(f"_{k}") for k in ("figure", "table", "note")), running((F.col("kind") == "header") & F.col("starred")).alias("phantom"))
    restart = {1: F.col("changed")} | {k: F.col("changed") | (numbered() & F.col("level").between(2, k - 1)) for k in range(2, LEVELS + 1)}
    rows = rows.select("*", *(since(F.col(f"_c{k}"), restart[k]).alias(f"n{k}") for k in range(1, LEVELS + 1)), *(since(F.col(f"_{k}"), numbered(2)).alias(f"{k}_n") for k in ("figure", "table", "note")))
    rows = rows.withColumn("chapter", F.coalesce(F.last(F.when(numbered(2), F.col("n2")), ignorenulls=True).over(so_far()), F.lit(0)))
    return rows.drop(*(f"_c{k}" for k in range(1, LEVELS + 1)), "_figure", "_table", "_note")


def section_number() -> Column:
    """The seven components, dotted."""
    return F.concat_ws(".", *(F.col(f"n{k}").cast("string") for k in range(1, LEVELS + 1)))


def section_numbers(events: DataFrame) -> DataFrame:
    return with_numbers(events).filter(numbered()).select("doc_id", "seq", "level", F.col("in_region").alias("region"), section_number().alias("number"))


def phantom_headers(events: DataFrame) -> DataFrame:
    return with_numbers(events).filter((F.col("kind") == "header") & F.col("starred")).select("doc_id", "seq", "phantom", section_number().alias("number"))


def chapter_counters(events: DataFrame) -> DataFrame:
    rows = with_numbers(events).filter(F.col("kind").isin("figure", "table", "note"))
    n = F.when(F.col("kind") == "figure", F.col("figure_n")).when(F.col("kind") == "table", F.col("table_n")).otherwise(F.col("note_n"))
    return rows.select("doc_id", "seq", "kind", "chapter", n.alias("n"))


def with_items(rows: DataFrame) -> DataFrame:
    """Adds item: the number of the last example of an outer list in the chapter, and those in the inner lists around; rows as with_numbers() with in_list."""
    outer = running((F.col("kind") == "item") & (F.size("in_list") == 0))
    rows = rows.withColumn("_outer", outer).withColumn("_outer", since(F.col("_outer"), numbered(2)))
    return rows.withColumn("item", F.concat_ws("-", F.col("_outer").cast("string"), F.col("in_list").cast("array<string>"))).drop("_outer")


def own_anchor(rows: DataFrame) -> Column:
    """The id of what labels bind to; null for other rows. Examples count where rows have item."""
    from ..functions.text import section_id

    chapter = F.col("chapter").cast("string")
    own = F.when(numbered(), section_id(F.col("in_region"), F.array(*(F.col(f"n{k}") for k in range(2, LEVELS + 1)))))
    for kind in ("figure", "table"):
        own = own.when(F.col("kind") == kind, F.concat_ws("-", F.lit(kind), chapter, F.col(f"{kind}_n").cast("string")))
    return own.when(F.col("kind") == "item", F.concat_ws("-", F.lit("item"), chapter, F.col("item"))) if "item" in rows.columns else own


def with_anchors(events: DataFrame) -> DataFrame:
    """Adds anchor, the id of what was last numbered (the document's start at first)."""
    rows = with_numbers(events)
    rows = with_items(rows) if "in_list" in rows.columns else rows
    return rows.withColumn("anchor", F.coalesce(F.last(own_anchor(rows), ignorenulls=True).over(so_far()), F.lit("start")))


def labels(events: DataFrame) -> DataFrame:
    """doc_id, label, anchor: the last binding of each label."""
    return with_anchors(events).filter(F.col("label").isNotNull()).groupBy("doc_id", "label").agg(F.max_by("anchor", "seq").alias("anchor"))


def resolved(pointers: DataFrame, bound: DataFrame) -> DataFrame:
    """Pointers (doc_id, seq, label) with text and target; a label that nothing binds shows as ???."""
    rows = pointers.join(bound, ["doc_id", "label"], "left")
    return rows.select("doc_id", "seq", "label", F.coalesce("anchor", F.lit("???")).alias("text"), F.coalesce(F.concat(F.lit("#"), F.col("anchor")), F.lit("")).alias("target"))


def item_paths(items: DataFrame) -> DataFrame:
    """Numbered examples: items (doc_id, seq, chapter, list_id, sub) to chapter-wide top numbers and numbers within each sub-list."""
    top = Window.partitionBy("doc_id", "chapter").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sub = Window.partitionBy("doc_id", "chapter", "list_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = items.withColumn("n", F.sum(F.when(~F.col("sub"), 1).otherwise(0)).over(top)).withColumn("m", F.sum(F.when(F.col("sub"), 1).otherwise(0)).over(sub))
    return rows.select("doc_id", "seq", F.concat_ws(".", F.col("chapter").cast("string"), F.col("n").cast("string"), F.when(F.col("sub"), F.col("m").cast("string"))).alias("path"))
