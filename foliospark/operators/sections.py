"""Sections, files and derived parts of documents, from headers (doc_id, seq, level) by windows; no interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 7
RANKS = {"front": 0, "main": 1, "back": 2}


def ordered():
    return Window.partitionBy("doc_id").orderBy("seq")


def tree(headers: DataFrame) -> DataFrame:
    """Adds parent (seq of the nearest earlier header of a lower level) and last (seq of the section's last header)."""
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    after = ordered().rowsBetween(1, Window.unboundedFollowing)

    def nearest(k: int) -> Column:
        return F.max(F.when(F.col("level") < k, F.col("seq"))).over(before)

    def next_(k: int) -> Column:
        return F.min(F.when(F.col("level") <= k, F.col("seq"))).over(after)

    end = F.max("seq").over(Window.partitionBy("doc_id"))
    parent = F.coalesce(*(F.when(F.col("level") == k, nearest(k)) for k in range(1, LEVELS + 1)))
    following = F.coalesce(*(F.when(F.col("level") == k, next_(k)) for k in range(1, LEVELS + 1)))
    return headers.withColumn("parent", parent).withColumn("before_next", F.coalesce(following - 1, end))


def with_depth(headers: DataFrame) -> DataFrame:
    """Adds depth: how many sections a section lies in, itself included; an open section of level k is one no header of level k or less has followed."""
    rows, w = headers, ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = [F.max(F.when(F.col("level") == k, F.col("seq"))).over(w).alias(f"_o{k}") for k in range(1, LEVELS + 1)]
    closed = [F.max(F.when(F.col("level") < k, F.col("seq"))).over(w).alias(f"_c{k}") for k in range(1, LEVELS + 1)]
    rows = rows.select("*", *opened, *closed)
    depth = sum((F.when((F.col("level") >= k) & F.col(f"_o{k}").isNotNull() & (F.coalesce(F.col(f"_c{k}"), F.lit(-1)) < F.col(f"_o{k}")), 1).otherwise(0) for k in range(1, LEVELS + 1)), F.lit(0))
    return rows.withColumn("depth", depth).drop(*(f"_{x}{k}" for x in "oc" for k in range(1, LEVELS + 1)))


def files(headers: DataFrame, level: int) -> DataFrame:
    """Adds file: a header starts a file if its own level, or its parent's, is below the given one, or it has no parent."""
    rows = tree(headers)
    parents = rows.select(F.col("doc_id"), F.col("seq").alias("parent"), F.col("level").alias("parent_level"))
    rows = rows.join(parents, ["doc_id", "parent"], "left")
    starts = (F.col("level") < level) | F.col("parent").isNull() | (F.col("parent_level") < level)
    return rows.withColumn("file", F.sum(starts.cast("int")).over(ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def anchor_files(anchored: DataFrame) -> DataFrame:
    """doc_id, anchor, file: of several files that hold an anchor the first."""
    return anchored.groupBy("doc_id", "anchor").agg(F.min("file").alias("file"))


def region_runs(sections: DataFrame) -> DataFrame:
    """Adds run: front while it lasts, then main while it lasts, then back whatever comes."""
    rank = F.coalesce(*(F.when(F.col("region") == k, v) for k, v in RANKS.items()))
    highest = F.max(rank).over(ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sections.withColumn("run", F.element_at(F.array(*map(F.lit, RANKS)), highest + 1))


def notes_section(notes: DataFrame) -> DataFrame:
    """notes (doc_id, seq, chapter, n, body) by chapter, in order; of notes with one number the last stays."""
    last = notes.groupBy("doc_id", "chapter", "n").agg(F.max_by("body", "seq").alias("body"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), " | ")
    return last.groupBy("doc_id", "chapter").agg(texts.alias("notes"), F.count(F.lit(1)).alias("n_notes"))


def appended(sections: DataFrame, extra: DataFrame) -> DataFrame:
    """extra sections (doc_id, place, title) after the last ones, numbered as unnumbered headers on from those there are."""
    base = sections.groupBy("doc_id").agg(F.max("seq").alias("last"), F.sum(F.col("starred").cast("int")).alias("phantoms"))
    rows = extra.join(base, "doc_id", "left")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    return rows.select("doc_id", (F.coalesce("last", F.lit(0)) + n).alias("seq"), "title", F.concat(F.lit("sec-back-unnumbered-"), (F.coalesce("phantoms", F.lit(0)) + n).cast("string")).alias("anchor"))


def rendered(fragments: DataFrame) -> DataFrame:
    """fragments (doc_id, pos, text) joined in order."""
    return fragments.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("rendered"))
