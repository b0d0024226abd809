"""Exact duplicates by content-defined chunk recipes.

A text (A-Z lower-cased) is cut where a hash of the last eight bytes has its top bits clear, so equal stretches are cut
alike wherever they stand. Each chunk moves once per task, under its digest, and all contents that share a digest are compared
byte by byte: a digest that has one content only is a *verified identifier*. Documents are then compared by their
ordered lists of identifiers, 16 bytes for some 4,000 of text; the texts themselves are not moved again. Documents with a chunk
whose digest turned out to stand for two contents (never seen; a 128-bit collision) are compared by whole texts instead.

Defined results: null text counts as empty, and all empty texts are equal; a null doc_id is smaller than any other; of rows
that share text and doc_id one stays; extra columns don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHORTEST, LONGEST, BITS = 1 << 10, 1 << 16, 12
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased (bytes.lower touches ASCII only)."""
    return (text or "").encode().lower()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: content-defined, at least SHORTEST and at most LONGEST bytes apart but for the last."""
    n, ends, last = len(data), [], 0
    if n > SHORTEST:
        words = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=data, strides=(1,))
        for at in (np.flatnonzero((words * _MULTIPLIER) >> np.uint64(64 - BITS) == 0) + 8).tolist():
            while at - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if at - last >= SHORTEST and at < n:
                ends.append(at)
                last = at
        while n - last > LONGEST:
            last += LONGEST
            ends.append(last)
    return [*ends, n]


def chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in cuts(data):
        out.append(data[start:end])
        start = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def _recipes(batches):
    for batch in batches:
        ids, shas, lists = batch.column(0), [], []
        for text in common.texts(batch):
            data = normalised(text)
            shas.append(hashlib.sha256(data).hexdigest())
            lists.append([digest(c) for c in chunks(data)])
        yield pa.RecordBatch.from_arrays([ids, pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "text_sha256", "recipe"])


#: Digests that a task remembers so as not to send a chunk twice; beyond it, chunks may be sent again, which is harmless.
REMEMBERED = 200_000


def _contents(batches):
    seen: set[tuple[bytes, int]] = set()
    for batch in batches:
        keys, bodies, held = [], [], 0
        for text in common.texts(batch):
            for c in chunks(normalised(text)):
                # Python's own hash of the bytes beside the digest: a local repeat is skipped only when both agree
                if (mark := (key := digest(c), hash(c))) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(mark)
                    keys.append(key)
                    bodies.append(c)
                    held += len(c)
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["chunk", "content"])
                        keys, bodies, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["chunk", "content"])


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, recipe (the ordered digests of the chunks)."""
    return docs.select("doc_id", "text").mapInArrow(_recipes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_sha256 string, recipe array<binary>")


def ambiguous(docs: DataFrame) -> DataFrame:
    """Digests that stand for more than one content; every other digest is a verified identifier."""
    bodies = docs.select("text").mapInArrow(_contents, "chunk binary, content binary")
    spread = bodies.groupBy("chunk").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    return spread.filter(F.col("low") != F.col("high")).select("chunk")


def groups(docs: DataFrame, verify: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = common.written(recipes(docs).withColumn("_row", F.monotonically_increasing_id()), "recipes")
    key = F.struct("recipe", F.lit("").alias("whole"))
    if verify and (bad := common.written(ambiguous(docs), "ambiguous")).head(1):
        # identifiers that failed: the documents that hold one are compared by their whole texts
        odd = rows.select("doc_id", "text_sha256", F.explode("recipe").alias("chunk")).join(bad, "chunk", "left_semi").select("doc_id", "text_sha256").distinct()
        text = docs.select("doc_id", common.lower_ascii(F.coalesce("text", F.lit(""))).alias("whole"))
        text = text.withColumn("text_sha256", F.sha2(F.col("whole").cast("binary"), 256)).join(odd, ["doc_id", "text_sha256"], "left_semi").distinct()
        rows = common.written(rows.join(text, ["doc_id", "text_sha256"], "left"), "recipes")
        key = F.struct("recipe", F.coalesce("whole", F.lit("")).alias("whole"))
    rows = rows.withColumn("_key", key)
    best = rows.groupBy("_key").agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    # from a table, so that both sides of the join are dealt anew and adaptive execution may split a group that holds many rows
    best = common.cleanly(best, "best")
    return rows.join(best, "_key").select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    names = docs.columns
    # the row as one struct, so that no column of its own can clash
    rows = common.written(docs.select(F.struct(*names).alias("all"), F.monotonically_increasing_id().alias("uid")), "rows")
    marks = groups(rows.select(F.struct("all.doc_id", "uid").alias("doc_id"), F.col("all.text").alias("text")))
    gone = marks.filter(~F.col("kept")).select(F.col("doc_id.uid").alias("uid"))
    return rows.join(gone, "uid", "left_anti").select("all.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.documents(spark, sf_dir))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
