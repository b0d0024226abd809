"""Tables of distinct keys over slices of a corpus, and the way back to the places where the keys stand.

A task numbers the distinct keys of a slice of its rows, and every document becomes the numbers of its keys in order. Where keys need the whole corpus, a
slice becomes one row (its keys, its documents): so what is shuffled is each key once for a slice and never once for a place, and no key has
more rows than there are slices.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and the texts of each slice, which ends after that many characters; a text that is longer is a slice by itself."""
    for batch in batches:
        ids, texts = batch.column(0), common.texts(batch)
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= most or i + 1 == len(texts):
                yield ids.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def uids() -> Iterator[int]:
    """Numbers that no other task of the stage gives, the same ones whenever a task runs again."""
    return count(TaskContext.get().partitionId() << 33)


class Numbers(defaultdict):
    """Numbers new keys from 0 on."""

    def __init__(self):
        super().__init__(count().__next__)

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int32, len(keys))


def lists(parts: list[np.ndarray], type_: pa.DataType = pa.int32()) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int32)]), type_))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, side by side."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def packed(*parts: np.ndarray) -> bytes:
    """Arrays of numbers below 2**31 as few bytes: the four bytes of the numbers apart, compressed."""
    planes = b"".join(np.ascontiguousarray(p, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts)
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    many = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", many, 8)
    planes = np.frombuffer(pa.decompress(blob[8 * (many + 1) :], int(4 * sizes.sum()), codec="zstd", asbytes=True), np.uint8)
    cuts = np.concatenate([[0], np.cumsum(4 * sizes)])
    return [np.ascontiguousarray(planes[i:j].reshape(4, -1).T).view("<i4").ravel() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def one(values: pa.Array) -> pa.ListArray:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def unfolded(batch: pa.RecordBatch, name: str, i: int) -> list[pa.Array]:
    """The fields of an array of structs in row i of a batch."""
    return batch.column(batch.schema.get_field_index(name)).slice(i, 1).flatten().flatten()


def brought_back(coded: DataFrame, table: DataFrame) -> DataFrame:
    """coded (uid, keys, ...) with found: what table (key, ...) has for each key, and the key's slot. Both sides have a key once for a slice at most."""
    wanted = coded.select("uid", F.posexplode("keys").alias("slot", "key")).join(table, "key")
    found = wanted.groupBy("uid").agg(F.collect_list(F.struct("slot", *(c for c in table.columns if c != "key"))).alias("found"))
    return coded.drop("keys").join(found, "uid", "left")
