"""Best-fit packing of token sequences by the sum-of-squares rule.

A document's ids end with an end id; one longer than the capacity is cut into full pieces and a rest. An open sequence's gap is
its free room. Each piece goes where, after placing it, the sum over gaps of the squared number of open sequences with that gap is
smallest (a sequence that is filled has no gap and leaves the sum), so that no residual gap piles up.

Scale. Pieces are dealt by a hash into groups of about GROUP pieces, and each group is packed by one task. What a group leaves in sequences filled
below FULL is returned and packed once more, in one group just as in many; rounds take turns between falling lengths and a shuffle with the shortest
quarter last. A round that needs no fewer sequences for the rest than the one before is put aside, and after three of them in a row the best
placing so far stays. The pieces' ids are not moved, only their lengths.

Defined results: null text counts as empty and is one piece holding the end id; a text of any length is encoded whole and cut into as many pieces
as it takes; repeated rows and repeated doc_ids are packed separately, each row on its own; equal lengths keep the order of a shuffle with a fixed
seed, equal sums go to the smallest gap left; a null doc_id is kept as null; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, keyed
from .word_bpe import WordBpe

CAPACITY, END = 4096, 1
GROUP, FULL = 40_000, 0.995
#: Characters of text whose stretches are encoded together.
SLICE = 4 << 20

_encoders: dict[str, WordBpe] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary as installed beside the library, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None) -> WordBpe:
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def _cut(path: str | None, capacity: int, end: int):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        bpe = encoder(path)
        for whole in batches:
            for ids, texts in keyed.slices([whole], SLICE):
                owner, piece, start, length, crc = [], [], [], [], []
                for i, own in enumerate(bpe.encode(texts)):
                    own += tail
                    n = len(own) // 4
                    for k, a in enumerate(range(0, n, capacity)):
                        z = min(n, a + capacity)
                        owner.append(i), piece.append(k), start.append(a), length.append(z - a)
                        crc.append(zlib.crc32(own if z - a == n else own[4 * a : 4 * z]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_cut(path, capacity, end), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length (1 to capacity), placed in the order given."""
    open_ = np.zeros(capacity + 1, dtype=np.int64)  # open_[g]: sequences with gap g; 0 stands for none and never counts
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # cost of using a sequence with gap g: it leaves g for g - s
        gaps = open_[s:]
        cost = np.where(gaps > 0, 2 * (open_[: capacity + 1 - s] - gaps) + 2, np.iinfo(np.int64).max)
        if gaps[0] > 0:
            cost[0] = 1 - 2 * gaps[0]
        k = int(cost.argmin())
        fresh = 2 * open_[capacity - s] + 1 if s < capacity else 0
        if gaps[k] > 0 and cost[k] <= fresh:
            g = s + k
            b = stacks[g].pop()
            open_[g] -= 1
        else:
            g, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            open_[g - s] += 1
            stacks[g - s].append(b)
    return bins, offsets


def placing_order(lengths: np.ndarray, turn: int = 1) -> np.ndarray:
    """In even turns the longest first; in odd ones shuffled, as the rule expects of its input, but the shortest quarter last: it fills what gaps remain."""
    if turn % 2 == 0:
        return np.argsort(-lengths, kind="stable")
    shuffled = np.random.Generator(np.random.PCG64(len(lengths) + turn - 1)).permutation(len(lengths))
    short = lengths[shuffled] <= (np.quantile(lengths, 0.25) if len(lengths) else 0)
    last = shuffled[short]
    return np.concatenate([shuffled[~short], last[np.argsort(-lengths[last], kind="stable")]])


def _packed(capacity: int, turn: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", kind="stable")
        frame = frame.iloc[placing_order(frame["length"].to_numpy(), turn)]
        lengths = frame["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        # a sequence is named by the smallest row number in it: unique whatever the grouping
        names = np.full(len(used), np.iinfo(np.int64).max)
        np.minimum.at(names, bins, frame["_row"].to_numpy())
        return frame.assign(sequence_id=names[bins], offset=offsets, filled=used[bins])

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with length) plus sequence_id and offset; the lengths alone decide."""
    rows = common.written(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    todo, settled, best, open_count, turn, idle = rows.select("_row", "length"), [], None, None, 0, 0
    while True:
        count = max(1, -(-todo.count() // GROUP))
        dealt = todo.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(count)))
        done = common.written(dealt.groupBy("_group").applyInPandas(_packed(capacity, turn), "_row bigint, length bigint, _group bigint, sequence_id bigint, offset bigint, filled bigint"), "packed")
        full = F.col("filled") >= FULL * capacity
        used, left = done.filter("offset = 0").agg(F.count(F.lit(1)), F.count(F.when(~full, 1))).first()
        turn += 1
        if best is not None and used >= open_count:
            idle += 1
            if idle == 3:
                break
            continue
        # what is full stays; best places what is left
        settled.append(done.filter(full))
        best, open_count, idle, todo = done.filter(~full), left, 0, done.filter(~full).select("_row", "length")
        if not left:
            break
    places = best
    for more in settled:
        places = places.union(more)
    return rows.join(places.select("_row", "sequence_id", "offset"), "_row").drop("_row")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, capacity), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))
