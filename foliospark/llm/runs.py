"""Maximal runs of words with a period, by block matching at every scale.

A run of period q and length n (at least 2q and 12) has n - q places whose word comes again q words later. Aligned blocks of b words, b a power of two
with 2b - 1 at most max(q, 12 - q), so one lies wholly in these places and comes again at distance q. For each scale b an Aho-Corasick automaton over
sequences of word numbers holds the text's aligned blocks and is run over the text; an occurrence q words after its block, q in the scale's range, is a seed.
A seed is extended word by word to both sides. Scales go up, so shorter periods come first, and what lies in a run whose period divides q is no new run.

Places that belong to no run are left out of the search by an exact condition: each of a run's n - q places lies in six words that occur twice.

Defined results: null, empty and blank texts have no words and no runs; the collapsed text is empty then. Ties for the longest run go to the smallest
start. Repeated rows and rows without doc_id are handled one by one. Texts of any length are whole, within one task as runs may reach over all
of a text. Extra columns are dropped, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, keyed

#: Fewest words of a run.
LEAST = 12
#: Words of which two equal places are a necessary mark of a run: LEAST less the greatest period that LEAST words can show twice.
GRAM = LEAST - LEAST // 2


def recurring(w: np.ndarray) -> np.ndarray:
    """Places covered by GRAM neighbouring words that occur more than once (or share a hash, which only costs time)."""
    n = len(w) - GRAM + 1
    covered = np.zeros(len(w), bool)
    if n < 2:
        return covered
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h ^ w[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if same.any():
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(GRAM):
            covered[k : k + n] |= twice
    return covered


def scales(n: int) -> Iterator[tuple[int, int, int]]:
    """Block size and the least and greatest distance, for texts of n words."""
    half = LEAST // 2
    yield 2, half, half  # six words twice are too few for an aligned block of four
    yield 4, 1, 14
    b = 8
    while 2 * (2 * b - 1) <= n:
        yield b, 2 * b - 1, 4 * b - 2
        b *= 2


def seeds(w: np.ndarray, words: tuple[int, ...], covered: np.ndarray, b: int, low: int, high: int) -> dict[int, list[int]]:
    """For each distance the places where an aligned block stands that comes again at that distance."""
    import ahocorasick

    blocks = len(w) // b
    whole = np.flatnonzero(covered[: blocks * b].reshape(blocks, b).all(axis=1))
    out: dict[int, list[int]] = defaultdict(list)
    if not len(whole):
        return out
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    number = [-1] * blocks  # the key of each block, by its first place
    for j in whole.tolist():
        key = words[j * b : j * b + b]
        number[j] = automaton.get(key, None)
        if number[j] is None:
            automaton.add_word(key, j)
            number[j] = j
    automaton.make_automaton()
    # stretches of places that can be a block's second one
    marks = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    for start, end in zip(marks[::2].tolist(), marks[1::2].tolist(), strict=True):
        for last, name in automaton.iter(words[start:end]):
            at = start + last - b + 1
            for j in range(max(-(-(at - high) // b), 0), (at - low) // b + 1):
                if number[j] == name:
                    out[at - j * b].append(j * b)
    return out


def _reach(equal, most: int) -> int:
    """How far equal(i, n), an array for n places from i on, is true from 0 on; looks ever farther ahead."""
    at, step = 0, 16
    while at < most:
        same = equal(at, min(step, most - at))
        if not same.all():
            return at + int(np.argmin(same))
        at, step = at + len(same), step * 2
    return at


def extended(w: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch around place at whose words come again q words later; as start and end of the words with that period."""
    right = _reach(lambda i, n: w[at + i : at + i + n] == w[at + i + q : at + i + n + q], len(w) - q - at)
    left = _reach(lambda i, n: w[at - i - n : at - i][::-1] == w[at - i - n + q : at - i + q][::-1], at)
    return at - left, at + right + q


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of every run of the word numbers, by start, then period."""
    covered = recurring(w)
    found: list[tuple[int, int, int]] = []
    if not covered.any():
        return found
    words = tuple(w.tolist())
    made = [(q, b, places) for b, low, high in scales(len(w)) for q, places in seeds(w, words, covered, b, low, high).items()]
    for q, b, places in sorted(made, key=lambda x: x[0]):
        known = np.array([(s, s + n) for s, n, p in found if q % p == 0], np.int64).reshape(-1, 2)
        known = known[np.argsort(known[:, 0], kind="stable")]
        farthest = np.maximum.accumulate(known[:, 1]) if len(known) else known[:, 1]
        done = -1
        for at in sorted(places):
            k = np.searchsorted(known[:, 0], at, "right")
            if at < done or (k and farthest[k - 1] >= at + q + b):
                continue
            start, end = extended(w, at, q)
            done = end - q
            if end - start >= max(LEAST, 2 * q) and not any(s <= start and s + n >= end for s, n, p in found if q % p == 0):
                found.append((start, end - start, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def repeated(words: list, key: str) -> list:
    """A tenth of the documents, by the checksum of their id, have their words from some place on in repetition (the query's contract)."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]


def _found(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts(batch), strict=True):
                words = text.encode().split()  # of bytes: at the six white space characters of ASCII only
                if planted:
                    words = repeated(words, "" if doc_id is None else str(doc_id))
                made = runs(keyed.Numbers().of(words))
                keep = np.ones(len(words), bool)
                for start, length, period in made:
                    keep[start + period : start + length] = False
                kept = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                rows.append((doc_id, len(words), [{"start": s, "length": n, "period": p} for s, n, p in made], b" ".join(kept).decode()))
            made = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def found(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed (the words without repetitions, joined by spaces).

    With planted, a tenth of the documents are repeated first as repeated() says.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found(planted), f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(common.documents(spark, sf_dir), planted=True)
    longest = F.aggregate("runs", F.element_at("runs", 1), lambda a, x: F.when(x["length"] > a["length"], x).otherwise(a))
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, longest))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
