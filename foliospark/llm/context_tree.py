"""Language-model scores by context-tree weighting over bytes.

A text is scored as its sequence of words, A-Z lower-cased: the words joined by single spaces and an end byte that UTF-8 never uses, so what kind
of blanks separates two words, and how many, is not part of what is scored. Each byte is eight binary decisions. For every decision and
every context of 0 to DEPTH preceding bytes the training texts give two counts, and Krichevsky-Trofimov estimates P_e. The weighted
probability of a context is P_w = P_e / 2 + (product of P_w over its one byte longer contexts) / 2, so all pruned trees up to DEPTH are
mixed; the share of P_e in P_w is the posterior weight of stopping there, and prediction mixes the contexts' estimates with those weights,
from the longest to the empty one. The code length is the negative log2.

Scale. Tasks cut their texts into blocks of some BLOCK bytes. A block lists its distinct words and its distinct byte runs (DEPTH bytes and the
next) with their training counts. The lists are dealt into groups: words by a hash, runs by their ROOT bytes before the last one, so that a
group holds whole subtrees of contexts of ROOT bytes and more, and computes them in numpy. What their roots weigh goes up into the top of the tree,
three levels in SQL whose size is bounded by the alphabet; what the top leaves to each root comes down again, and each list returns to its
block with a probability for each run. So each list crosses twice, sorted and packed to some bytes a run, texts cross once, and no model of the
whole corpus is ever broadcast or gathered. All counts cover all training texts. Groups grow in number with the input's partitions.

Defined results: null and empty texts are the end alone; a null doc_id goes by the remainder of the empty id; repeated rows count and are scored
each; texts of any length are scored whole, in stretches that overlap by their contexts; extra columns don't matter; an empty table gives an
empty result; without training rows the base is uniform. Equal texts have equal scores, so ties need no order.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH, ROOT, BLOCK, END = 6, 3, 30_000_000, b"\xff"
#: Bytes of texts whose runs are in hand at once.
STRETCH = 500_000


# ---- texts and lists ----------------------------------------------------------------------------------------------------------


def serialised(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def runs(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each text the number that its depth preceding bytes and itself form; before a text stand end bytes."""
    return np.concatenate([r for r, _ in stretches(texts, depth)]) if texts else np.zeros(0, dtype=np.int64)


def stretches(texts: list[bytes], depth: int, most: int = STRETCH) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Runs of about most bytes at a time, and whose they are: (text's place, bytes). A long text is cut; each part keeps its context."""
    held: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), most):
            part = t[at : at + most]
            held += [t[at - depth : at] if at >= depth else END * (depth - at) + t[:at], part]
            owners.append((i, len(part)))
            size += len(part)
            if size >= most:
                yield _runs(held, owners, depth), owners
                held, owners, size = [], [], 0
    if owners:
        yield _runs(held, owners, depth), owners


def _runs(held: list[bytes], owners: list[tuple[int, int]], depth: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(held), np.uint8).astype(np.int64)
    out = np.zeros(len(raw) - depth, dtype=np.int64)
    for i in range(depth + 1):
        out = (out << 8) | raw[i : len(raw) - depth + i]
    sizes = np.fromiter((n for _, n in owners), np.int64, len(owners))
    keep = np.ones(len(out), dtype=bool)
    seams = np.cumsum(sizes + depth)[:-1] - depth
    for k in range(depth):  # windows that end inside the next part's context
        keep[seams + k] = False
    return out[keep]


def _planes(x: np.ndarray) -> bytes:
    """Numbers packed: equal bytes of neighbours side by side, compressed."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 3)


def _numbers(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(rows: list[tuple[bytes, bool, bytes]]) -> bytes:
    return zstandard.compress(b"".join(x for k, h, t in rows for x in (struct.pack("<iBq", len(k), h, len(t)), k, t)), 3)


def _unpack(blob: bytes) -> Iterator[tuple[bytes, bool, bytes]]:
    raw, at = zstandard.decompress(blob), 0
    while at < len(raw):
        a, h, n = struct.unpack_from("<iBq", raw, at)
        at += 13
        yield raw[at : at + a], bool(h), raw[at + a : at + a + n]
        at += a + n


def _group(runs_: np.ndarray, root: int, groups: int) -> np.ndarray:
    ctx = ((runs_ >> 8) & ((1 << (8 * root)) - 1)).astype(np.uint64)
    return (((ctx * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(groups)).astype(np.int16)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k).astype(np.int32 if len(k) < 1 << 31 else np.int64)
    k, n = k[order], n[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[start], np.add.reduceat(n, start) if len(k) else n


_LISTS = "block bigint, part int, runs binary, counts binary, words binary, word_counts binary, texts binary"


def _counted(depth: int, root: int, size: int, groups: int):
    """Rows of each block: one for each group with its runs and words and their training counts, and one with its texts."""

    def table(block: int, rows: list[tuple[bytes, bool, bytes]]):
        words: Counter = Counter()
        other: set[bytes] = set()
        sums: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))]
        for held in (False, True):
            texts = [t for _, h, t in rows if h is held]
            for t in texts:
                w = t[:-1].split()
                if held:
                    other.update(w)
                else:
                    words.update(w)
            words[END] += 0 if held else len(texts)
            for r, _ in stretches(texts, depth):
                k, n = np.unique(r, return_counts=True)
                sums.append((k, (n * (not held)).astype(np.int32)))
                while len(sums) > 1 and 2 * len(sums[-1][0]) >= len(sums[-2][0]):  # neighbours of like size are merged
                    one, two = sums.pop(), sums.pop()
                    sums.append(_summed([two[0], one[0]], [two[1], one[1]]))
                    del one, two
        for w in other:
            words.setdefault(w, 0)
        while len(sums) > 1:
            one, two = sums.pop(), sums.pop()
            sums.append(_summed([two[0], one[0]], [two[1], one[1]]))
            del one, two
        keys, counts = sums.pop()
        group = _group(keys, root, groups)
        order = np.argsort(group, kind="stable").astype(np.int32)
        cut = np.searchsorted(group[order], np.arange(groups + 1))
        del group
        lists: list[list[bytes]] = [[] for _ in range(groups)]
        for w in words:
            lists[zlib.crc32(w) % groups].append(w)
        out = []
        for g in range(groups):
            mine = order[cut[g] : cut[g + 1]]
            if len(mine) or lists[g]:
                k = keys[mine]
                n = np.fromiter(map(words.__getitem__, lists[g]), np.int64, len(lists[g]))
                out.append((block, g, _planes(np.diff(k, prepend=0)), _planes(counts[mine].astype(np.int64)), zstandard.compress(b"\n".join(lists[g]), 3), _planes(n), None))
        out.append((block, -1, None, None, None, None, _pack(rows)))
        types = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "part", "runs", "counts", "words", "word_counts", "texts"])

    def run(batches):
        first, made, rows, bytes_ = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            keys, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, h, text in zip(keys, held, common.texts(batch), strict=True):
                t = serialised(text.encode().lower().split())
                rows.append((b"" if key is None else str(key).encode(), h, t))
                bytes_ += len(t)
                if bytes_ >= size:
                    yield table(first + made, rows)
                    made, rows, bytes_ = made + 1, [], 0
        if rows:
            yield table(first + made, rows)

    return run


# ---- estimates ----------------------------------------------------------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps up; good to ten digits for x >= 0.5."""
    y = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(product)


def log_estimate(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


@lru_cache(1)
def _small(n: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """ln gamma(k + 1/2) and ln gamma(k + 1) of small k."""
    return np.array([math.lgamma(k + 0.5) for k in range(n)]), np.array([math.lgamma(k + 1) for k in range(n)])


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log_estimate of arrays of counts."""

    def gamma(k: np.ndarray, plus: float, known: np.ndarray) -> np.ndarray:
        y = k + (plus + 8.0)
        big = k >= len(known)
        out = known[np.where(big, 0, k)]
        if big.any():
            y = y[big] - 8.0
            out[big] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
        return out

    half, whole = _small()
    return gamma(a, 0.5, half) + gamma(b, 0.5, half) - math.log(math.pi) - gamma(a + b, 1.0, whole)


class Subtrees:
    """The contexts of root to depth bytes of sorted distinct runs, as levels of (context, node) by bit."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, root: int):
        self.depth, self.root, self.keys = depth, root, keys
        self.levels: dict[int, list[dict]] = {}
        ln2 = math.log(2)
        k, n = keys, counts
        for d in range(depth, root - 1, -1):
            if d < depth:
                k, n = _summed([k & ((1 << (8 * (d + 1))) - 1)], [n])
            level = []
            for bit in range(8):
                prefix = k >> (8 - bit)  # context and the symbol's first bits: what the decision is made after
                start = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
                one = (k >> (7 - bit)) & 1
                b = np.add.reduceat(n * one, start) if len(k) else n
                a = (np.add.reduceat(n, start) if len(k) else n) - b
                level.append({"prefix": prefix[start], "a": a, "b": b, "lw": estimates(a, b)})
            self.levels[d] = level
        for d in range(depth, root - 1, -1):
            for bit in range(8):
                x = self.levels[d][bit]
                if d == depth:
                    x["stop"] = np.ones(len(x["a"]))
                else:
                    own, below = x["lw"] - ln2, x.pop("below") - ln2
                    x["lw"] = np.logaddexp(own, below)
                    x["stop"] = np.exp(own - x["lw"])
                if d > root:
                    up = self.levels[d - 1][bit]
                    x["up"] = np.searchsorted(up["prefix"], x["prefix"] & ((1 << (8 * (d - 1) + bit)) - 1))
                    up["below"] = np.bincount(x["up"], x["lw"], len(up["prefix"]))

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """context << 8 | node, a, b, lw of the roots."""
        level = self.levels[self.root]
        names = [((x["prefix"] >> bit) << 8) | (1 << bit) | (x["prefix"] & ((1 << bit) - 1)) for bit, x in enumerate(level)]
        return (np.concatenate(names), *(np.concatenate([x[c] for x in level]) for c in ("a", "b", "lw")))

    def log10(self, names: np.ndarray, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """lp of every key; p, rest of the roots' names: what shorter contexts give, and what they leave."""
        order = np.argsort(names)
        names, p, rest = names[order], p[order], rest[order]
        out = np.zeros(len(self.keys))
        for bit in range(8):
            for d in range(self.root, self.depth + 1):
                x = self.levels[d][bit]
                if d == self.root:
                    at = np.searchsorted(names, ((x["prefix"] >> bit) << 8) | (1 << bit) | (x["prefix"] & ((1 << bit) - 1)))
                    before, left = p[at], rest[at]
                else:
                    before, left = now[x["up"]], over[x["up"]]  # noqa: F821
                now = before + left * x["stop"] * (x["b"] + 0.5) / (x["a"] + x["b"] + 1)
                over = left * (1 - x["stop"])
            prefix = self.keys >> (8 - bit)
            mine = now[np.cumsum(np.append(False, prefix[1:] != prefix[:-1]))] if len(prefix) else now
            out += np.log10(np.where((self.keys >> (7 - bit)) & 1 == 1, mine, 1 - mine))
        return out


# ---- groups -------------------------------------------------------------------------------------------------------------------


def _merged(lists: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    each = [np.cumsum(_numbers(r, np.int64)) for r in lists.column("runs").to_pylist()]
    keys, counts = _summed([np.zeros(0, dtype=np.int64), *each], [np.zeros(0, dtype=np.int64), *(_numbers(n, np.int64) for n in lists.column("counts").to_pylist())])
    return each, keys, counts


def _words(lists: pa.Table) -> tuple[list[list[bytes]], Counter]:
    each, total = [zstandard.decompress(w).split(b"\n") if len(n) else [] for w, n in zip(lists.column("words").to_pylist(), map(lambda x: _numbers(x, np.int64), lists.column("word_counts").to_pylist()), strict=True)], Counter()
    for ws, n in zip(each, lists.column("word_counts").to_pylist(), strict=True):
        for w, c in zip(ws, _numbers(n, np.int64).tolist(), strict=True):
            total[w] += c
    return each, total


_UP = "part int, name bigint, a bigint, b bigint, lw double, tokens bigint, words bigint"


def _up(depth: int, root: int):
    """A group's roots, and in one more row how many training tokens and words it has."""

    def run(key: tuple, lists: pa.Table) -> pa.Table:
        _, keys, counts = _merged(lists)
        names, a, b, lw = Subtrees(keys, counts, depth, root).roots()
        words = _words(lists)[1]
        n = len(names)
        none = pa.nulls(1, pa.int64())
        rows = [pa.array([key[0].as_py()] * (n + 1), pa.int32())]
        rows += [pa.concat_arrays([pa.array(x, pa.int64()), none]) for x in (names, a, b)]
        rows += [pa.concat_arrays([pa.array(lw, pa.float64()), pa.nulls(1, pa.float64())])]
        rows += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([v], pa.int64())]) for v in (sum(words.values()), sum(c > 0 for c in words.values()))]
        return pa.table(rows, names=["part", "name", "a", "b", "lw", "tokens", "words"])

    return run


def _down(depth: int, root: int):
    """Each list of a group with the probabilities of its runs and the counts of its words."""

    def run(key: tuple, lists: pa.Table, top: pa.Table) -> pa.Table:
        each, keys, counts = _merged(lists)
        lp = Subtrees(keys, counts, depth, root).log10(*(top.column(c).to_numpy() for c in ("name", "p", "rest"))).astype(np.float32)
        ws, total = _words(lists)
        made = [_planes(lp[np.searchsorted(keys, r)]) for r in each]
        counted = [_planes(np.fromiter(map(total.__getitem__, w), np.int64, len(w))) for w in ws]
        return pa.table([lists.column("block"), lists.column("runs"), pa.array(made, pa.binary()), lists.column("words"), pa.array(counted, pa.binary()), pa.nulls(len(made), pa.binary())], names=["block", "runs", "lp", "words", "word_counts", "texts"])

    return run


def top(roots: DataFrame, root: int) -> DataFrame:
    """name, p, rest: for each decision after each root's context, what all shorter contexts give to a one, and what they leave. roots: name, a, b, lw."""
    half = math.log(0.5)
    level = roots.select(F.shiftright("name", 8).alias("context"), F.col("name").bitwiseAND(F.lit(255)).alias("node"), "a", "b", "lw")
    levels = []
    for d in range(root - 1, -1, -1):
        upper = F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        level = level.groupBy(upper.alias("context"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("children"))
        level = level.withColumn("le", log_estimate(F.col("a").cast("double"), F.col("b").cast("double"))).withColumn("lw", _log_add(F.col("le") + half, F.col("children") + half)).withColumn("stop", F.exp(F.col("le") + half - F.col("lw"))).select("context", "node", "a", "b", "lw", "stop")
        level = common.written(level, "level")
        levels.append(level)
    mixed = None
    for d in range(root):
        estimate = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
        rows = levels[root - 1 - d]
        if d == 0:
            mixed = rows.select("context", "node", (F.col("stop") * estimate).alias("p"), (1 - F.col("stop")).alias("rest"))
        else:
            upper = F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1))
            below = mixed.select(F.col("context").alias("upper"), "node", F.col("p").alias("p0"), F.col("rest").alias("rest0"))
            mixed = rows.withColumn("upper", upper).join(below, ["upper", "node"]).select("context", "node", (F.col("p0") + F.col("rest0") * F.col("stop") * estimate).alias("p"), (F.col("rest0") * (1 - F.col("stop"))).alias("rest"))
    upper = F.shiftright("name", 8).bitwiseAND(F.lit((1 << (8 * (root - 1))) - 1))
    rows = roots.withColumn("context", upper).withColumn("node", F.col("name").bitwiseAND(F.lit(255)))
    return rows.join(mixed, ["context", "node"]).select(*(c for c in roots.columns if c not in ("a", "b", "lw")), "p", "rest")


# ---- scores -------------------------------------------------------------------------------------------------------------------

_SCORES = "key string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"


def _scored(depth: int, total: int, distinct: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bottom = total + 0.5 * (distinct + 1)
        place: dict[bytes, int] = {}
        keys, values, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)], [np.zeros(0, dtype=np.int64)]
        blob = None
        for r, lp, w, n, texts in zip(*(rows.column(c).to_pylist() for c in ("runs", "lp", "words", "word_counts", "texts")), strict=True):
            if texts is not None:
                blob = texts
                continue
            keys.append(np.cumsum(_numbers(r, np.int64))), values.append(_numbers(lp, np.float32))
            counts.append(_numbers(n, np.int64))
            if len(counts[-1]):
                place.update(zip(zstandard.decompress(w).split(b"\n"), range(len(place), len(place) + len(counts[-1])), strict=True))
        keys_, values_ = np.concatenate(keys), np.concatenate(values)
        keys.clear(), values.clear()
        order = np.argsort(keys_).astype(np.int32)
        keys_, values_ = keys_[order], values_[order]
        del order
        counts_ = np.concatenate(counts)
        logs = np.log10((counts_ + 0.5) / bottom)
        docs = list(_unpack(blob))
        scores = [0.0] * len(docs)
        for r, owners in stretches([t for _, _, t in docs], depth):
            distinct_, back = np.unique(r, return_inverse=True)
            lp = values_[np.searchsorted(keys_, distinct_)].astype(np.float64)[back]
            sizes = np.fromiter((n for _, n in owners), np.int64, len(owners))
            for (i, _), s in zip(owners, np.add.reduceat(lp, np.cumsum(sizes) - sizes).tolist(), strict=True):
                scores[i] += s
        out = []
        for (k, h, t), s in zip(docs, scores, strict=True):
            w = [*t[:-1].split(), END]
            at = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
            out.append((k.decode() or None, h, len(w), int((counts_[at] > 0).sum()), total, float(logs[at].sum()), s, len(t)))
        types = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    return run


def scored(docs: DataFrame, depth: int = DEPTH, held: int = 1, of: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte; learned from rows whose crc32 remainder is not held."""
    kind, root = docs.schema["doc_id"].dataType, min(ROOT, depth)
    rows = docs.select("doc_id", (common.remainder(F.col("doc_id"), of) == held).alias("held_out"), "text")
    groups = min(4096, max(16, 2 * rows.rdd.getNumPartitions()))
    parts = common.written(rows.mapInArrow(_counted(depth, root, block, groups), _LISTS), "lists")
    lists = parts.filter("part >= 0").select("block", "part", "runs", "counts", "words", "word_counts")
    ups = common.written(lists.groupBy("part").applyInArrow(_up(depth, root), _UP), "roots")
    sums = ups.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("words"), F.lit(0)).alias("distinct")).first()
    tops = top(ups.filter("name IS NOT NULL").select("part", "name", "a", "b", "lw"), root)
    made = lists.groupBy("part").cogroup(tops.groupBy("part")).applyInArrow(_down(depth, root), "block bigint, runs binary, lp binary, words binary, word_counts binary, texts binary")
    texts = parts.filter("part < 0").select("block", *(F.lit(None).cast("binary").alias(c) for c in ("runs", "lp", "words", "word_counts")), "texts")
    out = made.unionByName(texts).groupBy("block").applyInArrow(_scored(depth, int(sums["total"]), int(sums["distinct"])), _SCORES)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return out.select(F.col("key").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.documents(spark, sf_dir))
