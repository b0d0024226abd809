"""Document quality from a linear-chain conditional random field over lines.

Each non-blank line is labelled good or bad from its own features and those of its neighbours, with weights for transitions between
labels. Training takes labelled documents of any length in the order of hashes of their ids, at most SAMPLE of them and, after the first, none that
brings their lines above LINES together; longer ones are cut into chains of CHAIN lines, all of which count; a line starts with its document's label, and in a second pass lines of bad documents that look good on their own are relabelled, so that a clean line next
to junk doesn't blur the model. Scoring runs forward-backward over all lines of every text; the length-weighted mean of the good
marginals, put through a fitted logistic curve, is the document's quality.

The recursion runs over many documents at once: they are ordered by their number of lines, and step t handles line t of all that have
one. Nothing is padded, so one very long text doesn't enlarge the others.

Defined results: null, empty and blank texts have no lines and get the share of good documents among the training labels (0.5 without
any); texts of any length are read whole; without labels of both kinds every text gets that share; equal texts get equal scores; a null doc_id is scored and not held
out unless the empty id's hash says so; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: documents, and lines of all of them together; and lines of a chain in training.
SAMPLE, LINES, CHAIN = 4_000, 400_000, 500
THRESHOLD = 0.3
_UPPER, _DIGITS, _SIGNS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>{}[]\\^~=_"
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
OWN = 11


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x OWN) and byte lengths of the lines that hold a word."""
    rows, sizes, seen = [], [], set()
    for line in text.encode().split(b"\n"):
        w = line.split()
        if not w:
            continue
        n, k = len(line), len(w)
        letters = n - len(line.translate(None, _LETTERS))
        marks = line.count(b"!")
        rows.append(
            (
                min(1.0, k / 12),
                min(1.0, k / 60),
                min(1.0, 2 * (n - len(line.translate(None, _SIGNS))) / k),
                min(1.0, 2 * marks / k),
                (n - len(line.translate(None, _UPPER))) / max(1, letters),
                min(1.0, 2 * sum(map(eq, w, w[1:])) / k),
                1.0 - len(set(w)) / k if k > 4 else 0.0,
                1.0 - letters / (n - k + 1) if n >= k else 0.0,
                min(1.0, (n - len(line.translate(None, _DIGITS))) / n * 4),
                float(line in seen),
                min(1.0, n / k / 16),
            )
        )
        sizes.append(n)
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, OWN), np.array(sizes, dtype=np.float64)


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Columns of the line, the one before, the one after (0 beyond the ends), and 1."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    if n:
        before[1:], after[:-1] = x[:-1], x[1:]
        ends = np.cumsum(counts[counts > 0])
        before[np.concatenate([[0], ends[:-1]])] = 0
        after[ends - 1] = 0
    return np.hstack([x, before, after, np.ones((n, 1))])


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=-1, keepdims=True)))[..., 0]


def forward_backward(emission: np.ndarray, transition: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals of both labels for each line, and the summed pairwise marginals; counts are lines of each document."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, sizes = starts[order], counts[order]
    alpha, beta = emission.copy(), np.zeros_like(emission)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents with more than t lines
    for t in range(1, longest):
        at = starts[: live[t]] + t
        alpha[at] += _log_sum(alpha[at - 1][:, None, :] + transition.T[None])
    for t in range(longest - 1, 0, -1):
        at = starts[: live[t]] + t
        beta[at - 1] = _log_sum((emission[at] + beta[at])[:, None, :] + transition[None])
    total = alpha + beta
    norm = _log_sum(total) if len(total) else np.zeros(0)
    inner = np.ones(len(emission), dtype=bool)
    inner[starts[sizes > 0]] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(alpha[at - 1][:, :, None] + transition[None] + (emission[at] + beta[at])[:, None, :] - norm[at][:, None, None])
    return total - norm[:, None], pairs.sum(axis=0)


@dataclass
class LineCrf:
    weights: np.ndarray  # of the label good against bad
    transition: np.ndarray
    curve: tuple[float, float]
    prior: float

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability that each line is good."""
        emission = np.zeros((len(x), 2))
        emission[:, 1] = with_neighbours(x, counts) @ self.weights
        return np.exp(forward_backward(emission, self.transition, counts)[0][:, 1])

    def share(self, x: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Length-weighted good share of each document; NaN without lines."""
        good, owner = self.marginals(x, counts), np.repeat(np.arange(len(counts)), counts)
        with np.errstate(invalid="ignore"):
            return np.bincount(owner, good * sizes, len(counts)) / np.bincount(owner, sizes, len(counts))

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        parts = [line_features(t) for t in texts]
        counts = np.array([len(s) for _, s in parts])
        share = self.share(np.vstack([x for x, _ in parts]), np.concatenate([s for _, s in parts]), counts)
        a, b = self.curve
        return np.where(counts > 0, _sigmoid(a * _logit(np.nan_to_num(share, nan=0.5)) + b), self.prior)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.002, 0.998)
    return np.log(p / (1 - p))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(x: np.ndarray, sizes: np.ndarray, counts: np.ndarray, quality: np.ndarray, steps: int = 120) -> LineCrf:
    """Fits by conditional likelihood; documents of the two kinds weigh alike."""
    prior = float(quality.mean()) if len(quality) else 0.5
    width = 3 * OWN + 1
    if not len(x) or quality.min() == quality.max():
        return LineCrf(np.zeros(width), np.zeros((2, 2)), (0.0, float(_logit(np.array(prior)))), prior)
    full, owner = with_neighbours(x, counts), np.repeat(np.arange(len(counts)), counts)
    y = quality[owner].astype(np.int64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    own = np.hstack([x, np.ones((len(x), 1))])

    def alone(w):
        return own.T @ (weight * (_sigmoid(own @ w) - y)) + 1e-4 * w

    looks = _sigmoid(own @ _adam(alone, np.zeros(OWN + 1), 300, 0.1))
    # what looks good by itself in a bad document counts as good, but its worst line stays bad
    worst = np.full(len(counts), 2.0)
    np.minimum.at(worst, owner, looks)
    y = np.where((y == 0) & (looks > 0.8) & (looks > worst[owner]), 1, y)
    first = np.zeros(len(x), dtype=bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    at = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)

    def chained(w):
        emission = np.zeros((len(x), 2))
        emission[:, 1] = full @ w[:width]
        marginal, pairs = forward_backward(emission, w[width:].reshape(2, 2), counts)
        return np.concatenate([full.T @ (np.exp(marginal[:, 1]) - y), (pairs - seen).ravel()]) / len(x) + 1e-4 * w

    w = _adam(chained, np.zeros(width + 4), steps, 0.15)
    out = LineCrf(w[:width], w[width:].reshape(2, 2), (1.0, 0.0), prior)
    has = counts > 0
    z = np.stack([_logit(out.share(x, sizes, counts)[has]), np.ones(has.sum())], axis=1)
    goal = quality[has]
    curve = _adam(lambda c: z.T @ (_sigmoid(z @ c) - goal) / len(goal) + 1e-3 * c, np.array([1.0, 0.0]), 300, 0.05)
    out.curve = (float(max(curve[0], 0.05)), float(curve[1]))
    return out


def _lines(batches):
    """Each text's number of lines, and features and sizes of its lines as packed numbers."""
    for batch in batches:
        made = [line_features(text) for text in common.texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(s) for _, s in made], pa.int64()), *(pa.array([m[k].astype(np.float32).tobytes() for m in made], pa.binary()) for k in (0, 1))],
            names=["doc_id", "quality", "n", "x", "sizes"],
        )


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, held: int = 0, of: int = 5) -> LineCrf:
    """Learns from labelled rows whose crc32 remainder is not held."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (common.remainder(F.col("doc_id"), of) != held)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = common.written(rows.mapInArrow(_lines, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, n bigint, x binary, sizes binary"), "lines")
    # rows that share a doc_id may be more than the sample: they follow in the order of their features
    order = rows.select("doc_id", "n", F.xxhash64("doc_id").alias("h"), F.xxhash64("x", "sizes").alias("own")).orderBy("h", "doc_id", "own").limit(sample)
    w = Window.orderBy("h", "doc_id", "own")
    order = order.select("doc_id", "own", F.row_number().over(w).alias("place"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("all")).filter((F.col("place") == 1) | (F.col("all") <= lines))
    table = rows.withColumn("own", F.xxhash64("x", "sizes")).join(F.broadcast(order.select("doc_id", "own").distinct()), ["doc_id", "own"], "left_semi").select("doc_id", "own", "quality", "x", "sizes").toPandas().sort_values(["doc_id", "own"], kind="stable").head(sample)
    common.removed(rows)
    x, sizes = (np.frombuffer(b"".join(table[c]), np.float32).astype(np.float64) for c in ("x", "sizes"))
    counts = np.array([len(s) // 4 for s in table["sizes"]], dtype=np.int64)
    chains = [[CHAIN] * (n // CHAIN) + ([n % CHAIN] if n % CHAIN or not n else []) for n in counts.tolist()]
    quality = np.repeat(table["quality"].to_numpy().astype(float), [len(c) for c in chains])
    return train(x.reshape(-1, OWN), sizes, np.array([n for c in chains for n in c], dtype=np.int64), quality)


#: Texts that are scored at once.
SLICE = 512


def _scored(model: LineCrf):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(common.texts(batch)), pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: LineCrf) -> DataFrame:
    """doc_id and score of every text."""
    return docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def kept(docs: DataFrame, model: LineCrf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that reach the threshold, with all their columns."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                yield batch.filter(pa.array(model.score(common.texts(batch)) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    rows = scored(docs, fitted(docs, common.labels(spark, sf_dir)))
    return rows.select("doc_id", (common.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
