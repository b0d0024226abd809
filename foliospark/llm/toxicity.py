"""Toxicity by a lexicon trie that is intersected with Levenshtein automata, weighed by context windows.

Lexicon. From at most SAMPLE labelled documents (smallest hashes of their ids): words, and word beginnings with several
continuations, that occur in toxic documents and hardly ever in others. Terms live in one trie. The automaton that accepts every string
within a few edits of a term (none below five letters, one from five, two from ten) is run on the trie: a state is a set of (trie node, edits)
pairs, made deterministic as texts demand it, so a word costs one table step per letter whatever the lexicon's size. A misspelling
counts only if clean training documents don't use it as a word of its own.

Context. Each hit is weighed by its window of WINDOW words to either side: whether it stands between quotation marks, near a verb of reporting or a
mention ("the word ...") as well, or next to a word of address. The three factors are learned: of a grid, coordinate by coordinate, those
are taken with which the logistic curve fits the sample best; where the sample doesn't tell, quotation and reporting halve a hit and address adds
a fifth. The document's strongest hit, the sum and the density of its hits go into that curve.

Defined results: null and empty texts and texts without hits get the score of a text without hits; without labels of both kinds the lexicon is
empty and every score is the share of toxic labels (0 without labels); equal texts get equal scores; extra columns don't
matter; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .line_crf import _adam, _sigmoid

SAMPLE, WINDOW, THRESHOLD = 12_000, 8, 0.7
#: Factors of hits in quotation, of reported ones and of addressed ones: where learning starts, and what it tries.
FACTORS, TRIED = (0.5, 0.5, 1.2), ((0.5, 1.0, 0.7, 0.3, 0.1), (0.5, 1.0, 0.7, 0.3, 0.1), (1.2, 1.0, 1.5, 2.0))
#: Words that a worker remembers, and automaton states; when full, they are built anew.
REMEMBERED, STATES = 500_000, 50_000
_TOKEN = re.compile(r"[\w@$]+")
#: Fixed word lists of the context scores.
_OPEN, _CLOSE = "\"'“”„‚‘«»‹›", "\"'“”’‘«»‹›"
REPORTING = frozenset("said says wrote writes called calling quoted quote quotes word term phrase slur insult reported testified dit écrit mot terme sagte schrieb wort begriff zitat dijo escribió palabra término".split())
ADDRESS = frozenset("you your u ya youre du dich dir ihr euch tu te toi vous tú ti usted ustedes eres".split())


def allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """The trie of terms, met by Levenshtein automata of their allowed edits, made deterministic on demand."""

    def __init__(self, terms: list[tuple[str, bool]]):
        """terms: text, and whether it is a beginning that any ending may follow."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]
        self.room = [0]  # most edits that a term below a node allows
        for k, (term, stem) in enumerate(terms):
            node, most = 0, allowed(term)
            for c in term:
                self.room[node] = max(self.room[node], most)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.ends.append(None), self.room.append(0)
                node = self.children[node][c]
            self.room[node] = max(self.room[node], most)
            if self.ends[node] is None or not stem:
                self.ends[node] = (k, stem)
        self.terms = terms
        self._restart()

    def _restart(self) -> None:
        self.names: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._name(self._closed({(0, 0)}))

    def _closed(self, states: set) -> frozenset:
        """Adds what leaving out letters of a term reaches; drops what a better state covers."""
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if node >= 0 and e < self.room[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.room[child] and (child, e + 1) not in states:
                        states.add((child, e + 1)), todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in states:
            if e < best.get(node, 99):
                best[node] = e
        return frozenset(best.items())

    def _name(self, states: frozenset) -> int:
        if states not in self.names:
            self.names[states] = len(self.sets)
            self.sets.append(states), self.steps.append({})
        return self.names[states]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if node < 0:  # past the end of a stem
                out.add((node, e))
                continue
            end = self.ends[node]
            if end and end[1] and e <= allowed(self.terms[end[0]][0]):
                out.add((-1 - end[0], e))
            if (child := self.children[node].get(c)) is not None and e <= self.room[child]:
                out.add((child, e))
            if e < self.room[node]:
                out.add((node, e + 1))
                out.update((child, e + 1) for child in self.children[node].values() if e + 1 <= self.room[child])
        return self._name(self._closed(out))

    def find(self, word: str) -> tuple[int, int] | None:
        """The term within its allowed edits of the whole word, and the edits; the fewest edits, then the first term."""
        if len(self.sets) > STATES:
            self._restart()
        state = self.start
        for c in word:
            steps = self.steps[state]
            nxt = steps.get(c)
            if nxt is None:
                nxt = steps[c] = self._step(state, c)
            state = nxt
            if not self.sets[state]:
                return None
        best = None
        for node, e in self.sets[state]:
            k = -1 - node if node < 0 else self.ends[node][0] if self.ends[node] else None
            if k is not None and e <= allowed(self.terms[k][0]) and (best is None or (e, k) < best):
                best = (e, k)
        return (best[1], best[0]) if best else None


@dataclass
class Lexicon:
    terms: list[tuple[str, bool]]
    weights: list[float]
    own: frozenset[str] = frozenset()  # near a term, but words of clean documents
    curve: list[float] = field(default_factory=lambda: [0.0] * 5)
    factors: tuple[float, float, float] = FACTORS

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher(dict):
    """Stretches between blanks to their hits (term, edits), remembered."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.automaton = lexicon, Automaton(lexicon.terms)

    def __missing__(self, stretch: str):
        if len(self) >= REMEMBERED:
            self.clear()
        hits = []
        for w in _TOKEN.findall(stretch.lower()):
            if (hit := self.automaton.find(w)) and not (hit[1] and w in self.lexicon.own):
                hits.append((*hit, w))
        value = self[stretch] = tuple(hits)
        return value

    def marked(self, text: str) -> list[tuple[float, int, str, tuple[bool, bool, bool]]]:
        """Weight without context, edits, surface and context of each hit."""
        words = text.split()
        found = list(map(self.__getitem__, words))
        out = []
        if not any(found):
            return out
        for i, hs in enumerate(found):
            if hs:
                marks = context(words, i)
                out += [(self.lexicon.weights[k] * (0.8 ** e), e, w, marks) for k, e, w in hs]
        return out

    def hits(self, text: str) -> list[tuple[float, int, str]]:
        """Weight in context, edits and surface of each hit."""
        return [(w * factor(marks, self.lexicon.factors), e, surface) for w, e, surface, marks in self.marked(text)]

    def features(self, text: str) -> list[float]:
        return features([h[0] for h in self.hits(text)], len(text.split()))


def features(weights: list[float], n_words: int) -> list[float]:
    """Of the weights of a text's hits: whether there are any, the strongest, their sum, their density."""
    if not weights:
        return [0.0, 0.0, 0.0, 0.0]
    return [1.0, min(1.0, max(weights) / 6), min(1.0, sum(weights) / 30), min(1.0, 20 * len(weights) / (n_words + 20))]


def context(words: list[str], i: int) -> tuple[bool, bool, bool]:
    """Of a hit at place i: whether it is quoted, reported as well, addressed."""
    low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    opened = any(w[0] in _OPEN for w in words[low : i + 1])
    closed = any(w.rstrip(".,;:!?")[-1:] in _CLOSE and w.rstrip(".,;:!?") for w in words[i:high])
    near = {t for w in words[low:high] for t in _TOKEN.findall(w.lower())}
    return opened and closed, bool(opened and near & REPORTING), bool(near & ADDRESS)


def factor(marks: tuple[bool, bool, bool], factors: tuple[float, float, float]) -> float:
    out = 1.0
    for mark, f in zip(marks, factors, strict=True):
        out *= f if mark else 1.0
    return out


def _word_counts(batches):
    """Per task: in how many toxic and clean documents a word, or a beginning of four to eight letters, occurs, and in how many toxic ones of one half."""
    both: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for text, toxic in zip(common.texts(batch), batch.column("toxic").to_pylist(), strict=True):
            words = set(_TOKEN.findall(text.lower()))
            marks = {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(4, 9) if len(w) > n}
            half = toxic and zlib.crc32(text.encode()) % 2
            for m in marks:
                n = both.setdefault(m, [0, 0, 0])
                n[toxic] += 1
                n[2] += half
    rows = [(*k, *v) for k, v in both.items()]
    for at in range(0, len(rows), 50_000):
        a, b, *counts = zip(*rows[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(c, pa.int64()) for c in counts)], names=["term", "stem", "clean", "toxic", "half"])


def _measured(lexicon: Lexicon):
    """Each text's label, words, and its hits: weights without context, their contexts as bits, and surfaces that are near a term."""

    def run(batches):
        matcher = lexicon.matcher()
        for batch in batches:
            n, weights, marks, near = [], [], [], []
            for text in common.texts(batch):
                hits = matcher.marked(text)
                n.append(len(text.split())), weights.append([h[0] for h in hits])
                marks.append([h[3][0] | h[3][1] << 1 | h[3][2] << 2 for h in hits]), near.append(sorted({w for _, e, w, _ in hits if e}))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")), pa.array(n, pa.int64()), pa.array(weights, pa.list_(pa.float64())), pa.array(marks, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.string()))], names=["toxic", "n", "weights", "marks", "near"])

    return run


_MEASURED = "toxic int, n bigint, weights array<double>, marks array<int>, near array<string>"


def curve(table, factors: tuple[float, float, float]) -> tuple[list[float], float]:
    """The logistic curve that fits the sample's rows (toxic, n, weights, marks) under these factors, and its mean log loss."""
    values = [factor((bool(m & 1), bool(m & 2), bool(m & 4)), factors) for m in range(8)]
    x = np.array([[1.0, *features([w * values[m] for w, m in zip(ws, ms, strict=True)], n)] for n, ws, ms in zip(table["n"], table["weights"], table["marks"], strict=True)])
    y = table["toxic"].to_numpy().astype(float)
    w = _adam(lambda w: x.T @ (_sigmoid(x @ w) - y) / len(y) + 1e-4 * w, np.zeros(5), 600, 0.1)
    w[2:] = np.maximum(0.0, w[2:])  # more or stronger hits never lower a score
    p = np.clip(_sigmoid(x @ w), 1e-9, 1 - 1e-9)
    return w.tolist(), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = 1, of: int = 3) -> Lexicon:
    """Learns from labelled rows whose crc32 remainder is not held."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (common.remainder(F.col("doc_id"), of) != held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = common.written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        p = bad / max(1, bad + good)
        return Lexicon([], [], curve=[float(np.log((p + 1e-6) / (1 - p + 1e-6))), 0.0, 0.0, 0.0, 0.0])
    counts = rows.mapInArrow(_word_counts, "term string, stem boolean, clean bigint, toxic bigint, half bigint").groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "half")))
    # support in both halves of the toxic documents, and an odds ratio that chance would hardly give
    counts = counts.filter(F.least("half", F.col("toxic") - F.col("half")) >= F.when(F.col("stem"), 4).when(F.lit(bad >= 100), 2).otherwise(1))
    strong = counts.filter((F.col("toxic") >= F.when(F.col("stem"), 8).otherwise(3)) & (F.col("toxic") * good >= 40 * (F.col("clean") + F.when(F.col("stem"), 0.2).otherwise(0.1)) * bad))
    picked = strong.orderBy(F.desc("toxic"), "term", "stem").collect()  # words of a bounded sample
    stems = {r["term"] for r in picked if r["stem"]}
    stems = {s for s in stems if not any(s[:k] in stems for k in range(4, len(s)))}
    words = {r["term"] for r in picked if not r["stem"]}
    stems = {s for s in stems if sum(w.startswith(s) for w in words) >= 3}
    terms, weights = [], []
    for r in picked:
        t = r["term"]
        if (r["stem"] and t in stems) or (not r["stem"] and len(t) > 2 and not any(t[:k] in stems for k in range(4, len(t)))):
            terms.append((t, r["stem"])), weights.append(float(np.log((r["toxic"] + 0.5) / (bad + 1) * (good + 1) / (r["clean"] + 0.5))))
    lexicon = Lexicon(terms, weights)
    near = rows.mapInArrow(_measured(lexicon), _MEASURED).filter("toxic = 0").select(F.explode("near").alias("w")).distinct()
    lexicon.own = frozenset(r["w"] for r in near.collect())
    table = rows.mapInArrow(_measured(lexicon), _MEASURED).select("toxic", "n", "weights", "marks").toPandas().sort_values(["toxic", "n"], kind="stable")
    lexicon.curve, loss = curve(table, lexicon.factors)
    for i, tries in enumerate(TRIED):
        for f in tries[1:]:
            factors = (*lexicon.factors[:i], f, *lexicon.factors[i + 1 :])
            made, less = curve(table, factors)
            if less < loss - 1e-5:
                lexicon.curve, lexicon.factors, loss = made, factors, less
    return lexicon


def _scored(lexicon: Lexicon):
    def run(batches):
        matcher, curve = lexicon.matcher(), np.array(lexicon.curve)
        for batch in batches:
            x = np.array([matcher.features(t) for t in common.texts(batch)], dtype=float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(np.hstack([np.ones((len(x), 1)), x]) @ curve))], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every text."""
    return docs.select("doc_id", "text").mapInArrow(_scored(lexicon), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    rows = scored(docs, fitted(docs, common.labels(spark, sf_dir)))
    return rows.select("doc_id", (common.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
