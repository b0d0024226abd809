"""Quality rules as a learned decision list.

Statistics of every whole text are taken in one pass; the list is learned from labelled rows by sequential covering: a rule, a
conjunction of thresholds, is grown condition by condition by information gain on two thirds of the rows, pruned from its end on the
last third, kept while it is right there often enough, and the rows that it covers are set aside before the next is grown. The list
becomes one ordered CASE expression, which Spark evaluates; anyone can read it (see `DecisionList.sql`).

Learning takes at most SAMPLE labelled rows, those with the smallest hashes of their ids; a fifth of the labels, by the crc32 of the id, is left out, so
that the list can be measured. Statistics and verdicts cover all rows.

Defined results: null and empty texts have all counts 0 and fail the base rule; equal rows get equal verdicts; a document without
doc_id is judged like any other; without labelled rows of both kinds the list is empty and the base rule alone decides;
labels that are null or repeated don't harm; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that learning uses at most.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_doubled", "n_upper", "n_letters", "n_exclaim", "n_bare")


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """How many positions lie in a window of width words that the text holds twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    top = int(ids.max()) + 1
    for i in range(1, width):
        if (int(key.max()) + 1) * top >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + ids[i : n + i]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for i in range(width):
        covered[i : n + i] |= hit
    return int(covered.sum())


def statistics(text: str) -> tuple[int, ...]:
    """The counts named in COUNTS."""
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(number),
        int((ids[1:] == ids[:-1]).sum()),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _LETTERS)),
        text.count("!"),
        sum(not w.strip(b"|#*$%&<>-_=~.!") for w in words),
    )


def _counted(batches):
    for batch in batches:
        rows = np.array([statistics(t) for t in common.texts(batch)], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text."""
    return docs.select("doc_id", "text").mapInArrow(_counted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS))


#: What conditions compare: SQL over the counts; the same text is evaluated for learning.
FEATURES = {
    "words": "n_words",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "doubled_share": "n_doubled / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "exclaims_per_word": "n_exclaim / greatest(n_words, 1)",
    "bare_share": "n_bare / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.bound if self.above else table[self.feature] <= self.bound

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<='} {self.bound!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that one covers is rejected, the others are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def sql(self) -> str:
        if not self.rules:
            return "true"
        return "CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN false" for r in self.rules) + " ELSE true END"


def covered(rule: tuple[Condition, ...], table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _best(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most information gain among the rows inside."""
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    before, best = np.log2(p / (p + n)), (1e-9, None)
    for name, values in table.items():
        v, y = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        low_p = np.cumsum(y)[edge].astype(float)
        low_n = (edge + 1) - low_p
        for above, pos, neg in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), Condition(name, above, round(float((v[edge[k]] + v[edge[k] + 1]) / 2), 6)))
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, longest: int = 4, most: int = 24) -> DecisionList:
    """Sequential covering of the bad rows."""
    n = len(bad)
    order = np.random.Generator(np.random.PCG64(5)).permutation(n)
    grow = np.zeros(n, dtype=bool)
    grow[order[: 2 * n // 3]] = True
    left, rules = np.ones(n, dtype=bool), []
    while len(rules) < most and (bad & left & grow).sum() >= 5:
        rule: tuple[Condition, ...] = ()
        while len(rule) < longest:
            inside = left & grow & covered(rule, table, n)
            if bad[inside].all() or not bad[inside].any():
                break
            _, c = _best(table, bad, inside)
            if c is None:
                break
            rule = (*rule, c)

        def worth(r: tuple[Condition, ...]) -> float:
            inside = left & ~grow & covered(r, table, n)
            p = int(bad[inside].sum())
            return (2 * p - int(inside.sum())) / max(1, int(inside.sum()))

        tries = [rule[:k] for k in range(1, len(rule) + 1)]
        if not tries:
            break
        rule = max(tries, key=lambda r: (worth(r), -len(r)))
        inside = left & covered(rule, table, n)
        if (worth(rule) + 1) / 2 < precision or not (bad & inside).any():
            break
        rules.append(rule)
        left &= ~inside
    return DecisionList(tuple(rules))


def fitted(counts: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = 0, of: int = 5) -> DecisionList:
    """The list that at most sample labelled rows teach whose crc32 remainder is not held."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (common.remainder(F.col("doc_id"), of) != held)).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = counts.join(F.broadcast(chosen), "doc_id").selectExpr("doc_id", "quality", *(f"CAST({x} AS double) AS {k}" for k, x in FEATURES.items()))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES).limit(sample).toPandas()
    bad = (rows["quality"] == 0).to_numpy()
    if not len(bad) or bad.all() or not bad.any():
        return DecisionList(())
    return learn({k: rows[k].to_numpy() for k in FEATURES}, bad)


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DecisionList]:
    """doc_id, all counts, base_failed and kept; and the list that decided."""
    counts = common.written(counted(docs), "counts")
    rules = fitted(counts, labels, sample)
    return counts.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", F.expr(f"NOT ({BASE_FAILED}) AND ({rules.sql()})")), rules


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = judged(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
