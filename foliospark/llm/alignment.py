"""Alignment of the tokens of two vocabularies by a dangling-suffix transducer, and how often tokens meet in the corpus.

Both tokenisers split the same bytes (a space and the text). The transducer's state says which side leads and what bytes of its last token the
other side has not reached yet. The side behind gives the next token, which meets the leader's last token (a link); it uses up some of the residual, or
all of it and takes the lead with its own rest. Where nothing remains a group closes. Moves are remembered by state and token.

Before a space that follows a non-space both sides end a token, so the residual is empty there: every distinct stretch between such places is encoded
and aligned once for a slice of documents, and a document's groups are those of its stretches side by side. All stretches of a slice take their moves
together, one token each at a time. Pairs of ids are keys (keyed.py): a task counts in how many documents of its slice each pair is linked, the
sums over the corpus come from one aggregation, and return by slice.

Defined results: null and empty texts, and texts one side can't give back byte by byte (those that hold U+2581), have no tokens and only zeros; special
tokens' strings are plain text; each of repeated rows counts as a document; ties for the highest count of an id all count as best; rows without
doc_id are rows like others; texts of any length are whole; extra columns are dropped, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, keyed
from .piece_bpe import pieces
from .word_bpe import _byte_letters

BYTES = "byte_bpe_50k.json"
#: Moves that a worker remembers; stretches of more tokens are aligned one by one.
MOVES, TOGETHER = 200_000, 200
#: Characters of a text that are cut at once.
AT_ONCE = 1 << 20
_BORDER = re.compile(r"(?<=\S) ")
_DOUBLE = re.compile(r"\s ")
#: Characters of text in a slice.
SLICE = 1 << 21
#: A pair of ids is one number: the first id that many bits higher than the second. So is a move: its state and its token.
BITS = 32


class Transducer:
    """States are numbered in the order that they are met; state 0 has no residual."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens = {True: a, False: b}
        self.forget()

    def forget(self) -> None:
        #: Number, and whether A leads with which residual, of each state; moves as a table, and sorted for many at once.
        self.numbers: dict[tuple[bool, bytes], int] = {}
        self.states: list[tuple[bool, bytes]] = [(False, b"")]
        self.moves: dict[int, int] = {}
        self.keys, self.next, self.leads = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, bool)

    def state(self, a_leads: bool, residual: bytes) -> int:
        if not residual:
            return 0
        n = self.numbers.setdefault((a_leads, residual), len(self.states))
        if n == len(self.states):
            self.states.append((a_leads, residual))
        return n

    def move(self, state: int, token: int) -> int:
        """The state after the side behind (A if neither is) gives a token; -1 where their bytes differ."""
        new = self.moves.get(state << BITS | token)
        if new is None:
            a_leads, rest = self.states[state]
            given = self.tokens[not a_leads][token]
            if rest.startswith(given):
                new = self.state(a_leads, rest[len(given) :])
            else:
                new = self.state(not a_leads, given[len(rest) :]) if given.startswith(rest) else -1
            self.moves[state << BITS | token] = new
        return new

    def move_all(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys = states << BITS | tokens
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            for k in np.unique(keys[~known]).tolist():
                self.move(k >> BITS, k & (1 << BITS) - 1)
            self.keys = np.fromiter(self.moves, np.int64, len(self.moves))
            order = np.argsort(self.keys)
            self.next = np.fromiter(self.moves.values(), np.int64, len(self.moves))[order]
            self.keys, self.leads = self.keys[order], np.array([x for x, _ in self.states], bool)
            at = np.searchsorted(self.keys, keys)
        return self.next[at]

    def aligned(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """Where each group ends in a and in b, and the linked pairs of places in order; nothing where the bytes differ."""
        i = j = state = 0
        ends, links = [], []
        while i < len(a) or j < len(b):
            a_gives = not self.states[state][0]
            if (i if a_gives else j) == len(a if a_gives else b):
                return None
            token = a[i] if a_gives else b[j]
            i, j = i + a_gives, j + (not a_gives)
            if state:
                links.append((i - 1, j - 1))
            state = self.move(state, token)
            if state < 0:
                return None
            if not state:
                ends.append((i, j))
        return None if state else (ends, links)

    def aligned_all(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """aligned() for many texts whose ids lie side by side, n_a and n_b each. Rows of text, end in a, end in b of all groups in order; rows of text, place
        in a, place in b of all links; and which texts have other bytes on one side (they have one group of all and no links).
        """
        if len(self.moves) > MOVES:
            self.forget()
        a_end, b_end = np.cumsum(n_a), np.cumsum(n_b)
        i, j, state = a_end - n_a, b_end - n_b, np.zeros(len(n_a), np.int64)
        failed, ends, links = np.zeros(len(n_a), bool), [np.empty((0, 3), np.int64)], [np.empty((0, 3), np.int64)]
        for x in np.flatnonzero(n_a + n_b > TOGETHER).tolist():
            made = self.aligned(a[i[x] : a_end[x]].tolist(), b[j[x] : b_end[x]].tolist())
            failed[x] = made is None
            for rows, to in zip(made or (), (ends, links), strict=False):
                to.append(np.array([(x, i[x] + p, j[x] + q) for p, q in rows], np.int64).reshape(-1, 3))
        here = np.flatnonzero(n_a + n_b <= TOGETHER)
        while True:
            here = here[(state[here] != 0) | (i[here] < a_end[here]) | (j[here] < b_end[here])]
            a_gives = ~self.leads[state[here]]
            short = np.where(a_gives, i[here] == a_end[here], j[here] == b_end[here])
            failed[here[short]] = True
            here, a_gives = here[~short], a_gives[~short]
            if not len(here):
                break
            tokens = np.empty(len(here), np.int64)
            tokens[a_gives], tokens[~a_gives] = a[i[here[a_gives]]], b[j[here[~a_gives]]]
            before = state[here]
            new = self.move_all(before, tokens)
            i[here] += a_gives
            j[here] += ~a_gives
            met, closed = here[before != 0], here[new == 0]
            links.append(np.stack([met, i[met] - 1, j[met] - 1], axis=1))
            ends.append(np.stack([closed, i[closed], j[closed]], axis=1))
            failed[here[new < 0]] = True
            state[here] = new
            here = here[new >= 0]
        ends, links, bad = np.concatenate(ends), np.concatenate(links), np.flatnonzero(failed)
        if len(bad):
            ends, links = ends[~failed[ends[:, 0]]], links[~failed[links[:, 0]]]
            ends = np.concatenate([ends, np.stack([bad, a_end[bad], b_end[bad]], axis=1)])
        return ends[np.lexsort((ends[:, 2], ends[:, 1], ends[:, 0]))], links, failed


class Texts:
    """Ids of both sides as text, each with one of two characters after it: all in one array of bytes."""

    def __init__(self, sizes: tuple[int, int]):
        parts = [f"{i}{mark}".encode() for size, marks in zip(sizes, (",|", ",;"), strict=True) for i in range(size) for mark in marks]
        self.blob, self.sizes = np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts, self.b = np.cumsum(self.sizes) - self.sizes, 2 * sizes[0]

    def shown(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray, n: int) -> list[str]:
        """Of each of n texts its groups: A ids | B ids; and so on. ends: as aligned_all() gives them, every id in a group."""
        sizes = np.diff(np.concatenate([np.zeros((1, 2), np.int64), ends[:, 1:]]), axis=0)
        key = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends[:, 1] - 1] = last_b[ends[:, 2] - 1] = 1
        before_a, before_b = ends[:, 2] - sizes[:, 1], ends[:, 1]
        key[np.arange(len(a)) + np.repeat(before_a, sizes[:, 0])] = 2 * a + last_a
        key[np.arange(len(b)) + np.repeat(before_b, sizes[:, 1])] = self.b + 2 * b + last_b
        whole = self.blob[keyed.ranges(self.starts[key], self.sizes[key])].tobytes().decode("ascii")
        chars = np.concatenate([[0], np.cumsum(self.sizes[key])])
        groups = np.cumsum(np.bincount(ends[:, 0], minlength=n))
        to = chars[np.where(groups > 0, ends[groups - 1, 1] + ends[groups - 1, 2], 0)] if len(ends) else np.zeros(n, np.int64)
        return [whole[x : max(x, y - 1)] for x, y in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]


class Aligner:
    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(a_path or public_tokenizers.path(BYTES), encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if sorted(ranks.values()) != list(range(len(ranks))) or any(model["vocab"][x + y] != 256 + i for i, (x, y) in enumerate(merges)):
            raise ValueError("ids must be the order of the merges")
        self.a, self.b = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), pieces(b_path)
        tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.transducer = Transducer(tokens, self.b.bytes)
        self.texts = Texts((len(tokens), len(self.b.bytes)))
        self.sizes = np.array([len(t) for t in tokens])

    def encoded(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of stretches (with their first space) side by side, and how many each has.

        All go through the library in one text, but for those that end in white space: the border after a non-space and before a space is one of tokens.
        """
        loose = [i for i, s in enumerate(stretches) if s[-1].isspace()]
        cuts = [*loose, len(stretches)]
        parts, n, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for cut in cuts:
            joined = stretches[at:cut]
            ids = np.array(self.a.encode_ordinary("".join(joined)), np.int64)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(s.encode()) for s in joined])) + 1 if joined else np.empty(0, np.int64)
            parts.append(ids), n.append(np.diff(ends, prepend=0))
            if cut < len(stretches):
                parts.append(np.array(self.a.encode_ordinary(stretches[cut]), np.int64)), n.append(np.array([len(parts[-1])]))
            at = cut + 1
        return np.concatenate(parts), np.concatenate(n)

    def all(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of stretches (without their first space): numbers of A ids, B ids, groups; linked pairs side by side and how many each has; the groups as text; which
        B can't give back."""
        stretches = [" " + s for s in stretches]
        a, n_a = self.encoded(stretches)
        made = self.b.bare.encode(stretches, num_threads=1) if stretches else []
        n_b = np.fromiter(map(len, made), np.int64, len(made))
        b = np.fromiter(chain.from_iterable(made), np.int64, int(n_b.sum()))
        ends, links, failed = self.transducer.aligned_all(a, b, n_a, n_b)
        links = links[np.argsort(links[:, 0], kind="stable")]
        counts = np.stack([n_a, n_b, np.bincount(ends[:, 0], minlength=len(stretches))], axis=1)
        return counts, a[links[:, 1]] << BITS | b[links[:, 2]], np.bincount(links[:, 0], minlength=len(stretches)), self.texts.shown(a, b, ends, len(stretches)), failed


def stretched(text: str) -> Iterator[list[str]]:
    """A space and the text, cut before each space that follows a non-space, some at a time; each stretch without the space that it begins with."""
    text, at = " " + text, 0
    while at < len(text):
        border = _BORDER.search(text, at + AT_ONCE) if len(text) - at > AT_ONCE else None
        end = border.start() if border else len(text)
        part = text[at:end]
        if _DOUBLE.search(part):
            cuts = [0, *(m.start() for m in _BORDER.finditer(part, 1)), len(part)]
            yield [part[i + 1 : j] for i, j in zip(cuts, cuts[1:], strict=False)]
        else:
            yield part[1:].split(" ")
        at = end


_made: dict[tuple, Aligner] = {}


def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    if (a_path, b_path) not in _made:
        _made[a_path, b_path] = Aligner(a_path, b_path)
    return _made[a_path, b_path]


def _cut(a_path: str | None, b_path: str | None, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for uid, (ids, texts) in zip(keyed.uids(), keyed.slices(batches, SLICE), strict=False):
            numbers = keyed.Numbers()
            words = [np.concatenate([np.empty(0, np.int32), *map(numbers.of, stretched(t) if t else ())]) for t in texts]
            n, flat, sizes, shown, failed = both.all(list(numbers))
            if failed.any():
                words = [w[:0] if failed[w].any() else w for w in words]
            rows = [";".join([shown[x] for x in w.tolist()]) for w in words]
            if digest:
                rows = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in rows]
            starts = np.cumsum(sizes) - sizes
            pairs, slots = np.unique(flat, return_inverse=True)
            # in how many documents of the slice a pair is: distinct stretches of each document first, then their distinct pairs
            each = [np.unique(w) for w in words]
            owner, s = np.repeat(np.arange(len(each)), list(map(len, each))), np.concatenate([np.empty(0, np.int32), *each])
            held = np.unique(np.repeat(owner, sizes[s]) * max(len(pairs), 1) + slots[keyed.ranges(starts[s], sizes[s])])
            documents = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
            ends = np.cumsum([0, *map(len, words)])
            sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(n[np.concatenate([np.empty(0, np.int32), *words])], axis=0)])
            a, b, g = np.diff(sums[ends], axis=0).T
            docs = pa.StructArray.from_arrays([ids, *map(pa.array, (a, b, g, a + b - g)), pa.array(rows, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
            blob = keyed.packed(sizes, slots, np.diff(ends), np.concatenate([np.empty(0, np.int32), *words]))
            columns = [pa.array([uid], pa.int64()), keyed.one(pa.array(pairs)), keyed.one(pa.array(documents.astype(np.int64))), pa.array([blob], pa.binary()), keyed.one(docs)]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "keys", "documents", "places", "docs"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own = keyed.unfolded(batch, "docs", i)
            n_links, links, n_words, words = keyed.unpacked(batch.column(batch.schema.get_field_index("places"))[i].as_py())
            at, count, best = keyed.unfolded(batch, "found", i) if batch.column(batch.schema.get_field_index("found"))[i].is_valid else [np.empty(0, np.int64)] * 3
            counts = np.zeros((len(at), 2), np.int64)
            counts[np.asarray(at), 0], counts[np.asarray(at), 1] = np.asarray(best), np.asarray(count)

            def summed(values, places, many):
                sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values[places], axis=0)])
                return np.diff(sums[np.cumsum(np.concatenate([[0], many]))], axis=0)

            best, total = summed(summed(counts, links, n_links), words, n_words).T
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(best), pa.array(total)], names=names)


def coded(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False) -> DataFrame:
    """One row a slice: uid, keys (its linked pairs), documents (in how many of it each is linked), docs, and places: how many links each stretch has, their
    slots among keys, how many stretches each document has, and which."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = f"struct<doc_id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups: string>"
    rows = docs.select("doc_id", "text").mapInArrow(_cut(a_path, b_path, digest), f"uid bigint, keys array<bigint>, documents array<bigint>, places binary, docs array<{own}>")
    return common.cleanly(rows, "aligned")


def pair_counts(cut: DataFrame) -> DataFrame:
    """key, a, b, count, best: in how many documents of the corpus a pair is linked, and whether no other pair of its A id is in more."""
    each = cut.select(F.explode(F.arrays_zip("keys", "documents")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.documents").alias("count"))
    each = common.cleanly(each.withColumn("a", F.shiftright("key", BITS).cast("int")), "pairs")
    highest = each.groupBy("a").agg(F.max("count").alias("highest"))
    return each.join(highest, "a").select("key", "a", F.col("key").bitwiseAND((1 << BITS) - 1).cast("int").alias("b"), "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (A ids | B ids; ...; or only their SHA-256), n_best, count_sum of every document."""
    cut = coded(docs, a_path, b_path, digest)
    rows = keyed.brought_back(cut.drop("documents"), pair_counts(cut).select("key", "count", F.col("best").cast("bigint").alias("best")))
    return rows.mapInArrow(_sum, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(common.documents(spark, sf_dir), digest=True)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
