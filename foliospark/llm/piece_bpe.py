"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of white space markers and what follows it up to the next one. Where no piece of the vocabulary holds a marker after another
character (checked when the model is read), no merge crosses a chunk's border, so a text's ids are the ids of its chunks side by side.
A task numbers the chunks of a slice of documents; the library segments each distinct chunk of this table once, and the ids come back to the places by
the numbers. Short chunks are remembered from slice to slice (bounded). One table over the whole corpus was measured, and is not used: texts have so
many rare chunks that it has half as many rows as the tables of all slices together, while bringing its ids back moves all documents (README).
Decoding puts together what the ids stand for, and leaves to the library what isn't plain.

Defined results: null and empty texts have no ids but the end; U+2581 in a text is a marker like a space, as for the library; texts of any length are
whole (they are cut into chunks a million characters at a time); a text without any space is one chunk; repeated rows are encoded each, ties cannot
arise; rows without doc_id are encoded too; extra columns are dropped, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, keyed
from .byte_bpe import _field

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of a text that are cut at once.
AT_ONCE = 1 << 20
#: Characters of text in a slice; chunks that a worker remembers, and the longest of them.
SLICE, REMEMBERED, LONGEST = 2 << 20, 200_000, 48
_BORDER = re.compile(f"(?<=[^{MARK}]){MARK}")
_CHUNK = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        # the same model without the marker before each text; the last of repeated fields of a message holds
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=raw + _field(3, _field(3, 0)))
        self.end = self.library.eos_id()
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in n.lstrip(MARK) for n in names):
            raise ValueError("a piece crosses a white space marker")
        if self.library.encode("  a", out_type=str) != self.bare.encode(MARK * 3 + "a", out_type=str):
            raise ValueError("the model changes white space")
        #: What each id stands for: nothing, a byte, or its piece with spaces; whether it begins with a marker; whether only the library shows it.
        kinds = [(self.library.is_byte(i), self.library.is_control(i)) for i in range(len(names))]
        self.bytes = [bytes([int(n[1:-1], 16)]) if byte else b"" if control else n.replace(MARK, " ").encode() for n, (byte, control) in zip(names, kinds, strict=True)]
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(names))
        self.blob, self.starts = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.marked = np.array([n.startswith(MARK) for n in names])
        self.strange = np.array([self.library.is_unknown(i) for i in range(len(names))])

        self.known: dict[str, bytes] = {}

    def table(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, given without their first marker, side by side; and how many each has."""
        new = [c for c in chunks if c not in self.known]
        fresh = {c: array("i", ids).tobytes() for c, ids in zip(new, self.bare.encode([MARK + c for c in new], num_threads=1) if new else (), strict=True)}
        old = self.known
        made = [fresh[c] if c in fresh else old[c] for c in chunks]
        if len(old) + len(fresh) > REMEMBERED:
            old.clear()
        old.update((c, i) for c, i in fresh.items() if len(c) <= LONGEST)
        return np.frombuffer(b"".join(made), np.int32), np.fromiter(map(len, made), np.int64, len(made)) // 4


    def decoded(self, ids: np.ndarray, many: np.ndarray) -> list[str]:
        """The texts of ids that lie side by side, so many each, as the library decodes them: what they stand for, less the first marker where a text begins
        with one. Unknown pieces and bytes that are no characters are left to the library."""
        raw = self.blob[keyed.ranges(self.starts[ids], self.sizes[ids])].tobytes()
        ends = np.cumsum(np.concatenate([[0], many]))
        places = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends]
        strange = np.concatenate([[0], np.cumsum(self.strange[ids])])[ends]
        out = []
        for i, j, x, y, odd in zip(ends[:-1].tolist(), ends[1:].tolist(), places[:-1].tolist(), places[1:].tolist(), np.diff(strange).tolist(), strict=True):
            if x < y:
                shown = int(np.argmax(self.sizes[ids[i : i + 8]] > 0))
                if not self.sizes[ids[i + shown]]:
                    shown = int(np.argmax(self.sizes[ids[i:j]] > 0))
                x += int(self.marked[ids[i + shown]])
            try:
                out.append(self.library.decode(ids[i:j].tolist()) if odd else raw[x:y].decode())
            except UnicodeDecodeError:
                out.append(self.library.decode(ids[i:j].tolist()))
        return out


_read: dict[str, Pieces] = {}


def pieces(path: str | None) -> Pieces:
    import public_tokenizers

    path = path or public_tokenizers.path(MODEL)
    if path not in _read:
        _read[path] = Pieces(path)
    return _read[path]


def chunks(text: str) -> Iterator[list[str]]:
    """A text's chunks without their first marker, some at a time."""
    if not text:
        return
    text, at = MARK + text.replace(" ", MARK), 0
    while at < len(text):
        border = _BORDER.search(text, at + AT_ONCE) if len(text) - at > AT_ONCE else None
        end = border.start() if border else len(text)
        part = text[at:end]
        yield _CHUNK.findall(part) if MARK * 2 in part else part[1:].split(MARK)
        at = end


def _encode(path: str | None, end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        last = np.array([model.end] if end else [], np.int32)
        for ids, texts in keyed.slices(batches, SLICE):
            numbers = keyed.Numbers()
            places = [np.concatenate([np.empty(0, np.int32), *map(numbers.of, chunks(t))]) for t in texts]
            flat, sizes = model.table(list(numbers))
            starts, out = np.cumsum(sizes) - sizes, []
            for w in places:
                out.append(np.concatenate([flat[keyed.ranges(starts[w], sizes[w])], last]))
            yield pa.RecordBatch.from_arrays([ids, keyed.lists(out)], names=["doc_id", "ids"])

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = batch.column(1)
                made = model.decoded(np.asarray(ids.flatten()), np.asarray(ids.value_lengths().fill_null(0)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, path: str | None = None, end: bool = True) -> DataFrame:
    """doc_id, ids (array of int) of every text, with the end id unless that is left out."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path, end), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the text that the ids stand for, as the library decodes them."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(common.documents(spark, sf_dir)))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
