"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every vocabulary entry becomes a piece in which each byte is one printable letter, scored by its negative rank, and the normaliser
changes nothing; so sentencepiece's own merging (best score first, leftmost on ties) is merging by rank. A text is first cut
into pre-tokens by the vocabulary's pattern; each is encoded on its own. Decoding maps pieces back to their bytes.

Texts are cut at spaces that follow a non-space: no pre-token reaches over such a place and no look-ahead sees beyond it, so
each distinct stretch is encoded once and remembered (bounded).

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are encoded each; special tokens' strings
are ordinary text; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .word_bpe import _byte_letters

#: Stretches and pre-tokens that a worker remembers.
REMEMBERED = 400_000
RANKS = "byte_bpe_50k.tiktoken"
#: A blank before a space.
_DOUBLE = re.compile(r"\s ")
#: Tokens that are decoded at once.
AT_ONCE = 1 << 20


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of type BPE whose piece ids are the ranks; the unknown piece comes last."""
    letters = _byte_letters()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out += _field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # trainer: BPE, size, id of unknown; normaliser: identity, no dummy prefix, spaces kept as they are
    out += _field(2, _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must run from 0 without gaps")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        # the regex module counts four more controls as white space than the pattern's own engine does
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.letters = [x for _, x in sorted(_byte_letters().items())]
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pieces: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def stretched(self, text: str) -> list[str]:
        """The text cut before each space that follows a non-space."""
        parts = text.split(" ")
        if text.startswith(" ") or text.endswith(" ") or _DOUBLE.search(text):
            out = [parts[0]]
            for p in parts[1:]:
                if out[-1] and not out[-1][-1].isspace():
                    out.append(" " + p)
                else:
                    out[-1] += " " + p
            return out
        return [parts[0], *[" " + p for p in parts[1:]]]

    def _learn(self, new: set[str]) -> None:
        cut = {s: self.pattern.findall(s) for s in new}
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        fresh = {p for c in cut.values() for p in c if p not in self.pieces}
        hard = []
        for p in fresh:
            rank = self.ranks.get(p.encode())
            if rank is None:
                hard.append(p)
            else:
                self.pieces[p] = struct.pack("<i", rank)
        mapped = ["".join(map(self.letters.__getitem__, p.encode())) for p in hard]
        for p, ids in zip(hard, self.model.encode(mapped, num_threads=1) if hard else (), strict=True):
            self.pieces[p] = np.array(ids, dtype="<i4").tobytes()
        get = self.pieces.__getitem__
        self.stretches.update((s, b"".join(map(get, c))) for s, c in cut.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit numbers."""
        cut = [self.stretched(t) if t else [] for t in texts]
        new = {s for c in cut for s in c if s not in self.stretches}
        if len(self.stretches) + len(new) > REMEMBERED:
            self.stretches.clear()
            new = {s for c in cut for s in c}
        if new:
            self._learn(new)
        get = self.stretches.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids side by side, and how many each has."""
        sizes, parts = self.sizes[ids], [np.zeros(0, dtype=np.uint8)]
        for at in range(0, len(ids), AT_ONCE):
            n = sizes[at : at + AT_ONCE]
            shift = self.starts[ids[at : at + AT_ONCE]] - (np.cumsum(n) - n)
            parts.append(self.blob[np.repeat(shift, n) + np.arange(n.sum())])
        return np.concatenate(parts), sizes


_coders: dict[str, ByteBpe] = {}


def coder(path: str | None) -> ByteBpe:
    import public_tokenizers

    path = path or public_tokenizers.path(RANKS)
    if path not in _coders:
        _coders[path] = ByteBpe(path, public_tokenizers.PATTERN)
    return _coders[path]


#: Texts that are in hand at once.
SLICE = 512


def _encode(path: str | None):
    def run(batches):
        bpe = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = bpe.encode(common.texts(batch))
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "ids"])

    return run


def _decode(path: str | None):
    def run(batches):
        bpe = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = batch.column(1)
                raw, sizes = bpe.decoded(ids.flatten().to_numpy(zero_copy_only=False))
                many = np.cumsum(np.concatenate([[0], ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))
                ends = np.concatenate([[0], np.cumsum(sizes)])[many]
                made = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*batch.columns, made.cast(pa.binary())], names=["doc_id", "ids", "bytes"])

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, bytes: what the ids stand for."""
    return rows.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, bytes binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(common.documents(spark, sf_dir)))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
