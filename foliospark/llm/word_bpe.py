"""Token ids of a word-ending BPE vocabulary (a tokenizers JSON file) for many texts, faster than one by one.

White space separates pieces and is dropped, so a text is cut at spaces and line feeds, and the ids of each distinct stretch of a slice of texts are
computed once. Stretches of plain letters are cut into pieces together, and all pieces go through one byte-pair encoder in one text, in which a zero
byte stands for the end of a word: it joins the byte before it first, as the vocabulary has each byte with a word's end as a symbol. That encoder
joins what is a token by the token's rank, the vocabulary two given tokens by the merge's: both do the same if each token comes out of its own
letters whole, which is checked for all tokens when the vocabulary is read. What needs Unicode normalisation, has rare letters, holds one of the
vocabulary's added tokens or is very long goes through the library itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from . import keyed

LONGEST = 48
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin letters whose lower case is one letter and which NFC leaves alone; anything else takes the library's way.
_PLAIN = re.compile(f"[\x21-\x7eÀ-ÖØ-öø-ÿ]{{1,{LONGEST}}}")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 as is, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # strings that the library takes whole wherever they stand; none holds a blank, so cutting at blanks leaves them whole
        self.whole = [t["content"] for t in spec["added_tokens"]]
        assert not any(" " in t or "\n" in t for t in self.whole)
        self.mark = os.path.commonprefix(self.whole)
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in model["merges"]], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.quick = self._encoder(model["merges"], vocab, end) if self._whole(vocab, end) else None

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def _encoder(self, merges: list, vocab: dict[str, int], end: str):
        """The vocabulary as an encoder of bytes; numbers is the vocabulary's id of each of its ids, last whether it ends a word."""
        import tiktoken

        byte = {c: bytes([b]) for b, c in _byte_letters().items()}

        def raw(token: str) -> bytes:
            ended = token.endswith(end)
            return b"".join(byte[c] for c in (token.removesuffix(end) if ended else token)) + b"\0" * ended

        tokens = [*(bytes([b]) for b in range(256)), *(bytes([b, 0]) for b in range(256)), *(raw(a + b) for a, b in merges)]
        self.numbers = np.concatenate([self.inner, self.last, self.made]).astype("<u4")
        self.ends = np.array([t.endswith(b"\0") for t in tokens])
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})

    def _whole(self, vocab: dict[str, int], end: str) -> bool:
        """Whether every token that merges make comes out whole when its own letters are merged, and none ends in a zero byte itself."""
        letters = {c: b for b, c in _byte_letters().items()}
        tokens = {i: t for t, i in vocab.items()}
        for ended in (True, False):
            mine = [i for i in self.made.tolist() if tokens[i].endswith(end) == ended]
            bytes_ = [bytes(letters[c] for c in tokens[i].removesuffix(end)) for i in mine]
            sizes = np.fromiter(map(len, bytes_), np.int64, len(bytes_))
            ids, many = self.words(np.frombuffer(b"".join(bytes_), np.uint8), sizes, ended)
            if any(b"\0" in b for b in bytes_) or not (many == 1).all() or ids.tolist() != mine:
                return False
        return True

    def words(self, raw: np.ndarray, sizes: np.ndarray, ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces whose bytes lie side by side, none empty, each merged on its own as the merge list says; and how many each has."""
        symbols, owner = self.inner[raw], np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes) - 1
        if ended:
            symbols[ends] = self.last[raw[ends]]
        none, done = len(self.keys), []
        ranks = np.full(len(symbols), none)  # of each symbol with the next one of its word
        if len(symbols):
            ranks[:-1] = np.where(owner[:-1] == owner[1:], self._pair_ranks(symbols[:-1], symbols[1:]), none)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            active = np.repeat(low < none, lengths)
            if not active.all():
                done.append((owner[~active], symbols[~active]))
                symbols, owner, ranks = symbols[active], owner[active], ranks[active]
                if not len(symbols):
                    break
                lengths = lengths[low < none]
                low = low[low < none]
            hit = np.flatnonzero(ranks == np.repeat(low, lengths))
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]
            symbols[hit] = self.made[ranks[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            # only what a new symbol is a part of has a new rank
            hit = hit - np.arange(len(hit))
            for left in (hit, hit[hit > 0] - 1):
                right = np.minimum(left + 1, len(symbols) - 1)
                same = (owner[left] == owner[right]) & (right > left)
                ranks[left] = np.where(same, self._pair_ranks(symbols[left], symbols[right]), none)
        owner = np.concatenate([x for x, _ in done]) if done else np.empty(0, np.int64)
        symbols = np.concatenate([x for _, x in done]) if done else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype("<u4"), np.bincount(owner, minlength=len(sizes))

    def _plain(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short stretches of plain letters side by side, and how many each has."""
        pieces = _PIECES.findall(" ".join(stretches).lower())
        # the pieces cover all but the blanks, so lengths tell which stretch each lies in
        lengths = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(lengths, np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches))))
        ids = np.array(self.quick.encode_ordinary("\0".join([*pieces, ""])), np.int64)
        return self.numbers[ids], np.diff(np.flatnonzero(self.ends[ids])[last] + 1, prepend=0)

    def table(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct stretches in some order, where those of each begin, and how many each has."""
        plain, mark = _PLAIN.fullmatch, self.mark
        fit = [self.quick is not None and plain(s) is not None and not (self.whole and mark in s and any(t in s for t in self.whole)) for s in stretches]
        quick, slow = [s for s, f in zip(stretches, fit, strict=True) if f], [s for s, f in zip(stretches, fit, strict=True) if not f]
        ids, many = self._plain(quick) if quick else (np.empty(0, "<u4"), np.empty(0, np.int64))
        more = [e.ids for e in self.library.encode_batch(slow, add_special_tokens=False)] if slow else []
        ids, many = np.concatenate([ids, *(np.array(x, "<u4") for x in more)]), np.concatenate([many, np.fromiter(map(len, more), np.int64, len(more))])
        starts, sizes, fit = np.empty(len(stretches), np.int64), np.empty(len(stretches), np.int64), np.array(fit, bool)
        order = np.concatenate([np.flatnonzero(fit), np.flatnonzero(~fit)])
        starts[order], sizes[order] = np.cumsum(many) - many, many
        return ids.astype("<u4"), starts, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        ids, starts, sizes = self.table(coded.dictionary.to_pylist())
        places = np.split(coded.indices.to_numpy(), np.cumsum(cut.value_lengths().to_numpy())[:-1]) if texts else []
        return [ids[keyed.ranges(starts[w], sizes[w])].tobytes() for w in places]
