"""Alignment, pieces and runs against brute-force versions and the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliospark.llm import alignment, common, piece_bpe, runs

SF = "/root/testdata/sf0.001"
BITS = [" ", "  ", "\n", "\x1c", "\x85", "\xa0", "　 ", " word", "b'll", "'s", " 12", "é", "😀", "\t", "x\n", "!?", " \n ", "<|endoftext|>", "<s>", "</s>", "\r\n", "\x00", "日本", "ab́", "the", " the", "ing "]
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One\ntwo three " * 30), (5, "One\ntwo three " * 30), (5, "One\ntwo three " * 30), (None, "no id here"), (None, None), (6, "x" * 5_000 + " y z" * 9_000), (7, "a▁b c ▁ d"), (8, "\x00\x01 \x1c\x85")]
EXTRA = ("key", "keys", "uid", "docs", "slots", "found", "ids", "runs", "links", "best", "count", "words")


def strings(seed, n=1500):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    return made.select("*", *(F.lit("clash").alias(c) for c in EXTRA))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))


# ---- pieces


def test_chunks_encode_as_whole_texts_do(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "AT_ONCE", 7)
    model = piece_bpe.pieces(None)
    for t in [*strings(1), "▁", " ▁ a▁", "a ", " "]:
        assert [i for part in piece_bpe.chunks(t) for c in part for i in model.table([c])[0].tolist()] == library.encode(t)


def test_pieces_over_tables(spark, library):
    docs = [*ODD, *((100 + i, t) for i, t in enumerate(strings(2, 300)))]
    rows = piece_bpe.decoded(piece_bpe.encoded(frame(spark, docs))).collect()
    want = Counter((i, tuple(library.encode(t or "", add_eos=True)), library.decode(library.encode(t or "", add_eos=True))) for i, t in docs)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert piece_bpe.encoded(frame(spark, docs).limit(0)).collect() == []


def test_each_distinct_chunk_of_a_slice_is_segmented_once(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(piece_bpe, "SLICE", 200)
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 20)
    texts, seen = strings(5, 300), []
    model = piece_bpe.Pieces(public_tokenizers.path(piece_bpe.MODEL))
    table = model.table
    monkeypatch.setattr(model, "table", lambda chunks: seen.append(chunks) or table(chunks))
    monkeypatch.setitem(piece_bpe._read, "own", model)
    rows = [r for b in piece_bpe._encode("own", False)(iter([pa.record_batch([pa.array(range(300)), pa.array(texts)], names=["doc_id", "text"])])) for r in b.column(1).to_pylist()]
    assert rows == [library.encode(t) for t in texts] and len(seen) > 20 and all(len(set(c)) == len(c) for c in seen) and len(model.known) < 200


def test_piece_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in common.documents(spark, SF).collect()}
    for r in piece_bpe.query(spark, SF).collect():
        ids = library.encode(texts.pop(r["doc_id"]) or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert not texts


def test_any_ids_decode_as_the_library_does(library):
    model, r = piece_bpe.pieces(None), random.Random(8)
    space, tab = library.piece_to_id("▁"), library.piece_to_id("▁▁")
    common_ids = [0, 1, 2, 3, 35, 198, 199, 230, space, tab, *library.encode("é the 日本 ing")]
    rows = [[r.choice(common_ids) if r.random() < 0.7 else r.randrange(32000) for _ in range(r.randint(0, 12))] for _ in range(3000)] + [[1] * 20 + [space, space], [2], [35], []]
    got = model.decoded(np.array([i for x in rows for i in x], np.int64), np.array(list(map(len, rows))))
    assert got == [library.decode(x) for x in rows]


def test_crossing_pieces_are_refused(tmp_path):
    from foliospark.llm.byte_bpe import _field

    bad = b"".join(_field(1, _field(1, p.encode()) + _field(2, -float(i)) + _field(3, t)) for i, (p, t) in enumerate([("<unk>", 2), ("<s>", 3), ("</s>", 3), ("a▁b", 1), ("a", 1), ("▁", 1), ("b", 1)]))
    (tmp_path / "m").write_bytes(bad + _field(2, _field(3, 2)) + _field(3, _field(1, b"identity") + _field(4, 0)))
    with pytest.raises(ValueError, match="crosses"):
        piece_bpe.Pieces(str(tmp_path / "m"))


# ---- alignment


def brute_alignment(docs, library):
    """By byte offsets alone: for each row its groups, links and the sums, over all rows."""
    from tokenizers import Tokenizer

    from foliospark.llm.word_bpe import _byte_letters

    a_side = Tokenizer.from_file(public_tokenizers.path(alignment.BYTES))
    a_side.encode_special_tokens = True
    byte = {c: b for b, c in _byte_letters().items()}
    rows, count = [], Counter()
    for i, t in docs:
        a, b = (a_side.encode(" " + t, add_special_tokens=False).ids, library.encode(t)) if t else ([], [])
        raw_a = [bytes(byte[c] for c in a_side.id_to_token(x)) for x in a]
        raw_b = [bytes([int(p[1:-1], 16)]) if library.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [library.id_to_piece(x)]]
        if t and not (b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode()):
            a = b = raw_a = raw_b = []
        ends = [np.cumsum(list(map(len, r))).tolist() for r in (raw_a, raw_b)]
        links, j = [], 0
        for x, (end, r) in enumerate(zip(ends[0], raw_a, strict=True)):
            while ends[1][j] - len(raw_b[j]) >= end or ends[1][j] <= end - len(r):
                j += 1
            k = j
            while k < len(b) and ends[1][k] - len(raw_b[k]) < end:
                links.append((a[x], b[k]))
                k += 1
        groups, at = [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(f"{','.join(map(str, a[at[0]:to[0]]))}|{','.join(map(str, b[at[1]:to[1]]))}")
            at = to
        rows.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(i, n, m, g, len(ls), text, sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls)) for i, n, m, g, ls, text in rows]


def test_alignment_equals_brute_force(spark, library, monkeypatch):
    docs = [*ODD, *((100 + i, t) for i, t in enumerate(strings(3, 400)))]
    got = alignment.aligned(frame(spark, docs)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")) for r in got) == Counter(brute_alignment(docs, library))
    assert all(x == 0 or x == "" for r in got if r["doc_id"] in (0, 1, 7) for x in r[1:])
    assert alignment.aligned(frame(spark, docs).limit(0)).collect() == []


def test_alignment_query(spark, library):
    docs = [(r["doc_id"], r["text"]) for r in common.documents(spark, SF).collect()]
    got = {tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in alignment.query(spark, SF).collect()}
    assert got == {(*x[:5], hashlib.sha256(x[5].encode()).hexdigest() if x[5] else "", *x[6:]) for x in brute_alignment(docs, library)}


def test_stretches_and_small_stores(monkeypatch):
    texts = strings(4, 200)

    def made(both):
        out = []
        for t in texts:
            parts = [s for part in alignment.stretched(t) for s in part]
            assert "".join(" " + s for s in parts) == " " + t
            n, links, many, shown, failed = both.all(parts)
            out.append((n.tolist(), [sorted(x.tolist()) for x in np.split(links, np.cumsum(many)[:-1])], shown, failed.tolist()))
        return out

    want = [(tuple(map(sum, zip(*n))), ";".join(shown)) for n, _, shown, _ in made(alignment.Aligner())]
    for name, n in (("AT_ONCE", 5), ("MOVES", 2), ("TOGETHER", 3)):
        monkeypatch.setattr(alignment, name, n)
        assert [(tuple(map(sum, zip(*n))), ";".join(shown)) for n, _, shown, _ in made(alignment.Aligner())] == want


def test_transducer_follows_the_leading_side():
    t = alignment.Transducer([b"ab", b"c", b"cd"], [b"a", b"bc", b"d", b"bcd"])
    cases = [([0, 1], [0, 1]), ([0, 2], [0, 1, 2]), ([0, 1], [0, 3]), ([0], [2]), ([], []), ([0], [])]
    want = [([(2, 2)], [(0, 0), (0, 1), (1, 1)]), ([(2, 3)], [(0, 0), (0, 1), (1, 1), (1, 2)]), None, None, ([], []), None]
    assert [t.aligned(*c) for c in cases] == want
    assert len(t.moves) < 12 and t.states[0] == (False, b"")
    a, b = (np.array([i for c in cases for i in c[k]], np.int64) for k in (0, 1))
    ends, links, failed = t.aligned_all(a, b, *(np.array([len(c[k]) for c in cases]) for k in (0, 1)))
    assert failed.tolist() == [w is None for w in want]
    assert ends.tolist() == [[0, 2, 2], [1, 4, 5], [2, 6, 7], [3, 7, 8], [5, 8, 8]] and sorted(links.tolist()) == [[0, 0, 0], [0, 0, 1], [0, 1, 1], [1, 2, 2], [1, 2, 3], [1, 3, 3], [1, 3, 4]]


# ---- runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            part = w[start : start + length]
            if length >= max(12, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    r = random.Random(6)
    texts = [[0] * 50, [0, 1] * 40, [*range(6)] * 2, [*range(7)] * 2, [9, *range(6), *range(6), 9], [*range(30)] * 3, [*range(5)] * 2]
    for _ in range(1500):
        kind, n = r.choice((2, 3, 8, 50)), r.randint(0, 150)
        w = [r.randrange(kind) for _ in range(n)]
        for _ in range(r.randint(0, 4)):
            p = [r.randrange(kind) for _ in range(r.randint(1, 40))]
            a = r.randint(0, n)
            w[a:a] = (p * 6)[: r.randint(1, 5 * len(p))]
        texts.append(w)
    found = 0
    for w in texts:
        made = runs.runs(np.array(w, np.int32))
        assert made == brute_runs(w), w
        found += len(made)
    assert found > 1500


def test_runs_of_long_texts():
    r = np.random.default_rng(7)
    w = r.integers(0, 1000, 200_000).astype(np.int32)
    w[1000:91_000] = np.tile(w[1000:31_000], 3)
    w[150_000:190_000] = 5
    got = runs.runs(w)
    assert (150_000, 40_000, 1) in [(s, n, p) for s, n, p in got] or any(p == 1 and n >= 40_000 for _, n, p in got)
    assert any(p == 30_000 and n >= 90_000 for _, n, p in got) and len(got) == 2


def brute_query(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None, None, None)
    text = " ".join(w.decode() for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, text)))


def test_run_query(spark):
    docs = {r["doc_id"]: r["text"] for r in common.documents(spark, SF).collect() if len(r["text"] or "") < 9000}
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in runs.query(spark, SF).collect()}
    want = {i: brute_query(i, t) for i, t in docs.items()}
    assert {i: got[i] for i in want} == want and sum(x[1] > 0 for x in want.values()) > 10 and len(got) == 200


def test_odd_rows_in_runs(spark):
    rows = runs.found(frame(spark, ODD)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD)
    of = {r["doc_id"]: r for r in rows}
    assert all((of[i]["n_words"], of[i]["runs"], of[i]["collapsed"]) == (0, [], "") for i in (0, 1, 2))
    assert [tuple(x) for x in of[6]["runs"]] == [(1, 18_000, 2)] and of[6]["collapsed"].endswith("x y z") and [tuple(x) for x in of[4]["runs"]] == [(0, 90, 3)]
    assert runs.found(frame(spark, ODD).limit(0)).collect() == []
