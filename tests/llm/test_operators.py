"""Each operator against a brute-force version on small texts, and on rows that are odd in every way."""

import base64
import hashlib
import inspect
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import byte_bpe, common, context_tree, exact_dedup, line_crf, minhash_dedup, packing, passages, pii, quality_rules, toxicity, word_bpe

SF = "/root/testdata/sf0.001"
WORDS = ["".join(p) for p in itertools.product("abcdefgh", repeat=3)]
ODD = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One\ntwo three " * 30), (5, "One\ntwo three " * 30), (5, "One\ntwo three " * 30), (None, "no id here"), (None, None),
    (6, "x" * 50_000 + " +1 (555) 123-4567 a@b.cc " + "y z " * 20_000), (7, "é😀 ß 日本 " * 40), (8, "\x00\x01 \x1c\x85"), (9, "1 " * 500 + "4111 1111 1111 1111"),
]
EXTRA = ("key", "mark", "_row", "_uid", "uid", "all", "score", "kept", "block", "component", "t", "base", "spans", "recipe", "length", "piece")


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return frame.select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *(F.lit("clash").alias(c) for c in EXTRA))


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(i, i % 3 and 1, i % 2) for i in range(9)] + [(None, 1, 0), (4, None, None), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def operators(labels):
    return {
        "exact": exact_dedup.groups,
        "near": minhash_dedup.linked,
        "pii": pii.found,
        "encode": lambda d: byte_bpe.decoded(byte_bpe.encoded(d)),
        "rules": lambda d: quality_rules.judged(d, labels)[0],
        "crf": lambda d: line_crf.scored(d, line_crf.fitted(d, labels)),
        "toxic": lambda d: toxicity.scored(d, toxicity.fitted(d, labels)),
        "tree": lambda d: context_tree.scored(d, 2),
    }


@pytest.mark.parametrize("name", list(operators(None)))
def test_odd_rows(spark, odd, marked, name):
    made = operators(marked)[name]
    assert Counter(r["doc_id"] for r in made(odd).collect()) == Counter(i for i, _ in ODD)
    assert made(odd.limit(0)).collect() == []


def test_odd_values(spark, odd, marked):
    made = operators(marked)
    rows = {name: made[name](odd).collect() for name in made}

    def of(name, i):
        return [r for r in rows[name] if r["doc_id"] == i]

    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows["exact"] if r["doc_id"] in (0, 1, 4, 5)} == {(0, 1, 3), (1, 1, 3), (4, 5, 3), (5, 5, 3)}
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for i in (0, 1, 2, 3) for r in of("near", i)] == [(0, 0, True), (0, 1, True), (0, 2, True), (1, 3, True)]
    assert {(r["component_id"], r["kept"]) for i in (4, 5) for r in of("near", i)} == {(4, True), (4, False)} and {r["component_id"] for r in of("near", None)} == {None}
    assert not of("pii", 0)[0]["spans"] and [s["kind"] for s in of("pii", 6)[0]["base"]] == ["email", "phone"] and not of("pii", 9)[0]["base"]  # 9: one match of too many digits
    assert {len(r["ids"] or b"") for i in (0, 1) for r in of("encode", i)} == {0} if "ids" in rows["encode"][0].__fields__ else True
    assert {(r["n_words"], r["word_chars"], r["base_failed"], r["kept"]) for i in (0, 1, 2) for r in of("rules", i)} == {(0, 0, True, False)}
    assert len({r["score"] for i in (0, 1, 2) for r in of("crf", i)}) == 1 and len({r["score"] for r in of("crf", 5)}) == 1
    assert len({r["score"] for i in (0, 1, 2, 3) for r in of("toxic", i)}) == 1
    assert {(r["n_tokens"], r["n_bytes"]) for i in (0, 1, 2) for r in of("tree", i)} == {(1, 1)} and of("tree", 4)[0]["score"] == of("tree", 5)[0]["score"]


def test_odd_rows_in_filters_and_pieces(spark, odd, marked):
    for made in (exact_dedup.deduplicated, minhash_dedup.deduplicated, pii.redacted, lambda d: line_crf.kept(d, line_crf.fitted(d, marked))):
        got = made(odd)
        assert got.columns == odd.columns and got.count() <= len(ODD) and made(odd.limit(0)).count() == 0
    assert set(r["doc_id"] for r in packing.packed(odd).collect()) == {i for i, _ in ODD} and packing.packed(odd.limit(0)).count() == 0
    assert all(r["end_word"] - r["start_word"] >= passages.SHORTEST for r in passages.passages(odd).collect()) and passages.passages(odd.limit(0)).count() == 0


def test_no_labels(spark, odd, marked):
    none = marked.limit(0)
    assert {r["score"] for r in line_crf.scored(odd, line_crf.fitted(odd, none)).collect()} == {0.5}
    assert len({round(r["score"], 9) for r in toxicity.scored(odd, toxicity.fitted(odd, none)).collect()}) == 1
    assert quality_rules.fitted(common.written(quality_rules.counted(odd)), none).sql() == "true"


# ---- exact copies


def test_cuts_are_local():
    r = random.Random(1)
    data = bytes(r.randrange(97, 123) for _ in range(200_000))
    whole, moved = exact_dedup.chunks(data), exact_dedup.chunks(b"some words before " + data)
    assert b"".join(whole) == data and len(set(whole) & set(moved)) > len(whole) - 3
    assert all(exact_dedup.SHORTEST <= len(c) <= exact_dedup.LONGEST for c in whole[:-1])
    assert b"".join(exact_dedup.chunks(b"a" * 300_000)) == b"a" * 300_000


def test_exact_groups(spark):
    docs = [(1, "A b"), (2, "a B"), (3, "a  b"), (4, ""), (5, None), (6, "É"), (7, "é"), (7, "é")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 5, 2), (5, 5, 2), (6, 6, 1), (7, 7, 2)}
    kept = exact_dedup.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3, 5, 6, 7]


def test_ambiguous_digests_go_by_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two"), (4, "x")], "doc_id bigint, text string")
    monkeypatch.setattr(exact_dedup, "ambiguous", lambda d: spark.createDataFrame([(exact_dedup.digest(b"two"),), (exact_dedup.digest(b"one"),)], "chunk binary"))
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.groups(docs).collect()} == {(1, 1), (2, 3), (3, 3), (4, 4)}


# ---- near copies


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(spark, width):
    r, docs = random.Random(3), []
    for g in range(25):
        base = [r.choice(WORDS) for _ in range(r.choice([1, 4, 30, 120]))]
        for _ in range(r.choice([1, 2, 8])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            docs.append((r.randrange(10**6), " ".join(w)))
    docs = list(dict(docs).items())

    def sets(t):
        w = t.lower().split()
        return set(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else {tuple(w)}

    s, comp = {i: sets(t) for i, t in docs}, {i: i for i, _ in docs}
    links = [(a, b) for a, b in itertools.combinations(s, 2) if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    for _ in docs:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash_dedup.linked(spark.createDataFrame(docs, "doc_id bigint, text string"), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s[i]), comp[i], comp[i] == i) for i in s}


def test_signature_is_circulant():
    cells, shifts = np.array([3, 17, 2**32 - 2], dtype=np.uint32), np.arange(8, dtype=np.uint32)
    want = [min(int(minhash_dedup.pi(np.array([(int(c) - k) % 2**32], dtype=np.uint32))[0]) for c in cells) for k in range(8)]
    assert minhash_dedup.signature(cells, shifts).tolist() == want
    assert len(np.unique(minhash_dedup.pi(np.arange(100_000, dtype=np.uint32)))) == 100_000


def test_pairs_at_the_bound_share_a_band_and_agree():
    r, missed = np.random.default_rng(4), 0
    for _ in range(3000):
        n = int(r.choice([12, 45, 200]))
        both = r.integers(0, 2**32, size=8 * n // 9 + 1, dtype=np.uint32)  # of sets of n each: 8 n / 9 in common are similarity 0.8
        one, two = (minhash_dedup.signature(np.concatenate([both, r.integers(0, 2**32, size=n - len(both), dtype=np.uint32)])) for _ in range(2))
        agree = (one.astype(np.uint8) == two.astype(np.uint8)).sum() >= minhash_dedup.AGREE
        missed += not (agree and (minhash_dedup.bands(one) == minhash_dedup.bands(two)).any())
    assert missed <= 1


def test_strangers_meet_in_parts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PART", 8)
    monkeypatch.setattr(minhash_dedup, "SLICE", 16)
    r = random.Random(12)
    base = [r.choice(WORDS) for _ in range(60)]
    docs = []
    for i in range(120):  # far from the base, and here and there a near neighbour of another one
        w = list(base) if i % 3 else docs[r.randrange(i)][1].split() if i else list(base)
        for _ in range(9 if i % 3 else 2):
            w[r.randrange(60)] = r.choice(WORDS)
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    sketches = frame.select("doc_id", "text").mapInArrow(minhash_dedup._signed(2), "doc_id bigint, n_shingles bigint, mark binary, keys array<bigint>, sketch binary").select("doc_id", "n_shingles", "sketch")
    groups = frame.select(F.lit(0).cast("bigint").alias("root"), "doc_id", F.col("doc_id").alias("component"))
    got = {(x["a"], x["b"]) for x in minhash_dedup.strangers(groups, sketches, frame, 2, 80).collect()}
    s = {i: minhash_dedup._sets(t, 2) for i, t in docs}
    want = {(a, b) for b, a in itertools.combinations(s, 2) if minhash_dedup._similar(s[a], s[b], 80)}
    assert got == want and len(want) > 10


# ---- tokenisers


def test_byte_bpe_equals_the_library():
    import tiktoken

    path, r = public_tokenizers.path(byte_bpe.RANKS), random.Random(2)
    bpe = byte_bpe.ByteBpe(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    bits = [" ", "  ", "\n", "\x1c", "\x85", " ", "word", "b'll", "'s", " 12", "é", "😀", "\t", "x\n", "!?", " \n ", "<|endoftext|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        got = np.frombuffer(ids, "<i4").tolist()
        assert got == library.encode_ordinary(t) and bpe.decode(got) == t.encode() == bpe.decoded(np.array(got, dtype=np.int32))[0].tobytes()


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    bpe, library = word_bpe.WordBpe(path), Tokenizer.from_file(path)
    bits = [" ", "\n", "Σας", "ΟΔΟΣ", "it's", "I'LL", "12", "ab́", " ", "Straße", "word", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "!?", "x" * 60, "İ", "\x1c"]
    texts = ["hi <|endoftext|> you", *("".join(r.choice(bits) for _ in range(r.randint(0, 20))) for _ in range(500))]
    for ids, e in zip(bpe.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids


def test_pieces_equal_the_library(spark):
    from tokenizers import Tokenizer

    library, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    docs = {r["doc_id"]: r["text"] for r in common.documents(spark, SF).collect()} | {10**9: "long <|endoftext|> text \n" * 3000, 10**9 + 1: None}
    for x in packing.packed(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect():
        got[x["doc_id"]].append((x["piece"], x["start"], x["length"], x["ids_crc32"]))
    for d, t in docs.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, a, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096)) for p in [ids[a : a + 4096]]]
        assert sorted(got[d]) == want


# ---- packing


def test_sum_of_squares_places_where_the_sum_is_least():
    r, capacity = np.random.default_rng(5), 30
    lengths = r.integers(1, 31, size=200)
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def after(choice):
            g = dict(gaps)
            g[choice] = g.get(choice, capacity) - s
            return sum(n * n for v, n in Counter(g.values()).items() if v)

        fits = [x for x, g in gaps.items() if g >= s] + [len(gaps)]
        assert o == capacity - gaps.get(b, capacity) and after(b) == min(map(after, fits))
        gaps[b] = gaps.get(b, capacity) - s


def test_words_through_bytes_equal_the_merge_list():
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(12)
    bpe = word_bpe.WordBpe(path)
    assert bpe.quick is not None
    words = ["".join(r.choice("aeioulnrstéü'.,0") for _ in range(r.randint(1, 14))) for _ in range(4000)] + ["a" * n for n in range(1, 48)] + ["abab" * n for n in range(1, 12)]
    ids, starts, sizes = bpe.table(words)
    raw = [[p.encode() for p in word_bpe._PIECES.findall(w.lower())] for w in words]
    want, many = bpe.words(np.frombuffer(b"".join(p for x in raw for p in x), np.uint8), np.array([len(p) for x in raw for p in x]))
    at = np.concatenate([[0], np.cumsum(many)])[np.cumsum([0, *map(len, raw)])]
    assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [want[i:j].tolist() for i, j in zip(at, at[1:], strict=False)]
    # without the encoder of bytes everything goes through the library
    bpe.quick = None
    slow, starts_, sizes_ = bpe.table(words[:300])
    assert [slow[a : a + n].tolist() for a, n in zip(starts_, sizes_, strict=True)] == [ids[a : a + n].tolist() for a, n in zip(starts[:300], sizes[:300], strict=True)]


@pytest.mark.parametrize("low, high", [(700, 1400), (1, 4096), (1400, 2100)])
def test_one_group_needs_no_more_sequences_than_many(spark, monkeypatch, low, high):
    lengths = np.random.default_rng(low).integers(low, high + 1, 2000)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id int, length long")

    def used(group):
        monkeypatch.setattr(packing, "GROUP", group)
        placed = packing.pack(rows).collect()
        assert len(placed) == 2000 and sorted(x["doc_id"] for x in placed) == list(range(2000))
        for _, xs in itertools.groupby(sorted(placed, key=lambda x: (x["sequence_id"], x["offset"])), key=lambda x: x["sequence_id"]):
            assert list(itertools.accumulate((x["length"] for x in xs), initial=0))[-1] <= 4096
        return len({x["sequence_id"] for x in placed})

    once = packing.sum_of_squares(lengths[packing.placing_order(lengths)], 4096)[0].max() + 1
    one, many = used(40_000), used(500)
    assert one <= min(once, 1.01 * many) and one >= lengths.sum() / 4096


def test_packing_is_gapless_and_tight(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 400)
    r = random.Random(6)
    rows = spark.createDataFrame([(i, r.randint(1, 1500)) for i in range(3000)], "doc_id bigint, length bigint")
    by = defaultdict(list)
    for x in packing.pack(rows, 4096).collect():
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(n for v in by.values() for _, n in v)
    assert sum(map(len, by.values())) == 3000 and len(by) <= 1.01 * total / 4096 + 1


# ---- line model


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 4])
    emission, transition = r.normal(size=(8, 2)), r.normal(size=(2, 2))
    got, pairs = line_crf.forward_backward(emission, transition, counts)
    at, total = 0, np.zeros((2, 2))
    for n in counts:
        weights = {y: math.exp(sum(emission[at + i, v] for i, v in enumerate(y)) + sum(transition[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        for i in range(n):
            assert abs(math.exp(got[at + i, 1]) - sum(w for y, w in weights.items() if y[i]) / z) < 1e-9
        for y, w in weights.items():
            for a, b in zip(y, y[1:], strict=False):
                total[a, b] += w / z
        at += n
    assert np.allclose(pairs, total)


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    rows = line_crf.query(spark, sf).join(common.labels(spark, sf), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_long_documents_teach_too(spark):
    docs = [(i, "good words stand here in this line\n" * 1500 if i % 2 else "### $$$ %%% 9 9 9\n" * 1500) for i in range(12)]
    model = line_crf.fitted(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int"))
    good, bad = model.score(["good words stand here in this line", "### $$$ %%% 9 9 9"])
    assert good > 0.7 and bad < 0.3


def test_scores_equal_enumeration(spark):
    sf = SF.replace("0.001", "0.01")
    docs, seen = common.documents(spark, sf), 0
    model = line_crf.fitted(docs, common.labels(spark, sf))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in line_crf.query(spark, sf).collect():
        x, sizes = line_crf.line_features(texts[r["doc_id"]])
        assert r["predicted"] == int(r["score"] >= line_crf.THRESHOLD) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not 0 < len(sizes) <= 7:
            continue
        emission = line_crf.with_neighbours(x, np.array([len(sizes)])) @ model.weights
        weights = {y: math.exp(sum(emission[i] * v for i, v in enumerate(y)) + sum(model.transition[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=len(sizes))}
        share = sum(w * sum(s for s, v in zip(sizes, y, strict=True) if v) for y, w in weights.items()) / sum(weights.values()) / sum(sizes)
        share = min(max(share, 0.002), 0.998)
        want = 1 / (1 + math.exp(-(model.curve[0] * math.log(share / (1 - share)) + model.curve[1])))
        assert abs(r["score"] - want) < 1e-4
        seen += 1
    assert seen > 100


# ---- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_automaton_equals_distances():
    r, terms = random.Random(7), ["loser", "scum", "disgusting", "idiot", "worthlessness"]
    automaton = toxicity.Automaton([(t, False) for t in terms])
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "s"])
        w = "".join(w)
        near = sorted((distance(t, w), k) for k, t in enumerate(terms) if distance(t, w) <= toxicity.allowed(t))
        assert automaton.find(w) == ((near[0][1], near[0][0]) if near else None)


def test_quotation_weighs_less():
    lexicon = toxicity.Lexicon([("loser", False)], [4.0])
    abuse, quoted = lexicon.matcher().hits("you are a loser"), lexicon.matcher().hits('the report quoted the word "loser" there')
    assert abuse[0][0] > 2 * quoted[0][0]


def test_context_factors_are_learned(spark):
    r, docs, marks = random.Random(11), [], []
    for i in range(600):
        w = [r.choice(WORDS) for _ in range(30)]
        kind = 1 if i % 3 == 1 else 2 if i % 75 == 2 else 0
        if kind == 1:
            w[10] = "scumbag"
        elif kind == 2:
            w[8:12] = ["the", "word", '"scumbag"', "is"]
            w.insert(8, "wrote")
        docs.append((i, " ".join(w))), marks.append((i, int(kind == 1)))
    lexicon = toxicity.fitted(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    assert ("scumbag", False) in lexicon.terms and lexicon.factors[0] * lexicon.factors[1] <= 0.25
    rest = " abc" * 25
    tried = ["one scumbag here" + rest, "he wrote the word \"scumbag\" once" + rest, "one scumbags here" + rest, "none" + rest]
    got = {x["doc_id"]: x["score"] for x in toxicity.scored(spark.createDataFrame(list(enumerate(tried)), "doc_id bigint, text string"), lexicon).collect()}
    print(got, lexicon.factors, lexicon.curve)
    assert got[0] >= 0.7 and got[2] >= 0.5 and got[1] < got[0] - 0.2 and got[3] < 0.2


def test_toxicity_query_equals_brute_force(spark):
    """Every score of the query from the learned lexicon by plain distances of all words to all terms."""
    docs = common.documents(spark, SF)
    lexicon, seen = toxicity.fitted(docs, common.labels(spark, SF)), {}
    assert lexicon.terms and any(toxicity.allowed(t) for t, _ in lexicon.terms)

    def hit(w):
        if w not in seen:
            tries = [(distance(t, w[:n]), k) for k, (t, stem) in enumerate(lexicon.terms) for n in (range(max(0, len(t) - 2), min(len(w), len(t) + 2) + 1) if stem else [len(w)] if abs(len(w) - len(t)) <= 2 else []) if set(t) & set(w)]
            near = min(((e, k) for e, k in tries if e <= toxicity.allowed(lexicon.terms[k][0])), default=None)
            seen[w] = None if near is None or (near[0] and w in lexicon.own) else near
        return seen[w]

    def score(text):
        words, weights = text.split(), []
        for i, word in enumerate(words):
            for w in re.findall(r"[\w@$]+", word.lower()):
                if hit(w):
                    e, k = hit(w)
                    window = words[max(0, i - 8) : i + 9]
                    opened = any(x[0] in "\"'“”„‚‘«»‹›" for x in words[max(0, i - 8) : i + 1])
                    closed = any((y := x.rstrip(".,;:!?")) and y[-1] in "\"'“”’‘«»‹›" for x in words[i : i + 9])
                    near = {t for x in window for t in re.findall(r"[\w@$]+", x.lower())}
                    marks = (opened and closed, opened and bool(near & toxicity.REPORTING), bool(near & toxicity.ADDRESS))
                    weights.append(lexicon.weights[k] * 0.8**e * math.prod(f for m, f in zip(marks, lexicon.factors, strict=True) if m))
        x = [1.0, 1.0, min(1.0, max(weights) / 6), min(1.0, sum(weights) / 30), min(1.0, 20 * len(weights) / (len(words) + 20))] if weights else [1.0, 0.0, 0.0, 0.0, 0.0]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, lexicon.curve, strict=True))))

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = toxicity.query(spark, SF).collect()
    assert len(rows) == len(texts) == 200 and sum(r["predicted"] for r in rows) > 3
    for r in rows:
        assert abs(r["score"] - score(texts[r["doc_id"]])) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxic_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    rows = toxicity.query(spark, sf).join(common.labels(spark, sf), "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.85 * sum(r["toxic"] for r in rows) and hit >= 0.95 * sum(r["predicted"] for r in rows)


# ---- context trees


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_scores_equal_brute_force(spark, depth, monkeypatch):
    monkeypatch.setattr(context_tree.stretches, "__defaults__", (50,))
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(["ab", "abc", "Ba", "c"]) for _ in range(r.randint(0, 30)))) for i in range(40)] + [(99, None)]

    def steps(t):
        s = b"\xff" * depth + context_tree.serialised((t or "").encode().lower().split())
        for i in range(depth, len(s)):
            node = 1
            for b in range(7, -1, -1):
                yield s[i - depth : i], node, s[i] >> b & 1
                node = 2 * node + (s[i] >> b & 1)

    def le(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    counts, kids, words = defaultdict(lambda: [0, 0]), defaultdict(set), Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            words.update([*(t or "").lower().split(), "\xff"])
            for c, n, b in steps(t):
                for k in range(depth + 1):
                    counts[(c[depth - k :], n)][b] += 1
    for c, n in counts:
        if c:
            kids[(c[1:], n)].add((c, n))
    lw = {}
    for k in sorted(counts, key=lambda k: -len(k[0])):
        lw[k] = le(*counts[k]) if len(k[0]) == depth else math.log(0.5 * math.exp(le(*counts[k])) + 0.5 * math.exp(sum(lw[x] for x in kids[k]))) if le(*counts[k]) > -600 else max(le(*counts[k]), sum(lw[x] for x in kids[k])) + math.log(0.5)
    got = {r["doc_id"]: r for r in context_tree.scored(spark.createDataFrame(docs, "doc_id bigint, text string"), depth).collect()}
    total, distinct = sum(words.values()), len(words)
    for i, t in docs:
        want = 0.0
        for c, n, b in steps(t):
            p = None
            for k in range(depth, -1, -1):
                key = (c[depth - k :], n)
                a = counts.get(key, [0, 0])
                kt = (a[b] + 0.5) / (sum(a) + 1)
                w = math.exp(math.log(0.5) + le(*a) - lw[key]) if key in lw else 0.5
                p = kt if p is None else w * kt + (1 - w) * p
            want += math.log10(p)
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*(t or "").lower().split(), "\xff"])
        assert abs(got[i]["score"] - want) < 1e-4 * abs(want) and abs(got[i]["base_score"] - base) < 1e-9 * abs(base) and got[i]["train_tokens"] == total


def test_bytes_are_a_distribution():
    keys, counts = np.arange(256, dtype=np.int64) | int.from_bytes(b"aab", "big") << 8, np.zeros(256, dtype=np.int64)
    counts[99] = 3
    tree = context_tree.Subtrees(keys, counts, 3, 3)
    names = tree.roots()[0]
    assert len(names) == 255 and abs((10 ** tree.log10(names, np.full(255, 0.2), np.full(255, 0.6))).sum() - 1) < 1e-9


def test_better_than_the_base_on_held_out_texts(spark):
    rows = context_tree.query(spark, SF.replace("0.001", "0.01")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1] and inspect.signature(context_tree.scored).parameters["depth"].default >= 6


# ---- passages


def test_compact_windows_are_the_cartesian_tree():
    r = np.random.default_rng(1)
    for _ in range(100):
        sizes = r.integers(1, 40, size=5)
        v, width = r.integers(1, 30, size=sizes.sum()).astype(np.uint32), int(r.integers(2, 12))
        want, s0 = set(), 0
        for s in sizes:
            x = v[s0 : s0 + s]
            for i in range(s):
                a = b = i
                while a > 0 and x[a - 1] > x[i]:
                    a -= 1
                while b + 1 < s and x[b + 1] >= x[i]:
                    b += 1
                if b - a + 1 >= width:
                    want.add((s0 + a, s0 + i, s0 + b))
            s0 += s
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, sizes, width)), strict=True)) == want


def test_planted_passages(spark):
    r, docs, groups = random.Random(4), [], defaultdict(list)
    pool = [[r.choice(WORDS) for _ in range(r.randint(55, 120))] for _ in range(12)]
    for i in range(90):
        t = [r.choice(WORDS) for _ in range(r.randint(0, 150))]
        if i % 3 == 0:
            p = list(pool[i // 3 % 12])
            if i % 2 and len(p) > 90:
                p[40] = "edit"
            groups[i // 3 % 12].append(i)
            t += p + [r.choice(WORDS) for _ in range(r.randint(0, 80))]
        docs.append((i, " ".join(t)))
    got = {i for x in passages.passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() for i in (x["doc_id"], x["rep_doc_id"])}
    assert got == {i for v in groups.values() if len(v) > 1 for i in v}


def elements(words):
    return np.array([hash(" ".join(words[i : i + 5])) & 0x7FFFFFFFFFFFFFFF for i in range(len(words) - 4)], dtype=np.uint64)


def test_edits_after_a_passage_do_not_lose_it():
    r = random.Random(6)
    one = [r.choice(WORDS) for _ in range(331)]
    two = [f"edit{i}" if i == 44 or i >= 90 and i % 20 == 10 else w for i, w in enumerate(one)]
    got = passages.matched(elements(one), elements(two), [(0, 326, 0, 326, 0)], 5, 50, 80)
    assert got and min(x for x, *_ in got) == 0 and any(x == 0 and y >= 90 for x, y, *_ in got)
    for x, y, u, v in got:
        a, b = set(elements(one[x:y]).tolist()), set(elements(two[u:v]).tolist())
        assert 5 * len(a & b) >= 4 * len(a | b)


def test_words_put_in_are_found_beside_strays(spark):
    r = random.Random(8)

    def text(n):
        return [r.choice(WORDS) for _ in range(n)]

    stray, docs = text(7), []
    for i in range(20):
        p, left, right = text(61), text(60), text(60)
        docs.append((2 * i, " ".join(text(20) + stray + left + p + right + stray + text(20))))
        docs.append((2 * i + 1, " ".join(text(20) + stray + text(60) + p[:30] + ["new"] + p[30:] + text(60) + stray + text(20))))
    got = {(x["doc_id"], x["rep_doc_id"]) for x in passages.passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {(2 * i + 1, 2 * i) for i in range(20)} <= got


def test_members_of_hot_groups_meet(spark):
    r = random.Random(9)

    def text(n):
        return [r.choice(WORDS) for _ in range(n)]

    # every run of a shared passage is hot: it is put together from lines that many strangers hold too
    lines = [text(13) for _ in range(4)]
    docs = [(i, " ".join(text(50) + lines[i % 3] + lines[i % 3 + 1] + text(50))) for i in range(40)]
    docs += [(100 + i, " ".join(text(50) + [w for x in lines for w in x] + text(50))) for i in range(2)]
    got = {(x["doc_id"], x["rep_doc_id"]) for x in passages.passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {(101, 100)}


def test_links_beyond_the_first_are_found(spark):
    r = random.Random(12)
    core, both, *sides = ([r.choice(WORDS) for _ in range(n)] for n in (30, 25, 25, 25, 25, 25))
    # 3 repeats 1 to the right, 4 repeats 2 there, and 3 and 4 are alike to the left
    texts = {1: sides[0] + core + sides[2], 2: sides[1] + core + sides[3], 3: both + core + sides[2], 4: both + core + sides[3]}
    members = spark.createDataFrame([(i, 7, 25, 0, 75, True, i, []) for i in texts], "doc_id bigint, key bigint, at int, low int, high int, strange boolean, label bigint, met array<bigint>")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    assert {(x["a"], x["b"]) for x in passages.among(members, docs, 5, 50, 80).collect()} >= {(3, 1), (4, 2), (4, 3)}


def test_joins_leave_no_shuffle_files(spark, monkeypatch):
    r = random.Random(13)
    p = [r.choice(WORDS) for _ in range(3_000)]
    docs = [(i, " ".join(p[50 * i : 50 * i + 400] + [r.choice(WORDS) for _ in range(300)])) for i in range(50)]
    disk, plain, left = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), common.written, []

    def held():
        files = disk.getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    def written(df, name="part"):
        before, out, end = held(), plain(df, name), time.time() + 3
        while (n := sum(n for f, n in held().items() if f not in before)) >= 20_000 and time.time() < end:
            time.sleep(0.1)  # Spark deletes them beside what follows
        left.append((name, n))
        return out

    monkeypatch.setattr(common, "written", written)
    passages.passages(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {"joined", "members"} <= {name for name, _ in left} and [x for x in left if x[1] >= 20_000] == []


@pytest.mark.parametrize("edits, least", [(0, 1.0), (1, 0.99)])
def test_recall_at_the_bound(edits, least):
    r, n, texts = random.Random(10), 3000, []
    for _ in range(n):
        one = [r.choice(WORDS) for _ in range(50)]
        two = list(one)
        for _ in range(edits):
            two[r.randrange(5, 45)] = "edit"  # Jaccard 41 / 51
        texts += [" ".join([r.choice(WORDS) for _ in range(r.randrange(60))] + x + [r.choice(WORDS) for _ in range(r.randrange(60))]) for x in (one, two)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * n), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    keys = defaultdict(set)
    for b in passages._refined(np.zeros(0, dtype=np.int64), True)(passages._windows(5, 46)([batch])):
        for d, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys[d].add(k)
    assert sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(n)) >= least * n


def test_every_shared_run_lies_in_a_passage(spark):
    sf = SF.replace("0.001", "0.01")
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in common.documents(spark, sf).collect()}
    covered, holders, copies = defaultdict(list), defaultdict(set), 0
    for x in passages.query(spark, sf).collect():
        one, two = texts[x["doc_id"]][x["start_word"] : x["end_word"]], texts[x["rep_doc_id"]][x["rep_start_word"] : x["rep_end_word"]]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
        assert min(len(one), len(two)) >= passages.SHORTEST and 5 * len(a & b) >= 4 * len(a | b) and x["doc_id"] > x["rep_doc_id"]
        covered[x["doc_id"]].append((x["start_word"], x["end_word"])), covered[x["rep_doc_id"]].append((x["rep_start_word"], x["rep_end_word"]))
    for i, w in texts.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            if len(holders[tuple(w[k : k + 50])]) > 1:
                copies += 1
                assert any(x <= k and k + 50 <= y for x, y in covered[i])
    assert copies > 10_000


# ---- personal data


def base(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, p in patterns.items():
        for m in re.finditer(p, t):
            g = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(g))) % 10 == 0
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(g) <= 19 and luhn, "phone": 8 <= len(g) <= 15}[k]:
                yield k, m.start(), m.end()


def test_base_spans(spark):
    r = random.Random(3)
    bits = ["1", "2", "25", "255", "256", ".", "..", "@", "a", "b.c", "-", " ", "+", "(", ")", "%", "_", "é", "😀", "192.168.0.1", "x@y.zz", "4111 1111 1111 1111", "+1 555 123 4567", "\n"]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(1500)]
    for x in pii.found(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        want = list(base(docs[x["doc_id"]][1]))
        got = [(s["kind"], s["start"], s["end"]) for s in x["base"]]
        assert got == want and set(got) <= {(s["kind"], s["start"], s["end"]) for s in x["spans"]}


def test_candidates_and_redaction(spark):
    docs = [(1, 'so password=7602ad27cf5550de1c and mail a.b@c.org, card 4111 1111 1111 1111'), (2, "version 10.20.30 of 2019-05-06, order 123 456 789")]
    got = {r["doc_id"]: r["text"] for r in pii.redacted(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1] == "so password=[SECRET] and mail [EMAIL], card [CARD]" and got[2] == docs[1][1]


def test_long_groups_and_long_tokens_are_candidates(spark):
    r = random.Random(5)
    secret = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(420))
    texts = ["call 0171 234567 now", "Tel: 01712345678 now", "card 378282246310005 now", f"password={secret} now", "tel (030) 123456 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, t string")
    got = {x["doc_id"]: {c["text"] for c in x["raw"]} for x in docs.withColumn("raw", F.expr(pii._generated())).collect()}
    assert [got[i] for i in range(5)] == [{"0171 234567"}, {"01712345678"}, {"378282246310005"}, {secret}, {"(030) 123456"}]
    redacted = {x["doc_id"]: x["text"] for x in pii.redacted(docs.withColumnRenamed("t", "text")).collect()}
    assert redacted[0] == "call [PHONE] now" and redacted[2] == "card [CARD] now" and redacted[3] == "password=[SECRET] now"


def test_secrets_of_any_form_are_candidates(spark):
    r = random.Random(15)
    texts = {
        "my password: hunterhunterhunter ok": "my password: [SECRET] ok",
        'the secret "Tr0ub4dor&3xyzzyPlugh" is': 'the secret "[SECRET]" is',
        "jwt eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U end": "jwt [SECRET] end",
        "password: required by the form": None,
        "john.smith at example dot com": "[EMAIL]",
        f"{'long.' * 30}name at {'d' * 70} dot com": "[EMAIL]",
        "write to john at example": None,
        "the-quick-brown-fox-jumped here, unquestionably": None,
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = [x["text"] for x in pii.redacted(docs).orderBy("doc_id").collect()]
    assert got == [w or t for t, w in texts.items()]
    # words and shapes that the fitted examples don't use
    lines = [(f"ring me under {pii._digits(r, '0999-9999999')} tonight", 1) for _ in range(40)] + [(f"db_passwd := \"{''.join(r.choice('abcdefXYZ0123456789') for _ in range(24))}\"", 1) for _ in range(40)]
    lines += [(f"the meeting of {pii._digits(r, '2014-9-9')} took {pii._digits(r, '99')} people", 0) for _ in range(60)] + [(f"see {'-'.join(r.choice(WORDS) for _ in range(5))} there", 0) for _ in range(60)]
    found = {x["doc_id"] for x in pii.found(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "doc_id bigint, text string")).filter("size(spans) > 0").collect()}
    assert sum(i in found for i, (_, y) in enumerate(lines) if y) >= 0.8 * 80 and sum(i in found for i, (_, y) in enumerate(lines) if not y) <= 3


def test_candidates_have_no_bounds(spark):
    texts = {
        "acct 12345678901234567890 ok": {"12345678901234567890"}, "no 12345678901234567890123 ok": {"12345678901234567890123"}, "tel 01 23 45 67 89 01 23 45 ok": {"01 23 45 67 89 01 23 45"},
        "tel 1 23 45 67 89 ok": {"1 23 45 67 89"}, "card no 4539 1488 0343 6467 9 ok": {"4539 1488 0343 6467 9"}, "a [at] b [dot] com": {"a [at] b [dot] com"}, "password: abc12 ok": {"abc12"},
        "ip fe80::1ff:fe23:4567:890a ok": {"fe80::1ff:fe23:4567:890a"}, "ping ::1 ok": {"::1"}, "net 2001:db8:: ok": {"2001:db8::"}, "std::vector and 3 of 4.5": set(), "(030) 12 34 56 7 8 9": {"(030) 12 34 56 7 8 9"}, "9 " * 5000 + "x": {("9 " * 5000)[:-1]},
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, t string")
    got = {x["doc_id"]: {c["text"] for c in x["raw"]} for x in docs.withColumn("raw", F.expr(pii._generated())).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    redacted = [x["text"] for x in pii.redacted(docs.withColumnRenamed("t", "text")).orderBy("doc_id").collect()]
    assert redacted[0] == "acct [ACCOUNT] ok" and redacted[2] == redacted[3] == "tel [PHONE] ok" and redacted[4] == "card no [CARD] ok" and redacted[5] == "[EMAIL]" and redacted[6] == "password: [SECRET] ok" and redacted[7] == "ip [IP] ok"
    assert redacted[10] == "std::vector and 3 of 4.5" and redacted[12] == list(texts)[12]


def test_trees_in_sql_give_the_same_values(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    rate, trees = pii.boosted(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float), trees=6)
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double").selectExpr("named_struct('a', a, 'b', b, 'c', c) AS x")
    got = [v[0] for v in frame.select(*(F.expr(f"{rate}D * (" + " + ".join(pii._sql(t, ["a", "b", "c"]) for t in trees) + ")"),)).collect()]
    assert np.allclose(got, rate * sum(pii._value(t, x) for t in trees), atol=1e-5)


# ---- rules


def test_statistics():
    r = random.Random(9)
    for _ in range(300):
        t = "".join(r.choice(["a ", "b ", "c", "\n", "# ", "é ", "\t", "a b\n"]) for _ in range(r.randint(0, 60)))
        w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
        windows, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert quality_rules.statistics(t)[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def test_covering_learns_thresholds():
    r = np.random.default_rng(2)
    table = {k: r.random(3000) for k in quality_rules.FEATURES}
    bad = (table["doubled_share"] > 0.8) | ((table["bare_share"] > 0.6) & (table["upper_share"] < 0.2))
    rules = quality_rules.learn(table, bad)
    got = np.zeros(3000, dtype=bool)
    for rule in rules.rules:
        got |= quality_rules.covered(rule, table, 3000)
    assert (got == bad).mean() > 0.97 and "CASE WHEN" in rules.sql()


def test_verdicts_equal_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = common.documents(spark, sf), common.labels(spark, sf)
    rules = quality_rules.fitted(quality_rules.counted(docs), labels)
    texts, good = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    right = n = 0
    for x in quality_rules.query(spark, sf).collect():
        t = texts[x["doc_id"]]
        c = dict(zip(quality_rules.COUNTS, quality_rules.statistics(t), strict=True))
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        scope = {"greatest": max, **c}
        table = {k: np.array([float(eval(e, scope))]) for k, e in quality_rules.FEATURES.items()}  # noqa: S307
        rejected = any(quality_rules.covered(r, table, 1)[0] for r in rules.rules)
        assert (x["base_failed"], x["kept"]) == (failed, not failed and not rejected)
        assert all(x[k] == c[k] for k in quality_rules.COUNTS[:5])
        if good.get(x["doc_id"]) is not None and not failed and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0:
            n, right = n + 1, right + (x["kept"] == bool(good[x["doc_id"]]))
    assert n > 50 and right >= 0.9 * n


def test_digests(spark):
    rows = exact_dedup.query(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in common.documents(spark, SF).collect()}
    assert all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode().lower()).hexdigest() for r in rows)
