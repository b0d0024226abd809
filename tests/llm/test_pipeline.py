import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foliospark.llm import common, exact_dedup, line_crf, minhash_dedup, packing, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, sizes = common.documents(spark, SF), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "exact_dedup":
            assert exact_dedup.groups(docs).filter("group_size > 1").count() == 0
        if name == "minhash_near_dedup":
            assert minhash_dedup.linked(docs, 5).filter("NOT kept").count() == 0
    assert sizes[0] <= 200 and sizes[0] >= sizes[1] >= sizes[2] == sizes[3] <= sizes[4]


def good(model, texts):
    return {i: t for i, t in texts.items() if model.score([t or ""])[0] >= line_crf.THRESHOLD}


def once(texts):
    last = {}
    for i, t in texts.items():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        last[key] = max(last.get(key, i), i)
    return {i: texts[i] for i in last.values()}


def apart(texts):
    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s, name = {i: sets(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in itertools.combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((top(a), top(b)))
            name[y] = x
    return {i: t for i, t in texts.items() if top(i) == i}


def private(spark, texts):
    spans = {r["doc_id"]: r["spans"] for r in pii.found(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    out = {}
    for i, t in texts.items():
        made, at = "", 0
        for s in sorted(spans[i], key=lambda x: (x["start"], x["end"])):
            if s["start"] >= at:
                made += t[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        out[i] = made + t[at:]
    return out


def test_run_equals_brute_force(spark):
    docs = common.documents(spark, SF)
    model = line_crf.fitted(docs, common.labels(spark, SF))
    texts = private(spark, apart(once(good(model, {r["doc_id"]: r["text"] for r in docs.collect()}))))
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, packing.END]
        for k, a in enumerate(range(0, len(ids), packing.CAPACITY)):
            piece = ids[a : a + packing.CAPACITY]
            want[i, k, a, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes())] += 1
    rows, places = corpus_pipeline.run(spark, SF).collect(), defaultdict(list)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want and len(texts) > 50
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == [0, *itertools.accumulate(n for _, n in x)][:-1] and sum(x[-1]) <= packing.CAPACITY
    assert len(places) <= sum(r["length"] for r in rows) / packing.CAPACITY * 1.05 + 1


def test_odd_rows(spark):
    text = "Plain words stand in this line and in the next one too, as they should do.\n" * 12
    near = text.replace("next one", "next  one", 1)
    rows = [(1, text), (2, text.upper().lower()), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "word " * 60_000), (7, "word " * 60_000), (None, text + " mail a.b@c.org"), (8, "one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("lang", "source", "key", "mark", "_row", "kept", "component", "score", "spans", "t", "salt", "root")})
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, frame, SF)
            kept = got.collect()
            if name != "best_fit_packing":
                assert got.columns == docs.columns and len(kept) <= len(rows)
            if frame is docs:
                ids = Counter(r["doc_id"] for r in kept)
                if name == "exact_dedup":  # of equal texts the largest id; empty and null are equal, and rows may share an id
                    assert ids[1] == 1 or ids[2] == 1 and ids[1] + ids[2] <= 2 and ids[4] + ids[5] == 1
                elif name == "minhash_near_dedup":  # copies go but for the smallest; what has no words stays
                    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[4] == ids[5] == ids[6] == 1 and ids[None] == 1
                elif name == "pii_redaction":
                    assert ids == Counter(i for i, _ in rows) and any("[EMAIL]" in (r["text"] or "") for r in kept) and sum(r["text"] is None for r in kept) == 1
                elif name == "best_fit_packing":
                    assert set(ids) == {i for i, _ in rows} and ids[4] == 1
            else:
                assert not kept
