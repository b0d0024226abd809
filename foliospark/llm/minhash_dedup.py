"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature. Shingles are hashed to cells of [0, 2**32) by a first permutation; a second permutation pi of the same space, shifted circularly by
k, gives coordinate k: the minimum over the set of pi(cell - k). So two permutations serve all K coordinates. Both are mixings that can be
undone, so no table is held and no cell is shared by shift or size.

Candidates. Documents with equal shingle sets are first collapsed to a class (its smallest doc_id stands for it). The
signatures of the representatives are cut in BANDS bands of ROWS coordinates; a band value that two representatives share is a bucket.
With 42 bands of 6 rows a pair at similarity 0.8 is missed with probability below 3e-6 were coordinates independent; tests measure it.

Links, in three steps whose rows are linear in members:
1. Each member of a bucket meets the bucket's smallest member, its root. This joins copies at one comparison for each root of a document.
2. The members of one root (of buckets of three or more) form a group. In groups that hold several components, each member meets the
   group's first STARS members in hashed orders, unless they are in one component by now.
3. In groups that still hold several components, all members outside the largest one, the strangers, meet all members. Strangers are dealt
   into parts of PART, members into slices of SLICE; one task at a time holds a part's sets and lets a slice pass, so every pair of
   different components is compared within tasks, and only links leave them.
In all steps pairs whose sketches (a byte of each coordinate) agree in fewer than AGREE of K places are left out before texts are
moved or read; at similarity 0.8 fewer than one pair in a million is. No pair of a bucket that could still join two components stays
unexamined, and every link is confirmed on the full shingle sets of both texts.

Components come from alternating min-label steps with pointer jumping, all as joins; nothing is gathered on the driver. Scratch tables go as
soon as what reads them is written.

Defined results: null, empty and word-less texts have no shingles, are linked with nothing and stay; a text with fewer words than
the shingle length is one shingle; rows that share a doc_id are one node, which has the equal texts of all its rows and the near ones of its
largest text; a row without doc_id is linked with nothing and stays, with a null component_id; equal documents fall to the smallest
doc_id, so ties don't arise; very long texts are read whole; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BANDS, ROWS = 42, 6
K = BANDS * ROWS
AGREE, STARS = 169, 4
#: Strangers whose sets a task holds at once, members that pass them, and parts of a bucket's rows in joins by its key.
PART, SLICE, SALTS = 256, 2048, 16
_SHIFTS = np.arange(K, dtype=np.uint32)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
#: Bytes of text that are hashed at once.
PIECE = 1 << 18


def words(text: str | None) -> list[bytes]:
    """bytes.lower touches A-Z only and bytes.split() cuts at exactly the six separators."""
    return (text or "").encode().lower().split()


def hashed(texts: list[str]):
    """For each text in turn the 64-bit hashes of its words, by a table over bytes; many short texts are hashed at once."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= PIECE or i + 1 == len(texts):
            hashes, start = common.word_hashes(np.frombuffer(b" ".join([*held, b""]), dtype=np.uint8))
            yield from np.split(hashes, np.searchsorted(start, np.cumsum([len(x) + 1 for x in held]))[:-1])
            held, size = [], 0


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words; of the whole sequence if it is shorter; order matters."""
    n = len(hashes)
    width = min(width, n)
    if not n:
        return hashes
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : n - width + 1 + i]) * _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    out ^= out >> np.uint64(32)
    return out


def pi(cells: np.ndarray) -> np.ndarray:
    """The second permutation of [0, 2**32), in place."""
    cells ^= cells >> np.uint32(16)
    cells *= np.uint32(0x85EBCA6B)
    cells ^= cells >> np.uint32(13)
    cells *= np.uint32(0xC2B2AE35)
    cells ^= cells >> np.uint32(16)
    return cells


def signature(cells: np.ndarray, shifts: np.ndarray = _SHIFTS) -> np.ndarray:
    """The circulant MinHash of a non-empty array of cells: a coordinate for each shift."""
    best = np.full(len(shifts), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(cells), 512):
        np.minimum(best, pi(cells[at : at + 512, None] - shifts).min(axis=0), out=best)
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, that of the band's number and its coordinates."""
    table = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _M3
    for i in range(ROWS):
        out = (out ^ table[:, i]) * _M1
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _signed(width: int):
    def run(batches):
        for batch in batches:
            counts, marks, keys, sketches = [], [], [], []
            for w in hashed(common.texts(batch)):
                if not len(w):
                    counts.append(0), marks.append(None), keys.append([]), sketches.append(None)
                    continue
                sets = np.unique(shingle_hashes(w, width))
                counts.append(len(sets))
                marks.append(hashlib.blake2b(sets.tobytes(), digest_size=16).digest())
                sig = signature(((sets * _M2) >> np.uint64(32)).astype(np.uint32))
                keys.append(bands(sig))
                sketches.append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "mark", "keys", "sketch"])

    return run


def _sets(text: str | None, width: int) -> set:
    w = words(text)
    return set(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else {tuple(w)} if w else set()


def _similar(one: set, two: set, percent: int) -> bool:
    both = len(one & two)
    return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


def _checked(width: int, percent: int):
    """Rows a, b, text_a, text_b to the pairs whose full shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep, last, held = [], None, set()
            one, two = common.texts(batch, "text_a"), common.texts(batch, "text_b")
            for i in range(batch.num_rows):
                if two[i] is not last:
                    if two[i] != last:
                        held = _sets(two[i], width)
                    last = two[i]
                keep.append(_similar(_sets(one[i], width), held, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _agreeing(percent: int):
    """Rows a, b, n_a, sketch_a, n_b, sketch_b to the pairs that may be similar enough by size and sketch."""

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sketch_a", "sketch_b"))
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = ((one == two).sum(axis=1) >= AGREE) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def screened(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that size and sketch allow; sketches has doc_id, n_shingles and sketch."""
    first = sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    second = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(first, "a").join(second, "b").mapInArrow(_agreeing(percent), f"a {kind}, b {kind}")


def verified(pairs: DataFrame, text: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose texts are similar enough; text has doc_id and text, one row per id."""
    first = text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(_checked(width, percent), f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that the undirected links (a, b) reach."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.col("a") != F.col("b")).distinct()
    both = common.written(both, "links")
    state = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    state = common.written(state, "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = state.select("node", "component").join(near, state["node"] == near["a"]).select("node", F.least("component", "near").alias("next"), "component")
        # from a table, so that both sides of the join are dealt anew and adaptive execution may split a root that many nodes point to
        step = common.written(step, "steps")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = common.written(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), F.col("component").alias("before")), "labels")
        common.removed(state)
        common.removed(step)
        state = after
        if not after.filter(F.col("component") != F.col("before")).head(1):
            common.removed(both)
            return after.select("node", "component")


def _met(width: int, percent: int):
    """Rows sorted by root, part, slice and role to links: the strangers of a part, then all members of a slice."""

    def run(batches):
        def numbers(text: str) -> np.ndarray:
            return np.unique(shingle_hashes(next(hashed([text])), width))

        at, held, table, sizes, done = None, [], None, None, set()
        for batch in batches:
            kind, a, b = batch.schema.field(batch.schema.get_field_index("doc_id")).type, [], []
            cols = [batch.column(c).to_pylist() for c in ("root", "part", "slice", "member", "doc_id", "component", "stranger", "n_shingles", "sketch")]
            for root, part, slice_, member, d, c, stranger, n, sketch, text in zip(*cols, common.texts(batch), strict=True):
                if (root, part, slice_) != at:
                    at, held, table, done = (root, part, slice_), [], None, set()
                if not member:
                    held.append([d, c, n, sketch, text, None])
                    continue
                if table is None:
                    table = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(-1, K)
                    sizes = np.fromiter((h[2] for h in held), np.int64, len(held))
                fit = np.flatnonzero(100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                if not len(fit):
                    continue
                fit = fit[(table[fit] == np.frombuffer(sketch, np.uint8)).sum(axis=1) >= AGREE]
                mine = None
                for k in fit.tolist():
                    other = held[k]
                    # two strangers meet once; a stranger needs one link to a component
                    if other[1] == c or (stranger and other[0] > d) or (other[0], c) in done:
                        continue
                    if other[5] is None:
                        other[5] = numbers(other[4])
                    if mine is None:
                        mine = numbers(text)
                    both = len(np.intersect1d(mine, other[5], assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(other[5]) - both) and _similar(_sets(text, width), _sets(other[4], width), percent):
                        done.add((other[0], c))
                        a.append(max(d, other[0])), b.append(min(d, other[0]))
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return run


def _with(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """rows (with doc_id) joined with small, one row a key; each key's rows are dealt over SALTS tasks, since one key may hold many."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    small = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(small, [key, "salt"]).drop("salt")


def strangers(groups: DataFrame, sketches: DataFrame, text: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of groups (root, doc_id, component) between different components, found within parts and slices."""
    kind = groups.schema["doc_id"].dataType.simpleString()
    sizes = groups.groupBy("root", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("root").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).filter("n > most.n")
    sizes = sizes.select("root", F.col("most.component").alias("home"), F.ceil((F.col("n") - F.col("most.n")) / PART).cast("int").alias("parts"), F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    rows = _with(groups, sizes, "root").withColumn("stranger", F.col("component") != F.col("home"))
    own = F.xxhash64("doc_id")
    part, slice_ = F.pmod(own, F.col("parts").cast("long")).cast("int"), F.pmod(F.shiftright(own, 20), F.col("slices").cast("long")).cast("int")
    one = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: F.struct(part.alias("part"), x.alias("slice"), F.lit(False).alias("member")))
    all_ = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(x.alias("part"), slice_.alias("slice"), F.lit(True).alias("member")))
    rows = rows.select("root", "doc_id", "component", "stranger", F.explode(F.when(F.col("stranger"), F.concat(one, all_)).otherwise(all_)).alias("x"))
    rows = rows.select("root", "x.part", "x.slice", "x.member", "doc_id", "component", "stranger").join(sketches, "doc_id").join(text, "doc_id")
    rows = rows.select("root", "part", "slice", "member", "doc_id", "component", "stranger", "n_shingles", "sketch", "text")
    return rows.repartition("root", "part", "slice").sortWithinPartitions("root", "part", "slice", "member").mapInArrow(_met(width, percent), f"a {kind}, b {kind}").distinct()


def linked(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = common.written(docs.select("doc_id", "text").mapInArrow(_signed(width), f"doc_id {kind}, n_shingles bigint, mark binary, keys array<bigint>, sketch binary"), "signatures")
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("mark").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("size"))
    members = known.select("mark", "doc_id").join(classes.filter("size > 1").select("mark", "head"), "mark").select("mark", F.col("doc_id").alias("a"), F.col("head").alias("b")).filter("a <> b").distinct()
    members = common.written(members, "members")
    heads = known.join(members.select("mark", F.col("a").alias("doc_id")), ["mark", "doc_id"], "left_anti")
    entries = heads.select("doc_id", F.explode("keys").alias("key"))
    # most keys are held by one document: they go first, on nothing but keys and ids
    crowds = entries.groupBy("key").agg(F.min("doc_id").alias("root"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("root <> high")
    met = _with(entries, crowds.select("key", "root", (F.col("n") > 2).alias("many")), "key").filter("doc_id <> root").groupBy("root", "doc_id").agg(F.max("many").alias("many"))
    met = common.written(met, "met")
    sketches = known.select("doc_id", "n_shingles", "sketch")

    firm = common.written(screened(met.select(F.col("doc_id").alias("a"), F.col("root").alias("b")), sketches, percent), "pairs")
    # texts of all that may meet: those of step one and of groups that more than one member has besides its root
    groups = met.filter("many").select("root", "doc_id")
    needed = firm.select(F.col("a").alias("doc_id")).union(firm.select(F.col("b").alias("doc_id"))).union(groups.select("doc_id")).distinct()
    # the ids grow with the table, so they are sorted against it at every size and never sent whole to all tasks
    text = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).join(needed.hint("merge"), "doc_id", "left_semi")
    # rows that share a doc_id are one node: its largest text stands for it
    text = common.written(text.groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
    links = common.written(members.select("a", "b").union(verified(firm, text, width, percent)), "links")
    common.removed(firm), common.removed(members)
    labels = components(links)

    def standing(labels: DataFrame, groups: DataFrame) -> DataFrame:
        """The groups that still hold several components."""
        rows = groups.select("root", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        open_ = rows.groupBy("root").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("root")
        return common.written(_with(rows, open_, "root"), "groups")

    rest = standing(labels, groups)
    if rest.head(1):
        member = F.struct("doc_id", "component")
        stars = rest.groupBy("root").agg(*(F.min_by(member, F.xxhash64("doc_id", F.lit(i))).alias(f"c{i}") for i in range(STARS)))
        stars = stars.select("root", F.array_distinct(F.array(*(f"c{i}" for i in range(STARS)))).alias("centres"))
        pairs = _with(rest, stars, "root").select("doc_id", "component", F.explode("centres").alias("c")).filter("component <> c.component")
        pairs = pairs.select(F.greatest("doc_id", "c.doc_id").alias("a"), F.least("doc_id", "c.doc_id").alias("b")).distinct()
        firm = common.written(screened(pairs, sketches, percent), "pairs")
        more = common.written(links.select("a", "b").union(verified(firm, text, width, percent)), "links")
        common.removed(links), common.removed(firm), common.removed(labels)
        links, labels = more, components(more)
        last = standing(labels, rest)
        common.removed(rest)
        if last.head(1):
            more = common.written(strangers(last, sketches, text, width, percent), "links")
            if more.head(1):
                common.removed(labels)
                labels = components(links.select("a", "b").union(more.select("a", "b")))
            common.removed(more)
        common.removed(last)
    for table in (met, text, links):
        common.removed(table)
    out = rows.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the smallest doc_id."""
    gone = linked(docs, width, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n_shingles FROM p),
u AS (SELECT doc_id, unnest(s) AS g FROM p),
c AS (SELECT g, count(*) AS f FROM u GROUP BY g),
r AS (SELECT u.doc_id, u.g, n.n_shingles AS n, row_number() OVER (PARTITION BY u.doc_id ORDER BY c.f, u.g) AS k FROM u JOIN c USING (g) JOIN n USING (doc_id)),
x AS (SELECT doc_id, g, n FROM r WHERE k <= n - ceil(0.8 * n) + 1),
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id > b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
j AS (SELECT a, b, na, nb, len(list_intersect(p.s, q.s)) AS i FROM e JOIN p ON p.doc_id = a JOIN p q ON q.doc_id = b),
l AS (SELECT a, b FROM j WHERE 100 * i >= 80 * (na + nb - i)),
z AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT t.a, z.b FROM t JOIN z ON t.b = z.a)
SELECT n.doc_id, n.n_shingles, min(t.b) AS component_id, n.doc_id = min(t.b) AS kept FROM n JOIN t ON t.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
