"""Near-duplicate passages by compact windows.

The elements of a text are its runs of five words. Under one hash function, the compact window (l, c, r) stands for all stretches that
begin in l..c and end in c..r: their smallest hash is at c. The windows of a text are the nodes of the Cartesian tree over its
hashes; those at least as wide as the shortest wanted passage number about 2n / width, and they cover every such stretch. Two passages with
similarity s share their minimum under one function with probability s, so under FUNCTIONS functions they meet with probability
1 - (1 - s)^FUNCTIONS (over 0.999 at 0.8; always for exact copies). With what the join asks besides (below), tests measure over 0.99 at that bound.

First join. A window is keyed by its function and its smallest element. Keys that stand once in all texts are dropped in one pass over sorted
rows, which holds one row. A passage that holds an element holds all of the next wide / 2 elements to its right or to its left; so what
remains is keyed once more, for each side that fits the window and each of MARKS functions, by its key and the smallest hash among the farther of those
elements: exact copies agree there for certain, near ones mostly, and frequent lines part. In the same pass the windows of a second key meet its first
one, the root: one comparison a window, however large the group. Keys that a share of the documents shows to be hot are dealt over SALTS groups; their
windows, and those of keys with more than MOST, meet in a second sorted pass, and the roots of a hot second key's groups in a pass of their own.

Interval join. The windows that two documents meet with are merged where they overlap on one diagonal; each such region is looked at
once: its equal elements (64-bit hashes of five-word runs) are chained, also over neighbouring diagonals, and of the chain the longest stretches of
SHORTEST words or more are taken in which aligned elements outweigh gaps as the bound demands and whose exact Jaccard similarity over their sets of
runs reaches it.

Strangers. The windows that met are keyed a third time, by their element and the one wide / 2 to the right or to the left, which an exact
passage holds as well on one side at least; so groups part that only share a line or a passage too short to count. A member's label is the
smallest document with which a confirmed passage around its element links it (and where there); members of one label are connected. All
outside a group's largest label, the strangers, are compared with all members, settled or not, in parts and slices within tasks and over NEAR
elements to both sides, which hold an exact passage for certain. Only pairs that have met there before or that links found so far connect are
left out. What is alike leaves the task and is confirmed as any other. So around each element all passages that are alike are connected by
reported ones; those that are connected already aren't expanded into all pairs.

Copies. Texts that are equal but for A-Z form classes first (by a digest of 256 bits); only the smallest document of a class goes through all this,
and each other one repeats the whole of its text.

Result: one row for each document and passage: where it lies, and the passage of a smaller document that it repeats.

Defined results: null, empty and short texts have no passages; texts of any length are read whole; repeated rows that share a doc_id are one
document (its largest text); rows without doc_id are left out; of equal passages the smallest (doc_id, place) of a key is what others repeat;
extra columns don't matter; an empty table gives an empty result. A passage that repeats only within one document is not reported.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import word_hashes
from .minhash_dedup import shingle_hashes

FUNCTIONS, RUN, SHORTEST, PERCENT = 5, 5, 50, 80
#: Texts whose hashes are in hand at once, in words; bytes of text that are hashed at once, and rows with elements that are made at once.
SLICE, PIECE, ROWS = 400_000, 1 << 18, 1 << 14
#: Strangers whose elements a task holds at once, members that pass them, and how far their elements reach to both sides.
PART, PASSING, NEAR = 128, 2048, 96
#: Hashes that mark the farther elements on one side of a window, 18 bits each.
MARKS = 2
#: Keys that are dealt over SALTS groups: those with one in HOT or more of all windows of one in SEEN documents, so at most HOT of them.
HOT, SEEN, SALTS = 2000, 64, 64
#: Windows that a task joins at once, and windows of one key from which on they are dealt once more by their second keys.
STEP, MOST = 1 << 16, 1 << 18
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, size=FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def elements(texts: list[str], run: int):
    """For each text in turn the hashes of its runs of words; none if it has fewer words. Many short texts are hashed at once."""

    def hashed(pieces: list[bytes]):
        data = np.frombuffer(b" ".join([*pieces, b""]), dtype=np.uint8)
        hashes, start = word_hashes(data)
        ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in pieces])).tolist()
        runs = shingle_hashes(hashes, run) if len(hashes) >= run else hashes[:0]
        for low, high in zip([0, *ends[:-1]], ends, strict=True):
            yield runs[low : max(low, high - run + 1)]

    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= PIECE:
            yield from hashed(held)
            held, size = [], 0
    if held:
        yield from hashed(held)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each stretch of width values, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[: len(values) - width + 1], out[width - span :]) if span < width else out


def compact_windows(values: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of all windows of at least width elements; texts of the given sizes lie side by side, values are positive.

    c is the leftmost smallest element of l..r. It is the minimum of some stretch of width elements, and only such elements are
    looked at; how far each reaches is found by doubling over tables of minima. All texts are done at once, and time doesn't depend
    on how the Cartesian tree is shaped.
    """
    n, none = len(values), np.empty(0, dtype=np.int64)
    if n < width:
        return none, none, none
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    low = _sliding(values, width, np.minimum)
    low = np.where(owner[: len(low)] == owner[width - 1 :], low, 0)  # a stretch over two texts is none
    pad = np.zeros(width - 1, dtype=values.dtype)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == values)
    first, end, value = (ends - sizes)[owner[at]], ends[owner[at]], values[at]
    tables, span = [values], 1
    while 2 * span <= int(sizes.max()):
        tables.append(np.minimum(tables[-1][:-span], tables[-1][span:]))
        span *= 2
    left, right = at.copy(), at + 1
    for k in range(len(tables) - 1, -1, -1):
        step, table = 1 << k, tables[k]
        go = left - step
        left = np.where((go >= first) & (table[np.maximum(go, 0)] > value), go, left)
        ok = (right + step <= end) & (table[np.minimum(right, len(table) - 1)] >= value)
        right = np.where(ok, right + step, right)
    keep = right - left >= width
    return left[keep], at[keep], right[keep] - 1


def window_key(elements: np.ndarray, f: int) -> np.ndarray:
    """Keys of windows by their smallest elements; the last seven bits are free: one marks a hot key, six hold its salt."""
    k = (elements ^ _MIX) * _SEEDS[f] + np.uint64(f)
    return (k ^ (k >> np.uint64(29))).view(np.int64) & np.int64(~127)


def second_key(key: np.ndarray, side: np.ndarray, which: int) -> np.ndarray:
    """Second keys of windows by their key and the mark of a side; the last seven bits are free again."""
    mark = (side >> (6 + 18 * (which % MARKS))) & ((1 << 18) - 1)
    k = ((key & ~127).view(np.uint64) ^ mark.astype(np.uint64) * _MIX) * _SEEDS[1] + np.uint64(which)
    return (k ^ (k >> np.uint64(29))).view(np.int64) & np.int64(~127)


def _windows(run: int, width: int, hot: np.ndarray | None = None):
    """doc_id, key, at, low, high, right, left: each window with the marks of its sides; 0 where a side doesn't fit, else MARKS hashes over 6 bits of salt."""
    half, near = width // 2, width // 5

    def emit(docs: list[tuple], kind):
        ids, hashes = [d for d, _ in docs], [h for _, h in docs]
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        flat, owner = np.concatenate(hashes), np.repeat(np.arange(len(docs)), sizes)
        starts = np.cumsum(sizes) - sizes
        # of its text, so that it doesn't depend on the kind of ids
        salts = np.array([int(h[0]) % SALTS for h in hashes], dtype=np.int64)
        far = np.zeros(max(0, len(flat) - half + near), dtype=np.int64)
        for seed in _SEEDS[:MARKS]:
            v = flat * seed
            v = (v ^ (v >> np.uint64(31))) * _MIX
            far = far << 18 | (_sliding(v, half - near + 1, np.minimum) >> np.uint64(46)).astype(np.int64)
        doc, rows = [], [[] for _ in range(6)]
        for f, seed in enumerate(_SEEDS):
            v = flat * seed
            v = (((v ^ (v >> np.uint64(31))) * _MIX) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            lo, c, hi = compact_windows(v, sizes, width)
            o = owner[c]
            k = window_key(flat[c], f)
            if hot is not None and len(hot):
                k = np.where(np.isin(k, hot), k | 64 | salts[o], k)
            sides = []
            for first in (c + near, c - half):
                fits = (first >= lo) & (first + half - near <= hi)
                sides.append(np.where(fits, far[np.clip(first, 0, len(far) - 1)] << 6 | salts[o] | 1 << 62, 0))
            doc.append(o)
            for to, x in zip(rows, (k, c - starts[o], lo - starts[o], hi - starts[o], *sides), strict=True):
                to.append(x)
        types = (pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2)
        columns = [pa.array(np.concatenate(x), t if t == pa.int64() else None).cast(t) for x, t in zip(rows, types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(np.concatenate(doc))), *columns], names=["doc_id", "key", "at", "low", "high", "right", "left"])

    def go(batches):
        for batch in batches:
            docs, held, kind = [], 0, batch.schema.field(0).type
            for d, e in zip(batch.column(0).to_pylist(), elements(common.texts(batch), run), strict=True):
                if len(e) >= width:
                    docs.append((d, e))
                    held += len(e)
                if held > SLICE:
                    yield emit(docs, kind)
                    docs, held = [], 0
            if docs:
                yield emit(docs, kind)

    return go


def windows(docs: DataFrame, run: int = RUN, shortest: int = SHORTEST, hot: np.ndarray | None = None) -> DataFrame:
    """doc_id, key, at, low, high, right, left: the compact windows of every text, in elements."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_windows(run, shortest - run + 1, hot), f"doc_id {kind}, key bigint, at int, low int, high int, right bigint, left bigint")


def seconds(rows: pa.Table, hot: np.ndarray) -> pa.Table:
    """Windows to rows (doc_id, key, at, low, high) with second keys, side by side in the order of the windows."""
    parts = []
    for which, name in enumerate(["right"] * MARKS + ["left"] * MARKS):
        side, key = rows.column(name).to_numpy(), rows.column("key").to_numpy()
        at = np.flatnonzero(side)
        k = second_key(key[at], side[at], which)
        if len(hot):
            k = np.where(np.isin(k, hot), k | 64 | (side[at] & 63), k)
        part = rows.take(pa.array(at)).select(["doc_id", "key", "at", "low", "high"])
        parts.append(part.set_column(1, "key", pa.array(k, pa.int64())))
    return pa.concat_tables(parts).combine_chunks()


def _refined(hot: np.ndarray, all_: bool = False):
    """Windows sorted by key to rows (doc_id, key, at, low, high) with second keys, of keys that stand twice at least (or of all)."""

    def refined(table: pa.Table, keep: np.ndarray) -> pa.Table:
        return seconds(table.filter(pa.array(keep)), hot)

    def go(batches):
        held = None  # the last row, which may have its like in the next batch, and whether it had it in the one before
        was = False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = table.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.append(was and held is not None, same) | np.append(same, False) | (key & 64 != 0) | all_
            held, was = table.slice(len(key) - 1, 1).combine_chunks(), bool(keep[-1])
            keep[-1] = False
            yield from refined(table, keep).to_batches()
        if held is not None and was:
            yield from refined(held, np.array([True])).to_batches()

    return go


def jaccard(one: np.ndarray, two: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two arrays' sets."""
    one, two = np.unique(one), np.unique(two)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both, len(one) + len(two) - both


def stretches(p: np.ndarray, q: np.ndarray, wide: int, percent: int) -> list[tuple[int, int]]:
    """The longest stretches of a chain (first and last place in it) of wide elements or more in both texts in which what is aligned outweighs the gaps.

    p, q: rising places of equal elements. A stretch begins and ends at the ends of runs without gaps; with c aligned elements and g skipped
    ones in both texts, it is similar enough if 100 c >= percent (c + g). Sums over runs turn this into finding, for each begin, the last
    end whose sum isn't below the begin's.
    """
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1))
    begin, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(p) - 1]])
    gaps = np.concatenate([[0], (p[begin[1:]] - p[end[:-1]] - 1) + (q[begin[1:]] - q[end[:-1]] - 1)])
    aligned_ = (100 - percent) * (end - begin + 1)
    at_end = np.cumsum(aligned_ - percent * gaps)
    at_begin = at_end - aligned_
    best = np.maximum.accumulate(at_end[::-1])[::-1]  # the most that any end from here on reaches; it falls
    out, reached = [], -1
    for i in range(len(begin)):
        j = int(np.searchsorted(-best, -at_begin[i], side="right")) - 1
        if j <= reached:
            continue
        x, y = int(begin[i]), int(end[j])
        if p[y] - p[x] + 1 >= wide and q[y] - q[x] + 1 >= wide:
            out.append((x, y))
            reached = j
    return out


def similar(one: np.ndarray, two: np.ndarray, p: np.ndarray, q: np.ndarray, x: int, y: int, wide: int, percent: int) -> list[tuple[int, int]]:
    """A stretch of a chain if its Jaccard similarity reaches the bound; else it is cut at its widest gap and both parts are looked at."""
    out, todo = [], [(x, y)]
    while todo:
        x, y = todo.pop()
        if p[y] - p[x] + 1 < wide or q[y] - q[x] + 1 < wide:
            continue
        both, all_ = jaccard(one[p[x] : p[y] + 1], two[q[x] : q[y] + 1])
        if 100 * both >= percent * all_:
            out.append((x, y))
        elif y > x:
            k = x + int(np.argmax(np.diff(p[x : y + 1]) + np.diff(q[x : y + 1])))
            todo += [(x, k), (k + 1, y)]
    return out


def aligned(one: np.ndarray, two: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places p, q, both rising, of the longest chain of equal elements; of several equal ones in two that nearest the diagonal counts."""
    order = np.argsort(two, kind="stable")
    sorted_ = two[order]
    low, high = np.searchsorted(sorted_, one, "left"), np.searchsorted(sorted_, one, "right")
    p = np.flatnonzero(high > low)
    if not len(p):
        return p, p
    if (high[p] - low[p]).max() > 1:
        # equal elements have one rank and lie in order of place, so rank and place together are sorted
        rank = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1])) * (2 * len(two) + len(one) + 1)
        near = np.clip(np.searchsorted(rank + order, rank[low[p]] + np.clip(p + shift, 0, len(two) - 1)), low[p], high[p] - 1)
        before = np.maximum(near - 1, low[p])
        q = np.where(np.abs(order[before] - p - shift) <= np.abs(order[near] - p - shift), order[before], order[near])
    else:
        q = order[low[p]]
    if (np.diff(q) > 0).all():
        return p, q
    tails, ends, previous = [], [], np.empty(len(p), dtype=np.int64)
    for k, x in enumerate(q.tolist()):
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x), ends.append(k)
        else:
            tails[at], ends[at] = x, k
        previous[k] = ends[at - 1] if at else -1
    chain, k = [], ends[-1]
    while k >= 0:
        chain.append(k)
        k = int(previous[k])
    return p[chain[::-1]], q[chain[::-1]]


def needed(elements: np.ndarray, wide: int, percent: int) -> np.ndarray:
    """For each stretch of wide elements, by its start, how many distinct common elements it must have at least."""
    order = np.argsort(elements, kind="stable")
    again = np.zeros(len(elements) + 1, dtype=np.int64)  # elements that came less than a stretch before
    near = (np.diff(elements[order]) == 0) & (np.diff(order) < wide)
    again[order[1:][near] + 1] = 1
    sums = np.cumsum(again)
    return -(-percent * (wide - (sums[wide:] - sums[:-wide])) // 100)


def regions(meetings: np.ndarray) -> np.ndarray:
    """Meetings (low, high, other_low, other_high, shift) merged where they overlap on one diagonal."""
    m = meetings[np.lexsort((meetings[:, 0], meetings[:, 4]))]
    turn = np.cumsum(np.append(0, m[1:, 4] != m[:-1, 4])) * (int(m[:, 1].max()) + 2)
    far = np.maximum.accumulate(m[:, 1] + turn)  # how far those before on the same diagonal reach
    at = np.flatnonzero(np.append(True, m[1:, 0] + turn[1:] > far[:-1]))
    return np.stack([m[at, 0], np.maximum.reduceat(m[:, 1], at), np.minimum.reduceat(m[:, 2], at), np.maximum.reduceat(m[:, 3], at), m[at, 4]], axis=1)


def matched(a: np.ndarray, b: np.ndarray, meetings, run: int, shortest: int, percent: int, places: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Passages (from, to, from, to in words) of a and b, arrays of elements, that repeat each other.

    meetings: ranges of a's and of b's elements (ends inclusive) and the shift from a's to b's. A region needs enough elements in common in
    some stretch to be looked at; its equal elements are chained over all diagonals, so that words put in or left out are gaps like any other,
    and the chain's longest similar stretches are taken. places: b, sorted, where it is known. What lies inside another passage of both is left out.
    """
    wide, out = shortest - run + 1, []
    if len(a) < wide or len(b) < wide:
        return out
    places = np.sort(b) if places is None else places
    has = np.concatenate([[0], np.cumsum(places[np.minimum(np.searchsorted(places, a), len(b) - 1)] == a)])
    enough = has[wide:] - has[:-wide] >= needed(a, wide, percent)
    if not enough.any():
        return out
    hopeful = np.concatenate([[0], np.cumsum(enough)])

    def inside(low: int, high: int, other_low: int, other_high: int) -> bool:
        return any(x <= low and high <= y and u <= other_low and other_high <= v for x, y, u, v in out)

    rows = regions(np.asarray(meetings, dtype=np.int64).reshape(-1, 5))
    rows = rows[np.argsort(-np.minimum(rows[:, 1] - rows[:, 0], rows[:, 3] - rows[:, 2]), kind="stable")]
    for low, high, other_low, other_high, shift in rows.tolist():
        if high - low + 1 < wide or hopeful[high - wide + 2] == hopeful[low] or inside(low, high + run, other_low, other_high + run):
            continue
        one, two = a[low : high + 1], b[other_low : other_high + 1]
        p, q = aligned(one, two, shift + low - other_low)
        if len(p) == 0:
            continue
        for x, y in stretches(p, q, wide, percent):
            for x, y in similar(one, two, p, q, x, y, wide, percent):
                found = (low + int(p[x]), low + int(p[y]) + run, other_low + int(q[x]), other_low + int(q[y]) + run)
                if not inside(*found):
                    out[:] = [o for o in out if not (found[0] <= o[0] and o[1] <= found[1] and found[2] <= o[2] and o[3] <= found[3])]
                    out.append(found)
    return sorted(out)


# ---- joins --------------------------------------------------------------------------------------------------------------------

#: A window as it stands in packed lists.
_WINDOW = np.dtype([("at", "<i4"), ("low", "<i4"), ("high", "<i4"), ("b_at", "<i4"), ("b_low", "<i4"), ("b_high", "<i4")])


def _met(batches):
    """Rows sorted by key, doc_id and at to meetings with their key's first; of hot keys' groups the first ones as well, with null b, and only they with their key.

    Of a document's windows of one key that overlap, the first stands for all.
    """
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if carried is None else [*carried.to_batches(), batch])
        key = table.column("key").to_numpy()
        docs = table.column("doc_id").combine_chunks()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        root = np.repeat(start, np.diff(np.append(start, len(key))))
        turn = np.append(True, pc.not_equal(docs[1:], docs[:-1]).to_numpy(zero_copy_only=False) | (key[1:] != key[:-1]))
        low, high = table.column("low").to_numpy().astype(np.int64), table.column("high").to_numpy().astype(np.int64)
        shift = (np.cumsum(turn) - 1) * (int(high.max()) + 2)
        fresh = turn | np.append(True, low[1:] + shift[1:] > np.maximum.accumulate(high + shift)[:-1])
        other = pc.not_equal(docs, docs.take(pa.array(root))).to_numpy(zero_copy_only=False) & fresh
        first = (root == np.arange(len(key))) & (key & 64 != 0)
        if carried is not None:
            first[0] = False
        at = np.flatnonzero(other | first)
        to = pa.array(root[at], mask=first[at])
        cols = [docs.take(pa.array(at)), docs.take(to), pa.array(key[at], mask=~first[at])]
        cols += [table.column(c).combine_chunks().take(i) for i in (pa.array(at), to) for c in ("at", "low", "high")]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "at", "low", "high", "b_at", "b_low", "b_high"])
        carried = table.slice(int(root[-1]), 1).combine_chunks()


def _joined(hot: np.ndarray, step: int = STEP, most: int = MOST):
    """Windows sorted by key to the meetings of second keys, and to the rows that are dealt once more, as a and key with null b.

    Only what shares its key is sorted by doc_id and at as well. A key's windows are in one task, so those of its second keys meet there. Only the windows of hot keys, which lie in several tasks, go on, those of
    keys with more than most windows, and the first ones of hot second keys' groups.
    """
    kinds = {"a": "doc_id", "key": "key", "at": "at", "low": "low", "high": "high"}

    def dealt(table: pa.Table):
        rows = seconds(table, hot)
        columns = [rows.column(kinds[c]) if c in kinds else pa.nulls(rows.num_rows, rows.schema.field("doc_id" if c == "b" else "at").type) for c in ("a", "b", "key", *_WINDOW.names)]
        yield from pa.table(columns, names=["a", "b", "key", *_WINDOW.names]).combine_chunks().to_batches()

    def done(table: pa.Table):
        if not table.num_rows:
            return
        key = table.column("key").to_numpy()
        same, salted = key[1:] == key[:-1], key & 64 != 0
        if salted.any():
            yield from dealt(table.filter(pa.array(salted)))
        rows = table.filter(pa.array((np.append(False, same) | np.append(same, False)) & ~salted))
        rows = seconds(rows.sort_by([("doc_id", "ascending"), ("at", "ascending")]), hot)
        rows = rows.take(pa.array(np.argsort(rows.column("key").to_numpy(), kind="stable"))).combine_chunks()
        yield from _met(rows.to_batches())

    def go(batches):
        held, n, large = [], 0, None
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < step:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            first, last = int((key == large).sum()) if large is not None else 0, int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            if first:
                yield from dealt(table.slice(0, first))
            yield from done(table.slice(first, max(0, last - first)))
            rest = table.slice(max(first, last)).combine_chunks()
            if rest.num_rows > most:
                yield from dealt(rest)
                large, rest = int(key[-1]), rest.slice(0, 0)
            held, n = rest.to_batches(), 0
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            ongoing = table.column("key").to_numpy() == (0 if large is None else large)
            if large is not None and ongoing.any():
                yield from dealt(table.filter(pa.array(ongoing)))
                table = table.filter(pa.array(~ongoing))
            yield from done(table)

    return go


def meetings(rows: DataFrame) -> DataFrame:
    """a, b, at, low, high, b_at, b_low, b_high: windows (doc_id, key, at, low, high) with the first window of their key, of another document."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, key bigint, at int, low int, high int, b_at int, b_low int, b_high int"

    def once(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "doc_id", "at").select("doc_id", "key", "at", "low", "high").mapInArrow(_met, schema)

    met = common.cleanly(once(rows), "met")
    firsts = met.filter("b IS NULL").select(F.col("a").alias("doc_id"), F.col("key").bitwiseAND(F.lit(~127)).alias("key"), "at", "low", "high")
    return met.filter("b IS NOT NULL").union(once(firsts)).drop("key")


def _gathered(batches):
    """Meetings sorted by a and b to one row a pair, its windows packed; of those of one place under several keys the first stays."""
    held, last = [], None

    def packed(rows: list[np.ndarray]) -> bytes:
        all_ = np.concatenate(rows)
        place = all_["at"].astype(np.int64) << 32 | all_["b_at"]
        return all_[np.unique(place, return_index=True)[1]].tobytes()

    for batch in batches:
        kind = batch.schema.field(0).type
        n = batch.num_rows
        if not n:
            continue
        rows = np.empty(n, dtype=_WINDOW)
        for c in _WINDOW.names:
            rows[c] = batch.column(batch.schema.get_field_index(c)).to_numpy()
        a, b = batch.column(0), batch.column(1)
        change = pc.or_(pc.not_equal(a[1:], a[:-1]), pc.not_equal(b[1:], b[:-1])).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, dtype=bool)
        start = np.append(0, np.flatnonzero(change) + 1)
        out = []
        for x, y in zip(start.tolist(), [*start[1:].tolist(), n], strict=True):
            pair = (a[x].as_py(), b[x].as_py())
            if pair != last and held:
                out.append((*last, packed(held)))
                held = []
            last = pair
            held.append(rows[x:y])
        data = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, (kind, kind, pa.binary()), strict=True)], names=["a", "b", "windows"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], kind), pa.array([last[1]], kind), pa.array([packed(held)], pa.binary())], names=["a", "b", "windows"])


_FOUND = ("a_from", "a_to", "b_from", "b_to")
_SIDES = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def _checked(run: int, shortest: int, percent: int):
    """Rows a, b, windows, text_a, text_b to the confirmed passages, and to all windows of both with the third keys of their sides; b is whom a window met."""

    half = (shortest - run + 1) // 2
    names = ("at", "low", "high", "right", "left")

    def keyed(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        # elements of windows, of the places half a window to the right and to the left, and at, low, high
        mine, right, left, at, low, high = (np.concatenate(x) for x in zip(*rows, strict=True))
        sides, key = [], window_key(mine, 0)
        for which, (place, there) in enumerate(((at + half, right), (at - half, left))):
            mark = (there >> np.uint64(46)).astype(np.int64) << 6
            sides.append(np.where((place >= low) & (place <= high), second_key(key, mark, 2 * MARKS + MARKS * which) | 1, 0))
        return at, low, high, *sides

    def row(e: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        return e[at], e[np.minimum(at + half, len(e) - 1)], e[np.maximum(at - half, 0)], at, low, high

    def go(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            last, held, out, docs, met, rows, others = None, None, [], [], [], [], []

            def others_too():
                # each of the second text's windows once
                if others:
                    x = np.concatenate(others)
                    x = x[np.unique(x["b_at"], return_index=True)[1]]
                    docs.append(last[0]), met.append(None), rows.append(row(held, x["b_at"], x["b_low"], x["b_high"]))
                    others.clear()

            a, b, packed = (batch.column(c).to_pylist() for c in ("a", "b", "windows"))
            new = [i for i in range(len(b)) if not i or b[i] != b[i - 1]]
            firsts, one = set(new), elements(common.texts(batch, "text_a"), run)
            two = elements((x or "" for x in batch.column(batch.schema.get_field_index("text_b")).take(pa.array(new)).to_pylist()), run)
            for i, mine in enumerate(one):
                if i in firsts:
                    others_too()
                    last, held = (b[i],), next(two)
                    places = np.sort(held)
                w = np.frombuffer(packed[i], dtype=_WINDOW)
                found = matched(mine, held, np.stack([w["low"], w["high"], w["b_low"], w["b_high"], w["b_at"] - w["at"]], axis=1), run, shortest, percent, places)
                out += [(a[i], b[i], *f) for f in found]
                docs.append(a[i]), met.append(b[i]), rows.append(row(mine, w["at"], w["low"], w["high"]))
                others.append(w)
            others_too()
            found = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (kind, kind, *[pa.int32()] * 4), strict=True)]
            owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
            found = pa.table([*found, *(pa.nulls(len(out), t) for t in _SIDES)], names=["a", "b", *_FOUND, *names])
            columns = [pa.array(x, t) for x, t in zip(keyed(rows), _SIDES, strict=True)]
            windows = pa.table([*(pa.array(x, kind).take(pa.array(owner)) for x in (docs, met)), *(pa.nulls(len(owner), pa.int32()) for _ in _FOUND), *columns], names=found.column_names)
            yield from pa.concat_tables([found, windows]).combine_chunks().to_batches()

    return go


def gathered(met: DataFrame) -> DataFrame:
    """a, b, windows: the meetings of each pair; written."""
    kind = met.schema["a"].dataType.simpleString()
    return common.cleanly(met.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_gathered, f"a {kind}, b {kind}, windows binary"), "pairs")


def confirmed(pairs: DataFrame, texts: DataFrame, run: int, shortest: int, percent: int) -> DataFrame:
    """What _checked gives for all pairs; written. Deletes the pairs. texts: doc_id, text, one row an id."""
    kind = pairs.schema["a"].dataType.simpleString()
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    schema = f"a {kind}, b {kind}, {', '.join(f'{c} int' for c in _FOUND)}, at int, low int, high int, right bigint, left bigint"
    out = common.cleanly(rows.select("a", "b", "windows", "text_a", "text_b").mapInArrow(_checked(run, shortest, percent), schema), "checked")
    common.removed(pairs)
    return out


def _surrounded(run: int, near: int):
    """Rows doc_id, text, members to one row a window with the elements around its own, 32 bits of each."""

    names = ("key", "at", "low", "high", "strange", "label", "met", "parts", "slices")

    def go(batches):
        for batch in batches:
            e = [(x >> np.uint64(32)).astype(np.uint32) for x in elements(common.texts(batch), run)]
            if not sum(map(len, e)):
                continue
            start, flat = np.cumsum([0, *map(len, e)]), np.concatenate(e)
            owners = pc.list_parent_indices(batch.column(2))
            all_ = pa.Table.from_arrays([owners, batch.column(0).take(owners), *pc.list_flatten(batch.column(2)).flatten()], names=["owner", "doc_id", *(f.name for f in batch.column(2).type.value_type)])
            for k in range(0, all_.num_rows, ROWS):
                rows = all_.slice(k, ROWS)
                owner, at, low, high = (rows.column(c).to_numpy().astype(np.int64) for c in ("owner", "at", "low", "high"))
                first = np.maximum(low, at - near)
                sizes = np.maximum(0, np.minimum(np.minimum(high, at + near) + 1, start[owner + 1] - start[owner]) - first)
                ends = np.cumsum(sizes)
                around = flat[np.repeat(start[owner] + first - ends + sizes, sizes) + np.arange(ends[-1])]
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(around)])
                columns = {"doc_id": rows.column("doc_id"), **{c: rows.column(c) for c in names}, "first": pa.array(first, pa.int32()), "elements": packed}
                order = ("key", "doc_id", "at", "low", "high", "strange", "label", "met", "parts", "slices", "first", "elements")
                yield from pa.table({c: columns[c] for c in order}).combine_chunks().to_batches()

    return go


def alike(rows: list[tuple], held: list[tuple], near: int, wide: int, percent: int) -> np.ndarray:
    """Pairs (places in rows and in held) that may share a passage around their elements; rows are doc_id, at, low, high, first, met, label, elements.

    A passage of wide elements or more in the first one begins at or before its element and ends at or after it with elements of the second
    one, and what they have in common between outweighs the gaps in both, as in stretches. Where elements repeat, enough distinct ones in common will do. All of different labels are looked at at once.
    """
    n, width = len(held), 2 * near + 1

    def flat(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(r[-1]) for r in rows])
        places = np.concatenate([np.arange(k) + (r[4] - r[1] + near) for r, k in zip(rows, sizes.tolist(), strict=True)])
        both = np.concatenate([r[-1] for r in rows]).astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(rows), dtype=np.uint64), sizes)
        both, at = np.unique(both, return_index=True)
        owner = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return both >> np.uint64(32), owner, places[at], np.bincount(owner, minlength=len(rows)) < sizes

    (theirs, owner, q, their_repeats), (mine, row, p, repeats) = flat(held), flat(rows)
    low = np.searchsorted(theirs, mine, "left")
    times = np.searchsorted(theirs, mine, "right") - low
    of = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    cell = np.repeat(row * n, times) + owner[of]
    again = (repeats[:, None] | their_repeats[None, :]).reshape(-1)
    need = [np.array([needed(r[-1], wide, percent).min() if x else -(-percent * wide // 100) for r, x in zip(*of_, strict=True)]) for of_ in ((rows, repeats), (held, their_repeats))]
    enough = np.bincount(cell, minlength=len(rows) * n) >= np.maximum(need[0][:, None], need[1][None, :]).reshape(-1)
    enough &= (np.array([r[-2] for r in rows])[:, None] != np.array([h[-2] for h in held])[None, :]).reshape(-1)
    pairs = np.flatnonzero(enough & ~again)
    if not len(pairs):
        return np.flatnonzero(enough)
    to = np.full((len(pairs), width), -1, dtype=np.int32)
    in_ = (enough & ~again)[cell]
    to[np.searchsorted(pairs, cell[in_]), np.repeat(p, times)[in_]] = q[of[in_]]
    mask = to >= 0
    # common elements weigh 100 + percent, places in both texts percent
    sums = (100 + percent) * np.cumsum(mask, axis=1, dtype=np.int32) - percent * (to + np.arange(width, dtype=np.int32))
    begin = np.where(mask, sums - (100 + percent), 1 << 30)
    begin[:, near + 1 :] = 1 << 30
    begin = np.minimum.accumulate(begin, axis=1)
    ends = np.arange(max(near, wide - 1), width)
    good = (mask[:, ends] & (sums[:, ends] - begin[:, ends - wide + 1] >= 2 * percent)).any(axis=1)
    return np.sort(np.concatenate([pairs[good], np.flatnonzero(enough & again)]))


def _among(run: int, shortest: int, percent: int):
    """Rows sorted by key, part, slice, member and doc_id to meetings of what is alike: the strangers of a part, then all members of a slice.

    Members of one label are connected, and so are those of labels that a meeting of the task has joined; all others are compared that haven't met here before.
    """
    wide = shortest - run + 1

    def go(batches):
        group, held, joined, out = None, [], {}, []

        def root(label: int) -> int:
            while (to := joined.get(label, label)) != label:
                label = to
            return label

        def compare(rows: list[tuple]) -> None:
            # what is connected to all others here, or has met them, needs no look at its elements
            rows, there = ([(*r[:6], root(r[6]), r[7]) for r in x] for x in (rows, held))
            roots = {h[6] for h in there}
            rows = [r for r in rows if (len(roots) > 1 or r[6] not in roots) and any(r[6] != h[6] and r[0] != h[0] and h[0] not in r[5] and r[0] not in h[5] for h in there)]
            roots = {r[6] for r in rows}
            there = [h for h in there if len(roots) > 1 or h[6] not in roots]
            if not rows or not there:
                return
            for pair in alike(rows, there, NEAR, wide, percent).tolist():
                (d, at, low, high, first, met, label, mine), (other, o_at, o_low, o_high, o_first, o_met, o_label, theirs) = rows[pair // len(there)], there[pair % len(there)]
                one, two, x, u = root(label), root(o_label), at - first, o_at - o_first
                if d == other or one == two or other in met or d in o_met:
                    continue
                found = matched(mine, theirs, [(0, len(mine) - 1, 0, len(theirs) - 1, u - x)], run, shortest, percent)
                if any(f[0] <= x <= f[1] - run and f[2] <= u <= f[3] - run for f in found):
                    joined[one] = two
                    a, b = (d, at, low, high), (other, o_at, o_low, o_high)
                    a, b = (a, b) if d > other else (b, a)
                    out.append((a[0], b[0], *a[1:], *b[1:]))

        for batch in batches:
            kind = batch.schema.field(batch.schema.get_field_index("doc_id")).type
            names, waiting = ("key", "part", "slice", "member", "doc_id", "at", "low", "high", "first", "met", "label", "elements"), []
            for key, part, slice_, member, *row, e in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if (key, part, slice_) != group:
                    if waiting:
                        compare(waiting)
                    group, held, waiting = (key, part, slice_), [], []
                    joined.clear()
                mine = np.frombuffer(e, np.uint32)
                if len(mine) < wide:
                    continue
                if not member:
                    held.append((*row, mine))
                elif held:
                    waiting.append((*row, mine))
                    if len(waiting) == 64:
                        compare(waiting)
                        waiting = []
            if waiting:
                compare(waiting)
            data = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, (kind, kind, *[pa.int32()] * 6), strict=True)], names=["a", "b", *_WINDOW.names])

    return go


def among(members: DataFrame, texts: DataFrame, run: int, shortest: int, percent: int) -> DataFrame:
    """Meetings, in each key's group, of those outside its largest label, the strangers, with all others; members: doc_id, key, at, low, high, label, met (of the documents it has met there, two at most)."""
    kind = members.schema["doc_id"].dataType.simpleString()
    salt, salts = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(15)))
    # most groups have one label; what they hold needn't be sorted
    several = members.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.min("doc_id").alias("x"), F.max("doc_id").alias("z")).filter("l <> m AND x <> z").select("key", salts.alias("salt"))
    members = common.cleanly(members.withColumn("salt", salt).join(several, ["key", "salt"]), "several")
    labels = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("x"), F.max(F.struct("doc_id", "met")).alias("z"))
    sizes = labels.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.min("x").alias("x"), F.max("z").alias("z")).filter("n > top.n AND x <> z.doc_id AND NOT (n = 2 AND array_contains(z.met, x))")
    sizes = sizes.select("key", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / PART).cast("int").alias("parts"), F.ceil(F.col("n") / PASSING).cast("int").alias("slices"))
    spread = common.cleanly(sizes, "sizes").withColumn("salt", salts)
    open_ = common.cleanly(members.join(spread, ["key", "salt"]).withColumn("strange", F.col("label") != F.col("top")), "open")
    # parts and slices go along, so that the elements cross one shuffle only
    own = open_.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "low", "high", "strange", "label", "met", "parts", "slices")).alias("members"))
    rows = texts.join(own, "doc_id").select("doc_id", "text", "members").mapInArrow(_surrounded(run, NEAR), f"key bigint, doc_id {kind}, at int, low int, high int, strange boolean, label bigint, met array<{kind}>, parts int, slices int, first int, elements binary")
    own = F.xxhash64("doc_id", "at")
    part, slice_ = F.pmod(own, F.col("parts").cast("long")).cast("int"), F.pmod(F.shiftright(own, 20), F.col("slices").cast("long")).cast("int")
    one = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: F.struct(part.alias("part"), x.alias("slice"), F.lit(False).alias("member")))
    all_ = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(x.alias("part"), slice_.alias("slice"), F.lit(True).alias("member")))
    names = ("doc_id", "at", "low", "high", "first", "met", "label", "elements")
    rows = rows.select("key", *names, F.explode(F.when(F.col("strange"), F.concat(one, all_)).otherwise(all_)).alias("x"))
    dealt = rows.select("key", "x.part", "x.slice", "x.member", *names).repartition("key", "part", "slice").sortWithinPartitions("key", "part", "slice", "member", "doc_id")
    met = dealt.mapInArrow(_among(run, shortest, percent), f"a {kind}, b {kind}, at int, low int, high int, b_at int, b_low int, b_high int")
    # over their whole windows strangers meet one of the largest label too, as alike passages may be longer than what lies near
    one = open_.groupBy("key").agg(F.min(F.struct("strange", "doc_id", "at", "low", "high")).alias("b"))
    far = open_.filter("strange").join(one, "key").filter("doc_id <> b.doc_id AND NOT array_contains(met, b.doc_id)")
    return met.union(far.select(F.col("doc_id").alias("a"), F.col("b.doc_id").alias("b"), "at", "low", "high", *(F.col(f"b.{c}").alias(f"b_{c}") for c in ("at", "low", "high"))))


def hot_keys(text: DataFrame, run: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and second keys of one in HOT or more of the windows of one in SEEN documents: at most HOT of each. They only decide how groups are dealt out."""
    kind = text.schema["doc_id"].dataType.simpleString()
    seen = common.cleanly(windows(text.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SEEN)) == 0), run, shortest), "seen")
    second = seen.mapInArrow(_refined(np.zeros(0, dtype=np.int64), True), f"doc_id {kind}, key bigint, at int, low int, high int")
    out = []
    for rows in (seen, second):
        counts = common.cleanly(rows.select("doc_id", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        out.append(np.array(sorted(r["key"] for r in counts.filter(F.col("n") >= max(50, -(-total // HOT))).select("key").collect()), dtype=np.int64))
        common.removed(counts)
    common.removed(seen)
    return out[0], out[1]


def copies(text: DataFrame) -> DataFrame:
    """doc_id, rep: documents whose texts are equal but for A-Z, and the smallest of each class; documents of one row only."""
    marks = text.select("doc_id", F.sha2(common.lower_ascii(F.col("text")).cast("binary"), 256).alias("mark"))
    marks = marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("mark").alias("mark")).filter("n = 1").drop("n")
    marks = common.cleanly(marks, "marks")
    classes = marks.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark", "rep")
    # from a table, so that a class of many may be dealt over several tasks
    out = common.cleanly(marks.join(common.cleanly(classes, "classes"), "mark").filter("doc_id <> rep").select("doc_id", "rep"), "copies")
    common.removed(marks)
    return out


def passages(docs: DataFrame, run: int = RUN, shortest: int = SHORTEST, percent: int = PERCENT) -> DataFrame:
    """doc_id, start_word, end_word, rep_doc_id, rep_start_word, rep_end_word: passages and what they repeat (ends exclusive)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # equal texts are one text: the others repeat all of it
    same = copies(text)
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    whole_ = text.join(same, "doc_id").select("doc_id", F.lit(0).alias("start_word"), words.alias("end_word"), F.col("rep").alias("rep_doc_id"), F.lit(0).alias("rep_start_word"), words.alias("rep_end_word"))
    whole_ = common.cleanly(whole_.filter(F.col("end_word") >= shortest), "whole")
    text = text.join(same, "doc_id", "left_anti")
    hot, second = hot_keys(text, run, shortest)
    rows = windows(text, run, shortest, hot).repartition("key").sortWithinPartitions("key")
    joined = common.cleanly(rows.mapInArrow(_joined(second), f"a {kind}, b {kind}, key bigint, at int, low int, high int, b_at int, b_low int, b_high int"), "joined")
    met = joined.filter("b IS NOT NULL").drop("key").union(meetings(joined.filter("b IS NULL").select(F.col("a").alias("doc_id"), "key", "at", "low", "high")))
    pairs = gathered(met)
    common.removed(met), common.removed(joined)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = common.cleanly(text.join(ids.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
    first = confirmed(pairs, texts, run, shortest, percent)
    found = common.cleanly(first.filter("a_from IS NOT NULL").select("a", "b", *_FOUND), "found")
    # where a passage that holds a window's element lies in the smallest document it is linked to; windows without one stand alone
    spans = found.select(F.col("a").alias("doc_id"), F.struct("b", F.col("b_from").alias("to"), F.col("a_from").alias("x"), F.col("a_to").alias("y")).alias("s"))
    spans = spans.union(found.select("b", F.struct("b", "b_from", "b_from", "b_to"))).groupBy("doc_id").agg(F.collect_set("s").alias("spans"))
    label = f"array_min(transform(filter(spans, s -> s.x <= at AND at + {run} <= s.y), s -> struct(s.b, (s.to + at - s.x) DIV 64 AS place)))"
    sides = [F.max(F.when(F.col(c) != 0, F.col(c))).alias(c) for c in ("right", "left")]
    # of the documents that a window has met two are kept, in plain columns that need no sort; the others may be compared once more
    met = F.array_distinct(F.filter(F.array("one", "two"), lambda x: x.isNotNull())).alias("met")
    members = first.filter("a_from IS NULL").select(F.col("a").alias("doc_id"), "b", "at", "low", "high", "right", "left").repartition("doc_id")
    members = members.groupBy("doc_id", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("b").alias("one"), F.max("b").alias("two"), *sides).join(spans, "doc_id", "left").withColumn("label", F.expr(label))
    members = members.withColumn("label", F.when(F.col("label").isNotNull(), F.xxhash64("label.b", "label.place")).otherwise(F.xxhash64("doc_id", F.lit(-1))))
    whole = common.cleanly(members.select("doc_id", "at", "low", "high", "right", "left", "label", met), "members")
    common.removed(first)
    members = whole.select("doc_id", "at", "low", "high", "label", "met", F.explode(F.filter(F.array("right", "left"), lambda x: x.isNotNull())).alias("key"))
    again = common.cleanly(among(members, texts, run, shortest, percent), "again")
    if again.head(1):
        found = found.union(confirmed(gathered(again), texts, run, shortest, percent).filter("a_from IS NOT NULL").select("a", "b", *_FOUND))
    common.removed(whole), common.removed(again), common.removed(texts)
    flip = found.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_from").alias("a_from"), F.col("b_to").alias("a_to"), F.col("a_from").alias("b_from"), F.col("a_to").alias("b_to"))
    found = found.filter("a > b").union(flip)
    found = found.select(F.col("a").alias("doc_id"), F.col("a_from").alias("start_word"), F.col("a_to").alias("end_word"), F.col("b").alias("rep_doc_id"), F.col("b_from").alias("rep_start_word"), F.col("b_to").alias("rep_end_word")).distinct()
    return found.union(whole_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(common.documents(spark, sf_dir))
