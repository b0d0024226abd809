"""Trees as rows: nested tags matched by windows, containment by an interval join, re-parenting by pointer doubling, subtrees as slices of one array.

Tags are rows (doc_id, seq, role, name, ...) with role open, close or leaf. Nodes are rows in preorder: node_id from 1 on, last_id of the last node below,
parent_id (0 at the top), depth (0 at the top). An end tag closes the nearest open element of its name and all that is open in it; one that finds
none is dropped; what is still open at the end ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bibliography import checkpointed


def _before(*keys: str, here: bool = True):
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if here else -1)


def _after(*keys: str):
    """What follows a row; read backwards, so that each row is looked at once."""
    return Window.partitionBy(*keys).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)


def _paired(tags: DataFrame) -> DataFrame:
    """tags with loose: adds partner, the other tag of an element, by names alone: within a name ends match the last start still open.

    Ends without a start go. Starts that are loose, or that no end follows, have no partner.
    """
    of = ("doc_id", "name")
    step = F.when((F.col("role") == "open") & ~F.col("loose"), 1).when(F.col("role") == "close", -1).otherwise(0)
    rows = tags.withColumn("_sum", F.sum(step).over(_before(*of)))
    floor = F.least(F.coalesce(F.min("_sum").over(_before(*of, here=False)), F.lit(0)), F.lit(0))
    rows = rows.withColumn("_floor", floor).filter((F.col("role") != "close") | (F.col("_sum") >= F.col("_floor")))
    rows = rows.withColumn("_level", F.col("_sum") - F.least("_sum", "_floor"))
    rows = rows.withColumn("_closed", (F.col("role") == "open") & ~F.col("loose") & F.coalesce(F.min("_level").over(_after(*of)) < F.col("_level"), F.lit(False)))
    # at one level of a name, starts that are closed and ends take turns
    turn = F.when(F.col("_closed"), F.col("_level")).when(F.col("role") == "close", F.col("_level") + 1)
    w = Window.partitionBy(*of, "_turn").orderBy("seq")
    partner = F.when(F.col("role") == "close", F.lag("seq").over(w)).when(F.col("_closed"), F.lead("seq").over(w))
    return rows.withColumn("_turn", turn).withColumn("partner", partner).drop("_sum", "_floor", "_level", "_closed", "_turn")


def _nested(rows: DataFrame) -> DataFrame:
    """Adds inside (elements with both tags that hold the row; a tag lies in its own element), n (nodes so far) and crossed (an end whose element isn't the innermost)."""
    whole = F.col("partner").isNotNull()
    rows = rows.withColumn("_sum", F.sum(F.when(whole & (F.col("role") == "open"), 1).when(F.col("role") == "close", -1).otherwise(0)).over(_before("doc_id")))
    rows = rows.withColumn("n", F.sum((F.col("role") != "close").cast("int")).over(_before("doc_id")))
    rows = rows.withColumn("inside", F.col("_sum") + (F.col("role") == "close").cast("int")).drop("_sum")
    start = F.when(whole & (F.col("role") == "open"), F.col("seq"))
    innermost = F.last(start, ignorenulls=True).over(_before("doc_id", "inside", here=False))
    return rows.withColumn("crossed", (F.col("role") == "close") & (innermost != F.col("partner")))


def matched(tags: DataFrame) -> DataFrame:
    """tags (doc_id, seq, role, name, ...) with partner, inside and n.

    Where elements cross, the first end that does so in a document leaves loose what is open in its element, and the document is matched anew: one round
    for each such end of the worst document, over the documents that still have one. Well-nested documents take none.
    """
    done, rest = [], tags.withColumn("loose", F.lit(False))
    while True:
        rows = checkpointed(_nested(_paired(rest)))
        first = rows.filter("crossed").groupBy("doc_id").agg(F.min(F.struct("seq", "partner")).alias("_end"))
        if not first.head(1):
            break
        done.append(rows.join(first, "doc_id", "left_anti"))
        marks = rows.join(first, "doc_id").select("doc_id", "seq", ((F.col("role") == "open") & F.col("seq").between(F.col("_end.partner") + 1, F.col("_end.seq")) & (F.col("partner") > F.col("_end.seq"))).alias("_now"))
        rest = rest.join(first, "doc_id", "left_semi").join(marks, ["doc_id", "seq"], "left").withColumn("loose", F.col("loose") | F.coalesce("_now", F.lit(False))).drop("_now")
    for d in done:
        rows = rows.unionByName(d)
    return rows.drop("loose", "crossed")


def nodes(tags: DataFrame) -> DataFrame:
    """One row for each element and leaf, in preorder: doc_id, node_id, last_id, parent_id, depth, and the tag's own columns."""
    own = [c for c in tags.columns if c not in ("doc_id", "seq", "role")]
    rows = matched(tags)
    # as many tasks as made the tags, however many shuffles have by default
    rows = rows.repartition(max(1, rows.rdd.getNumPartitions()), "doc_id")
    total = F.max("n").over(Window.partitionBy("doc_id"))
    opens, whole = F.col("role") == "open", F.col("partner").isNotNull()
    rows = rows.withColumn("_total", total).withColumn("_free", opens & ~whole)
    # an element with both tags also looks for its parent one level farther out
    rows = rows.withColumn("_probe", F.explode(F.when(opens & whole, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).withColumn("inside", F.col("inside") - F.col("_probe").cast("int"))
    at, real = ("doc_id", "inside"), ~F.col("_probe")
    rows = rows.withColumn("_seen", F.sum((F.col("_free") & real).cast("int")).over(_before(*at)))
    start = F.when(opens & whole & real, F.col("_seen"))
    rows = rows.select(
        "*",
        F.when(F.col("role") == "close", F.col("_seen") - F.last(start, ignorenulls=True).over(_before(*at))).otherwise(0).alias("_loose"),
        F.coalesce(F.last(F.when(opens & real, F.col("n")), ignorenulls=True).over(_before(*at, here=False)), F.lit(0)).alias("_parent"),
        F.coalesce(F.last(F.when(F.col("role") == "close", F.col("n")), ignorenulls=True).over(_after(*at)), F.col("_total")).alias("_last"),
    )
    # the row that stands in its own element gives the end, the one farther out the parent
    rows = rows.groupBy("doc_id", "seq").agg(
        F.max(F.when(real, F.col("_last"))).alias("_last"), F.max(F.when(F.col("_probe") | ~(opens & whole), F.col("_parent"))).alias("parent_id"),
        *(F.max(c).alias(c) for c in ("_loose", "role", "partner", "n", *own)),
    )
    step = F.when(F.col("role") == "open", 1).when(F.col("role") == "close", -1 - F.col("_loose")).otherwise(0)
    rows = rows.withColumn("depth", F.coalesce(F.sum(step).over(_before("doc_id", here=False)), F.lit(0))).filter("role <> 'close'")
    return rows.select("doc_id", F.col("n").cast("int").alias("node_id"), F.when(F.col("role") == "leaf", F.col("n")).otherwise(F.col("_last")).cast("int").alias("last_id"), F.col("parent_id").cast("int").alias("parent_id"), F.col("depth").cast("int").alias("depth"), *own)


def _levels(most: Column) -> Column:
    return F.sequence(F.lit(0), F.floor(F.log2(F.greatest(most, F.lit(1)) * 2.0)).cast("int"))


def contained(intervals: DataFrame, points: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of intervals (key, low, high, ...) and points (key, at, ...) that lie in them; numbers from 0 on.

    An interval is at most two blocks of each power of two; a point lies in one block of each. So both meet by equality of key, power and block, exactly
    once, and nothing else is compared. Powers go up to the longest interval of the key.
    """
    k = F.col("_k")
    size = F.pow(F.lit(2.0), k)
    blocks = intervals.filter("low <= high").withColumn("_k", F.explode(_levels(F.col("high") - F.col("low") + 1)))
    left, right = F.ceil(F.col("low") / size), F.floor((F.col("high") + 1) / size)
    blocks = blocks.withColumn("_l", left).withColumn("_r", right).filter("_l < _r")
    one = F.array_compact(F.array(F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1)))
    blocks = blocks.withColumn("_block", F.explode(one)).drop("_l", "_r")
    widest = intervals.groupBy(key).agg(F.max(F.col("high") - F.col("low") + 1).alias("_widest"))
    spread = points.join(widest, key).withColumn("_k", F.explode(_levels(F.col("_widest")))).withColumn("_block", F.floor(F.col("at") / size)).drop("_widest")
    return blocks.join(spread, [key, "_k", "_block"]).drop("_k", "_block")


def ancestors(tree: DataFrame) -> DataFrame:
    """doc_id, ancestor_id, node_id, distance of every node below another."""
    outer = tree.filter("last_id > node_id").select("doc_id", (F.col("node_id") + 1).alias("low"), F.col("last_id").alias("high"), F.col("node_id").alias("ancestor_id"), F.col("depth").alias("_above"))
    inner = tree.select("doc_id", F.col("node_id").alias("at"), F.col("depth").alias("_below"))
    return contained(outer, inner).select("doc_id", "ancestor_id", F.col("at").alias("node_id"), (F.col("_below") - F.col("_above")).alias("distance"))


def unwrapped(tree: DataFrame, gone: Column) -> DataFrame:
    """The tree without the nodes for which gone holds: what they held goes to the nearest ancestor that stays; ids, ends and depths are counted anew.

    Pointers of nodes that go are doubled until all point to one that stays, or to the top: as many joins as the logarithm of the longest chain of them.
    """
    tree = tree.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    out = checkpointed(tree.filter("_gone").select("doc_id", "node_id", F.col("parent_id").alias("to")))
    while True:
        over = out.select("doc_id", F.col("node_id").alias("to"), F.col("to").alias("_next"))
        jumped = checkpointed(out.join(over, ["doc_id", "to"], "left").select("doc_id", "node_id", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")))
        out = jumped.drop("_moved")
        if not jumped.filter("_moved").head(1):
            break
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = tree.withColumn("_n", F.sum((~F.col("_gone")).cast("int")).over(w))
    to = out.select("doc_id", F.col("node_id").alias("parent_id"), "to")
    rows = counted.filter(~F.col("_gone")).join(to, ["doc_id", "parent_id"], "left").withColumn("parent_id", F.coalesce("to", "parent_id")).drop("to")
    ids = counted.select("doc_id", "node_id", "_n")
    rows = rows.join(ids.select("doc_id", F.col("node_id").alias("last_id"), F.col("_n").alias("_end")), ["doc_id", "last_id"])
    rows = rows.join(ids.select("doc_id", F.col("node_id").alias("parent_id"), F.col("_n").alias("_up")), ["doc_id", "parent_id"], "left")
    # a node that goes is one level less for all that it holds: the sum of starts less that of ends
    starts = tree.filter("_gone").select("doc_id", F.col("node_id").alias("at"), F.lit(1).alias("_step"))
    ends = tree.filter("_gone").select("doc_id", (F.col("last_id") + 1).alias("at"), F.lit(-1).alias("_step"))
    own = [c for c in tree.columns if c not in ("doc_id", "node_id", "last_id", "parent_id", "depth", "_gone")]
    steps = starts.union(ends).groupBy("doc_id", "at").agg(F.sum("_step").alias("_step"))
    rows = rows.join(steps.withColumnRenamed("at", "node_id"), ["doc_id", "node_id"], "full").withColumn("_less", F.sum(F.coalesce("_step", F.lit(0))).over(w)).filter("_n IS NOT NULL")
    return rows.select("doc_id", F.col("_n").cast("int").alias("node_id"), F.col("_end").cast("int").alias("last_id"), F.coalesce("_up", F.lit(0)).cast("int").alias("parent_id"), (F.col("depth") - F.col("_less")).cast("int").alias("depth"), *own)


def serialised(tree: DataFrame, start: Column, end: Column) -> DataFrame:
    """doc_id, text: the fragment start of every node at its place and the fragment end (null: none) after its last node, deeper nodes first."""
    opening = tree.select("doc_id", F.struct(F.col("node_id").alias("at"), F.lit(0).alias("back"), start.alias("text")).alias("e"))
    closing = tree.filter(end.isNotNull()).select("doc_id", F.struct(F.col("last_id").alias("at"), (F.lit(2_000_000_000) - F.col("depth")).alias("back"), end.alias("text")).alias("e"))
    texts = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"])
    return opening.union(closing).groupBy("doc_id").agg(F.array_join(texts, "").alias("text"))


def subtree_texts(tree: DataFrame, own: Column) -> DataFrame:
    """doc_id, node_id, text: what own gives for the nodes of each subtree, in order.

    A document's texts stand side by side in one array of bytes once, and running sums of their lengths say where a node's part begins and ends.
    """
    rows = tree.select("doc_id", "node_id", "last_id", F.coalesce(own, F.lit("")).alias("_own"))
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum(F.octet_length("_own").cast("bigint")).over(w)).withColumn("_start", F.col("_end") - F.octet_length("_own"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("node_id", "_own"))), lambda x: x["_own"])
    whole = rows.filter("_own <> ''").groupBy("doc_id").agg(F.array_join(texts, "").cast("binary").alias("_whole"))
    ends = rows.select("doc_id", F.col("node_id").alias("last_id"), F.col("_end").alias("_to"))
    rows = rows.drop("_own", "_end").join(ends, ["doc_id", "last_id"]).join(whole, "doc_id", "left")
    part = F.substring(F.col("_whole"), (F.col("_start") + 1).cast("int"), (F.col("_to") - F.col("_start")).cast("int")).cast("string")
    return rows.select("doc_id", "node_id", F.coalesce(part, F.lit("")).alias("text"))


def lists(tree: DataFrame, separator: Column) -> DataFrame:
    """Items between separators among the children of each node that holds one: doc_id, parent_id, item (from 1), first_id, last_id, n.

    Only separators at the depth of the list count, those of inner lists lie in its items. An item may be empty (null ends, n 0); nothing after the last
    separator is no item, as an end is optional.
    """
    w = Window.partitionBy("doc_id", "parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = tree.select("doc_id", "parent_id", "node_id", "last_id", F.coalesce(separator, F.lit(False)).alias("_sep"))
    rows = rows.withColumn("item", F.sum(F.col("_sep").cast("int")).over(w) + (~F.col("_sep")).cast("int"))
    # a separator ends the item whose number it has, so an item without nodes still has the row of its separator
    made = rows.groupBy("doc_id", "parent_id", "item").agg(*(f(F.when(~F.col("_sep"), F.col(c))).alias(n) for f, c, n in ((F.min, "node_id", "first_id"), (F.max, "last_id", "last_id"), (F.count, "node_id", "n"))), F.max("_sep").alias("_ended"))
    return made.withColumn("_list", F.max("_ended").over(Window.partitionBy("doc_id", "parent_id"))).filter("_list").select("doc_id", "parent_id", F.col("item").cast("int").alias("item"), "first_id", "last_id", "n")
