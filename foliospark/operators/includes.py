"""Files spliced into others: an ordered walk of a graph that may have cycles.

lines: file, pos, text, include; a line with include stands for the named file. Each round joins the files that are reached with those that they include and
carries the places on the way as a text, whose order is the order of the lines. A file that is being read already is cut; its line and those of files that
aren't there stay as rows with an error. There is one round for each level of nesting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bibliography import checkpointed, cleanly, removed

#: Turns in which roots are numbered at most, each with shuffle files of its own.
TURNS = 8


def resolved(lines: DataFrame, listing: DataFrame) -> DataFrame:
    """lines with target: the file of the name as it stands, else with .tex after it; null where neither is there. listing: file."""
    there = listing.select(F.col("file").alias("target")).distinct()
    names = lines.select("include").filter("include IS NOT NULL").distinct()
    both = names.select("include", F.posexplode(F.array(F.col("include"), F.concat("include", F.lit(".tex")))).alias("_rank", "target"))
    best = both.join(there, "target").groupBy("include").agg(F.min_by("target", "_rank").alias("target"))
    return lines.join(best, "include", "left")


def _step(pos: Column) -> Column:
    """A place as text whose order is that of the places, so that ways are compared as texts: the number of digits comes first."""
    digits = pos.cast("string")
    return F.concat(F.chr(F.length(digits) + 96), digits)


def _starts(reached: DataFrame, ids: DataFrame) -> DataFrame:
    """root (its name), _at, _run, _first, depth: how many lines come before each run and each cut (run 0) of the files that were reached."""
    all_ = reached.repartition("root").join(ids.select(F.col("_id").alias("root"), F.col("file").alias("_name")), "root")
    places = F.transform("_runs", lambda x: F.struct(_step(x["pos"]).alias("place"), x["n"].alias("n"), x["_run"].alias("_run")))
    cuts = F.transform("_cut", lambda x: F.struct(_step(x).alias("place"), F.lit(1).alias("n"), F.lit(0).alias("_run")))
    all_ = all_.select("root", "_name", "_at", "_way", "depth", F.explode(F.concat(places, cuts)).alias("x")).select("root", "_name", "_at", "depth", "x.n", "x._run", F.concat("_way", "x.place").alias("_way"))
    first = F.sum("n").over(Window.partitionBy("root").orderBy("_way").rowsBetween(Window.unboundedPreceding, -1))
    return all_.select(F.col("_name").alias("root"), "_at", "_run", F.coalesce(first, F.lit(0)).cast("int").alias("_first"), "depth")


def spliced(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """root, line (from 1), file, text, depth, error (missing, cycle or null) of each root (file) with all that it includes. lines: see resolved(); pos from 0 on.

    The rounds walk from file to file only, by numbers of files, and each reached file is one row: with its runs (lines between two includes) as places and
    lengths, so that whole runs are numbered, and with what it leads to next. Texts meet the numbered runs at the end and cross no sort. Files that lead
    nowhere don't carry what is open. Each round's shuffle files, and all rounds once the runs have numbers, are deleted.
    """
    spark = lines.sparkSession
    ids = cleanly(lines.select("file").union(roots.select("file")).distinct().select("file", F.monotonically_increasing_id().alias("_id")))
    numbered = lines.join(ids, "file").withColumn("_before", F.count("target").over(Window.partitionBy("_id").orderBy("pos")))
    own = numbered.filter("target IS NULL").withColumn("_run", F.dense_rank().over(Window.partitionBy("_id").orderBy("_before")))
    own = own.withColumn("_off", F.row_number().over(Window.partitionBy("_id", "_run").orderBy("pos")))
    own = cleanly(own.select(F.col("_id").alias("_at"), "_run", "_off", "pos", "file", F.when(F.col("include").isNull(), F.col("text")).alias("text"), F.when(F.col("include").isNotNull(), "missing").alias("error")))
    links = lines.filter("target IS NOT NULL").select("file", "pos", "target").join(ids, "file").select(F.col("_id").alias("_file"), "pos", F.col("target").alias("file"))
    links = links.join(ids, "file").select("_file", "pos", F.col("_id").alias("_target"))
    leads = links.select(F.col("_file").alias("_target")).distinct().withColumn("_leads", F.lit(True))
    links = links.join(leads, "_target", "left").groupBy("_file").agg(F.collect_list(F.struct("pos", "_target", F.coalesce("_leads", F.lit(False)).alias("_leads"))).alias("_links"))
    runs = own.groupBy("_at", "_run").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).cast("int").alias("n")).groupBy(F.col("_at").alias("_file")).agg(F.collect_list(F.struct("pos", "n", "_run")).alias("_runs"))
    # dealt by file once, so that the rounds move only what they have reached
    n = ids.count()
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // 8192)
    files = runs.join(links, "_file", "full").repartition(parts, "_file")
    files = checkpointed(files.select("_file", *(F.coalesce(c, F.array()).alias(c) for c in ("_runs", "_links"))))
    level = roots.join(ids, "file").select(F.col("_id").alias("root"), F.col("_id").alias("_at"), F.lit("").alias("_way"), F.array("_id").alias("_open"), F.lit(1).alias("depth"))
    reached = []
    while True:
        rows = level.join(files, F.col("_at") == F.col("_file"))
        cut, onward = (F.filter("_links", lambda x: F.array_contains("_open", x["_target"]) == cycle) for cycle in (True, False))
        rows = rows.select("root", "_at", "_way", "depth", "_runs", F.transform(cut, lambda x: x["pos"]).alias("_cut"), onward.alias("_next"), F.when(F.size("_links") > 0, F.col("_open")).alias("_open"))
        rows = cleanly(rows)
        reached.append(rows)
        if not rows.filter(F.size("_next") > 0).head(1):
            break
        opened = F.when(F.col("x._leads"), F.concat("_open", F.array("x._target")))
        level = rows.select("*", F.explode("_next").alias("x")).select("root", F.col("x._target").alias("_at"), F.concat("_way", _step(F.col("x.pos"))).alias("_way"), opened.alias("_open"), (F.col("depth") + 1).alias("depth"))
    # a file's row crosses to its root as one, and becomes its runs and cuts there; some roots at a time
    all_ = reduce(DataFrame.union, (r.select("root", "_at", "_way", "depth", "_runs", "_cut") for r in reached))
    turns = min(TURNS, 1 + n // 32_768)
    starts = reduce(DataFrame.union, [cleanly(_starts(all_.filter(F.pmod(F.xxhash64("root"), F.lit(turns)) == k), ids)) for k in range(turns)])
    for rows in reached:
        removed(rows)
    # a line that is cut stands as run 0 of its file
    cycles = ids.select(F.col("_id").alias("_at"), F.lit(0).alias("_run"), F.lit(1).alias("_off"), "file", F.lit(None).cast("string").alias("text"), F.lit("cycle").alias("error"))
    shown = own.drop("pos").union(cycles.join(files.filter(F.size("_links") > 0).select(F.col("_file").alias("_at")), "_at", "left_semi"))
    return starts.join(shown, ["_at", "_run"]).select("root", (F.col("_first") + F.col("_off")).alias("line"), "file", "text", "depth", "error")
