"""Bibliography tables: duplicates, normal forms, inheritance, macros, names.

Fields are long: key, name, value. Inheritance carries a priority array along each lineage and takes the value of the smallest: [0] for an own
value, [1, -i] before it for the i-th of several parents (the last listed wins), [2, rank] for a cross-reference. A path of visited keys cuts
cycles. Lineages are followed by iterated joins until none grows; each step is written, so none is computed again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a cross-reference never passes on, and those that it renames.
PRIVATE = ("crossref", "entryset", "entrysubtype", "execute", "label", "options", "presort", "related", "relatedoptions", "relatedstring", "relatedtype", "shorthand", "sortkey", "xdata", "xref", "keywords")
TO_BOOK = {"author": "bookauthor", "subtitle": "booksubtitle", "title": "booktitle"}
#: Older field names.
NEW_NAMES = {"address": "location", "journal": "journaltitle", "school": "institution"}


def renamed(name: Column, names: dict[str, str]) -> Column:
    out = F
    for old, new in names.items():
        out = out.when(name == old, new)
    return out.otherwise(name)


def shared(df: DataFrame) -> None:
    """Sets the folder of checkpoints, that of spark.checkpoint.dir; where that is unset and Spark runs in one process, a local one."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='foliospark-')}")


def checkpointed(df: DataFrame) -> DataFrame:
    """df in the shared folder of checkpoints."""
    shared(df)
    return df.checkpoint()


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the folder of checkpointed(): readers take only the columns and rows that they need, and no row is an object of its own."""
    context = df.sparkSession.sparkContext
    shared(df)
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanly(df: DataFrame) -> DataFrame:
    """written() in less space; the shuffle files of its plan are deleted as soon as the table stands."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return written(df, "zstd")
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def removed(df: DataFrame) -> None:
    """Deletes a table of written() or cleanly() that nothing needs any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def deduplicated(raw: DataFrame) -> DataFrame:
    """raw: key, seq, pos, name, value. The first entry of a key wins, and in it the last value of a field."""
    first = raw.groupBy("key").agg(F.min("seq").alias("seq"))
    return raw.join(first, ["key", "seq"]).groupBy("key", "name").agg(F.max_by("value", "pos").alias("value"))


def normalised_types(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """A book with an editor and no author is a collection."""
    has = fields.groupBy("key").agg(F.max((F.col("name") == "editor").cast("int")).alias("e"), F.max((F.col("name") == "author").cast("int")).alias("a"))
    rows = entries.join(has, "key", "left")
    return rows.select("key", F.when((F.col("type") == "book") & (F.coalesce("e", F.lit(0)) == 1) & (F.coalesce("a", F.lit(0)) == 0), "collection").otherwise(F.col("type")).alias("type"))


def normalised_fields(fields: DataFrame) -> DataFrame:
    """New field names; of several that become one, the alphabetically greatest original keeps its value."""
    return fields.groupBy("key", renamed(F.col("name"), NEW_NAMES).alias("to")).agg(F.max_by("value", "name").alias("value")).select("key", F.col("to").alias("name"), "value")


def lineages(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """root, node, prio: every ancestor that a root reaches without a cycle; edges: child, parent, ord."""
    start = keys.select(F.col("key").alias("root"), F.col("key").alias("node"), F.array().cast("array<int>").alias("prio"), F.array("key").alias("path"))
    parts, last = [start], start
    while True:
        last = last.join(edges, last["node"] == edges["child"]).filter(~F.array_contains(F.col("path"), F.col("parent"))).select("root", F.col("parent").alias("node"), F.concat("prio", F.array(F.lit(1), -F.col("ord"))).alias("prio"), F.concat("path", F.array("parent")).alias("path"))
        last = written(last)
        if not last.head(1):
            break
        parts.append(last)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("root", "node", F.concat("prio", F.array(F.lit(0))).alias("prio"))


def xdata(own: DataFrame, edges: DataFrame) -> DataFrame:
    """key, name, value with what the data parents add."""
    reach = lineages(own.select("key").distinct(), edges)
    rows = reach.join(own.withColumnRenamed("key", "node"), "node").filter("name <> 'xdata'")
    return rows.groupBy(F.col("root").alias("key"), "name").agg(F.min_by("value", "prio").alias("value"))


def crossref(own: DataFrame, edges: DataFrame) -> DataFrame:
    """key, name, value with what the cross-referenced entry adds, level by level; edges: child, parent."""
    start = own.select(F.col("key").alias("root"), "name", "value", F.array(F.lit(0)).alias("prio"))
    parts, reach = [start], edges.filter("child <> parent").select(F.col("child").alias("root"), F.col("parent").alias("node"), F.array("child", "parent").alias("path"), F.lit(1).alias("depth"))
    while True:
        reach = written(reach)
        if not reach.head(1):
            break
        fields, depth = reach.join(own.withColumnRenamed("key", "node"), "node"), F.col("depth")
        steps, name = [], F.col("name")
        fields = fields.filter(~name.isin(*PRIVATE))
        # each step up may rename; a name that is already a book's stays
        new = renamed(name, TO_BOOK)
        steps.append(F.array_repeat(F.lit(2), depth))
        rank = F.when(name > new, 0).when(name.isin(*TO_BOOK.values()) & (name < F.lit("booktitle")), 0).otherwise(1)
        parts.append(fields.select("root", new.alias("name"), "value", F.concat(steps[0], F.array(rank)).alias("prio")))
        reach = reach.join(edges, reach["node"] == edges["child"]).filter(~F.array_contains(F.col("path"), F.col("parent"))).select("root", F.col("parent").alias("node"), F.concat("path", F.array("parent")).alias("path"), (F.col("depth") + 1).alias("depth"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy(F.col("root").alias("key"), "name").agg(F.min_by("value", "prio").alias("value"))


def resolved(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries (key, type) and fields (key, name, value) of a parsed file (key, type, name, value), as readers of it want them.

    Data parents come first, then cross-references of what results, then entries of type xdata go and types and names become normal. The keys of
    data parents are what stands between commas, empty ones left out.
    """
    fields = written(fields)  # six joins read them, which would parse the file each time
    own = fields.select("key", "name", "value")
    listed = own.filter("name = 'xdata'").select(F.col("key").alias("child"), F.posexplode(F.filter(F.split("value", ","), lambda x: x != "")).alias("ord", "parent"))
    full = written(xdata(own, listed))
    linked = fields.filter("name = 'crossref'").select(F.col("key").alias("child"), F.col("value").alias("parent")).distinct()
    full = crossref(full, linked).filter("name NOT IN ('crossref', 'xdata')")
    kept = fields.groupBy("key").agg(F.min("type").alias("type")).filter("type <> 'xdata'")
    full = written(full.join(kept.select("key"), "key", "left_semi"))
    return normalised_types(kept, full), normalised_fields(full)


def expanded_macros(stream: DataFrame) -> DataFrame:
    """stream: doc_id, seq, kind (def, use), name, value. Uses with the value of the last definition before them, or nothing."""
    w = Window.partitionBy("doc_id", F.lower("name")).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = stream.withColumn("found", F.last(F.when(F.col("kind") == "def", F.col("value")), ignorenulls=True).over(w))
    return rows.filter("kind = 'use'").select("doc_id", "seq", "name", F.coalesce("found", F.lit("")).alias("value"))


def agents(rows: DataFrame) -> DataFrame:
    """key, names to key, place, first, prefix, last, suffix; for names without braces, in the three comma forms."""
    names = rows.select("key", F.posexplode(F.filter(F.transform(F.split("names", r"(?<=^|\s)and(?=\s|$)"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")).alias("place", "name"))
    parts = F.transform(F.split("name", ","), lambda x: F.trim(x))
    n = names.withColumn("parts", parts).withColumn("words", F.split(F.when(F.size("parts") > 1, F.col("parts")[0]).otherwise(F.col("name")), " "))
    low = F.transform("words", lambda x: F.rlike(x, F.lit(r"^\p{Ll}")))
    n = n.withColumn("low", low).withColumn("k", F.size("words"))
    first_low = F.array_position("low", F.lit(True)).cast("int")
    last_low = F.when(first_low == 0, 0).otherwise(F.col("k") + 1 - F.array_position(F.reverse("low"), F.lit(True)).cast("int"))
    cut = F.least(last_low, F.col("k") - 1)
    bare = F.size("parts") == 1

    def join(a: Column, b: Column) -> Column:
        return F.array_join(F.slice("words", a, F.greatest(b - a + 1, F.lit(0))), " ")

    n = n.withColumn("f", first_low).withColumn("c", F.greatest(cut, F.lit(0)))
    first = F.when(bare, F.when(F.col("f") == 0, join(F.lit(1), F.col("k") - 1)).otherwise(join(F.lit(1), F.col("f") - 1))).when(F.size("parts") == 2, F.col("parts")[1]).otherwise(F.array_join(F.slice("parts", 3, F.greatest(F.size("parts") - 2, F.lit(0))), ", "))
    prefix = F.when(bare, F.when((F.col("f") == 0) | (F.col("c") < F.col("f")), "").otherwise(join(F.greatest(F.col("f"), F.lit(1)), F.col("c")))).otherwise(F.when(F.col("c") < 1, "").otherwise(join(F.lit(1), F.col("c"))))
    last = F.when(bare & (F.col("f") == 0), F.element_at("words", -1)).otherwise(join(F.col("c") + 1, F.col("k")))
    suffix = F.when(F.size("parts") > 2, F.col("parts")[1]).otherwise("")
    return n.select("key", (F.col("place") + 1).alias("place"), first.alias("first"), prefix.alias("prefix"), last.alias("last"), suffix.alias("suffix"))
