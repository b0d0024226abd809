"""Names with scopes: what a use sees of the definitions before it whose groups are still open.

stream: doc_id, seq, kind (open, close, def, provide, use), name, value. A definition holds from its place to the end of its group, so those of one name
lie in each other or apart. Hence the innermost one that holds at a use is the last before it among those with as many others around them: two windows
find it, and no definition meets a use by a join. A close without an open is nothing; groups that stay open hold to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _so_far(*keys: str, order: tuple = ("seq",), here: bool = True):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if here else -1)


def with_ends(stream: DataFrame) -> DataFrame:
    """Adds until: the place of the close that ends the group of a row; null where it stays open."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = stream.withColumn("_sum", F.sum(step).over(_so_far("doc_id")))
    rows = rows.withColumn("_low", F.least(F.min("_sum").over(_so_far("doc_id")), F.lit(0)))
    # a close that reaches a new low has no open
    stray = (F.col("kind") == "close") & (F.col("_low") < F.coalesce(F.lag("_low").over(Window.partitionBy("doc_id").orderBy("seq")), F.lit(0)))
    rows = rows.withColumn("_stray", stray).filter(~F.col("_stray")).withColumn("_in", F.col("_sum") - F.col("_low") + (F.col("kind") == "close").cast("int"))
    back = Window.partitionBy("doc_id", "_in").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("until", F.last(F.when(F.col("kind") == "close", F.col("seq")), ignorenulls=True).over(back)).drop("_sum", "_low", "_stray", "_in")


def looked_up(stream: DataFrame) -> DataFrame:
    """doc_id, seq, name, value, defined_at of every use: the value of the innermost, newest definition that holds there; null where none does.

    A provide defines a name only where none holds.
    """
    rows = with_ends(stream).filter("kind IN ('def', 'provide', 'use')").select("doc_id", "seq", "kind", "name", "value", "until", F.lit(1).alias("step"))
    defining = F.col("kind") != "use"
    ends = F.struct(F.col("until").alias("seq"), F.lit("end").alias("kind"), F.lit(-1).alias("step"), F.col("kind").alias("of"), F.col("seq").alias("began"))
    own = F.struct("seq", "kind", F.when(defining, 1).otherwise(0).alias("step"), F.col("kind").alias("of"), F.col("seq").alias("began"))
    rows = rows.select("doc_id", "name", "value", F.explode(F.when(defining & F.col("until").isNotNull(), F.array(own, ends)).otherwise(F.array(own))).alias("e")).select("doc_id", "name", "value", "e.*")
    by_name, order = ("doc_id", "name"), ("seq", "began")
    around = F.coalesce(F.sum("step").over(_so_far(*by_name, order=order, here=False)), F.lit(0))
    # whatever holds where a provide stands holds as long as it would, so those that define nothing needn't be told apart here
    idle = rows.withColumn("_idle", (F.col("kind") == "provide") & (around > 0))
    idle = idle.withColumn("_idle", F.max("_idle").over(Window.partitionBy(*by_name, "began", "of")))
    rows = idle.filter(~F.col("_idle")).withColumn("_depth", F.sum("step").over(_so_far(*by_name, order=order)))
    found = F.last(F.when(F.col("kind").isin("def", "provide"), F.struct("value", "seq")), ignorenulls=True).over(_so_far(*by_name, "_depth", order=order))
    rows = rows.withColumn("_found", F.when(F.col("_depth") > 0, found)).filter("kind = 'use'")
    return rows.select("doc_id", "seq", "name", F.col("_found.value").alias("value"), F.col("_found.seq").alias("defined_at"))
