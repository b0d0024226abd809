"""Helpers shared by the training-data operators: inputs, scratch tables, shipping of this package."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED = "foliospark.llm.shipped"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only where it is unset and Spark runs in one process, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return str(own.get()).rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='foliospark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The frame as a Parquet table in the shared scratch folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanly(df: DataFrame, name: str = "part") -> DataFrame:
    """written(), and Spark deletes the shuffle files of its plan as soon as the table stands, whether or not the driver collects its garbage."""
    conf, name_ = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name_, None)
    conf.set(name_, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(name_) if before is None else conf.set(name_, before)


def removed(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing needs it any more."""
    spark = df.sparkSession
    root = scratch_root(spark).removeprefix("file://").removeprefix("file:")
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder and re.search(r"-[0-9a-f]{32}$", folder):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hconf).delete(path, True)


def remainder(col, n: int):
    """crc32 of the id written as text, modulo n; the contracts hold rows out by it."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def lower_ascii(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python in smaller batches than Spark's ten thousand rows, so that long ones fit in a worker's memory."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = (spark.conf.get(name) or "").rstrip("b")
        now = int(now) if now.lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def texts(batch, name: str = "text") -> list[str]:
    """A string column of an Arrow batch as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


_FAR = np.uint64(0xD6E8FEB86659FD93)
#: Values of the 256 bytes at 64 places of a word, whose sums are the hashes of words; those of A-Z are those of a-z, blanks have none.
_BYTES = np.random.Generator(np.random.PCG64(78)).integers(1, (1 << 64) - 1, size=(64, 256), dtype=np.uint64)
_BYTES[:, ord("A") : ord("Z") + 1] = _BYTES[:, ord("a") : ord("z") + 1]
_BYTES[:, [32, *range(9, 14)]] = 0
_BYTES = _BYTES.reshape(-1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first place of each word of UTF-8 bytes; bytes of A-Z count as those of a-z."""
    blank = _BYTES[data] == 0
    start = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    if not len(start):
        return np.empty(0, dtype=np.uint64), start
    data = data[start[0] :]
    place = np.arange(start[0], start[0] + len(data)) - np.repeat(start, np.diff(np.append(start, start[0] + len(data))))
    values = _BYTES[(place & 63) << 8 | data]
    far = np.flatnonzero(place > 63)
    if len(far):
        values[far] *= (place[far] >> 6).astype(np.uint64) * _FAR * np.uint64(2) + np.uint64(1)
    hashes = np.add.reduceat(values, start - start[0])
    return hashes ^ (hashes >> np.uint64(32)), start
