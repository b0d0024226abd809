"""Documents as a stream: each new file is converted on its own, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus


def tex_stream(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    raw = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def converted(stream: DataFrame, form: str = "html") -> DataFrame:
    return corpus.pages(stream, form)
