"""Scans and sinks of document files; all paths go through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tex_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: every file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


bib_files = tex_files


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of images; what can't be read is absent."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,svg,tif,tiff}").load(path).select("path", "content")


def with_media(media: DataFrame, files: DataFrame) -> DataFrame:
    """media (doc_id, media_id, name) with the contents of the files of that name; null where none can be read."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return media.join(named, "name", "left").select("doc_id", "media_id", "name", "content")


def located(media: DataFrame, files: DataFrame) -> DataFrame:
    """media (doc_id, media_id, name) with location: the path of the file of that name (its last part); empty where there is none."""
    last = F.element_at(F.split("name", "/"), -1)
    named = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("_last")).agg(F.min("path").alias("path"))
    return media.withColumn("_last", last).join(named, "_last", "left").select("doc_id", "media_id", "name", F.coalesce("path", F.lit("")).alias("location"))


def write_native(rows: DataFrame, path: str) -> None:
    rows.write.parquet(path)
