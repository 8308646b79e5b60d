"""Sources and sinks of a catalog: blobs, audit logs, migration targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files of a filesystem part store: id from the file's name, and the content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("part_id"), "length", F.col("modificationTime").alias("modified"), "content")


def chunked_blobs(chunks: DataFrame) -> DataFrame:
    """Blobs of a store that keeps them as numbered chunks: joined in order."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", F.hex("content").alias("h"))))
    return chunks.groupBy("part_id").agg(F.unhex(F.array_join(F.transform(parts, lambda c: c["h"]), "")).alias("content"))


def catalog_tables(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A catalog kept in a database, read through JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_buckets(objects: DataFrame, path: str) -> None:
    """Migration target, one folder per bucket; refuses a target that holds data."""
    objects.write.mode("errorifexists").partitionBy("bucket").parquet(path)


def write_json_log(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").json(path)


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
