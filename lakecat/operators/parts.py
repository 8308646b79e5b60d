"""Multipart manifests: ranges, completeness, declared parts, ETags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(parts: DataFrame) -> DataFrame:
    """Adds `start` and `stop` of each part within its object."""
    w = Window.partitionBy("object_id").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("stop", F.sum("size").over(w)).withColumn("start", F.col("stop") - F.col("size"))


def slices(parts: DataFrame, start: int, stop: int) -> DataFrame:
    """What of each part a read of bytes [start, stop) of its object needs: skip so many bytes, take so many."""
    lo, hi = F.lit(start).cast("long"), F.lit(stop).cast("long")
    met = offsets(parts).where((F.col("start") < hi) & (F.col("stop") > lo))
    return met.withColumns({"skip": F.greatest(lo - F.col("start"), F.lit(0)), "take": F.least(hi, F.col("stop")) - F.greatest(lo, F.col("start"))})


def covered_part(parts: DataFrame, start: int, stop: int) -> DataFrame:
    """Parts that a range covers exactly: these can be copied by reference."""
    return offsets(parts).where((F.col("start") == start) & (F.col("stop") == stop))


def manifest(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """Per object: number and size of its parts, whether their numbers are 1..n, whether sizes add up to the object's."""
    sums = parts.groupBy("object_id").agg(F.count("*").alias("n_parts"), F.sum("size").alias("parts_size"), F.min("sequence_number").alias("first"), F.max("sequence_number").alias("last"), F.count_distinct("sequence_number").alias("n_numbers"))
    joined = objects.select("object_id", F.col("size").alias("object_size")).join(sums, "object_id", "left")
    return joined.select(
        "object_id",
        F.coalesce("n_parts", F.lit(0)).alias("n_parts"),
        F.coalesce("parts_size", F.lit(0)).alias("parts_size"),
        F.coalesce((F.col("first") == 1) & (F.col("last") == F.col("n_parts")) & (F.col("n_numbers") == F.col("n_parts")), F.lit(True)).alias("contiguous"),
        (F.coalesce("parts_size", F.lit(0)) == F.col("object_size")).alias("complete"),
    )


def check_declared(stored: DataFrame, declared: DataFrame) -> DataFrame:
    """Per upload: the verdict on its declared part list (object_id, part_number, etag, pos) against the stored parts."""
    w = Window.partitionBy("object_id").orderBy("pos")
    ordered = declared.withColumn("before", F.lag("part_number").over(w))
    both = ordered.select("object_id", "part_number", F.col("etag").alias("declared"), "before").join(stored.select("object_id", "part_number", F.col("etag").alias("stored")), ["object_id", "part_number"], "full_outer")
    return both.groupBy("object_id").agg(
        F.coalesce(F.bool_or(F.col("before") >= F.col("part_number")), F.lit(False)).alias("out_of_order"),
        F.count_if(F.col("stored").isNull()).alias("n_missing"),
        F.count_if(F.col("declared").isNull()).alias("n_omitted"),
        F.count_if(F.col("declared") != F.col("stored")).alias("n_mismatched"),
    ).withColumn("verdict", F.when(F.col("out_of_order"), "InvalidPartOrder").when(F.col("n_missing") + F.col("n_omitted") + F.col("n_mismatched") > 0, "InvalidPart").otherwise("ok"))


def multipart_etag(parts: DataFrame) -> DataFrame:
    """Per upload: quoted md5 of the parts' md5s in order, and the number of parts. An upload has 10,000 parts at most."""
    digests = F.sort_array(F.collect_list(F.struct("part_number", F.md5(F.col("content").cast("binary")).alias("md5"))))
    joined = parts.groupBy("object_id").agg(digests.alias("d"), F.sum(F.octet_length("content")).cast("long").alias("size"))
    etag = F.concat(F.lit('"'), F.md5(F.unhex(F.array_join("d.md5", ""))), F.lit("-"), F.size("d"), F.lit('"'))
    return joined.select("object_id", etag.alias("etag"), F.size("d").cast("long").alias("n_parts"), "size")


def composite_digests(parts: DataFrame) -> DataFrame:
    """Per upload: base64 of the composite SHA-1, SHA-256 and CRC-32 over the parts' own digests, in order."""
    data = F.col("content").cast("binary")
    own = F.struct("part_number", F.sha1(data).alias("sha1"), F.sha2(data, 256).alias("sha256"), F.lpad(F.hex(F.crc32(data)), 8, "0").alias("crc32"))
    d = parts.groupBy("object_id").agg(F.sort_array(F.collect_list(own)).alias("d"))
    raw = lambda c: F.unhex(F.array_join(f"d.{c}", ""))
    return d.select(
        "object_id",
        F.base64(F.unhex(F.sha1(raw("sha1")))).alias("sha1"),
        F.base64(F.unhex(F.sha2(raw("sha256"), 256))).alias("sha256"),
        F.base64(F.unhex(F.lpad(F.hex(F.crc32(raw("crc32"))), 8, "0"))).alias("crc32"),
    )
