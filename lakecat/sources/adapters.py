"""The driver's tables as catalog frames.

Keys, versions, parts, logs and events of an object store, taken from the generic tables; the mapping is the one thing here that
knows those tables. Timestamps stay without zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, key, size, etag, content and doc_id of documents as objects."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("bucket"),
        F.concat_ws("/", "lang", "source", "doc_id").alias("key"),
        F.col("n_chars").alias("size"),
        F.concat(F.lit('"'), F.md5(text.cast("binary")), F.lit('"')).alias("etag"),
        text.alias("content"),
        "doc_id",
    )


def objects_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket (host) and key (path) of pages."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("bucket"),
        F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1).alias("key"),
        F.length("html").cast("long").alias("size"),
    )


def objects_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, key, size, status, creation time and tags of orders as objects; open ones are pending uploads."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("bucket"),
        F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("key"),
        F.floor("o_totalprice").cast("long").alias("size"),
        F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("COMPLETED").alias("upload_status"),
        F.col("o_orderdate").alias("created_at"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("tags"),
        F.lit(None).cast("string").alias("storage_class"),
        F.col("o_orderkey").alias("object_id"),
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("upload_id"),
    )


def versions(spark: SparkSession, sf_dir: str, daily: bool = False, tagged: bool = False) -> DataFrame:
    """Object versions from events; daily=True gives each user a key for each day, tagged=True adds tags and storage class."""
    key = F.concat(F.lit("u/"), F.col("user_id"))
    if daily:
        key = F.concat_ws("/", key, F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), F.col("user_id") % 5).alias("bucket"),
        key.alias("key"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("version_id"),
        F.col("ts").alias("last_modified"),
        (F.col("event_type") == "error").alias("is_delete_marker"),
        F.floor(F.col("value") * 100).cast("long").alias("size"),
        *([F.create_map(F.lit("kind"), F.col("event_type")).alias("tags"), F.when(F.col("event_id") % 4 == 0, "GLACIER").alias("storage_class")] if tagged else []),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of objects from line items; the sequence numbers count in the order of all columns."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *[c for c in sorted(rows.columns) if c not in ("l_orderkey", "l_linenumber")])
    return rows.select(
        F.col("l_orderkey").alias("object_id"),
        F.col("l_partkey").alias("part_id"),
        F.row_number().over(order).alias("sequence_number"),
        F.col("l_quantity").cast("long").alias("size"),
    )


def part_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts of each object add up to. Their sequence numbers count from 1 on, so the last one is their number."""
    count = F.count("*")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("object_id")).agg(count.alias("n_parts"), F.sum(F.col("l_quantity").cast("long")).alias("parts_size"), count.alias("last_part"))


def part_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_size").cast("long").alias("ref_count"))


def upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded parts with contents, from conversations."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("object_id"), (F.col("turn") + 1).alias("part_number"), F.coalesce("text", F.lit("")).alias("content"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part outbox: a PUT or DELETE of a part for each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("part_id"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("operation"),
        F.col("ts").alias("next_attempt_at"),
        F.concat(F.lit("b"), F.col("user_id") % 5).alias("bucket"),
        F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("u/"), F.col("user_id"))).alias("key"),
        (F.col("event_id") % 12).cast("int").alias("attempts"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log entries from events, in the order of (ts, id)."""
    actor = F.nullif(F.col("user_id") % 10, F.lit(0))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("event_type").alias("operation"),
        F.coalesce(actor.cast("string"), F.lit("anonymous")).alias("actor"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "denied").otherwise("success").alias("outcome"),
        F.when(F.col("event_id") % 97 == 0, "timeout").otherwise("").alias("error"),
        "user_id",
    )


def object_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notification events."""
    names = {"signup": "ObjectCreated:Put", "purchase": "ObjectCreated:Copy", "click": "ObjectTagging:Put", "view": "ObjectTagging:Delete", "error": "ObjectRemoved:Delete"}
    mapped = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, "s3:" + v)])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.element_at(mapped, F.col("event_type")).alias("event_name"),
        F.concat(F.lit("b"), F.col("user_id") % 5).alias("bucket"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "images/").otherwise("docs/"), F.col("user_id"), F.when(F.col("event_id") % 3 == 0, ".jpg").otherwise(".txt")).alias("key"),
        F.floor(F.col("value") * 100).cast("long").alias("size"),
        "ts",
    )
