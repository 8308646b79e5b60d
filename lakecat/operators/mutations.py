"""Writes as batch deltas: each takes the catalog's frames and a frame of requests and returns rows to put in place, or outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakecat.functions import exprs


def append_parts(parts: DataFrame, appended: DataFrame) -> DataFrame:
    """parts with the appended ones (object_id, part_id, size, pos) after each object's last."""
    last = parts.groupBy("object_id").agg(F.max("sequence_number").alias("last"))
    own = F.row_number().over(Window.partitionBy("object_id").orderBy("pos"))
    new = appended.withColumn("own", own).join(last, "object_id", "left").withColumn("sequence_number", F.coalesce("last", F.lit(0)) + F.col("own"))
    return parts.select("object_id", "part_id", "sequence_number", "size").unionByName(new.select("object_id", "part_id", "sequence_number", "size"))


def copy_objects(objects: DataFrame, copies: DataFrame) -> DataFrame:
    """New objects for copies (object_id, new_key, directive, new_tags): contents are shared by reference, the storage class is not
    carried, tags come from the source (COPY) or from the request (REPLACE)."""
    met = objects.join(copies, "object_id")
    return met.select(
        "bucket", F.col("new_key").alias("key"), "size", F.col("object_id").alias("shares"),
        F.when(F.col("directive") == "REPLACE", F.col("new_tags")).otherwise(F.col("tags")).alias("tags"),
        exprs.storage_class(F.lit(None).cast("string")).alias("storage_class"),
    )


def shared_references(parts: DataFrame, copied: DataFrame) -> DataFrame:
    """How many references each part gains when objects (column shares) are copied."""
    return parts.join(copied.select(F.col("shares").alias("object_id")), "object_id").groupBy("part_id").agg(F.count("*").alias("delta"))


def create_buckets(buckets: DataFrame, asked: DataFrame) -> DataFrame:
    """Outcome per name asked for: Created, BucketAlreadyExists or InvalidBucketName; a name asked for twice is created once."""
    held = buckets.select("bucket", F.lit(True).alias("held")).distinct()
    met = asked.select("bucket").distinct().join(held, "bucket", "left")
    outcome = F.when(~exprs.valid_bucket_name(F.col("bucket")), "InvalidBucketName").when(F.col("held"), "BucketAlreadyExists").otherwise("Created")
    return met.select("bucket", outcome.alias("outcome"))


def delete_buckets(buckets: DataFrame, objects: DataFrame, asked: DataFrame) -> DataFrame:
    """Outcome per name asked for: Deleted, NoSuchBucket or BucketNotEmpty."""
    held = buckets.select("bucket", F.lit(True).alias("held")).distinct()
    full = objects.select("bucket", F.lit(True).alias("full")).distinct()
    met = asked.select("bucket").distinct().join(held, "bucket", "left").join(full, "bucket", "left")
    return met.select("bucket", F.when(F.col("held").isNull(), "NoSuchBucket").when(F.col("full"), "BucketNotEmpty").otherwise("Deleted").alias("outcome"))


def configure(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """Bucket configurations (bucket, kind, document) after changes (bucket, kind, seq, document; a null document deletes): the last change
    of each kind stands. Kinds are versioning, website, cors, lifecycle and notification."""
    last = changes.groupBy("bucket", "kind").agg(F.max(F.struct("seq", "document")).alias("c")).select("bucket", "kind", "c.document")
    kept = configs.join(last, ["bucket", "kind"], "left_anti").select("bucket", "kind", "document")
    return kept.unionByName(last.where("document IS NOT NULL"))


def upload_deltas(uploads: DataFrame, parts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads (upload_id, bucket, key) and parts (upload_id, part_number, etag, size) after commands (seq, op, upload_id, bucket, key, part_number, etag, size).

    CREATE opens an upload, PART stores or replaces a part, ABORT and COMPLETE close the upload and drop its parts; parts sent to an
    upload that is not open, or before it was, are refused, i.e. left out.
    """
    opened = commands.where("op = 'CREATE'").groupBy("upload_id").agg(F.min(F.struct("seq", "bucket", "key")).alias("o")).select("upload_id", F.col("o.seq").alias("since"), "o.bucket", "o.key")
    begun = uploads.select("upload_id", F.lit(-1).cast("long").alias("since"), "bucket", "key").unionByName(opened.join(uploads, "upload_id", "left_anti").select("upload_id", F.col("since").cast("long").alias("since"), "bucket", "key"))
    closed = commands.where("op IN ('ABORT', 'COMPLETE')").select("upload_id").distinct()
    open_ = begun.join(closed, "upload_id", "left_anti")
    sent = parts.select("upload_id", "part_number", F.lit(-1).cast("long").alias("seq"), "etag", "size").unionByName(commands.where("op = 'PART'").select("upload_id", "part_number", F.col("seq").cast("long").alias("seq"), "etag", "size"))
    fit = sent.join(open_.select("upload_id", "since"), "upload_id").where("seq >= since")
    last = fit.groupBy("upload_id", "part_number").agg(F.max(F.struct("seq", "etag", "size")).alias("p")).select("upload_id", "part_number", "p.etag", "p.size")
    return open_.select("upload_id", "bucket", "key"), last


def bulk_delete(objects: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each request (bucket, key, if_match): a missing key counts as deleted, a wrong ETag is refused."""
    held = objects.select("bucket", "key", "etag")
    met = requests.join(held, ["bucket", "key"], "left")
    refused = F.col("if_match").isNotNull() & F.col("etag").isNotNull() & ~exprs.if_match(F.col("etag"), F.col("if_match"))
    return met.select("bucket", "key", F.when(refused, "PreconditionFailed").otherwise("Deleted").alias("status"), F.col("etag").isNotNull().alias("existed"))


def move_class(objects: DataFrame, plan: DataFrame) -> DataFrame:
    """objects with the storage class of the plan (bucket, key, etag, to_class), where the ETag is still that of the plan."""
    asked = plan.select("bucket", "key", F.col("etag").alias("planned"), "to_class")
    met = objects.join(asked, ["bucket", "key"], "left")
    current = exprs.storage_class(F.col("storage_class"))
    return met.withColumn("storage_class", F.when(F.col("planned") == F.col("etag"), F.col("to_class")).otherwise(current)).drop("planned", "to_class")


def replace_tags(tags: DataFrame, puts: DataFrame) -> DataFrame:
    """Tag rows (object_id, key, value) after tag sets (object_id, tags map) were put: a set replaces all tags of its object."""
    kept = tags.join(puts.select("object_id"), "object_id", "left_anti")
    return kept.select("object_id", "key", "value").unionByName(puts.select("object_id", F.explode("tags").alias("key", "value")))


def tag_maps(tags: DataFrame) -> DataFrame:
    """One map of tags per object, keys in order."""
    return tags.groupBy("object_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("tags"))


def checksum_verdicts(declared: DataFrame, computed: DataFrame, kinds: list[str]) -> DataFrame:
    """Per object: the kinds whose declared checksum is not the computed one; what is not declared is not checked."""
    met = declared.join(computed.select("object_id", *[F.col(k).alias(f"own_{k}") for k in kinds]), "object_id")
    wrong = F.filter(F.array(*[F.when(F.col(k).isNotNull() & ~F.col(k).eqNullSafe(F.col(f"own_{k}")), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())
    return met.select("object_id", F.array_join(wrong, ",").alias("mismatched"))


def shard_ids(shards: list[DataFrame]) -> DataFrame:
    """Part ids that any shard holds."""
    out = shards[0].select("part_id")
    for s in shards[1:]:
        out = out.union(s.select("part_id"))
    return out.distinct()


def shard_health(shards: list[DataFrame], needed: int) -> DataFrame:
    """Per part: how many shards hold it, and whether it can be read (`needed` of them) and needs healing."""
    each = [s.select("part_id", F.lit(i).alias("shard")) for i, s in enumerate(shards)]
    all_ = each[0]
    for s in each[1:]:
        all_ = all_.unionByName(s)
    held = all_.groupBy("part_id").agg(F.count_distinct("shard").alias("shards"))
    return held.withColumns({"readable": F.col("shards") >= needed, "heal": F.col("shards") < len(shards)})


def replicate(rows: DataFrame, primary: Callable[[DataFrame], None], secondaries: list[Callable[[DataFrame], None]]) -> None:
    """Apply a write to the primary, then to each secondary; meant for foreachBatch."""
    rows = rows.persist()
    try:
        for sink in (primary, *secondaries):
            sink(rows)
    finally:
        rows.unpersist()
