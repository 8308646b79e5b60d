"""Outboxes: last state per part, overlay on a base listing, claims, retries, scope heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecat.functions import exprs


def last_entries(outbox: DataFrame) -> DataFrame:
    """The entry with the highest id of each part, combined before the shuffle."""
    return outbox.groupBy("part_id").agg(F.max(F.struct("id", "operation")).alias("e")).select("part_id", "e.*")


def overlay(base: DataFrame, outbox: DataFrame) -> DataFrame:
    """Ids as a reader sees them: the base without parts whose last entry deletes, with those whose last entry puts."""
    last = last_entries(outbox)
    kept = base.join(last.where("operation = 'DELETE'"), "part_id", "left_anti").select("part_id")
    return kept.union(last.where("operation = 'PUT'").select("part_id")).distinct()


def claim_batch(outbox: DataFrame, now: Column, batch: int) -> DataFrame:
    """The next entries to work on: due ones by attempt time and id. The batch size is the limit."""
    return outbox.where(F.col("next_attempt_at") <= now).orderBy("next_attempt_at", "id").limit(batch)


def claim_next(outbox: DataFrame, now: Column, batch: int, max_attempts: int) -> DataFrame:
    """As claim_batch, without entries that another worker holds a lease on (lease_until after now) and without dead letters."""
    free = outbox.where((F.col("lease_until").isNull() | (F.col("lease_until") <= now)) & (F.col("attempts") < max_attempts))
    return claim_batch(free, now, batch)


def dispatched(batch: DataFrame, delivered: DataFrame, now: Column, least: int, most: int, max_attempts: int) -> DataFrame:
    """What becomes of claimed entries once publishing was tried (delivered: ids that went out): DELETE, RETRY with its next attempt, or
    DEAD after the last attempt. A claim counts as an attempt."""
    met = batch.join(delivered.select("id", F.lit(True).alias("ok")), "id", "left").withColumn("attempts", F.col("attempts") + 1)
    dead = F.col("attempts") >= max_attempts
    outcome = F.when(F.col("ok"), "DELETE").when(dead, "DEAD").otherwise("RETRY")
    at = now + F.make_dt_interval(secs=exprs.backoff_seconds(F.col("attempts"), least, most))
    return met.select("id", "attempts", outcome.alias("outcome"), F.when(outcome == "RETRY", at).alias("next_attempt_at"))


def entries_with(entries: DataFrame, tags: DataFrame, metadata: DataFrame) -> DataFrame:
    """Outbox entries with their tags and user metadata (id, key, value) as maps, null where there are none."""
    from lakecat.operators import listing

    return entries.join(listing.maps(tags, "id", "tag_set"), "id", "left").join(listing.maps(metadata, "id", "user_metadata"), "id", "left")


def barriers(outbox: DataFrame, reads: DataFrame) -> DataFrame:
    """The last entry that each read (read_id, scope: global, bucket or key; bucket; key) waits for, null where it waits for none.

    Entries with an empty bucket concern everything, those with an empty key their whole bucket.
    """
    ends = outbox.groupBy("bucket", "key").agg(F.max("id").alias("last_id"))
    everything = ends.agg(F.max("last_id").alias("all_last"), F.max(F.when(F.col("bucket") == "", F.col("last_id"))).alias("wide_last"))
    in_bucket = ends.where("bucket <> ''").groupBy("bucket").agg(F.max("last_id").alias("bucket_last"), F.max(F.when(F.col("key") == "", F.col("last_id"))).alias("bucket_wide"))
    own = ends.where("bucket <> '' AND key <> ''").withColumnRenamed("last_id", "key_last")
    # one row
    met = reads.join(in_bucket, "bucket", "left").join(own, ["bucket", "key"], "left").join(F.broadcast(everything))
    last = F.when(F.col("scope") == "global", F.col("all_last")).when(F.col("scope") == "bucket", F.greatest("bucket_last", "wide_last")).otherwise(F.greatest("key_last", "bucket_wide", "wide_last"))
    return met.select("read_id", "scope", last.alias("waits_for"))


def scope_heads(outbox: DataFrame) -> DataFrame:
    """First and last entry that a reader of each (bucket, key) waits for: the key's own and the bucket-wide ones (key '')."""
    own = outbox.groupBy("bucket", "key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    wide = own.where("key = ''").select("bucket", F.col("first_id").alias("w_first"), F.col("last_id").alias("w_last"))
    both = own.where("key <> ''").join(wide, "bucket", "left")
    return both.select("bucket", "key", F.least("first_id", "w_first").alias("first_id"), F.greatest("last_id", "w_last").alias("last_id"))


def retries(outbox: DataFrame, most: int, max_attempts: int) -> DataFrame:
    """Delay before the next attempt, or dead-lettered."""
    dead = F.col("attempts") >= max_attempts
    return outbox.select("id", "attempts", F.when(~dead, exprs.backoff_seconds(F.greatest("attempts", F.lit(1)), 1, most)).alias("delay_seconds"), dead.alias("dead"))


def chunks_joined(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each entry's content from its chunks in index order."""
    content = chunks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return entries.join(content, "id", "left").withColumn("content", F.array_join(F.coalesce(F.col("c.content"), F.array().cast("array<string>")), "")).drop("c")
