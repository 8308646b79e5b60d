"""Part references: counting, reconciliation, deduplication and garbage collection."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecat.functions import exprs


#: Name of the store that holds what no other store is named for.
DEFAULT = "default"


def blob_ids(chunks: DataFrame) -> DataFrame:
    """Distinct ids of stored blobs, of their chunks."""
    return chunks.select("part_id").distinct()


def named_stores(stores: dict[str, DataFrame]) -> DataFrame:
    """part_id and `store` of the parts of all named stores."""
    frames = [f.select("part_id", F.lit(name).alias("store")) for name, f in sorted(stores.items())]
    return functools.reduce(DataFrame.unionByName, frames)


def stores_for(rows: DataFrame, classes: dict[str, str], known: list[str]) -> DataFrame:
    """rows with `store`: by the recorded store name if there is one, else by the storage class, else the default one; and whether it is
    `known`. The configuration is a map in the expression, no join."""
    for name in classes.values():
        if name not in known:
            raise ValueError(f"storage class maps to unknown store {name}")
    by_class = F.create_map(*[F.lit(x) for kv in sorted(classes.items()) for x in kv]).cast("map<string,string>")
    store = F.coalesce("store_name", F.element_at(by_class, exprs.storage_class(F.col("storage_class"))), F.lit(DEFAULT))
    return rows.withColumn("store", store).withColumn("known", F.col("store").isin(DEFAULT, *known))


def sorted_refs(deltas: DataFrame) -> DataFrame:
    """Summed changes per object as one array of (part_id, delta) in the order of part ids, so that writers lock in one order."""
    sums = deltas.groupBy("object_id", "part_id").agg(F.sum("delta").alias("delta"))
    return sums.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("part_id", "delta"))).alias("refs"))


def ref_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part_id").agg(F.count("*").alias("refs"))


def reconcile(parts: DataFrame, registry: DataFrame) -> DataFrame:
    """What the registry must change so that each part's count is that of its references: INSERT, UPDATE or DELETE rows."""
    both = ref_counts(parts).join(registry.select("part_id", "ref_count"), "part_id", "full_outer")
    action = (
        F.when(F.col("ref_count").isNull(), "INSERT").when(F.col("refs").isNull(), "DELETE").when(F.col("refs") != F.col("ref_count"), "UPDATE")
    )
    return both.withColumn("action", action).where("action IS NOT NULL").select("part_id", "action", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("ref_count", F.lit(0)).alias("ref_count"))


def apply_deltas(registry: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add the deltas' sums to live counts; a condemned part (count 0) takes no reference, and no count falls below zero."""
    sums = deltas.groupBy("part_id").agg(F.sum("delta").alias("delta"))
    joined = registry.join(sums, "part_id", "left")
    ok = (F.col("ref_count") > 0) & (F.col("ref_count") + F.col("delta") >= 0)
    return joined.select("part_id", F.when(ok, F.col("ref_count") + F.col("delta")).otherwise(F.col("ref_count")).alias("ref_count"), F.coalesce(ok, F.lit(True)).alias("applied"))


def orphans(stored: DataFrame, parts: DataFrame, registry: DataFrame | None = None, created: Column | None = None, cutoff: Column | None = None) -> DataFrame:
    """Stored parts without references; with a registry, only those it does not count; with a cutoff, only those made before it."""
    left = stored.join(parts.select("part_id"), "part_id", "left_anti")
    if registry is not None:
        left = left.join(registry.where("ref_count != 0").select("part_id"), "part_id", "left_anti")
    return left if cutoff is None else left.where(created < cutoff)


def dedup_index(blobs: DataFrame) -> DataFrame:
    """One row per (sha256, size): the smallest id and, each on its own, the smallest of the other columns."""
    return blobs.groupBy("sha256", "size").agg(F.min("part_id").alias("part_id"), F.min("etag").alias("etag"), F.min("crc32").alias("crc32"), F.count("*").alias("copies"))


def dedup_lookup(blobs: DataFrame, index: DataFrame) -> DataFrame:
    """Blobs whose content the index holds under another id, all checksums verified."""
    held = index.select("sha256", "size", F.col("part_id").alias("shared_id"), F.col("etag").alias("i_etag"), F.col("crc32").alias("i_crc32"))
    hit = blobs.join(held, ["sha256", "size"]).where("etag = i_etag AND crc32 = i_crc32 AND part_id <> shared_id")
    return hit.select("part_id", "shared_id")


def prune_index(index: DataFrame, live: DataFrame) -> DataFrame:
    """Index rows whose part is not live any more."""
    return index.join(live.select("part_id"), "part_id", "left_anti")


def collect_garbage(parts: DataFrame, registry: DataFrame, stored: DataFrame, index: DataFrame | None = None, created: Column | None = None, cutoff: Column | None = None) -> dict[str, DataFrame]:
    """The steps of a collection: registry corrections, what is condemned under the corrected registry (stored before the cutoff), index rows
    whose part is condemned, and the parts to delete."""
    fixed = ref_counts(parts).select("part_id", F.col("refs").alias("ref_count"))
    condemned = orphans(stored, parts, fixed, created, cutoff)
    steps = {"corrections": reconcile(parts, registry), "condemned": condemned, "deletes": condemned.select("part_id").distinct()}
    return steps if index is None else steps | {"pruned": index.join(condemned.select("part_id"), "part_id", "left_semi")}
