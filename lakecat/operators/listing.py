"""Namespace listings. Each gives the first page of every bucket after its marker: ranks with a limit, which Spark prunes
before the shuffle, so a bucket's page costs its page size and not its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecat.functions import exprs


def _page(rows: DataFrame, order: list[Column], n: int, by: str = "bucket") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def list_objects(objects: DataFrame, prefix: str = "", start_after: str = "", page: int = 1000) -> DataFrame:
    """Completed objects after the marker in key order, with `rank` and `is_truncated` of the page.

    Where objects have versions, columns is_latest and is_delete_marker say which are listed: latest ones that are no marker.
    """
    rows = objects.where(F.startswith("key", F.lit(prefix)) & (F.col("key") > start_after) & (F.col("upload_status") == "COMPLETED"))
    if "is_latest" in objects.columns:
        rows = rows.where("is_latest AND NOT is_delete_marker")
    probed = _page(rows, [F.col("key")], page + 1)
    more = F.max("rank").over(Window.partitionBy("bucket")) > page
    return probed.withColumn("is_truncated", more).where(F.col("rank") <= page)


def with_common_prefix(objects: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    return objects.where(F.startswith("key", F.lit(prefix))).withColumn("common_prefix", exprs.common_prefix(F.col("key"), prefix, delimiter))


def common_prefixes(objects: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """Distinct (bucket, common_prefix)."""
    return with_common_prefix(objects, prefix, delimiter).where("common_prefix IS NOT NULL").select("bucket", "common_prefix").distinct()


def delimited_summary(objects: DataFrame, prefix: str = "", delimiter: str = "/", page: int = 1000) -> DataFrame:
    """Per bucket: matching keys, direct children, common prefixes, and whether a page of them is truncated."""
    rows = with_common_prefix(objects, prefix, delimiter)
    return rows.groupBy("bucket").agg(
        F.count("*").alias("n_keys"),
        F.count_if(F.col("common_prefix").isNull()).alias("n_contents"),
        F.count_distinct("common_prefix").alias("n_prefixes"),
        (F.count("*") > page).alias("is_truncated"),
    )


def delimited_page(objects: DataFrame, prefix: str = "", delimiter: str = "/", start_after: str = "", page: int = 1000) -> DataFrame:
    """First page of direct children and common prefixes, which share the page's budget: `name`, `common_prefix` (null for a child), `rank`,
    `is_truncated` and `next_marker`, the page's last name where more follows. A prefix that the marker names or lies below is over."""
    rows = with_common_prefix(objects.where(F.col("key") > start_after), prefix, delimiter)
    name = F.coalesce("common_prefix", "key")
    units = rows.where(F.col("common_prefix").isNull() | ~F.startswith(F.lit(start_after), F.col("common_prefix"))).groupBy("bucket", name.alias("name")).agg(F.max("common_prefix").alias("common_prefix"))
    probed = _page(units, [F.col("name")], page + 1)
    w = Window.partitionBy("bucket")
    more = F.max("rank").over(w) > page
    last = F.max(F.when(F.col("rank") <= page, F.col("name"))).over(w)
    return probed.withColumns({"is_truncated": more, "next_marker": F.when(more, last)}).where(F.col("rank") <= page)


def list_versions(versions: DataFrame, prefix: str = "", delimiter: str = "/", key_marker: str = "", page: int = 1000, version_marker: str = "") -> DataFrame:
    """First page of versions and common prefixes, which share the page's budget: a prefix takes one slot with its first row.

    With a version marker the page begins behind that version of the marked key.
    """
    after = F.col("key") > key_marker
    if version_marker:
        after = after | (F.col("key") == key_marker) & (exprs.version_order(F.col("version_id")) < exprs.version_order(F.lit(version_marker)))
    rows = with_common_prefix(versions.where(after), prefix, delimiter)
    order = [F.col("key"), exprs.version_order(F.col("version_id")).desc()]
    plain = rows.where("common_prefix IS NULL").select("bucket", F.lit(None).cast("string").alias("common_prefix"), "key", "version_id")
    rolled = rows.where("common_prefix IS NOT NULL").groupBy("bucket", "common_prefix").agg(F.min("key").alias("key")).select("bucket", "common_prefix", "key", F.lit(None).cast("string").alias("version_id"))
    probed = _page(plain.unionByName(rolled), order, page + 1)
    more = F.max("rank").over(Window.partitionBy("bucket")) > page
    return probed.withColumn("is_truncated", more).where(F.col("rank") <= page)


def list_uploads(objects: DataFrame, prefix: str = "", key_marker: str = "", upload_marker: str = "", page: int = 1000) -> DataFrame:
    """Pending uploads after the two-column marker, by key and upload id."""
    after = F.col("key") > key_marker
    if upload_marker:
        after = after | (F.col("key") == key_marker) & (F.col("upload_id") > upload_marker)
    rows = objects.where((F.col("upload_status") == "PENDING") & F.startswith("key", F.lit(prefix)) & after)
    return _page(rows, [F.col("key"), F.col("upload_id")], page)


def with_next_markers(page: DataFrame, second: str) -> DataFrame:
    """A page (bucket, rank, is_truncated, key and a second marker column) with next_key_marker and next_<second>_marker where more follows."""
    last = F.max_by(F.struct("key", second), "rank").over(Window.partitionBy("bucket"))
    return page.withColumns({"next_key_marker": F.when(F.col("is_truncated"), last["key"]), f"next_{second}_marker": F.when(F.col("is_truncated"), last[second])})


def list_uploads_delimited(objects: DataFrame, prefix: str = "", delimiter: str = "/", key_marker: str = "", page: int = 1000) -> DataFrame:
    """First page of pending uploads and common prefixes, in the order of key and upload id, with `is_truncated`."""
    pending = objects.where((F.col("upload_status") == "PENDING") & (F.col("key") > key_marker))
    rows = with_common_prefix(pending, prefix, delimiter)
    plain = rows.where("common_prefix IS NULL").select("bucket", "common_prefix", "key", "upload_id")
    rolled = rows.where("common_prefix IS NOT NULL").groupBy("bucket", "common_prefix").agg(F.min("key").alias("key")).select("bucket", "common_prefix", "key", F.lit(None).cast("string").alias("upload_id"))
    probed = _page(plain.unionByName(rolled), [F.col("key"), F.col("upload_id")], page + 1)
    more = F.max("rank").over(Window.partitionBy("bucket")) > page
    return probed.withColumn("is_truncated", more).where(F.col("rank") <= page)


def shape_versions(page: DataFrame) -> DataFrame:
    """A page's rows as a response names them: versions, delete markers and common prefixes, with ETag, size and class of versions only."""
    kind = F.when(F.col("common_prefix").isNotNull(), "CommonPrefix").when(F.col("is_delete_marker"), "DeleteMarker").otherwise("Version")
    version = F.col("kind") == "Version"
    return page.withColumn("kind", kind).select(
        "bucket", "rank", "kind", F.coalesce("common_prefix", "key").alias("name"), "version_id", "is_latest",
        F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_modified"),
        F.when(version, F.col("size")).alias("size"),
        F.when(version, exprs.storage_class(F.col("storage_class"))).alias("storage_class"),
    )


def shape_objects(page: DataFrame, version: int = 2, fetch_owner: bool = False, owner: str = "") -> DataFrame:
    """Per bucket the response to a listing: contents in order, KeyCount and NextContinuationToken (version 2) or NextMarker (1)."""
    item = F.struct("rank", "key", "size", exprs.storage_class(F.col("storage_class")).alias("storage_class"), *([F.lit(owner).alias("owner")] if fetch_owner or version == 1 else []))
    whole = page.groupBy("bucket").agg(F.sort_array(F.collect_list(item)).alias("contents"), F.first("is_truncated").alias("is_truncated"))
    last = F.element_at("contents", -1)["key"]
    if version == 1:
        return whole.withColumn("next_marker", F.when(F.col("is_truncated"), last))
    return whole.withColumns({"key_count": F.size("contents"), "next_continuation_token": F.when(F.col("is_truncated"), F.base64(last.cast("binary")))})


def list_parts(parts: DataFrame, marker: int = 0, page: int = 1000) -> DataFrame:
    """Parts of every object after the marker, and whether more are stored."""
    rows = parts.where(F.col("sequence_number") > marker)
    probed = _page(rows, [F.col("sequence_number")], page + 1, "object_id")
    more = F.max("rank").over(Window.partitionBy("object_id")) > page
    return probed.withColumn("is_truncated", more).where(F.col("rank") <= page).drop("rank")


def authorized(objects: DataFrame, allowed: DataFrame, on: str, page: int) -> DataFrame:
    """List only rows that a policy allows: the filter stands before the page's limit."""
    return _page(objects.join(allowed.select(on).distinct(), on, "left_semi"), [F.col("key")], page)


def head_objects(objects: DataFrame, sums: DataFrame) -> DataFrame:
    """Every object with what its parts add up to (`part_sums`); objects without parts have none."""
    return objects.join(sums, "object_id", "left")


def part_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("object_id").agg(F.count("*").alias("n_parts"), F.sum("size").alias("parts_size"), F.max("sequence_number").cast("long").alias("last_part"))


def head_buckets(asked: DataFrame, buckets: DataFrame) -> DataFrame:
    """Which of the buckets asked for exist."""
    held = buckets.select("bucket", F.lit(True).alias("held")).distinct()
    return asked.join(held, "bucket", "left").select("bucket", F.coalesce("held", F.lit(False)).alias("exists"))


def assembled(objects: DataFrame, parts: DataFrame, tags: DataFrame, metadata: DataFrame) -> DataFrame:
    """Objects with `parts` (in order; 10,000 at most), `tag_set` and `user_metadata` as maps; empty ones where there are none."""
    listed = parts.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("sequence_number", "part_id", "size"))).alias("parts"))
    out = objects.join(listed, "object_id", "left").join(maps(tags, "object_id", "tag_set"), "object_id", "left").join(maps(metadata, "object_id", "user_metadata"), "object_id", "left")
    empty = F.create_map().cast("map<string,string>")
    return out.withColumns({"parts": F.coalesce("parts", F.array().cast(out.schema["parts"].dataType)), "tag_set": F.coalesce("tag_set", empty), "user_metadata": F.coalesce("user_metadata", empty)})


def maps(pairs: DataFrame, by: str, name: str) -> DataFrame:
    """One map of (key, value) pairs per `by`, keys in ascending order; of equal keys the greatest value stays."""
    one = pairs.groupBy(by, "key").agg(F.max("value").alias("value"))
    return one.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias(name))


def head_versions(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """The versions asked for (bucket, key, version_id; `null` is the null version): outcome Found, DeleteMarker or NoSuchVersion."""
    held = versions.select("bucket", "key", "version_id", "is_delete_marker", "size", "last_modified")
    met = asked.join(held, ["bucket", "key", "version_id"], "left")
    outcome = F.when(F.col("is_delete_marker").isNull(), "NoSuchVersion").when(F.col("is_delete_marker"), "DeleteMarker").otherwise("Found")
    return met.select(*asked.columns, outcome.alias("outcome"), "size", "last_modified")


def null_versions(versions: DataFrame) -> DataFrame:
    """The null version of each key that has one."""
    return versions.where("version_id = 'null'")


def all_objects(objects: DataFrame) -> DataFrame:
    """Every completed object: what paging through all pages of a listing gives, as one scan."""
    return objects.where("upload_status = 'COMPLETED'")


def tags_of_page(page: DataFrame, tags: DataFrame) -> DataFrame:
    """A page's objects with their tags, fetched by one join."""
    own = tags.join(page.select("object_id").distinct(), "object_id", "left_semi")
    return page.join(maps(own, "object_id", "tag_set"), "object_id", "left")


def emptiness(buckets: DataFrame, objects: DataFrame) -> DataFrame:
    """Buckets that hold no object."""
    return buckets.join(objects, "bucket", "left_anti")


def routed_buckets(buckets: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    """Buckets with the storage they are routed to."""
    return buckets.join(routes, "route_key", "left").withColumn("storage", F.coalesce("storage", F.lit(default))).drop("route_key")


def fan_out_listing(frames: list[DataFrame]) -> DataFrame:
    """Union of the listings of several storages; equal names stay."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
