"""Registry of the catalog queries: each binds an operator to the driver's tables, and beside it stands the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecat.functions import exprs
from lakecat.operators import audit as logs
from lakecat.operators import checksums, governance, lifecycle, listing, mutations, notify, outbox, registry
from lakecat.operators import parts as manifests
from lakecat.operators import versions as history
from lakecat.sources import adapters
from lakecat.sources.config import local_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The adapters' frames for DuckDB.
VIEWS = {
    "docs_o": """SELECT source AS bucket, lang || '/' || source || '/' || doc_id AS key, n_chars AS size, '"' || md5(coalesce(text, '')) || '"' AS etag,
        coalesce(text, '') AS content, doc_id FROM documents""",
    "pages_o": """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS bucket, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS key,
        length(html) AS size FROM pages""",
    "orders_o": """SELECT 'c' || (o_custkey % 7) AS bucket, o_orderpriority || '/' || o_orderkey AS key, floor(o_totalprice)::BIGINT AS size,
        CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'COMPLETED' END AS upload_status, o_orderdate AS created_at, o_orderstatus AS status,
        o_orderkey AS object_id, lpad(o_orderkey::VARCHAR, 10, '0') AS upload_id FROM orders""",
    "versions_o": """SELECT 'b' || (user_id % 5) AS bucket, 'u/' || user_id AS key, lpad(event_id::VARCHAR, 12, '0') AS version_id, ts AS last_modified,
        event_type = 'error' AS is_delete_marker, floor(value * 100)::BIGINT AS size, event_type AS kind,
        CASE WHEN event_id % 4 = 0 THEN 'GLACIER' ELSE 'STANDARD' END AS class FROM events""",
    "daily_o": """SELECT bucket, key || '/' || strftime(last_modified, '%Y-%m-%d') AS key, version_id, last_modified, is_delete_marker, size FROM versions_o""",
    "parts_o": """SELECT l_orderkey AS object_id, l_partkey AS part_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount,
        l_extendedprice, l_linestatus, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) AS sequence_number, l_quantity::BIGINT AS size FROM lineitem""",
    "outbox_o": """SELECT event_id AS id, user_id AS part_id, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS operation, ts AS next_attempt_at,
        'b' || (user_id % 5) AS bucket, CASE WHEN event_id % 50 = 0 THEN '' ELSE 'u/' || user_id END AS key, (event_id % 12)::INT AS attempts FROM events""",
    "audit_o": """SELECT event_id AS id, ts, event_type AS operation, coalesce(nullif(user_id % 10, 0)::VARCHAR, 'anonymous') AS actor,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'denied' ELSE 'success' END AS outcome,
        CASE WHEN event_id % 97 = 0 THEN 'timeout' ELSE '' END AS error, user_id FROM events""",
    "notif_o": """SELECT event_id AS id, 's3:' || CASE event_type WHEN 'signup' THEN 'ObjectCreated:Put' WHEN 'purchase' THEN 'ObjectCreated:Copy' WHEN 'click' THEN
        'ObjectTagging:Put' WHEN 'view' THEN 'ObjectTagging:Delete' WHEN 'error' THEN 'ObjectRemoved:Delete' END AS event_name, 'b' || (user_id % 5) AS bucket,
        CASE WHEN event_id % 2 = 0 THEN 'images/' ELSE 'docs/' END || user_id || CASE WHEN event_id % 3 = 0 THEN '.jpg' ELSE '.txt' END AS key,
        floor(value * 100)::BIGINT AS size, ts FROM events""",
    "history_o": """SELECT *, coalesce(sum(CASE WHEN n > 1 AND NOT is_delete_marker THEN 1 ELSE 0 END) OVER (PARTITION BY bucket, key ORDER BY n
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS newer, n = 1 AS is_latest
        FROM (SELECT *, row_number() OVER w AS n, lag(last_modified) OVER w AS noncurrent_since FROM versions_o
              WINDOW w AS (PARTITION BY bucket, key ORDER BY last_modified DESC, version_id DESC))""",
}


def sql(body: str) -> str:
    """The query with the views that it names, and those that these name, as common table expressions."""
    wanted: list[str] = []

    def want(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in wanted:
                want(VIEWS[name])
                wanted.append(name)

    want(body)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = body.strip()
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"


def query(oracle: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return put



def at(moment: str):
    return F.lit(moment).cast("timestamp_ntz")


#: The time of the sweeps.
NOW, NOW_VERSIONS = "2001-06-01 00:00:00", "2024-01-25 12:00:00"

# --- listings


@query("""SELECT bucket, key, size, 'STANDARD' AS storage_class, rank, more AS is_truncated FROM (
    SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS rank, count(*) OVER (PARTITION BY bucket) > 20 AS more
    FROM orders_o WHERE starts_with(key, '1-') AND key > '1-URGENT/2' AND upload_status = 'COMPLETED') WHERE rank <= 20""")
def list_prefix_topk(spark, sf):
    page = listing.list_objects(adapters.objects_orders(spark, sf), prefix="1-", start_after="1-URGENT/2", page=20)
    return page.select("bucket", "key", "size", exprs.storage_class(F.col("storage_class")).alias("storage_class"), F.col("rank").cast("long").alias("rank"), "is_truncated")


@query("""SELECT DISTINCT bucket, string_split(key, '/')[1] || '/' AS common_prefix FROM pages_o WHERE contains(key, '/')""")
def list_delim_prefixes(spark, sf):
    return listing.common_prefixes(adapters.objects_pages(spark, sf))


@query("""SELECT bucket, count(*) AS n_keys, count(*) FILTER (NOT contains(key, '/')) AS n_contents,
    count(DISTINCT CASE WHEN contains(key, '/') THEN string_split(key, '/')[1] END) AS n_prefixes, count(*) > 3 AS is_truncated FROM pages_o GROUP BY bucket""")
def list_delim_summary(spark, sf):
    return listing.delimited_summary(adapters.objects_pages(spark, sf), page=3)


@query("""WITH units AS (
      SELECT bucket, NULL AS common_prefix, key, version_id FROM daily_o WHERE len(string_split(key, '/')) <= 2
      UNION ALL SELECT bucket, string_split(key, '/')[1] || '/' || string_split(key, '/')[2] || '/', min(key), NULL FROM daily_o
      WHERE len(string_split(key, '/')) > 2 AND key > 'u/11' AND starts_with(key, 'u/') GROUP BY ALL
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, version_id DESC) AS rank, count(*) OVER (PARTITION BY bucket) > 7 AS is_truncated FROM units)
    SELECT bucket, common_prefix, key, version_id, rank, is_truncated FROM ranked WHERE rank <= 7""")
def list_versions_page(spark, sf):
    page = listing.list_versions(adapters.versions(spark, sf, daily=True), prefix="u/", key_marker="u/11", page=7)
    return page.select("bucket", "common_prefix", "key", "version_id", F.col("rank").cast("long").alias("rank"), "is_truncated")


@query("""SELECT bucket, key, version_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, coalesce(nullif(version_id, 'null'), '') DESC) AS rank
    FROM versions_o WHERE starts_with(key, 'u/1')) WHERE rank <= 50""")
def list_versions_flat(spark, sf):
    page = listing.list_versions(adapters.versions(spark, sf), prefix="u/1", delimiter="#", page=50)
    return page.select("bucket", "key", "version_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT bucket, key, upload_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, upload_id) AS rank FROM orders_o
    WHERE upload_status = 'PENDING' AND (key > '2-HIGH/1' OR (key = '2-HIGH/1' AND upload_id > '0000000005'))) WHERE rank <= 15""")
def list_uploads_page(spark, sf):
    page = listing.list_uploads(adapters.objects_orders(spark, sf), key_marker="2-HIGH/1", upload_marker="0000000005", page=15)
    return page.select("bucket", "key", "upload_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT object_id, part_id, sequence_number::INT AS sequence_number, size, n > 3 AS is_truncated FROM (
    SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY sequence_number) AS r, count(*) OVER (PARTITION BY object_id) AS n FROM parts_o
    WHERE sequence_number > 1) WHERE r <= 3""")
def list_parts_page(spark, sf):
    return listing.list_parts(adapters.parts(spark, sf), marker=1, page=3)


@query("""SELECT bucket, key, o.size, status, n_parts, parts_size, last_part FROM orders_o o LEFT JOIN (SELECT object_id, count(*) AS n_parts,
    sum(size)::BIGINT AS parts_size, max(sequence_number) AS last_part FROM parts_o GROUP BY object_id) p USING (object_id)""")
def head_object_full(spark, sf):
    heads = listing.head_objects(adapters.objects_orders(spark, sf), adapters.part_sums(spark, sf))
    return heads.select("bucket", "key", "size", F.element_at("tags", "status").alias("status"), "n_parts", "parts_size", "last_part")


@query("""SELECT n_name AS name, coalesce(r_name, 'default') AS storage FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) ON n_regionkey = r_regionkey
    UNION ALL SELECT s_name, 'default' FROM supplier""")
def bucket_union_routed(spark, sf):
    nations = adapters.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("route_key"))
    suppliers = adapters.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit(None).cast("int").alias("route_key"))
    routes = adapters.table(spark, sf, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("route_key"), F.col("r_name").alias("storage"))
    return listing.routed_buckets(listing.fan_out_listing([nations, suppliers]), routes, "default")


@query("""SELECT p_partkey AS bucket FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)""")
def bucket_emptiness(spark, sf):
    buckets = adapters.table(spark, sf, "part").select(F.col("p_partkey").alias("bucket"))
    return listing.emptiness(buckets, adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("bucket")))


@query("""SELECT bucket, key, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS rank FROM docs_o
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)) WHERE rank <= 5""")
def authorized_listing(spark, sf):
    allowed = adapters.table(spark, sf, "labels").where("quality = 1 AND toxic = 0")
    page = listing.authorized(adapters.objects_docs(spark, sf), allowed, "doc_id", 5)
    return page.select("bucket", "key", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT n_name AS bucket, n_nationkey IN (SELECT s_nationkey FROM supplier) AS exists FROM nation""")
def head_bucket(spark, sf):
    nation = adapters.table(spark, sf, "nation").select(F.col("n_name").alias("bucket"), "n_nationkey")
    held = adapters.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("bucket")
    return listing.head_buckets(nation.select("bucket"), held)


@query("""SELECT o_orderkey AS object_id, coalesce(n, 0)::INT AS n_parts, p AS parts, 'status=' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ',team=t' || o_custkey ELSE '' END AS tags, CASE WHEN o_orderkey % 3 = 0 THEN 'p=' || o_orderpriority ELSE '' END AS metadata
    FROM orders LEFT JOIN (SELECT object_id, count(*) AS n, string_agg(part_id, ',' ORDER BY sequence_number) AS p FROM parts_o GROUP BY 1) ON object_id = o_orderkey""")
def head_object_assembled(spark, sf):
    orders = adapters.table(spark, sf, "orders")
    tag = lambda k, v: orders.select(F.col("o_orderkey").alias("object_id"), F.lit(k).alias("key"), v.alias("value"))
    tags = tag("status", F.col("o_orderstatus")).unionByName(tag("team", F.concat(F.lit("t"), "o_custkey")).where("object_id % 2 = 0"))
    metadata = tag("p", F.col("o_orderpriority")).where("object_id % 3 = 0")
    heads = listing.assembled(orders.select(F.col("o_orderkey").alias("object_id")), adapters.parts(spark, sf), tags, metadata)
    joined = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    listed = F.when(F.size("parts") > 0, F.array_join("parts.part_id", ","))
    return heads.select("object_id", F.size("parts").alias("n_parts"), listed.alias("parts"), joined("tag_set").alias("tags"), joined("user_metadata").alias("metadata"))


@query("""SELECT bucket, key, version_id, CASE WHEN lost THEN 'NoSuchVersion' WHEN is_delete_marker THEN 'DeleteMarker' ELSE 'Found' END AS outcome, CASE WHEN NOT lost THEN size END AS size,
    CASE WHEN NOT lost THEN last_modified END AS last_modified FROM (SELECT * REPLACE (CASE WHEN version_id::BIGINT % 7 = 0 THEN '?' || version_id ELSE version_id END AS version_id), version_id::BIGINT % 7 = 0 AS lost FROM versions_o)""")
def head_object_version(spark, sf):
    versions = adapters.versions(spark, sf)
    odd = F.col("version_id").cast("long") % 7 == 0
    return listing.head_versions(versions, versions.select("bucket", "key", F.when(odd, F.concat(F.lit("?"), "version_id")).otherwise(F.col("version_id")).alias("version_id")))


@query("""SELECT bucket, key, size FROM versions_o WHERE version_id::BIGINT % 11 = 0""")
def null_version_lookup(spark, sf):
    named = adapters.versions(spark, sf).withColumn("version_id", F.when(F.col("version_id").cast("long") % 11 == 0, "null").otherwise(F.col("version_id")))
    return listing.null_versions(named).select("bucket", "key", "size")


@query("SELECT bucket, key, size FROM orders_o WHERE upload_status = 'COMPLETED'")
def list_all_objects(spark, sf):
    return listing.all_objects(adapters.objects_orders(spark, sf)).select("bucket", "key", "size")


@query("""SELECT bucket, key, version_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS rank FROM history_o
    WHERE is_latest AND NOT is_delete_marker AND key > 'u/2') WHERE rank <= 10""")
def list_latest_objects(spark, sf):
    rows = history.noncurrent(adapters.versions(spark, sf)).withColumn("upload_status", F.lit("COMPLETED"))
    return listing.list_objects(rows, start_after="u/2", page=10).select("bucket", "key", "version_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH u AS (SELECT DISTINCT bucket, CASE WHEN contains(key, '/') THEN split_part(key, '/', 1) || '/' ELSE key END AS name, CASE WHEN contains(key, '/') THEN split_part(key, '/', 1) || '/' END AS common_prefix
      FROM pages_o WHERE key > 'de/5'), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY name) AS rank, count(*) OVER (PARTITION BY bucket) > 3 AS is_truncated FROM u WHERE name <> 'de/')
    SELECT bucket, name, common_prefix, rank, is_truncated, CASE WHEN is_truncated THEN max(name) OVER (PARTITION BY bucket) END AS next_marker FROM r WHERE rank <= 3""")
def list_delim_page(spark, sf):
    page = listing.delimited_page(adapters.objects_pages(spark, sf), start_after="de/5", page=3)
    return page.withColumn("rank", F.col("rank").cast("long"))


@query("""WITH r AS (SELECT bucket, key, version_id, row_number() OVER (PARTITION BY bucket ORDER BY key, version_id DESC) AS rank, count(*) OVER (PARTITION BY bucket) > 9 AS is_truncated FROM versions_o
      WHERE key > 'u/11' OR key = 'u/11' AND version_id < '000000000500')
    SELECT *, CASE WHEN is_truncated THEN max_by(key, rank) OVER (PARTITION BY bucket) END AS next_key_marker, CASE WHEN is_truncated THEN max_by(version_id, rank) OVER (PARTITION BY bucket) END AS next_version_id_marker
    FROM r WHERE rank <= 9""")
def list_versions_continued(spark, sf):
    page = listing.list_versions(adapters.versions(spark, sf), delimiter="#", key_marker="u/11", page=9, version_marker="000000000500")
    return listing.with_next_markers(page.select("bucket", "key", "version_id", F.col("rank").cast("long").alias("rank"), "is_truncated"), "version_id")


@query("""WITH u AS (SELECT DISTINCT bucket, split_part(key, '/', 1) || '/' AS common_prefix FROM orders_o WHERE upload_status = 'PENDING' AND key > '2-HIGH'),
      r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY common_prefix) AS rank, count(*) OVER (PARTITION BY bucket) > 2 AS is_truncated FROM u)
    SELECT bucket, common_prefix, rank, is_truncated FROM r WHERE rank <= 2""")
def list_uploads_delimited(spark, sf):
    page = listing.list_uploads_delimited(adapters.objects_orders(spark, sf), key_marker="2-HIGH", page=2)
    return page.select("bucket", "common_prefix", F.col("rank").cast("long").alias("rank"), "is_truncated")


@query("""SELECT bucket, rank, CASE WHEN is_delete_marker THEN 'DeleteMarker' ELSE 'Version' END AS kind, key AS name, version_id, is_latest, strftime(last_modified, '%Y-%m-%dT%H:%M:%SZ') AS last_modified,
    CASE WHEN NOT is_delete_marker THEN size END AS size, CASE WHEN NOT is_delete_marker THEN class END AS storage_class
    FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key, version_id DESC) AS rank FROM history_o) WHERE rank <= 30""")
def shape_versions(spark, sf):
    rows = history.noncurrent(adapters.versions(spark, sf, tagged=True))
    page = listing.list_versions(rows, delimiter="#", page=30).select("bucket", "common_prefix", "key", "version_id", "rank")
    own = rows.select("key", "version_id", "is_delete_marker", "is_latest", "last_modified", "size", "storage_class")
    return listing.shape_versions(page.join(own, ["key", "version_id"])).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS r, count(*) OVER (PARTITION BY bucket) > 20 AS t FROM orders_o WHERE upload_status = 'COMPLETED')
    SELECT bucket, string_agg(key, ',' ORDER BY key) AS keys, count(*)::INT AS key_count, CASE WHEN any_value(t) THEN base64(encode(max(key))) END AS next_continuation_token FROM p WHERE r <= 20 GROUP BY 1""")
def shape_objects(spark, sf):
    shaped = listing.shape_objects(listing.list_objects(adapters.objects_orders(spark, sf), page=20))
    return shaped.select("bucket", F.array_join("contents.key", ",").alias("keys"), "key_count", "next_continuation_token")


@query("""SELECT bucket, key, rank, 'quality=' || quality || ',toxic=' || toxic AS tags FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS rank FROM docs_o) LEFT JOIN labels USING (doc_id) WHERE rank <= 50""")
def page_tags(spark, sf):
    labels = adapters.table(spark, sf, "labels").select(F.col("doc_id").alias("object_id"), F.explode(F.create_map(F.lit("toxic"), F.col("toxic").cast("string"), F.lit("quality"), F.col("quality").cast("string"))).alias("key", "value"))
    rows = adapters.objects_docs(spark, sf).select("bucket", "key", F.col("doc_id").alias("object_id")).withColumn("upload_status", F.lit("COMPLETED"))
    page = listing.tags_of_page(listing.list_objects(rows, page=50), labels)
    joined = F.array_join(F.transform(F.map_entries("tag_set"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return page.select("bucket", "key", F.col("rank").cast("long").alias("rank"), joined.alias("tags"))


# --- versions


@query("""SELECT bucket, key, last_modified, version_id, is_delete_marker, size, n_versions FROM (SELECT *, count(*) OVER (PARTITION BY bucket, key) AS n_versions,
    row_number() OVER (PARTITION BY bucket, key ORDER BY last_modified DESC, version_id DESC) AS n FROM versions_o) WHERE n = 1""")
def latest_versions(spark, sf):
    return history.latest(adapters.versions(spark, sf))


@query("""SELECT bucket, key, version_id, last_modified, is_delete_marker, size FROM history_o WHERE n = 2""")
def promote_after_delete(spark, sf):
    return history.promoted(adapters.versions(spark, sf))


@query("""SELECT bucket, key, version_id, is_delete_marker, is_latest, noncurrent_since, newer FROM history_o""")
def noncurrent_windows(spark, sf):
    return history.noncurrent(adapters.versions(spark, sf)).select("bucket", "key", "version_id", "is_delete_marker", "is_latest", "noncurrent_since", "newer")


def _commands(spark, sf):
    return adapters.versions(spark, sf).select("bucket", "key", F.col("version_id").cast("long").alias("id"), F.when(F.col("is_delete_marker"), "DELETE").otherwise("PUT").alias("op"), "size")


@query("""SELECT bucket, key, 'null' AS version_id, size FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY version_id DESC) AS n FROM versions_o)
    WHERE n = 1 AND NOT is_delete_marker""")
def fold_unversioned(spark, sf):
    return history.fold(_commands(spark, sf), "disabled").select("bucket", "key", "version_id", "size")


@query("""SELECT bucket, key, version_id::BIGINT::VARCHAR AS version_id, is_delete_marker, version_id = max(version_id) OVER (PARTITION BY bucket, key) AS is_latest FROM versions_o""")
def fold_versioned(spark, sf):
    return history.fold(_commands(spark, sf), "enabled").select("bucket", "key", "version_id", "is_delete_marker", "is_latest")


@query("""SELECT bucket, key, is_delete_marker, size FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY version_id DESC) AS n FROM versions_o) WHERE n = 1""")
def fold_suspended(spark, sf):
    return history.fold(_commands(spark, sf), "suspended").select("bucket", "key", "is_delete_marker", "size")


@query("""SELECT bucket, key, CASE WHEN id % 3 = 0 THEN id::VARCHAR ELSE 'null' END AS version_id, is_delete_marker, id = newest AS is_latest FROM (SELECT *, version_id::BIGINT AS id,
      max(version_id::BIGINT) OVER w AS newest, max(CASE WHEN version_id::BIGINT % 3 <> 0 THEN version_id::BIGINT END) OVER w AS last_null FROM versions_o WINDOW w AS (PARTITION BY bucket, key))
    WHERE id % 3 = 0 OR id = last_null""")
def fold_changing_versioning(spark, sf):
    """Commands of a bucket whose versioning goes on and off."""
    commands = _commands(spark, sf).withColumn("versioning", F.when(F.col("id") % 3 == 0, "enabled").otherwise("suspended"))
    return history.fold_states(commands).select("bucket", "key", "version_id", "is_delete_marker", "is_latest")


@query("""SELECT o_custkey AS id, o_orderstatus AS state FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderstatus <> 'P'
    UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def merge_delta(spark, sf):
    base = adapters.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"))
    last = adapters.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"))
    return history.merge_delta(base, last.withColumn("deleted", F.col("state") == "P"), ["id"])


# --- lifecycle

_RULES = [
    {"bucket": "c0", "rule_pos": 0, "id": "old", "exp_days": 365},
    {"bucket": "c0", "rule_pos": 1, "id": "older", "exp_days": 900},
    {"bucket": "c1", "rule_pos": 0, "id": "urgent", "prefix": "1-URGENT/", "exp_days": 30, "size_gt": 100000, "size_lt": 300000},
    {"bucket": "c2", "rule_pos": 0, "id": "date", "exp_date": "2001-01-01"},
    {"bucket": "c2", "rule_pos": 1, "id": "future", "exp_date": "2099-01-01"},
    {"bucket": "c3", "rule_pos": 0, "id": "tagged", "want_tags": {"status": "F"}, "exp_days": 100, "transitions": [(30, None, "GLACIER")]},
    {"bucket": "c3", "rule_pos": 1, "id": "both tags", "want_tags": {"status": "O", "owner": "none"}, "exp_days": 1},
    {"bucket": "c4", "rule_pos": 0, "id": "tiers", "transitions": [(30, None, "STANDARD_IA"), (900, None, "GLACIER"), (900, None, "DEEP_ARCHIVE")]},
    {"bucket": "c4", "rule_pos": 1, "id": "low", "prefix": "5-LOW/", "transitions": [(1500, None, "DEEP_ARCHIVE")]},
    {"bucket": "c4", "rule_pos": 2, "id": "off", "enabled": False, "exp_days": 1, "abort_days": 1},
    {"bucket": "c5", "rule_pos": 0, "id": "abort", "abort_days": 7},
    {"bucket": "c6", "rule_pos": 0, "id": "both", "prefix": "2", "abort_days": 400, "exp_days": 1200, "transitions": [(10, None, "GLACIER")]},
]
#: The enabled ones as tables, and what a sweep of the reference's order finds: objects, then uploads, each by itself.
_VALUES = """rules(bucket, rule_pos, id, prefix, size_gt, size_lt, tag, days, date) AS (VALUES
    ('c0', 0, 'old', '', NULL, NULL, NULL, 365, NULL::TIMESTAMP), ('c0', 1, 'older', '', NULL, NULL, NULL, 900, NULL), ('c1', 0, 'urgent', '1-URGENT/', 100000, 300000, NULL, 30, NULL),
    ('c2', 0, 'date', '', NULL, NULL, NULL, NULL, TIMESTAMP '2001-01-01'), ('c2', 1, 'future', '', NULL, NULL, NULL, NULL, TIMESTAMP '2099-01-01'),
    ('c3', 0, 'tagged', '', NULL, NULL, 'F', 100, NULL), ('c6', 0, 'both', '2', NULL, NULL, NULL, 1200, NULL)),
  moves(bucket, rule_pos, t_pos, id, prefix, tag, days, to_class) AS (VALUES ('c3', 0, 0, 'tagged', '', 'F', 30, 'GLACIER'), ('c4', 0, 0, 'tiers', '', NULL, 30, 'STANDARD_IA'),
    ('c4', 0, 1, 'tiers', '', NULL, 900, 'GLACIER'), ('c4', 0, 2, 'tiers', '', NULL, 900, 'DEEP_ARCHIVE'), ('c4', 1, 0, 'low', '5-LOW/', NULL, 1500, 'DEEP_ARCHIVE'), ('c6', 0, 0, 'both', '2', NULL, 10, 'GLACIER')),
  stops(bucket, prefix, days) AS (VALUES ('c5', '', 7), ('c6', '2', 400)),
  expire AS (SELECT bucket, key, min_by(id, rule_pos) AS rule_id, min_by(due, rule_pos) AS due FROM (
      SELECT o.bucket, key, rule_pos, id, coalesce(date_trunc('day', created_at + to_days(days)) + INTERVAL 1 DAY, date) AS due FROM orders_o o JOIN rules r ON o.bucket = r.bucket
        AND starts_with(key, prefix) AND (size_gt IS NULL OR size > size_gt) AND (size_lt IS NULL OR size < size_lt) AND (tag IS NULL OR tag = status) AND upload_status = 'COMPLETED')
      WHERE due <= TIMESTAMP '2001-06-01' GROUP BY ALL),
  move AS (SELECT bucket, key, id AS rule_id, to_class, due FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY due DESC, rule_pos, t_pos) AS n FROM (
      SELECT o.bucket, key, rule_pos, t_pos, id, to_class, date_trunc('day', created_at + to_days(days)) + INTERVAL 1 DAY AS due FROM orders_o o JOIN moves m ON o.bucket = m.bucket
        AND starts_with(key, prefix) AND (tag IS NULL OR tag = status) AND upload_status = 'COMPLETED') WHERE due <= TIMESTAMP '2001-06-01') WHERE n = 1),
  stop AS (SELECT bucket, key, upload_id, min(due) AS due FROM (SELECT o.bucket, key, upload_id, date_trunc('day', created_at + to_days(days)) + INTERVAL 1 DAY AS due
      FROM orders_o o JOIN stops s ON o.bucket = s.bucket AND starts_with(key, prefix) AND upload_status = 'PENDING') WHERE due <= TIMESTAMP '2001-06-01' GROUP BY ALL)"""


def _rules(spark):
    import datetime

    asked = [r | ({"exp_date": datetime.datetime.fromisoformat(r["exp_date"])} if "exp_date" in r else {}) for r in _RULES]
    return lifecycle.rules_frame(spark, asked)


@query(f"WITH {_VALUES} SELECT bucket, key, rule_id, due FROM expire")
def lifecycle_expire(spark, sf):
    return lifecycle.expirations(adapters.objects_orders(spark, sf), _rules(spark), at(NOW))


@query(f"WITH {_VALUES} SELECT bucket, key, rule_id, to_class, due FROM move")
def lifecycle_transition_pick(spark, sf):
    return lifecycle.transitions(adapters.objects_orders(spark, sf), _rules(spark), at(NOW))


@query(f"WITH {_VALUES} SELECT bucket, key, upload_id, due FROM stop")
def lifecycle_abort_uploads(spark, sf):
    return lifecycle.aborts(adapters.objects_orders(spark, sf), _rules(spark), at(NOW))


_VERSION_RULES = [
    {"bucket": "b0", "rule_pos": 0, "id": "one", "nc_days": 3, "nc_newer": 1, "expired_markers": True},
    {"bucket": "b1", "rule_pos": 0, "id": "any", "nc_days": 10, "nc_transitions": [(2, None, "STANDARD_IA"), (6, 2, "GLACIER")]},
    {"bucket": "b1", "rule_pos": 1, "id": "large", "size_gt": 5000, "expired_markers": True},
    {"bucket": "b2", "rule_pos": 0, "id": "some", "prefix": "u/1", "nc_days": 1, "nc_newer": 5, "expired_markers": True},
    {"bucket": "b2", "rule_pos": 1, "id": "big", "size_gt": 5000, "nc_days": 8, "nc_transitions": [(1, None, "GLACIER")]},
    {"bucket": "b3", "rule_pos": 0, "id": "clicks", "want_tags": {"kind": "click"}, "nc_days": 4, "nc_transitions": [(1, None, "GLACIER")]},
    {"bucket": "b3", "rule_pos": 1, "id": "views", "want_tags": {"kind": "view"}, "nc_days": 2},
    {"bucket": "b4", "rule_pos": 0, "id": "off", "enabled": False, "nc_days": 1, "expired_markers": True},
]
#: What a sweep does to versions, from the rules' text: `vgone`, `vmove` and `marker` in DuckDB, over all versions or one key a day.
_VERSIONS = """nr(bucket, rule_pos, prefix, size_gt, tag, days, newer) AS (VALUES ('b0', 0, '', -1, NULL, 3, 1), ('b1', 0, '', -1, NULL, 10, -1), ('b2', 0, 'u/1', -1, NULL, 1, 5),
      ('b2', 1, '', 5000, NULL, 8, -1), ('b3', 0, '', -1, 'click', 4, -1), ('b3', 1, '', -1, 'view', 2, -1)),
    nt(bucket, rule_pos, t_pos, size_gt, tag, days, newer, to_class) AS (VALUES ('b1', 0, 0, -1, NULL, 2, -1, 'STANDARD_IA'), ('b1', 0, 1, -1, NULL, 6, 2, 'GLACIER'),
      ('b2', 1, 0, 5000, NULL, 1, -1, 'GLACIER'), ('b3', 0, 0, -1, 'click', 1, -1, 'GLACIER')),
    vgone AS (SELECT bucket, key, version_id, min(rule_pos)::INT AS rule_pos, min_by(due, rule_pos) AS due FROM (SELECT h.*, rule_pos, date_trunc('day', noncurrent_since + to_days(days)) + INTERVAL 1 DAY AS due
      FROM history_o h JOIN nr r ON h.bucket = r.bucket AND starts_with(key, prefix) AND (r.size_gt < 0 OR size > r.size_gt) AND (tag IS NULL OR tag = kind) AND h.newer > r.newer WHERE NOT is_latest AND NOT is_delete_marker)
      WHERE due <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY bucket, key, version_id),
    vmove AS (SELECT bucket, key, version_id, to_class, due FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key, version_id ORDER BY due DESC, rule_pos, t_pos) AS pick FROM (
      SELECT h.bucket, key, version_id, rule_pos, t_pos, to_class, date_trunc('day', noncurrent_since + to_days(days)) + INTERVAL 1 DAY AS due
      FROM history_o h JOIN nt r ON h.bucket = r.bucket AND (r.size_gt < 0 OR size > r.size_gt) AND (tag IS NULL OR tag = kind) AND h.newer > r.newer AND class <> to_class WHERE NOT is_latest AND NOT is_delete_marker)
      WHERE due <= TIMESTAMP '2024-01-25 12:00:00') WHERE pick = 1)"""


def _version_rules(spark):
    return lifecycle.rules_frame(spark, _VERSION_RULES)


@query("""SELECT bucket, key, n_markers, version_id FROM (SELECT bucket, key, count(*) AS n_markers, arg_max(version_id, (last_modified, version_id)) AS version_id,
      arg_max(size, (last_modified, version_id)) AS size FROM daily_o GROUP BY ALL HAVING bool_and(is_delete_marker))
    WHERE bucket = 'b0' OR bucket = 'b1' AND size > 5000 OR bucket = 'b2' AND starts_with(key, 'u/1')""")
def lifecycle_delete_markers(spark, sf):
    return lifecycle.expired_markers(adapters.versions(spark, sf, daily=True), _version_rules(spark))


@query(f"WITH {_VERSIONS} SELECT * FROM vgone")
def lifecycle_noncurrent_expire(spark, sf):
    return lifecycle.noncurrent_expirations(adapters.versions(spark, sf, tagged=True), _version_rules(spark), at(NOW_VERSIONS))


@query(f"WITH {_VERSIONS} SELECT * FROM vmove")
def lifecycle_noncurrent_transition(spark, sf):
    return lifecycle.noncurrent_transitions(adapters.versions(spark, sf, tagged=True), _version_rules(spark), at(NOW_VERSIONS))


@query(f"""WITH {_VALUES} SELECT bucket, key, NULL::VARCHAR AS target, 'EXPIRE' AS action, NULL::VARCHAR AS detail FROM expire
    UNION ALL SELECT bucket, key, NULL, 'TRANSITION', to_class FROM move WHERE (bucket, key) NOT IN (SELECT (bucket, key) FROM expire)
    UNION ALL SELECT bucket, key, upload_id, 'ABORT', NULL FROM stop""")
def lifecycle_action_plan(spark, sf):
    return lifecycle.plan(adapters.objects_orders(spark, sf), None, _rules(spark), at(NOW))


@query(f"""WITH {_VERSIONS} SELECT bucket, key, version_id AS target, 'EXPIRE_VERSION' AS action, NULL::VARCHAR AS detail FROM vgone
    UNION ALL SELECT bucket, key, version_id, 'TRANSITION_VERSION', to_class FROM vmove WHERE (bucket, key, version_id) NOT IN (SELECT (bucket, key, version_id) FROM vgone)
    UNION ALL SELECT bucket, key, arg_max(version_id, (last_modified, version_id)), 'EXPIRE_MARKER', NULL FROM versions_o GROUP BY bucket, key
      HAVING bool_and(is_delete_marker) AND (bucket = 'b0' OR bucket = 'b1' AND arg_max(size, (last_modified, version_id)) > 5000 OR bucket = 'b2' AND starts_with(key, 'u/1'))""")
def lifecycle_version_plan(spark, sf):
    none = adapters.objects_orders(spark, sf).where("false")
    return lifecycle.plan(none, adapters.versions(spark, sf, tagged=True), _version_rules(spark), at(NOW_VERSIONS))


@query("""SELECT * FROM (VALUES ('x', 'a', 'id not unique'), ('x', 'a', 'id not unique'), ('x', 'b', 'days and date'), ('x', 'c', 'abort with tag'), ('x', 'd', 'no action'), ('x', 'e', 'class twice'),
    ('x', 'f', 'transition to STANDARD'), ('x', 'g', 'transition not before expiration'), ('x', 'h', 'newer versions not 1 to 100'), ('x', 'i', 'days not positive')) t(bucket, id, reason)""")
def lifecycle_invalid_rules(spark, sf):
    import datetime

    day = datetime.datetime(2030, 1, 1)
    rules = [
        {"id": "a", "exp_days": 1}, {"id": "a", "exp_days": 2}, {"id": "b", "exp_days": 1, "exp_date": day}, {"id": "c", "abort_days": 1, "want_tags": {"k": "v"}}, {"id": "d"},
        {"id": "e", "transitions": [(1, None, "GLACIER"), (2, None, "GLACIER")]}, {"id": "f", "transitions": [(1, None, "STANDARD")]}, {"id": "g", "exp_days": 5, "transitions": [(5, None, "GLACIER")]},
        {"id": "h", "nc_days": 1, "nc_newer": 101}, {"id": "i", "abort_days": 0}, {"id": "fine", "exp_date": day, "transitions": [(1, None, "GLACIER")]},
    ]
    asked = [{"bucket": "x", "rule_pos": i} | r for i, r in enumerate(rules)]
    return lifecycle.invalid_rules(lifecycle.rules_frame(spark, asked)).select("bucket", "id", "reason")


# --- parts


@query("""SELECT object_id, part_id, sequence_number::INT AS sequence_number, greatest(30 - start, 0)::BIGINT AS skip, (least(90, stop) - greatest(30, start))::BIGINT AS take FROM (
    SELECT *, stop - size AS start FROM (SELECT *, sum(size) OVER (PARTITION BY object_id ORDER BY sequence_number)::BIGINT AS stop FROM parts_o)) WHERE start < 90 AND stop > 30""")
def range_to_parts(spark, sf):
    return manifests.slices(adapters.parts(spark, sf), 30, 90).select("object_id", "part_id", "sequence_number", "skip", "take")


@query("""SELECT object_id, part_id FROM (SELECT *, sum(size) OVER (PARTITION BY object_id ORDER BY sequence_number)::BIGINT AS stop FROM parts_o) WHERE stop - size = 0 AND stop = 30""")
def covered_parts(spark, sf):
    return manifests.covered_part(adapters.parts(spark, sf), 0, 30).select("object_id", "part_id")


@query("""SELECT object_id, coalesce(n, 0)::BIGINT AS n_parts, coalesce(s, 0)::BIGINT AS parts_size, coalesce(lo = 1 AND hi = n AND d = n, true) AS contiguous, coalesce(s, 0) = o.size AS complete
    FROM orders_o o LEFT JOIN (SELECT l_orderkey AS object_id, count(*) AS n, sum(l_quantity::BIGINT) AS s, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_linenumber) AS d
      FROM lineitem GROUP BY 1) USING (object_id)""")
def manifest_check(spark, sf):
    lines = adapters.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("sequence_number"), F.col("l_quantity").cast("long").alias("size"))
    return manifests.manifest(adapters.objects_orders(spark, sf), lines)


def _stored(spark, sf):
    return adapters.upload_parts(spark, sf).select("object_id", "part_number", F.md5(F.col("content").cast("binary")).alias("etag"))


@query("""WITH stored AS (SELECT conv_id AS object_id, turn + 1 AS part_number, md5(coalesce(text, '')) AS etag FROM conversations),
    declared AS (SELECT object_id, part_number, CASE WHEN object_id % 7 = 1 AND part_number = 1 THEN 'x' ELSE etag END AS etag, CASE WHEN object_id % 5 = 2 THEN -part_number ELSE part_number END AS pos
      FROM stored WHERE NOT (object_id % 11 = 3 AND part_number = 2)),
    ordered AS (SELECT *, lag(part_number) OVER (PARTITION BY object_id ORDER BY pos) AS before FROM declared),
    sums AS (SELECT coalesce(d.object_id, s.object_id) AS object_id, coalesce(bool_or(before >= d.part_number), false) AS out_of_order, count(*) FILTER (s.etag IS NULL) AS n_missing,
      count(*) FILTER (d.etag IS NULL) AS n_omitted, count(*) FILTER (d.etag <> s.etag) AS n_mismatched FROM ordered d FULL JOIN stored s ON d.object_id = s.object_id AND d.part_number = s.part_number GROUP BY 1)
    SELECT *, CASE WHEN out_of_order THEN 'InvalidPartOrder' WHEN n_missing + n_omitted + n_mismatched > 0 THEN 'InvalidPart' ELSE 'ok' END AS verdict FROM sums""")
def multipart_declared_check(spark, sf):
    stored = _stored(spark, sf)
    declared = stored.where("NOT (object_id % 11 = 3 AND part_number = 2)").select(
        "object_id", "part_number",
        F.when((F.col("object_id") % 7 == 1) & (F.col("part_number") == 1), "x").otherwise(F.col("etag")).alias("etag"),
        F.when(F.col("object_id") % 5 == 2, -F.col("part_number")).otherwise(F.col("part_number")).alias("pos"),
    )
    return manifests.check_declared(stored, declared)


@query("""SELECT conv_id AS object_id, '"' || md5(unhex(string_agg(md5(coalesce(text, '')), '' ORDER BY turn))) || '-' || count(*) || '"' AS etag, count(*) AS n_parts,
    sum(strlen(coalesce(text, '')))::BIGINT AS size FROM conversations GROUP BY conv_id""")
def multipart_etag(spark, sf):
    return manifests.multipart_etag(adapters.upload_parts(spark, sf))


@query("""SELECT conv_id AS object_id, base64(unhex(sha256(unhex(string_agg(sha256(coalesce(text, '')), '' ORDER BY turn))))) AS sha256,
    base64(unhex(sha1(unhex(string_agg(sha1(coalesce(text, '')), '' ORDER BY turn))))) AS sha1 FROM conversations GROUP BY conv_id""")
def composite_checksums(spark, sf):
    return manifests.composite_digests(adapters.upload_parts(spark, sf)).select("object_id", "sha256", "sha1")


@query("""SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def part_digests(spark, sf):
    return checksums.digests(adapters.objects_docs(spark, sf)).select("doc_id", "md5", "sha1", "sha256")


@query()
def cyclic_checksums(spark, sf):
    """Full-object CRC-32, CRC-32C and CRC-64/NVME combined from the parts' own."""
    parts = adapters.upload_parts(spark, sf).withColumn("data", F.col("content").cast("binary"))
    out = None
    for kind in checksums.POLYNOMIALS:
        own = parts.select("object_id", "part_number", checksums.crc_column(kind)("data").alias("checksum"), F.octet_length("content").cast("long").alias("size"))
        whole = checksums.full_object(own, kind).withColumnRenamed("checksum", kind)
        out = whole if out is None else out.join(whole, "object_id")
    return out


# --- registry


@query("SELECT l_partkey AS part_id, count(*) AS refs FROM lineitem GROUP BY 1")
def registry_refcounts(spark, sf):
    return registry.ref_counts(adapters.parts(spark, sf))


@query("""SELECT * FROM (SELECT coalesce(r.part_id, p.p_partkey) AS part_id, CASE WHEN p_partkey IS NULL THEN 'INSERT' WHEN refs IS NULL THEN 'DELETE' WHEN refs <> p_size THEN 'UPDATE' END AS action,
    coalesce(refs, 0) AS refs, coalesce(p_size, 0)::BIGINT AS ref_count FROM (SELECT l_partkey AS part_id, count(*) AS refs FROM lineitem GROUP BY 1) r
    FULL JOIN part p ON r.part_id = p.p_partkey) WHERE action IS NOT NULL""")
def registry_reconcile(spark, sf):
    return registry.reconcile(adapters.parts(spark, sf), adapters.part_registry(spark, sf))


@query("""SELECT p_partkey AS part_id, CASE WHEN p_size - 10 + coalesce(d, 0) >= 0 AND p_size - 10 > 0 AND d IS NOT NULL THEN p_size - 10 + d ELSE p_size - 10 END::BIGINT AS ref_count,
    coalesce(p_size - 10 > 0 AND p_size - 10 + d >= 0, d IS NULL) AS applied
    FROM part LEFT JOIN (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS d FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def registry_deltas(spark, sf):
    held = adapters.part_registry(spark, sf).withColumn("ref_count", F.col("ref_count") - 10)
    deltas = adapters.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part_id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("delta"))
    return registry.apply_deltas(held, deltas)


@query("""SELECT o_orderkey AS part_id FROM orders WHERE o_orderkey NOT IN (SELECT l_partkey FROM lineitem) AND o_orderkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 0) AND o_orderdate < TIMESTAMP '1998-01-01'""")
def gc_orphans(spark, sf):
    """Stored blobs are orders; the cutoff is the end of the grace period."""
    stored = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("part_id"), F.col("o_orderdate").alias("created"))
    return registry.orphans(stored, adapters.parts(spark, sf), adapters.part_registry(spark, sf), F.col("created"), at("1998-01-01 00:00:00")).select("part_id")


@query("""WITH refs AS (SELECT l_partkey AS part_id, count(*) AS refs FROM lineitem GROUP BY 1), gone AS (SELECT o_orderkey AS part_id FROM orders WHERE o_orderkey NOT IN (SELECT part_id FROM refs))
    SELECT 'corrections' AS step, coalesce(r.part_id, p_partkey) AS part_id FROM refs r FULL JOIN part ON part_id = p_partkey WHERE refs IS DISTINCT FROM p_size UNION ALL SELECT 'condemned', part_id FROM gone
    UNION ALL SELECT 'deletes', part_id FROM gone UNION ALL SELECT 'pruned', p_partkey FROM part WHERE p_partkey IN (SELECT part_id FROM gone)""")
def gc_pipeline(spark, sf):
    stored = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("part_id"))
    steps = registry.collect_garbage(adapters.parts(spark, sf), adapters.part_registry(spark, sf), stored, adapters.part_registry(spark, sf))
    return listing.fan_out_listing([f.select(F.lit(name).alias("step"), "part_id") for name, f in steps.items()])


@query("SELECT DISTINCT l_partkey AS part_id FROM lineitem")
def blob_ids(spark, sf):
    return registry.blob_ids(adapters.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part_id")))


@query("SELECT p_partkey AS part_id, 'default' AS store FROM part UNION ALL SELECT s_suppkey, 'cold' FROM supplier")
def named_stores_union(spark, sf):
    return registry.named_stores({"default": adapters.part_registry(spark, sf), "cold": adapters.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("part_id"))})


@query("""SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'gone' WHEN event_id % 4 = 0 THEN 'cold' ELSE 'default' END AS store, event_id % 10 <> 0 AS known FROM events""")
def store_for_class(spark, sf):
    rows = adapters.versions(spark, sf, tagged=True).select(F.col("version_id").cast("long").alias("id"), "storage_class").withColumn("store_name", F.when(F.col("id") % 10 == 0, "gone"))
    return registry.stores_for(rows, {"GLACIER": "cold"}, ["cold"]).select("id", "store", "known")


@query("""SELECT object_id, string_agg(part_id || ':' || delta, ',' ORDER BY part_id) AS refs FROM (SELECT l_orderkey AS object_id, l_partkey AS part_id, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS delta
    FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def sorted_reference_deltas(spark, sf):
    deltas = adapters.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_partkey").alias("part_id"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("delta"))
    text = F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["part_id"], r["delta"])), ",")
    return registry.sorted_refs(deltas).select("object_id", text.alias("refs"))


def _blobs(spark, sf):
    return checksums.digests(adapters.objects_docs(spark, sf)).select(F.col("doc_id").alias("part_id"), "sha256", "size", "etag", "crc32")


@query("""SELECT sha256(content) AS sha256, size, min(doc_id) AS part_id, min(etag) AS etag, count(*) AS copies FROM docs_o GROUP BY 1, 2""")
def dedup_backfill(spark, sf):
    return registry.dedup_index(_blobs(spark, sf)).drop("crc32")


@query("""SELECT doc_id AS part_id, shared_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(content), size) AS shared_id FROM docs_o) WHERE doc_id <> shared_id""")
def dedup_lookup(spark, sf):
    blobs = _blobs(spark, sf)
    return registry.dedup_lookup(blobs, registry.dedup_index(blobs))


@query("""SELECT min(doc_id) AS part_id, sha256(content) AS sha256 FROM docs_o GROUP BY 2, size HAVING min(doc_id) NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def dedup_prune_dead(spark, sf):
    live = adapters.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("part_id"))
    return registry.prune_index(registry.dedup_index(_blobs(spark, sf)), live).select("part_id", "sha256")


# --- outbox and notifications


@query("SELECT part_id, max(id) AS id, max_by(operation, id) AS operation FROM outbox_o GROUP BY 1")
def outbox_last_per_part(spark, sf):
    return outbox.last_entries(adapters.outbox(spark, sf))


@query("""WITH last_ AS (SELECT part_id, max_by(operation, id) AS operation FROM outbox_o GROUP BY 1)
    SELECT c_custkey AS part_id FROM customer WHERE c_custkey NOT IN (SELECT part_id FROM last_ WHERE operation = 'DELETE') UNION SELECT part_id FROM last_ WHERE operation = 'PUT'""")
def outbox_overlay(spark, sf):
    return outbox.overlay(adapters.table(spark, sf, "customer").select(F.col("c_custkey").alias("part_id")), adapters.outbox(spark, sf))


@query("""SELECT id, part_id, operation, next_attempt_at FROM outbox_o WHERE next_attempt_at <= TIMESTAMP '2024-01-25 12:00:00' ORDER BY next_attempt_at, id LIMIT 100""")
def outbox_claim_batch(spark, sf):
    return outbox.claim_batch(adapters.outbox(spark, sf), at(NOW_VERSIONS), 100).select("id", "part_id", "operation", "next_attempt_at")


@query("""SELECT bucket, key, least(min(id), any_value(w_first)) AS first_id, greatest(max(id), any_value(w_last)) AS last_id FROM outbox_o
    LEFT JOIN (SELECT bucket, min(id) AS w_first, max(id) AS w_last FROM outbox_o WHERE key = '' GROUP BY 1) USING (bucket) WHERE key <> '' GROUP BY 1, 2""")
def outbox_scope_heads(spark, sf):
    return outbox.scope_heads(adapters.outbox(spark, sf))


@query("""SELECT id, attempts, CASE WHEN attempts < 10 THEN least(pow(2, greatest(attempts, 1) - 1), 300)::BIGINT END AS delay_seconds, attempts >= 10 AS dead FROM outbox_o""")
def notify_backoff(spark, sf):
    return outbox.retries(adapters.outbox(spark, sf), most=300, max_attempts=10)


@query("""SELECT id, part_id, operation FROM outbox_o WHERE next_attempt_at <= TIMESTAMP '2024-01-25 12:00:00' AND attempts < 10 AND id % 5 <> 0 ORDER BY next_attempt_at, id LIMIT 50""")
def outbox_claim_next(spark, sf):
    """Every fifth entry is leased until after now."""
    held = adapters.outbox(spark, sf).withColumn("lease_until", F.when(F.col("id") % 5 == 0, at("2024-02-25 12:00:00")).when(F.col("id") % 7 == 0, at("2024-01-01 00:00:00")))
    return outbox.claim_next(held, at(NOW_VERSIONS), 50, 10).select("id", "part_id", "operation")


@query("""SELECT id, attempts + 1 AS attempts, CASE WHEN id % 2 = 0 THEN 'DELETE' WHEN attempts + 1 >= 10 THEN 'DEAD' ELSE 'RETRY' END AS outcome,
    CASE WHEN id % 2 = 1 AND attempts + 1 < 10 THEN TIMESTAMP '2024-01-25 12:00:00' + to_seconds(least(pow(2, attempts), 300)::BIGINT) END AS next_attempt_at FROM outbox_o""")
def notify_dispatch(spark, sf):
    entries = adapters.outbox(spark, sf).select("id", "attempts")
    return outbox.dispatched(entries, entries.where("id % 2 = 0").select("id"), at(NOW_VERSIONS), 1, 300, 10)


@query("""SELECT event_id AS id, 'kind=' || event_type AS tags, CASE WHEN event_id % 2 = 0 THEN 'user=' || user_id END AS metadata FROM events""")
def outbox_entry_maps(spark, sf):
    events = adapters.table(spark, sf, "events")
    entries = events.select(F.col("event_id").alias("id"))
    tags = events.select(F.col("event_id").alias("id"), F.lit("kind").alias("key"), F.col("event_type").alias("value"))
    metadata = events.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.lit("user").alias("key"), F.col("user_id").cast("string").alias("value"))
    joined = lambda m: F.when(F.col(m).isNotNull(), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))
    return outbox.entries_with(entries, tags, metadata).select("id", joined("tag_set").alias("tags"), joined("user_metadata").alias("metadata"))


@query("""WITH e AS (SELECT id, CASE WHEN id % 500 = 3 THEN '' ELSE bucket END AS bucket, CASE WHEN id % 500 = 3 THEN '' ELSE key END AS key FROM outbox_o)
    SELECT c_custkey AS read_id, scope, CASE scope WHEN 'global' THEN (SELECT max(id) FROM e) WHEN 'bucket' THEN (SELECT max(id) FROM e WHERE e.bucket IN ('', r.bucket))
      ELSE (SELECT max(id) FROM e WHERE e.bucket = '' OR e.bucket = r.bucket AND e.key IN ('', r.key)) END AS waits_for
    FROM (SELECT c_custkey, 'b' || (c_custkey % 5) AS bucket, 'u/' || c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'bucket' ELSE 'key' END AS scope FROM customer) r""")
def outbox_read_barriers(spark, sf):
    wide = F.col("id") % 500 == 3
    entries = adapters.outbox(spark, sf).select("id", F.when(wide, "").otherwise(F.col("bucket")).alias("bucket"), F.when(wide, "").otherwise(F.col("key")).alias("key"))
    n = F.col("c_custkey")
    reads = adapters.table(spark, sf, "customer").select(n.alias("read_id"), F.concat(F.lit("b"), n % 5).alias("bucket"), F.concat(F.lit("u/"), n).alias("key"), F.when(n % 3 == 0, "global").when(n % 3 == 1, "bucket").otherwise("key").alias("scope"))
    return outbox.barriers(entries, reads)


@query("SELECT count(*) FILTER (attempts < 10) AS pending, count(*) FILTER (attempts >= 10) AS dead_lettered FROM outbox_o")
def notify_pending(spark, sf):
    return outbox.retries(adapters.outbox(spark, sf), 300, 10).agg(F.count_if(~F.col("dead")).alias("pending"), F.count_if("dead").alias("dead_lettered"))


_ROUTES = [
    ("b0", 0, "queue", ["s3:ObjectCreated:*"], ["images/"], [".jpg"]),
    ("b0", 1, "topic", ["s3:ObjectCreated:Put", "s3:ObjectRemoved:*"], None, None),
    ("b1", 0, "hook", ["s3:ObjectTagging:*"], ["docs/", "docs/1"], None),
    ("b2", 0, "queue", ["s3:ObjectRemoved:Delete"], None, [".txt"]),
    ("b2", 1, "lambda", ["s3:ObjectRemoved:*"], ["images/"], None),
]


def _routes(spark):
    return local_frame(spark, _ROUTES, notify.RULES)


@query("""SELECT id, event_name, bucket, key, destination FROM notif_o JOIN (VALUES
      ('b0', 'queue', 's3:ObjectCreated:', 'images/', '.jpg'), ('b0', 'topic', 's3:ObjectCreated:Put', '', ''), ('b0', 'topic', 's3:ObjectRemoved:', '', ''),
      ('b1', 'hook', 's3:ObjectTagging:', 'docs/1', ''), ('b2', 'queue', 's3:ObjectRemoved:Delete', '', '.txt'), ('b2', 'lambda', 's3:ObjectRemoved:', 'images/', '')) r(b, destination, e, p, s)
    ON bucket = b AND starts_with(event_name, e) AND starts_with(key, p) AND ends_with(key, s) UNION ALL SELECT id, event_name, bucket, key, 'eventbridge' FROM notif_o WHERE bucket = 'b3'""")
def notify_fanout(spark, sf):
    return notify.fan_out(adapters.object_events(spark, sf), _routes(spark), ["b3"])


@query("SELECT * FROM (VALUES ('b0', 0, 1), ('b2', 0, 1)) t(bucket, first, second)")
def notify_rule_overlap(spark, sf):
    return notify.overlaps(_routes(spark))


@query("""SELECT id, '{"Records":[{"eventName":"' || substr(event_name, 4) || '","s3":{"bucket":{"name":"' || bucket || '"},"object":{"key":"' || key || '","size":' || size || '}}}]}' AS payload FROM notif_o""")
def notify_payload(spark, sf):
    return notify.payload(adapters.object_events(spark, sf))


# --- audit


@query("""SELECT count(*) AS entries, count(*) FILTER (error <> '' OR outcome = 'error') AS errors, count(*) FILTER (outcome = 'denied') AS denied, count(DISTINCT actor) AS actors,
    min(ts) AS first, max(ts) AS last FROM audit_o""")
def audit_stats(spark, sf):
    return logs.stats(adapters.audit(spark, sf))


@query("SELECT operation, actor, count(*) AS entries, count(*) FILTER (error <> '' OR outcome = 'error') AS errors FROM audit_o GROUP BY 1, 2")
def audit_by_operation_actor(spark, sf):
    return logs.by_operation_actor(adapters.audit(spark, sf))


def _log(spark, sf):
    """The audit table as a log whose entries hash their own fields; tests hold logs against `verified` whose hashes cover the chain."""
    rows = logs.numbered(adapters.audit(spark, sf)).select("n", "id", "operation", "actor", "outcome")
    return logs.linked(logs.grounded(rows, logs.content_hash("id", "operation", "actor", "outcome")), "seed")


def _own_hash():
    fields = logs.content_hash("id", "operation", "actor", "outcome")
    kind = F.col("entry_type")
    return F.when(kind == logs.GENESIS, logs.content_hash("entry_type")).when(kind == logs.GROUNDING, logs.content_hash("entry_type", "merkle_root")).otherwise(fields)


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY ts, id) - 1 AS r, outcome FROM audit_o), total AS (SELECT count(*) AS c FROM l),
    entries AS (SELECT r + 1 + r // 1000 AS n, 'LOG' AS entry_type, outcome FROM l UNION ALL SELECT 0, 'GENESIS', '' UNION ALL SELECT (b + 1) * 1001, 'GROUNDING', '' FROM total, range(0, c // 1000) t(b)),
    left_ AS (SELECT *, entry_type = 'LOG' AND n % 500 = 7 AS forged FROM entries WHERE NOT (entry_type = 'LOG' AND n % 700 = 13)),
    seen AS (SELECT *, lag(n) OVER (ORDER BY n) AS before, (SELECT count(*) FROM entries e WHERE e.entry_type = 'LOG' AND e.n % 700 = 13 AND (e.n - 1) // 1001 = (left_.n - 1) // 1001) AS lost FROM left_)
    SELECT * FROM (SELECT n, entry_type, CASE WHEN forged THEN 'hash' WHEN n > 0 AND before <> n - 1 THEN 'chain' WHEN entry_type = 'GROUNDING' AND lost > 0 THEN 'interval' END AS problem FROM seen) WHERE problem IS NOT NULL""")
def audit_chain_check(spark, sf):
    """A log with forged outcomes and deleted entries."""
    logged = F.col("entry_type") == logs.LOG
    log = _log(spark, sf).where(~(logged & (F.col("n") % 700 == 13)))
    forged = log.withColumn("outcome", F.when(logged & (F.col("n") % 500 == 7), F.concat("outcome", F.lit("?"))).otherwise(F.col("outcome")))
    return logs.verified(forged, _own_hash(), "seed")


@query("""SELECT 'LOG' AS entry_type, count(*) AS entries FROM audit_o UNION ALL SELECT 'GENESIS', 1 UNION ALL SELECT 'GROUNDING', count(*) // 1000 FROM audit_o HAVING count(*) >= 1000""")
def audit_by_type(spark, sf):
    return logs.by_type(_log(spark, sf))


@query()
def audit_merkle_roots(spark, sf):
    rows = logs.numbered(adapters.audit(spark, sf)).withColumns({"block": F.floor(F.col("n") / logs.BLOCK), "hash": logs.content_hash("id", "operation", "actor", "outcome")})
    return logs.merkle_roots(rows)


@query("SELECT id, operation, actor, outcome, error FROM audit_o")
def audit_binary_round_trip(spark, sf):
    fields = ["id", "operation", "actor", "outcome", "error"]
    read = logs.from_binary(logs.to_binary(adapters.audit(spark, sf), fields), fields)
    return read.withColumn("id", F.col("id").cast("long"))


@query("""SELECT id, user_id, epoch_us(ts) - epoch_us(begun) AS duration_us FROM (SELECT *, last_value(CASE WHEN operation = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begun FROM audit_o WHERE operation IN ('click', 'purchase')) WHERE operation = 'purchase' AND begun IS NOT NULL""")
def audit_phase_duration(spark, sf):
    return logs.phase_durations(adapters.audit(spark, sf), "click", "purchase")


@query("SELECT ts, 'log' AS entry_type, operation, actor, outcome, id, error FROM audit_o")
def audit_text_round_trip(spark, sf):
    return logs.from_text(logs.to_text(adapters.audit(spark, sf)))


# --- governance


@query("""WITH expected AS (SELECT key, CASE WHEN doc_id % 41 = 0 THEN '"x"' ELSE etag END AS etag, CASE WHEN doc_id % 37 = 0 THEN strlen(content) + 1 ELSE strlen(content) END AS size FROM docs_o WHERE doc_id % 29 <> 0)
    SELECT CASE WHEN e.key IS NULL THEN 'unknown' WHEN strlen(content) <> e.size THEN 'size' WHEN d.etag <> e.etag THEN 'etag' ELSE 'ok' END AS verdict, count(*) AS objects
    FROM docs_o d LEFT JOIN expected e ON d.key = e.key GROUP BY 1""")
def integrity_report(spark, sf):
    objects = adapters.objects_docs(spark, sf)
    size = F.octet_length("content").cast("long")
    expected = objects.where("doc_id % 29 <> 0").select(
        "key", F.when(F.col("doc_id") % 41 == 0, '"x"').otherwise(F.col("etag")).alias("etag"), F.when(F.col("doc_id") % 37 == 0, size + 1).otherwise(size).alias("size")
    )
    return governance.report(governance.integrity(objects, expected))


@query("""WITH p AS (SELECT conv_id AS object_id, turn + 1 AS part_number, conv_id * 1000 + turn AS part_id, md5(coalesce(text, '')) AS md5, strlen(coalesce(text, '')) AS n FROM conversations),
    bad AS (SELECT object_id, part_number, CASE WHEN part_id % 31 = 0 THEN 'part missing' WHEN part_id % 29 = 0 THEN 'part size' WHEN part_id % 23 = 0 THEN 'part etag' END AS problem FROM p),
    o AS (SELECT object_id, md5(unhex(string_agg(md5, '' ORDER BY part_number))) || '-' || count(*) AS etag, sum(n) AS size FROM p GROUP BY 1)
    SELECT object_id, coalesce(min_by(problem, part_number) FILTER (problem IS NOT NULL), CASE WHEN object_id % 7 = 0 THEN 'size' WHEN object_id % 5 = 0 THEN 'etag' ELSE 'ok' END) AS verdict,
    (min(part_number) FILTER (problem IS NOT NULL))::INT AS part_number FROM o JOIN bad USING (object_id) GROUP BY object_id""")
def integrity_multipart(spark, sf):
    parts = adapters.upload_parts(spark, sf).withColumn("part_id", F.col("object_id") * 1000 + F.col("part_number") - 1)
    data = F.col("content").cast("binary")
    broken = lambda n: F.col("part_id") % n == 0
    size = F.octet_length(data).cast("long")
    manifest = parts.select("object_id", F.col("part_number").cast("int").alias("part_number"), "part_id", F.when(broken(23), "x").otherwise(F.md5(data)).alias("etag"), F.when(broken(29), size + 1).otherwise(size).alias("size"))
    whole = manifests.multipart_etag(adapters.upload_parts(spark, sf))
    objects = whole.select("object_id", F.when(F.col("object_id") % 5 == 0, F.concat(F.lit('"x'), F.substring("etag", 2, 100))).otherwise(F.col("etag")).alias("etag"), F.when(F.col("object_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return governance.integrity_parts(manifest, parts.where(~broken(31)).select("part_id", "content"), objects)


@query("SELECT bucket, sum(size)::BIGINT AS total_size, count(*) AS objects FROM docs_o GROUP BY 1")
def bucket_total_size(spark, sf):
    return governance.sizes(adapters.objects_docs(spark, sf))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def migration_missing(spark, sf):
    source = adapters.table(spark, sf, "customer").select("c_custkey", "c_name")
    return governance.missing(source, adapters.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT bucket, key, copied, total, CASE WHEN total > 0 THEN copied * 100 // total ELSE 100 END AS percent FROM (SELECT bucket, key, sum(size) OVER (PARTITION BY bucket ORDER BY key
    ROWS UNBOUNDED PRECEDING)::BIGINT AS copied, sum(size) OVER (PARTITION BY bucket)::BIGINT AS total FROM docs_o)""")
def migration_progress(spark, sf):
    return governance.progress(adapters.objects_docs(spark, sf)).withColumn("percent", F.col("percent").cast("long"))


@query("""SELECT bucket, coalesce(sum(size) FILTER (doc_id % 2 = 0), 0)::BIGINT AS bytes_up, count(*) FILTER (doc_id % 2 = 0) AS requests_up,
    coalesce(sum(size) FILTER (doc_id % 2 = 1), 0)::BIGINT AS bytes_down, count(*) FILTER (doc_id % 2 = 1) AS requests_down FROM docs_o GROUP BY 1""")
def api_bytes_by_bucket(spark, sf):
    asked = adapters.objects_docs(spark, sf).select("bucket", F.when(F.col("doc_id") % 2 == 0, "up").otherwise("down").alias("direction"), F.col("size").alias("bytes"))
    return governance.transferred(asked)


@query("SELECT operation, count(*) AS total, count(*) FILTER (outcome = 'success') AS succeeded, count(*) FILTER (outcome <> 'success') AS failed FROM audit_o GROUP BY 1")
def api_op_counters(spark, sf):
    return governance.operation_counters(adapters.audit(spark, sf))


@query("SELECT user_id, count(*) AS uses, max(ts) AS last_use, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1")
def cache_lfu_frequency(spark, sf):
    return governance.cache_frequency(adapters.table(spark, sf, "events"))


@query("""SELECT user_id, row_number() OVER (ORDER BY count(*), max(ts), arg_max(event_id, (ts, event_id))) AS place FROM events GROUP BY 1""")
def cache_eviction_order(spark, sf):
    return governance.evictions(adapters.table(spark, sf, "events")).select("user_id", "place")


@query("""SELECT page_id AS request_id, CASE WHEN starts_with(url, 'https://') AND bucket LIKE 'm.%' AND page_id % 3 <> 0 THEN 0 WHEN ends_with(bucket, '.example.com') THEN 1 END AS rule_pos
    FROM pages_o JOIN pages USING (page_id) WHERE starts_with(url, 'https://') AND bucket LIKE 'm.%' AND page_id % 3 <> 0 OR ends_with(bucket, '.example.com')""")
def cors_match(spark, sf):
    """Origins in upper case; every third request asks for a header that the first rule does not allow."""
    pages = adapters.table(spark, sf, "pages")
    asked = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("X-Other"))).otherwise(F.array(F.lit("x-API-key"), F.lit("Content-Type")))
    requests = pages.select(F.col("page_id").alias("request_id"), F.lit("web").alias("bucket"), F.upper(F.regexp_extract("url", "^[a-z]+://[^/]+", 0)).alias("origin"), F.lit(" get").alias("method"), asked.alias("headers"))
    rules = local_frame(
        spark,
        [("web", 0, ["https://M.*"], ["GET", "PUT"], ["x-api-*", "content-type"]), ("web", 1, ["ftp://a", "*.example.com"], ["GET"], ["*"]), ("web", 2, ["*"], ["POST"], None), ("other", 0, ["*"], ["GET"], ["*"])],
        "bucket string, rule_pos int, origins array<string>, methods array<string>, allowed_headers array<string>",
    )
    return governance.first_cors_rule(requests, rules)


@query("""SELECT page_id AS request_id, bucket, rule_pos::INT AS rule_pos, CASE WHEN rule_pos IS NULL THEN CASE WHEN key = '' OR ends_with(key, '/') THEN key || 'index.html' ELSE key END END AS document,
    CASE rule_pos WHEN 0 THEN '/english/' || substr(key, 4) WHEN 1 THEN 'https://de.test/' || key WHEN 3 THEN '/lost.html' END AS location,
    CASE rule_pos WHEN 0 THEN 301 WHEN 1 THEN 302 WHEN 3 THEN 301 END::INT AS code
    FROM (SELECT *, CASE WHEN bucket NOT LIKE 'm.%' THEN NULL WHEN starts_with(key, 'en/') THEN 0 WHEN starts_with(key, 'de/') THEN 1 WHEN page_id % 4 = 0 THEN 3 END AS rule_pos FROM pages_o)""")
def website_route(spark, sf):
    """The hosts that begin with m. have rules; every fourth request met a 404."""
    pages = adapters.objects_pages(spark, sf)
    requests = pages.select(F.col("page_id").alias("request_id"), "bucket", "key", F.when(F.col("page_id") % 4 == 0, 404).alias("status"))
    given = local_frame(
        spark,
        [(0, "en/", None, None, "english/", None, None, None), (1, "de/", None, None, None, "de.test", "https", 302), (2, "en/1", None, "never", None, None, None, None), (3, None, 404, "lost.html", None, None, None, None)],
        "rule_pos int, prefix string, error_code int, replace_key string, replace_prefix string, host string, protocol string, code int",
    )
    # one row per host and rule
    rules = pages.select("bucket").where("bucket LIKE 'm.%'").distinct().join(F.broadcast(given))
    return governance.website_route(requests, rules, "index.html").select("request_id", "bucket", "rule_pos", "document", "location", "code")


@query("""SELECT doc_id, lang = 'en' AND toxic = 0 AS by_tags, source || '/' = split_part(key, '/', 2) || '/' AND starts_with(key, 'en/') AS in_namespace, doc_id % 2 = 0 AS authenticated,
    doc_id % 256 < 128 AS from_network, doc_id % 3 = 0 AS read_only, CASE WHEN toxic = 1 THEN 'toxic' ELSE '?' END AS kind, 'agent ' || doc_id AS agent
    FROM docs_o JOIN documents USING (doc_id) JOIN labels USING (doc_id)""")
def request_helpers(spark, sf):
    """Requests for labelled documents, seen through the fields and helpers that a policy uses."""
    docs, labels = adapters.table(spark, sf, "documents").select("doc_id", "lang"), adapters.table(spark, sf, "labels").select("doc_id", "toxic")
    rows = adapters.objects_docs(spark, sf).join(docs, "doc_id").join(labels, "doc_id").select(
        "doc_id", "bucket", "key", F.col("bucket").alias("source"),
        F.when(F.col("doc_id") % 3 == 0, "GetObject").otherwise("PutObject").alias("operation"),
        (F.col("doc_id") % 2 == 0).alias("authenticated"),
        F.concat(F.lit("10.0.0."), F.col("doc_id") % 256).alias("client_ip"),
        F.create_map(F.lit("User-Agent"), F.concat(F.lit("agent "), "doc_id")).alias("headers"),
        F.when(F.col("toxic") == 1, F.create_map(F.lit("kind"), F.lit("toxic"))).alias("object_tags"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("request_tags"),
    )
    asked = governance.requests_frame(rows)
    inside = governance.header("user-agent")
    return asked.select(
        "doc_id",
        (governance.has_tag("request", "lang", "en") & ~governance.has_tag("object", "kind")).alias("by_tags"),
        (F.col("source").eqNullSafe(F.col("bucket")) & F.startswith("key", F.lit("en/"))).alias("in_namespace"),
        governance.is_authenticated().alias("authenticated"),
        governance.from_network("10.0.0.0/25").alias("from_network"),
        governance.is_read_only().alias("read_only"),
        governance.tag_value("object", "kind", "?").alias("kind"),
        inside.alias("agent"),
    )


@query(r"""SELECT bucket, key, length(bucket) BETWEEN 3 AND 63 AND regexp_matches(bucket, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$')
    AND NOT regexp_matches(bucket, '^\d+\.\d+\.\d+\.\d+$|^(xn--|sthree-)|(-s3alias|--ol-s3)$|--') AS bucket_ok, strlen(key) BETWEEN 1 AND 1024 AS key_ok FROM pages_o""")
def name_validation(spark, sf):
    pages = adapters.objects_pages(spark, sf)
    return pages.select("bucket", "key", exprs.valid_bucket_name(F.col("bucket")).alias("bucket_ok"), exprs.valid_object_key(F.col("key")).alias("key_ok"))


@query("""SELECT object_id, size, greatest(size - 500, 0) AS suffix_start, CASE WHEN 100 < size THEN least(100000, size) END AS end_at FROM orders_o""")
def range_headers(spark, sf):
    rows = adapters.objects_orders(spark, sf)
    suffix, middle = exprs.byte_range(F.lit("bytes=-500"), F.col("size")), exprs.byte_range(F.lit("bytes=100-99999"), F.col("size"))
    return rows.select("object_id", "size", suffix["start"].alias("suffix_start"), middle["end"].alias("end_at"))


@query("""SELECT key, etag = (SELECT min(etag) FROM docs_o) AS matches, true AS always, etag <> (SELECT min(etag) FROM docs_o) AS none_matches, false AS never FROM docs_o""")
def preconditions(spark, sf):
    objects = adapters.objects_docs(spark, sf)
    least = objects.agg(F.min("etag").alias("wanted"))  # one row
    return objects.join(F.broadcast(least)).select("key", exprs.if_match(F.col("etag"), F.col("wanted")).alias("matches"), exprs.if_match(F.col("etag"), F.lit("*")).alias("always"), exprs.if_none_match(F.col("etag"), F.col("wanted")).alias("none_matches"), exprs.if_none_match(F.col("etag"), F.lit("*")).alias("never"))


# --- writes as deltas


@query("""SELECT object_id, part_id, sequence_number::INT AS sequence_number, size FROM parts_o UNION ALL SELECT o_orderkey, 0, coalesce(n, 0) + 1, 7 FROM orders
    LEFT JOIN (SELECT object_id, max(sequence_number) AS n FROM parts_o GROUP BY 1) ON object_id = o_orderkey""")
def append_parts(spark, sf):
    new = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"), F.lit(0).cast("long").alias("part_id"), F.lit(7).cast("long").alias("size"), F.lit(0).alias("pos"))
    return mutations.append_parts(adapters.parts(spark, sf), new)


@query("""SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE replace(lower(n_name), '_', '-') END AS bucket, CASE WHEN n_nationkey % 5 = 0 THEN 'InvalidBucketName' WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'BucketAlreadyExists' ELSE 'Created' END AS outcome FROM nation""")
def create_buckets(spark, sf):
    name = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")))
    nation = adapters.table(spark, sf, "nation").select(name.alias("bucket"), "n_nationkey")
    held = adapters.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("bucket")
    return mutations.create_buckets(held, nation.select("bucket"))


@query("""SELECT c_custkey AS bucket, CASE WHEN c_custkey % 10 = 0 THEN 'NoSuchBucket' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'BucketNotEmpty' ELSE 'Deleted' END AS outcome FROM customer""")
def delete_buckets(spark, sf):
    asked = adapters.table(spark, sf, "customer").select(F.col("c_custkey").alias("bucket"))
    objects = adapters.table(spark, sf, "orders").select(F.col("o_custkey").alias("bucket"))
    return mutations.delete_buckets(asked.where("bucket % 10 <> 0"), objects, asked)


@query("""WITH last_ AS (SELECT 'b' || (user_id % 5) || '/' || user_id AS bucket, CASE event_type WHEN 'click' THEN 'cors' WHEN 'view' THEN 'website' ELSE 'lifecycle' END AS kind, max(event_id) AS id FROM events GROUP BY 1, 2)
    SELECT bucket, kind, 'd' || id AS document FROM last_ WHERE id % 4 <> 0
    UNION ALL SELECT 'b' || (c_custkey % 5) || '/' || c_custkey, 'cors', 'old' FROM customer WHERE ('b' || (c_custkey % 5) || '/' || c_custkey, 'cors') NOT IN (SELECT (bucket, kind) FROM last_)""")
def bucket_configurations(spark, sf):
    name = lambda c: F.concat(F.lit("b"), F.col(c) % 5, F.lit("/"), c)
    kind = F.when(F.col("event_type") == "click", "cors").when(F.col("event_type") == "view", "website").otherwise("lifecycle")
    changes = adapters.table(spark, sf, "events").select(name("user_id").alias("bucket"), kind.alias("kind"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("d"), "event_id")).alias("document"))
    return mutations.configure(adapters.table(spark, sf, "customer").select(name("c_custkey").alias("bucket"), F.lit("cors").alias("kind"), F.lit("old").alias("document")), changes)


@query("""WITH c AS (SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'CREATE' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'ABORT' ELSE 'PART' END AS op, user_id::VARCHAR AS upload_id, (event_id % 7)::INT AS part_number,
      md5(event_id::VARCHAR) AS etag FROM events), o AS (SELECT upload_id, min(seq) AS since FROM c WHERE op = 'CREATE' GROUP BY 1 HAVING upload_id NOT IN (SELECT upload_id FROM c WHERE op = 'ABORT'))
    SELECT upload_id, part_number, arg_max(etag, seq) AS etag FROM c JOIN o USING (upload_id) WHERE op = 'PART' AND seq >= since GROUP BY 1, 2""")
def multipart_deltas(spark, sf):
    kind = F.col("event_type")
    op = F.when(kind == "signup", "CREATE").when((kind == "error") & (F.col("user_id") % 3 == 0), "ABORT").otherwise("PART")
    commands = adapters.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("upload_id"), F.lit("b").alias("bucket"), F.concat(F.lit("u/"), "user_id").alias("key"),
        (F.col("event_id") % 7).cast("int").alias("part_number"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("etag"), F.lit(1).cast("long").alias("size"),
    )
    none = spark.createDataFrame([], "upload_id string, bucket string, key string, part_number int, etag string, size long")
    return mutations.upload_deltas(none.select("upload_id", "bucket", "key"), none.select("upload_id", "part_number", "etag", "size"), commands)[1].select("upload_id", "part_number", "etag")


def _copies(spark, sf):
    objects = adapters.objects_orders(spark, sf)
    asked = objects.select(
        "object_id", F.concat(F.lit("copy/"), "key").alias("new_key"), F.when(F.col("object_id") % 2 == 0, "REPLACE").otherwise("COPY").alias("directive"), F.create_map(F.lit("status"), F.lit("new")).alias("new_tags")
    )
    return mutations.copy_objects(objects, asked)


@query("""SELECT bucket, 'copy/' || key AS key, size, object_id AS shares, CASE WHEN object_id % 2 = 0 THEN 'new' ELSE status END AS status, 'STANDARD' AS storage_class FROM orders_o""")
def copy_objects(spark, sf):
    return _copies(spark, sf).select("bucket", "key", "size", "shares", F.element_at("tags", "status").alias("status"), "storage_class")


@query("SELECT l_partkey AS part_id, count(*) AS delta FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def copy_references(spark, sf):
    return mutations.shared_references(adapters.parts(spark, sf), _copies(spark, sf))


@query("""SELECT source AS bucket, lang || '/' || source || '/' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '?' ELSE '' END AS key,
    CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN 'PreconditionFailed' ELSE 'Deleted' END AS status, doc_id % 4 <> 0 AS existed FROM documents""")
def bulk_delete(spark, sf):
    objects = adapters.objects_docs(spark, sf)
    asked = objects.select("bucket", F.when(F.col("doc_id") % 4 == 0, F.concat("key", F.lit("?"))).otherwise(F.col("key")).alias("key"), F.when(F.col("doc_id") % 3 == 0, '"old"').alias("if_match"))
    return mutations.bulk_delete(objects, asked)


@query("SELECT key, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'GLACIER' ELSE 'STANDARD' END AS storage_class FROM docs_o")
def transition_class(spark, sf):
    objects = adapters.objects_docs(spark, sf).withColumn("storage_class", F.lit(""))
    plan = objects.where("doc_id % 2 = 0").select("bucket", "key", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("etag")).alias("etag"), F.lit("GLACIER").alias("to_class"))
    return mutations.move_class(objects, plan).select("key", "storage_class")


@query("""SELECT doc_id AS object_id, 'toxic' AS key, toxic::VARCHAR AS value FROM labels WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 'quality', quality::VARCHAR FROM labels WHERE doc_id % 2 = 1
    UNION ALL SELECT doc_id, 'state', 'new' FROM labels WHERE doc_id % 2 = 0""")
def replace_tags(spark, sf):
    labels = adapters.table(spark, sf, "labels")
    tags = labels.select(F.col("doc_id").alias("object_id"), F.explode(F.create_map(F.lit("toxic"), F.col("toxic").cast("string"), F.lit("quality"), F.col("quality").cast("string"))).alias("key", "value"))
    puts = labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("object_id"), F.create_map(F.lit("state"), F.lit("new")).alias("tags"))
    return mutations.replace_tags(tags, puts)


@query("""SELECT doc_id AS object_id, CASE WHEN doc_id % 6 = 0 THEN 'md5,sha256' WHEN doc_id % 2 = 0 THEN 'md5' WHEN doc_id % 3 = 0 THEN 'sha256' ELSE '' END AS mismatched FROM documents""")
def declared_checksums(spark, sf):
    own = checksums.digests(adapters.objects_docs(spark, sf)).select(F.col("doc_id").alias("object_id"), "md5", "sha256")
    said = own.select("object_id", F.when(F.col("object_id") % 2 == 0, "x").otherwise(F.col("md5")).alias("md5"), F.when(F.col("object_id") % 3 == 0, "x").when(F.col("object_id") % 5 != 0, F.col("sha256")).alias("sha256"))
    return mutations.checksum_verdicts(said, own, ["md5", "sha256"])


@query("""SELECT p_partkey AS part_id, (p_partkey % 2 = 0)::BIGINT + (p_partkey % 3 = 0)::BIGINT + (p_partkey % 5 <> 0)::BIGINT AS shards,
    (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_partkey % 5 <> 0)::INT >= 2 AS readable, NOT (p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 <> 0) AS heal
    FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 <> 0""")
def shard_health(spark, sf):
    part = adapters.part_registry(spark, sf)
    return mutations.shard_health([part.where("part_id % 2 = 0"), part.where("part_id % 3 = 0"), part.where("part_id % 5 <> 0")], 2)
