"""Integrity reports, migration, metrics, authorisation, cross-origin and website rules."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakecat.functions import exprs
from lakecat.operators import order


def integrity(objects: DataFrame, expected: DataFrame) -> DataFrame:
    """Recompute each object's ETag and size in bytes from its content and compare with what the catalog says.

    The ETag of a multipart object, which ends in -n, is not that of the content: `integrity_parts` checks it.
    """
    data = F.col("content").cast("binary")
    etag = F.concat(F.lit('"'), F.md5(data), F.lit('"'))
    both = objects.select("key", etag.alias("found"), F.octet_length(data).cast("long").alias("found_size")).join(expected.select("key", "etag", "size"), "key", "full_outer")
    composite = F.col("etag").rlike(r'-\d+"?$')
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("etag").isNull(), "unknown").when(F.col("found_size") != F.col("size"), "size").when(~composite & (F.col("found") != F.col("etag")), "etag").otherwise("ok")
    return both.select("key", verdict.alias("verdict"))


def integrity_parts(manifest: DataFrame, stored: DataFrame, objects: DataFrame) -> DataFrame:
    """Per object (object_id, etag, size): its parts (object_id, part_number, part_id, etag, size) against the stored contents (part_id, content),
    then the object. The verdict is that of the first part that is missing or differs, else size or etag of the object, else ok.

    An object of several parts has the ETag of their MD5s in order with -n behind it; an object has 10,000 parts at most.
    """
    data = F.col("content").cast("binary")
    held = stored.select("part_id", F.md5(data).alias("found"), F.octet_length(data).cast("long").alias("found_size"))
    met = manifest.join(held, "part_id", "left")
    problem = F.when(F.col("found").isNull(), "part missing").when(F.col("found_size") != F.col("size"), "part size").when(F.col("found") != F.col("etag"), "part etag")
    each = met.select("object_id", "part_number", "found", "found_size", problem.alias("problem"))
    sums = each.groupBy("object_id").agg(
        F.min(F.when(F.col("problem").isNotNull(), F.struct("part_number", "problem"))).alias("first"),
        F.sort_array(F.collect_list(F.struct("part_number", "found"))).alias("parts"),
        F.sum("found_size").alias("found_size"),
    )
    whole = F.concat(F.md5(F.unhex(F.array_join("parts.found", ""))), F.lit("-"), F.size("parts"))
    own = F.when(F.col("etag").rlike(r"-\d+\"?$"), whole).otherwise(F.get(F.col("parts.found"), F.lit(0)))
    verdict = F.when(F.col("parts").isNull(), "no parts").when(F.col("first").isNotNull(), F.col("first.problem")).when(F.col("found_size") != F.col("size"), "size").when(own != F.regexp_replace("etag", '"', ""), "etag").otherwise("ok")
    return objects.select("object_id", "etag", "size").join(sums, "object_id", "left").select("object_id", verdict.alias("verdict"), F.col("first.part_number").alias("part_number"))


def report(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("objects"))


def sizes(objects: DataFrame) -> DataFrame:
    return objects.groupBy("bucket").agg(F.sum("size").alias("total_size"), F.count("*").alias("objects"))


def progress(objects: DataFrame) -> DataFrame:
    """Bytes copied after each object of a bucket, in key order, and their share in percent, rounded down. A bucket's keys are cut into
    ranges, so no bucket has to fit a task."""
    copied = order.running(objects.select("bucket", "key", "size"), ["key"], F.col("size"), "copied", ["bucket"])
    totals = objects.groupBy(F.col("bucket").alias("of")).agg(F.sum("size").alias("total"))
    met = copied.join(totals, F.col("bucket").eqNullSafe(F.col("of")))
    return met.select("bucket", "key", "copied", "total", F.when(F.col("total") > 0, F.expr("copied * 100 div total")).otherwise(100).alias("percent"))


def missing(source: DataFrame, destination: DataFrame, on: str | list[str]) -> DataFrame:
    return source.join(destination, on, "left_anti")


def transferred(requests: DataFrame) -> DataFrame:
    """Bytes and requests up and down by bucket (requests: bucket, direction, bytes)."""
    of = lambda d: F.col("direction") == d
    sums = [a for d in ("up", "down") for a in (F.coalesce(F.sum(F.when(of(d), F.col("bytes"))), F.lit(0)).alias(f"bytes_{d}"), F.count_if(of(d)).alias(f"requests_{d}"))]
    return requests.groupBy("bucket").agg(*sums)


def operation_counters(audit: DataFrame) -> DataFrame:
    return audit.groupBy("operation").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "success").alias("succeeded"), F.count_if(F.col("outcome") != "success").alias("failed"))


def cache_frequency(events: DataFrame) -> DataFrame:
    """Use counts and last use of each key."""
    used = events.groupBy("user_id").agg(F.count("*").alias("uses"), F.max(F.struct("ts", "event_id")).alias("last"))
    return used.select("user_id", "uses", F.col("last.ts").alias("last_use"), F.col("last.event_id").alias("last_event"))


def evictions(events: DataFrame) -> DataFrame:
    """Each key's place in the order of eviction: least used first, of ties the longest unused."""
    return order.running(cache_frequency(events), ["uses", "last_use", "last_event"], F.lit(1).cast("long"), "place")


def first_cors_rule(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """For each request (request_id, bucket, origin, method, headers) the first rule that allows it; rules are configuration.

    Origins and headers are compared without case, methods in upper case. A request without headers asks for none.
    """
    fits = lambda pattern, value: exprs.wildcard_match(F.lower(pattern), F.lower(value))
    header_ok = F.forall(F.coalesce("headers", F.array().cast("array<string>")), lambda h: F.exists("allowed_headers", lambda a: fits(a, h)))
    met = requests.join(rules.withColumn("allowed_headers", F.coalesce("allowed_headers", F.array().cast("array<string>"))), "bucket")
    hit = met.where(F.exists("origins", lambda o: fits(o, F.col("origin"))) & F.array_contains("methods", F.upper(F.trim("method"))) & header_ok)
    return hit.groupBy("request_id").agg(F.min("rule_pos").alias("rule_pos"))


#: Routing rules of websites; null conditions hold always.
ROUTES = "bucket string, rule_pos int, prefix string, error_code int, replace_key string, replace_prefix string, host string, protocol string, code int"


def website_route(requests: DataFrame, rules: DataFrame, index: str) -> DataFrame:
    """Requests (request_id, bucket, key, status: null or an error code) with the key of the document, or the redirect of their bucket's first rule
    whose prefix the key has and whose error code, if any, the request met. `location` is the redirect's place, `code` its status."""
    hit = (F.col("prefix").isNull() | F.startswith("key", F.col("prefix"))) & (F.col("error_code").isNull() | (F.col("error_code") == F.col("status")))
    fields = ["rule_pos", "prefix", "replace_key", "replace_prefix", "host", "protocol", "code"]
    met = requests.join(rules, "bucket", "left")
    first = met.groupBy("request_id", "bucket", "key", "status").agg(F.min(F.when(F.col("rule_pos").isNotNull() & hit, F.struct(*fields))).alias("r"))
    tail = F.when(F.col("r.prefix").isNull(), "").otherwise(F.substr("key", F.length("r.prefix") + 1))
    target = F.coalesce(F.col("r.replace_key"), F.concat("r.replace_prefix", tail), F.col("key"))
    rooted = F.concat(F.lit("/"), F.regexp_replace(target, "^/", ""))
    plain = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target))
    location = F.when(F.col("r.host").isNull() & F.col("r.protocol").isNull(), plain).otherwise(F.concat(F.coalesce("r.protocol", F.lit("http")), F.lit("://"), F.coalesce("r.host", F.col("bucket")), rooted))
    resolved = F.when((F.col("key") == "") | F.endswith("key", F.lit("/")), F.concat("key", F.lit(index))).otherwise(F.col("key"))
    return first.select("request_id", "bucket", "r.rule_pos", F.when(F.col("r").isNull(), resolved).alias("document"), F.when(F.col("r").isNotNull(), location).alias("location"), F.when(F.col("r").isNotNull(), F.coalesce("r.code", F.lit(301))).alias("code"))


def authorized_by(rows: DataFrame, policy: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """Rows that a user's function allows; it sees Arrow batches of the named columns and gives booleans."""

    @F.pandas_udf("boolean")
    def run(frame: pd.DataFrame) -> pd.Series:
        return policy(frame)

    return rows.where(run(F.struct(*columns)))


def request_is(method: Column, *allowed: str) -> Column:
    return F.upper(method).isin(*allowed)


#: The request that a policy sees.
REQUEST = (
    "operation string, bucket string, key string, method string, path string, host string, client_ip string, credential string, authenticated boolean, "
    "headers map<string,string>, query map<string,string>, object_tags map<string,string>, source_tags map<string,string>, request_tags map<string,string>"
)


def requests_frame(rows: DataFrame) -> DataFrame:
    """rows brought to the fields of REQUEST; what is not there is null, header names are in lower case."""
    fields = StructType.fromDDL(REQUEST)
    out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields], *[c for c in rows.columns if c not in fields.names])
    return out.withColumn("headers", F.transform_keys("headers", lambda k, _: F.lower(k)))


def header(name: str) -> Column:
    return F.element_at("headers", F.lit(name.lower()))


def query_value(name: str) -> Column:
    return F.element_at("query", F.lit(name))


def has_tag(which: str, key: str, *values: str) -> Column:
    """Does the request's object, source or own tag set (`which`) hold the key, with one of the values if any are named."""
    value = F.element_at(F.col(f"{which}_tags"), F.lit(key))
    return F.coalesce(value.isin(*values) if values else value.isNotNull(), F.lit(False))


def tag_value(which: str, key: str, default: str = "") -> Column:
    return F.coalesce(F.element_at(F.col(f"{which}_tags"), F.lit(key)), F.lit(default))


def in_namespace(bucket: str, prefix: str = "") -> Column:
    """Is the request about the bucket, below the prefix."""
    return F.coalesce((F.col("bucket") == bucket) & F.startswith(F.coalesce("key", F.lit("")), F.lit(prefix)), F.lit(False))


def is_authenticated() -> Column:
    return F.coalesce("authenticated", F.lit(False))


def from_network(*cidrs: str) -> Column:
    hits = [F.coalesce(exprs.in_cidr(F.col("client_ip"), F.lit(c)), F.lit(False)) for c in cidrs]
    return functools.reduce(lambda a, b: a | b, hits, F.lit(False))


def is_read_only() -> Column:
    return exprs.read_only(F.col("operation"))


def worth_compressing(blobs: DataFrame, content: str = "content", least: int = 1024, ratio: float = 0.95) -> DataFrame:
    """Whether a blob of `least` bytes or more shrinks to `ratio` of its size or less; the ratio is that of zstandard."""

    @F.pandas_udf("double")
    def measured(values: pd.Series) -> pd.Series:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        return pd.Series([len(compress(bytes(v))) / len(v) if v is not None and len(v) else 1.0 for v in values])

    data = F.col(content).cast("binary")
    found = blobs.withColumn("ratio", F.when(F.octet_length(data) >= least, measured(data)))
    return found.withColumn("compress", F.coalesce(F.col("ratio") <= ratio, F.lit(False)))
