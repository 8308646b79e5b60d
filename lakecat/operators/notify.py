"""Event routing: rules by bucket, event family, key prefix and suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecat.functions import exprs

RULES = "bucket string, rule_pos int, destination string, events array<string>, prefixes array<string>, suffixes array<string>"


def _filters(key: Column) -> Column:
    every = lambda fn, c: F.forall(F.coalesce(c, F.array().cast("array<string>")), lambda x: fn(key, x))
    return every(F.startswith, F.col("prefixes")) & every(F.endswith, F.col("suffixes"))


def fan_out(events: DataFrame, rules: DataFrame, bus: list[str] = ()) -> DataFrame:
    """One row for each event and rule that takes it, and one for each event of a bucket whose events all go to the bus."""
    hit = events.join(rules, "bucket").where(F.exists("events", lambda p: exprs.event_matches(p, F.col("event_name"))) & _filters(F.col("key")))
    out = hit.select("id", "event_name", "bucket", "key", "destination")
    if bus:
        out = out.unionByName(events.where(F.col("bucket").isin(*bus)).select("id", "event_name", "bucket", "key", F.lit("eventbridge").alias("destination")))
    return out


def payload(events: DataFrame) -> DataFrame:
    """The record that a destination gets, as JSON."""
    record = F.struct(
        F.regexp_replace("event_name", "^s3:", "").alias("eventName"),
        F.struct(F.struct(F.col("bucket").alias("name")).alias("bucket"), F.struct("key", "size").alias("object")).alias("s3"),
    )
    return events.select("id", F.to_json(F.struct(F.array(record).alias("Records"))).alias("payload"))


def overlaps(rules: DataFrame) -> DataFrame:
    """Pairs of a bucket's rules that can take the same event: configuration, a hundred rules per bucket at most."""
    a, b = rules.alias("a"), rules.alias("b")
    one = lambda p: F.element_at(p, 1)
    touch = lambda x, y, fn: x.isNull() | y.isNull() | fn(x, y) | fn(y, x)
    families = F.exists("a.events", lambda x: F.exists("b.events", lambda y: exprs.event_matches(x, y) | exprs.event_matches(y, x)))
    near = touch(one(F.col("a.prefixes")), one(F.col("b.prefixes")), F.startswith) & touch(one(F.col("a.suffixes")), one(F.col("b.suffixes")), F.endswith)
    met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.rule_pos") < F.col("b.rule_pos")))
    return met.where(families & near).select(F.col("a.bucket").alias("bucket"), F.col("a.rule_pos").alias("first"), F.col("b.rule_pos").alias("second"))
