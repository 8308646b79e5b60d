"""Lifecycle rules against objects, versions and uploads.

Rules are configuration, a thousand per bucket at most; they meet objects by an equi-join on the bucket with the rest of the
rule as a condition, so the planner may broadcast them if they are small or shuffle on the bucket if they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakecat.functions import exprs
from lakecat.operators import versions as history
from lakecat.sources.config import local_frame

RULES = (
    "bucket string, rule_pos int, id string, enabled boolean, prefix string, size_gt long, size_lt long, want_tags map<string,string>, exp_days int, exp_date timestamp_ntz, "
    "expired_markers boolean, abort_days int, transitions array<struct<days:int, date:timestamp_ntz, storage_class:string>>, "
    "nc_days int, nc_newer int, nc_transitions array<struct<days:int, newer:int, storage_class:string>>"
)


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules given as dicts; what a rule does not name is null, but a rule is enabled if it does not say otherwise.

    `want_tags` holds all tags that an object must have, that of a filter and those of its conjunction alike.
    """
    names = ["bucket", "rule_pos", "id", "enabled", "prefix", "size_gt", "size_lt", "want_tags", "exp_days", "exp_date", "expired_markers", "abort_days", "transitions", "nc_days", "nc_newer", "nc_transitions"]
    made = [{"enabled": True} | r for r in rules]
    rows = [tuple(list(r[n].items()) if n == "want_tags" and r.get(n) is not None else r.get(n) for n in names) for r in made]
    return local_frame(spark, rows, RULES)


def matches(size: Column, tags: Column | None) -> Column:
    """Prefix, strict size bounds and all tags of a rule."""
    ok = F.startswith("key", F.coalesce("prefix", F.lit("")))
    ok = ok & (F.col("size_gt").isNull() | (size > F.col("size_gt"))) & (F.col("size_lt").isNull() | (size < F.col("size_lt")))
    wanted = F.map_entries("want_tags")
    none = F.coalesce(F.size(wanted) <= 0, F.lit(True))
    if tags is None:
        return ok & none
    return ok & (none | F.coalesce(F.forall(wanted, lambda w: F.coalesce(F.element_at(tags, w["key"]) == w["value"], F.lit(False))), F.lit(False)))


def _due(days: Column, date: Column, created: Column) -> Column:
    return F.coalesce(F.when(days.isNotNull(), exprs.next_midnight(created, days)), date)


def _last_due(transitions: str, due, now: Column, allowed=None) -> Column:
    """Of a rule's transitions those due by now to another class: struct(due, order, to_class) of the one due last, of ties the first."""
    current = exprs.storage_class(F.col("storage_class"))

    def made(t: Column, i: Column) -> Column:
        ok = (due(t) <= now) & (t["storage_class"] != current) & (F.lit(True) if allowed is None else allowed(t))
        return F.when(ok, F.struct(due(t).alias("due"), (-F.col("rule_pos")).alias("pos"), (-i).alias("t_pos"), t["storage_class"].alias("to_class"), F.col("id").alias("rule_id")))

    return F.array_max(F.transform(transitions, made))


def current_actions(objects: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """bucket, key, upload_id (of pending uploads), and what enabled rules ask of it: `expire` (rule_pos, rule_id, due), `move` (due, pos, t_pos,
    to_class, rule_id), `abort` (due). Objects meet their bucket's rules once, and one aggregate picks."""
    pending = F.col("upload_status") == "PENDING"
    asked = rules.where("enabled AND (exp_days IS NOT NULL OR exp_date IS NOT NULL OR abort_days IS NOT NULL OR transitions IS NOT NULL)")
    met = objects.join(asked, "bucket").where(F.when(pending, matches(F.lit(0), None)).otherwise(matches(F.col("size"), F.col("tags"))))
    created = F.col("created_at")
    expires, aborts_ = _due(F.col("exp_days"), F.col("exp_date"), created), exprs.next_midnight(created, F.col("abort_days"))
    move = _last_due("transitions", lambda t: _due(t["days"], t["date"], created), now)
    each = met.select(
        "bucket", "key", F.when(pending, F.col("upload_id")).alias("upload_id"),
        F.when(~pending & (expires <= now), F.struct("rule_pos", F.col("id").alias("rule_id"), expires.alias("due"))).alias("expire"),
        F.when(~pending, move).alias("move"),
        F.when(pending & (aborts_ <= now), aborts_).alias("abort"),
    ).where("expire IS NOT NULL OR move IS NOT NULL OR abort IS NOT NULL")
    return each.groupBy("bucket", "key", "upload_id").agg(F.min("expire").alias("expire"), F.max("move").alias("move"), F.min("abort").alias("abort"))


def expirations(objects: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Completed objects that a rule expires by now, each with the first such rule."""
    return current_actions(objects.where("upload_status = 'COMPLETED'"), rules, now).where("expire IS NOT NULL").select("bucket", "key", "expire.rule_id", "expire.due")


def transitions(objects: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """The transition that is due last by now, of ties the first in rule order, of those to another class than the object's."""
    return current_actions(objects.where("upload_status = 'COMPLETED'"), rules, now).where("move IS NOT NULL").select("bucket", "key", "move.rule_id", "move.to_class", "move.due")


def aborts(objects: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Pending uploads that a rule aborts; uploads have no size and no tags."""
    return current_actions(objects.where("upload_status = 'PENDING'"), rules, now).where("abort IS NOT NULL").select("bucket", "key", "upload_id", F.col("abort").alias("due"))


def expired_markers(versions: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys whose versions are delete markers all, with the latest marker, under an enabled rule that removes such markers and matches it."""
    newest = F.max(F.struct("last_modified", "version_id", "size")).alias("m")
    lone = versions.groupBy("bucket", "key").agg(F.bool_and("is_delete_marker").alias("only"), F.count("*").alias("n_markers"), newest).where("only")
    hit = lone.join(rules.where("enabled AND expired_markers"), "bucket").where(matches(F.coalesce("m.size", F.lit(0)), None))
    return hit.select("bucket", "key", "n_markers", F.col("m.version_id").alias("version_id")).distinct()


def noncurrent_actions(versions: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """bucket, key, version_id of noncurrent versions, and what enabled rules ask: `expire` (rule_pos, due), `move` (due, pos, t_pos, to_class, rule_id).

    A version counts from when it was superseded; a rule that keeps newer ones acts on those with more newer noncurrent versions.
    Versions without tags or storage_class columns have no tags and the standard class.
    """
    since = F.col("noncurrent_since")
    expires = exprs.next_midnight(since, F.col("nc_days"))
    for name, kind in (("tags", "map<string,string>"), ("storage_class", "string")):
        if name not in versions.columns:
            versions = versions.withColumn(name, F.lit(None).cast(kind))
    old = history.noncurrent(versions).where("NOT is_latest AND NOT is_delete_marker")
    met = old.join(rules.where("enabled AND (nc_days IS NOT NULL OR nc_transitions IS NOT NULL)"), "bucket").where(matches(F.col("size"), F.col("tags")))
    move = _last_due("nc_transitions", lambda t: exprs.next_midnight(since, t["days"]), now, lambda t: F.col("newer") > F.coalesce(t["newer"], F.lit(-1)))
    each = met.select(
        "bucket", "key", "version_id",
        F.when((expires <= now) & (F.col("newer") > F.coalesce("nc_newer", F.lit(-1))), F.struct("rule_pos", expires.alias("due"))).alias("expire"),
        move.alias("move"),
    ).where("expire IS NOT NULL OR move IS NOT NULL")
    return each.groupBy("bucket", "key", "version_id").agg(F.min("expire").alias("expire"), F.max("move").alias("move"))


def noncurrent_expirations(versions: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Noncurrent versions that a rule expires, each with the first such rule and when that fell due."""
    return noncurrent_actions(versions, rules, now).where("expire IS NOT NULL").select("bucket", "key", "version_id", "expire.rule_pos", "expire.due")


def noncurrent_transitions(versions: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """The class that each noncurrent version moves to: of the due ones to another class than its own, the one due last."""
    return noncurrent_actions(versions, rules, now).where("move IS NOT NULL").select("bucket", "key", "version_id", "move.to_class", "move.due")


#: Actions of a sweep, in the order in which it takes them.
ACTIONS = ("EXPIRE", "EXPIRE_MARKER", "EXPIRE_VERSION", "TRANSITION_VERSION", "TRANSITION", "ABORT")


def plan(objects: DataFrame, versions: DataFrame | None, rules: DataFrame, now: Column) -> DataFrame:
    """bucket, key, target, action, detail: what a sweep does. Target is null for an object, else the version or upload that is meant.

    An object that expires is not moved, a version that expires neither; every due upload is aborted by itself.
    """
    own = current_actions(objects, rules, now)
    said = own.select(
        "bucket", "key", F.col("upload_id").alias("target"),
        F.when(F.col("abort").isNotNull(), "ABORT").when(F.col("expire").isNotNull(), "EXPIRE").otherwise("TRANSITION").alias("action"),
        F.when(F.col("abort").isNull() & F.col("expire").isNull(), F.col("move.to_class")).alias("detail"),
    )
    if versions is None:
        return said
    gone = expired_markers(versions, rules).select("bucket", "key", F.col("version_id").alias("target"), F.lit("EXPIRE_MARKER").alias("action"), F.lit(None).cast("string").alias("detail"))
    old = noncurrent_actions(versions, rules, now).select(
        "bucket", "key", F.col("version_id").alias("target"),
        F.when(F.col("expire").isNotNull(), "EXPIRE_VERSION").otherwise("TRANSITION_VERSION").alias("action"),
        F.when(F.col("expire").isNull(), F.col("move.to_class")).alias("detail"),
    )
    return said.unionByName(gone).unionByName(old)


def invalid_rules(rules: DataFrame) -> DataFrame:
    """Rules that break the configuration's own conditions, with the reason."""
    w = Window.partitionBy("bucket", "id")
    target = lambda c: F.coalesce(F.transform(c, lambda t: t["storage_class"]), F.array().cast("array<string>"))
    any_target = lambda f: F.exists(F.concat(target("transitions"), target("nc_transitions")), f)
    repeated = lambda c: F.size(F.array_distinct(target(c))) < F.size(target(c))
    midnight = lambda t: t == F.date_trunc("DAY", t).cast("timestamp_ntz")
    reason = (
        F.when(F.count("*").over(Window.partitionBy("bucket")) > 1000, "more than 1000 rules")
        .when(F.length("id") > 255, "id too long")
        .when(F.count("*").over(w) > 1, "id not unique")
        .when((F.col("exp_days") <= 0) | (F.col("abort_days") <= 0) | (F.col("nc_days") <= 0), "days not positive")
        .when(F.col("exp_days").isNotNull() & F.col("exp_date").isNotNull(), "days and date")
        .when(F.coalesce("expired_markers", F.lit(False)) & (F.col("exp_days").isNotNull() | F.col("exp_date").isNotNull()), "markers with days or date")
        .when(F.coalesce("expired_markers", F.lit(False)) & (F.coalesce(F.size("want_tags"), F.lit(0)) > 0), "markers with tag")
        .when(~F.coalesce(midnight(F.col("exp_date")), F.lit(True)), "date not at midnight")
        .when(F.coalesce(F.exists("transitions", lambda t: t["days"].isNull() == t["date"].isNull()), F.lit(False)), "transition needs days or date")
        .when(F.coalesce(F.exists("nc_transitions", lambda t: t["days"].isNull() | (t["days"] <= 0)), F.lit(False)), "transition needs days")
        .when(F.coalesce(F.exists("transitions", lambda t: t["days"] < 0), F.lit(False)), "transition days negative")
        .when(any_target(lambda t: t == "STANDARD"), "transition to STANDARD")
        .when(repeated("transitions") | repeated("nc_transitions"), "class twice")
        .when(F.coalesce(F.exists("transitions", lambda t: t["days"] >= F.col("exp_days")), F.lit(False)), "transition not before expiration")
        .when(F.coalesce(F.exists("nc_transitions", lambda t: t["days"] >= F.col("nc_days")), F.lit(False)), "transition not before expiration")
        .when(~F.coalesce(F.col("nc_newer").between(1, 100), F.lit(True)), "newer versions not 1 to 100")
        .when((F.col("size_gt") < 0) | (F.col("size_lt") < 0) | (F.col("size_gt") >= F.col("size_lt")), "sizes")
        .when(F.col("abort_days").isNotNull() & (F.col("size_gt").isNotNull() | F.col("size_lt").isNotNull()), "abort with size")
        .when(F.col("abort_days").isNotNull() & (F.coalesce(F.size("want_tags"), F.lit(0)) > 0), "abort with tag")
        .when(F.coalesce("exp_days", "abort_days", "nc_days").isNull() & F.col("exp_date").isNull() & F.col("transitions").isNull() & F.col("nc_transitions").isNull() & ~F.coalesce("expired_markers", F.lit(False)), "no action")
    )
    return rules.withColumn("reason", reason).where("reason IS NOT NULL")
