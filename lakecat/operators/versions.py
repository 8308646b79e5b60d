"""Version history: which version is latest, since when others are not, and the state that a command log leaves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("bucket", "key")


def _newest_first():
    return Window.partitionBy(*KEY).orderBy(F.desc("last_modified"), F.desc("version_id"))


def latest(versions: DataFrame) -> DataFrame:
    """One row per key: the newest version, by a max over structs that is combined before the shuffle."""
    order = F.struct("last_modified", "version_id", "is_delete_marker", "size")
    return versions.groupBy(*KEY).agg(F.max(order).alias("v"), F.count("*").alias("n_versions")).select(*KEY, "v.*", "n_versions")


def promoted(versions: DataFrame) -> DataFrame:
    """The version that becomes latest when the latest one is deleted; keys with one version have none."""
    ranked = versions.withColumn("n", F.row_number().over(_newest_first()))
    return ranked.where("n = 2").drop("n")


def noncurrent(versions: DataFrame) -> DataFrame:
    """Adds is_latest, noncurrent_since (when the next newer row of any kind came) and newer (how many newer noncurrent versions)."""
    w = _newest_first()
    ranked = versions.withColumns({"n": F.row_number().over(w), "noncurrent_since": F.lag("last_modified").over(w)})
    counts = F.when((F.col("n") > 1) & ~F.col("is_delete_marker"), 1).otherwise(0)
    newer = F.sum(counts).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumns({"newer": F.coalesce(newer, F.lit(0)).cast("long"), "is_latest": F.col("n") == 1}).drop("n")


def fold(commands: DataFrame, versioning: str) -> DataFrame:
    """State after a log of (bucket, key, id, op, size): PUT and DELETE commands in the order of their ids.

    versioning: "disabled" (a key holds its last PUT, or nothing after a DELETE), "enabled" (each PUT is a version, each
    DELETE a marker) or "suspended" (the null version is replaced by each command; a DELETE leaves a marker).
    """
    if versioning == "enabled":
        newest = F.max("id").over(Window.partitionBy(*KEY))
        return commands.select(*KEY, F.col("id").cast("string").alias("version_id"), (F.col("op") == "DELETE").alias("is_delete_marker"), "size", (F.col("id") == newest).alias("is_latest"))
    last = commands.groupBy(*KEY).agg(F.max(F.struct("id", "op", "size")).alias("c"))
    state = last.select(*KEY, F.lit("null").alias("version_id"), (F.col("c.op") == "DELETE").alias("is_delete_marker"), F.col("c.size").alias("size"), F.lit(True).alias("is_latest"))
    return state.where("NOT is_delete_marker") if versioning == "disabled" else state


def fold_states(commands: DataFrame) -> DataFrame:
    """As fold, where each command carries the bucket's `versioning` of its time ("enabled", else it writes the null version).

    Versions written while versioning was enabled stay; the last of the other commands is the null version, as an object or a marker.
    The latest row is the one of the last command.
    """
    named = F.col("versioning") == "enabled"
    last_null = F.max(F.when(~named, F.col("id"))).over(Window.partitionBy(*KEY))
    newest = F.max("id").over(Window.partitionBy(*KEY))
    kept = commands.withColumns({"__null": last_null, "__newest": newest}).where(named | (F.col("id") == F.col("__null")))
    return kept.select(*KEY, F.when(named, F.col("id").cast("string")).otherwise("null").alias("version_id"), (F.col("op") == "DELETE").alias("is_delete_marker"), "size", (F.col("id") == F.col("__newest")).alias("is_latest"))


def merge_delta(base: DataFrame, delta: DataFrame, on: list[str], deleted: str = "deleted") -> DataFrame:
    """base with the rows of delta put in place of those with equal keys; rows marked deleted go."""
    kept = base.join(delta.select(*on), on, "left_anti")
    return kept.unionByName(delta.where(~F.col(deleted)).select(*base.columns))


def replay(commands: DataFrame, step, schema: str) -> DataFrame:
    """A state machine over each key's commands in id order, for rules that no aggregate expresses; step(frame) -> frame."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return step(rows.sort_values("id"))

    return commands.groupBy(*KEY).applyInPandas(run, schema)


def compare_and_set(rows: DataFrame, updates: DataFrame, on: str) -> DataFrame:
    """Updates whose expected version is the stored one, with the next version."""
    return updates.join(rows.select(on, "version"), on).where("expected = version").withColumn("version", F.col("version") + 1).drop("expected")

