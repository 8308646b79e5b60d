"""Places and running sums in a global order, without bringing an order's rows into one task.

Rows are cut into ranges whose bounds come from a bounded sample, ranges are summed up by themselves, and only the ranges' totals,
one row each, meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows sampled for each range.
_SAMPLE = 20


def bounds(rows: DataFrame, by: list[str], ranges: int) -> list[Column]:
    """At most ranges - 1 ascending bounds, as literals of struct(by), from the rows with the smallest hashes."""
    order = F.struct(*by)
    few = rows.select(*by).orderBy(F.xxhash64(*by)).limit(_SAMPLE * ranges)
    held = few.select(F.sort_array(F.collect_set(order)).alias("x")).groupBy().agg(F.first("x").alias("x")).select(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(max(ranges - 1, 1))), lambda i: F.get(F.col("x"), (i * F.size("x") / ranges).cast("int")))).alias("x")
    ).first()["x"]
    types = rows.select(*by).schema
    return [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, types, strict=True)]) for b in held if b is not None]


def range_of(key: Column, at: list[Column], first: int = 0) -> Column:
    """The number of bounds below the key, by a tree of comparisons."""
    if not at:
        return F.lit(first)
    m = len(at) // 2
    return F.when(key <= at[m], range_of(key, at[:m], first)).otherwise(range_of(key, at[m + 1 :], first + m + 1))


def running(rows: DataFrame, by: list[str], value: Column, name: str, groups: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """rows with the sum of `value` over all rows of the same group up to and with each row, in the order of `by`.

    `by` must be unique in a group and free of nulls. A group is cut by the same ranges, so a hot group is spread over tasks.
    """
    groups = groups or []
    if ranges is None:
        ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*groups, *by]
    cut = rows.withColumns({"__range": range_of(F.struct(*key), bounds(rows, key, ranges)), "__counted": value})
    own = F.sum("__counted").over(Window.partitionBy(*groups, "__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = cut.groupBy(*groups, "__range").agg(F.sum("__counted").alias("__sum"))
    # one row per range and group
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(g).alias(f"__of_{i}") for i, g in enumerate(groups)], F.col("__range").alias("__at"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier"))
    same = F.col("__range") == F.col("__at")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{i}"))
    met = cut.withColumn("__within", own).join(before, same)
    return met.withColumn(name, F.col("__within") + F.col("__earlier")).drop("__range", "__at", "__counted", "__within", "__earlier", *[f"__of_{i}" for i in range(len(groups))])
