"""Audit log: statistics, hash chain, groundings, Merkle roots, durations, text and binary codecs.

A log has a place `n` for each entry, from 0 on. Every entry holds the hash of the entry before it; its own hash covers that and its
fields. The first entry is a GENESIS, which names the digest of a seed; a GROUNDING after each `block` LOG entries holds the
Merkle root over their hashes. Verification works on blocks of places by themselves, each with the last entry of the one before, so no
task holds the whole log.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecat.operators import order

BLOCK = 1000
#: Entry types; fixed values of the log format.
GENESIS, LOG, GROUNDING = "GENESIS", "LOG", "GROUNDING"


def stats(audit: DataFrame) -> DataFrame:
    """Totals of the log: entries, errors (error text or outcome error; denied is none), actors, first and last time."""
    failed = (F.col("error") != "") | (F.col("outcome") == "error")
    return audit.agg(F.count("*").alias("entries"), F.count_if(failed).alias("errors"), F.count_if(F.col("outcome") == "denied").alias("denied"), F.count_distinct("actor").alias("actors"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def by_operation_actor(audit: DataFrame) -> DataFrame:
    failed = (F.col("error") != "") | (F.col("outcome") == "error")
    return audit.groupBy("operation", "actor").agg(F.count("*").alias("entries"), F.count_if(failed).alias("errors"))


def by_type(audit: DataFrame, kind: str = "entry_type") -> DataFrame:
    return audit.groupBy(kind).agg(F.count("*").alias("entries"))


def numbered(audit: DataFrame) -> DataFrame:
    """Rows with `n`, their place from 0 on in the order of (ts, id)."""
    return order.running(audit, ["ts", "id"], F.lit(1).cast("long"), "n").withColumn("n", F.col("n") - 1)


def content_hash(*fields: str | Column) -> Column:
    """sha512 over the fields, each behind its length in bytes, so that no two lists of fields read the same; in hex."""
    text = [F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit("")) for f in fields]
    return F.sha2(F.concat(*[x for t in text for x in (F.octet_length(t).cast("string"), F.lit(":"), t)]), 512)


def grounded(logs: DataFrame, hash_: Column, block: int = BLOCK) -> DataFrame:
    """A log made of numbered LOG rows (n from 0): a GENESIS in front, a GROUNDING behind each whole block, places anew.

    Columns: n, entry_type, hash, merkle_root (of groundings) and those of the rows.
    """
    rows = logs.withColumns({"block": F.floor(F.col("n") / block), "hash": hash_})
    logged = rows.withColumn("n", F.col("n") + 1 + F.col("block")).withColumns({"entry_type": F.lit(LOG), "merkle_root": F.lit(None).cast("string")})
    roots = merkle_roots(rows).where(F.col("entries") == block)
    ground = roots.select(((F.col("block") + 1) * (block + 1)).alias("n"), "block", F.lit(GROUNDING).alias("entry_type"), "merkle_root").withColumn("hash", content_hash("entry_type", "merkle_root"))
    spark = logs.sparkSession
    first = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(GENESIS).alias("entry_type")).withColumn("hash", content_hash("entry_type"))
    return logged.drop("block").unionByName(ground.drop("block"), allowMissingColumns=True).unionByName(first, allowMissingColumns=True)


def linked(log: DataFrame, seed: str, block: int = BLOCK) -> DataFrame:
    """The log with previous_hash: the hash at the place before; the first entry names the digest of the seed."""
    before = _before(log, block + 1, "hash")
    return before.withColumn("previous_hash", F.when(F.col("n") == 0, F.sha2(F.lit(seed), 512)).otherwise(F.col("__before"))).drop("__before")


def _before(log: DataFrame, block: int, column: str) -> DataFrame:
    """The log with the column's value at the place before, `__before`, null where that place is missing.

    A window in each block of places; the entry at a block's last place goes to the next block too, as what its first one follows.
    """
    own = F.floor(F.col("n") / block)
    cut = log.withColumn("__block", F.explode(F.when(F.col("n") % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__block").orderBy("n")
    seen = cut.withColumns({"__n": F.lag("n").over(w), "__lag": F.lag(column).over(w)}).where(F.col("__block") == own)
    return seen.withColumn("__before", F.when(F.col("__n") == F.col("n") - 1, F.col("__lag"))).drop("__block", "__n", "__lag")


def verified(log: DataFrame, hash_: Column, seed: str, block: int = BLOCK) -> DataFrame:
    """n, entry_type and problem of every entry that does not hold; no row for a sound log. Of several problems an entry shows the first:

    hash (the stored hash is not that of the fields), genesis (the first entry is no GENESIS or names another seed), chain (it does not
    name the hash of the entry before), ungrounded (a LOG entry where a GROUNDING is due), interval (a GROUNDING elsewhere, or after
    another number of LOG entries), root (its Merkle root is not that of the entries).

    A GROUNDING is due at each place that is a multiple of block + 1, so entries belong to a span by their place, and a missing place
    is a break of the chain. Spans are checked by themselves.
    """
    span = F.floor((F.col("n") - 1) / (block + 1))
    ground, first = F.col("entry_type") == GROUNDING, F.col("n") == 0
    logs = log.where(F.col("entry_type") == LOG).select(span.alias("block"), "n", "hash")
    roots = merkle_roots(logs).select(F.col("block").alias("__span"), "entries", F.col("merkle_root").alias("__root"))
    checked = _before(log, block + 1, "hash").withColumn("__span", F.when(ground, span)).join(roots, "__span", "left")
    due = F.col("n") % (block + 1) == 0
    problem = (
        F.when(~F.col("hash").eqNullSafe(hash_), "hash")
        .when(first & ((F.col("entry_type") != GENESIS) | ~F.col("previous_hash").eqNullSafe(F.sha2(F.lit(seed), 512))), "genesis")
        .when(~first & ~F.coalesce(F.col("previous_hash") == F.col("__before"), F.lit(False)), "chain")
        .when(~first & due & ~ground, "ungrounded")
        .when(ground & (~due | (F.coalesce("entries", F.lit(0)) != block)), "interval")
        .when(ground & ~F.col("merkle_root").eqNullSafe(F.col("__root")), "root")
    )
    return checked.select("n", "entry_type", problem.alias("problem")).where("problem IS NOT NULL")


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root over the hashes; an odd one at the end of a level is paired with itself."""
    if not hashes:
        return b""
    while len(hashes) > 1:
        if len(hashes) % 2:
            hashes = [*hashes, hashes[-1]]
        hashes = [hashlib.sha512(a + b).digest() for a, b in zip(hashes[::2], hashes[1::2], strict=True)]
    return hashes[0]


def merkle_roots(log: DataFrame) -> DataFrame:
    """Merkle root of each block of `log` (block, n, hash in hex); a block is bounded by its definition."""
    lists = log.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            roots = [merkle_root([bytes.fromhex(r["hash"]) for r in x]).hex() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(roots)], names=["block", "entries", "merkle_root"])

    return lists.select("block", F.col("rows")).mapInArrow(run, "block long, entries long, merkle_root string")


def phase_durations(audit: DataFrame, start: str, complete: str) -> DataFrame:
    """For each COMPLETE row the time since the actor's last START before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("operation") == start, F.col("ts")), ignorenulls=True).over(w)
    rows = audit.where(F.col("operation").isin(start, complete)).withColumn("begun", begun)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("begun").cast("timestamp"))
    return rows.where((F.col("operation") == complete) & F.col("begun").isNotNull()).select("id", "user_id", seconds.alias("duration_us"))


_LINE = r"^(\S+ \S+) \[(\w+)\] (\S+) actor=(\S+) outcome=(\S+) id=(\S+) error=(.*)$"


def to_text(audit: DataFrame) -> DataFrame:
    """One line of text per entry."""
    fields = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" [log] "), "operation", F.lit(" actor="), "actor", F.lit(" outcome="), "outcome", F.lit(" id="), F.col("id").cast("string"), F.lit(" error="), F.coalesce("error", F.lit(""))]
    return audit.select(F.concat(*fields).alias("value"))


def from_text(lines: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("value", _LINE, i)
    return lines.select(part(1).cast("timestamp_ntz").alias("ts"), part(2).alias("entry_type"), part(3).alias("operation"), part(4).alias("actor"), part(5).alias("outcome"), part(6).cast("long").alias("id"), part(7).alias("error"))


def _be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def to_binary(rows: DataFrame, fields: list[str]) -> DataFrame:
    """`entry`: the fields' UTF-8, each behind its length as a big-endian unsigned 32-bit integer; null counts as empty."""
    data = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    return rows.withColumn("entry", F.concat(*[x for d in data for x in (_be32(F.octet_length(d)), d.cast("binary"))]))


def from_binary(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The fields of `entry`, as strings."""
    at: Column = F.lit(1)
    out = {}
    for f in fields:
        size = F.conv(F.hex(F.substring("entry", at, 4)), 16, 10).cast("int")
        out[f] = F.decode(F.substring("entry", at + 4, size), "UTF-8")
        at = at + 4 + size
    return rows.select(*[c.alias(f) for f, c in out.items()])
