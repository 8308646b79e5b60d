"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at `radius` or fewer differing bits have a point half-way between them that lies within half the radius of
both. Every distinct fingerprint therefore emits the variants within half the radius and those that meet are compared.

Over whole 64-bit words with radius 4 these are 2,081 variants. `blocks` lowers the number without losing a link: when the
word is cut in three blocks, one of them holds at least two of four differing bits, so the other two together hold at most
two, and half of that radius is one. Each fingerprint then emits, for each of the three pairs of blocks, the pair itself and
its one-bit variants: 131 rows. blocks=1 is the plain ball. Meeting fingerprints are verified over all 64 bits.

A variant on which more than `crowd` fingerprints meet is not compared pairwise: its fingerprints go the plain way. All that
share a plain variant lie within twice half the radius of each other, so a star to the smallest of them loses no link.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; texts with
fewer words than a shingle are one shingle; repeated rows share a component; rows with a null doc_id keep a null id but
count as a member (a component of null ids only has a null id); texts of any length are hashed whole; an empty table gives an empty
result; extra columns pass through `components`, but for fp, root and component_id, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, RADIUS, BLOCKS, CROWD = 4, 42, 4, 3, 2048
_BLOCK_BYTES = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    return int(_majority(_hashes(words, shingle, seed)))


def _hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> np.uint64:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).view(np.uint64)[0]


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs without the text, with the fingerprint as a signed long in column `into`."""
    kept = docs.select(*[c for c in docs.columns if c not in (text, into)], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = kept.drop("__text").withColumn(into, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = [fingerprint(x, shingle, seed) for x in common.encoded(texts)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(np.array(out, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return kept.mapInArrow(run, schema)


def masks(radius: int, blocks: int) -> list[tuple[int, int]]:
    """(kept bits, flipped bits) of each variant: keep all but one block, flip up to half of the radius that is left."""
    if blocks == 1:
        whole = (1 << 64) - 1
        return [(whole, sum(1 << b for b in bits)) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    edges = [64 * i // blocks for i in range(blocks + 1)]
    left = radius - -(-radius // blocks)  # the fullest block holds at least the mean
    half, out = -(-left // 2), []
    for lo, hi in zip(edges, edges[1:], strict=False):
        kept = [b for b in range(64) if not lo <= b < hi]
        out += [(sum(1 << b for b in kept), sum(1 << b for b in bits)) for k in range(half + 1) for bits in combinations(kept, k)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fp, kept-block mask `part` and variant `v`; generated in the JVM."""
    table = masks(radius, blocks)
    parts = sorted({k for k, _ in table})
    pairs = F.array(*[
        F.struct(
            F.lit(i).cast("byte").alias("part"),
            F.lit(_signed(k)).alias("kept"),
            F.array(*[F.lit(_signed(m)) for kk, m in table if kk == k]).alias("flips"),
        )
        for i, k in enumerate(parts)
    ])
    each = fps.select("fp", F.explode(pairs).alias("p")).select("fp", "p.part", F.col("fp").bitwiseAND(F.col("p.kept")).alias("own"), F.explode("p.flips").alias("flip"))
    return each.select("fp", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("v"))


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) of the components within one small group."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints of `fps` (column fp) whose closure joins all pairs within the radius."""
    spark = fps.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # few bytes a fingerprint, many variants: without this the small input would be put into few tasks; dealt by a hash of its own,
    # because the planner drops a partitioning that repeats the one of `distinct` and then coalesces that one by its bytes
    met = _variants(fps.repartition(n, F.xxhash64("fp")), radius, blocks)
    schema = "a long, b long, hot boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (part, v); a group that ends a batch is carried to the next."""
        rest: tuple[np.ndarray, ...] = tuple(np.zeros(0, t) for t in (np.int8, np.int64, np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            part, v, fp = (np.concatenate([r, x]) for r, x in zip(rest, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)), strict=True))
            cut = np.flatnonzero((part != part[-1]) | (v != v[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            rest = part[cut:], v[cut:], fp[cut:]
            yield from found(part[:cut], v[:cut], fp[:cut])
        yield from found(*rest)

    def found(part: np.ndarray, v: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(v):
            return
        first = np.concatenate([[True], (v[1:] != v[:-1]) | (part[1:] != part[:-1])])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(v)))
        a, b, hot = [], [], []
        two = starts[counts == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(x ^ y) <= radius
        a.append(x[near])
        b.append(y[near])
        for s, c in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
            own = np.sort(fp[s : s + c])
            if c > crowd:
                hot.append(own)
            else:
                x, y = _forest(own, radius)
                a.append(x)
                b.append(y)
        a, b, hot = np.concatenate(a), np.concatenate(b), np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)
        pairs = np.unique(np.stack([np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        h = hot.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], h])), pa.array(np.concatenate([pairs[:, 1], h])), pa.array(np.concatenate([np.zeros(len(pairs), bool), np.ones(len(h), bool)]))], names=["a", "b", "hot"])

    dealt = met.select("part", "v", "fp").repartition(n, "part", "v").sortWithinPartitions("part", "v")
    all_ = common.staged(dealt.mapInArrow(run, schema).distinct(), "links")
    pairs = all_.where("not hot").select("a", "b")
    if blocks == 1:
        return pairs
    crowded = all_.where("hot").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return pairs
    ball = _variants(crowded, radius, 1)
    star = ball.groupBy("v").agg(F.min("fp").alias("a"))
    return pairs.union(ball.join(star, "v").where("fp != a").select("a", F.col("fp").alias("b"))).distinct()


def closure(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every node that has an edge.

    Alternating large-star and small-star steps; each cuts the lineage with a written table and keeps the number of edges
    bounded by the input. A star per component is the fixed point.
    """
    spark = edges.sparkSession
    now = common.staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every node points its smaller neighbours and itself to the smallest
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = common.staged(small, "edges")
        state = new.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        before = now.agg(F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        now = new
        if state["n"] == state["d"] and state["x"] == before["x"]:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, crowd: int = CROWD, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs without text, with `fp` (long), `component_id`, the smallest doc_id that links reach, and `root`, the smallest
    fingerprint that they reach, which tells components of null ids apart."""
    docs = docs.drop(*[c for c in ("fp", "root", "component_id") if c in docs.columns])
    rows = common.staged(fingerprints(docs, shingle=shingle, seed=seed), "fingerprints")
    fps = rows.select("fp").distinct()
    roots = closure(links(fps, radius, blocks, crowd))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = common.staged(rooted, "rooted")
    # staged, so that both sides of the join on root are plain shuffles and the planner can split a hot root
    own = common.staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "own")
    known = rooted.join(own, "root").select("fp", "root", "component_id")
    return rows.join(known, "fp")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (null ids last), of equal ids the one whose text hashes
    smallest, of repeated rows one."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = components(keyed, **options)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("__id"), F.col("first.h").alias("__h"))
    rows = docs.withColumn("__key", F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__h")), "left_semi")
    order = Window.partitionBy("doc_id", "__key").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in sorted(docs.columns)])
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
