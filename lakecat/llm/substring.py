"""Substring dedup by De Bruijn compaction.

The graph: every `window` consecutive words of a document are an edge; edges with equal words are one edge with a
multiplicity. Words that an edge of multiplicity two or more covers are removed.

Edges are not shuffled one by one. Each edge has an anchor, the `k` words in it with the smallest hash (leftmost of ties);
consecutive edges with the same anchor position form a path, on average a dozen edges. Equal edges have equal anchors, so

1. anchors that occur once rule out their whole path (aggregate, then a join drops these paths);
2. paths of equal words are counted: a path that occurs twice or more repeats as a whole (join);
3. where an anchor starts two or more different paths, one source of each of these paths is opened, by its source coordinates,
   into its single edges, and those are counted by their words;
4. repeated paths are compacted: from the neighbours of all occurrences comes which other path each one leads to and comes
   from; where one leads always to the same one, and that one comes always from it, the two are glued (a join of
   out-degrees with in-degrees, and one that brings its result to the occurrences). So each maximal nonbranching run of
   paths is one long span per occurrence;
5. long spans are verified at their source coordinates: the words of all occurrences of a span, read from the texts, are compared
   with each other, and an occurrence whose words no other one has is not cut out.

Until then paths are told apart by digests of their words' bytes, 128 bits in all with the anchor's; the single edges at branchings, a window
long each, are told apart by 128 bits of their words' bytes and not read again.

Defined results: null text has no words; texts shorter than a window lose none; words that overlap their own earlier
occurrence are removed like any other; repeated rows (same id, same text) are occurrences of each other; rows with null ids
are documents like others, told apart by their text; texts of any length are worked on whole, their grams numbered piece by
piece, and spans are compared in pieces of `PIECE` words; an empty table gives an empty result; other columns, whatever their names, pass
through `strip` and, but for `cuts`, which is the result's own, `removed`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW, K, PIECE = 35, 10, 4096
_BLOCK_BYTES = 2 << 20
#: Bytes of different pieces of spans that a task counts before it hands them on.
_SEEN_BYTES = 8 << 20


#: Grams are compared by the bits above _LOW; a piece of so many grams is numbered in the bits below.
_PLACE_BITS = 24
_LOW = np.uint64((1 << 24) - 1)


class Words:
    """The words of some texts, one after another, joined by single spaces in `bytes`."""

    def __init__(self, texts: list[bytes]):
        split = [x.split() for x in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.ends_of = np.cumsum(self.counts)
        self.bytes = b" ".join([b" ".join(w) for w in split if w])
        n = int(self.counts.sum())
        lengths = np.fromiter((len(x) for w in split for x in w), np.int64, n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def hashes(self) -> np.ndarray:
        return common.byte_hashes(np.frombuffer(self.bytes, np.uint8), self.starts, self.ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : len(x) - have + 1]) if have < w else out


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w consecutive grams, the first of equal ones; places are packed into the low bits, piece by piece."""
    low = np.uint64((1 << _PLACE_BITS) - 1)
    step = (1 << _PLACE_BITS) - w
    out = []
    for a in range(0, len(grams) - w + 1, step):
        part = grams[a : a + step + w - 1]
        out.append((sliding_min((part & ~_LOW) | np.arange(len(part), dtype=np.uint64), w) & low).astype(np.int64) + a)
    return np.concatenate(out)


def paths_of(texts: list[bytes], window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, lo, n, anchor, digest) of each path: n edges from word lo on that share an anchor."""
    words = Words(texts)
    total, w = len(words.starts), window - k + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if total < window:
        return none
    grams = common.gram_hashes(words.hashes(), k)
    anchor = anchors(grams, w)
    text = np.repeat(np.arange(len(texts)), words.counts)[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + window <= words.ends_of[text])
    if not len(at):
        return none
    first = np.concatenate([[True], (np.diff(anchor[at]) != 0) | (np.diff(at) != 1)])
    lo = at[first]
    n = np.diff(np.append(np.flatnonzero(first), len(at)))
    digest, data = xxhash.xxh64_intdigest, words.bytes
    spans = np.fromiter([digest(data[a:b]) for a, b in zip(words.starts[lo].tolist(), words.ends[lo + n + window - 2].tolist(), strict=True)], np.uint64, len(lo))
    of = text[lo]
    return of, lo - (words.ends_of - words.counts)[of], n, grams[anchor[lo]].view(np.int64), spans.view(np.int64)


def _key(docs: DataFrame) -> tuple[Column, Column]:
    """Two columns that tell documents apart: the id, of a null id a hash of the text, and another hash of the text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"])), F.hash(docs["text"])


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns behind the key; the same columns in the same order let the planner shuffle the texts once for both joins."""
    d, h = _key(docs)
    return docs.select(d.alias("__d"), h.alias("__h"), *columns)


def paths(keyed: DataFrame, window: int, k: int) -> DataFrame:
    schema = "d long, h int, lo int, n int, a long, s long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, _BLOCK_BYTES):
                of, lo, n, a, s = paths_of(common.encoded(part.column(2)), window, k)
                if len(of):
                    take = pa.array(of)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(a), pa.array(s)], names=["d", "h", "lo", "n", "a", "s"])

    return keyed.mapInArrow(run, schema)


def _edges(keyed: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """The single edges of the opened paths: d, h, pos, two digests of the edge's words."""
    lists = opened.groupBy("d", "h").agg(F.collect_list(F.struct("lo", "n")).alias("open"))
    met = keyed.join(lists, (F.col("__d") == F.col("d")) & (F.col("__h") == F.col("h"))).select("d", "h", "text", "open", "doc_id")
    schema = "d long, h int, pos int, e1 long, e2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, e = [], [], []
            for i, (text, spans) in enumerate(zip(common.encoded(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                words = Words([text])
                at = np.unique(np.concatenate([np.arange(x["lo"], x["lo"] + x["n"]) for x in spans]))
                digest, data = xxhash.xxh3_128_digest, words.bytes
                e += [digest(data[a:b]) for a, b in zip(words.starts[at].tolist(), words.ends[at + window - 1].tolist(), strict=True)]
                rows.append(np.full(len(at), i))
                pos.append(at)
                if sum(map(len, pos)) > 200_000:
                    yield made(batch, rows, pos, e)
                    rows, pos, e = [], [], []
            if rows:
                yield made(batch, rows, pos, e)

    def made(batch: pa.RecordBatch, rows: list, pos: list, e: list) -> pa.RecordBatch:
        take, both = pa.array(np.concatenate(rows)), np.frombuffer(b"".join(e), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["d", "h", "pos", "e1", "e2"])

    # repeated rows open the same path each: their edges are occurrences of each other
    return met.mapInArrow(run, schema)


def repeated(docs: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The repeated paths of each document (d, h, lo, n, k1, k2: n edges from word lo on, told by two digests), and the repeated edges of paths at
    branchings (d, h, lo).

    What is counted is staged before it is joined, so that the planner can split a join's hot keys on the side of the paths.
    """
    spark, keyed = docs.sparkSession, _keyed(docs, "doc_id", "text")
    made = common.staging(spark, "paths")
    all_ = common.staged_at(paths(keyed.select("__d", "__h", "text"), window, k), made)
    # 1. anchors that occur twice or more, counted before they are shuffled
    twice = common.staged(all_.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "anchors")
    some = common.staged(all_.join(twice, "a"), "repeated")
    common.drop_path(spark, made)
    # 2. multiplicity of whole paths, and one source of each
    path = common.staged(some.groupBy("a", "s").agg(F.count("*").alias("c"), F.min(F.struct("d", "h", "lo", "n")).alias("source")), "multiplicity")
    whole = some.join(path.where("c > 1").select("a", "s"), ["a", "s"]).select("d", "h", "lo", "n", F.col("a").alias("k1"), F.col("s").alias("k2"))
    # 3. branching anchors: their paths are opened into edges
    branching = common.staged(path.groupBy("a").agg(F.count("*").alias("ways")).where("ways > 1").select("a"), "branching")
    edge = _edges(keyed, path.join(branching, "a").select("source.*"), window)
    # grouped as one struct, the counts are shuffled once more for the join, and the planner can split a hot edge's rows there
    again = edge.groupBy(F.struct("e1", "e2").alias("e")).agg(F.count("*").alias("c")).where("c > 1").select("e.e1", "e.e2")
    return whole, edge.join(again, ["e1", "e2"]).select("d", "h", F.col("pos").alias("lo"))


def compacted(whole: DataFrame) -> DataFrame:
    """d, h, lo, n, k1, k2: each maximal nonbranching run of repeated paths as one span per occurrence, told by its first path."""
    w = Window.partitionBy("d", "h").orderBy("lo")
    # repeated rows hold the same paths at the same places: one of each place is enough
    before, after = F.lag(F.struct("lo", "n", "k1", "k2")).over(w), F.lead(F.struct("lo", "k1", "k2")).over(w)
    beside = whole.distinct().withColumns({"p": before, "q": after})
    follows, leads = F.col("p.lo") + F.col("p.n") == F.col("lo"), F.col("q.lo") == F.col("lo") + F.col("n")
    steps = common.staged(beside.select("d", "h", "lo", "n", "k1", "k2", *[F.when(ok, F.col(f"{x}.k{i}")).alias(f"{x}{i}") for x, ok in (("p", follows), ("q", leads)) for i in (1, 2)]), "steps")

    def only(x: str) -> DataFrame:
        """Paths that always have a neighbour on this side, and always the same one."""
        one, two = f"{x}1", f"{x}2"
        same = (F.count(one) == F.count("*")) & (F.min(one) == F.max(one)) & (F.min(two) == F.max(two))
        return steps.groupBy("k1", "k2").agg(same.alias("same"), F.min(one).alias(one), F.min(two).alias(two)).where("same").drop("same")

    out = only("q").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("q1").alias("k1"), F.col("q2").alias("k2"))
    glued = common.staged(only("p").join(out, ["k1", "k2", "p1", "p2"]).select("k1", "k2", F.lit(1).alias("glued")), "glued")
    marked = steps.select("d", "h", "lo", "n", "k1", "k2").join(glued, ["k1", "k2"], "left")
    number = F.sum(F.when(F.col("glued").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("run", number).groupBy("d", "h", "run").agg(F.min(F.struct("lo", "k1", "k2")).alias("f"), F.sum("n").cast("int").alias("n"))
    return runs.select("d", "h", "f.lo", "n", "f.k1", "f.k2")


def spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """d, h, lo, n, k1, k2: runs of n repeated edges of a document from word lo on; the words lo to lo+n+window-2 go, once they are verified. Keys are
    null for single edges. Runs may adjoin; `cover` merges them."""
    whole, single = repeated(docs, window, k)
    none = F.lit(None).cast("long")
    return compacted(whole).unionByName(single.distinct().select("d", "h", "lo", F.lit(1).alias("n"), none.alias("k1"), none.alias("k2")))


def unverified(cut: DataFrame, window: int) -> DataFrame:
    """d, h, lo of the long spans that have a piece whose words no other occurrence has. cut: __d, __h, text, cuts."""
    schema = "d long, h int, lo int, k1 long, k2 long, piece int, words binary, c long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal pieces are counted before they leave a task, so that a span which many documents hold is a row per task and not per document."""
        seen: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            for part in common.blocks(batch, _BLOCK_BYTES):
                for d, h, text, cuts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.encoded(part.column(2)), part.column(3).to_pylist(), strict=True):
                    words = text.split()
                    for c in cuts:
                        if c["k1"] is None:
                            continue
                        end = c["lo"] + c["n"] + window - 1
                        for i, a in enumerate(range(c["lo"], end, PIECE)):
                            key = c["k1"], c["k2"], i, b" ".join(words[a : min(a + PIECE, end)])
                            if key in seen:
                                seen[key][3] += 1
                            else:
                                seen[key] = [d, h, c["lo"], 1]
                                size += len(key[3])
                if size > _SEEN_BYTES:
                    yield made(seen)
                    seen, size = {}, 0
        yield made(seen)

    def made(seen: dict[tuple, list]) -> pa.RecordBatch:
        rows = [(*of, *key, n) for key, (*of, n) in seen.items()]
        return common.out_batch(held, zip(*rows, strict=True) if rows else [[]] * len(held))

    held = pa.schema([("d", pa.int64()), ("h", pa.int32()), ("lo", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("piece", pa.int32()), ("words", pa.binary()), ("c", pa.int64())])
    said = cut.select("__d", "__h", "text", "cuts").where("cuts IS NOT NULL").mapInArrow(run, schema)
    alone = said.groupBy("k1", "k2", "piece", "words").agg(F.sum("c").alias("c"), *[F.min(x).alias(x) for x in ("d", "h", "lo")]).where("c = 1")
    return alone.select("d", "h", "lo").distinct()


def removed(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with `cuts`, an array of verified repeated runs (lo, n) of the document's words, null where nothing repeats."""
    docs = docs.drop("cuts")
    spark, mark, kept = docs.sparkSession, common.staged_so_far(), common.staging(docs.sparkSession, "spans")
    all_ = common.staged_at(spans(docs, window, k), kept)
    common.release(spark, [kept], mark)
    found = all_.groupBy("d", "h").agg(F.collect_list(F.struct("lo", "n", "k1", "k2")).alias("cuts"))
    found = found.select(F.col("d").alias("__of"), F.col("h").alias("__hash"), "cuts")
    rows = _keyed(docs, *docs.columns)
    whole = common.staging(spark, "cut")
    cut = common.staged_at(rows.join(found, (F.col("__d") == F.col("__of")) & (F.col("__h") == F.col("__hash")), "left").drop("__of", "__hash"), whole)
    common.release(spark, [whole], mark)
    wrong = common.staged(unverified(cut, window), "unverified")
    if not wrong.isEmpty():
        lists = wrong.groupBy(F.col("d").alias("__of"), F.col("h").alias("__hash")).agg(F.collect_list("lo").alias("__wrong"))
        met = cut.join(lists, (F.col("__d") == F.col("__of")) & (F.col("__h") == F.col("__hash")), "left")
        kept = F.filter("cuts", lambda c: c["k1"].isNull() | ~F.array_contains(F.coalesce("__wrong", F.array().cast("array<int>")), c["lo"]))
        cut = met.withColumn("cuts", F.when(F.size(kept) > 0, kept)).drop("__of", "__hash", "__wrong")
    return cut.withColumn("cuts", F.transform("cuts", lambda c: F.struct(c["lo"].alias("lo"), c["n"].alias("n")))).drop("__d", "__h")


def cover(n_words: int, cuts: list[dict] | None, window: int) -> np.ndarray:
    """Mask of the removed words."""
    edges = np.zeros(n_words + 1, np.int64)
    if cuts:
        lo = np.array([c["lo"] for c in cuts])
        np.add.at(edges, lo, 1)
        np.add.at(edges, lo + np.array([c["n"] for c in cuts]) + window - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def strip(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with the repeated words cut out of `text` and n_chars, if there, counted anew. Texts without repeats stay as they are;
    in the others what is kept stands joined by single spaces within a line and keeps its line breaks."""
    cols = list(docs.columns)
    # a column of the name of the result's own waits under another name
    away = {"cuts": "__cuts"} if "cuts" in cols else {}
    out = removed(docs.withColumnsRenamed(away), window, k)
    schema = out.schema

    def cut(text: bytes, cuts: list[dict]) -> str:
        lines, n = [], 0
        mask = cover(len(text.split()), cuts, window)
        for line in text.split(b"\n"):
            words = line.split()
            kept = [w for w, gone in zip(words, mask[n : n + len(words)].tolist(), strict=True) if not gone]
            n += len(words)
            if kept or not words:
                lines.append(b" ".join(kept))
        return b"\n".join(lines).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cuts = batch.column(schema.names.index("cuts")).to_pylist()
            new = pa.array([cut(t.encode(), c) if c else t for t, c in zip(texts, cuts, strict=True)], batch.column(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    done = out.mapInArrow(run, schema).drop("cuts").withColumnsRenamed({b: a for a, b in away.items()})
    if "n_chars" in cols:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*cols)


def digests(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words joined by one space."""
    found = removed(docs.select("doc_id", "text"), window, k)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            for text, cuts in zip(common.encoded(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if cuts:
                    mask = cover(len(words), cuts, window).tolist()
                    words = [w for w, gone in zip(words, mask, strict=True) if not gone]
                n_removed.append(n_words[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.select("doc_id", "text", "cuts").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = rf"""
WITH split_ AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM split_ WHERE len(ws) >= {WINDOW})
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM windows) WHERE c > 1
), gone AS (
  SELECT DISTINCT r, i + j AS k FROM again, range(0, {WINDOW}) AS t(j)
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM split_
), kept AS (
  SELECT r, count(*) FILTER (gone.k IS NOT NULL) AS n_removed, string_agg(w, ' ' ORDER BY k) FILTER (gone.k IS NULL) AS text FROM words LEFT JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM split_ LEFT JOIN kept USING (r)
"""
