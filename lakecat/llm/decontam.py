"""Benchmark decontamination by latent semantic retrieval.

1. Every text becomes its sequence of terms (lower-case runs of letters and digits), as numbers of the benchmark's vocabulary;
   terms that no item holds share one number. They would add nothing to an inner product with an item.
2. Passages of `length` terms, one after another in every document, give document frequencies and the TF-IDF matrix.
3. One pass of a randomised SVD over all passages: each task adds up A'(A G) for its passages and a fixed random G (terms x rank
   plus oversampling), the sums are added up in the shared shuffle, and the driver solves the small eigenproblem. A term weighs
   by how far its IDF is above that of a term in a share COMMON of all passages; what is more frequent weighs nothing.
4. Candidates for an item are all windows, little longer than the item, that hold as many terms of it as a paraphrase needs. Terms in
   order are terms held, so this is a bound and loses none, whatever the item's length. There is no limit on candidates.
5. Candidates are verified by the longest common subsequence of the item and the window: a share of `same` of the item's terms is a
   copy; a share of `alike` is a paraphrase if the item's answer, its last `answer` terms, is found in order to the same share and the
   window holds most of the item's IDF mass. One window that passes is enough.
6. The cosine of item and passages in the latent space is reported for what was found; it excludes nothing. That of an item
   much longer than a passage is low by nature.

The benchmark is the stated query set. It is worked on in groups of items of at most VOCABULARY distinct terms (one item at least),
each with its own vocabulary and latent space: so what goes to every task, and what comes back to the driver (terms x
RANK + OVERSAMPLE numbers), is bounded by VOCABULARY, whatever the sizes of benchmark and corpus.

Defined results: a null text has no terms; a text shorter than a passage is one passage; texts of any length are searched whole, their
blocks and candidates in steps of bounded size; items without terms match nothing; repeated items match alike, each under its own id; repeated rows
and null ids are documents like others (`matches` has one row for each id and item, `clean` tells rows of an id apart by their
texts); an empty benchmark or corpus gives no row; extra columns, whatever their names, are not read by `matches` and pass through `clean`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, STRIDE, RANK, OVERSAMPLE = 24, 8, 64, 8
#: Terms in more than this share of all passages weigh nothing in the latent space, unless an item has fewer than FEW other terms.
COMMON, FEW = 0.05, 4
#: Distinct terms of the items that are searched for at a time.
VOCABULARY = 100_000
SAME, ALIKE, ANSWER, MASS, SLACK = 0.85, 0.65, 6, 0.7, 1.3
#: Windows that start in the same BLOCK terms are candidates together; items of a group and cells of a matrix bound memory.
BLOCK, _ITEMS, _CELLS = 8, 256, 1 << 18
_SEED, _BLOCK_BYTES, _TERMS = 5, 4 << 20, 1 << 20

_TABLE = np.zeros(256, bool)
_TABLE[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(0x80, 256)]] = True


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of each text, one after another, and how many each text has."""
    data = [x.lower().encode() for x in texts]
    buffer = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    inside = _TABLE[buffer]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    hashes = common.byte_hashes(buffer, starts, ends)
    of = np.searchsorted(np.cumsum([len(x) + 1 for x in data]), starts, "right")
    return hashes, np.bincount(of, minlength=len(texts))


class Benchmark:
    """Vocabulary and term sequences of the items; small by nature, it goes to every task."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        hashes, counts = terms([t or "" for _, t in items])
        self.vocabulary = np.unique(hashes)
        ends = np.cumsum(counts)
        known = np.searchsorted(self.vocabulary, hashes)
        self.items = [known[e - c : e] for e, c in zip(ends, counts, strict=True)]
        self.size = len(self.vocabulary)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms; `size` for those that no item holds."""
        if not self.size:
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), self.size - 1)
        return np.where(self.vocabulary[at] == hashes, at, self.size).astype(np.int32)

    def vectors(self, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Unit vectors of the items in the latent space."""
        raw = np.stack([np.bincount(t, minlength=self.size) * idf for t in self.items]) @ basis if self.items else np.zeros((0, basis.shape[1]))
        return unit(raw.astype(np.float32))


def weights(bench: Benchmark, df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """IDF of each term, and its weight in the latent space."""
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    weight = np.maximum(idf + np.float32(np.log(COMMON)), 0)
    for item in bench.items:
        if len(np.unique(item[weight[item] > 0])) < FEW:
            weight[item] = np.maximum(weight[item], idf[item])
    return idf, weight


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def passages(counts: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the passages of texts of so many terms that stand one after another; a text's last one may be shorter."""
    begin = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(-(-(counts - length) // stride), 0) + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * stride
    return text, begin[text] + start, begin[text] + np.minimum(start + length, counts[text])


def _sums(numbers: np.ndarray, used: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of rows[number] over each passage, of the numbers that are `used`; starts ascend.

    Passages overlap, so the terms between neighbouring borders are added up once and the passages from these.
    """
    if not len(start):
        return np.zeros((0, rows.shape[1]), np.float32)
    border = np.unique(np.concatenate([start, end]))
    kept = np.flatnonzero(used[numbers[border[0] : border[-1]]]) + border[0]
    at = np.searchsorted(kept, border)
    own = np.concatenate([rows[numbers[kept]], np.zeros((1, rows.shape[1]), rows.dtype)])
    part = np.add.reduceat(own, at, axis=0)[:-1]
    part[np.diff(at) == 0] = 0
    lo, hi = np.searchsorted(border, start), np.searchsorted(border, end)
    total = part[lo]
    for k in range(1, int((hi - lo).max())):
        more = lo + k < hi
        total[more] += part[lo[more] + k]
    return total


def lcs(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of the item and each row of windows (-1 pads), bit-parallel over all rows."""
    limbs = -(-len(item) // 64)
    distinct, at = np.unique(item, return_inverse=True)
    mask = np.zeros((len(distinct) + 1, limbs), np.uint64)
    place = np.arange(len(item))
    np.bitwise_or.at(mask, (at, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    code = np.minimum(np.searchsorted(distinct, windows), len(distinct) - 1)
    code = np.where(distinct[code] == windows, code, len(distinct))
    state = np.full((len(windows), limbs), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(windows.shape[1]):
        m = mask[code[:, j]]
        carry = np.zeros(len(windows), np.uint64)
        for k in range(limbs):
            v = state[:, k]
            u = v & m[:, k]
            s = v + u
            over = s < v
            t = s + carry
            carry = (over | (t < s)).astype(np.uint64)
            state[:, k] = t | (v & ~m[:, k])
    zeros = np.bitwise_count(~state).sum(axis=1)
    spare = 64 * limbs - len(item)  # carries may clear bits past the item's end
    if spare:
        zeros -= np.bitwise_count(~state[:, -1] >> np.uint64(64 - spare))
    return zeros.astype(np.int64)


def grid(counts: np.ndarray, numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the texts, each text padded with `size` to whole blocks of BLOCK terms: (blocks, text of each block, first block of each text)."""
    n = -(-counts // BLOCK)
    first = np.cumsum(n) - n
    out = np.full(int(n.sum()) * BLOCK, size, np.int32)
    out[np.repeat(first * BLOCK - (np.cumsum(counts) - counts), counts) + np.arange(len(numbers))] = numbers
    return out.reshape(-1, BLOCK), np.repeat(np.arange(len(counts)), n), first


def width(item: np.ndarray) -> int:
    """Terms of the windows that are compared with the item."""
    return int(np.ceil(SLACK * len(item)))


def needed(item: np.ndarray) -> int:
    """The fewest terms in order that are a share of ALIKE of the item."""
    n = len(item)
    return next(k for k in range(max(int(ALIKE * n) - 1, 1), n + 1) if k / n >= ALIKE)


def candidates(bench: Benchmark, blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, blocks in which a window may start that holds the item in order to a share of ALIKE).

    Terms in order are terms of the item, so a window that is alike has at least as many positions with a term of the item. These
    are counted over the blocks that windows from a block reach: no window that is alike is lost, whatever the item's length.
    """
    order = sorted((i for i, t in enumerate(bench.items) if len(t)), key=lambda i: len(bench.items[i]))
    for g in range(0, len(order), _ITEMS):
        group = order[g : g + _ITEMS]
        member = np.zeros((bench.size + 1, len(group)), np.uint8)
        for k, i in enumerate(group):
            member[bench.items[i], k] = 1
        need = np.array([needed(bench.items[i]) for i in group], np.int32)
        reach = np.array([(width(bench.items[i]) + BLOCK - 2) // BLOCK + 1 for i in group])
        borders = [*np.flatnonzero(np.diff(reach, prepend=-1)).tolist(), len(group)]
        far = int(reach.max())
        step = max(8192, far)
        found: list[list[np.ndarray]] = [[] for _ in group]
        for a in range(0, len(blocks), step):
            part = blocks[a : a + step + far]
            held = member[part[:, 0]]
            for k in range(1, BLOCK):
                held += member[part[:, k]]
            n = min(step, len(blocks) - a)
            total = np.zeros((n + far + 1, len(group)), np.int32)
            np.cumsum(held, axis=0, dtype=np.int32, out=total[1 : len(held) + 1])
            total[len(held) + 1 :] = total[len(held)]
            for lo, hi in zip(borders, borders[1:]):
                r = int(reach[lo])
                k, at = np.nonzero((total[r : r + n, lo:hi] - total[:n, lo:hi] >= need[lo:hi]).T)
                cut = np.searchsorted(k, np.arange(hi - lo + 1))
                for j in range(hi - lo):
                    if cut[j] < cut[j + 1]:
                        found[lo + j].append(at[cut[j] : cut[j + 1]] + a)
        for k, i in enumerate(group):
            if found[k]:
                yield i, np.concatenate(found[k])


def verified(item: np.ndarray, idf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(does it hold a copy or a paraphrase, share of the item's terms in order) for the item and each row of terms."""
    n = len(item)
    share = lcs(item, rows) / n
    ok = share >= SAME
    some = np.flatnonzero(~ok & (share >= ALIKE))
    if len(some):
        answer, weight = item[-ANSWER:], idf[item]
        some = some[lcs(answer, rows[some]) / len(answer) >= ALIKE]
        for k in some.tolist():
            ok[k] = weight[np.isin(item, rows[k])].sum() >= MASS * weight.sum()
    return ok, share


def found_in(bench: Benchmark, idf: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, share, start in the text) of all windows that hold an item, but for those that start at neighbouring terms of the same block."""
    blocks, text, first = grid(counts, numbers, bench.size)
    flat, ends = blocks.reshape(-1), first * BLOCK + counts
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    for i, at in candidates(bench, blocks):
        item, w, need = bench.items[i], width(bench.items[i]), needed(bench.items[i])

        def terms_from(start: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
            place = start[:, None] + np.arange(n)
            return np.where(place < ends[of][:, None], flat[np.minimum(place, len(flat) - 1)], -1)

        # what the windows from a block reach bounds each of them from above: most candidates end here
        reach = w + BLOCK - 1
        rows = max(_CELLS // reach, 1)
        at = np.concatenate([x[lcs(item, terms_from(x * BLOCK, reach, text[x])) >= need] for x in (at[a : a + rows] for a in range(0, len(at), rows))])
        rows = max(rows // BLOCK, 1)
        for a in range(0, len(at), rows):
            x = at[a : a + rows]
            start = (x[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            ok, share = verified(item, idf, terms_from(start, w, np.repeat(text[x], BLOCK)))
            share = np.where(ok, share, -1).reshape(-1, BLOCK)
            best = share.argmax(axis=1)
            good = share.max(axis=1) >= 0
            x, best, share = x[good], best[good], share.max(axis=1)[good]
            out.append((text[x], np.full(len(x), i), share, (x - first[text[x]]) * BLOCK + best))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cosines(bench: Benchmark, rows: np.ndarray, targets: np.ndarray, numbers: np.ndarray, counts: np.ndarray, found: tuple[np.ndarray, ...], length: int, stride: int) -> np.ndarray:
    """For each window found, the highest cosine of its item with a passage that starts in it, or with the one around its start."""
    text, item, _, at = found
    wide = np.array([width(t) for t in bench.items])[item]
    last = np.maximum(-(-(counts - length) // stride), 0)[text]
    lo = np.minimum(at // stride, last)
    n = np.minimum((at + wide - 1) // stride, last) - lo + 1
    window = np.repeat(np.arange(len(n)), n)
    begin = (np.cumsum(counts) - counts)[text[window]]
    start = (lo[window] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * stride
    rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
    out = np.full(len(n), -1.0)
    for a in range(0, len(window), 1024):
        part = slice(a, a + 1024)
        place = start[part, None] + np.arange(length)
        inside = place < counts[text[window[part]]][:, None]
        term = np.where(inside, numbers[np.minimum(begin[part, None] + place, len(numbers) - 1)], bench.size)
        cosine = (unit(rows[term].sum(axis=1)) * targets[item[window[part]]]).sum(axis=1)
        np.maximum.at(out, window[part], cosine)
    return out


def sequences(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """doc_id, a hash of the text, and `terms`, little-endian 32-bit numbers of the text's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, _BLOCK_BYTES):
                hashes, counts = terms([x or "" for x in part.column(1).to_pylist()])
                numbers = benchmark.number(hashes)
                offsets = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(numbers.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), blob], names=["doc_id", "hash", "terms"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, hash long, terms binary")


def _numbers(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their term numbers one after another, how many each has) in blocks of bounded size."""
    for part in common.blocks(batch, 4 * _TERMS, "terms"):
        data = part.column(part.schema.get_field_index("terms"))
        offsets = np.frombuffer(data.buffers()[1], np.int32, count=data.offset + len(data) + 1)[data.offset :].astype(np.int64)
        whole = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        yield part, np.frombuffer(whole.tobytes(), np.int32), np.diff(offsets) // 4


def frequencies(seqs: DataFrame, size: int, length: int) -> tuple[np.ndarray, int]:
    """In how many passages each term is, and the number of passages, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, numbers, counts in _numbers(batch):
                _, start, end = passages(counts, length, length)
                place = np.repeat(np.arange(len(start)), end - start)
                kept = numbers < size
                key = np.unique(place[kept] * (size + 1) + numbers[kept])
                total += np.bincount(key % (size + 1), minlength=size)[:size]
                n += len(start)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["term", "n"])

    rows = seqs.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(size, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def basis_of(seqs: DataFrame, idf: np.ndarray, length: int, rank: int, oversample: int = OVERSAMPLE) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix of all passages, by a one-pass randomised SVD."""
    size = len(idf)
    width = min(rank + oversample, size)
    G = np.random.default_rng(_SEED).normal(size=(size, width)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = G * idf[:, None].astype(np.float32)
        used = np.append(idf > 0, False)
        total = np.zeros((size, width))
        for batch in batches:
            for _, numbers, counts in _numbers(batch):
                _, start, end = passages(counts, length, length)
                y = np.concatenate([_sums(numbers, used, weighted, start[a : a + 2048], end[a : a + 2048]) for a in range(0, len(start), 2048)] or [np.zeros((0, width), np.float32)])
                # A'y: each term's sum of its passages' rows; these passages cut the texts without overlap
                at = np.flatnonzero(used[numbers])
                of, term = np.repeat(np.arange(len(start)), end - start)[at], numbers[at]
                order = np.argsort(term, kind="stable")
                term, of = term[order], of[order]
                cut = len(term)
                if cut:
                    first = np.flatnonzero(np.diff(term, prepend=-1))
                    for a in range(0, len(first), 256):
                        lo, hi = first[a], first[a + 256] if a + 256 < len(first) else cut
                        total[term[first[a : a + 256]]] += np.add.reduceat(y[of[lo:hi]], first[a : a + 256] - lo, axis=0)
        total *= idf[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * width)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["z"])

    Z = np.zeros(size * width)
    for row in seqs.select("terms").mapInArrow(run, "z binary").repartition(8).mapInArrow(add, "z binary").toLocalIterator():
        Z += np.frombuffer(row["z"])
    Z = Z.reshape(size, width)
    Q, _ = np.linalg.qr(Z)
    # Z = (A'A) G and A'A is about Q T Q', so T solves T (Q'G) = Q'Z
    T = np.linalg.lstsq((Q.T @ G).T, (Q.T @ Z).T, rcond=None)[0].T
    values, vectors = np.linalg.eigh((T + T.T) / 2)
    return (Q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def groups(items: Iterable[tuple[int, str]], most: int = VOCABULARY) -> Iterator[Benchmark]:
    """The items in groups of at most `most` distinct terms."""
    held: list[tuple[int, str]] = []
    known: set[int] = set()
    for item in items:
        own = set(terms([item[1] or ""])[0].tolist())
        if held and len(known | own) > most:
            yield Benchmark(held)
            held, known = [], set()
        held.append(item)
        known |= own
    if held:
        yield Benchmark(held)


def _found(docs: DataFrame, benchmark: DataFrame, length: int, stride: int, rank: int) -> DataFrame:
    """doc_id, hash (of the text), item_id, share and cosine of all windows found."""
    items = ((r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator())
    each = [_found_of(docs, bench, length, stride, rank) for bench in groups(items) if bench.size]
    if not each:
        return docs.sparkSession.createDataFrame([], _FOUND)
    return functools.reduce(DataFrame.unionByName, each)


_FOUND = "doc_id long, hash long, item_id long, share double, cosine double"


def _found_of(docs: DataFrame, bench: Benchmark, length: int, stride: int, rank: int) -> DataFrame:
    seqs = common.staged(sequences(docs, bench), "terms")
    df, n = frequencies(seqs, bench.size, length)
    idf, weight = weights(bench, df, n)
    basis = basis_of(seqs, weight, length, rank)
    targets = bench.vectors(weight, basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = basis * weight[:, None]
        for batch in batches:
            for part, numbers, counts in _numbers(batch):
                found = found_in(bench, idf, numbers, counts)
                if len(found[0]):
                    text, item, share, _ = found
                    cosine = cosines(bench, rows, targets, numbers, counts, found, length, stride)
                    take = pa.array(text, pa.int64())
                    columns = [part.column(0).take(take), part.column(1).take(take), pa.array([bench.ids[x] for x in item], pa.int64()), pa.array(share, pa.float64()), pa.array(cosine, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "item_id", "share", "cosine"])

    return seqs.mapInArrow(run, _FOUND)


def matches(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, stride: int = STRIDE, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, share (of the item's terms, in order) and cosine: one row for each document and item that it holds."""
    found = _found(docs, benchmark, length, stride, rank)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("cosine").alias("cosine"))


def clean(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, stride: int = STRIDE, rank: int = RANK) -> DataFrame:
    """docs without those that hold an item. Rows of the same id, null included, are told apart by their texts."""
    bad = _found(docs, benchmark, length, stride, rank).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("__hash")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"), F.round("cosine", 4).alias("cosine"))
