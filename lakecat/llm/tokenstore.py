"""Token-id output as a bit-plane shuffled binary store.

Texts are encoded with the tokenizers library, an end id closes each document, and the ids of all documents follow one another
in ascending doc_id order. The store is a folder of part files; each row of a part is one block of `block` ids, transposed
into byte planes (all lowest bytes, then the next ones; or into single bits with planes="bit"), each plane compressed with
zstandard. Beside the planes stands the block's entry of the chunk index: where its ids start in the part, how many they are,
and which documents have how many of them.

Writing goes through Spark's committer, so a lost executor costs a rerun of its tasks and nothing else, and the store can be on
any file system that Spark writes to. Documents reach their part as ids, not as texts, by ranges of doc_id whose bounds come
from approximate quantiles of all rows (a bound per part). An id that holds more rows than a part, null included, is split
over several parts, in the order of its texts' hashes; parts are even by rows, and a task packs its rows block by block.

Encoding looks up repeated pieces of text, and the pre-tokens of new pieces. A piece ends where a space follows a character that is no white space; byte-level
pre-tokenisation always starts a new token there, whatever stands around, so pieces encode alone as in their text.

Defined results: a null text counts as empty and has the end id only; rows with a null doc_id come first; rows with equal ids
stand side by side, ordered by a hash of their text; a text of any length is encoded whole and cut only by the store's blocks
(in one piece where it has no space); an empty table gives an empty store; extra columns, whatever their names, are not stored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK, LEVEL, END = 1 << 16, 3, 0
_BATCH_BYTES, _CACHE = 8 << 20, 1_000_000
#: White space other than the common four, as a class of RE2.
_RARE = r"\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Texts with runs of white space that must not be cut within, with rare white space, or with a space at the end take the careful split.
_HARD = rf"[ \t\r] |[ \r\n\t]\n| [\t\r]|[{_RARE}]| $"
_CUT = re.compile(r"(?<=\S) (?!\n)")


def _careful(text: str) -> list[str]:
    """The keys of a text's pieces, cut before single spaces that follow a character that is no white space."""
    first, *more = _CUT.split(text)
    return ["\t" + first, *("\t " + p if p[:1] in ("\t", "\n") else p for p in more)]


def keys(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """Keys of the pieces of the texts, one after another, and how many each text has.

    A key is a piece without the space it starts with; one that starts with a line end has no such space, and what follows a
    tab is a piece as it stands. Plain texts are cut outside of Python.
    """
    hard = pc.match_substring_regex(texts, _HARD)
    if pc.any(hard).as_py():
        plain = pc.if_else(hard, "", texts)
    else:
        plain = texts
    marked = pc.replace_substring(pc.binary_join_element_wise("", plain, "\t"), "\n", " \n")
    split = pc.split_pattern(marked, " ")
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    flat = split.flatten()
    odd = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
    if len(odd):
        own = [_careful(x) for x in texts.take(pa.array(odd)).to_pylist()]
        # a hard text's place is held by one empty key
        stops, parts, at = np.cumsum(counts), [], 0
        for i, k in zip(odd.tolist(), own, strict=True):
            parts += [flat.slice(at, int(stops[i]) - 1 - at), pa.array(k, flat.type)]
            at = int(stops[i])
        flat = pa.concat_arrays([*parts, flat.slice(at)])
        counts[odd] = [len(k) for k in own]
    return flat, counts


def piece_of(key: str) -> str:
    """The piece of text that a key stands for."""
    return key[1:] if key[:1] == "\t" else key if key[:1] == "\n" else " " + key


#: What the byte-level pre-tokeniser does to text of ASCII and the Latin-1 letters only.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = re.compile(rf"[\x20-\x7E\n{_LATIN}]*").fullmatch
_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+").findall
#: Bytes that byte-level spelling keeps; the others become the characters from U+0100 on, in order.
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELLING = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


def _hashes(strings: pa.StringArray) -> np.ndarray:
    offsets = np.frombuffer(strings.buffers()[1], np.int32, count=strings.offset + len(strings) + 1)[strings.offset :].astype(np.int64)
    data = strings.buffers()[2]
    return common.byte_hashes(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], offsets[1:])


class Table:
    """Ids of strings; remembers those of up to `limit` strings, of the most frequent ones when there are more.

    `learn` gives the ids of strings that are new, one after another, and how many each has. The strings are held in one buffer
    and looked up by sorted hashes, so that a million of them take some tens of megabytes and no Python object each. What
    a hash finds is compared with the string itself.
    """

    def __init__(self, learn: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]], limit: int):
        self.learn, self.limit = learn, limit
        self.strings = pa.array([], pa.string())
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.begin, self.seen = common.Growing(np.uint32), common.Growing(np.int64, [0]), common.Growing(np.int64)

    def _trim(self) -> None:
        """Forget all but the most frequent half of what may be held."""
        keep = np.sort(np.argsort(-self.seen.all, kind="stable")[: min(self.limit, len(self.strings)) // 2])
        sizes = np.diff(self.begin.all)[keep]
        self.flat = common.Growing(np.uint32, self._gather(keep, sizes))
        self.begin = common.Growing(np.int64, np.concatenate([[0], np.cumsum(sizes)]))
        self.seen, self.strings = common.Growing(np.int64, self.seen.all[keep]), self.strings.take(pa.array(keep))
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._index(_hashes(self.strings), np.arange(len(keep)))

    def _index(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        hashes, slots = hashes[order], slots[order]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, slots)

    def _find(self, strings: pa.StringArray, hashes: np.ndarray) -> np.ndarray:
        """Slots of the strings, -1 for those that are not held."""
        if not len(self.hashes):
            return np.full(len(strings), -1)
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
        slot = self.slots[at]
        some = np.flatnonzero(self.hashes[at] == hashes)
        same = pc.equal(strings.take(pa.array(some)), self.strings.take(pa.array(slot[some]))).to_numpy(zero_copy_only=False)
        out = np.full(len(strings), -1)
        out[some[same]] = slot[some[same]]
        return out

    def _gather(self, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        stops = np.cumsum(sizes)
        at = np.repeat(self.begin.all[slots] - (stops - sizes), sizes)
        at += np.arange(len(at))
        return self.flat.all[at]

    def ids(self, strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings one after another, and how many each has."""
        if len(self.strings) > self.limit or self.strings.nbytes > 64 * self.limit + _BATCH_BYTES:
            self._trim()
        told = pc.dictionary_encode(strings)
        hashes = _hashes(told.dictionary)
        slot = self._find(told.dictionary, hashes)
        new = slot < 0
        if new.any():
            fresh = told.dictionary.filter(pa.array(new))
            slot[new] = len(self.strings) + np.arange(len(fresh))
            flat, counts = self.learn(fresh)
            self.begin.add(self.begin.all[-1] + np.cumsum(counts))
            self.flat.add(flat)
            self.seen.add(np.zeros(len(fresh), np.int64))
            self._index(hashes[new], slot[new])
            self.strings = pa.concat_arrays([self.strings, fresh])
        own = told.indices.to_numpy()
        self.seen.all[slot] += np.bincount(own, minlength=len(slot))
        sizes = np.diff(self.begin.all)[slot][own]
        return self._gather(slot[own], sizes), sizes


class Encoder:
    """Ids of texts; remembers up to `cache` pieces and as many pre-tokens.

    It reads files whose pre-tokeniser is the byte-level one with its own pattern, without normaliser and post-processor; another
    file is refused.
    """

    def __init__(self, path: str, cache: int = _CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["post_processor"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("a BPE file with the byte-level pre-tokeniser, without normaliser and post-processor is asked for")
        if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special strings that hold a space, take space beside them or are normalised are not read")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.pieces, self.words = Table(self._of_pieces, cache), Table(self._of_words, cache)

    def _of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """By the library's model, of pre-tokens in byte-level spelling."""
        tokenize, out = self.tokenizer.model.tokenize, []
        counts = np.empty(len(words), np.int64)
        for i, word in enumerate(words.to_pylist()):
            if word.isascii() and "\n" not in word:
                spelt = word.replace(" ", "\u0120")
            else:
                spelt = word.encode().decode("latin-1").translate(_SPELLING)
            own = [t.id for t in tokenize(spelt)]
            counts[i] = len(own)
            out += own
        return np.array(out, np.uint32), counts

    def _of_pieces(self, keys: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Plain Latin text is cut into pre-tokens here and goes to the library's model, other text through all of the library."""
        plain: list[list[str]] = []
        other: dict[int, list[int]] = {}
        for i, piece in enumerate(map(piece_of, keys.to_pylist())):
            if _SAFE(piece) and not self.special(piece):
                plain.append(_TOKENS(piece))
            else:
                plain.append([])
                other[i] = self.tokenizer.encode(piece, add_special_tokens=False).ids
        flat, sizes = self.words.ids(pa.array(chain.from_iterable(plain), pa.string()))
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends], prepend=0)
        if other:
            at = np.cumsum(counts)[list(other)]
            flat = np.insert(flat, np.repeat(at, list(map(len, other.values()))), np.fromiter(chain.from_iterable(other.values()), np.uint32))
            counts[list(other)] = list(map(len, other.values()))
        return flat, counts

    def encode(self, texts: pa.StringArray | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. Only pieces and pre-tokens that are new are Python's work."""
        flat, pieces = keys(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        ids, sizes = self.pieces.ids(flat)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(pieces)], prepend=0)


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(path)


def planes_of(ids: np.ndarray, width: int, kind: str, level: int = LEVEL) -> list[bytes]:
    """Compressed planes of a block of ids of `width` bytes each."""
    import zstandard

    raw = np.ascontiguousarray(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    if kind == "bit":
        raw = np.concatenate([np.packbits(np.unpackbits(p[:, None], axis=1), axis=0, bitorder="little").T for p in raw])
    compress = zstandard.ZstdCompressor(level=level).compress
    return [compress(p.tobytes()) for p in raw]


def ids_of(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    """The inverse of planes_of, as unsigned 32-bit ids."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    raw = np.stack([np.frombuffer(expand(p), np.uint8) for p in planes]) if n else np.zeros((len(planes), 0), np.uint8)
    if kind == "bit":
        bits = np.unpackbits(raw, axis=1, count=n, bitorder="little").reshape(width, 8, n)
        raw = np.packbits(bits, axis=1).reshape(width, n)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").reshape(-1).astype(np.uint32)


_STORE = "part int, chunk int, first long, n int, width int, kind string, planes array<binary>, docs array<struct<ord: long, doc_id: long, n: int>>"


_FIRST = np.iinfo(np.int64).min


class Bounds:
    """Upper bounds (doc_id, hash of the text) of the store's parts, in ascending order; the last part has none.

    They are quantiles of all rows. An id that is found more than once among them holds more than a part's rows: its bounds come
    from quantiles of its texts' hashes. A text that is found more than once even so is dealt over its parts row by row: its
    rows are equal, so their order makes no difference.
    """

    def __init__(self, ids: np.ndarray, hashes: np.ndarray):
        self.ids, self.hashes = ids, hashes

    @classmethod
    def of(cls, rows: DataFrame, parts: int) -> Bounds:
        cut = lambda col, n: F.percentile_approx(col, [i / n for i in range(1, n)], 100 * n)
        found = rows.select(cut("__id", parts).alias("q")).first()["q"] if parts > 1 else []
        ids, times = np.unique(np.array(found or [], np.int64), return_counts=True)
        bounds = [(int(i), np.iinfo(np.int64).max) for i, n in zip(ids, times, strict=True) if n == 1]
        hot = {int(i): int(n) for i, n in zip(ids, times, strict=True) if n > 1}
        if hot:  # at most half as many ids as there are parts
            most = max(hot.values())
            for row in rows.where(F.col("__id").isin(list(hot))).groupBy("__id").agg(cut("__h", 4 * most).alias("q")).collect():
                n = hot[row["__id"]]
                bounds += [(row["__id"], np.iinfo(np.int64).max), *((row["__id"], row["q"][len(row["q"]) * k // n]) for k in range(1, n))]
        bounds.sort()
        return cls(np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64))

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, ids: np.ndarray, hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The part of each row."""
        if not len(self):
            return np.zeros(len(ids), np.int32)
        pair = np.dtype([("i", "<i8"), ("h", "<i8")])
        bounds, rows = np.empty(len(self), pair), np.empty(len(ids), pair)
        bounds["i"], bounds["h"], rows["i"], rows["h"] = self.ids, self.hashes, ids, hashes
        # the rank of each pair among all of them orders pairs by plain numbers
        _, rank = np.unique(np.concatenate([bounds, rows]), return_inverse=True)
        own, at = rank[len(self) :], rank[: len(self)]
        lo, hi = np.searchsorted(at, own, "left"), np.searchsorted(at, own, "right")
        return (lo + salt % np.maximum(hi - lo, 1)).astype(np.int32)


def encode(docs: DataFrame, tokenizer: str, end: int | None = END) -> DataFrame:
    """doc_id and `ids`, little-endian unsigned integers of `width` bytes, 2 where all ids fit, else 4."""
    return _encode(_rows(docs), tokenizer, end, Bounds(np.zeros(0, np.int64), np.zeros(0, np.int64))).select("doc_id", "ids", "width")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text, and what orders and deals the rows: the id with null as the least number, a hash of the text, the row's number.

    The hash has 53 bits, which quantiles keep exactly.
    """
    id_ = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    return docs.select(id_.alias("doc_id"), text.alias("text"), F.coalesce(id_, F.lit(int(_FIRST))).alias("__id"), F.shiftright(F.xxhash64(text), 11).alias("__h"), F.monotonically_increasing_id().alias("__salt"))


def _encode(rows: DataFrame, tokenizer: str, end: int | None, bounds: Bounds) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        kind = "<u2" if encoder.vocab <= 1 << 16 and (end or 0) < 1 << 16 else "<u4"
        width = np.dtype(kind).itemsize
        for batch in batches:
            for part in common.blocks(batch, _BATCH_BYTES):
                ids, counts = encoder.encode(part.column(1))
                stops = np.cumsum(counts)
                if end is not None:
                    ids = np.insert(ids, stops, end)
                    stops = stops + np.arange(1, len(stops) + 1)
                data = ids.astype(kind).tobytes()
                offsets = np.concatenate([[0], stops * width]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
                to = bounds.part(*(part.column(c).to_numpy() for c in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([part.column(0), blob, pa.array(np.full(len(counts), width, np.int32)), part.column(3), pa.array(to)], names=["doc_id", "ids", "width", "h", "to"])
        ids = blob = data = None
        common.give_back()

    return rows.mapInArrow(run, "doc_id long, ids binary, width int, h long, to int")


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, block: int = BLOCK, kind: str = "byte", level: int = LEVEL) -> None:
    """Write the store of docs (doc_id, text) to path."""
    rows = _rows(docs)
    bounds = Bounds.of(rows, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, first, ord_ = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        docs_held: list[dict] = []
        have, width = 0, 4

        def flush() -> dict:
            nonlocal chunk, first, have
            ids = np.concatenate(held)
            row = {"part": part, "chunk": chunk, "first": first, "n": len(ids), "width": width, "kind": kind, "planes": planes_of(ids, width, kind, level), "docs": list(docs_held)}
            chunk, first, have = chunk + 1, first + len(ids), 0
            held.clear()
            docs_held.clear()
            return row

        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(pa.struct([("ord", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32())])))])
        rows = []
        for batch in batches:
            for doc_id, data, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):  # noqa: B007
                ids = np.frombuffer(data, f"<u{width}")
                at = 0
                while True:
                    take = min(len(ids) - at, block - have)
                    held.append(ids[at : at + take])
                    docs_held.append({"ord": ord_, "doc_id": doc_id, "n": take})
                    at, have = at + take, have + take
                    if have == block:
                        rows.append(flush())
                    if at == len(ids):
                        break
                ord_ += 1
                if len(rows) >= 16:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if held:
            rows.append(flush())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = _encode(rows, tokenizer, end, bounds).repartitionById(len(bounds) + 1, F.col("to")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "ids")
    # planes are compressed already
    dealt.select("doc_id", "ids", "width").mapInArrow(pack, _STORE).write.option("compression", "none").parquet(path)


def bases(spark: SparkSession, path: str) -> DataFrame:
    """part, base: how many ids all earlier parts hold. One row per part file."""
    parts = spark.read.schema(_STORE).parquet(path).groupBy("part").agg(F.sum("n").alias("own"))
    before = F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """(part, ord, doc_id, start, n of each document's share of a block; its ids one after another; where the shares end)."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = ids_of(row["planes"], row["n"], row["width"], row["kind"])
            sizes = np.array([d["n"] for d in row["docs"]], np.int64)
            stops = np.cumsum(sizes)
            columns = [np.full(len(sizes), row["part"], np.int32), pa.array([d["ord"] for d in row["docs"]], pa.int64()), pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), row["first"] + stops - sizes, sizes]
            yield [pa.array(c) for c in columns], ids, stops


_SHARE = ["part", "ord", "doc_id", "start", "n"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, ord, doc_id, start (in the part), n and `ids` (little-endian unsigned 32-bit) of each document's share of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids, stops in _shares(batches):
            offsets = np.concatenate([[0], stops * 4]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([*columns, blob], names=[*_SHARE, "ids"])

    return spark.read.schema(_STORE).parquet(path).mapInArrow(run, "part int, ord long, doc_id long, start long, n long, ids binary")


def crc32_combine(a: int, b: int, size_b: int) -> int:
    """crc32 of two byte strings joined, from the crc32 of each and the size of the second."""
    rows = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    bits = size_b * 8
    while bits:
        if bits & 1:
            a = times(rows, a)
        rows = [times(rows, x) for x in rows]
        bits >>= 1
    return a ^ b


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids, stops in _shares(batches):
            out = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.int64())], names=[*_SHARE, "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shares in batch.column(4).to_pylist():
                shares.sort(key=lambda x: x["start"])
                value = shares[0]["crc"]
                for x in shares[1:]:
                    value = crc32_combine(value, x["crc"], 4 * x["n"])
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int64())], names=[*batch.schema.names[:4], "ids_crc32"])

    shares = spark.read.schema(_STORE).parquet(path).mapInArrow(crc, "part int, ord long, doc_id long, start long, n long, crc long")
    # a document has a share in each block that it reaches into; one in most cases
    whole = shares.groupBy("part", "ord").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("start", "n", "crc")).alias("shares"))
    done = whole.select("part", "doc_id", "start", "n_tokens", "shares").mapInArrow(join, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # one row per part file, and there are no more part files than shuffle partitions
    return done.join(F.broadcast(bases(spark, path)), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.staging(spark, "tokens")
    write(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)
