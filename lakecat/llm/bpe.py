"""BPE encoding and decoding with a pair occurrence index.

Encoding works on the distinct words of a block of texts at once. Their symbols stand in one array; an index maps each active
merge rank to all positions of its pair. Ranks are applied in ascending order, each to all its positions, and the
neighbours of what was merged move to the lists of their new pairs. A merge makes only pairs of higher rank, because the
symbol it makes did not exist before, so a rank is done once it was applied.

Normalisation and pre-tokenisation are those of the tokenizer file; ids equal those of the tokenizers library without special
tokens, truncation and padding. Text is cut at spaces first and equal pieces are handled once: no token and no special string
of the file holds a space. The decoder joins the tokens' strings by single spaces, as the library does for a file without a
decoder.

Defined results: null text counts as empty and has no ids; special strings inside a text are found as the library finds them;
repeated rows are encoded alike; null ids pass through; texts of any length are encoded whole, those that Arrow brings in one batch in
blocks of some megabytes; an empty table gives an empty result; extra columns pass through `encode`, but for those of the names of
its results, which it replaces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_BATCH_BYTES, _CACHE = 4 << 20, 150_000
_NONE = np.iinfo(np.int32).max


class Merges:
    """A vocabulary's merge table: ranks of symbol pairs, and the words' encoder over an occurrence index."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        # the merged string: the left one cannot carry the end mark
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where there is no merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.order[at], _NONE).astype(np.int32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has. A symbol that is not in the vocabulary is left out."""
        get, suffix = self.vocab.get, self.suffix
        ids = [[i for i in (get(c) for c in (*w[:-1], w[-1] + suffix)) if i is not None] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        # a -1 closes each word
        symbols = np.fromiter(chain.from_iterable((*i, -1) for i in ids), np.int32, int(sizes.sum()) + len(ids))
        self._merge(symbols)
        word = np.repeat(np.arange(len(ids)), sizes + 1)
        kept = symbols >= 0
        return symbols[kept].astype(np.uint32), np.bincount(word[kept], minlength=len(ids))

    def _merge(self, sym: np.ndarray) -> None:
        """Apply all merges in place; symbols that went are -2."""
        n = len(sym)
        if n < 2:
            return
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n, _NONE, np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, of: np.ndarray) -> None:
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            begin = [0, *cuts.tolist()]
            for r, a, b in zip(of[begin].tolist(), begin, [*begin[1:], len(at)], strict=True):
                held = index.get(r)
                if held is None:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)
                else:
                    held.append(at[a:b])

        active = np.flatnonzero(rank != _NONE).astype(np.int32)
        if len(active):
            add(active, rank[active])
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[rank[at] == r]
            if len(held) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            after = nxt[at]
            if len(at) > 1 and sym[at[0]] == sym[after[0]]:  # a pair of equal symbols: every other one of a run
                run = np.concatenate([[False], at[1:] == after[:-1]])
                place = np.arange(len(at))
                first = np.maximum.accumulate(np.where(run, 0, place))
                odd = (place - first) % 2 == 1
                at, after = at[~odd], after[~odd]
            beyond = nxt[after]
            sym[at] = self.made[r]
            sym[after] = -2
            rank[after] = _NONE
            nxt[at] = beyond
            prv[beyond] = at  # a word's end mark follows its last symbol, so there is always one
            before = prv[at]
            before = before[before >= 0]
            touched = np.concatenate([at, before])
            own, right = sym[touched], sym[nxt[touched]]
            new = self.ranks(own, right)
            rank[touched] = new
            keep = new != _NONE
            if keep.any():
                add(touched[keep], new[keep])


class Codec:
    """A tokenizer file read for encoding by Merges: pieces of text to ids and to the decoded bytes."""

    def __init__(self, path: str, cache: int = _CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("a BPE file without decoder and post-processor is asked for")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(" " in s for s in self.special):
            raise ValueError("a special string holds a space")
        self.found = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.string = {i: t.encode() for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.slot = common.Slots([""])
        self.text: list[bytes] = [b""]
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def words(self, piece: str) -> list[str | int]:
        """The piece's words in byte-level spelling; special strings as their ids."""
        if self.found and "<|" in piece and (parts := self.found.split(piece))[1:]:
            return [w for p in parts for w in ([self.special[p]] if p in self.special else self.words(p))]
        if piece.isascii() and piece.isprintable():
            return self.plain(piece.lower())  # printable ASCII is its own byte-level spelling
        return [w for w, _ in self.split(self.normalize(piece))]

    def _learn(self, new: list[str]) -> None:
        of = [self.words(p) for p in new]
        distinct = list(dict.fromkeys(w for ws in of for w in ws if isinstance(w, str)))
        ids, sizes = self.merges.encode(distinct)
        stops = np.cumsum(sizes).tolist()
        ids = ids.tolist()
        known: dict[str | int, list[int]] = {w: ids[b - n : b] for w, n, b in zip(distinct, sizes.tolist(), stops, strict=True)}
        known.update((i, [i]) for i in self.special.values())
        string = self.string
        flat, counts = [], []
        for ws in of:
            own = [i for w in ws for i in known[w]]
            counts.append(len(own))
            flat += own
            self.text.append(b" ".join([string[i] for i in own]))
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.array(counts, np.int64))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """All ids, how many each text has, and the slots of each text's pieces."""
        if len(self.slot) > self.cache:
            self._clear()
        split = [x.split(" ") for x in texts]
        flat = list(chain.from_iterable(split))
        codes = list(map(self.slot.__getitem__, flat))
        self._learn(self.slot.taken())
        code = np.array(codes, np.int64)
        sizes = np.diff(self.begin)[code]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.begin[code] - stops[:-1], sizes) + np.arange(int(stops[-1]))
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split))).tolist()
        return self.flat[at], np.diff(stops[ends], prepend=0), [codes[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library's decode(ids, skip_special_tokens=False) for a file without decoder."""
        return b" ".join([self.string[i] for i in ids.tolist()])


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with `ids`, little-endian unsigned 32-bit integers, `n_tokens`, and `decoded`, the decoded text."""
    return _with(docs, tokenizer, text, "ids binary, n_tokens long, decoded string", lambda data, n, decoded: [data, n, decoded.decode()])


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _with(docs.select("doc_id", "text"), tokenizer, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda data, n, decoded: [n, sha(data), sha(decoded)]).drop("text")


def summarised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids and both digests."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    more = "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
    return _with(docs.select("doc_id", "text"), tokenizer, "text", more, lambda data, n, decoded: [n, data, sha(data), sha(decoded)]).drop("text")


def _with(docs: DataFrame, tokenizer: str, text: str, more: str, row) -> DataFrame:
    new = [c.strip().split(" ")[0] for c in more.split(",")]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), more])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[c.strip().split(" ")[1]] for c in more.split(",")]
        texts = slots = rows = made = None
        for batch in batches:
            for part in common.blocks(batch, _BATCH_BYTES, text):
                ids, counts, slots = codec.encode([x or "" for x in part.column(at).to_pylist()])
                rows, texts, stops = [], codec.text, np.cumsum(counts).tolist()
                for n, stop, own in zip(counts.tolist(), stops, slots, strict=True):
                    decoded = b" ".join([x for x in map(texts.__getitem__, own) if x])
                    rows.append(row(ids[stop - n : stop].tobytes(), n, decoded))
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *new])
        del codec, texts, slots, rows, made
        common.give_back()

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
