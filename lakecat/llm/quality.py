"""Quality classifier: supervised subword embeddings.

A text's units are its words and its pairs of neighbouring words. A word's vector is the mean of the learned vectors of its
hash and of its character n-grams' hashes (3 to 5 bytes, word ends marked); a pair has a hashed vector of its own, and all pairs
of equal words share one, so that repetition is a feature whatever is repeated. The text's vector is the mean over its units;
a softmax layer gives the labels' probabilities. Vectors and layer are trained in numpy by stochastic gradient descent with
per-row step sizes.

Training runs as one task on a sample of `sample` labelled rows at most (the ids with the smallest hashes), read by a
broadcast of those ids; the model (at most a few MB, whatever the corpus) comes back through the driver. As the network is linear
up to the softmax, a unit's share of the two logits is a scalar: scoring looks it up per distinct word and adds up per text.

Defined results: a null text counts as empty; a text without words gets the probability of the trained bias alone; with no
labelled row at all, or one label only, that share, or 1.0, is everyone's score; repeated rows score alike; rows with a null
doc_id are never held out and never train; texts of any length are scored whole; an empty table gives an empty result; extra columns
pass through `scored`, but for held_out, score and predicted, which it replaces.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, BUCKETS, DIM, MIN_GRAM, MAX_GRAM = 4_000, 1 << 17, 8, 3, 5
THRESHOLD, FOLDS = 0.3, 5
_STEPS, _BATCH, _RATE, _SEED = 300, 32, 0.5, 7
_BLOCK_BYTES, _CACHE = 4 << 20, 200_000


def word_features(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each feature, feature, hash of each word): the word itself and its character n-grams, as buckets."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    whole = common.byte_hashes(data, starts, ends) if len(words) else np.zeros(0, np.uint64)
    rows, hashes = [np.arange(len(words))], [whole]
    of = np.repeat(np.arange(len(words)), sizes)
    for k in range(MIN_GRAM, MAX_GRAM + 1):
        at = np.arange(max(0, len(data) - k + 1))
        at = at[at + k <= ends[of[at]]]
        rows.append(of[at])
        hashes.append(common.byte_hashes(data, at, at + k))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int32), whole


def pair_features(hashes: np.ndarray, codes: np.ndarray, text: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each pair of neighbouring words."""
    inside = text[1:] == text[:-1]
    a, b = codes[:-1][inside], codes[1:][inside]
    made = common.mix(hashes[a] * np.uint64(3) + hashes[b])
    return text[1:][inside], np.where(a == b, 0, made % np.uint64(buckets)).astype(np.int32)


class Trainer:
    """Units of the labelled texts, and the gradient steps."""

    def __init__(self, texts: list[bytes], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, seed: int = _SEED):
        slots = common.Slots()
        split = [x.split() for x in texts]
        self.codes = [np.fromiter(map(slots.__getitem__, w), np.int64, len(w)) for w in split]
        rows, self.features, self.hashes = word_features(list(slots), buckets)
        order = np.argsort(rows, kind="stable")
        self.features = self.features[order]
        self.sizes = np.bincount(rows, minlength=len(slots))
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.labels, self.buckets = labels, buckets
        rng = self.rng = np.random.default_rng(seed)
        self.E = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.W = np.zeros((dim, 2), np.float32)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.b = np.log([1 - share, share]).astype(np.float32)
        self.G, self.GW = np.full(buckets, 1e-8, np.float32), np.full(self.W.shape, 1e-8, np.float32)

    def batch(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents' averaging matrix as (row, feature, weight)."""
        codes = np.concatenate([self.codes[d] for d in docs])
        text = np.repeat(np.arange(len(docs)), [len(self.codes[d]) for d in docs])
        key, count = np.unique(text << 32 | codes, return_counts=True)
        t, c = key >> 32, key & 0xFFFFFFFF
        sizes = self.sizes[c]
        stops = np.cumsum(sizes)
        at = np.repeat(self.begin[c] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)
        pair_text, pair = pair_features(self.hashes, codes, text, self.buckets)
        units = np.maximum(np.bincount(text, minlength=len(docs)) + np.bincount(pair_text, minlength=len(docs)), 1)
        rows = np.concatenate([np.repeat(t, sizes), pair_text])
        weight = np.concatenate([np.repeat(count / sizes, sizes), np.ones(len(pair))]) / units[rows]
        # equal (row, feature) entries add up
        key, back = np.unique(rows << 32 | np.concatenate([self.features[at], pair]), return_inverse=True)
        return key >> 32, key & 0xFFFFFFFF, np.bincount(back, weight, len(key)).astype(np.float32)

    def step(self, docs: np.ndarray, rate: float) -> None:
        rows, feature, weight = self.batch(docs)
        n, dim = len(docs), self.W.shape[0]
        x = np.stack([np.bincount(rows, weight * self.E[feature, k], n) for k in range(dim)], 1).astype(np.float32)
        logits = x @ self.W + self.b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), self.labels[docs]] -= 1
        gx, gw = p @ self.W.T, x.T @ p
        distinct, back = np.unique(feature, return_inverse=True)
        ge = np.stack([np.bincount(back, weight * gx[rows, k], len(distinct)) for k in range(dim)], 1).astype(np.float32)
        self.G[distinct] += (ge**2).mean(1)
        self.E[distinct] -= rate * 0.1 * ge / np.sqrt(self.G[distinct])[:, None]
        self.GW += gw**2
        self.W -= rate * gw / np.sqrt(self.GW)
        self.b -= 0.01 * rate * p.sum(0)

    def train(self, steps: int = _STEPS, batch: int = _BATCH, rate: float = _RATE) -> None:
        order = np.zeros(0, np.int64)
        for i in range(steps):
            if len(order) < batch:
                order = np.concatenate([order, self.rng.permutation(len(self.labels))])
            self.step(order[:batch], rate * (1 - i / steps))
            order = order[batch:]


class Scorer:
    """Probability of label 1, from a trained model's scalars."""

    def __init__(self, table: np.ndarray, bias: float, cache: int = _CACHE):
        self.table, self.bias, self.cache = table, bias, cache
        self._clear()

    def _clear(self) -> None:
        self.slots, self.value, self.hashes = common.Slots(), np.zeros(0, np.float32), np.zeros(0, np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            rows, features, hashes = word_features(part, len(self.table))
            mean = np.bincount(rows, self.table[features], len(part)) / np.bincount(rows, minlength=len(part))
            self.value, self.hashes = np.concatenate([self.value, mean.astype(np.float32)]), np.concatenate([self.hashes, hashes])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if len(self.slots) > self.cache:
            self._clear()
        split = [x.split() for x in texts]
        codes = np.array(list(map(self.slots.__getitem__, chain.from_iterable(split))), np.int64)
        self._learn(self.slots.taken())
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        pair_text, pair = pair_features(self.hashes, codes, text, len(self.table))
        total = np.bincount(text, self.value[codes], len(texts)) + np.bincount(pair_text, self.table[pair], len(texts))
        units = np.bincount(text, minlength=len(texts)) + np.bincount(pair_text, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(units, 1) + self.bias, -50, 50)))


def labelled(docs: DataFrame, labels: DataFrame, sample: int, folds: int = FOLDS) -> DataFrame:
    """text and label of at most `sample` rows outside the held-out fold: those whose ids have the smallest hashes."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(common.crc_fold("doc_id", folds) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> tuple[np.ndarray, float]:
    """(scalar of each bucket, bias): the difference of the two logits that a feature's vector makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        marks: list[int] = []
        for batch in batches:
            texts += common.encoded(batch.column(0))
            marks += batch.column(1).to_pylist()
        y = np.array(marks, np.int64)
        if len(set(marks)) < 2:
            table, bias = np.zeros(1, np.float32), 50.0 if not len(y) or y.mean() > 0.5 else -50.0
        else:
            trainer = Trainer(texts, y)
            trainer.train()
            side = np.array([-1, 1], np.float32)
            table, bias = trainer.E @ (trainer.W @ side), float(trainer.b @ side)
        held = io.BytesIO()
        np.savez(held, table=table, bias=bias)
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], names=["model"])
        texts = trainer = None
        common.give_back()

    rows = labelled(docs, labels, sample, folds)
    found = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("text", F.col("label").cast("int")).mapInArrow(run, "model binary").collect()
    if not found:
        return np.zeros(1, np.float32), 50.0
    model = np.load(io.BytesIO(found[0]["model"]))
    return model["table"], float(model["bias"])


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """docs with held_out, score and predicted."""
    docs = docs.drop(*[c for c in ("held_out", "score", "predicted") if c in docs.columns])
    table, bias = fit(docs, labels, sample, folds)
    schema = docs.withColumn("score", F.lit(0.0)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(table, bias)
        for batch in batches:
            for part in common.blocks(batch, _BLOCK_BYTES):
                score = scorer.score(common.encoded(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])
        del scorer
        common.give_back()

    out = docs.mapInArrow(run, schema)
    return out.withColumns({"held_out": common.crc_fold("doc_id", folds) == 0, "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
