"""Language identification: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a document's bytes, one from each side; a softmax over both states labels every position, and a
document's probabilities are the mean over all its positions. Trained in numpy by backpropagation through time with Adam on
windows of a bounded sample of documents.

Documents are read in windows of `SPAN` positions with `CONTEXT` more bytes on either side, which bring the states up to date and are not
counted there: each position is labelled once, with at least CONTEXT bytes read before it from each side (or all there are).
So a long text is many windows that run side by side, not one long loop, and memory is bounded by a batch of windows.

Defined results: null text, and text without a letter, is `und` with score 0; with no row to learn from everything is `und`;
ties go to the first language in sorted order; repeated rows score alike; a null doc_id is never held out and never trains; texts of any
length are read whole, those that Arrow brings in one batch in blocks of some megabytes; an empty table gives an empty result; extra
columns pass through `identified`, but for held_out, lang_pred and score, which it replaces.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: At most SAMPLE documents are learned from, of each at most PIECES windows of PIECE bytes.
SAMPLE, PIECES, PIECE, FOLDS = 2_000, 32, 64, 5
HIDDEN, SPAN, CONTEXT = 8, 960, 32
_STEPS, _BATCH, _RATE, _SEED = 400, 96, 0.03, 11
_BLOCK_BYTES, _WINDOWS = 4 << 20, 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: for each direction X (3, 256, H) of the input byte and U (3, H, H) of the state, of update gate, reset gate and candidate; V (2, H, C)
    and c for the labels."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
        self.p = {"Xf": draw(3, 256, hidden), "Uf": draw(3, hidden, hidden), "Xb": draw(3, 256, hidden), "Ub": draw(3, hidden, hidden), "V": draw(2, hidden, classes), "c": np.zeros(classes, np.float32)}
        self.hidden = hidden

    def _steps(self, x: np.ndarray, alive: np.ndarray, side: str) -> Iterator[tuple[int, int, np.ndarray, tuple]]:
        """(position, windows that reach it, states after it, what backpropagation needs), in the direction's order."""
        X, U = self.p["X" + side], self.p["U" + side]
        state = np.zeros((x.shape[1], self.hidden), np.float32)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            n = int(alive[t])
            s, at = state[:n], x[t, :n]
            z = _sigmoid(X[0].take(at, 0) + s @ U[0])
            r = _sigmoid(X[1].take(at, 0) + s @ U[1])
            rs = r * s
            new = np.tanh(X[2].take(at, 0) + rs @ U[2])
            before = s.copy()
            s += z * (new - s)
            yield t, n, s, (before, z, r, rs, new)

    def positions(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities (position, window, label); rows past a window's end mean nothing. Windows are sorted by size, longest first."""
        alive = np.searchsorted(-sizes, -np.arange(len(x)), "left")
        logits = np.zeros((*x.shape, len(self.p["c"])), np.float32) + self.p["c"]
        for i, side in enumerate("fb"):
            for t, n, s, _ in self._steps(x, alive, side):
                logits[t, :n] += s @ self.p["V"][i]
        return _softmax(logits)

    def sums(self, x: np.ndarray, sizes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sum of the label probabilities over the positions lo to hi of each window. As `positions`, without keeping them all."""
        alive = np.searchsorted(-sizes, -np.arange(len(x)), "left")
        # gates are 1 / (1 + exp(-a)), candidates 2 / (1 + exp(-2a)) - 1
        signs = np.array([-1, -1, -2], np.float32)[:, None, None]
        X, U = {s: self.p["X" + s] * signs for s in "fb"}, {s: self.p["U" + s] * signs for s in "fb"}
        V, c, classes, width = self.p["V"], self.p["c"], len(self.p["c"]), x.shape[1]
        logits = np.empty((len(x), width, classes), np.float32)
        out, ones = np.zeros((width, classes), np.float32), np.ones((classes, 1), np.float32)
        z, r, new, g = (np.empty((width, self.hidden), np.float32) for _ in range(4))
        for i, side in enumerate("fb"):
            state = np.zeros((width, self.hidden), np.float32)
            for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
                n = int(alive[t])
                s, at = state[:n], x[t, :n]
                for k, gate in ((0, z[:n]), (1, r[:n]), (2, new[:n])):
                    np.matmul(s if k < 2 else r[:n], U[side][k], out=gate)
                    np.take(X[side][k], at, 0, out=g[:n], mode="clip")
                    gate += g[:n]
                    np.exp(gate, out=gate)
                    gate += 1
                    np.reciprocal(gate, out=gate)
                    if k == 1:
                        gate *= s
                new[:n] *= 2
                new[:n] -= 1
                new[:n] -= s
                new[:n] *= z[:n]
                s += new[:n]
                if side == "f":
                    np.matmul(s, V[0], out=logits[t, :n])
                    continue
                p = logits[t, :n]
                p += s @ V[1]
                p += c  # states are within -1 and 1, so logits are too small to overflow
                np.exp(p, out=p)
                p *= ((t >= lo[:n]) & (t < hi[:n])).astype(np.float32)[:, None] / (p @ ones)
                out[:n] += p
        return out

    def gradient(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy over all positions, by backpropagation through time."""
        alive = np.searchsorted(-sizes, -np.arange(len(x)), "left")
        p = self.p
        kept = {side: [(t, n, s.copy(), more) for t, n, s, more in self._steps(x, alive, side)] for side in "fb"}
        logits = np.zeros((*x.shape, len(p["c"])), p["c"].dtype) + p["c"]
        for i, side in enumerate("fb"):
            for t, n, s, _ in kept[side]:
                logits[t, :n] += s @ p["V"][i]
        prob = _softmax(logits)
        inside = np.arange(len(x))[:, None] < sizes[None, :]
        prob[:, np.arange(len(label)), label] -= 1
        prob *= (inside / inside.sum()).astype(prob.dtype)[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["c"] = prob.sum((0, 1))
        for i, side in enumerate("fb"):
            U = p["U" + side]
            carry = np.zeros((x.shape[1], self.hidden), p["c"].dtype)
            for t, n, s, (before, z, r, rs, new) in reversed(kept[side]):
                grad["V"][i] += s.T @ prob[t, :n]
                d = carry[:n] + prob[t, :n] @ p["V"][i].T
                dn = d * z * (1 - new * new)
                drs = dn @ U[2].T
                dz = d * (new - before) * z * (1 - z)
                dr = drs * before * r * (1 - r)
                carry[:n] = d * (1 - z) + drs * r + dz @ U[0].T + dr @ U[1].T
                for k, (g, with_) in enumerate(((dz, before), (dr, before), (dn, rs))):
                    grad["U" + side][k] += with_.T @ g
                    np.add.at(grad["X" + side][k], x[t, :n], g)
        return grad

    def train(self, pieces: list[bytes], labels: np.ndarray, steps: int = _STEPS, batch: int = _BATCH, rate: float = _RATE, seed: int = _SEED) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, steps + 1):
            pick = sorted(rng.integers(0, len(pieces), batch).tolist(), key=lambda j: -len(pieces[j]))
            x, sizes = padded([pieces[j] for j in pick])
            for k, g in self.gradient(x, sizes, labels[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= (rate * (1 - i / (steps + 1)) / (1 - 0.9**i)) * first[k] / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = np.exp(logits - logits.max(axis=2, keepdims=True))
    return logits / logits.sum(axis=2, keepdims=True)


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' bytes as a matrix (position, piece), and their sizes; pieces must be sorted by size, longest first."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = int(sizes[0]) if len(sizes) else 0
    data = np.frombuffer(b"".join([p.ljust(width) for p in pieces]), np.uint8)
    return np.ascontiguousarray(data.reshape(len(pieces), width).T), sizes


def windows(lengths: np.ndarray, span: int = SPAN, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """(text, first byte, size, lo, hi) of the windows over texts of so many bytes: lo to hi, within the window, are the positions counted."""
    n = -(-lengths // span)
    text = np.repeat(np.arange(len(lengths)), n)
    core = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * span
    start, end = np.maximum(core - context, 0), np.minimum(core + span + context, lengths[text])
    return text, start, end - start, core - start, np.minimum(core + span, lengths[text]) - start


def pooled(network: Network, texts: list[bytes], span: int = SPAN, context: int = CONTEXT) -> np.ndarray:
    """Mean probability of each language over all positions of each text; zeros for an empty text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text, start, size, lo, hi = windows(lengths, span, context)
    flat = np.frombuffer(b"".join(texts) + b" ", np.uint8)
    begin = (np.cumsum(lengths) - lengths)[text] + start
    order = np.argsort(-size, kind="stable")
    out = np.zeros((len(texts), len(network.p["c"])))
    for a in range(0, len(order), _WINDOWS):
        part = order[a : a + _WINDOWS]
        at = begin[part][None, :] + np.arange(int(size[part[0]]))[:, None]
        found = network.sums(flat.take(at, mode="clip"), size[part], lo[part], hi[part])
        np.add.at(out, text[part], found)
    return out / np.maximum(lengths, 1)[:, None]


def pieces_of(doc_id: int, text: bytes, most: int = PIECES, size: int = PIECE) -> list[bytes]:
    """Windows of a text to learn from: all that it has, or `most` at places drawn by the id."""
    places = range(0, max(len(text) - size // 2, 1), size)
    if len(places) > most:
        rng = np.random.default_rng(zlib.crc32(str(doc_id).encode()))
        places = sorted(rng.integers(0, len(text) - size + 1, most).tolist())
    return [text[a : a + size] for a in places if text[a : a + size]]


def fit(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> tuple[Network | None, list[str]]:
    """Train on windows of `sample` documents at most (those whose ids have the smallest hashes) outside the held-out fold."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(common.crc_fold("doc_id", folds) != 0)
    known = known.groupBy("doc_id").agg(F.min("lang").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one row per sampled document
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "label")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, _BLOCK_BYTES):
                ids = part.column(0).to_pylist()
                made = [pieces_of(i, t) for i, t in zip(ids, common.encoded(part.column(1)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.binary())), part.column(2)], names=["doc_id", "pieces", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        names: list[str] = []
        for batch in batches:
            for own, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces += own
                names += [label] * len(own)
        if not pieces:
            return
        languages = sorted(set(names))
        index = {x: i for i, x in enumerate(languages)}
        network = Network(len(languages))
        network.train(pieces, np.array([index[x] for x in names]))
        held = io.BytesIO()
        np.savez(held, **network.p)
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary()), pa.array([languages], pa.list_(pa.string()))], names=["model", "languages"])

    # the sample's windows, some megabytes at most, in one task
    drawn = rows.mapInArrow(cut, "doc_id long, pieces array<binary>, label string").repartition(1).sortWithinPartitions("doc_id", "pieces")
    found = drawn.select("pieces", "label").mapInArrow(run, "model binary, languages array<string>").collect()
    if not found:
        return None, []
    network = Network(len(found[0]["languages"]))
    network.p = dict(np.load(io.BytesIO(found[0]["model"])))
    return network, list(found[0]["languages"])


def identified(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """docs (doc_id, text, lang) with held_out, lang_pred and score."""
    docs = docs.drop(*[c for c in ("held_out", "lang_pred", "score") if c in docs.columns])
    network, languages = fit(docs, sample, folds)
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, _BLOCK_BYTES):
                letters = np.array([x is not None and any(map(str.isalpha, x)) for x in part.column(at).to_pylist()])
                if network:
                    mean = pooled(network, common.encoded(part.column(at)))
                    best, score = mean.argmax(1), np.where(letters, mean.max(1), 0.0)
                    names = [languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                else:
                    names, score = ["und"] * len(letters), np.zeros(len(letters))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=[*part.schema.names, "lang_pred", "score"])
        common.give_back()

    return docs.mapInArrow(run, schema).withColumn("held_out", common.crc_fold("doc_id", folds) == 0)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs).select("doc_id", "held_out", "lang_pred", "score")
