"""The byte network against finite differences and a plain loop, its windows against whole texts, and odd documents."""

import random

import numpy as np

from lakecat.llm import langid


def test_gradient():
    net = langid.Network(3, hidden=4, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, sizes = langid.padded([b"hello", b"abc", b"\xc3\xa9t", b"z"])
    label = np.array([0, 1, 2, 1])

    def loss():
        prob = net.positions(x, sizes)
        inside = np.arange(len(x))[:, None] < sizes[None, :]
        return -(np.log(prob[:, np.arange(4), label]) * inside).sum() / inside.sum()

    grad = net.gradient(x, sizes, label)
    for k, at in (("Xf", (0, ord("e"), 3)), ("Uf", (2, 1, 3)), ("Xb", (1, ord("l"), 0)), ("Ub", (1, 2, 1)), ("Ub", (0, 2, 1)), ("V", (1, 1, 2)), ("c", (1,))):
        old, step = net.p[k][at], 1e-3
        net.p[k][at] = old + step
        up = loss()
        net.p[k][at] = old - step
        slope = (up - loss()) / (2 * step)
        net.p[k][at] = old
        assert abs(slope - grad[k][at]) < 1e-3 + 0.02 * abs(slope), k


def plain(net, text):
    """Label probabilities of every byte of a text, one step after another."""
    states = []
    for side, order in (("f", range(len(text))), ("b", range(len(text) - 1, -1, -1))):
        X, U, s, out = net.p["X" + side], net.p["U" + side], np.zeros(net.hidden), {}
        for t in order:
            z, r = (1 / (1 + np.exp(-(X[k][text[t]] + s @ U[k]))) for k in (0, 1))
            s = (1 - z) * s + z * np.tanh(X[2][text[t]] + (r * s) @ U[2])
            out[t] = s
        states.append([out[t] for t in range(len(text))])
    logits = np.array([f @ net.p["V"][0] + b @ net.p["V"][1] + net.p["c"] for f, b in zip(*states, strict=True)])
    e = np.exp(logits)
    return e / e.sum(1, keepdims=True)


def test_pooled_equals_a_plain_loop():
    rng = random.Random(1)
    net = langid.Network(4, seed=5)
    texts = [bytes(rng.choices(b"abcdefgh \xc3\xa9", k=n)) for n in (0, 1, 7, 200, 959, 960)]
    got = langid.pooled(net, texts)
    assert (got[0] == 0).all()
    for text, mean in zip(texts[1:], got[1:], strict=True):
        assert np.allclose(mean, plain(net, text).mean(0), atol=1e-4)


def test_windows_count_every_position_once_and_read_enough_before_it():
    lengths = np.array([0, 1, 960, 961, 5000, 100_000])
    text, start, size, lo, hi = langid.windows(lengths)
    for i, n in enumerate(lengths.tolist()):
        own = text == i
        places = [p for s, a, b in zip(start[own], lo[own], hi[own], strict=True) for p in range(s + a, s + b)]
        assert places == list(range(n))
        assert all(s == 0 or a == langid.CONTEXT for s, a in zip(start[own], lo[own], strict=True))
    assert (size <= langid.SPAN + 2 * langid.CONTEXT).all()
    net = langid.Network(4, seed=5)
    long = bytes(random.Random(2).choices(b"abcdefgh ", k=4000))
    assert np.abs(langid.pooled(net, [long])[0] - plain(net, long).mean(0)).max() < 0.01


def test_pieces_are_bounded_and_from_the_whole_text():
    text = bytes(range(256)) * 1000
    pieces = langid.pieces_of(7, text)
    assert len(pieces) == langid.PIECES and all(len(p) == langid.PIECE for p in pieces) and pieces == langid.pieces_of(7, text)
    assert langid.pieces_of(7, b"") == [] and langid.pieces_of(7, b"x") == [b"x"]


def test_odd_documents(spark):
    rows = [(1, None, "en", "x", 1.0), (2, "", "en", "x", 1.0), (3, "12 ½ ² ① Ⅷ !?", "en", "x", 1.0), (4, "a", "en", "x", 1.0), (None, "some words", None, "x", 1.0), (4, "a", "en", "x", 1.0), (5, "word " * 200_000, "en", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identified(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[1] == by[2] == by[3] == [("und", 0.0)] and by[4][0] == by[4][1] and by[4][0][0] == by[5][0][0] == by[None][0][0] == "en"
    assert [r.lang_pred for r in langid.identified(docs.withColumn("lang", docs.lang.substr(9, 0)).where("lang = 'x'")).collect()] == []
    nothing = langid.identified(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
