"""The token store against the library: odd texts, hot ids and texts, empty tables, very long texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from lakecat.llm import tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "Word", " ", " ", " ", "  ", "\n", "\n", "\t", "\r", ".", ",", "'s", "'", "É", "ß", "ÿ", "İ", "日", "🙂", "1", "23", "²", "\xa0", "\x0b", "\x1c", "　", "́", "<|endoftext|>", "<|", "|>", "\0", "_", "$$"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def expected(library, rows):
    out, start = [], 0
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def stored(spark, docs, path):
    tokenstore.write(docs, str(path), PATH, block=500)
    return sorted(map(tuple, tokenstore.digests(spark, str(path)).collect()), key=lambda r: r[1])


@pytest.mark.parametrize("cache", [5, 1_000_000])
def test_odd_texts(library, cache):
    rng = random.Random(cache)
    texts = ["".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(3000)]
    own = tokenstore.Encoder(PATH, cache=cache)
    for a in range(0, len(texts), 300):
        part = texts[a : a + 300]
        ids, counts = own.encode(pa.array(part, pa.string()))
        for x, n, b in zip(part, counts, np.cumsum(counts), strict=True):
            assert ids[b - n : b].tolist() == library.encode(x, add_special_tokens=False).ids, repr(x)


def test_very_long_text(library):
    text = " ".join(f"w{i % 977}" for i in range(300_000)) + "\n" + "x" * 50_000
    ids, counts = tokenstore.Encoder(PATH).encode([text, ""])
    assert counts.tolist() == [len(ids), 0] and ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokenstore.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_hot_ids_and_repeated_rows_are_split_and_keep_the_order(spark, library, tmp_path):
    rows = [(None, f"null {i}") for i in range(60)] + [(5, f"same {i % 3}") for i in range(60)] + [(7, "equal")] * 60 + [(i, f"doc {i}") for i in range(10, 70)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, __salt string").repartition(6)
    bounds = tokenstore.Bounds.of(tokenstore._rows(docs), 12)
    placed = bounds.part(np.array([7] * 60), np.full(60, bounds.hashes[bounds.ids == 7][0]), np.arange(60))
    assert len(set(placed.tolist())) > 1  # equal rows are dealt over several parts
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = stored(spark, docs, tmp_path / "store")
        parts = [r["c"] for r in tokenstore.read(spark, str(tmp_path / "store")).groupBy("part").count().withColumnRenamed("count", "c").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert max(parts) <= 50  # of 240 rows in 12 parts
    assert [r[0] for r in got] == [i for i, _ in rows]  # null first, then ascending, equal ids side by side
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    sort = lambda x: sorted((r[0] or -1, r[2], r[3]) for r in x)
    assert sort(got) == sort(expected(library, rows))


def test_empty_table(spark, tmp_path):
    assert stored(spark, spark.createDataFrame([], "doc_id long, text string"), tmp_path / "none") == []
    assert tokenstore.encode(spark.createDataFrame([(None, None)], "doc_id long, text string"), PATH).count() == 1
