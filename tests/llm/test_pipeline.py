"""Pipeline stages on whole tables, each against brute force on a small fixture, and odd rows through all of them."""

import collections
import random

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from lakecat.llm import common, quality
from tests.llm.test_operators import brute_components, brute_fingerprint

STAGE = dict(corpus_pipeline.STAGES)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "bpe_encoding"
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] >= sizes[4] == sizes[5] > 0
    mark = common.staged_so_far()
    assert corpus_pipeline.run(spark, sf).count() == sizes[5]
    assert common.staged_so_far() == mark + 1  # only the rows that the last stage reads are left


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a fixture: prose, copies, near copies, a repeated passage, a benchmark item; odd rows and columns."""
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "r", "st", "ll", "mp")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, item = text(60), text(30)
    rows = [(i, text(120)) for i in range(24)]
    rows += [(100 + i, rows[i][1]) for i in range(4)] + [(200 + i, rows[i + 6][1] + " end") for i in range(4)]
    rows += [(300 + i, f"{text(50)} {passage} {text(50)}") for i in range(3)] + [(400 + i, f"{text(40)} {item} {text(40)}") for i in range(2)]
    rows += [(500, None), (501, ""), (None, text(80)), (None, text(90)), (502, text(70)), (502, text(75))]
    out = tmp_path_factory.mktemp("fixture")
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cuts string, score double")
    frame.write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, text(25)), (3, None)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out), rows


def kept(spark, frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.collect())


def test_near_copies_against_brute_force(spark, folder):
    path, rows = folder
    rows = [r for r in rows if r[0] is not None and r[0] != 502]
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id IS NOT NULL AND doc_id <> 502")
    prints = {i: brute_fingerprint(t) for i, t in rows}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    first = {i: min([j for j in prints if near(i, j)]) for i in prints}
    roots = brute_components(prints)
    smallest = {}
    for i, root in roots.items():
        smallest[root] = min(i, smallest.get(root, i))
    assert set(first.values()) >= set(smallest.values())
    got = kept(spark, STAGE["simhash_near_dedup"](spark, docs, path))
    assert {i for i, _ in got} == set(smallest.values()) and max(got.values()) == 1


def test_passages_against_brute_force(spark, folder):
    path, rows = folder
    count = collections.Counter()
    for _, t in rows:
        w = (t or "").split()
        count.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    expected = collections.Counter()
    for i, t in rows:
        w = (t or "").split()
        gone = [any(count[tuple(w[q : q + 35])] > 1 for q in range(max(0, p - 34), min(p, len(w) - 35) + 1)) for p in range(len(w))]
        expected[i, None if t is None else " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    out = STAGE["substring_dedup"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert kept(spark, out) == expected
    assert all(r.cuts == "x" and r.n_chars == (len(r.text) if r.text is not None else r.n_chars) for r in out.collect())


def test_leaks_against_planted_items(spark, folder):
    path, rows = folder
    out = STAGE["benchmark_decontamination"](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert kept(spark, out) == collections.Counter(r for r in rows if r[0] is None or r[0] // 100 != 4)


def test_rejected_rows_are_those_of_the_classifier(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = STAGE["quality_classifier"](spark, docs, path)
    scored = quality.scored(docs.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 1")
    assert kept(spark, out) == kept(spark, scored) and out.columns == docs.columns


def test_encoding_against_the_library(spark, folder):
    path, rows = folder
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = STAGE["bpe_encoding"](spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()
    got = collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in out)
    assert got == collections.Counter((i, len(x), b"".join(y.to_bytes(4, "little") for y in x)) for i, x in ((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows))


def test_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name
