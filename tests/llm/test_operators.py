"""Each operator against brute force, the library, or DuckDB, on rows with nulls, empty and long texts, copies and clashing columns."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash

from lakecat.llm import bpe, chat, decontam, langid, quality, queries, rules, simhash, substring, tokenstore

WORDS = "the of and in a to thion erble restan whing onst derch anle moure".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "x", "yz", ".", ",\n"][: 3 + 4 * (rng.random() < 0.7)]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.choice([1, 3, 20, 60, 200])) for _ in range(60)]
    passage = prose(rng, 70)
    out = [None, "", " ", "one", "two words", "a\tb\x0bc\x0cd\r\ne  f\xa0g\x1ch", "É ñ ß <|endoftext|> x<|startoftext|>y's DON'T", "word " * 400, prose(rng, 6000)]
    out += base + base[:7] + [b.replace("the", "thee", 1) for b in base[20:30]]
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 10) for _ in range(5)] + [passage, passage + " " + passage]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, "clash", i, -1.0, "x") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, h string, n long, score double, cuts string"
    return spark.createDataFrame(rows, schema).repartition(5)


def some_words(text):
    return (text or "").encode().split()


def test_substring_against_brute_force(spark, docs, texts):
    count = collections.Counter()
    for t in texts:
        w = some_words(t)
        count.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    expected = {}
    for i, t in enumerate(texts):
        w = some_words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = [True] * 35
        expected[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect()}
    assert got == expected and sum(v[1] for v in got.values()) > 500


def test_substring_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, text + " tail"), (None, None)]
    out = substring.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out if r.text is not None) == [(0, "tail"), (1, ""), (1, "")]
    assert len(out) == 4


def test_substring_wide_windows_and_clashing_columns(spark):
    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(900))
    rows = [(1, shared, 5), (2, "head " + shared + " tail", 6), (3, shared[:2000], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts int")
    for window in (200, 300):
        assert {r.doc_id: r.n_removed for r in substring.digests(docs.where("doc_id < 3"), window).collect()} == {1: 900, 2: 900}
    out = {r.doc_id: (r.text, r.cuts) for r in substring.strip(docs).collect()}
    assert out[1] == ("", 5) and out[2] == ("head tail", 6) and out[3][1] == 7
    assert substring.strip(docs.where("false")).columns == docs.columns and substring.digests(docs.where("false")).count() == 0


def test_substring_compaction_and_verification(spark):
    """Shared passages become one span per occurrence; a span whose words no other one has is found out."""
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    passage = fresh(400)
    docs = spark.createDataFrame([(i, f"{fresh(40)} {passage} {fresh(40)}") for i in range(4)], "doc_id long, text string")
    whole, _ = substring.repeated(docs)
    long = substring.compacted(whole).collect()
    assert len(long) == 4 and whole.count() > 40 and len({(r.k1, r.k2, r.n) for r in long}) == 1
    same = [{"lo": 0, "n": 6, "k1": 1, "k2": 1}]
    cut = spark.createDataFrame([(1, 0, "a " * 40, same), (2, 0, "a " * 40, same), (3, 0, "a " * 39 + "b", same), (4, 0, None, None)], "__d long, __h int, text string, cuts array<struct<lo:int,n:int,k1:long,k2:long>>")
    assert [(r.d, r.h, r.lo) for r in substring.unverified(cut, 35).collect()] == [(3, 0, 0)]


def test_substring_very_long_text():
    """Grams of a text beyond one numbered piece, against the plain least."""
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    old, substring._PLACE_BITS = substring._PLACE_BITS, 12
    try:
        got = substring.anchors(grams, 26)
    finally:
        substring._PLACE_BITS = old
    high = grams & ~substring._LOW
    assert all(got[i] == i + int(high[i : i + 26].argmin()) for i in range(0, len(got), 997))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[j : j + 4]) for j in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


def test_simhash_against_brute_force(docs, texts):
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    parts = brute_components(fps)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.components(docs).collect()}
    assert got == {i: (fps[i], parts[i]) for i in fps}
    assert len(set(parts.values())) < len(parts)


@pytest.mark.parametrize(("blocks", "crowd"), [(3, 2048), (3, 2), (1, 2048)])
def test_ball_hashing_loses_no_link(spark, blocks, crowd):
    rng = random.Random(5)
    fps = {}
    for c in range(6):
        centre = rng.getrandbits(64)
        for _ in range(12):
            fp = centre
            for b in rng.sample(range(64), rng.randint(0, 7)):
                fp ^= 1 << b
            fps[len(fps)] = fp
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in set(fps.values())]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), blocks=blocks, crowd=crowd)
    roots = {r.node: r.root for r in simhash.closure(links).collect()}
    parts = brute_components({i: fp for i, (fp,) in enumerate((s[0] % (1 << 64),) for s in signed)})
    by_root = collections.defaultdict(set)
    for (fp,) in signed:
        by_root[roots.get(fp, fp)].add(fp)
    by_part = collections.defaultdict(set)
    for i, p in parts.items():
        by_part[p].add(signed[i][0])
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_part.values()))


def test_closure_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(9)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in simhash.closure(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(v == (0 if k <= 200 else 1000) for k, v in got.items()) and len(got) == 209


def test_keep_first(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    parts = {r.component_id for r in simhash.components(docs).collect()}
    assert sorted(ids) == sorted(parts)


def test_keep_first_of_null_ids_and_repeated_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a, 1), (None, a, 1), (None, b, 2), (None, c, 3), (7, c, 4), (7, c, 4)]
    out = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, fp long"))
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, a), (0, b), (7, c)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_store_round_trip(spark, docs, texts, tmp_path, kind):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    expected, start = {}, 0
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        expected[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    tokenstore.write(docs, str(tmp_path / kind), path, block=1000, kind=kind)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.digests(spark, str(tmp_path / kind)).collect()}
    assert got == expected


def test_planes():
    rng = np.random.default_rng(0)
    for kind in ("byte", "bit"):
        for width in (2, 4):
            for n in (0, 1, 7, 8, 9, 1000):
                ids = rng.integers(0, 1 << 8 * width, n).astype(np.uint32)
                assert (tokenstore.ids_of(tokenstore.planes_of(ids, width, kind), n, width, kind) == ids).all()


def test_crc32_combine():
    a, b = b"some bytes", b"and some more of them"
    assert tokenstore.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ODD = ["", " ", "a  b   c\n d \n e\t", "a\n\n\nb\n\n", "It's DON'T we'll 'S", "aaaaaaaaa  aaaa aa zzzz", "Café ÉTÉ İstanbul ΑΣ Σ ﬁ １２ ½ 3²", "a\xa0b \x1c!\x1c!   x", "<|ENDOFTEXT|><|endoftext|>", "日本語 текст 🙂👍🏽", "\0 \0b b", " lead", "trail ", "!!!???###", "a\r\nb\x85c \t\nd", "é ́x", "don''s 's", "x'S 'LL"]


def test_encoder_equals_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = tokenizers.Tokenizer.from_file(path), tokenstore.Encoder(path, cache=3)
    for _ in range(2):  # the second time after the cache was trimmed
        ids, counts = own.encode(ODD)
        stops = np.cumsum(counts)
        assert [ids[b - n : b].tolist() for n, b in zip(counts, stops, strict=True)] == [tok.encode(x, add_special_tokens=False).ids for x in ODD]


def test_codec_equals_library(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = tokenizers.Tokenizer.from_file(path), bpe.Codec(path, cache=3)
    for _ in range(2):
        ids, counts, _ = own.encode(ODD)
        stops = np.cumsum(counts)
        for x, n, b in zip(ODD, counts, stops, strict=True):
            expected = tok.encode(x, add_special_tokens=False).ids
            assert ids[b - n : b].tolist() == expected, x
            assert own.decode(ids[b - n : b]).decode() == tok.decode(expected, skip_special_tokens=False)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for i, t in enumerate(texts):
        e = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(e), sha(np.array(e, np.uint32).tobytes()), sha(tok.decode(e, skip_special_tokens=False).encode()))


def same(spark_rows, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    expected = con.execute(sql).to_arrow_table()
    names = sorted(expected.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(n).to_pylist() for n in names), strict=True)))
    assert rows(spark_rows.toArrow()) == rows(expected)


def test_rules_equal_sql(docs):
    found = rules.judged(docs.drop("n")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same(found, rules.sql(), documents=docs)


def test_chat_equals_sql_and_round_trips(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>\n\\"), (1, 1, "assistant", "a\\<|im_sep|>"), (1, 2, "assistant", "[INST]</s>"), (1, 2, "assistant", "[INST]</s>"),
        (2, 5, "user", None), (2, 5, None, "x"), (None, 1, "assistant", "é🙂"), (3, None, "system", ""), (3, 1, "assistant", "<<SYS>> \\\\ <\\s>"),
    ]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    table.createOrReplaceTempView("probe_rows")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]", ""), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "")], table.schema)
    same(chat.digests(table.unionByName(extra)), chat.SQL, conversations=table)
    turns = chat.read_back(chat.formatted(table)).where("conv_id = 1").first()["turns"]
    assert [tuple(t) for t in turns] == [(r[2], r[3]) for r in rows[:4]]
    whole = chat.read_back(chat.formatted(table)).where("conv_id = 1").first()["formatted"]
    assert whole.count("<|im_start|>") == 2 and whole.count("<|im_sep|>") == 2
    controls = "a<|endoftext|><|startoftext|>\\<|eot_id|>[INST]<</SYS>>" * 500
    odd = chat.read_back(chat.formatted(spark.createDataFrame([(1, 0, controls, controls)], "conv_id long, turn long, role string, text string"))).first()
    assert tuple(odd["turns"][0]) == (controls, controls)
    assert not any(x in odd["formatted"] for x in ("<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "[INST]", "<</SYS>>"))
    assert chat.digests(table.limit(0)).count() == 0


def test_quality_and_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.95 * len(scored) > 30
    pred = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in pred) >= 0.97 * len(pred) > 100


def test_classifiers_on_odd_rows(spark, docs, texts):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))] + [(None, 1, 0), (3, None, 0), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(docs, labels.where("false")).where("predicted = 1").count() == len(texts)
    found = {r.doc_id: r for r in langid.identified(docs).collect()}
    assert found[0].lang_pred == found[1].lang_pred == found[2].lang_pred == "und" and found[3].lang_pred == "en"
    assert langid.identified(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id < 0")).count() == 0


def test_lcs_against_brute_force():
    rng = np.random.default_rng(0)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for n in (1, 5, 63, 64, 65, 130):
        item, windows = rng.integers(0, 9, n), rng.integers(-1, 9, (8, 70))
        assert decontam.lcs(item, windows).tolist() == [brute(item, [w if w >= 0 else -9 for w in row]) for row in windows]


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: [rng.choice(WORDS) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 50)) for _ in range(30)]
    rows, expected = [], set()
    for i in range(200):
        body = text(rng.choice([5, 40, 300]))
        if i % 4 == 0:
            k = rng.randrange(30)
            leak = list(items[k])
            if i % 8 == 0:  # a paraphrase: a word changed, one put in
                leak[rng.randrange(len(leak) - 6)] = "changed"
                leak.insert(rng.randrange(len(leak) - 6), "extra")
            at = rng.randint(0, len(body))
            body = [*body[:at], *(w.upper() if rng.random() < 0.2 else w for w in leak), *body[at:]]
            expected.add((i, k))
        rows.append((i, " ".join(body), "x", 0.5))
    rows += [(200, None, "x", 0.5), (201, "", "x", 0.5), (None, " ".join(items[0]), "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, terms string, share double")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()}
    assert got == expected | {(None, 0)}
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(202)) - {d for d, _ in expected}
    assert decontam.matches(docs, bench.where("false")).count() == 0
    assert decontam.matches(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("name", ["op1_token_store", "op2_bpe_pair_index", "op3_substring_dedup", "op5_quality_rules", "op9_simhash_near_dedup"])
def test_empty_documents(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def held_items(texts, items):
    """Brute force: (text, item) where any window of the text holds the item by the rule of verification."""
    bench = decontam.Benchmark(list(enumerate(items)))
    numbers = [bench.number(decontam.terms([t])[0]) for t in texts]
    cut = [x[a : a + decontam.LENGTH] for x in numbers for a in range(0, len(x), decontam.LENGTH)]
    df = sum(np.bincount(np.unique(x), minlength=bench.size + 1)[: bench.size] for x in cut)
    idf = np.log((1 + len(cut)) / (1 + df)).astype(np.float32)
    out = set()
    for k, item in enumerate(bench.items):
        n, w, weight, answer = len(item), int(np.ceil(decontam.SLACK * len(item))), idf[item], item[-decontam.ANSWER :]
        for i, x in enumerate(numbers):
            rows = np.stack([x[a : a + w] for a in range(max(len(x) - w, 0) + 1)])
            share, last = decontam.lcs(item, rows) / n, decontam.lcs(answer, rows) / len(answer)
            if any(s >= decontam.SAME or s >= decontam.ALIKE and a >= decontam.ALIKE and weight[np.isin(item, r)].sum() >= decontam.MASS * weight.sum() for s, a, r in zip(share, last, rows, strict=True)):
                out.add((i, k))
    return out


def changed(rng, item, share, words):
    """The item with a share of its terms replaced, or followed by others, all but the last six."""
    out, insert = [], rng.random() < 0.3
    for j, w in enumerate(item):
        hit = j < len(item) - 6 and rng.random() < share
        out += [w, rng.choice(words)] if hit and insert else [rng.choice(words)] if hit else [w]
    return out


def test_decontamination_of_paraphrases_against_brute_force(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    text = lambda n: [rng.choice(WORDS) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [text(rng.randint(15, 50)) for _ in range(12)]
    texts = []
    for i in range(300):
        body = text(rng.choice([5, 60, 150]))
        at = rng.randint(0, len(body))
        texts.append(" ".join([*body[:at], *(changed(rng, items[i % 12], rng.choice([0.15, 0.25, 0.35]), words) if i % 3 else []), *body[at:]]))
    expected = held_items(texts, [" ".join(x) for x in items])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == expected
    assert 120 < len(expected) < 200


def test_decontamination_by_items_longer_than_a_passage(spark):
    rng = random.Random(33)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: [rng.choice(WORDS) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [text(n) for n in (24, 79, 190, 300, 363, 1200)]
    texts = []
    for i in range(90):
        body, item = text(rng.choice([0, 60, 400])), items[i % 6]
        at = rng.randint(0, len(body))
        leak = [item, changed(rng, item, 0.25, words), item[: len(item) // 2]][i // 6 % 3]  # copies, paraphrases, and halves, which are neither
        texts.append(" ".join([*body[:at], *leak, *body[at:]]))
    expected = held_items(texts, [" ".join(x) for x in items])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == expected
    assert {(i, i % 6) for i in range(90) if i // 6 % 3 == 0} <= expected


def test_substring_paths_do_not_depend_on_pieces(texts, monkeypatch):
    data = [(t or "").encode() for t in texts]
    whole = substring.paths_of(data, 35, 10)
    monkeypatch.setattr(substring, "_PLACE_BITS", 7)  # the texts are longer than 128 words
    pieces = substring.paths_of(data, 35, 10)
    assert len(whole[0]) > 100 and all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_substring_anchors_past_24_bits():
    grams = np.random.default_rng(1).integers(0, 1 << 63, (1 << 24) + 500).astype(np.uint64)
    at = substring.anchors(grams, 26)
    assert len(at) == len(grams) - 25
    for p in [0, *range((1 << 24) - 60, len(at), 7), len(at) - 1]:
        assert at[p] == p + int((grams[p : p + 26] >> np.uint64(24)).argmin())


def test_decontamination_in_groups_and_by_row(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randrange(400)}" for _ in range(n))
    items = [(i, text(30)) for i in range(6)]
    assert [b.ids for b in decontam.groups(items, 1)] == [[i] for i in range(6)]
    assert [i for b in decontam.groups(items, 60) for i in b.ids] == list(range(6)) and all(b.size <= 60 for b in decontam.groups(items, 60))
    rows = [(None, text(50)), (None, f"{text(20)} {items[0][1]} {text(9)}"), (7, text(50)), (7, f"{text(9)} {items[4][1]}"), (8, items[5][1])]
    docs, bench = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string"), spark.createDataFrame(items, "item_id long, text string")
    old = decontam.groups.__defaults__
    decontam.groups.__defaults__ = (60,)
    try:
        assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()} == {(None, 0), (7, 4), (8, 5)}
        assert sorted((r.doc_id or 0, r.text, r.hash) for r in decontam.clean(docs, bench).collect()) == sorted((i or 0, t, "x") for i, t in (rows[0], rows[2]))
    finally:
        decontam.groups.__defaults__ = old
