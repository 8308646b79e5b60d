"""Scenarios of an object store's behaviour on small frames."""

import datetime as dt
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lakecat.functions import exprs
from lakecat.operators import audit, checksums, governance, lifecycle, listing, notify, outbox, parts, registry, versions

T = dt.datetime.fromisoformat


def objects(spark, rows):
    """(key, size, created, tags) in bucket b."""
    schema = "bucket string, key string, size long, upload_status string, created_at timestamp_ntz, tags map<string,string>, storage_class string, upload_id string, object_id long"
    return spark.createDataFrame([("b", k, s, "COMPLETED", T(c), t, None, None, i) for i, (k, s, c, t) in enumerate(rows)], schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def now(text):
    return F.lit(text).cast("timestamp_ntz")


def rule(spark, **r):
    return lifecycle.rules_frame(spark, [{"bucket": "b", "rule_pos": 0, "id": "r"} | r])


def test_delimiter_rolls_up(spark):
    rows = spark.createDataFrame([("b", "my/x"), ("b", "my/test/y"), ("b", "my.txt")], "bucket string, key string")
    assert [r.common_prefix for r in listing.common_prefixes(rows).collect()] == ["my/"]
    assert [r.key for r in listing.with_common_prefix(rows).where("common_prefix IS NULL").collect()] == ["my.txt"]


@pytest.mark.parametrize(("prefix", "key", "expected"), [("", "a/b/c", "a/"), ("a/", "a/b/c", "a/b/"), ("fo", "foo/bar", "foo/"), ("a/", "a/b", None)])
def test_common_prefix_counts_segments(spark, prefix, key, expected):
    assert one(spark, exprs.common_prefix(F.lit(key), prefix, "/")) == expected


def test_version_pages_share_their_budget(spark):
    rows = spark.createDataFrame([("b", "a/one.txt", "1"), ("b", "a/two.txt", "2"), ("b", "b/two.txt", "3"), ("b", "c", "4")], "bucket string, key string, version_id string")
    first = listing.list_versions(rows, page=1).collect()
    assert [(r.common_prefix, r.is_truncated) for r in first] == [("a/", True)]
    rest = listing.list_versions(rows, key_marker="a/two.txt", page=2).collect()
    assert sorted((r.common_prefix or r.key, r.is_truncated) for r in rest) == [("b/", False), ("c", False)]


@pytest.mark.parametrize(("moment", "gone"), [("2026-07-01 23:59:59", []), ("2026-07-02 00:00:00", ["a"])])
def test_expiry_rounds_to_midnight(spark, moment, gone):
    rows = objects(spark, [("a", 1, "2026-06-28T10:30:00", {})])
    assert [r.key for r in lifecycle.expirations(rows, rule(spark, exp_days=3), now(moment)).collect()] == gone


def test_expiry_by_size_and_tag(spark):
    rows = objects(spark, [("big-dev", 500, "2026-01-01", {"env": "dev"}), ("big-prod", 500, "2026-01-01", {"env": "prod"}), ("small-dev", 5, "2026-01-01", {"env": "dev"})])
    found = lifecycle.expirations(rows, rule(spark, exp_days=3, want_tags={"env": "dev"}, size_gt=100), now("2026-01-11"))
    assert [r.key for r in found.collect()] == ["big-dev"]


def test_most_advanced_transition_and_priority(spark):
    rows = objects(spark, [("a", 1, "2026-01-01", {})])
    moves = rule(spark, transitions=[(30, None, "STANDARD_IA"), (90, None, "GLACIER")])
    assert [r.to_class for r in lifecycle.transitions(rows, moves, now("2026-04-12")).collect()] == ["GLACIER"]
    both = rule(spark, transitions=[(3, None, "GLACIER")], exp_days=5)
    assert [r.action for r in lifecycle.plan(rows, None, both, now("2026-01-11")).collect()] == ["EXPIRE"]


def history(spark, rows):
    return spark.createDataFrame([("b", k, v, T(at), dm, 1) for k, v, at, dm in rows], "bucket string, key string, version_id string, last_modified timestamp_ntz, is_delete_marker boolean, size long")


def test_noncurrent_expiry(spark):
    rows = history(spark, [
        ("logs/a", "v4", "2026-01-30T23:00:00", False), ("logs/a", "v3", "2026-01-21", False), ("logs/a", "v2", "2026-01-11", False),
        ("logs/a", "v1", "2026-01-01", False), ("logs/a", "v0", "2025-12-20", True), ("data/a", "w", "2026-01-01", False),
    ])
    found = lifecycle.noncurrent_expirations(rows, rule(spark, prefix="logs/", nc_days=3, nc_newer=1), now("2026-01-31"))
    assert [(r.key, r.version_id) for r in found.collect()] == [("logs/a", "v1")]


def test_age_counts_from_the_successor(spark):
    rows = history(spark, [("recent", "2", "2026-01-30T23:00:00", True), ("recent", "1", "2025-01-01", False), ("old", "4", "2026-01-21", True), ("old", "3", "2025-01-01", False)])
    found = lifecycle.noncurrent_expirations(rows, rule(spark, nc_days=3), now("2026-01-31"))
    assert [(r.key, r.version_id) for r in found.collect()] == [("old", "3")]


def test_lone_delete_markers(spark):
    rows = history(spark, [("lone", "1", "2026-01-01", True), ("kept", "2", "2026-01-02", True), ("kept", "1", "2026-01-01", False)])
    assert [r.key for r in lifecycle.expired_markers(rows, rule(spark, expired_markers=True)).collect()] == ["lone"]


def test_reconcile_and_registry_guards(spark):
    live = spark.createDataFrame([("p0",), ("p1",)], "part_id string")
    held = spark.createDataFrame([("p0", 99), ("extra", 7)], "part_id string, ref_count long")
    assert {(r.part_id, r.action, r.refs) for r in registry.reconcile(live, held).collect()} == {("p0", "UPDATE", 1), ("p1", "INSERT", 1), ("extra", "DELETE", 0)}
    counts = spark.createDataFrame([("condemned", 0), ("one", 1)], "part_id string, ref_count long")
    deltas = spark.createDataFrame([("condemned", 1), ("one", -2), ("missing", -1)], "part_id string, delta long")
    assert {(r.part_id, r.ref_count, r.applied) for r in registry.apply_deltas(counts, deltas).collect()} == {("condemned", 0, False), ("one", 1, False)}


def test_declared_parts(spark):
    stored = spark.createDataFrame([(u, p, f"e{p}") for u in range(5) for p in (1, 2)], "object_id long, part_number long, etag string")
    rows = [(0, 1, "e1", 0), (0, 2, "e2", 1), (1, 1, "bad", 0), (1, 2, "e2", 1), (2, 1, "e1", 0), (3, 2, "e2", 0), (3, 1, "e1", 1), (4, 1, "e1", 0), (4, 2, "e2", 1), (4, 3, "e3", 2)]
    found = parts.check_declared(stored, spark.createDataFrame(rows, "object_id long, part_number long, etag string, pos long"))
    assert {r.object_id: r.verdict for r in found.collect()} == {0: "ok", 1: "InvalidPart", 2: "InvalidPart", 3: "InvalidPartOrder", 4: "InvalidPart"}


def test_crc_of_joined_contents(spark):
    a, b = b"some content", b"and some more of it" * 50
    for kind in checksums.POLYNOMIALS:
        x, y, whole = (int(v) for v in checksums.crc(kind, [a, b, a + b]))
        assert checksums.combine(kind, x, y, len(b)) == whole
    assert int(checksums.crc("crc32", [a])[0]) == zlib.crc32(a)
    assert int(checksums.crc("crc32c", [b"123456789"])[0]) == 0xE3069283
    assert int(checksums.crc("crc64nvme", [b"123456789"])[0]) == 0xAE8B14860A799888
    assert checksums.crc("crc32", []).tolist() == [] and int(checksums.crc("crc32", [b""])[0]) == 0


def test_multipart_etag(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "object_id long, part_number long, content string")
    raw = b"".join(hashlib.md5(x).digest() for x in (b"a", b"b"))
    assert parts.multipart_etag(rows).first()["etag"] == f'"{hashlib.md5(raw).hexdigest()}-2"'


def test_notification_filters(spark):
    rules = spark.createDataFrame([("b", 0, "q", ["s3:ObjectCreated:*"], ["images/"], [".jpg"])], notify.RULES)
    rows = [(0, "s3:ObjectCreated:Put", "b", "images/a.jpg"), (1, "s3:ObjectRemoved:Delete", "b", "images/a.jpg"), (2, "s3:ObjectCreated:Put", "b", "images/a.png")]
    assert [r.id for r in notify.fan_out(spark.createDataFrame(rows, "id long, event_name string, bucket string, key string"), rules).collect()] == [0]


def test_overlay_and_backoff(spark):
    base = spark.createDataFrame([(1,), (2,)], "part_id long")
    log = spark.createDataFrame([(1, 1, "PUT", 1), (2, 1, "DELETE", 4), (3, 3, "DELETE", 9), (4, 3, "PUT", 12)], "id long, part_id long, operation string, attempts int")
    assert sorted(r.part_id for r in outbox.overlay(base, log).collect()) == [2, 3]
    assert {r.attempts: (r.delay_seconds, r.dead) for r in outbox.retries(log, 300, 12).collect()} == {1: (1, False), 4: (8, False), 9: (256, False), 12: (None, True)}


def test_chunks_in_order(spark):
    entries = spark.createDataFrame([(1,), (2,)], "id long")
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "id long, chunk_index int, content string")
    assert {r.id: r.content for r in outbox.chunks_joined(entries, chunks).collect()} == {1: "ab", 2: ""}


def test_chain_and_merkle(spark):
    rows = [(i, T("2026-01-01") + dt.timedelta(hours=i), "op", "me", "success", "", 1) for i in range(60)]
    log = spark.createDataFrame(rows, "id long, ts timestamp_ntz, operation string, actor string, outcome string, error string, user_id long")
    fields = audit.content_hash("id", "operation", "actor", "outcome")
    kind = F.col("entry_type")
    hash_ = F.when(kind == audit.GENESIS, audit.content_hash("entry_type")).when(kind == audit.GROUNDING, audit.content_hash("entry_type", "merkle_root")).otherwise(fields)
    sound = audit.linked(audit.grounded(audit.numbered(log), fields, 25), "seed", 25).cache()
    assert [r.entry_type for r in sound.orderBy("n").collect()] == ["GENESIS", *["LOG"] * 25, "GROUNDING", *["LOG"] * 25, "GROUNDING", *["LOG"] * 10]
    problems = lambda x: sorted((r.n, r.problem) for r in audit.verified(x, hash_, "seed", 25).collect())
    assert problems(sound) == []
    change = lambda n, c, v: sound.withColumn(c, F.when(F.col("n") == n, F.lit(v)).otherwise(F.col(c)))
    assert problems(change(30, "previous_hash", "x")) == [(30, "chain")]
    assert problems(change(30, "actor", "you")) == [(30, "hash")]
    assert problems(change(0, "previous_hash", "x")) == [(0, "genesis")]
    assert problems(sound.where("n <> 40")) == [(41, "chain"), (52, "interval")]
    shifted = sound.where("n <> 26").withColumn("n", F.when(F.col("n") > 26, F.col("n") - 1).otherwise(F.col("n")))
    assert problems(shifted) == [(26, "chain"), (51, "interval"), (52, "ungrounded")]
    forged = sound.withColumn("merkle_root", F.when(F.col("n") == 26, "00").otherwise(F.col("merkle_root"))).withColumn("hash", F.when(F.col("n") == 26, hash_).otherwise(F.col("hash")))
    assert problems(forged) == [(26, "root"), (27, "chain")]
    hashes = [bytes.fromhex(r.hash) for r in sound.where("entry_type = 'LOG' AND n < 26").orderBy("n").collect()]
    assert sound.where("n = 26").first().merkle_root == audit.merkle_root(hashes).hex()
    three = [b"a", b"b", b"c"]
    up = lambda x, y: hashlib.sha512(x + y).digest()
    assert audit.merkle_root(three) == up(up(b"a", b"b"), up(b"c", b"c"))


@pytest.mark.parametrize(("header", "expected"), [("bytes=0-9", (0, 10)), ("bytes=95-", (95, 100)), ("bytes=-30", (70, 100)), ("bytes=-300", (0, 100)), ("bytes=50-999", (50, 100)), ("bytes=100-", None), ("bytes=9-3", None), ("lines=1-2", None)])
def test_byte_ranges(spark, header, expected):
    found = one(spark, exprs.byte_range(F.lit(header), F.lit(100).cast("long")))
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize(("expr", "expected"), [
    (lambda: exprs.max_keys(F.lit("0")), 1000), (lambda: exprs.max_keys(F.lit("7")), 7), (lambda: exprs.max_keys(F.lit("x")), 1000), (lambda: exprs.max_keys(F.lit("5000")), 1000),
    (lambda: exprs.wildcard_match(F.lit("https://*.a"), F.lit("https://x.a")), True), (lambda: exprs.wildcard_match(F.lit("ab*ba"), F.lit("aba")), False),
    (lambda: exprs.in_cidr(F.lit("10.1.2.3"), F.lit("10.1.0.0/16")), True), (lambda: exprs.in_cidr(F.lit("10.2.2.3"), F.lit("10.1.0.0/16")), False),
    (lambda: exprs.parse_tagging(F.lit("a=1&b=x%20y")), {"a": "1", "b": "x y"}), (lambda: exprs.parse_tagging(F.lit("a=1&a=2")), None),
    (lambda: exprs.valid_tags(F.create_map(F.lit("k"), F.lit("v"))), True), (lambda: exprs.valid_tags(F.create_map(F.lit(""), F.lit("v"))), False),
    (lambda: exprs.valid_bucket_name(F.lit("my-bucket.a")), True), (lambda: exprs.valid_bucket_name(F.lit("192.168.0.1")), False), (lambda: exprs.valid_bucket_name(F.lit("a--b")), False),
    (lambda: exprs.ulid_time_ms(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV")), 1469922850259),
    (lambda: exprs.fill_template(F.lit("{bucket}/{key}"), {"bucket": F.lit("b"), "key": F.lit("k")}), "b/k"),
    (lambda: exprs.copy_allowed(F.lit("e"), F.lit("2026-01-01 10:00:00.9").cast("timestamp"), F.lit(None), F.lit(None), F.lit(None), F.lit("2026-01-01 10:00:00").cast("timestamp")), True),
])
def test_scalar_rules(spark, expr, expected):
    assert one(spark, expr()) == expected


def test_row_policy_and_compression(spark):
    rows = spark.createDataFrame([("a", "x" * 5000), ("b", "short")], "key string, content string")
    assert [r.key for r in governance.authorized_by(rows, lambda f: f["key"] == "a", ["key"]).collect()] == ["a"]
    assert {r.key: r.compress for r in governance.worth_compressing(rows).collect()} == {"a": True, "b": False}


def test_folds(spark):
    log = spark.createDataFrame([("b", "k", 1, "PUT", 5), ("b", "k", 2, "DELETE", None), ("b", "j", 3, "PUT", 7)], "bucket string, key string, id long, op string, size long")
    assert [(r.key, r.size) for r in versions.fold(log, "disabled").collect()] == [("j", 7)]
    assert sorted((r.key, r.is_delete_marker) for r in versions.fold(log, "suspended").collect()) == [("j", False), ("k", True)]
    assert sorted((r.key, r.version_id, r.is_latest) for r in versions.fold(log, "enabled").collect()) == [("j", "3", True), ("k", "1", False), ("k", "2", True)]
    counted = versions.replay(log, lambda f: f.head(1).assign(n=len(f))[["key", "n"]], "key string, n long")
    assert sorted((r.key, r.n) for r in counted.collect()) == [("j", 1), ("k", 2)]
    held = spark.createDataFrame([(1, 4), (2, 5)], "id long, version long")
    asked = spark.createDataFrame([(1, 4, "x"), (2, 4, "y")], "id long, expected long, value string")
    assert [(r.id, r.version) for r in versions.compare_and_set(held, asked, "id").collect()] == [(1, 5)]
