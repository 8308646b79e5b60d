import datetime as dt

from lakecat.operators import notify, outbox
from lakecat.sources import io
from lakecat.streaming import change_log


def test_outbox_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 7, "DELETE" if i % 3 == 0 else "PUT") for i in range(100)]
    log = spark.createDataFrame(rows, "id long, part_id long, operation string").repartition(4)
    log.write.parquet(str(tmp_path / "log"))
    state: dict[int, tuple] = {}

    def apply(batch, batch_id):
        for r in batch.collect():
            if r.part_id not in state or state[r.part_id][0] < r.id:
                state[r.part_id] = (r.id, r.operation)

    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    change_log.apply_batches(stream, apply, str(tmp_path / "ckpt")).awaitTermination()
    assert state == {r.part_id: (r.id, r.operation) for r in outbox.last_entries(log).collect()}


def test_routed_and_windowed_streams(spark, tmp_path):
    rows = [(i, "s3:ObjectCreated:Put", "b", f"k{i}", dt.datetime(2026, 1, 1, 0, i)) for i in range(20)]
    events = spark.createDataFrame(rows, "id long, event_name string, bucket string, key string, ts timestamp")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    rules = spark.createDataFrame([("b", 0, "q", ["s3:ObjectCreated:*"], ["k1"], None)], notify.RULES)
    q = change_log.routed(stream, rules).writeStream.format("memory").queryName("routed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("routed").count() == 11
    q = change_log.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("windows").collect()) == [5, 5, 5, 5]


def test_sources(spark, tmp_path):
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "p1").write_bytes(b"abc")
    assert [(r.part_id, bytes(r.content)) for r in io.blobs(spark, str(tmp_path / "blobs")).collect()] == [("p1", b"abc")]
    chunks = spark.createDataFrame([("p", 1, bytearray(b"b")), ("p", 0, bytearray(b"a"))], "part_id string, chunk_index int, content binary")
    assert bytes(io.chunked_blobs(chunks).first()["content"]) == b"ab"
    rows = spark.createDataFrame([("b1", "k"), ("b2", "k")], "bucket string, key string")
    io.write_buckets(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["bucket=b1", "bucket=b2"]
    io.write_json_log(rows, str(tmp_path / "json"))
    assert io.read_json_log(spark, str(tmp_path / "json"), "bucket string, key string").count() == 2
