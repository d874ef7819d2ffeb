"""The store: merges, tombstones, replays, versions; and the feed's fan-out with late and repeated events."""

import datetime as dt

from pyspark.sql import functions as F

from geosweep.functions import geo
from geosweep.operators import store
from geosweep.operators.graph import rank_nodes
from geosweep.sources import readers
from geosweep.streaming import events

SCHEMA = "det_id long, pass_id long, cls string, confidence double"


def noon():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def state(df):
    return {r["det_id"]: (r["cls"], r["confidence"]) for r in df.collect()}


def test_merges_and_tombstones(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", SCHEMA)
    assert s.version() == 0 and s.live().collect() == []
    assert s.merge(rows(spark, (1, 1, "a", 0.5), (2, 1, "b", 0.6), (3, 2, "c", 0.7)), "e1") == 1
    # values replace, nulls leave, new keys come in; the other partition is not written again
    assert s.merge(rows(spark, (2, 1, None, 0.9), (4, 1, "d", None)), "e2") == 2
    assert state(s.live()) == {1: ("a", 0.5), 2: ("b", 0.9), 3: ("c", 0.7), 4: ("d", None)}
    assert {r["partition"] for r in s.log().where("version = 2").collect()} == {1}
    # a replayed epoch changes nothing
    assert s.merge(rows(spark, (2, 1, "z", 0.0)), "e2") == 2 and s.version() == 2
    gone = spark.createDataFrame([(1, 1), (3, 2), (77, 2)], "det_id long, pass_id long")
    assert s.tombstone(gone, "e3", noon()) == 3
    assert set(state(s.live())) == {2, 4} and s.rows().count() == 4
    # the first time of a tombstone stays, and a merge brings a row back
    s.tombstone(gone, "e4", F.lit("2025-01-01").cast("timestamp"))
    assert {r["deleted_at"] for r in s.rows().where("det_id IN (1, 3)").collect()} == {dt.datetime(2024, 1, 1, 12)}
    s.merge(rows(spark, (3, 2, "again", 0.1)), "e5")
    assert state(s.live()) == {2: ("b", 0.9), 4: ("d", None), 3: ("again", 0.1)}
    # a pass that is processed again
    s.replace(rows(spark, (2, 1, "new", 0.3), (9, 1, "new", 0.2), (9, 1, "new", 0.2)), "e6", noon())
    assert state(s.live()) == {2: ("new", 0.3), 9: ("new", 0.2), 3: ("again", 0.1)} and s.rows().count() == 5
    assert state(s.live(version=1)) == {1: ("a", 0.5), 2: ("b", 0.6), 3: ("c", 0.7)}
    assert s.merge(rows(spark), "e7") == 7 and s.live().count() == 3
    # a pass in which nothing is found any more, and one that never was
    s.replace(rows(spark), "e8", noon(), [2, 55])
    assert set(state(s.live())) == {2, 9} and s.rows().count() == 5


def test_a_step_broken_off_is_not_seen(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", SCHEMA)
    s.merge(rows(spark, (1, 1, "a", 0.5)), "e1")
    rows(spark, (8, 1, "half", 0.5)).withColumn("deleted_at", F.lit(None).cast("timestamp")).write.parquet(f"file://{tmp_path}/s/data/version=2/part=1")
    assert state(s.live()) == {1: ("a", 0.5)}
    assert s.merge(rows(spark, (2, 1, "b", 0.5)), "e2") == 2 and set(state(s.live())) == {1, 2}


def test_feed_batches_fan_out_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame(
        [(1, "move", 24.0, 54.0, at, '{"mmsi": "m1", "confidence": "0.9"}'), (1, "move", 24.1, 54.1, at, '{"mmsi": "m1"}'), (2, "note", None, None, at, "{}")],
        "source_id long, event_type string, latitude double, longitude double, observed_at timestamp, payload string",
    )
    for _ in range(2):  # the second time is a replay of the same epoch
        events.fan_out(batch, 0, f"{tmp_path}/out")
    events.fan_out(batch.where("source_id = 2"), 1, f"{tmp_path}/out")
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert [read(n).count() for n in ("feed_events", "tracks", "track_points", "observations", "timeline")] == [4, 1, 2, 2, 4]
    assert sorted(r["confidence"] for r in read("observations").collect()) == [0.7, 0.9] and read("tracks").first()["track_uid"] == "m1"


def test_late_rows_are_let_go(spark, tmp_path):
    """A row behind the watermark of earlier batches is in no window; one within it counts."""
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for k, hours in enumerate([[0, 1, 50], [49, 51], [2], [200]]):
        spark.createDataFrame([(at(h), "a") for h in hours], "ts timestamp, kind string").coalesce(1).write.parquet(f"{source}/{k}")
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    made = events.windowed_counts(stream, "ts", ["kind"], "1 hour", late="10 hours")
    run = made.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(sink)
    run.awaitTermination(120)
    got = {(r["start"].day - 1) * 24 + r["start"].hour: r["n"] for r in spark.read.parquet(sink).collect()}
    assert got == {0: 1, 1: 1, 49: 1, 50: 1, 51: 1}  # hour 2 came two batches after hour 50 and is gone


def test_stream_with_sites_and_repeats(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), f"k{m % 2}", 54.0 + m / 1000, 24.0) for m in range(4)], "ts timestamp, k string, lon double, lat double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string, lon double, lat double").parquet(f"{tmp_path}/in")
    sites = spark.createDataFrame([(1, 54.0, 24.0, 150.0)], "site_id int, lon double, lat double, radius_m double")
    near = events.near_sites(events.throttled(stream, "k", "ts"), sites, "radius_m")
    run = near.writeStream.format("memory").queryName("near_store").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("near_store").collect()
    assert {r["k"] for r in got} == {"k0", "k1"} and all(r["distance_m"] <= 150 for r in got) and len(got) == 2


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    ring = one(geo.square_ring(F.lit(10.0), F.lit(20.0), 0.5))
    assert [list(p) for p in ring] == [[9.5, 19.5], [10.5, 19.5], [10.5, 20.5], [9.5, 20.5], [9.5, 19.5]]
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert one(geo.iou_cxcywh(box(1, 1, 2, 2), box(2, 1, 2, 2))) == 1 / 3
    scores = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5)], "id int, s double")
    assert [(r["id"], r["rank"]) for r in rank_nodes(scores, "s", 2).collect()] == [(2, 1), (1, 2)]


def test_digests_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"x" * 1000)
    got = {r[0].rsplit("/", 1)[-1]: r[1] for r in readers.file_digests(spark, f"file://{tmp_path}/*.bin").collect()}
    assert got == {"a.bin": hashlib.sha256(b"x" * 1000).hexdigest()}


def test_binary_telemetry(spark):
    import struct

    def block(key, kind, size, count, payload):
        return key + kind + bytes([size]) + struct.pack(">H", count) + payload + b"\0" * (-len(payload) % 4)

    scal = block(b"SCAL", b"l", 4, 5, struct.pack(">5l", 10_000_000, 10_000_000, 1000, 0, 100))
    gps = lambda *fixes: block(b"GPS5", b"l", 20, len(fixes), b"".join(struct.pack(">5l", *f, 0, 0) for f in fixes))
    name = block(b"STNM", b"c", 1, 3, b"GPS")
    inner = name + scal + gps((-515_000_000, 1_200_000, 35_500), (1, 2, 3))
    assert readers.gps_blocks(inner) == [(-51.5, 0.12, 35.5)]
    body = block(b"STRM", b"\0", 1, len(inner), inner)
    nested = block(b"DEVC", b"\0", 1, len(body), body) + b"\0" * 8 + gps((10_000_000, 20_000_000, 0))
    assert readers.gps_blocks(nested) == [(-51.5, 0.12, 35.5), (1.0, 2.0, 0.0)]
    assert readers.gps_blocks(nested[:-4]) == [(-51.5, 0.12, 35.5)] and readers.gps_blocks(nested[:30]) == [] and readers.gps_blocks(b"") == []
    assert readers.gps_blocks(block(b"GPS5", b"s", 20, 1, b"\0" * 20) + block(b"GPS5", b"l", 16, 1, b"\0" * 16)) == []
    files = spark.createDataFrame([(1, nested, 8.0), (2, None, 8.0), (3, b"", None), (4, scal + gps((0, 0, 0)) * 3, None)], "clip int, content binary, duration double")
    got = sorted((r["clip"], r["t"], r["lat"]) for r in readers.gpmd_samples(files, "clip").collect())
    assert got == [(1, 0.0, -51.5), (1, 4.0, 1.0), (4, 0.0, 0.0), (4, 1.0, 0.0), (4, 2.0, 0.0)]
