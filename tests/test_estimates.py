"""Sizes, uncertainty, scaling, label normalisation and identification against worked cases."""

import math

from pyspark.sql import functions as F

from geosweep.operators import estimates as est
from geosweep.operators import shapes
from geosweep.operators import tracking


def test_utm_known_points(spark):
    # central meridian of zone 31 on the equator, and a point whose coordinates are published widely (CN Tower, zone 17)
    rows = spark.createDataFrame([(3.0, 0.0), (-79.387139, 43.642567), (3.0, -1.0)], "lon double, lat double")
    zone = est.utm_zone("lon")
    got = [tuple(r) for r in rows.select(zone, *est.utm("lon", "lat", zone)).collect()]
    assert got[0] == (31, 500_000.0, 0.0)
    assert got[1][0] == 17 and math.hypot(got[1][1] - 630_084, got[1][2] - 4_833_438) < 2
    assert got[2][2] > 9_880_000
    assert spark.range(1).select(est.utm_zone(F.lit(180.0)), est.utm_zone(F.lit(-180.0))).first()[:] == (60, 1)


def test_rotated_size(spark):
    turn, box = math.radians(30), [(0, 0), (10, 0), (10, 4), (0, 4)]
    ring = [(x * math.sin(turn) - y * math.cos(turn), x * math.cos(turn) + y * math.sin(turn)) for x, y in box]
    cases = [ring, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], [(0.0, 0.0), (3.0, 0.0)], [(0.0, 0.0)], [], None, [(0.0, 0.0), (6.0, 0.0), (6.0, 0.0), (3.0, 2.0)]]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, ring array<struct<x:double,y:double>>")
    got = {r["i"]: r["s"] for r in rows.select("i", shapes.rectangle_of("ring").alias("s")).collect()}
    assert (got[0]["length_m"], got[0]["width_m"], got[0]["bearing_deg"]) == (10.0, 4.0, 30.0)
    assert got[1] is got[2] is got[3] is got[4] is got[5] is None
    assert got[6]["length_m"] * got[6]["width_m"] < 12.01


def test_outline_without_area(spark):
    schema = "ring array<struct<lon:double,lat:double>>, w double, h double, px int"
    rows = spark.createDataFrame([(None, 1.0, 1.0, 4), ([], 1.0, 1.0, 4), ([(1.0, 1.0)], 1.0, 1.0, 0)], schema)
    for r in est.estimated_sizes(rows, "ring", "w", "h", "px").collect():
        assert r["length_m"] is None and r["area_m2"] is None and r["length_error_m"] is None
    assert est.estimated_sizes(rows.limit(0), "ring", "w", "h", "px").count() == 0


def test_scaled_bands(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.1), ("a", float("nan")), ("a", None), ("b", -15.0), ("b", 4.0), ("b", None), ("c", 3000.0)], "image string, v double")
    got = [(r["image"], round(r["sar"], 6), r["reflectance"]) for r in est.scaled_bands(rows, ["image"], "v").orderBy("image", F.desc("v")).collect()]
    assert sorted(s for i, s, _ in got if i == "a") == [0.0, 0.0, 0.666667, 1.0]
    assert sorted(s for i, s, _ in got if i == "b") == [0.0, 0.5, 1.0]
    assert [round(x, 6) for i, _, x in got if i == "c"] == [0.3]


def test_labels_and_identities(spark):
    objects = spark.createDataFrame([("T1", "Main Battle Tank", "tank on tracks", "Ground"), ("T2", "main-battle tank", "x", "Other2")], "object_id string, label string, prompt string, branch_id string")
    rows = spark.createDataFrame([(1, "main_battle_tank"), (2, "DOTA_Main Battle Tank"), (3, "Tank on  Tracks"), (4, "t2"), (5, "patrol boat"), (6, "odd thing"), (7, None), (8, " ")], "i int, label string")
    out = est.normalise_labels(rows, "label", objects, [("Sea", "boat"), ("Any", "patrol")])
    got = {r["i"]: (r["branch_id"], r["object_id"], r["canonical_label"], r["was_unknown"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("Ground", "T1", "Main Battle Tank", False)
    assert got[4] == ("Other2", "T2", "main-battle tank", False) and got[5] == ("Sea", None, "patrol boat", False)
    assert got[6] == ("Other", None, "odd thing", True) and got[7] == got[8] == ("Other", None, "unknown", True)

    scores = spark.createDataFrame([(1, 9, 0.9), (1, 8, 0.9), (1, 7, 0.1), (1, 6, 0.05), (2, 5, 0.84)], "item int, c int, s double")
    got = {(r["item"], r["c"]): (r["rank"], r["status"]) for r in est.identified(scores, "item", "c", "s").collect()}
    assert got == {(1, 8): (1, "auto_applied"), (1, 9): (2, "pending"), (1, 7): (3, "pending"), (2, 5): (1, "pending")}


def test_states_of_tracks(spark):
    cases = [("air", 0.2, None), ("air", 21.0, None), ("air", 21.0, " GROUND "), ("rail", 99.0, None), ("maritime", None, ""), (None, 1.0, None)]
    rows = spark.createDataFrame(cases, "category string, speed double, given string").withColumn("state", tracking.state("category", "speed", "given"))
    radius = tracking.gate("category", F.lit(5.0), F.lit(0.0), F.lit(10.0), "state")
    got = [tuple(r) for r in rows.select("state", tracking.speed_limit("category", "state"), tracking.noise("category", "state"), F.round(radius, 6)).collect()]
    assert [g[0] for g in got] == ["stationary", "airborne", "ground", "default", "default", "default"]
    assert [g[1] for g in got] == [1.0, 300.0, 14.0, 16.0, 16.0, 16.0] and [g[2] for g in got] == [0.1, 10.0, 1.5, 2.0, 1.0, 2.0]
    # three sigmas where the state is slow, travel where it is fast
    assert got[0][3] == round(3 * math.sqrt(25 + 25), 6) and got[1][3] == 3750.0
