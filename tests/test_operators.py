"""Operators against fixtures, invariants and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosweep.operators import detections, evaluation, graph, relational, spatial, terrain, tracking
from geosweep.sources import readers


def corridor(spark):
    pts = [(t, s, x, 25.001) for t in (1, 2) for s, x in enumerate((55.001, 55.021, 55.041))]
    return spark.createDataFrame(pts, "track_id int, seq int, lon double, lat double")


def test_od_corridor(spark):
    flows = relational.od_flows(corridor(spark), order="seq").collect()
    assert max(f["weight"] for f in flows) == 2 and len(flows) == 2
    assert relational.od_flows(corridor(spark).where("track_id = 1"), min_flow=2, order="seq").count() == 0


def test_od_matrix(spark):
    m = spark.createDataFrame([(0, [5.0, 3.0]), (1, [0.0, 9.0])], "i int, values array<double>")
    assert [tuple(r) for r in relational.matrix_edges(m, 1).collect()] == [(0, 1, 3.0)]


def test_upsert_keeps_old_where_null(spark):
    old = spark.createDataFrame([(1, "a", "x", 1)], "k int, v string, w string, at int")
    new = spark.createDataFrame([(1, None, "y", 2), (2, "b", None, 2)], "k int, v string, w string, at int")
    got = sorted(map(tuple, relational.upsert(old, new, ["k"], "at", True).select("k", "v", "w").collect()))
    assert got == [(1, "a", "y"), (2, "b", None)]


def grid(spark, n, step):
    return spark.createDataFrame([(i * n + j, 54 + i * step, 24 + j * step * 1.03 + i * 0.001) for i in range(n) for j in range(n)], "id long, lon double, lat double")


def edges(df):
    return {(r["a_id"], r["b_id"]) for r in df.collect()}


def test_proximity_graphs_nest(spark):
    p = grid(spark, 5, 0.02)
    rng, gab = edges(spatial.empty_region_graph(p, "rng", 6000.0)), edges(spatial.empty_region_graph(p, "gabriel", 6000.0))
    tree = edges(spatial.minimum_spanning_tree(spatial.empty_region_graph(p, "rng", 6000.0), p.select("id")))
    mesh = edges(spatial.delaunay_graph(p.withColumn("k", F.lit(1)), "k"))
    assert tree <= rng <= gab <= mesh and len(tree) == 24


def test_radius_and_neighbours_match_brute_force(spark):
    p = grid(spark, 6, 0.013)
    rows = p.collect()

    def metres(a, b):
        s = math.sin(math.radians(b["lat"] - a["lat"]) / 2) ** 2 + math.cos(math.radians(a["lat"])) * math.cos(math.radians(b["lat"])) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(s))

    assert edges(spatial.radius_graph(p, 2500.0)) == {(a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and metres(a, b) <= 2500}
    want = {tuple(sorted((a["id"], b["id"]))) for a in rows for b in sorted((x for x in rows if x["id"] != a["id"]), key=lambda x: (metres(a, x), x["id"]))[:3]}
    assert edges(spatial.knn_graph(p, 3)) == want
    assert edges(spatial.knn_graph(p.repartition(7), 3)) == want


def test_graph_path_and_star(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "d"), ("d", "zz")], "src string, dst string")
    d = graph.density(nodes, path).first()
    assert d["n_edges"] == 3 and d["density"] == 0.5
    assert {r["component"] for r in graph.components(nodes, path).collect()} == {"a"}
    b = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, path).collect()}
    assert b["b"] == b["c"] == pytest.approx(2 / 3) and b["a"] == 0
    rank = {r["id"]: r["rank"] for r in graph.pagerank(nodes, path).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["b"] > rank["a"]
    assert [r["path"] for r in graph.shortest_paths(path, "a", "d").collect()] == [["a", "b", "c", "d"]]
    hops = {r["id"]: r["hop"] for r in graph.neighbourhood(path, nodes.where("id = 'a'"), 2).collect()}
    assert hops == {"a": 0, "b": 1, "c": 2}


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        c = rng.random((n, m))
        pairs = detections.assign(c)
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in zip(range(m), p)) for p in itertools.permutations(range(n), m))
        assert len(pairs) == min(n, m) and sum(c[i, j] for i, j in pairs) == pytest.approx(best)


BOX = "image int, cls string, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, source string"


def test_nms_is_idempotent_and_wbf_fuses(spark):
    rows = [(1, "a", 1, 10.0, 10.0, 30.0, 30.0, 0.7, "sam3"), (1, "a", 2, 11.0, 11.0, 31.0, 31.0, 0.9, "dota_obb"), (1, "a", 3, 100.0, 100.0, 120.0, 120.0, 0.5, "sam3")]
    df = spark.createDataFrame(rows, BOX)
    kept = detections.nms(df, ["image", "cls"])
    assert {r["det_id"] for r in kept.collect()} == {2, 3} == {r["det_id"] for r in detections.nms(kept, ["image", "cls"]).collect()}
    fused = sorted((r["det_id"], r["members"]) for r in detections.weighted_box_fusion(df, ["image", "cls"]).collect())
    assert fused == [(2, 2), (3, 1)]


def test_obb_iou():
    assert detections.obb_iou([0, 0, 2, 0, 2, 2, 0, 2], [1, 1, 3, 1, 3, 3, 1, 3]) == pytest.approx(1 / 7)
    assert detections.obb_iou([0, 0, 2, 0, 2, 2, 0, 2], [1, 0, 2, 1, 1, 2, 0, 1]) == pytest.approx(0.5)
    assert detections.obb_iou([0, 0], None) == 0


def test_clip_tracks(spark):
    rows = [(1, "a", f * 10 + k, 50.0 * k + f, 0.0, 50.0 * k + f + 20, 20.0, 0.9, "s", f) for f in range(4) for k in range(2)]
    out = detections.clip_tracks(spark.createDataFrame(rows, BOX + ", frame int").withColumn("clip_id", F.lit(7))).collect()
    assert {(r["det_id"] % 10, r["track"]) for r in out} == {(0, 1), (1, 2)}


def test_grid_covers(spark):
    rasters = spark.createDataFrame([(1, 3000, 1500), (2, 9000, 9000), (3, 500, 400)], "raster_id int, width int, height int")
    covered = np.zeros((1500, 3000), bool)
    for c in detections.grid_chips(rasters, block=512).where("raster_id = 1").collect():
        assert c["x"] % 512 == c["y"] % 512 == 0
        covered[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]] = True
    assert covered.all()
    few = detections.grid_chips(rasters, max_chips=20).collect()
    ranks = sorted({c["ix"] for c in few if c["raster_id"] == 2})
    rows = sorted({c["iy"] for c in few if c["raster_id"] == 2})
    assert ranks == [0, 3, 6, 8, 11] and rows == [0, 4, 7, 11] and sum(c["raster_id"] == 2 for c in few) == 20
    assert sum(c["raster_id"] == 3 for c in few) == 1 and sum(c["raster_id"] == 1 for c in few) == 8


def test_suppression_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    corner = rng.uniform(0, 1500, (300, 2))
    box = np.hstack([corner, corner + rng.uniform(5, 200, (300, 2))])
    i, j, iou = detections.overlapping(box, chunk=500)
    got = {(min(a, b), max(a, b)): v for a, b, v in zip(i.tolist(), j.tolist(), iou.tolist(), strict=True)}
    cell = np.floor((box[:, :2] + box[:, 2:]) / 2 / detections.BUCKET)
    for a in range(300):
        for b, v in enumerate(detections.iou_many(box[a], box)):
            if a < b:
                near = (abs(cell[a] - cell[b]) <= 1).all()
                assert ((a, b) in got) == bool(v > 0 and near) and abs(got.get((a, b), v) - v) < 1e-9


def test_cells_meet_near_poles_and_across_the_date_line(spark):
    rng = np.random.default_rng(4)
    lat = np.concatenate([rng.uniform(-90, 90, 200), rng.uniform(88, 90, 100), rng.uniform(-1, 1, 100)])
    lon = np.concatenate([rng.uniform(-180, 180, 300), rng.choice([-179.9, 179.9, 180.0, -180.0], 100) + rng.uniform(-0.05, 0.05, 100)])
    lon = (lon + 180) % 360 - 180
    p = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat, strict=True))], "id int, lon double, lat double")
    phi, lam = np.radians(lat), np.radians(lon)
    s = np.sin((phi[:, None] - phi) / 2) ** 2 + np.cos(phi)[:, None] * np.cos(phi) * np.sin((lam[:, None] - lam) / 2) ** 2
    d = 2 * 6_371_008.8 * np.arcsin(np.minimum(1, np.sqrt(s)))
    for metres in (30_000.0, 2_000_000.0, 15_000_000.0):
        got = {(r["a"], r["b"]) for r in spatial.radius_join(p.withColumnRenamed("id", "a"), p.withColumnRenamed("id", "b"), metres, metres).select("a", "b").collect()}
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= metres), strict=True)}


def test_spanning_tree_against_kruskal(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(1, 9, 200), strict=True) if a != b]
    root, want = list(range(60)), 0.0

    def find(x):
        return x if root[x] == x else find(root[x])

    n = 0
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want, n = want + w, n + 1
    got = spatial.minimum_spanning_tree(spark.createDataFrame(edges, "a_id int, b_id int, distance_m double"), spark.range(60).select(F.col("id").cast("int").alias("id"))).collect()
    assert (len(got), sum(r["distance_m"] for r in got)) == (n, want)


def test_truth_matching_is_one_to_one(spark):
    p = spark.createDataFrame([("a", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 2, 0.8, 1.0, 1.0, 11.0, 11.0), ("b", 3, 0.7, 0.0, 0.0, 1.0, 1.0)], "cls string, pred_id long, score double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0)], "cls string, x1 double, y1 double, x2 double, y2 double")
    got = {r["pred_id"]: r["is_tp"] for r in detections.match_truth(p, t, ["cls"]).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_gates(spark):
    g = lambda cat, dt: spark.range(1).select(tracking.gate(F.lit(cat), F.lit(5.0), F.lit(0.0), F.lit(dt)).alias("v")).first()["v"]
    assert g("infrastructure", 6000.0) == 15.0 and g("default", 6000.0) < 4_000_000 and g("ground", 0.0) == 15.0


def test_cfar_finds_a_bright_target(spark):
    db = np.random.default_rng(0).normal(-15, 1, (80, 70))
    db[40:43, 30:33] = 5
    rows = [(t, r, c, float(db[r, c]) if t else 0.0) for t, h in ((1, 80), (0, 10)) for r in range(h) for c in range(70 if t else 10)]
    tiles = spark.createDataFrame(rows, "tile int, row int, col int, db double")
    found = terrain.cfar_tiles(tiles).orderBy(F.desc("pixels")).collect()
    assert (found[0]["x1"], found[0]["y1"], found[0]["pixels"]) == (30, 40, 9) and {f["tile"] for f in found} == {1}
    # z against means and deviations taken window by window
    z = {(r["row"], r["col"]): r["z"] for r in terrain.ring_scores(tiles.where("tile = 1"), "tile", "db", 4, 20).collect()}
    wide = np.pad(db, 20, mode="reflect")
    for r, c in ((0, 0), (5, 69), (41, 31), (79, 3)):
        window = wide[r : r + 41, c : c + 41].copy()
        window[16:25, 16:25] = np.nan
        assert abs(z[r, c] - (db[r, c] - np.nanmean(window)) / max(0.1, np.nanstd(window))) < 1e-6


def test_labels_join_around_corners():
    m = np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]], bool)
    assert len(np.unique(terrain.label_mask(m))) == 3


def test_sar_change_both_ways(spark):
    rows = [(0, r, c, 1.0, 4.0 if r < 3 else 0.2 if r > 5 else 1.0) for r in range(9) for c in range(5)]
    df = spark.createDataFrame(rows, "scene int, row int, col int, before double, after double")
    got = {(r["row"], r["col"]): r["changed"] for r in terrain.sar_change(df).collect()}
    assert got[0, 0] and got[8, 4] and not got[4, 2] and len(got) == 45


def test_passes_drop_what_a_failure_interrupts(spark):
    e = [5, 12, 30, 12, 5, 20, None, 5, 15]
    df = spark.createDataFrame([(1, k * 30, None if v is None else float(v)) for k, v in enumerate(e)], "sat_id int, s int, elevation double").withColumn("t", F.timestamp_seconds("s"))
    got = [(r["max_elevation"], r["duration_s"]) for r in terrain.passes(df).orderBy("aos").collect()]
    assert got == [(30.0, 60.0), (15.0, 0.0)]


def test_line_of_sight_blocked_by_a_ridge(spark):
    pairs = spark.createDataFrame([(1, 54.0, 24.0, 100.0, 54.2, 24.0, 100.0)], "pair_id int, obs_lon double, obs_lat double, obs_elev double, tgt_lon double, tgt_lat double, tgt_elev double")
    flat = terrain.line_of_sight(pairs, lambda f: f.withColumn("elevation", F.lit(0.0))).first()
    ridge = terrain.line_of_sight(pairs, lambda f: f.withColumn("elevation", F.when(F.col("k") == 64, 500.0).otherwise(0.0))).first()
    assert flat["visible"] and not ridge["visible"] and ridge["blocking"] == 1


def test_average_precision(spark):
    p = spark.createDataFrame([("a", 1, 0.9, True), ("a", 2, 0.8, False), ("a", 3, 0.7, True)], "label string, pred_id long, score double, is_tp boolean")
    curve = evaluation.precision_recall(p, spark.createDataFrame([("a", 2)], "label string, n_gt long"))
    assert evaluation.average_precision(curve, points=None).first()["ap"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert evaluation.average_precision(curve).first()["ap"] == pytest.approx((6 + 5 * 2 / 3) / 11)


def test_feeds(spark):
    body = '{"items": [{"lat": "1.5", "lon": 2, "type": "ship", "time": "t0"}, {"latitude": 3}, 7]}'
    got = readers.json_feed(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r["event_type"], r["latitude"], r["longitude"]) for r in got] == [("ship", 1.5, 2.0), ("observation", 3.0, None)]
    geo_ = '{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[5, 6], [7, 8]]]}, "properties": {}}]}'
    r = readers.geojson_feed(spark.createDataFrame([(geo_,)], "body string")).first()
    assert (r["event_type"], r["longitude"], r["latitude"]) == ("feature", 5.0, 6.0)
    lines = spark.createDataFrame([("MSG,3,1,1,ABC,1,2024/01/01,00:00:01,,,CALL ,1000,250,90,51.5,-0.1,",), ("MSG,3,1",), ("MSG,3,1,1,ABC,1,,,,,X,,,,,,",)], "value string")
    assert [(r["hex_ident"], r["callsign"], r["latitude"]) for r in readers.adsb_feed(lines).collect()] == [("ABC", "CALL", 51.5)]


def test_replay_follows_an_object(spark):
    rows = [(0, i, i * 60, "car", "ground", 54 + i * 0.001, 24.0, 0.9) for i in range(5)] + [(0, 9, 0, "car", "ground", 60.0, 30.0, 0.9)]
    got = {r["det_id"]: r["track_id"] for r in tracking.replay(spark.createDataFrame(rows, "region int, det_id long, pass_at long, cls string, category string, lon double, lat double, confidence double"), "region").collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[9] != got[0]


def test_streaming_counters(spark, tmp_path):
    from geosweep.streaming.events import running_counters

    spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "label string, at long").write.parquet(f"{tmp_path}/in")
    q = running_counters(spark.readStream.schema("label string, at long").parquet(f"{tmp_path}/in"), "label").writeStream.format("memory").queryName("counters").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counters").collect())) == [("a", 2, 5), ("b", 1, 2)]


def test_soft_nms_decays(spark):
    rows = [(1, "a", 1, 0.0, 0.0, 10.0, 10.0, 0.9, "s"), (1, "b", 2, 0.0, 0.0, 10.0, 9.0, 0.8, "s")]
    got = {r["det_id"]: round(r["confidence"], 3) for r in detections.soft_nms(spark.createDataFrame(rows, BOX), ["image"]).collect()}
    assert got == {1: 0.9, 2: 0.08}
