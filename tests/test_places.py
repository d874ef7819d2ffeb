"""Rows that share their place: places meet once, and the result is that of all rows."""

import itertools
import math
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geosweep.operators import spatial
from geosweep.plans import analytics


def crowd(spark, n=120, places=12, name="id"):
    rows = [(i, 54.0 + i % places * 0.013, 24.0 + i % places * 5 % 7 * 0.011) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} long, lon double, lat double")


def metres(a, b):
    s = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(s))


def counted(monkeypatch, name, of):
    """Rows of the sides that a spatial function gets."""
    real, seen = getattr(spatial, name), []

    def call(*args, **more):
        seen.append(tuple(args[i].count() for i in of))
        return real(*args, **more)

    monkeypatch.setattr(spatial, name, call)
    return seen


def tables(tmp_path, **made):
    for name, sql in made.items():
        duckdb.sql(sql).write_parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


SUPPLIERS = "SELECT k AS s_suppkey, 'S' || k AS s_name, 0 AS s_nationkey, 1.0::DOUBLE AS s_acctbal FROM (SELECT (i // 8) % {n} + i % 8 * 1000 AS k FROM range(8 * {n}) r(i))"
EVENTS = "SELECT i % 50 + i // 50 * 1000 AS event_id, TIMESTAMP '2024-01-15' + to_seconds(i) AS ts, i AS user_id, ['view', 'error'][i % 2 + 1] AS event_type, (i % 400)::DOUBLE AS value, '{}' AS props FROM range(400) r(i)"


def against_sql(spark, folder, name):
    got = sorted(map(tuple, entry.queries()[name](spark, folder).collect()), key=lambda r: tuple((x is not None, x) for x in r))
    c = duckdb.connect()
    for t in ("supplier", "events", "part"):
        try:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        except duckdb.IOException:
            pass
    columns = ", ".join(entry.queries()[name](spark, folder).columns)
    return got, sorted(c.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall(), key=lambda r: tuple((x is not None, x) for x in r))


def test_aged_tracks_on_the_edge_of_the_footprint(spark, tmp_path):
    """A site on a side of the footprint ages by the ray's rule in both, not by distance in one."""
    folder = tables(tmp_path, supplier=SUPPLIERS.format(n=1000))
    got, want = against_sql(spark, folder, "aged_tracks")
    assert got == want and len(got) == 8000


@pytest.mark.parametrize("radius", [9000.0, "radius_m"])
def test_radius_join_meets_by_place(spark, monkeypatch, radius):
    rows, p = crowd(spark)
    right = p.select(F.col("id").alias("b"), "lon", "lat", (F.lit(3000.0) + F.col("id") % 12 % 3 * 3000).alias("radius_m"))
    seen = counted(monkeypatch, "_meeting", (0, 1))
    got = {(r["a"], r["b"], r["distance_m"]) for r in spatial.radius_join(p.withColumnRenamed("id", "a"), right, radius, 9000.0, digits=3).collect()}
    reach = lambda b: 9000.0 if radius == 9000.0 else 3000.0 + b[0] % 12 % 3 * 3000
    want = {(a[0], b[0]): metres(a, b) for a in rows for b in rows if metres(a, b) <= reach(b)}
    assert {(a, b): d for a, b, d in got} == {k: pytest.approx(d, abs=6e-4) for k, d in want.items()} and len(got) == len(want) > 1200
    assert seen == [(12, 12)]


def test_near_sites_of_sites_that_share_places(spark, tmp_path, monkeypatch):
    folder = tables(tmp_path, supplier=SUPPLIERS.format(n=40), events=EVENTS)
    seen = counted(monkeypatch, "_meeting", (0, 1))
    got, want = against_sql(spark, folder, "near_sites")
    assert got == want and len(got) > 500 and max(map(max, seen)) <= 120


def test_radius_graph_needs_no_grouping_of_pairs(spark, tmp_path, monkeypatch):
    """Pairs of distinct ids are distinct as they are formed; points that repeat an id still give their least distance."""
    folder = tables(tmp_path, supplier=SUPPLIERS.format(n=40))
    monkeypatch.setattr(spatial, "undirected", None)
    got, want = against_sql(spark, folder, "proximity_radius_graph")
    assert got == want and len(got) > 1000
    monkeypatch.undo()
    twice = spark.createDataFrame([(1, 54.0, 24.0), (1, 54.001, 24.0), (2, 54.002, 24.0)], "id long, lon double, lat double")
    (only,) = spatial.radius_graph(twice, 1000.0).collect()
    assert only["distance_m"] == pytest.approx(metres((0, 54.001, 24.0), (0, 54.002, 24.0)))


def test_site_composition_counts_before_places_meet(spark, tmp_path, monkeypatch):
    folder = tables(tmp_path, supplier=SUPPLIERS.format(n=40), events=EVENTS)
    seen = counted(monkeypatch, "radius_join", (0, 1))
    got, want = against_sql(spark, folder, "site_composition")
    # 50 places of two classes at most, and 40 places of sites of up to three radii
    assert got == want and len(got) > 50 and seen[0][0] <= 100 and seen[0][1] <= 120


def test_repeat_detector_counts_before_places_meet(spark, tmp_path, monkeypatch):
    folder = tables(tmp_path, supplier=SUPPLIERS.format(n=40), events=EVENTS)
    seen = counted(monkeypatch, "radius_join", (0, 1))
    got, want = against_sql(spark, folder, "repeat_detector")
    assert got == want and len(got) > 50 and seen[0][0] <= 100 and seen[0][1] <= 120


def empty(rows, kind):
    p = np.array([r[1:] for r in rows])
    x = np.radians(p) * 6371008.8 * [math.cos(math.radians(p[:, 1].mean())), 1.0]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    side = (lambda a, b: d[a] + d[b]) if kind == "gabriel" else (lambda a, b: np.maximum(d[a], d[b]))
    return {(rows[a][0], rows[b][0]) for a, b in itertools.combinations(range(len(rows)), 2) if not (np.delete(side(a, b), [a, b]) < d[a, b] * (1 - 1e-9)).any()}


def place_graphs(spark, monkeypatch, kind):
    """Edges of crowded points are those of all points, and the search gets each place once."""
    rows, p = crowd(spark, 84)
    real, most = spatial._empty_regions, spark.sparkContext.accumulator(0)

    def regions(at, *more):
        most.add(len(at))
        return real(at, *more)

    monkeypatch.setattr(spatial, "_empty_regions", regions)
    got = {(r["a_id"], r["b_id"]): r["distance_m"] for r in spatial.empty_region_graph(p, kind, start_m=50_000.0).collect()}
    assert set(got) == empty(rows, kind) and most.value <= 12 * 11
    assert all(d == pytest.approx(metres(rows[a], rows[b])) for (a, b), d in got.items())


def test_neighbourhood_graph_of_places(spark, monkeypatch):
    place_graphs(spark, monkeypatch, "rng")


def test_gabriel_graph_of_places(spark, monkeypatch):
    place_graphs(spark, monkeypatch, "gabriel")


def test_spanning_tree_of_places(spark):
    """The tree that Kruskal's rounds take from all edges in order of weight and ids."""
    rows, p = crowd(spark, 84)
    every = sorted((metres(rows[a], rows[b]) if rows[a][1:] != rows[b][1:] else 0.0, a, b) for a, b in empty(rows, "rng"))
    root, want = list(range(len(rows))), set()
    for _, a, b in every:
        if root[a] != root[b]:
            want.add((a, b))
            root = [root[a] if x == root[b] else x for x in root]
    got = spatial.spanning_tree_of(p).collect()
    assert {(r["a_id"], r["b_id"]) for r in got} == want and len(got) == 83


def test_triangulation_keeps_no_list_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    tracemalloc.start()
    edges = spatial.delaunay(pd.DataFrame(rng.random((2000, 2)) * 1000, columns=["x", "y"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(edges) <= 3 * 2000 - 6 and len(edges) > 2.9 * 2000 and peak < 40e6


def test_triangulation_of_crowded_places(spark):
    """A place is a corner under its least id; points all on a line are all joined."""
    rows, p = crowd(spark, 84)
    got = {(r["a_id"], r["b_id"]) for r in spatial.delaunay_graph(p.withColumn("k", F.lit(1)), "k").collect()}
    alone = {(r["a_id"], r["b_id"]) for r in spatial.delaunay_graph(p.where("id < 12").withColumn("k", F.lit(1)), "k").collect()}
    assert got == alone and {i for e in got for i in e} == set(range(12))
    line = spark.createDataFrame([(1, i, 54.0 + i % 2, 24.0) for i in range(6)], "k int, id long, lon double, lat double")
    assert {(r["a_id"], r["b_id"]) for r in spatial.delaunay_graph(line, "k").collect()} == set(itertools.combinations(range(6), 2))


def test_nearest_of_a_place_by_rounded_distance_and_id(spark):
    """Of places at one rounded distance those of least id come first, whatever the last bits say and however many share the nearer one."""
    left = spark.createDataFrame([(s, 54.5, 24.5) for s in range(30)], "site_id long, lon double, lat double")
    rows = [(100 + i, 54.51, 24.5) for i in range(20)] + [(i, 54.49 - 1e-9, 24.5) for i in range(20)]
    right = spark.createDataFrame(rows, "target_id long, lon double, lat double")
    got = spatial.knn_join(left, right, 2, "site_id", "target_id", digits=3).collect()
    assert {(r["site_id"], r["target_id"], r["rank"]) for r in got} == {(s, t, t + 1) for s in range(30) for t in (0, 1)}
    plain = spatial.knn_join(left, right, 2, "site_id", "target_id").collect()
    assert {r["target_id"] for r in plain} == {100, 101}


def test_link_candidates_score_a_place_and_class_once(spark, tmp_path, monkeypatch):
    part = "SELECT i % 50 + i // 50 * 1000 AS p_partkey, ['bolt', 'view ring'][i % 2 + 1] AS p_name, 'B' AS p_brand, ['LARGE', 'ERROR'][i // 2 % 2 + 1] AS p_type, 1 AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(2000) r(i)"
    folder = tables(tmp_path, events=EVENTS.replace("'view'", "'purchase'"), part=part.replace("view ring", "ring").replace("ERROR", "STEEL"))
    seen = counted(monkeypatch, "radius_join", (0,))
    got, want = against_sql(spark, folder, "link_candidates")
    assert got == want and len(got) > 100 and seen[0][0] <= 100


def test_a_side_that_is_not_few_is_never_broadcast(spark, monkeypatch):
    """The planner would send 500 rows round by their size; the count forbids it."""
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 100)
    p = spark.range(500).select(F.col("id").alias("a"), (F.lit(54.0) + F.col("id") * 1e-3).alias("lon"), F.lit(24.0).alias("lat"))
    plan = spatial.radius_join(p, p.withColumnRenamed("a", "b"), 150.0, 150.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


PARTS = "SELECT i % 50 + i // 50 * 1000 AS p_partkey, 'bolt' AS p_name, 'B' AS p_brand, 'LARGE' AS p_type, 1 AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(800) r(i)"


def covered(monkeypatch):
    """Polygons that are cut into cells."""
    from geosweep.operators import polygons

    real, seen = polygons.cover, []

    def cover(areas, *more):
        seen.append(areas.count())
        return real(areas, *more)

    monkeypatch.setattr(polygons, "cover", cover)
    return seen


def test_areas_that_overlap_take_part_by_shape(spark, tmp_path, monkeypatch):
    folder = tables(tmp_path, supplier=SUPPLIERS.format(n=40), part=PARTS)
    seen = covered(monkeypatch)
    got, want = against_sql(spark, folder, "areas_that_overlap")
    assert got == want and len(got) > 50 and max(seen) == 40


def test_a_cover_that_is_not_small_is_never_broadcast(spark, monkeypatch):
    from geosweep.operators import polygons

    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 10)
    _, p = crowd(spark)
    ring = F.array(*(F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y")) for x, y in ((0.0, 0.0), (0.01, 0.0), (0.0, 0.01))))
    cells = polygons.cover(p.select(F.col("id").alias("area"), F.array(ring).alias("rings")), "area")
    plan = polygons.contained(p, cells)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_points_in_areas_count_by_place_and_shape(spark, tmp_path, monkeypatch):
    folder = tables(tmp_path, supplier=SUPPLIERS.format(n=40), events=EVENTS)
    seen = covered(monkeypatch)
    got, want = against_sql(spark, folder, "points_in_notched_areas")
    assert got == want and len(got) > 50 and max(seen) == 40


def test_country_of_point_by_place_and_shape(spark, tmp_path, monkeypatch):
    folder = tables(tmp_path, supplier=SUPPLIERS.format(n=40), events=EVENTS)
    seen = covered(monkeypatch)
    got, want = against_sql(spark, folder, "country_of_point")
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 400 and max(seen) == 40


def test_viewshed_casts_the_rays_of_a_place_once(spark):
    from geosweep.operators import terrain

    dem = spark.range(400).select((F.col("id") % 20).alias("row"), F.floor(F.col("id") / 20).alias("col"), (F.col("id") * 7 % 31).cast("double").alias("elevation"))
    asked = []

    def sampler(frame):
        asked.append(frame.count())
        return terrain.sample_dem(frame, dem, 0.005, 54.0, 24.1)

    observers = spark.createDataFrame([(i, 54.05 + i % 2 * 0.01, 24.05, 30.0 + i % 2) for i in range(10)], "obs_id long, obs_lon double, obs_lat double, obs_elev double")
    got = {(r["obs_id"], r["ray"]): tuple(r)[2:] for r in terrain.viewshed(observers, sampler, 1200.0, azimuth_step=30.0).collect()}
    assert len(got) == 120 and asked == [2 * 12 * 20] and {v[2] for v in got.values()} != {0}
    assert all(got[i, ray] == got[i % 2, ray] for i in range(10) for ray in range(12))


def test_soft_suppression_meets_only_overlapping_boxes(monkeypatch):
    """The pairs of the sweep are those of all pairs, boxes without an extent among them."""
    from geosweep.operators import detections

    rng = np.random.default_rng(2)
    low = rng.integers(0, 60, (300, 2)).astype(float)
    boxes = np.hstack([low, low + rng.integers(0, 25, (300, 2))])
    for least in (0.0, 0.3, 0.5):
        i, j, share = detections.overlapping_by(boxes, least, chunk=500)
        all_of = np.array([detections.iou_many(b, boxes) for b in boxes])
        want = {(a, b) for a, b in zip(*np.nonzero(all_of > least), strict=True) if a < b}
        assert {(min(p), max(p)) for p in zip(i, j, strict=True)} == want and len(i) == len(want) > 50
        assert np.allclose(share, all_of[i, j])


def test_soft_suppression_as_by_all_pairs(spark, monkeypatch):
    from geosweep.operators import detections

    rng, rows = np.random.default_rng(3), []
    for k in range(200):
        x, y, w, h = (float(v) for v in (*rng.integers(0, 60, 2), *rng.integers(5, 25, 2)))
        rows.append((1, k, x, y, x + w, y + h, float(rng.random())))
    score, left, want = {r[1]: r[6] for r in rows}, {r[1]: r for r in rows}, {}
    while left:
        top = max(left, key=lambda k: (score[k], -k))
        if score[top] < 0.05:
            break
        box = np.array(left.pop(top)[2:6])
        want[top] = score[top]
        for k, r in left.items():
            o = detections.iou_many(box, np.array([r[2:6]]))[0]
            score[k] *= 1 - o if o > 0.5 else 1.0
    monkeypatch.setattr(detections, "iou_many", None)
    df = spark.createDataFrame(rows, "image int, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = {r["det_id"]: r["confidence"] for r in detections.soft_nms(df, ["image"]).collect()}
    assert got == pytest.approx(want) and len(want) < 200


def test_masks_of_equal_runs_are_measured_once(spark, monkeypatch):
    from geosweep.operators import shapes

    real, calls = shapes.hull, spark.sparkContext.accumulator(0)

    def hull(points):
        calls.add(1)
        return real(points)

    monkeypatch.setattr(shapes, "hull", hull)
    rows = [(m, y, 5 + m % 3 * y, 20 + m % 3 * 2 * y) for m in range(60) for y in range(2, 6)]
    got = {r["mask"]: tuple(r)[1:] for r in shapes.oriented_boxes(spark.createDataFrame(rows, "mask long, row int, x1 int, x2 int").repartition(5), "mask", 80.0, 60.0).collect()}
    assert len(got) == 60 and all(got[m] == got[m % 3] for m in got) and len({str(got[m]) for m in range(3)}) == 3
    assert calls.value <= 6


def test_betweenness_of_many_nodes_goes_by_component(spark, monkeypatch):
    """Paths and stars side by side, over 50,000 nodes in all; parts of a component's sources add up."""
    from geosweep.operators import graph

    monkeypatch.setattr(graph, "STEPS", 40)
    nodes = spark.range(50_020)
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)] + [(10, k) for k in range(11, 15)], "src long, dst long")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, edges).where("betweenness > 0").collect()}
    pairs = 50_019 * 50_018 / 2
    assert {k: v * pairs for k, v in got.items()} == pytest.approx({1: 3, 2: 4, 3: 3, 10: 6})


@pytest.mark.parametrize("seed", range(4))
def test_sets_that_do_not_compete_are_assigned_apart(seed):
    """As many allowed pairs, at the same cost, as the whole matrix gives with barred pairs at a high price; and never the whole matrix at once."""
    from geosweep.operators import detections

    rng = np.random.default_rng(seed)
    for n, m in ((1, 1), (7, 4), (12, 30), (40, 25), (60, 60)):
        cost = np.where(rng.random((n, m)) < 1.5 / m, rng.random((n, m)) * 2, 1e9)
        whole = [(a, b) for a, b in detections.assign(cost) if cost[a, b] < 1e9]
        found = detections.assign_apart(cost)
        assert len(found) == len(whole) == len({a for a, _ in found}) == len({b for _, b in found})
        assert sum(cost[p] for p in found) == pytest.approx(sum(cost[p] for p in whole), abs=1e-5)


def test_clip_tracks_compare_boxes_by_row(spark, monkeypatch):
    """Crowded clips: no call for each pair where nothing has an appearance, and no assignment of a whole frame."""
    from geosweep.operators import detections

    calls, sizes, real = [], [], detections.assign
    monkeypatch.setattr(detections, "appearance", None)
    monkeypatch.setattr(detections, "assign", lambda cost: (sizes.append(cost.shape), real(cost))[1])
    monkeypatch.setattr(detections, "per_group", lambda df, keys, run, schema: calls.append(run) or df)
    detections.clip_tracks(spark.createDataFrame([(1, 1, 0, "a", 0.0, 0.0, 1.0, 1.0)], "clip_id int, det_id long, frame int, cls string, x1 double, y1 double, x2 double, y2 double"))
    rows = [(1, 1000 * f + k, f, "a", 30.0 * (k % 20) + f, 30.0 * (k // 20), 30.0 * (k % 20) + f + 20, 30.0 * (k // 20) + 20) for f in range(3) for k in range(200)]
    got = calls[0](pd.DataFrame(rows, columns=["clip_id", "det_id", "frame", "cls", "x1", "y1", "x2", "y2"]))
    assert (got["track"] == got["det_id"] % 1000 + 1).all() and all(a * b <= 16 for a, b in sizes)
