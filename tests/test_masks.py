"""Components and outlines of masks against labels and counts on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosweep.operators import masks, terrain


def pixels_of(mask, scene=0):
    return [(scene, int(r), int(c)) for r, c in np.argwhere(mask)]


def test_outlines_of_random_masks(spark):
    rng = np.random.default_rng(2)
    scenes = {k: rng.random((rng.integers(1, 14), rng.integers(1, 14))) < p for k, p in enumerate((0.3, 0.5, 0.6, 0.7, 0.9))}
    scenes[9] = np.zeros((3, 700), bool)
    scenes[9][1, 3:690], scenes[9][0, 650], scenes[9][2, 0:2] = True, True, True  # wider than a stretch
    df = spark.createDataFrame([p for k, m in scenes.items() for p in pixels_of(m, k)], "scene int, row int, col int")
    got = {}
    for r in masks.outlines(df, ["scene"]).collect():
        got.setdefault(r["scene"], []).append(r)
    for k, mask in scenes.items():
        want = sorted((len(r), int(r.min()), int(c.min()), int(r.max()), int(c.max())) for r, c in terrain.regions(mask))
        assert sorted((r["pixels"], r["row_min"], r["col_min"], r["row_max"], r["col_max"]) for r in got[k]) == want
        again = np.zeros(mask.shape, bool)
        for r in got[k]:
            rings = [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
            area = lambda g: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, [*g[1:], g[0]], strict=True)) / 2
            # the outer ring runs one way, holes the other, and together they enclose the pixels
            assert area(rings[0]) > 0 and all(area(g) < 0 for g in rings[1:]) and sum(map(area, rings)) == r["pixels"]
            own = np.zeros(mask.shape, bool)
            for y in range(mask.shape[0]):
                for x in range(mask.shape[1]):
                    own[y, x] = sum(((a[1] > y + 0.5) != (b[1] > y + 0.5)) and x + 0.5 < a[0] for g in rings for a, b in zip(g, [*g[1:], g[0]], strict=True)) % 2
            assert own.sum() == r["pixels"] and not (again & own).any()
            again |= own
            assert all((a[0] == b[0]) != (a[1] == b[1]) for g in rings for a, b in zip(g, [*g[1:], g[0]], strict=True))
            turns = [(a, b, c) for g in rings for a, b, c in zip(g, [*g[1:], g[0]], [*g[2:], *g[:2]], strict=True)]
            assert all((b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in turns)
        assert (again == mask).all()


def test_corners_join_where_asked(spark):
    df = spark.createDataFrame(pixels_of(np.eye(4, dtype=bool)), "scene int, row int, col int")
    assert masks.outlines(df, ["scene"]).count() == 4 and masks.components(df, ["scene"], diagonal=True).select("component").distinct().count() == 1
    assert masks.outlines(df.limit(0), ["scene"]).collect() == []


@pytest.mark.parametrize("gaps", [False, True])
def test_means_in_boxes(spark, gaps):
    rng = np.random.default_rng(3)
    value = rng.random((9, 600))
    there = rng.random(value.shape) < (0.5 if gaps else 1.1)
    pixels = spark.createDataFrame([(1, int(r), int(c), float(value[r, c])) for r, c in np.argwhere(there)], "scene int, row int, col int, v double")
    boxes = [(1, f"b{i}", int(r), int(c), int(r + h), int(c + w)) for i, (r, c, h, w) in enumerate(zip(rng.integers(0, 5, 20), rng.integers(0, 300, 20), rng.integers(0, 4, 20), rng.integers(0, 299, 20), strict=True))]
    got = {r["component"]: r["score"] for r in masks.mean_in_boxes(spark.createDataFrame(boxes, "scene int, component string, row_min long, col_min long, row_max long, col_max long"), pixels, ["scene"], "v").collect()}
    for _, name, r0, c0, r1, c1 in boxes:
        window, own = value[r0 : r1 + 1, c0 : c1 + 1], there[r0 : r1 + 1, c0 : c1 + 1]
        assert got[name] == (pytest.approx(window[own].mean()) if own.any() else None)


def test_clutter_over_a_pass_has_no_seams(spark):
    """A scene taken whole and in tiles that overlap by a halo give the same bright regions."""
    rng = np.random.default_rng(5)
    db = rng.normal(0, 1, (40, 56))
    db[10:13, 26:31] += 25
    db[30, 3:9] += 25
    rows = [(1, r, c, float(db[r, c])) for r in range(40) for c in range(56)]
    df = spark.createDataFrame(rows, "scene int, row int, col int, db double")
    whole = terrain.cfar_pass(df, ["scene"], guard=2, background=6, transform=(54.0, 1e-3, 0.0, 25.0, 0.0, -1e-3)).collect()
    old = terrain.cfar_tiles(df.withColumnRenamed("scene", "tile"), guard=2, background=6).collect()
    key = lambda r: (r["x1"], r["y1"], r["x2"], r["y2"], r["pixels"], round(r["z_peak"], 9))
    assert sorted(map(key, whole)) == sorted(map(key, old)) and len(whole) >= 2
    tiled = terrain.cfar_pass(df.unionByName(df.where("col BETWEEN 20 AND 36")), ["scene"], guard=2, background=6, transform=(54.0, 1e-3, 0.0, 25.0, 0.0, -1e-3)).collect()
    assert sorted(map(key, tiled)) == sorted(map(key, whole))
    first = next(r for r in whole if r["x1"] <= 28 < r["x2"] and r["y1"] <= 11 < r["y2"])
    assert first["lon"] == pytest.approx(54.0 + (first["x1"] + first["x2"]) / 2 * 1e-3) and first["lat"] == pytest.approx(25.0 - (first["y1"] + first["y2"]) / 2 * 1e-3)
    assert F.col("x") is not None
