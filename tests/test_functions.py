"""Scalar functions against fixtures and closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from geosweep.functions import geo, labels, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_haversine_models(spark):
    quarter = math.pi / 2 * geo.MEAN_RADIUS_M
    assert one(spark, geo.haversine(0.0, 0.0, 90.0, 0.0)) == pytest.approx(quarter)
    assert one(spark, geo.haversine(0.0, 0.0, 90.0, 0.0, "atan2")) == pytest.approx(quarter * geo.PLAIN_RADIUS_M / geo.MEAN_RADIUS_M)


def test_cells(spark):
    assert one(spark, geo.cell_center(55.013, 0.02)) == 55.01
    assert one(spark, geo.snap(55.013, 0.02)) == 55.02


def test_destination_comes_back(spark):
    lon, lat = geo.destination(54.0, 24.0, 37.0, 12_345.0)
    assert one(spark, geo.haversine(F.lit(54.0), F.lit(24.0), lon, lat)) == pytest.approx(12_345.0, abs=1e-3)


def test_bbox_is_strict():
    assert geo.parse_bbox("1,2,3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "3,2,1,4", "1,2,1,4"):
        with pytest.raises(ValueError):
            geo.parse_bbox(bad)


def test_iou_and_degenerate(spark):
    assert one(spark, geo.iou_xyxy(*map(float, (0, 0, 2, 2, 1, 1, 3, 3)))) == pytest.approx(1 / 7)
    assert one(spark, geo.iou_xyxy(*map(float, (0, 0, 0, 0, 0, 0, 0, 0)))) == 0


def test_point_in_ring(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))))
    assert one(spark, geo.point_in_ring(1.0, 1.0, ring)) and not one(spark, geo.point_in_ring(2.0, 3.0, ring))
    assert one(spark, geo.ring_area(ring)) == pytest.approx(10.0)


def test_cosine_variants(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, geo.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, geo.cosine(v(0.0, 0.0), v(1.0, 1.0))) == 0
    assert one(spark, geo.cosine(v(1.0), v(1.0, 1.0))) is None


def mission(name):
    return labels.first_token(name, [("gps", "navigation"), ("NORTH", "coast")])


def area(value):
    return labels.domain(value, ["AIR", "SEA", "LAND"], "LAND", {"RF_AIR": "AIR"})


@pytest.mark.parametrize(
    ("fn", "given", "want"),
    [
        (labels.normalise, "  DOTA Large-Vehicle! ", "dota_large_vehicle"), (labels.strip_source, "DOTA ship", "ship"), (labels.normalise, "***", "object"), (labels.canonical, "Military-Facility  x", "military_facility_x"),
        (labels.display_class, "xview cargo_truck", "Cargo Truck"), (mission, "north 224 gps", "navigation"), (mission, "north 7", "coast"), (mission, None, "unknown"), (area, "rf/air", "AIR"), (area, " sea", "SEA"), (area, "", "LAND"), (area, "x", "LAND"),
        (labels.affiliation, " Friendly", "friend"), (labels.affiliation, "odd", None), (labels.upload_kind, "a/b.TIF", "imagery"), (labels.upload_kind, "x.exe", None), (labels.safe_filename, "/a/b c.tif", "b_c.tif"),
        (labels.relation_type, "near by!", "CANDIDATE_NEAR_BY"), (labels.type_name, "naval-base x", "NavalBaseX"), (labels.type_name, "!", "Thing"),
    ],
)
def test_labels(spark, fn, given, want):
    assert one(spark, fn(F.lit(given))) == want


def test_airframe(spark):
    assert [one(spark, labels.airframe(F.lit(c), F.lit(k))) for c, k in (("b06", None), ("A320", None), ("ZZ", "A7"), (None, None))] == ["heli", "airliner", "heli", "unknown"]


def test_name_similarity(spark):
    sim = lambda a, b: one(spark, labels.name_similarity(F.lit(a), F.lit(b)))
    assert sim("Port Alpha", "alpha") == 0.8 and sim("harbour a", "harbour b") == pytest.approx(0.7) and sim("abc", "abd") == 0 and sim("", "x") == 0


def test_calibration_edges(spark):
    c = lambda raw, t: one(spark, scoring.calibrate(F.lit(raw), F.lit(t)))
    assert c(0.0, 2.0) == 0 and c(1.0, 2.0) == 1 and c(None, 2.0) == 0 and c(0.5, 3.0) == pytest.approx(0.5) and c(0.9, 2.0) == pytest.approx(0.75)


def test_compatibility(spark):
    c = lambda a, b: one(spark, scoring.compatibility(F.lit(a), F.lit(b)))
    assert c("cargo_ship", "Big ship yard") == 1.0 and c("frigate", "naval base") == 0.7 and c("car", "naval base") == 0.2 and c("car", "  ") == 0.4
