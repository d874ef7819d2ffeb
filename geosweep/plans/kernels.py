"""Queries on detection kernels, tracking, rasters, terrain, orbits, feeds and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from geosweep.functions import geo
from geosweep.operators import clips as clips_
from geosweep.operators import detections as d
from geosweep.operators import terrain, tracker, tracking
from geosweep.operators.graph import settled
from geosweep.plans.domain import BOXES, boxes, detections, iou_sql, place, sites, track_points
from geosweep.sources import readers

PLANS: dict = {}


def plan(name: str, sql: str | None = None):
    def put(fn):
        PLANS[name] = (fn, sql)
        return fn

    return put


@plan("nms_survivors")
def nms(spark, sf):
    return d.nms(boxes(spark, sf), ["image", "cls"])


@plan("weighted_box_fusion")
def wbf(spark, sf):
    return d.weighted_box_fusion(boxes(spark, sf), ["image", "cls"])


@plan("soft_nms")
def soft(spark, sf):
    return d.soft_nms(boxes(spark, sf), ["image"])


@plan("edge_reconciliation")
def reconcile(spark, sf):
    return d.reconcile_truncated(boxes(spark, sf).withColumn("edge_truncated", F.col("det_id") % 2 == 0), ["image", "cls"])


@plan("clip_tracks")
def clips(spark, sf):
    return d.clip_tracks(boxes(spark, sf).withColumn("clip_id", F.col("image")))


# every box a second time under another prompt, moved a little, in a third of the images by too much to be one object
_SESSIONS = f"""{BOXES}, det AS (SELECT image AS clip_id, 2 * det_id AS det_id, frame, cls, confidence, x1, y1, x2, y2, (det_id // 10) % 3 AS track FROM boxes
UNION ALL SELECT image, 2 * det_id + 1, frame, CASE WHEN det_id % 4 = 0 THEN 'other' ELSE cls END, confidence / 2, x1 + m, y1, x2 + m, y2, (det_id // 10) % 3 + 3 FROM (SELECT *, CASE WHEN image % 3 = 0 THEN 30.0 ELSE 1.0 END::DOUBLE AS m FROM boxes))"""


def _sessions(spark, sf):
    b = boxes(spark, sf)
    track = (F.floor(F.col("det_id") / 10) % 3).cast("long")
    first = b.select(F.col("image").alias("clip_id"), (2 * F.col("det_id")).alias("det_id"), "frame", "cls", "confidence", "x1", "y1", "x2", "y2", track.alias("track"))
    by = F.when(F.col("image") % 3 == 0, 30.0).otherwise(1.0)
    second = b.select(
        F.col("image").alias("clip_id"), (2 * F.col("det_id") + 1).alias("det_id"), "frame", F.when(F.col("det_id") % 4 == 0, "other").otherwise(F.col("cls")).alias("cls"), (F.col("confidence") / 2).alias("confidence"),
        (F.col("x1") + by).alias("x1"), "y1", (F.col("x2") + by).alias("x2"), "y2", (track + 3).alias("track"),
    )
    return first.unionByName(second).withColumn("track_id", F.col("track"))


@plan(
    "clip_consolidation",
    f"""WITH RECURSIVE {_SESSIONS},
p AS (SELECT a.clip_id, a.track AS a, b.track AS b, a.frame, max({iou_sql('a', 'b')}) AS o FROM det a JOIN det b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.track < b.track GROUP BY ALL),
e AS (SELECT clip_id, a, b FROM p GROUP BY ALL HAVING sum((o >= 0.55)::INT) / count(*) >= 0.6),
l AS (SELECT clip_id, a AS x, b AS y FROM e UNION ALL SELECT clip_id, b, a FROM e),
r AS (SELECT DISTINCT clip_id, track, track AS root FROM det UNION SELECT r.clip_id, r.track, l.y FROM r JOIN l ON r.clip_id = l.clip_id AND r.root = l.x),
m AS (SELECT clip_id, track, min(root) AS root FROM r GROUP BY ALL),
d AS (SELECT det.*, m.root FROM det JOIN m USING (clip_id, track)),
v AS (SELECT clip_id, root, arg_max(cls, (n, med, cls)) AS canonical FROM (SELECT clip_id, root, cls, count(DISTINCT frame) AS n, median(confidence) AS med FROM d GROUP BY ALL) GROUP BY ALL),
t AS (SELECT clip_id, root, row_number() OVER (PARTITION BY clip_id ORDER BY f) AS consolidated_id FROM (SELECT clip_id, root, min((frame, det_id)) AS f FROM d GROUP BY ALL))
SELECT clip_id, det_id, consolidated_id, canonical, row_number() OVER (PARTITION BY clip_id, root, frame ORDER BY (cls = canonical) DESC, confidence DESC, track, det_id) > 1 AS duplicate FROM d JOIN v USING (clip_id, root) JOIN t USING (clip_id, root)""",
)
def clip_consolidation(spark, sf):
    """Tracks of two prompts made one, with one class each and one row a frame."""
    return clips_.consolidate(_sessions(spark, sf)).select("clip_id", "det_id", "consolidated_id", "canonical", "duplicate")


@plan("truth_matches")
def matches(spark, sf):
    b = boxes(spark, sf)
    preds = b.where("source <> 'dota_obb'").select("image", "cls", F.col("det_id").alias("pred_id"), F.col("confidence").alias("score"), "x1", "y1", "x2", "y2")
    return d.match_truth(preds, b.where("source = 'dota_obb'").select("image", "cls", "x1", "y1", "x2", "y2"), ["image", "cls"])


_W = "(1000 + p_size * 100)"


@plan(
    "inference_grid",
    f"""WITH r AS (SELECT p_partkey AS raster_id, {_W} AS width, 1500 + (p_partkey % 7) * 300 AS height FROM part),
c AS (SELECT *, unnest(range(CASE WHEN width <= 1008 THEN 1 ELSE ceil((width - 1008) / 756.0)::INT + 1 END)) AS ix FROM r),
e AS (SELECT *, unnest(range(CASE WHEN height <= 1008 THEN 1 ELSE ceil((height - 1008) / 756.0)::INT + 1 END)) AS iy FROM c)
SELECT raster_id, ix, iy, least(ix * 756, width - 1) AS x, least(iy * 756, height - 1) AS y, least(1008, width - least(ix * 756, width - 1)) AS w, least(1008, height - least(iy * 756, height - 1)) AS h FROM e""",
)
def grid(spark, sf):
    p = readers.table(spark, sf, "part")
    return d.grid_chips(p.select(F.col("p_partkey").alias("raster_id"), (1000 + F.col("p_size") * 100).alias("width"), (1500 + (F.col("p_partkey") % 7) * 300).alias("height")))


@plan(
    "inference_grid_budget",
    f"""WITH r AS (SELECT p_partkey AS raster_id, 3 * {_W} AS width, 3 * (1500 + (p_partkey % 7) * 300) AS height FROM part),
n AS (SELECT *, CASE WHEN width <= 1008 THEN 1 ELSE ceil((width - 1008) / 756.0)::INT + 1 END AS nx, CASE WHEN height <= 1008 THEN 1 ELSE ceil((height - 1008) / 756.0)::INT + 1 END AS ny FROM r),
y AS (SELECT *, CASE WHEN nx * ny > 12 THEN greatest(1, least(ny, floor(sqrt(12.0 * ny / nx))::INT)) ELSE ny END AS wy FROM n),
w AS (SELECT *, CASE WHEN nx * ny > 12 THEN greatest(1, least(nx, 12 // wy)) ELSE nx END AS wx FROM y),
c AS (SELECT *, unnest(list_distinct(CASE WHEN wx >= nx THEN range(nx::BIGINT) WHEN wx <= 1 THEN [nx::BIGINT // 2] ELSE list_transform(range(wx::BIGINT), lambda k: round_even(k * (nx - 1) / (wx - 1), 0)::BIGINT) END)) AS ix FROM w),
e AS (SELECT *, unnest(list_distinct(CASE WHEN wy >= ny THEN range(ny::BIGINT) WHEN wy <= 1 THEN [ny::BIGINT // 2] ELSE list_transform(range(wy::BIGINT), lambda k: round_even(k * (ny - 1) / (wy - 1), 0)::BIGINT) END)) AS iy FROM c),
o AS (SELECT *, least(ix * 756, width - 1) AS rx, least(iy * 756, height - 1) AS ry FROM e)
SELECT raster_id, ix, iy, rx - rx % 64 AS x, ry - ry % 64 AS y, least(1008 + rx % 64, width - rx + rx % 64) AS w, least(1008 + ry % 64, height - ry + ry % 64) AS h FROM o""",
)
def grid_budget(spark, sf):
    """Rasters three times as large, at most twelve chips each, origins on blocks of 64 pixels."""
    p = readers.table(spark, sf, "part")
    rasters = p.select(F.col("p_partkey").alias("raster_id"), (3 * (1000 + F.col("p_size") * 100)).alias("width"), (3 * (1500 + (F.col("p_partkey") % 7) * 300)).alias("height"))
    return d.grid_chips(rasters, max_chips=12, block=64)


@plan("track_assignment")
def assignment(spark, sf):
    """Tracks of each day to the detections of the next, for every pair of successive days.

    A day's gate is wider than the area of the points, so a pair of days is one set of candidates.
    """
    pts = track_points(spark, sf).withColumn("day", F.unix_date(F.to_date("observed_at")))
    last = pts.groupBy("day", "track_id").agg(F.max(F.struct("observed_at", "lon", "lat")).alias("m"))
    tracks = last.select((F.col("day") + 1).alias("day"), "track_id", F.col("m.lon").alias("t_lon"), F.col("m.lat").alias("t_lat"), F.col("m.observed_at").alias("t_at"))
    now = pts.select("day", F.col("point_id").alias("det_id"), "lon", "lat", "observed_at")
    dt = F.col("observed_at").cast("timestamp").cast("double") - F.col("t_at").cast("timestamp").cast("double")
    pairs = now.join(tracks, "day").withColumn("gate", tracking.gate(F.lit("ground"), F.lit(5.0), F.lit(0.0), dt)).withColumn("dist", geo.haversine("lon", "lat", "t_lon", "t_lat"))
    true = F.lit(True)
    gated = pairs.where("dist <= gate").withColumn("cost", tracking.cost("dist", "gate", true, true, F.lit(0.8)))
    return tracking.assign_pairs(gated.select("day", "track_id", "det_id", "cost"), "day").withColumn("day", F.date_from_unix_date("day"))


@plan("track_replay")
def replay(spark, sf):
    # a gate of a day spans thousands of kilometres, the detections about a hundred: one region
    det = detections(spark, sf)
    rows = det.select(
        F.lit(0).alias("region"), F.col("id").alias("det_id"), F.unix_timestamp(F.date_trunc("DAY", "created_at")).alias("pass_at"), F.col("class").alias("cls"), F.lit("ground").alias("category"), "lon", "lat", "confidence"
    )
    return tracking.replay(rows, "region")


@plan("tracker_passes")
def tracker_passes(spark, sf):
    """All detections as fixed objects, ten days a pass: a version of the state after each, the last one returned."""
    lon, lat = place("id", 37, 13, 400, 80)
    det = detections(spark, sf).withColumn("day", F.datediff("created_at", F.lit("2024-01-01")))
    rows = det.select(F.floor(F.col("day") / 10).cast("int").alias("pass"), F.col("id").alias("det_id"), F.concat("class", F.lit("_court")).alias("cls"), (1 - F.col("confidence")).alias("confidence"), lon.alias("lon"), lat.alias("lat"))
    rows = rows.withColumn("category", tracker.tracker_category("cls", F.lit(None).cast("string"))).transform(settled)
    after = spark.createDataFrame([], tracker.TRACKS)
    around = [(53.0, 23.0), (56.0, 23.0), (56.0, 26.0), (53.0, 26.0)]
    for p in sorted(r["pass"] for r in rows.select("pass").distinct().collect()):
        after, _ = tracker.advance(after, rows.where(F.col("pass") == p).drop("pass"), p, 864_000 * p, around)
        after = settled(after)
    return after.select("track_id", "cls", "status", "obs_count", "misses", F.round("sigma", 6).alias("sigma"))


def _pixels(spark, sf):
    """A scene per nation: rows and columns from supplier and part keys."""
    l = readers.table(spark, sf, "lineitem")
    cells = l.groupBy((F.col("l_suppkey") % 5).alias("scene"), (F.col("l_partkey") % 24).alias("row"), (F.col("l_orderkey") % 24).alias("col"))
    return cells.agg(F.round(F.avg("l_quantity"), 6).alias("before"), F.round(F.avg(F.col("l_quantity") * (1 + 8 * (F.col("l_tax") > 0.07).cast("int"))), 6).alias("after")).withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))


_PIX = "pix AS (SELECT l_suppkey % 5 AS scene, (l_partkey % 24)::INT AS r, (l_orderkey % 24)::INT AS c, round(avg(l_quantity), 6) AS before, round(avg(l_quantity * (1 + 8 * (l_tax > 0.07)::INT)), 6) AS after FROM lineitem GROUP BY 1, 2, 3)"


@plan("optical_change", f"WITH {_PIX}, p AS (SELECT *, abs(after - before) AS d, max(abs(after - before)) OVER (PARTITION BY scene) AS m FROM pix) SELECT scene, r AS row, c AS col, round(d / m, 5) AS diff, round(d / m, 5) >= 0.18 AS changed FROM p")
def optical(spark, sf):
    t = terrain.optical_change(_pixels(spark, sf).withColumn("band", F.lit(1)))
    return t.select("scene", "row", "col", F.round("diff", 5).alias("diff"), (F.round("diff", 5) >= 0.18).alias("changed"))


@plan(
    "sar_change",
    f"""WITH {_PIX}, q AS (SELECT scene, r, c, 10 * log10((greatest(after, 0) + 0.001) / (greatest(before, 0) + 0.001)) AS db, max(r) OVER (PARTITION BY scene) AS mr, max(c) OVER (PARTITION BY scene) AS mc FROM pix),
a AS (SELECT scene, r, c, greatest(0, least(r + dr, mr)) AS r2, greatest(0, least(c + dc, mc)) AS c2 FROM q, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc))
SELECT a.scene, a.r AS row, a.c AS col, round(quantile_cont(q.db, 0.5), 5) AS db FROM a JOIN q ON a.scene = q.scene AND a.r2 = q.r AND a.c2 = q.c GROUP BY ALL""",
)
def sar(spark, sf):
    return terrain.sar_change(_pixels(spark, sf)).select("scene", "row", "col", F.round("db", 5).alias("db"))


@plan(
    "change_polygons",
    f"""WITH RECURSIVE {_PIX}, p AS (SELECT *, abs(after - before) AS d, max(abs(after - before)) OVER (PARTITION BY scene) AS m FROM pix), v AS (SELECT scene, r, c, d / m AS diff, d / m >= 0.3 AS changed FROM p),
h AS (SELECT scene, r, c, r * 1000 + c AS k FROM v WHERE changed), l AS (SELECT a.scene, a.k AS a, b.k AS b FROM h a JOIN h b ON a.scene = b.scene AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
t AS (SELECT scene, k, k AS root FROM h UNION SELECT t.scene, t.k, l.b FROM t JOIN l ON t.scene = l.scene AND t.root = l.a), g AS (SELECT scene, k, min(root) AS root FROM t GROUP BY ALL),
n AS (SELECT scene, a AS k, count(*) AS n FROM l GROUP BY ALL),
x AS (SELECT scene, root, count(*) AS pixels, min(k // 1000) AS row_min, min(k % 1000) AS col_min, max(k // 1000) AS row_max, max(k % 1000) AS col_max, sum(4 - coalesce(n, 0))::BIGINT AS perimeter FROM g LEFT JOIN n USING (scene, k) GROUP BY ALL)
SELECT x.scene, pixels, row_min, col_min, row_max, col_max, perimeter, round(avg(v.diff), 4) AS score FROM x JOIN v ON v.scene = x.scene AND r BETWEEN row_min AND row_max AND c BETWEEN col_min AND col_max GROUP BY x.scene, root, pixels, row_min, col_min, row_max, col_max, perimeter""",
)
def polygons(spark, sf):
    """Changed regions as polygons with holes; the length of their outlines stands for the rings."""
    change = terrain.optical_change(_pixels(spark, sf).withColumn("band", F.lit(1)), 0.3)
    found = terrain.change_polygons(change, ["scene"])
    around = lambda ring: F.aggregate(F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"])), F.lit(0).cast("long"), lambda n, x: n + x)
    perimeter = F.aggregate(F.transform("rings", around), F.lit(0).cast("long"), lambda n, x: n + x)
    return found.select("scene", "pixels", "row_min", "col_min", "row_max", "col_max", perimeter.alias("perimeter"), "score")


@plan(
    "window_resample",
    f"""WITH {_PIX}, t AS (SELECT s.scene, tr, tc, (tc + 0.5) * 24 / 37 - 0.5 AS fx, (tr + 0.5) * 24 / 29 - 0.5 AS fy FROM (SELECT DISTINCT scene FROM pix) s, range(29) a(tr), range(37) b(tc)),
k AS (SELECT scene, tr, tc, floor(fx)::BIGINT + dx AS c, floor(fy)::BIGINT + dy AS r, (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w FROM t, range(2) x(dx), range(2) y(dy))
SELECT k.scene, tr AS row, tc AS col, round(sum(w * before) / sum(w), 9) AS value FROM k JOIN pix ON pix.scene = k.scene AND pix.r = k.r AND pix.c = k.c WHERE w > 0 GROUP BY ALL""",
)
def window_resample(spark, sf):
    """Every scene of 24 by 24 pixels brought to a window of 29 rows and 37 columns."""
    src = _pixels(spark, sf).select("scene", "row", "col", F.col("before").alias("value"))
    rows, cols = F.explode(F.sequence(F.lit(0), F.lit(28))).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(36))).alias("col")
    window = src.select("scene").distinct().select("scene", rows).select("scene", "row", cols)
    target = window.select("*", ((F.col("col") + 0.5) * 24 / 37).alias("x"), ((F.col("row") + 0.5) * 24 / 29).alias("y"))
    return terrain.resampled(src, target, ["scene"], 0.0, 0.0, 1.0, 1.0).where("value IS NOT NULL").withColumn("value", F.round("value", 9))


@plan("cfar_passes")
def cfar_passes(spark, sf):
    """Bright regions of whole passes on the map; a pass is a return flag of the lines."""
    cells = readers.table(spark, sf, "lineitem").groupBy("l_returnflag", (F.col("l_partkey") % 90).cast("int").alias("row"), (F.col("l_orderkey") % 110).cast("int").alias("col"))
    made = cells.agg(F.sum("l_quantity").alias("db")).withColumnRenamed("l_returnflag", "pass")
    return terrain.cfar_pass(made, ["pass"], (54.0, 1e-3, 0.0, 25.0, 0.0, -1e-3), background=12, guard=2, min_pixels=1)


@plan("sar_cfar")
def cfar(spark, sf):
    cells = readers.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("tile"), (F.col("l_partkey") % 64).cast("int").alias("row"), (F.col("l_orderkey") % 64).cast("int").alias("col"))
    return terrain.cfar_tiles(cells.agg((F.avg("l_quantity") + F.max("l_tax") * 50).alias("db")), "tile", background=12, guard=2, min_pixels=1)


def _dem(spark):
    """An analytic surface on a grid of 0.005 degrees over the area of the sites."""
    g = spark.range(201 * 201).select((F.col("id") % 201).alias("row"), F.floor(F.col("id") / 201).alias("col"))
    return g.withColumn("elevation", 100 + 80 * F.sin(F.col("row") / 9.0) * F.cos(F.col("col") / 7.0))


def _sampler(spark):
    dem = _dem(spark)
    return lambda frame: terrain.sample_dem(frame, dem, 0.005, 54.0, 25.0)


@plan("elevation_samples", "WITH s AS (SELECT s_suppkey AS site_id, 54.0::DOUBLE + ((s_suppkey * 83) % 1000) / 1000::DOUBLE + 0.0002::DOUBLE AS lon, 24.0::DOUBLE + ((s_suppkey * 29) % 200) / 200::DOUBLE + 0.0002::DOUBLE AS lat FROM supplier) SELECT site_id, round(100 + 80 * sin(floor((25.0 - lat) / 0.005) / 9.0) * cos(floor((lon - 54.0) / 0.005) / 7.0), 6) AS elevation FROM s")
def elevation(spark, sf):
    s = sites(spark, sf).select("site_id", (F.col("lon") + 0.0002).alias("lon"), (F.col("lat") + 0.0002).alias("lat"))
    return _sampler(spark)(s).select("site_id", F.round("elevation", 6).alias("elevation"))


@plan("line_of_sight")
def sight(spark, sf):
    s = _sampler(spark)(sites(spark, sf).select("site_id", (F.col("lon") + 0.0002).alias("lon"), (F.col("lat") + 0.0002).alias("lat"))).where("elevation IS NOT NULL")
    a = s.select(F.col("site_id").alias("pair_id"), F.col("lon").alias("obs_lon"), F.col("lat").alias("obs_lat"), F.col("elevation").alias("obs_elev"))
    b = s.select((F.col("site_id") - 1).alias("pair_id"), F.col("lon").alias("tgt_lon"), F.col("lat").alias("tgt_lat"), F.col("elevation").alias("tgt_elev"))
    return terrain.line_of_sight(a.join(b, "pair_id"), _sampler(spark))


@plan("viewshed")
def viewshed(spark, sf):
    s = _sampler(spark)(sites(spark, sf).select("site_id", (F.col("lon") + 0.0002).alias("lon"), (F.col("lat") + 0.0002).alias("lat"))).where("elevation IS NOT NULL")
    obs = s.select(F.col("site_id").alias("obs_id"), F.col("lon").alias("obs_lon"), F.col("lat").alias("obs_lat"), F.col("elevation").alias("obs_elev"))
    return terrain.viewshed(obs, _sampler(spark), 3000.0, step_m=60.0, azimuth_step=2.0)


@plan("isochrone")
def isochrone(spark, sf):
    probes = terrain.isochrone_probes(sites(spark, sf).select(F.col("site_id").alias("origin_id"), "lon", "lat"), 15)
    durations = probes.select("origin_id", "spoke", "ring", (F.col("ring") * 150.0 * (1 + F.col("spoke") % 4 / 4)).alias("seconds"))
    return terrain.isochrone(probes, durations, 15)


def _elements(spark, sf):
    s = readers.table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("sat_id"), (40 + F.col("s_suppkey") % 60).cast("double").alias("inclination"), (F.col("s_suppkey") * 7 % 360).cast("double").alias("raan"),
        (F.col("s_suppkey") * 31 % 360).cast("double").alias("mean_anomaly"), (14.0 + F.col("s_suppkey") % 10 / 10).alias("mean_motion"), F.lit("2024-01-01").cast("timestamp").alias("epoch"),
    )


@plan("satellite_passes")
def satellite_passes(spark, sf):
    pos = terrain.kepler_j2_positions(_elements(spark, sf), "2024-01-01 00:00:00", "2024-01-01 12:00:00", 60)
    ox, oy, oz = geo.geodetic_to_ecef(F.lit(24.5), F.lit(54.5), F.lit(0.0))
    up = geo.elevation_angle(F.lit(24.5), F.lit(54.5), ox, oy, oz, "x", "y", "z")
    return terrain.passes(pos.select("sat_id", "t", up.alias("elevation")))


@plan("ground_track")
def ground_track(spark, sf):
    pos = terrain.kepler_j2_positions(_elements(spark, sf), "2024-01-01 00:00:00", "2024-01-01 02:00:00", 120)
    lat, lon, alt = geo.ecef_to_geodetic("x", "y", "z")
    return pos.select("sat_id", "t", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"), F.round(alt / 1000, 2).alias("alt_km"))


_ORB = """o AS (SELECT o_custkey AS norad_id, o_orderdate + to_microseconds(o_orderkey) AS epoch, 50 + (o_orderkey % 7) * 0.03::DOUBLE AS inclination, (o_orderkey % 360)::DOUBLE AS raan, 0.001::DOUBLE * (1 + o_orderkey % 9) AS eccentricity, 15 + (o_orderkey % 11) * 0.004::DOUBLE AS mean_motion FROM orders),
l AS (SELECT *, lag(epoch) OVER w AS pe, lag(inclination) OVER w AS pi_, lag(eccentricity) OVER w AS pec, lag(mean_motion) OVER w AS pm FROM o WINDOW w AS (PARTITION BY norad_id ORDER BY epoch))"""


@plan(
    "orbit_anomalies",
    f"""WITH {_ORB}, q AS (SELECT norad_id, epoch, (epoch_us(epoch) - epoch_us(pe)) / 86400e6 AS dt, abs(1440 / mean_motion - 1440 / pm) AS dp, abs(inclination - pi_) AS di, abs(eccentricity - pec) AS de, mean_motion - pm AS dm FROM l WHERE pe IS NOT NULL)
SELECT norad_id, epoch, round(dt, 6) AS dt_days, round(dp, 6) AS d_period, round(di, 6) AS d_inclination, round(de, 6) AS d_eccentricity, coalesce(dt >= 0.5 AND abs(dm / dt) > 0.01, false) AS decay FROM q""",
)
def anomalies(spark, sf):
    o = readers.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    e = o.select(
        F.col("o_custkey").alias("norad_id"), F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k).alias("epoch"), (50 + (k % 7) * 0.03).alias("inclination"),
        (k % 360).cast("double").alias("raan"), (0.001 * (1 + k % 9)).alias("eccentricity"), (15 + (k % 11) * 0.004).alias("mean_motion"),
    )
    a = terrain.orbit_anomalies(e)
    return a.select("norad_id", "epoch", *(F.round(c, 6).alias(c) for c in ("dt_days", "d_period", "d_inclination", "d_eccentricity")), "decay")


@plan("json_feed", "SELECT event_id AS poll, 0 AS pos, event_type, value AS latitude, value / 2 AS longitude, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS observed_at FROM events")
def json_feed(spark, sf):
    e = readers.table(spark, sf, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    item = F.struct(F.col("event_type").alias("type"), F.col("value").alias("lat"), (F.col("value") / 2).alias("lon"), at.alias("time"))
    polls = e.select(F.col("event_id").alias("poll"), F.to_json(F.struct(F.array(item).alias("events"))).alias("body"))
    return readers.json_feed(polls).drop("payload")


@plan("geojson_feed", "SELECT event_id AS poll, 0 AS pos, event_type, value AS latitude, value / 2 AS longitude FROM events")
def geojson_feed(spark, sf):
    e = readers.table(spark, sf, "events")
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col("value") / 2, F.col("value")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("event_type").alias("type")).alias("properties"))
    return readers.geojson_feed(e.select(F.col("event_id").alias("poll"), F.to_json(F.struct(F.array(feature).alias("features"))).alias("body"))).drop("observed_at")


@plan("adsb_feed", "SELECT 'H' || event_id AS hex_ident, 'C' || user_id AS callsign, 1000.0::DOUBLE AS altitude_ft, value AS latitude, value / 2 AS longitude FROM events WHERE event_id % 3 > 0")
def adsb_feed(spark, sf):
    e = readers.table(spark, sf, "events")
    lat = F.when(F.col("event_id") % 3 > 0, F.col("value").cast("string")).otherwise(F.lit(""))
    c = F.lit("")
    fields = [F.lit("MSG"), F.lit("3"), F.lit("1"), F.lit("1"), F.concat(F.lit("H"), "event_id"), F.lit("1"), F.lit("2024/01/01"), F.lit("00:00:00"), c, c, F.concat(F.lit("C"), "user_id"), F.lit("1000"), c, c, lat, (F.col("value") / 2).cast("string"), c]
    return readers.adsb_feed(e.select(F.concat_ws(",", *fields).alias("value"))).select("hex_ident", "callsign", "altitude_ft", "latitude", "longitude")


@plan("tle_elements", "SELECT 10000 + s_suppkey % 80000 AS norad_id, 'SAT ' || s_suppkey AS name, (50 + s_suppkey % 40)::DOUBLE AS inclination, (s_suppkey % 360)::DOUBLE AS raan, 0.0012345::DOUBLE AS eccentricity, 15.5::DOUBLE AS mean_motion FROM supplier")
def tle(spark, sf):
    s = readers.table(spark, sf, "supplier")
    number, k = F.lpad((10_000 + F.col("s_suppkey") % 80_000).cast("string"), 5, "0"), F.col("s_suppkey")
    line1 = F.concat(F.lit("1 "), number, F.lit("U 98067A   24001.50000000  .00000000  00000-0  00000-0 0  9990"))
    line2 = F.concat(F.lit("2 "), number, F.lit(" "), F.lpad(F.format_string("%.4f", (50 + k % 40).cast("double")), 8, " "), F.lit(" "), F.lpad(F.format_string("%.4f", (k % 360).cast("double")), 8, " "), F.lit(" 0012345 000.0000 000.0000 15.50000000    10"))
    lines = s.select(F.col("s_suppkey").cast("string").alias("file"), F.posexplode(F.array(F.concat(F.lit("SAT "), k.cast("string")), line1, line2)).alias("n", "value"))
    return readers.tle_elements(readers.tle_lines(lines)).select("norad_id", "name", "inclination", "raan", "eccentricity", "mean_motion")


@plan("srt_telemetry", "SELECT s_suppkey AS clip_id, i::INT * 10 AS frame, round(i / 3.0, 3) AS t, 24.5::DOUBLE AS lat, 54.5::DOUBLE AS lon FROM supplier, range(3) r(i)")
def srt(spark, sf):
    block = lambda i: f"{i + 1}\n00:00:0{i // 3},{round(i % 3 * 1000 / 3):03d} --> 00:00:09,000\n[latitude: 24.5] [longitude: 54.5] [abs_alt: 120.0]"
    files = readers.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip_id"), F.lit("\n\n".join(block(i) for i in range(3))).alias("content"))
    return readers.telemetry_frames(readers.srt_samples(files), "clip_id", 30.0).select("clip_id", "frame", "t", "lat", "lon")


def run_stream(spark, sf, build):
    """A run to completion of a streaming aggregate over the event files, its table in the shared folder."""
    import uuid

    from geosweep.operators.graph import ensure_checkpoints

    ensure_checkpoints(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    path = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    counts = build(events)

    def put(batch, epoch):
        # complete mode: each epoch holds the whole result, the last one stands
        batch.write.mode("overwrite").parquet(f"{path}/table")

    query = counts.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/table")


@plan("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream(spark, sf):
    from geosweep.streaming.events import windowed_counts

    return run_stream(spark, sf, lambda events: windowed_counts(events, "ts", ["event_type"], "1 day"))
