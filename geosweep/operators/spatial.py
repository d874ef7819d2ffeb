"""Spatial joins and proximity graphs.

Radius and neighbour joins are equi-joins on grid cells of at least the radius: one side
lies in its own cell, the other is copied to the nine cells around, so that no pair of far
points meets.  A broadcast is taken only for a side whose row count has been checked.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosweep.functions import geo

BROADCAST_ROWS = 20_000


def _columns(row, size_lat: float, metres: float):
    """Number of cells in a row of latitude: each as wide as the radius at the row's far end and one row beyond."""
    top = F.least(F.greatest(F.abs(row * size_lat), F.abs((row + 1) * size_lat)) + size_lat, F.lit(90.0))
    share = math.sin(min(metres / (2 * geo.MEAN_RADIUS_M), math.pi / 2)) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), share * 1.01)))
    return F.greatest(F.lit(1), F.floor(360.0 / width).cast("long"))


def _cells(df: DataFrame, lon: str, lat: str, metres: float, spread: bool) -> DataFrame:
    """Cell (__cx, __cy) of each row; with ``spread`` a copy for each cell that a point within the radius can be in.

    Rows are as high as the radius; each has its own number of columns, which go around the globe.
    """
    size_lat = metres / 110_000.0
    row = F.floor(F.col(lat) / size_lat)

    def column(r, shift):
        n = _columns(r, size_lat, metres)
        return F.pmod(F.floor((F.col(lon) + 180.0) / 360.0 * n) + shift, n)

    if not spread:
        return df.withColumn("__cy", row).withColumn("__cx", column(row, 0))
    around = F.array_distinct(F.array(*(F.struct(column(row + dy, dx).alias("x"), (row + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    return df.withColumn("__c", F.explode(around)).withColumn("__cx", F.col("__c.x")).withColumn("__cy", F.col("__c.y")).drop("__c")


def sent_round(df: DataFrame) -> DataFrame:
    """A side of a join with a broadcast if its rows have been counted as few; else none is made, whatever the size of its files."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def _crowded(rows: DataFrame) -> bool:
    """Whether rows share their places, two or more each on average."""
    n, places = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("lon", "lat"))).first()
    return n >= 2 * places > 0


def _meeting(left: DataFrame, right: DataFrame, radius, max_radius: float, model: str) -> DataFrame:
    """Pairs of rows (the right side's place as r_lon, r_lat) within ``radius``, by cells."""
    r = right.withColumnRenamed("lon", "r_lon").withColumnRenamed("lat", "r_lat")
    distance = geo.haversine("lon", "lat", "r_lon", "r_lat", model)
    spread = _cells(r, "r_lon", "r_lat", max_radius, True)
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    pairs = _cells(left, "lon", "lat", max_radius, False).join(F.broadcast(spread) if small else spread.hint("merge"), ["__cx", "__cy"]).drop("__cx", "__cy")
    return pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= geo.col(radius))


def radius_join(left: DataFrame, right: DataFrame, radius, max_radius: float, model: str = "asin", digits: int | None = None) -> DataFrame:
    """Pairs within ``radius`` (a number, or a column of the right side, at most ``max_radius``) with distance_m, rounded to ``digits`` if given.

    Both sides have lon and lat; all other columns must differ in name.  Where many rows share a place,
    places meet once, and rows meet the places that theirs has met.
    """
    rounded = lambda df: df if digits is None else df.withColumn("distance_m", F.round("distance_m", digits))
    if not (_crowded(left) or _crowded(right)):
        return rounded(_meeting(left, right, radius, max_radius, model))
    from geosweep.operators.graph import settled

    right = right.withColumn("__radius", geo.col(radius).cast("double"))
    reach = ["lon", "lat", "__radius"]
    met = _meeting(left.select("lon", "lat").distinct(), right.select(reach).distinct(), "__radius", max_radius, model).transform(rounded).transform(settled)
    # the smaller side is led to the places of the other, which then has one join on a place
    r = right.withColumnRenamed("lon", "r_lon").withColumnRenamed("lat", "r_lat")
    led = sent_round(met).join(r, ["r_lon", "r_lat", "__radius"])
    names = [*(c for c in left.columns if c not in ("lon", "lat")), "lon", "lat", *(c for c in r.columns if c != "__radius"), "distance_m"]
    if r.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(sent_round(met), ["lon", "lat"]).join(F.broadcast(r), ["r_lon", "r_lat", "__radius"]).select(names)
    return left.join(led, ["lon", "lat"]).select(names)


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, start_m: float = 1000.0, exclude_equal: bool = False, digits: int | None = None) -> DataFrame:
    """The k nearest of ``right`` for each of ``left`` (ties by right_id; of distances rounded to ``digits``, if given), by widening rings.

    A left row is settled by a ring once it has k neighbours within its radius; the rest
    go on with four times the radius, and beyond half the globe all that is found counts.
    Only left rows with few neighbours near ever reach the wide rings.  Places are searched once for all
    left rows that share them, and of the right rows at one place only those of least id can count.
    """
    from geosweep.operators.graph import ensure_checkpoints, settled

    ensure_checkpoints(left.sparkSession)
    wanted = k + int(exclude_equal)
    here = Window.partitionBy("lon", "lat").orderBy(right_id)
    right = right.withColumn("__at", F.row_number().over(here)).where(F.col("__at") <= wanted).drop("__at").transform(settled)
    total = right.limit(wanted).count()
    reach, todo, done = start_m, left.select("lon", "lat").distinct().transform(settled), None
    distance = F.col("distance_m") if digits is None else F.round("distance_m", digits)
    w = Window.partitionBy("lon", "lat").orderBy(distance, right_id)
    while True:
        last = reach > 20_100_000
        pairs = radius_join(todo, right, reach, reach)
        ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= wanted).transform(settled)
        if last or total <= 0:
            done = ranked if done is None else done.unionByName(ranked)
            break
        # what lies beyond the ring may be as far as its edge when rounded
        sure = F.col("distance_m") <= reach - (0.0 if digits is None else 10.0**-digits)
        full = ranked.where(sure).groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min(wanted, total)).select("lon", "lat")
        complete = ranked.join(full, ["lon", "lat"], "left_semi")
        done = complete if done is None else done.unionByName(complete)
        todo = todo.join(full, ["lon", "lat"], "left_anti").transform(settled)
        if not todo.limit(1).count():
            break
        reach *= 4
    # null places have no neighbours; the rows of a place get its neighbours
    found = left.join(sent_round(done.transform(settled)), ["lon", "lat"])
    if exclude_equal:
        mine = Window.partitionBy(left_id).orderBy(distance, right_id)
        found = found.where(F.col(left_id) != F.col(right_id)).withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
    return found.select(*(c for c in left.columns if c not in ("lon", "lat")), "lon", "lat", *(c for c in found.columns if c not in left.columns))


def undirected(pairs: DataFrame, a: str, b: str, value: str = "distance_m") -> DataFrame:
    return (
        pairs.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("a_id"), F.greatest(a, b).alias("b_id"), value)
        .groupBy("a_id", "b_id")
        .agg(F.min(value).alias(value))
    )


def _once(points: DataFrame) -> bool:
    """Whether no two points share an id."""
    n, ids = points.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    return n == ids


def radius_graph(points: DataFrame, metres: float, digits: int | None = None) -> DataFrame:
    """All pairs of points (id, lon, lat) within the radius, a_id below b_id."""
    other = points.select(F.col("id").alias("b"), "lon", "lat")
    pairs = radius_join(points.select(F.col("id").alias("a"), "lon", "lat"), other, metres, metres, digits=digits).where("a < b")
    # ids of one place each need no search for the least distance of a pair
    return pairs.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), "distance_m") if _once(points) else undirected(pairs, "a", "b")


def knn_graph(points: DataFrame, k: int, cap_m: float | None = None) -> DataFrame:
    """Each point joined to its k nearest, as an undirected graph, optionally within a cap."""
    other = points.select(F.col("id").alias("b"), "lon", "lat")
    pairs = knn_join(points.select(F.col("id").alias("a"), "lon", "lat"), other, k, "a", "b", exclude_equal=True)
    edges = undirected(pairs, "a", "b")
    return edges.where(F.col("distance_m") <= cap_m) if cap_m else edges


def _projected(points: DataFrame) -> DataFrame:
    mean = points.agg(F.avg("lat").alias("__lat0"))
    x, y = geo.equirectangular("lon", "lat", "__lat0")
    return points.crossJoin(F.broadcast(mean)).select("id", "lon", "lat", x.alias("x"), y.alias("y"))


def _empty_regions(rows: pd.DataFrame, kind: str, reach: float, span: float) -> pd.DataFrame:
    """Edges of one point (a, ax, ay) to the points within ``reach``, and a row of its own id if it has no longer ones.

    A blocker of an edge lies nearer to the point than the other end, so all are at hand.  A point c
    blocks every edge longer than ``reach`` within an angle of its direction; once these angles go
    all around, the point is settled.
    """
    xy = rows[["bx", "by"]].to_numpy(float) - rows[["ax", "ay"]].to_numpy(float)
    d2 = (xy**2).sum(axis=1)
    order = np.argsort(d2, kind="stable")
    rows, xy, d2 = rows.iloc[order], xy[order], d2[order]
    left = np.arange(len(xy))
    for at in range(0, len(xy), 64):  # the nearest block most
        c, c2 = xy[at : at + 64], d2[at : at + 64]
        far = ((xy[left][:, None] - c[None]) ** 2).sum(axis=2)
        sides = c2 + far if kind == "gabriel" else np.maximum(c2, far)
        # an end does not block its own edge: sides is d2 there
        left = left[~(sides < d2[left][:, None] * (1 - 1e-9)).any(axis=1)]
        if not len(left) or at + 64 > left[-1]:
            break
    out = [(i, b, False) for i, b in zip(rows["a"].iloc[left], rows["b"].iloc[left], strict=True)]
    near = d2 > 0
    length = np.sqrt(d2[near])
    least = length / reach + span * 1e-9 / (2 * length)
    turn, half = np.arctan2(xy[near, 1], xy[near, 0])[least < 1], np.arccos(least[least < 1]) - 1e-9
    begin = np.sort(turn - half)
    end = (turn + half)[np.argsort(turn - half)]
    covered = len(begin) > 0 and bool((np.append(begin[1:], begin[0] + 2 * np.pi) <= np.maximum.accumulate(end)).all())
    if covered:
        out.append((rows["a"].iloc[0], rows["a"].iloc[0], True))
    return pd.DataFrame(out, columns=["a", "b", "settled"])


def places(points: DataFrame) -> DataFrame:
    """The place of each (lon, lat), under the least id there."""
    return points.groupBy("lon", "lat").agg(F.min("id").alias("id")).select("id", "lon", "lat")


def empty_region_graph(points: DataFrame, kind: str, max_edge_m: float | None = None, start_m: float = 15_000.0) -> DataFrame:
    """Gabriel (empty circle over the edge) or relative neighbourhood (empty lune) graph.

    Points at one place are joined to each other and all to those of a place that theirs is joined to, as none
    lies between them: the graph is that of the places, and its edges are then those of their points.
    """
    from geosweep.operators.graph import settled

    points = points.select("id", "lon", "lat").transform(settled)
    known = places(points).transform(settled)
    edges = place_graph(points, kind, max_edge_m, start_m)
    if points.limit(1).count() == 0 or not _crowded(points) and _once(points) and known.count() == points.count():
        return edges
    here = points.join(known.select(F.col("id").alias("at"), "lon", "lat"), ["lon", "lat"]).select("id", "at").transform(settled)
    loops = known.select(F.col("id").alias("a_at"), F.col("id").alias("b_at"), F.lit(0.0).alias("distance_m"))
    ends = edges.select(F.col("a_id").alias("a_at"), F.col("b_id").alias("b_at"), "distance_m").unionByName(loops)
    of = lambda c: here.select(F.col("id").alias(c), F.col("at").alias(f"{c}_at"))
    met = ends.join(of("a"), "a_at").join(of("b"), "b_at").where((F.col("a_at") != F.col("b_at")) | (F.col("a") < F.col("b")))
    met = met.where("a <> b").select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"), "distance_m")
    return met if _once(points) else met.groupBy("a_id", "b_id").agg(F.min("distance_m").alias("distance_m"))


def place_graph(points: DataFrame, kind: str, max_edge_m: float | None = None, start_m: float = 15_000.0) -> DataFrame:
    """Gabriel or relative neighbourhood graph of the places of points, each under its least id.

    Exact for edges of any length, or up to ``max_edge_m``: places take the candidates within a radius,
    and those that could still have longer edges go on with twice the radius.
    """
    from geosweep.operators.graph import ensure_checkpoints, settled

    if kind not in ("gabriel", "rng"):
        raise ValueError(f"unknown graph {kind}")
    ensure_checkpoints(points.sparkSession)
    p = _projected(points).groupBy("lon", "lat", "x", "y").agg(F.min("id").alias("id")).transform(settled)
    low_x, high_x, low_y, high_y = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = float(np.hypot((high_x or 0) - (low_x or 0), (high_y or 0) - (low_y or 0))) * (1 + 1e-9) + 1.0
    last = span if max_edge_m is None else min(span, max_edge_m)
    a = p.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    id_type = points.schema["id"].dataType.simpleString()
    todo, found, reach = a, None, min(start_m, last)
    while True:
        cell = lambda x, y: (F.floor(F.col(x) / reach), F.floor(F.col(y) / reach))  # noqa: B023, E731
        ax, ay = cell("ax", "ay")
        bx, by = cell("bx", "by")
        around = F.explode(F.array(*(F.struct((bx + i).alias("cx"), (by + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        others = b.select("*", around.alias("c")).select("b", "bx", "by", "c.cx", "c.cy")
        near = todo.withColumn("cx", ax).withColumn("cy", ay).join(others, ["cx", "cy"]).where("a <> b")
        near = near.where(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= reach**2).select("a", "ax", "ay", "b", "bx", "by")
        step = near.groupBy("a").applyInPandas(lambda rows: _empty_regions(rows, kind, reach, span), f"a {id_type}, b {id_type}, settled boolean").transform(settled)  # noqa: B023
        edges = step.where("NOT settled").select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"))
        found = edges if found is None else found.unionByName(edges)
        if reach >= last:
            break
        todo = todo.join(step.where("settled").select("a"), "a", "left_anti").transform(settled)
        if not todo.limit(1).count():
            break
        reach = min(2 * reach, last)
    at = lambda end: p.select(F.col("id").alias(f"{end}_id"), F.col("lon").alias(f"{end}_lon"), F.col("lat").alias(f"{end}_lat"))
    ends = found.distinct().join(at("a"), "a_id").join(at("b"), "b_id")
    return ends.select("a_id", "b_id", geo.haversine("a_lon", "a_lat", "b_lon", "b_lat").alias("distance_m"))


def smallest_containing(points: DataFrame, areas: DataFrame, point_id: str, value: str) -> DataFrame:
    """For each point the value of the smallest area that holds it (ties by value); null without one.

    Areas have ring, an array of (x, y), or rings, an outer one and its holes; they may be concave, and
    meet points through a cover of cells (``polygons``).  A place is looked up once for all points there, and of
    areas of one shape the least value alone counts.
    """
    from geosweep.operators import polygons
    from geosweep.operators.graph import settled

    rings = F.col("rings") if "rings" in areas.columns else polygons.as_rings("ring")
    size = F.aggregate(F.transform(rings, lambda r: geo.ring_area(r)), F.lit(None).cast("double"), lambda a, x: F.coalesce(a - x, x))
    known = areas.select(F.struct(F.round(size, 9).alias("area"), F.col(value)).alias("__area"), rings.alias("__rings")).groupBy("__rings").agg(F.min("__area").alias("__area"))
    inside = polygons.contained(points.select("lon", "lat").distinct(), polygons.cover(known, "__area", "__rings"))
    best = inside.groupBy("lon", "lat").agg(F.min("__area").getField(value).alias(value)).transform(settled)
    return points.join(sent_round(best), ["lon", "lat"], "left").select(*points.columns, value)


def flat(xy: np.ndarray) -> bool:
    """Whether points are too few, or all on a line, for a triangle."""
    return len(xy) < 3 or np.linalg.matrix_rank(xy - xy.mean(axis=0), tol=1e-9) < 2


def delaunay(points: pd.DataFrame) -> list[tuple[int, int]]:
    """Index pairs of a Delaunay triangulation by incremental insertion (Bowyer and Watson); all pairs of flat points.

    A point is tested against all triangles at once; a test within rounding of the limit is done again by elimination.
    """
    xy = points[["x", "y"]].to_numpy(float)
    n = len(xy)
    if flat(xy):
        return [(i, j) for i in range(n) for j in range(i + 1, n)]
    centre, span = xy.mean(axis=0), max(np.ptp(xy, axis=0).max(), 1e-9)
    all_xy = np.vstack([xy, np.array([[0, 3], [-3, -2], [3, -2]]) * span * 1e4 + centre])
    corners, live = np.zeros((2 * n + 16, 3), int), 1
    corners[0] = n, n + 1, n + 2
    limit = 1e-12 * span**4

    def held(p: np.ndarray) -> np.ndarray:
        """Which triangles have the point within their circle."""
        t = all_xy[corners[:live]]
        m = t - p
        q = (m**2).sum(axis=2)
        a, b, c = t[:, 0], t[:, 1], t[:, 2]
        side = np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
        parts = [m[:, i, 0] * m[:, j, 1] * q[:, k] for i, j, k in itertools.permutations(range(3))]
        det = sum(s * x for s, x in zip((1, -1, -1, 1, 1, -1), parts, strict=True))
        inside = det * side > limit
        close = np.flatnonzero(np.abs(det * side - limit) <= 1e-11 * sum(np.abs(x) for x in parts))
        exact = np.linalg.det(np.concatenate([m[close], q[close][:, :, None]], axis=2))
        inside[close] = exact * side[close] > limit
        return inside

    for i in range(n):
        bad = np.flatnonzero(held(all_xy[i]))
        if not len(bad):
            continue
        t = corners[bad]
        sides, times = np.unique(np.sort(np.concatenate([t[:, :2], t[:, 1:], t[:, [0, 2]]]), axis=1), axis=0, return_counts=True)
        rim = sides[times == 1]
        new = np.sort(np.column_stack([rim, np.full(len(rim), i)]), axis=1)
        keep = np.delete(corners[:live], bad, axis=0)
        live = len(keep) + len(new)
        if live > len(corners):
            corners = np.zeros((2 * live, 3), int)
        corners[: len(keep)], corners[len(keep) : live] = keep, new
    t = corners[:live]
    edges = np.unique(np.sort(np.concatenate([t[:, :2], t[:, 1:], t[:, [0, 2]]]), axis=1), axis=0)
    return [(int(a), int(b)) for a, b in edges if b < n]


def delaunay_graph(points: DataFrame, key: str) -> DataFrame:
    """Delaunay edges within each group of ``key``, a place under its least id (a group's places must fit a task: the triangulation is sequential).

    Points of a group whose places are too few or on one line are all joined, those at one place too.
    """
    from geosweep.operators.graph import settled

    located = _projected_by(points, key).transform(settled)
    known = located.groupBy(key, "x", "y").agg(F.min("id").alias("id")).transform(settled)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        k = rows[key].iloc[0]
        if flat(rows[["x", "y"]].to_numpy(float)):
            # a row without ends: all pairs of the group's points are formed by a join
            return pd.DataFrame([(k, None, None)], columns=[key, "a_id", "b_id"]).astype({"a_id": "Int64", "b_id": "Int64"})
        return pd.DataFrame([(k, rows["id"][a], rows["id"][b]) for a, b in delaunay(rows)], columns=[key, "a_id", "b_id"])

    kind = points.schema[key].dataType.simpleString()
    made = known.groupBy(key).applyInPandas(run, f"{key} {kind}, a_id long, b_id long").transform(settled)
    all_of = located.join(made.where("a_id IS NULL").select(key), key, "left_semi")
    a, b = all_of.select(key, F.col("id").cast("long").alias("a_id")), all_of.select(key, F.col("id").cast("long").alias("b_id"))
    return made.where("a_id IS NOT NULL").unionByName(a.join(b, key).where("a_id < b_id"))


def _projected_by(points: DataFrame, key: str) -> DataFrame:
    mean = points.groupBy(key).agg(F.avg("lat").alias("__lat0"))
    x, y = geo.equirectangular("lon", "lat", "__lat0")
    return points.join(mean, key).select(key, "id", x.alias("x"), y.alias("y"))


def minimum_spanning_tree(edges: DataFrame, nodes: DataFrame, weight: str = "distance_m") -> DataFrame:
    """Spanning forest by Boruvka rounds on a contracting graph: each component takes its lightest outgoing
    edge (ties by ids), components joined by such edges become one, and of the edges between two components
    only the lightest goes on.  A round halves the components at least; those without edges are done.
    """
    from geosweep.operators.graph import ensure_checkpoints, settled

    ensure_checkpoints(edges.sparkSession)
    known = nodes.select("id")
    edges = edges.select("a_id", "b_id", weight).join(known.withColumnRenamed("id", "a_id"), "a_id", "left_semi").join(known.withColumnRenamed("id", "b_id"), "b_id", "left_semi")
    item = F.struct(weight, "a_id", "b_id").alias("e")
    left, tree = edges.select(F.col("a_id").alias("ca"), F.col("b_id").alias("cb"), item).where("ca <> cb").transform(settled), None
    while left.limit(1).count():
        ends = left.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "e").unionByName(left.select(F.col("cb").alias("c"), F.col("ca").alias("to"), "e"))
        best = ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e").transform(settled)
        picked = best.select("e.*").distinct()
        tree = picked if tree is None else tree.unionByName(picked)
        # a component points along its edge; of two that point at each other the smaller is the root
        back = best.select(F.col("c").alias("to"), F.col("to").alias("again"))
        root = best.join(back, "to").select("c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up")).transform(settled)
        while True:
            jumped = root.join(root.select(F.col("c").alias("up"), F.col("up").alias("top")), "up").select("c", "up", "top").transform(settled)
            root = jumped.select("c", F.col("top").alias("up"))
            if not jumped.where("up <> top").limit(1).count():
                break
        at = lambda c: root.select(F.col("c").alias(c), F.col("up").alias(f"r{c}"))  # noqa: B023, E731
        joined = left.join(at("ca"), "ca").join(at("cb"), "cb").where("rca <> rcb")
        left = joined.groupBy(F.least("rca", "rcb").alias("ca"), F.greatest("rca", "rcb").alias("cb")).agg(F.min("e").alias("e")).transform(settled)
    return tree if tree is not None else edges.limit(0)


def spanning_tree_of(points: DataFrame) -> DataFrame:
    """Minimum spanning forest of points (id, lon, lat) over their relative neighbourhood graph.

    Points at one place hang on that of least id, at distance 0; ties go by ids, so that the lightest edge of two places is
    that of their least ids and the rest of the tree is that of the places.
    """
    from geosweep.operators.graph import settled

    points = points.select("id", "lon", "lat").transform(settled)
    known = places(points).transform(settled)
    tree = minimum_spanning_tree(place_graph(points, "rng"), known.select("id"))
    hung = points.join(known.withColumnRenamed("id", "a_id"), ["lon", "lat"]).where("id <> a_id")
    return tree.unionByName(hung.select(F.lit(0.0).alias("distance_m"), "a_id", F.col("id").alias("b_id")).distinct())
