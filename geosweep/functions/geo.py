"""Geometry and geodesy as Column expressions; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius for graph distances, plain radius for link scores, WGS84 axes.
MEAN_RADIUS_M = 6_371_008.8
PLAIN_RADIUS_M = 6_371_000.0
WGS84_A = 6_378_137.0
WGS84_E2 = 6.69437999014e-3
M_PER_DEG = 111_320.0


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine(lon1, lat1, lon2, lat2, model: str = "asin") -> Column:
    """Great-circle metres: ``asin`` on the mean radius, or ``atan2`` on the plain one."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    if model == "asin":
        return 2 * MEAN_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), s)))
    return PLAIN_RADIUS_M * 2 * F.atan2(F.sqrt(s), F.sqrt(1 - s))


def wrap_lon(lon) -> Column:
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def destination(lon, lat, bearing_deg, metres) -> tuple[Column, Column]:
    """Longitude and latitude reached along a great circle."""
    phi, theta, d = F.radians(col(lat)), F.radians(col(bearing_deg)), col(metres) / MEAN_RADIUS_M
    lat2 = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(theta))
    lon2 = F.radians(col(lon)) + F.atan2(F.sin(theta) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(lat2))
    return wrap_lon(F.degrees(lon2)), F.degrees(lat2)


def equirectangular(lon, lat, lat0) -> tuple[Column, Column]:
    """Local metres about a reference latitude."""
    k = math.pi / 180 * MEAN_RADIUS_M
    return col(lon) * k * F.cos(F.radians(col(lat0))), col(lat) * k


def metres_per_degree(lat) -> tuple[Column, Column]:
    """(per degree of latitude by series, per degree of longitude)."""
    r = F.radians(col(lat))
    return F.lit(111_132.954) - 559.822 * F.cos(2 * r) + 1.175 * F.cos(4 * r), F.lit(math.pi / 180 * MEAN_RADIUS_M) * F.cos(r)


def cell_center(x, size: float, digits: int = 6) -> Column:
    return F.round(F.floor(col(x) / size) * size + size / 2, digits)


def snap(x, size: float) -> Column:
    """Nearest multiple of the grid size."""
    return F.round(F.round(col(x) / size) * size, 9)


def in_bbox(lon, lat, box: tuple[float, float, float, float]) -> Column:
    """Inclusive envelope test on plain columns, so that it reaches Parquet statistics."""
    return col(lon).between(box[0], box[2]) & col(lat).between(box[1], box[3])


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4 or not (parts[0] < parts[2] and parts[1] < parts[3]):
        raise ValueError("bbox must be min_lon,min_lat,max_lon,max_lat with min below max")
    return tuple(parts)


def within_band(lon1, lat1, lon2, lat2, metres) -> Column:
    """Cheap necessary condition of a radius test."""
    d = col(metres) / 110_000.0
    return (F.abs(col(lat1) - col(lat2)) <= d) & (F.abs(col(lon1) - col(lon2)) <= d / F.greatest(F.cos(F.radians(col(lat1))), F.lit(0.01)))


def iou_xyxy(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = map(col, (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    w = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    h = F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    area = lambda x1, y1, x2, y2: F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)
    union = area(ax1, ay1, ax2, ay2) + area(bx1, by1, bx2, by2) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def overlap_area(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Area that two boxes share; null where they share none."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = map(col, (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    given = bx1.isNotNull() & ax1.isNotNull()
    return F.when(given & (w > 0) & (h > 0), w * h)


def affine(x, y, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Map coordinates of a pixel by (x0, dx/col, dx/row, y0, dy/col, dy/row)."""
    x0, xc, xr, y0, yc, yr = transform
    return x0 + col(x) * xc + col(y) * xr, y0 + col(x) * yc + col(y) * yr


def iou_cxcywh(a: list, b: list) -> Column:
    corners = lambda q: (col(q[0]) - col(q[2]) / 2, col(q[1]) - col(q[3]) / 2, col(q[0]) + col(q[2]) / 2, col(q[1]) + col(q[3]) / 2)
    return iou_xyxy(*corners(a), *corners(b))


def xyxy_to_cxcywh(x1, y1, x2, y2, width, height) -> list[Column]:
    """Centre and size as shares of the frame, within 0..1."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    x1, y1, x2, y2, w, h = map(col, (x1, y1, x2, y2, width, height))
    return [unit((x1 + x2) / 2 / w), unit((y1 + y2) / 2 / h), unit((x2 - x1) / w), unit((y2 - y1) / h)]


def square_ring(lon, lat, half: float) -> Column:
    point = lambda x, y: F.array(x, y)
    lon, lat = col(lon), col(lat)
    return F.array(*(point(lon + dx * half, lat + dy * half) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))


def point_in_ring(lon, lat, ring) -> Column:
    """Even-odd ray casting over an array of (x, y) structs; closing the ring is optional."""
    lon, lat, ring = col(lon), col(lat), col(ring)
    n = F.size(ring)
    edge = lambda i: F.struct(F.element_at(ring, i + 1).alias("a"), F.element_at(ring, F.pmod(i + 1, n).cast("int") + 1).alias("b"))
    crosses = lambda e: ((e.a.y > lat) != (e.b.y > lat)) & (lon < (e.b.x - e.a.x) * (lat - e.a.y) / (e.b.y - e.a.y) + e.a.x)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), edge), F.lit(False), lambda acc, e: acc != F.coalesce(crosses(e), F.lit(False)))


def ring_area(ring) -> Column:
    """Unsigned shoelace area."""
    ring = col(ring)
    n = F.size(ring)
    term = lambda i: (
        F.element_at(ring, i + 1).x * F.element_at(ring, F.pmod(i + 1, n).cast("int") + 1).y - F.element_at(ring, F.pmod(i + 1, n).cast("int") + 1).x * F.element_at(ring, i + 1).y
    )
    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, x: a + x)) / 2


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 for a zero vector, null where lengths differ or either is null."""
    a, b = col(a), col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0)))


def native_max_zoom(gsd_m) -> Column:
    """Zoom level whose pixels match the ground sample distance, within 10..24."""
    return F.greatest(F.lit(10), F.least(F.lit(24), F.round(F.log2(156_543.03 / col(gsd_m))))).cast("int")


def tile_bounds(z, x, y) -> list[Column]:
    """Longitude and latitude bounds (west, south, east, north) of a web map tile."""
    n = F.pow(F.lit(2.0), col(z))
    lat = lambda t: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * t / n))))
    return [col(x) / n * 360 - 180, lat(col(y) + 1), (col(x) + 1) / n * 360 - 180, lat(col(y))]


def geodetic_to_ecef(lat, lon, alt=0.0) -> list[Column]:
    phi, lam, h = F.radians(col(lat)), F.radians(col(lon)), col(alt)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(phi), 2))
    return [(n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - WGS84_E2) + h) * F.sin(phi)]


def ecef_to_geodetic(x, y, z) -> list[Column]:
    """Latitude, longitude, altitude by Bowring's closed form."""
    x, y, z = map(col, (x, y, z))
    b = WGS84_A * math.sqrt(1 - WGS84_E2)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * WGS84_A, p * b)
    lat = F.atan2(z + (WGS84_A**2 - b**2) / b * F.pow(F.sin(theta), 3), p - WGS84_E2 * WGS84_A * F.pow(F.cos(theta), 3))
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(lat), 2))
    pole = p < 1e-9
    return [
        F.when(pole, F.signum(z) * 90.0).otherwise(F.degrees(lat)),
        F.degrees(F.atan2(y, x)),
        F.when(pole, F.abs(z) - b).otherwise(p / F.cos(lat) - n),
    ]


def elevation_angle(obs_lat, obs_lon, ox, oy, oz, sx, sy, sz) -> Column:
    rx, ry, rz = col(sx) - col(ox), col(sy) - col(oy), col(sz) - col(oz)
    r = F.sqrt(rx * rx + ry * ry + rz * rz)
    phi, lam = F.radians(col(obs_lat)), F.radians(col(obs_lon))
    up = (rx * F.cos(phi) * F.cos(lam) + ry * F.cos(phi) * F.sin(lam) + rz * F.sin(phi)) / r
    return F.when(r < 1e-6, F.lit(90.0)).otherwise(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))))


def gmst(jd) -> Column:
    """Greenwich mean sidereal time in radians, IAU 1982."""
    t = (col(jd) - 2_451_545.0) / 36_525.0
    seconds = 67_310.54841 + (876_600.0 * 3600 + 8_640_184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t
    return F.pmod(F.radians(seconds / 240.0), F.lit(2 * math.pi))


def footprint(lon, lat, altitude, hfov, vfov, azimuth) -> Column:
    """Ring of a camera's ground rectangle, turned clockwise by the azimuth."""
    lon, lat = col(lon), col(lat)
    alt, hf = F.coalesce(col(altitude), F.lit(200.0)), F.coalesce(col(hfov), F.lit(30.0))
    vf, az = F.coalesce(col(vfov), hf * 0.6), F.radians(F.coalesce(col(azimuth), F.lit(0.0)))
    w, h = alt * F.tan(F.radians(hf / 2)), alt * F.tan(F.radians(vf / 2))
    per_lon = M_PER_DEG * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    at = lambda sx, sy: F.struct(
        (lon + (sx * w * F.cos(az) + sy * h * F.sin(az)) / per_lon).alias("x"), (lat + (-sx * w * F.sin(az) + sy * h * F.cos(az)) / M_PER_DEG).alias("y")
    )
    return F.array(at(-1, -1), at(-1, 1), at(1, 1), at(1, -1), at(-1, -1))
