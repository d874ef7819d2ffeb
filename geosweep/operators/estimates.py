"""Sizes, position uncertainty, band scaling, label normalisation and identification of detections."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosweep.functions.geo import M_PER_DEG, WGS84_A, col
from geosweep.functions.labels import canonical, strip_source
from geosweep.operators.shapes import rectangle_of

#: Range of SAR backscatter in decibels, scale of reflectances, share above which an identification applies itself.
SAR_DB = (-30.0, 0.0)
REFLECTANCE_SCALE = 0.0001
AUTO_SCORE = 0.85
#: WGS84 flattening, scale of the central meridian, false easting and northing of UTM.
FLATTENING = 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm_zone(lon) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), F.floor((col(lon) + 180) / 6) + 1))


def utm(lon, lat, zone) -> tuple[Column, Column]:
    """Easting and northing in a UTM zone, by the transverse Mercator series to the third order of the flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    bend = 2 * math.sqrt(n) / (1 + n)
    turn, height = F.radians(col(lon) - (zone * 6 - 183)), F.sin(F.radians(col(lat)))
    t = F.sinh(F.atanh(height) - bend * F.atanh(bend * height))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    north = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return UTM_EAST + UTM_SCALE * radius * east, F.when(col(lat) < 0, UTM_SOUTH).otherwise(0.0) + UTM_SCALE * radius * north


def estimated_sizes(rows: DataFrame, ring: str, pixel_w: str, pixel_h: str, mask_px: str, edge_px: float = 2.0) -> DataFrame:
    """Length, width, area and bearing of each outline ``ring`` of (lon, lat) corners, with their uncertainties.

    Corners are taken to the UTM zone of their mean.  The area is that of the mask's pixels where it has any,
    otherwise the rectangle's.  An outline without area gives nulls.
    """
    n = F.size(ring)
    middle = F.when(n > 0, F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lon"]) / n)
    metres = rows.withColumn("__zone", utm_zone(middle)).withColumn("__ring", F.transform(ring, lambda p: F.struct(*(c.alias(k) for k, c in zip("xy", utm(p["lon"], p["lat"], F.col("__zone")), strict=True)))))
    sized = metres.withColumn("__size", rectangle_of("__ring"))
    length, width, w, h = F.col("__size.length_m"), F.col("__size.width_m"), F.col(pixel_w), F.col(pixel_h)
    area = F.when(F.col(mask_px) > 0, F.col(mask_px) * w * h).otherwise(length * width)
    some = F.col("__size").isNotNull()
    return sized.select(
        *rows.columns, length.alias("length_m"), width.alias("width_m"), F.col("__size.bearing_deg").alias("bearing_deg"), F.when(some, F.round(area, 3)).alias("area_m2"),
        F.when(some, F.round(edge_px * w, 3)).alias("length_error_m"), F.when(some, F.round(edge_px * h, 3)).alias("width_error_m"),
        F.round(2 * (length + width) * edge_px * F.greatest(w, h), 3).alias("area_error_m2"),
    )


def uncertainty_ellipse(pixel_w, pixel_h, lat, geographic) -> list[Column]:
    """(semi_major_m, semi_minor_m, bearing_deg) of twice the pixel size, 95 % of positions; degrees become metres at ``lat``."""
    east = 2 * F.abs(col(pixel_w)) * F.when(col(geographic), M_PER_DEG * F.greatest(F.cos(F.radians(col(lat))), F.lit(0.01))).otherwise(1.0)
    north = 2 * F.abs(col(pixel_h)) * F.when(col(geographic), M_PER_DEG).otherwise(1.0)
    bearing = F.when(north >= east, 0.0).otherwise(90.0)
    return [F.round(F.greatest(east, north), 3).alias("semi_major_m"), F.round(F.least(east, north), 3).alias("semi_minor_m"), bearing.alias("bearing_deg")]


def scaled_bands(pixels: DataFrame, image: list[str], value: str) -> DataFrame:
    """Pixels with ``sar`` (backscatter within its range of decibels, 0 to 1) and ``reflectance``.

    An image without negative values holds linear power and is taken to decibels; one whose mean is above 1 holds
    integers of reflectance and is scaled.  Missing pixels have the floor as ``sar`` and no reflectance.  The two
    facts of each image come from one aggregation, which is partial before it is shuffled.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    facts = pixels.groupBy(*image).agg((F.min(v) >= 0).alias("__linear"), (F.avg(v) > 1).alias("__integer"))
    low, high = SAR_DB
    decibels = F.when(F.col("__linear"), 10 * F.log10(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(1e-6)))).otherwise(F.coalesce(v, F.lit(low)))
    return pixels.join(facts, image).select(
        *pixels.columns, ((F.least(F.greatest(decibels, F.lit(low)), F.lit(high)) - low) / (high - low)).alias("sar"),
        F.when(F.col("__integer"), v * REFLECTANCE_SCALE).otherwise(v).alias("reflectance"),
    )


def normalise_labels(rows: DataFrame, label: str, objects: DataFrame, branches: list[tuple[str, str]]) -> DataFrame:
    """Rows with the branch_id, object_id, canonical_label and was_unknown that the ontology gives to their label.

    A label, as it is or without the prefix of its source, is looked up among the objects' labels and ids, then among
    their prompts; then the first branch whose pattern it holds takes it; else it stays itself in branch Other.
    ``branches`` is the configured list (branch id, pattern) in order.  Only distinct labels are looked up; of
    objects with one key that of the least id counts.  Null and blank labels are Other and unknown.
    """
    keys = [(0, canonical("label")), (0, canonical("object_id")), (1, canonical("prompt"))]
    found = F.struct("object_id", "label", "branch_id")
    book = reduce(DataFrame.unionByName, (objects.select(F.lit(kind).alias("kind"), key.alias("key"), found.alias("found")) for kind, key in keys))
    book = book.where("key <> ''").groupBy("kind", "key").agg(F.min("found").alias("found"))
    own, bare = canonical("__label"), canonical(strip_source(F.coalesce(F.col("__label"), F.lit(""))))
    names = rows.select(F.col(label).alias("__label")).distinct().select("__label", own.alias("own"), F.when(own == "", "").otherwise(bare).alias("bare"))
    ways = F.array(*(F.struct(F.lit(2 * kind + i).alias("place"), F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind in (0, 1) for i, c in enumerate(("own", "bare"))))
    hits = names.select("__label", F.explode(ways).alias("w")).select("__label", "w.*").join(book, ["kind", "key"])
    hits = hits.groupBy("__label").agg(F.min(F.struct("place", "found")).alias("hit")).select(F.col("__label").alias("__hit"), "hit.found")
    known = names.join(hits, F.col("__label") == F.col("__hit"), "left")
    forms = [F.translate(c, "_", " ") for c in ("own", "bare")] + [F.col("own"), F.col("bare")]
    branch = F.coalesce(*(F.when(reduce(lambda a, b: a | b, (f.rlike(pattern) for f in forms)), name) for name, pattern in branches)) if branches else F.lit(None).cast("string")
    branch = F.when(F.col("own") != "", branch)
    told = known.select(
        F.col("__label").alias("__name"), F.coalesce("found.branch_id", branch, F.lit("Other")).alias("branch_id"), F.col("found.object_id").alias("object_id"),
        F.coalesce("found.label", F.when(F.trim("__label") != "", F.trim("__label")), F.lit("unknown")).alias("canonical_label"),
        (F.col("found").isNull() & branch.isNull()).alias("was_unknown"),
    )
    return rows.join(told, rows[label].eqNullSafe(told["__name"])).drop("__name")


def identified(scores: DataFrame, item: str, candidate: str, score: str, k: int = 3, auto: float = AUTO_SCORE) -> DataFrame:
    """The k best candidates of each item, ranked; the first applies itself (``auto_applied``) from ``auto`` on, the others are ``pending``."""
    order = Window.partitionBy(item).orderBy(F.desc(score), candidate)
    status = F.when((F.col("rank") == 1) & (F.col(score) >= auto), "auto_applied").otherwise("pending")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("status", status)
