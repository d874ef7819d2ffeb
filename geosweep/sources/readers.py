"""Scans, text feeds and sinks: everything parsed with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosweep.functions import geo

#: Poll limit, subtitle aliases, time formats of raster tags.
MAX_EVENTS = 500
SRT_LAT, SRT_LON, SRT_ALT = ("latitude", "lat"), ("longitude", "lon", "long"), ("altitude", "abs_alt")
TIME_FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMddHHmmss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(json: str | Column, *paths: str) -> Column:
    """First of the JSON paths that holds a number."""
    return F.coalesce(*(F.get_json_object(geo.col(json), f"$.{p}").try_cast("double") for p in paths))


def text(json: str | Column, *paths: str) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(geo.col(json), f"$.{p}"), F.lit("")) for p in paths))


def point_payload(json: str) -> list[Column]:
    """(lat, lon) from free-form keys; both null where either is not a number."""
    lat, lon = number(json, "lat", "latitude"), number(json, "lon", "lng", "longitude")
    both = lat.isNotNull() & lon.isNotNull()
    return [F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon")]


def json_feed(polls: DataFrame, body: str = "body", limit: int = MAX_EVENTS) -> DataFrame:
    """Events of polled bodies: an object with events or items, or a bare list; the first ``limit`` of each."""
    listed = F.coalesce(F.get_json_object(body, "$.events"), F.get_json_object(body, "$.items"), F.col(body))
    items = F.from_json(listed, "array<string>")
    rest = [c for c in polls.columns if c != body]
    events = polls.select(*rest, F.posexplode(F.slice(items, 1, limit)).alias("pos", "e"))
    return events.where(F.get_json_object("e", "$").startswith("{")).select(
        *rest, "pos", F.coalesce(text("e", "event_type", "type"), F.lit("observation")).alias("event_type"),
        number("e", "latitude", "lat").alias("latitude"), number("e", "longitude", "lon").alias("longitude"),
        text("e", "observed_at", "time", "timestamp").alias("observed_at"), F.col("e").alias("payload"),
    )


def geojson_feed(polls: DataFrame, body: str = "body", limit: int = MAX_EVENTS) -> DataFrame:
    """Features as events; a polygon is represented by the first vertex of its first ring."""
    items = F.from_json(F.get_json_object(body, "$.features"), "array<string>")
    rest = [c for c in polls.columns if c != body]
    f = polls.select(*rest, F.posexplode(F.slice(items, 1, limit)).alias("pos", "f")).withColumn("kind", F.get_json_object("f", "$.geometry.type"))
    at = lambda i: (
        F.when(F.col("kind") == "Point", number("f", f"geometry.coordinates[{i}]"))
        .when(F.col("kind") == "Polygon", number("f", f"geometry.coordinates[0][0][{i}]"))
        .when(F.col("kind") == "MultiPolygon", number("f", f"geometry.coordinates[0][0][0][{i}]"))
    )
    return f.select(
        *rest, "pos", F.coalesce(text("f", "properties.event_type", "properties.type"), F.lit("feature")).alias("event_type"),
        at(1).alias("latitude"), at(0).alias("longitude"), text("f", "properties.observed_at", "properties.time").alias("observed_at"),
    )


def adsb_feed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Position messages of BaseStation lines: MSG, at least 16 fields, both coordinates."""
    p = F.split(F.trim(value), ",")
    field = lambda i: F.get(F.col("p"), i)
    rows = lines.select(p.alias("p")).where((F.size("p") >= 16) & (field(0) == "MSG"))
    out = rows.select(
        field(4).alias("hex_ident"), F.nullif(F.trim(field(10)), F.lit("")).alias("callsign"), field(11).try_cast("double").alias("altitude_ft"),
        field(12).try_cast("double").alias("ground_speed_kt"), field(13).try_cast("double").alias("track_deg"), field(14).try_cast("double").alias("latitude"),
        field(15).try_cast("double").alias("longitude"),
        F.when((field(6) != "") & (field(7) != ""), F.concat(field(6), F.lit("T"), field(7), F.lit("Z"))).alias("observed_at"),
    )
    return out.where("latitude IS NOT NULL AND longitude IS NOT NULL")


def due_sources(sources: DataFrame, as_of: str, limit: int = 20) -> DataFrame:
    """Enabled web sources not seen within their interval, the longest unseen first."""
    now = F.lit(as_of).cast("timestamp")
    waited = now.cast("double") - F.col("last_seen").cast("double")
    due = sources.where(F.col("enabled") & F.lower("endpoint").rlike("^https?://") & (F.col("last_seen").isNull() | (waited > F.coalesce("poll_interval_seconds", F.lit(60)))))
    return due.orderBy(F.asc_nulls_first("last_seen"), "source_id").limit(limit)


def tle_lines(lines: DataFrame) -> DataFrame:
    """Element sets from numbered lines (file, n, value): a line 1 followed by a line 2, with the name line before, if any."""
    w = Window.partitionBy("file").orderBy("n")
    kept = lines.where(F.trim("value") != "").select("file", "n", F.rtrim("value").alias("v"))
    s = kept.select("*", F.lead("v").over(w).alias("v2"), F.lag("v").over(w).alias("v0")).where(F.col("v").startswith("1 ") & F.col("v2").startswith("2 "))
    named = F.when(~F.col("v0").startswith("2 ") & ~F.col("v0").startswith("1 "), F.trim("v0")).otherwise(F.lit(""))
    return s.select("file", "n", F.coalesce(named, F.lit("")).alias("name"), F.col("v").alias("line1"), F.col("v2").alias("line2"))


def tle_elements(tles: DataFrame) -> DataFrame:
    """Mean elements from the fixed columns; rows with a malformed field are left out."""
    cut = lambda line, a, b: F.trim(F.substring(line, a + 1, b - a))
    yy = cut("line1", 18, 20).try_cast("int")
    day = cut("line1", 20, 32).try_cast("double")
    year = F.when(yy < 57, 2000 + yy).otherwise(1900 + yy)
    epoch = F.timestamp_micros((F.unix_micros(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) + F.round((day - 1) * 86_400_000_000)).cast("long"))
    out = tles.select(
        cut("line1", 2, 7).try_cast("int").alias("norad_id"), "name", epoch.alias("epoch"), cut("line2", 8, 16).try_cast("double").alias("inclination"),
        cut("line2", 17, 25).try_cast("double").alias("raan"), F.concat(F.lit("0."), cut("line2", 26, 33)).try_cast("double").alias("eccentricity"),
        cut("line2", 43, 51).try_cast("double").alias("mean_anomaly"), cut("line2", 52, 63).try_cast("double").alias("mean_motion"),
    )
    return out.dropna(subset=["norad_id", "epoch", "inclination", "raan", "eccentricity", "mean_motion"])


def srt_samples(files: DataFrame, content: str = "content") -> DataFrame:
    """Telemetry samples of subtitle files: blocks with a time and both coordinates."""
    block = F.explode(F.split(content, r"\n\s*\n"))
    rest = [c for c in files.columns if c != content]
    b = files.select(*rest, block.alias("b"))
    time = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->"
    part = lambda i: F.regexp_extract("b", time, i).try_cast("double")
    value = lambda names: F.coalesce(*(F.nullif(F.regexp_extract("b", rf"(?i)\b{n}\s*[:=]\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double") for n in names))
    rows = b.select(*rest, F.round(part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000, 3).alias("t"), value(SRT_LAT).alias("lat"), value(SRT_LON).alias("lon"), value(SRT_ALT).alias("alt"))
    return rows.dropna(subset=["t", "lat", "lon"])


def _blocks(data: memoryview, at: int, end: int):
    """(key, type, size, count, payload) of the blocks of a stream of four-byte keys, containers (type 0) opened in place.

    Blocks are aligned to four bytes; one that is cut off ends the stream.
    """
    while at + 8 <= end:
        key, kind, size, count = bytes(data[at : at + 4]), data[at + 4], data[at + 5], int.from_bytes(data[at + 6 : at + 8], "big")
        first, at = at + 8, at + 8 + (size * count + 3 & ~3)
        if first + size * count > end:
            return
        if kind == 0 and size:
            yield from _blocks(data, first, first + size * count)
        elif key.strip(b"\x00 "):
            yield key, kind, size, count, data[first : first + size * count]


def gps_blocks(content: bytes) -> list[tuple[float, float, float | None]]:
    """(lat, lon, alt) of the first fix of each position block, divided by the scales that were given last."""
    scale, found = [1.0] * 5, []
    for key, kind, size, count, payload in _blocks(memoryview(content), 0, len(content)):
        numbers = lambda n: [int.from_bytes(payload[4 * i : 4 * i + 4], "big", signed=True) for i in range(n)]  # noqa: B023, E731
        if kind == ord("l") and key == b"SCAL" and size == 4:
            scale = [float(v) or 1.0 for v in numbers(count)]
        elif kind == ord("l") and key == b"GPS5" and size == 20 and count and len(scale) > 1:
            lat, lon, alt = numbers(3)
            found.append((lat / scale[0], lon / scale[1], alt / scale[2] if len(scale) > 2 else None))
    return found


def gpmd_samples(files: DataFrame, clip: str, content: str = "content", duration: str = "duration") -> DataFrame:
    """(clip, t, lat, lon, alt) of the position blocks of binary telemetry, spread evenly over the clip's duration.

    Without a duration the samples are a second apart; null or empty content has none.
    """
    kind = files.schema[clip].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for i, (value, seconds) in enumerate(zip(batch.column("content"), batch.column("duration").to_pylist(), strict=True)):
                fixes = gps_blocks(value.as_buffer().to_pybytes()) if value.is_valid else []
                span = seconds if seconds and seconds > 0 else float(len(fixes))
                at += [i] * len(fixes)
                rows += [(round(k / len(fixes) * span, 3), *fix) for k, fix in enumerate(fixes)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.float64()) for c in columns)], names=[clip, "t", "lat", "lon", "alt"])

    source = files.select(clip, F.col(content).alias("content"), F.col(duration).cast("double").alias("duration"))
    return source.mapInArrow(run, f"{clip} {kind}, t double, lat double, lon double, alt double")


def telemetry_frames(samples: DataFrame, clip: str, fps: float) -> DataFrame:
    """One row per clip and frame, the earliest sample of equals; the footprint ring comes along."""
    frame = F.round(F.col("t") * fps).cast("int")
    first = samples.withColumn("frame", frame).groupBy(clip, "frame").agg(F.min(F.struct("t", "lat", "lon", "alt")).alias("m"))
    none = F.lit(None).cast("double")
    return first.select(clip, "frame", "m.t", "m.lat", "m.lon", "m.alt", geo.footprint(F.col("m.lon"), F.col("m.lat"), F.col("m.alt"), none, none, none).alias("ring"))


def preferred_source(samples: DataFrame, clip: str, source: str, order: list[str]) -> DataFrame:
    """All samples of the first source in ``order`` that a clip has any of."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    best = samples.where(rank > 0).groupBy(clip).agg(F.min(rank).alias("__r"))
    return samples.join(best, clip).where(rank == F.col("__r")).drop("__r")


def raster_time(*tags: Column) -> Column:
    """First tag that reads as a time in any known format."""
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for t in tags for f in TIME_FORMATS))


def layover_risk(incidence) -> Column:
    return F.when(geo.col(incidence) < 25, "high").when(geo.col(incidence) < 35, "moderate").otherwise("low")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path; Spark lists no files without bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def feature_collection(rows: DataFrame, lon: str, lat: str, properties: list[str], order: list[str]) -> DataFrame:
    """One GeoJSON FeatureCollection of point features; an empty one without rows.

    The document is one value by nature: for exports of bounded result sets.
    """
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, feature.alias("f")))), lambda s: s.f)
    return rows.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), listed.alias("features"))).alias("geojson"))


def feature_lines(rows: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """Newline-delimited GeoJSON: one feature a row, for exports of any size."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def tile_rows(rows: DataFrame, z: int, x: int, y: int, columns: list[str]) -> DataFrame:
    """Rows of one map tile with tile-local coordinates on a 4096 grid."""
    west, south, east, north = geo.tile_bounds(F.lit(z), F.lit(x), F.lit(y))
    inside = rows.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    merc = lambda lat: F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483)))
    return inside.select(
        *columns, F.floor((F.col("lon") - west) / (east - west) * 4096).cast("int").alias("px"), F.floor((merc(north) - merc(F.col("lat"))) / (merc(north) - merc(south)) * 4096).cast("int").alias("py")
    )


def obb_ring(flat) -> Column:
    """Closed ring from a flat coordinate list of at least three points; null otherwise."""
    flat = geo.col(flat)
    n = F.size(flat)
    points = F.transform(F.sequence(F.lit(0), (n / 2 - 1).cast("int")), lambda i: F.struct(F.element_at(flat, 2 * i + 1).alias("x"), F.element_at(flat, 2 * i + 2).alias("y")))
    return F.when((n >= 6) & (n % 2 == 0), F.concat(points, F.slice(points, 1, 1)))


def stix_relations(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose two ends exist, with typed ids (kind--id)."""
    kinds = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (("platform", "infrastructure"), ("site", "location"), ("unit", "identity"), ("person", "identity")) for x in kv)), F.col("kind")), F.lit("observed-data"))
    named = objects.select("id", F.concat(kinds, F.lit("--"), F.col("id").cast("string")).alias("ref"))
    return (
        relations.join(named.select(F.col("id").alias("src"), F.col("ref").alias("source_ref")), "src")
        .join(named.select(F.col("id").alias("dst"), F.col("ref").alias("target_ref")), "dst")
        .select("source_ref", "target_ref", "relationship_type")
    )
