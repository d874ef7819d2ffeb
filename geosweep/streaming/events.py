"""Structured Streaming forms of the event-driven operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geosweep.functions import geo


def windowed_counts(events: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, late: str = "30 days") -> DataFrame:
    """Counts per tumbling or sliding window; events later than ``late`` are let go."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))  # watermarks need a zoned type
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    events = events.withColumn(at, F.col(at).cast("timestamp"))  # watermarks need a zoned type
    s = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(s.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def near_sites(events: DataFrame, sites: DataFrame, radius: str) -> DataFrame:
    """Stream of detections joined to static sites within each site's radius."""
    s = sites.withColumnRenamed("lon", "r_lon").withColumnRenamed("lat", "r_lat")
    d = geo.haversine("lon", "lat", "r_lon", "r_lat")
    return events.join(F.broadcast(s), geo.within_band("r_lon", "r_lat", "lon", "lat", F.col(radius))).withColumn("distance_m", d).where(F.col("distance_m") <= F.col(radius))


def throttled(events: DataFrame, key: str, at: str, within: str = "300 seconds") -> DataFrame:
    """First event of a key in a stretch; repeats within it are dropped."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def running_counters(events: DataFrame, key: str) -> DataFrame:
    """Per key the count and latest time so far, as keyed state that never expires."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for rows in batches:
            n, last = n + len(rows), max(last, int(rows["at"].max()))
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last_seen": [last]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} string, n long, last_seen long", "n long, last long", "update", GroupStateTimeout.NoTimeout)


def fan_out(batch: DataFrame, epoch: int, folder: str) -> None:
    """Write one feed batch as events, tracks, track points, observations and timeline rows."""
    uid = F.coalesce(*(F.get_json_object("payload", f"$.{k}") for k in ("track_id", "mmsi", "icao")), F.concat(F.lit("feed-"), F.col("source_id").cast("string")))
    rows = batch.withColumn("track_uid", uid).withColumn("confidence", F.coalesce(F.get_json_object("payload", "$.confidence").try_cast("double"), F.lit(0.7))).persist()
    points = rows.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    parts = {
        "feed_events": rows.select("source_id", "event_type", "latitude", "longitude", "observed_at", "payload"),
        "tracks": points.groupBy("track_uid").agg(F.max("observed_at").alias("last_seen")),
        "track_points": points.select("track_uid", "latitude", "longitude", "observed_at"),
        "observations": points.select("source_id", "event_type", "latitude", "longitude", "confidence", "observed_at"),
        "timeline": rows.select("event_type", "observed_at"),
    }
    for name, df in parts.items():
        # one folder per epoch: a replayed epoch overwrites what it wrote
        df.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")
    rows.unpersist()
