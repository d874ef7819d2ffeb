"""Filters, joins, roll-ups, top-k, set operations and keyed updates on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosweep.functions import geo


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Conjunction of the conditions that are given; None adds nothing."""
    kept = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, kept)) if kept else df


def live(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    """Rows that are not soft-deleted; tables without the column have none that are."""
    return df.where(F.col(deleted_at).isNull()) if deleted_at in df.columns else df


def time_range(column: str, start=None, end=None) -> Column | None:
    parts = [F.col(column) >= F.lit(start).cast("timestamp") if start else None, F.col(column) <= F.lit(end).cast("timestamp") if end else None]
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def recent(column: str, as_of, days: int) -> Column:
    """Moving window up to an explicit instant, so that a query has one result."""
    return F.col(column) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each key; ``order`` must be total for a unique result."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def latest(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """Newest row of each key, by a combinable maximum instead of a sort."""
    rest = [c for c in df.columns if c not in keys and c not in at]
    return df.groupBy(*keys).agg(F.max(F.struct(*at, *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in [*at, *rest]))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, keep_old_where_null: bool = False) -> DataFrame:
    """Merge by key: the newest row wins, or per column the newest value that is not null."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    if not keep_old_where_null:
        return both.groupBy(*keys).agg(F.max(F.struct("__src", F.col(order).alias("__at"), *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))
    value = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("__src", F.col(order).alias("__at"), F.col(c).alias("v")))).getField("v").alias(c)
    return both.groupBy(*keys).agg(*(value(c) for c in rest))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert with DO NOTHING on conflict."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh.dropDuplicates(keys))


def first_source_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the earliest listed source provides a key."""
    tagged = [p.withColumn("__rank", F.lit(i)) for i, p in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    rest = [c for c in parts[0].columns if c not in keys]
    return union.groupBy(*keys).agg(F.min(F.struct("__rank", *rest)).alias("m")).select(*keys, *(F.col(f"m.{c}").alias(c) for c in rest))


def one_current(df: DataFrame, kind: str, key: str, chosen) -> DataFrame:
    """Activate the chosen rows and nothing else of their kind (versioned settings)."""
    kinds = df.where(F.col(key).isin(*chosen)).select(F.col(kind).alias("__k")).distinct()
    return df.join(F.broadcast(kinds), F.col(kind) == F.col("__k"), "left").withColumn("is_current", F.when(F.col("__k").isNotNull(), F.col(key).isin(*chosen)).otherwise(F.col("is_current"))).drop("__k")


def mode_of(column: str) -> Column:
    """Most frequent value, the smallest of equals."""
    return F.mode(column, True)


def heatmap(points: DataFrame, lon: str, lat: str, size: float, n: int = 50) -> DataFrame:
    """Counts on a grid of nearest multiples, the n fullest cells."""
    cells = points.groupBy(geo.snap(lon, size).alias("lon"), geo.snap(lat, size).alias("lat")).agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.desc("n"), "lon", "lat").limit(n)


def od_flows(points: DataFrame, size: float = 0.02, min_flow: int = 1, track: str = "track_id", order: str = "observed_at") -> DataFrame:
    """Directed flows between consecutive distinct cells of each track."""
    cells = points.select(track, order, geo.cell_center("lon", size).alias("lon"), geo.cell_center("lat", size).alias("lat"))
    w = Window.partitionBy(track).orderBy(order)
    steps = cells.withColumn("from_lon", F.lag("lon").over(w)).withColumn("from_lat", F.lag("lat").over(w))
    moved = steps.where("from_lon IS NOT NULL AND (from_lon <> lon OR from_lat <> lat)")
    flows = moved.groupBy("from_lon", "from_lat", F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat")).agg(F.count(F.lit(1)).alias("weight"))
    return flows.where(F.col("weight") >= min_flow)


def matrix_edges(matrix: DataFrame, min_flow: float) -> DataFrame:
    """Rows (i, values) of a flow matrix as edges without the diagonal."""
    return matrix.select("i", F.posexplode("values").alias("j", "weight")).where((F.col("i") != F.col("j")) & (F.col("weight") >= min_flow))


def vector_mean(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean per key; vectors of another length than the key's longest are left out."""
    longest = df.groupBy(*keys).agg(F.max(F.size(vector)).alias("dim"))
    parts = df.join(longest, keys).where(F.size(vector) == F.col("dim")).select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c")).select(*keys, F.col("c.v").alias("centroid"))
