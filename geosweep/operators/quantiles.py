"""Exact quantiles of keys of any size, by refining histograms.

Of each key only counts are needed to tell in which range of values a rank lies: a pass counts the rows of
every range of the interval that holds the rank, and the next one looks at that range alone, between the least
and the greatest value that were found in it.  Once an interval holds a few rows, these are sorted.  No task or
window ever takes all rows of a key; what a pass sends is one row a range, added up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosweep.operators.graph import settled

#: Ranges an interval is cut into, and rows of an interval that are sorted at once.
RANGES, FEW = 1024, 2048


def _range_of(v: Column, low: Column, high: Column) -> Column:
    """Number of the range of ``v`` in [low, high]: never falls as v grows, 0 at the low end and the last at the high one."""
    share = (v / 2 - low / 2) / (high / 2 - low / 2)
    finite = F.least(F.lit(RANGES - 1), F.floor(share * RANGES)).cast("int")
    infinite = (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
    by_end = F.when(v == low, 0).when(v == high, RANGES - 1).otherwise(1)
    return F.when(low == high, 0).when(infinite, by_end).otherwise(finite)


def values_at(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, rank, v): the value of each wanted rank (0: the least) of its key; ``ranks`` has the keys and rank."""
    rows = rows.select(*keys, F.col(value).cast("double").alias("v"))
    span = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    open_ = ranks.select(*keys, "rank").distinct().join(span, keys).where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).withColumn("below", F.lit(0).cast("long")).transform(settled)
    done = None
    while True:
        small = (F.col("n") <= FEW) | (F.col("low") == F.col("high"))
        ended = open_.where(small)
        done = ended if done is None else done.unionByName(ended)
        open_ = open_.where(~small)
        if not open_.limit(1).count():
            break
        inside = rows.join(open_.select(*keys, "rank", "below", "low", "high"), keys).where(F.col("v").between(F.col("low"), F.col("high")))
        counted = inside.groupBy(*keys, "rank", "below", _range_of(F.col("v"), F.col("low"), F.col("high")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        # the ranges of an interval, RANGES at most, in one array each: the one that the rank falls into
        listed = counted.groupBy(*keys, "rank", "below").agg(F.array_sort(F.collect_list(F.struct("part", "n", "low", "high"))).alias("parts"))
        start = F.struct(F.col("below").alias("below"), F.lit(None).cast("struct<part: int, n: bigint, low: double, high: double>").alias("hit"))
        step = lambda s, p: F.when(s["hit"].isNotNull() | (F.col("rank") < s["below"] + p["n"]), F.struct(s["below"].alias("below"), F.coalesce(s["hit"], p).alias("hit"))).otherwise(F.struct((s["below"] + p["n"]).alias("below"), s["hit"].alias("hit")))
        found = listed.select(*keys, "rank", F.aggregate("parts", start, step).alias("s"))
        open_ = found.select(*keys, "rank", "s.hit.n", "s.hit.low", "s.hit.high", "s.below").transform(settled)
    same = done.where("low = high").select(*keys, "rank", F.col("low").alias("v"))
    few = rows.join(done.where("low < high").select(*keys, "rank", "below", "low", "high"), keys).where(F.col("v").between(F.col("low"), F.col("high")))
    sorted_ = few.groupBy(*keys, "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return same.unionByName(sorted_.select(*keys, "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v")))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], nearest: dict[str, float] | None = None) -> DataFrame:
    """(keys, n, one column for each share): quantiles between the two values next to them, or by nearest rank.

    Rows whose value is null or no number are left out.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, value)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).transform(settled)
    at = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in shares.items()}
    ends = {name: (F.floor(p), F.ceil(p)) for name, p in at.items()}
    exact = {name: F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n"))) - 1 for name, q in (nearest or {}).items()}
    wanted = [p for pair in ends.values() for p in pair] + list(exact.values())
    found = values_at(rows, keys, value, counts.select(*keys, F.explode(F.array(*(p.cast("long") for p in wanted))).alias("rank")))
    ranked = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("__at"))
    of = lambda p: F.try_element_at(F.col("__at"), p.cast("long"))
    between = lambda name: of(ends[name][0]) + (of(ends[name][1]) - of(ends[name][0])) * (at[name] - ends[name][0])
    # two equal values stay what they are, infinite ones too
    value_of = lambda name: F.when(of(ends[name][0]) == of(ends[name][1]), of(ends[name][0])).otherwise(between(name))
    return counts.join(ranked, keys).select(*keys, "n", *(value_of(name).alias(name) for name in shares), *(of(p).alias(name) for name, p in exact.items()))
