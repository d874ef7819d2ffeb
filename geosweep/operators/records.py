"""Record keeping: snapshots, replacements, guarded updates, review queues, rules and policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosweep.functions import geo

#: Category of a class, weights of a rule's parts, hours between polls, miss limits.
RULE_WEIGHTS = {"class": 4, "category": 2, "allegiance": 1}
SCHEDULE_HOURS = {"high": 1, "medium": 6, "low": 24}
LOST_AFTER, CLOUD_LIMIT, SEED_CONFIDENCE = 3, 0.7, 0.4


def snapshot(rows: DataFrame, keys: list[str], order: list[Column], fields: list[str], k: int = 25) -> DataFrame:
    """Newest k rows of each key as one ordered array, with the count of all; the sort key is the position."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = rows.select(*keys, *fields, n.alias("__n"))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    listed = F.array_sort(F.collect_list(F.struct("__n", *fields)))
    return ranked.where(F.col("__n") <= k).groupBy(*keys).agg(F.transform(listed, lambda s: F.struct(*(s[f].alias(f) for f in fields))).alias("items")).join(counted, keys)


def replace_pass(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows after a pass has been processed again: nothing old is left of the passes that the new rows name."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def emptied(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that no child refers to any more."""
    return parents.join(children.select(key).distinct(), key, "left_anti")


def merge_patch(json: str, patch: str) -> Column:
    """A flat JSON object after a merge patch: keys of the patch win, those set to null go."""
    both = F.map_concat(F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: ~F.array_contains(F.map_keys(F.from_json(patch, "map<string,string>")), k)), F.from_json(patch, "map<string,string>"))
    kept = F.map_filter(both, lambda _, v: v.isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def transition(rows: DataFrame, requests: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Status after requested transitions; a request counts only from a status that allows it."""
    asked = requests.groupBy(key).agg(F.min("to").alias("__to"))
    may = reduce(lambda a, b: a | b, ((F.col("__to") == to) & F.col("status").isin(*sources) for to, sources in allowed.items()))
    return rows.join(asked, key, "left").withColumn("status", F.when(may, F.col("__to")).otherwise(F.col("status"))).drop("__to")


def same_as(pairs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pending pairs without direction, best score first of repeats, less those rejected in either direction."""
    canonical = lambda df, *rest: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest).where("a <> b")
    best = canonical(pairs, "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    return best.join(canonical(rejected).distinct(), ["a", "b"], "left_anti")


def promote(edges: DataFrame, chosen: DataFrame, new_type: str) -> DataFrame:
    """Edge table after promotion: a chosen candidate edge gives way to one of the new type."""
    up = edges.where(F.col("type").startswith("CANDIDATE_")).join(chosen.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    rest = edges.join(up.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti")
    return rest.unionByName(up.withColumn("type", F.lit(new_type)).dropDuplicates(["src", "dst"]).select(*rest.columns))


def best_rule(rows: DataFrame, rules: DataFrame, row_id: str) -> DataFrame:
    """Most specific matching rule of each row (class 4, category 2, allegiance 1; null matches all; the newest of equals).

    Rules differ in which of their parts are null; each such pattern in use (eight at most) is one equi-join with
    its newest rule by key, and the pattern of greatest weight that found one wins.  A row stays one row.
    """
    parts = list(RULE_WEIGHTS)
    weight = reduce(lambda a, b: a + b, (F.when(F.col(p).isNotNull(), w).otherwise(0) for p, w in RULE_WEIGHTS.items()))
    weighed = rules.withColumn("__w", weight)
    found = []
    for used in sorted((r["__w"] for r in weighed.select("__w").distinct().collect()), reverse=True):
        keys, name = [p for p in parts if RULE_WEIGHTS[p] & used], f"__o{used}"
        newest = weighed.where(F.col("__w") == used).groupBy(*keys).agg(F.max(F.struct("updated_at", "outcome")).getField("outcome").alias(name))
        # with no part given there is one newest rule, or none
        rows = rows.join(newest, keys, "left") if keys else rows.crossJoin(F.broadcast(newest))
        found.append(name)
    return rows.withColumn("outcome", F.coalesce(*found, F.lit("unrated"))).drop(*found)


def resolve_policy(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """Settings by key from layers of rising priority; a null value falls through to the layer below."""
    union = reduce(lambda a, b: a.unionByName(b), (x.select(key, value, F.lit(i).alias("layer")) for i, x in enumerate(layers)))
    best = union.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(F.struct("layer", F.col(value).alias("v"))).alias("m"))
    return best.select(key, F.col("m.v").alias(value), F.col("m.layer").alias("layer"))


def aged(tracks: DataFrame, inside: Column, cloud: Column, lost_after: int = LOST_AFTER) -> DataFrame:
    """Unmatched tracks after a pass: a miss counts only inside the footprint and under few clouds; three lose a track."""
    misses = F.col("misses") + (inside & (cloud <= CLOUD_LIMIT)).cast("int")
    return tracks.withColumn("misses", misses).withColumn("status", F.when(F.col("misses") >= lost_after, F.lit("lost")).otherwise(F.col("status")))


def clip_to_mask(boxes: DataFrame, mask: DataFrame, floor: float = 0.2) -> DataFrame:
    """Boxes (det_id, scene, whole-pixel x1..y2, ends left out) shrunk to the envelope of their valid pixels.

    A box stays if its centre is valid and at least ``floor`` of its pixels are; ``mask`` lists a scene's valid pixels.
    """
    span = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b) - 1))
    cells = boxes.select("det_id", "scene", "x1", "y1", "x2", "y2", span("x1", "x2").alias("col")).select("*", span("y1", "y2").alias("row"))
    hit = cells.join(mask.select("scene", "row", "col"), ["scene", "row", "col"])
    centre = (F.col("col") == F.floor((F.col("x1") + F.col("x2")) / 2)) & (F.col("row") == F.floor((F.col("y1") + F.col("y2")) / 2))
    found = hit.groupBy("det_id").agg(
        F.max(centre).alias("centre"), F.count(F.lit(1)).alias("n"), F.first((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"),
        F.min("col").alias("x1"), F.min("row").alias("y1"), (F.max("col") + 1).alias("x2"), (F.max("row") + 1).alias("y2"),
    )
    return found.where(F.col("centre") & (F.col("n") >= floor * F.col("area"))).select("det_id", "x1", "y1", "x2", "y2", "n")


def rings_meet(a, b) -> Column:
    """Whether two convex rings (arrays of x, y) touch or overlap: no side of either separates them."""
    a, b = geo.col(a), geo.col(b)

    def separated(p, q):
        n = F.size(p)

        def side(i):
            u, v = F.element_at(p, i + 1), F.element_at(p, F.pmod(i + 1, n).cast("int") + 1)
            along = lambda r: F.transform(r, lambda s: s.x * (v.y - u.y) - s.y * (v.x - u.x))
            return (F.array_max(along(p)) < F.array_min(along(q))) | (F.array_max(along(q)) < F.array_min(along(p)))

        return F.exists(F.sequence(F.lit(0), n - 1), side)

    return ~separated(a, b) & ~separated(b, a)


def box_ring(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(geo.col, (x1, y1, x2, y2))
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))))


def clip_windows(clips: DataFrame, length: float = 12.0, overlap: float = 2.0) -> DataFrame:
    """Windows of (clip_id, duration): starts a step apart until a window reaches the end, which it does not pass."""
    step = length - overlap
    n = F.greatest(F.lit(1), F.ceil((F.col("duration") - overlap) / step)).cast("int")
    w = clips.where("duration > 0").select("clip_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    start = F.col("window") * step
    return w.select("clip_id", "window", start.alias("start"), F.least(start + length, F.col("duration")).alias("end"))


def json_object(text: str) -> Column:
    """The object in fenced or plain prose: from the first brace to the last; null if that is no JSON object."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body) if hasattr(F, "try_parse_json") else F.when(F.get_json_object(body, "$").isNotNull(), body)
