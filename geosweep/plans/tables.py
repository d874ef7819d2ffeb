"""Queries on the relational operators: scans, filters, joins, roll-ups, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosweep.functions import geo, labels
from geosweep.operators import relational as r
from geosweep.plans.domain import DET, POINTS, SITES, detections, sites, track_points
from geosweep.sources import readers

PLANS: dict = {}


def plan(name: str, sql: str | None = None):
    def put(fn):
        PLANS[name] = (fn, sql)
        return fn

    return put


@plan(
    "od_flows",
    f"""WITH {POINTS}, c AS (SELECT track_id, observed_at, round(floor(lon / 0.02::DOUBLE) * 0.02::DOUBLE + 0.01::DOUBLE, 6) AS lon, round(floor(lat / 0.02::DOUBLE) * 0.02::DOUBLE + 0.01::DOUBLE, 6) AS lat FROM pts),
s AS (SELECT *, lag(lon) OVER w AS from_lon, lag(lat) OVER w AS from_lat FROM c WINDOW w AS (PARTITION BY track_id ORDER BY observed_at))
SELECT from_lon, from_lat, lon AS to_lon, lat AS to_lat, count(*) AS weight FROM s WHERE from_lon IS NOT NULL AND (from_lon <> lon OR from_lat <> lat) GROUP BY ALL""",
)
def od_flows(spark: SparkSession, sf: str) -> DataFrame:
    return r.od_flows(track_points(spark, sf))


@plan(
    "pattern_of_life_heatmap",
    f"WITH {DET} SELECT round(round(lon / 0.02::DOUBLE) * 0.02::DOUBLE, 9) AS lon, round(round(lat / 0.02::DOUBLE) * 0.02::DOUBLE, 9) AS lat, count(*) AS n FROM det GROUP BY ALL ORDER BY n DESC, lon, lat LIMIT 50",
)
def heatmap(spark, sf):
    return r.heatmap(detections(spark, sf), "lon", "lat", 0.02)


@plan("class_counts", f"WITH {DET} SELECT class, count(*) AS n, max(confidence) AS max_confidence FROM det GROUP BY class")
def class_counts(spark, sf):
    return detections(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("max_confidence"))


@plan(
    "class_rollup",
    f"""WITH {DET}, b AS (SELECT *, pass_id % 4 AS branch FROM det), m AS (SELECT class, branch, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT class, branch FROM m QUALIFY row_number() OVER (PARTITION BY class ORDER BY n DESC, branch) = 1)
SELECT class, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, max(confidence) AS max_confidence, any_value(t.branch) AS top_branch,
 (SELECT string_agg(branch || ':' || m.n, ',' ORDER BY m.n DESC, branch) FROM m WHERE m.class = b.class) AS branches FROM b JOIN t USING (class) GROUP BY class""",
)
def class_rollup(spark, sf):
    d = detections(spark, sf).withColumn("branch", F.pmod("pass_id", F.lit(4)))
    base = d.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.max("confidence").alias("max_confidence"), r.mode_of("branch").alias("top_branch"))
    per = d.groupBy("class", "branch").agg(F.count(F.lit(1)).alias("m"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("o"), "branch", "m")))
    return base.join(per.groupBy("class").agg(F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s.branch.cast("string"), s.m.cast("string"))), ",").alias("branches")), "class")


@plan(
    "detections_in_view",
    f"""WITH {DET} SELECT id, class, confidence, created_at FROM det WHERE lon BETWEEN 54.2 AND 54.8 AND lat BETWEEN 24.1 AND 24.9
 AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20' AND class IN ('click', 'purchase', 'view') ORDER BY confidence DESC, id LIMIT 500""",
)
def detections_in_view(spark, sf):
    d = detections(spark, sf)
    box = geo.parse_bbox("54.2,24.1,54.8,24.9")
    rows = r.where_all(r.live(d), geo.in_bbox("lon", "lat", box), r.time_range("created_at", "2024-01-05", "2024-01-20"), F.col("class").isin("click", "purchase", "view"), None)
    return r.page(rows.select("id", "class", "confidence", "created_at"), [F.desc("confidence"), F.col("id")], 500)


@plan(
    "json_properties",
    "SELECT event_id, json_extract_string(props, '$.page') AS page, (props IS NOT NULL AND json_extract(props, '$.page') IS NOT NULL) AS has_page, upper(event_type) AS label FROM events",
)
def json_properties(spark, sf):
    page = F.get_json_object("props", "$.page")
    return readers.table(spark, sf, "events").select("event_id", page.alias("page"), page.isNotNull().alias("has_page"), F.upper("event_type").alias("label"))


@plan(
    "passes_with_live_detections",
    f"WITH {DET}, p AS (SELECT range AS pass_id FROM range(60)) SELECT p.pass_id, count(det.id) AS n FROM p LEFT JOIN det ON det.pass_id = p.pass_id AND det.confidence >= 0.4 GROUP BY ALL",
)
def passes_with_live(spark, sf):
    p = spark.range(60).select(F.col("id").alias("pass_id"))
    d = detections(spark, sf).where("confidence >= 0.4").groupBy("pass_id").agg(F.count(F.lit(1)).alias("n"))
    return p.join(d, "pass_id", "left").select("pass_id", F.coalesce("n", F.lit(0)).alias("n"))


@plan("latest_point_per_track", f"WITH {POINTS} SELECT track_id, observed_at, point_id, lon, lat FROM pts QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY observed_at DESC, point_id DESC) = 1")
def latest_point(spark, sf):
    return r.latest(track_points(spark, sf), ["track_id"], ["observed_at", "point_id"]).select("track_id", "observed_at", "point_id", "lon", "lat")


@plan("track_history", f"WITH {POINTS} SELECT track_id, string_agg(point_id::VARCHAR, '>' ORDER BY observed_at, point_id) AS path, count(*) AS n FROM pts GROUP BY track_id")
def track_history(spark, sf):
    items = F.array_sort(F.collect_list(F.struct("observed_at", "point_id")))
    return track_points(spark, sf).groupBy("track_id").agg(F.array_join(F.transform(items, lambda s: s.point_id.cast("string")), ">").alias("path"), F.count(F.lit(1)).alias("n"))


@plan("three_newest_per_class", f"WITH {DET} SELECT class, id, created_at FROM det QUALIFY row_number() OVER (PARTITION BY class ORDER BY created_at DESC, id DESC) <= 3")
def newest_per_class(spark, sf):
    return r.top_k(detections(spark, sf), ["class"], [F.desc("created_at"), F.desc("id")], 3).select("class", "id", "created_at")


@plan("two_newest_epochs", f"WITH {POINTS} SELECT track_id, point_id, lag(point_id) OVER (PARTITION BY track_id ORDER BY observed_at, point_id) AS previous FROM pts QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY observed_at DESC, point_id DESC) <= 2")
def two_newest(spark, sf):
    w = Window.partitionBy("track_id").orderBy("observed_at", "point_id")
    rows = track_points(spark, sf).withColumn("previous", F.lag("point_id").over(w))
    return r.top_k(rows, ["track_id"], [F.desc("observed_at"), F.desc("point_id")], 2).select("track_id", "point_id", "previous")


@plan("orphaned_customers", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def orphans(spark, sf):
    return readers.table(spark, sf, "customer").join(readers.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@plan(
    "proposals_not_yet_known",
    """WITH p AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS kind FROM lineitem)
SELECT src, dst FROM p WHERE kind = 'N' AND NOT EXISTS (SELECT 1 FROM p q WHERE q.src = p.src AND q.dst = p.dst AND q.kind = 'R') AND NOT EXISTS (SELECT 1 FROM p q WHERE q.src = p.src AND q.dst = p.dst AND q.kind = 'A')""",
)
def not_known(spark, sf):
    """Proposed pairs that were neither accepted nor rejected before."""
    p = readers.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")).distinct()
    known = lambda kind: p.where(F.col("kind") == kind).select("src", "dst")
    return known("N").join(known("R"), ["src", "dst"], "left_anti").join(known("A"), ["src", "dst"], "left_anti")


@plan("document_mentions", "SELECT doc_id, n_name AS name FROM documents JOIN nation ON contains(lower(text), substr(lower(n_name), 1, 3)) OR contains(substr(lower(n_name), 1, 3), lower(text))")
def mentions(spark, sf):
    # nation is a fixed list of 25 names
    n = F.broadcast(readers.table(spark, sf, "nation").select("n_name", F.substring(F.lower("n_name"), 1, 3).alias("needle")))
    text = F.lower("text")
    return readers.table(spark, sf, "documents").join(n, F.contains(text, F.col("needle")) | F.contains(F.col("needle"), text)).select("doc_id", F.col("n_name").alias("name"))


@plan("class_cooccurrence", f"WITH {DET}, c AS (SELECT DISTINCT track_id, class FROM det) SELECT a.class AS a, b.class AS b, count(*) AS n FROM c a JOIN c b USING (track_id) WHERE a.class < b.class GROUP BY ALL")
def cooccurrence(spark, sf):
    c = detections(spark, sf).select("track_id", "class").distinct()
    return c.withColumnRenamed("class", "a").join(c.withColumnRenamed("class", "b"), "track_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@plan("history_anchor", "SELECT l_suppkey AS target, least(1.0, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) / 5.0)::DOUBLE AS anchor FROM lineitem GROUP BY 1")
def history_anchor(spark, sf):
    accepted = F.count(F.when(F.col("l_returnflag").isin("A", "R"), 1))
    return readers.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("target")).agg(F.least(F.lit(1.0), accepted / 5.0).alias("anchor"))


@plan("unknown_label_counters", "SELECT event_type AS label, count(*) AS seen, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def unknown_labels(spark, sf):
    return readers.table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("seen"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@plan("conditional_aggregates", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS open_mean FROM orders GROUP BY 1")
def conditional(spark, sf):
    return readers.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.expr("count(*) FILTER (WHERE o_orderstatus = 'F')").alias("finished"), F.round(F.expr("avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O')"), 4).alias("open_mean"))


@plan("percentile_stretch", "SELECT event_type, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def percentiles(spark, sf):
    from geosweep.operators.quantiles import quantiles

    q = quantiles(readers.table(spark, sf, "events"), ["event_type"], "value", {"low": 0.02, "high": 0.98, "least": 0.0, "most": 1.0})
    return q.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "least", "most")


@plan("supplier_quantiles", "SELECT l_suppkey, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS middle, round(quantile_cont(l_extendedprice, 0.999), 6) AS top, quantile_disc(l_quantity, 0.9) AS quantity FROM lineitem GROUP BY 1")
def supplier_quantiles(spark, sf):
    """Quantiles of many keys at once, each by its own intervals."""
    from geosweep.operators.quantiles import quantiles

    l = readers.table(spark, sf, "lineitem")
    price = quantiles(l, ["l_suppkey"], "l_extendedprice", {"middle": 0.5, "top": 0.999}).withColumn("top", F.round("top", 6))
    return price.join(quantiles(l, ["l_suppkey"], "l_quantity", {}, {"quantity": 0.9}).drop("n"), "l_suppkey")


@plan(
    "latency_p50_p95",
    "WITH q AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, max(value) FILTER (WHERE r = greatest(1, ceil(0.95 * n))) AS p95 FROM q GROUP BY 1",
)
def latency(spark, sf):
    from geosweep.operators.evaluation import latency as run

    return run(readers.table(spark, sf, "events"), "event_type", "value").withColumn("p50", F.round("p50", 6))


@plan("page_with_total", "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def paged(spark, sf):
    p = readers.table(spark, sf, "part")
    total = p.agg(F.count(F.lit(1)).alias("total"))
    return r.page(p, [F.col("p_name"), F.col("p_partkey")], 50, 100).select("p_partkey", "p_name").crossJoin(F.broadcast(total))


@plan("review_queue", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 200")
def review_queue(spark, sf):
    o = readers.table(spark, sf, "orders").where(F.col("o_orderstatus").isin("P", "O"))
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return r.page(o, [rank, F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")], 200).select("o_orderkey", "o_orderstatus")


@plan(
    "upsert_newest",
    "WITH u AS (SELECT user_id, ts, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) = 1) SELECT user_id, ts, value, event_id FROM u",
)
def upsert(spark, sf):
    e = readers.table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return r.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "ts").select("user_id", "ts", "value", "event_id")


@plan("insert_do_nothing", "SELECT c_custkey AS id, 'customer' AS origin FROM customer UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def insert_missing(spark, sf):
    old = readers.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    return r.insert_missing(old, readers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("origin")), ["id"])


@plan("first_source_wins", "SELECT id, min(origin) AS origin FROM (SELECT s_suppkey AS id, '1-supplier' AS origin FROM supplier UNION ALL SELECT p_partkey, '2-part' FROM part) GROUP BY id")
def first_wins(spark, sf):
    a = readers.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("1-supplier").alias("origin"))
    return r.first_source_wins([a, readers.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("2-part").alias("origin"))], ["id"])


@plan("one_current_setting", "SELECT n_nationkey, n_regionkey, CASE WHEN n_regionkey IN (0, 1) THEN n_nationkey IN (0, 1) ELSE n_nationkey % 2 = 0 END AS is_current FROM nation")
def one_current(spark, sf):
    n = readers.table(spark, sf, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") % 2 == 0).alias("is_current"))
    return r.one_current(n, "n_regionkey", "n_nationkey", [0, 1])


@plan(
    "merge_entities",
    "SELECT CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS owner, count(*) AS n, max(o_orderdate) AS last_seen, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def merge_entities(spark, sf):
    owner = F.when(F.col("o_custkey") % 10 == 3, F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    return readers.table(spark, sf, "orders").groupBy(owner.alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_seen"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey % 7 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 45)")
def cascade(spark, sf):
    left = readers.table(spark, sf, "lineitem").where("l_quantity < 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.table(spark, sf, "orders").where("o_custkey % 7 <> 0").join(left, "o_orderkey", "left_semi").select("o_orderkey")


@plan(
    "labels_normalised",
    r"""WITH t AS (SELECT p_partkey, 'DOTA ' || p_type || ' - (' || p_brand || ')' AS raw FROM part), n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9:]+', '_', 'g'), '_+', '_', 'g'), '_') AS label, raw FROM t)
SELECT p_partkey, label, regexp_replace(label, '^dota_', '') AS bare, trim(regexp_replace(regexp_replace(lower(trim(raw)), '[\s\-]+', '_', 'g'), '_+', '_', 'g'), '_') AS folded FROM n""",
)
def normalised(spark, sf):
    raw = F.concat(F.lit("DOTA "), "p_type", F.lit(" - ("), "p_brand", F.lit(")"))
    return readers.table(spark, sf, "part").select("p_partkey", labels.normalise(raw).alias("label"), labels.strip_source(raw).alias("bare"), labels.canonical(raw).alias("folded"))


@plan(
    "vocabulary_mapping",
    """WITH t AS (SELECT event_id, event_type, lower(a.n_name) || ' 12 ' || b.n_name AS name, CASE event_id % 4 WHEN 0 THEN lower(r.r_name) WHEN 1 THEN replace(r.r_name, ' ', '/') WHEN 2 THEN 'far/east' ELSE '' END AS dom, r.r_name,
  ['B06', 'C130', 'GLF5', 'B738', 'ZZZ'][event_id % 5 + 1] AS code, ['Friendly', 'hostile', 'odd'][event_id % 3 + 1] AS aff
  FROM events JOIN nation a ON a.n_nationkey = event_id % 25 JOIN nation b ON b.n_nationkey = user_id % 25 JOIN region r ON r.r_regionkey = event_id % 5)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN r_name WHEN 1 THEN CASE WHEN contains(r_name, ' ') THEN 'OTHER' ELSE r_name END WHEN 2 THEN 'ASIA' ELSE 'OTHER' END AS domain,
CASE WHEN user_sensor = 'RADAR' THEN 'pictures' WHEN event_type IN ('view', 'click') THEN 'signals' ELSE 'texts' END AS media_domain,
(SELECT arg_min(r.r_name, n.n_nationkey) FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE contains(upper(t.name), n.n_name)) AS mission,
CASE code WHEN 'B06' THEN 'heli' WHEN 'C130' THEN 'turboprop' WHEN 'GLF5' THEN 'bizjet' WHEN 'B738' THEN 'airliner' ELSE 'unknown' END AS airframe,
CASE aff WHEN 'Friendly' THEN 'friend' WHEN 'hostile' THEN 'hostile' END AS affiliation FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'RADAR' END AS user_sensor FROM t) AS t""",
)
def vocabulary(spark, sf):
    """Names mapped by vocabularies that are tables: regions as domains, nations in their order as mission tokens."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % len(v) + 1).cast("int"))
    region, nation = readers.table(spark, sf, "region"), readers.table(spark, sf, "nation")
    missions = labels.vocabulary(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_nationkey", "n_name", "r_name")
    domains = [name for name, _ in labels.vocabulary(region, "r_regionkey", "r_name", "r_name")]
    key = lambda k, n: F.pmod(F.col(k), F.lit(n)).cast("int")
    e = readers.table(spark, sf, "events").withColumn("ka", key("event_id", 25)).withColumn("kb", key("user_id", 25)).withColumn("kr", key("event_id", 5))
    names = lambda k, c: nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(c))
    e = e.join(names("ka", "a_name"), "ka").join(names("kb", "b_name"), "kb").join(region.select(F.col("r_regionkey").alias("kr"), "r_name"), "kr")
    given = F.when(F.col("event_id") % 4 == 0, F.lower("r_name")).when(F.col("event_id") % 4 == 1, F.replace("r_name", F.lit(" "), F.lit("/"))).when(F.col("event_id") % 4 == 2, "far/east").otherwise("")
    e = e.withColumn("given", given).withColumn("sensor", F.when(F.col("event_id") % 7 == 0, "radar")).withColumn("name", F.concat(F.lower("a_name"), F.lit(" 12 "), "b_name"))
    return e.select(
        "event_id", labels.domain("given", domains, "OTHER", {"FAR_EAST": "ASIA"}).alias("domain"), labels.media_domain("event_type", "sensor", {"view": "signals", "click": "signals"}, {"RADAR": "pictures"}, "texts").alias("media_domain"),
        labels.first_token("name", missions).alias("mission"), labels.airframe(pick("B06", "C130", "GLF5", "B738", "ZZZ")).alias("airframe"), labels.affiliation(pick("Friendly", "hostile", "odd")).alias("affiliation"),
    )


@plan("geojson_features", f"WITH {SITES} SELECT '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || lon::VARCHAR || ',' || lat::VARCHAR || ']}},\"properties\":{{\"site_id\":' || site_id || ',\"kind\":\"' || kind || '\"}}}}' AS value FROM sites")
def geojson_features(spark, sf):
    return readers.feature_lines(sites(spark, sf), "lon", "lat", ["site_id", "kind"])


@plan("feature_collection")
def collection(spark, sf):
    return readers.feature_collection(sites(spark, sf), "lon", "lat", ["site_id", "kind"], ["site_id"])


@plan("timeline_range", "SELECT event_id, event_type, ts FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id DESC LIMIT 300")
def timeline(spark, sf):
    e = readers.table(spark, sf, "events")
    return r.page(r.where_all(e, F.col("event_type") == "view", r.time_range("ts", "2024-01-10", "2024-01-12")), [F.desc("ts"), F.desc("event_id")], 300).select("event_id", "event_type", "ts")


@plan("retention_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def retention(spark, sf):
    return readers.table(spark, sf, "events").where(r.recent("ts", "2024-02-15", 30)).select("event_id")
