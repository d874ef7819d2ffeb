"""URL filters as a temporal list join.

A list is a history of dated events, ``add`` or ``remove``, on patterns of four kinds:
``domain`` (the host and everything below it), ``host``, ``prefix`` (host and leading path
segments) and ``url`` (host, path and query).  The events of each pattern become validity
intervals [from, to), and a capture is judged against the entries active at its fetch
time: an as-of join on the pattern and the time.

The list side holds one row per pattern with its intervals in order, so the join has one
match at most for a key, and hot hosts go through the split join.  No row of the list is
broadcast but those of keys that hold over a thousandth of all capture keys.

Edge cases: a null or relative url has no host and matches nothing; a null fetch time is
never within an interval; of several events on a pattern at one instant a removal wins;
repeated events change nothing; repeated captures each get the result.  Columns of the
captures that are named like a result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosweep.llm.frames import split_join, table

#: The events that the registered query starts from.
EVENTS = (
    ("domain", "example.org", "add", "2024-03-01"),
    ("domain", "example.org", "remove", "2024-06-01"),
    ("domain", "example.org", "add", "2024-10-15"),
    ("domain", "ththre.example.com", "add", "2023-11-05"),
    ("host", "m.ththth.example.net", "add", "2024-01-01"),
    ("host", "m.ththth.example.net", "remove", "2024-01-02"),
    ("prefix", "ther.example.net/en", "add", "2024-02-10"),
    ("prefix", "erhe.example.com/de", "add", "2024-05-20"),
    ("prefix", "erhe.example.com/de", "remove", "2024-07-20"),
    ("url", "thther.example.org/en/685", "add", "2024-01-01"),
)
PRECEDENCE = ("url", "host", "prefix", "domain")


def intervals(events: DataFrame) -> DataFrame:
    """(kind, pattern, spans): per pattern the ordered validity intervals of its events."""
    daily = events.groupBy("kind", "pattern", "at").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    nxt = F.lead("at").over(Window.partitionBy("kind", "pattern").orderBy("at"))
    return (
        daily.withColumn("until", nxt)
        .where("on = 1")
        .groupBy("kind", "pattern")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("since"), "until"))).alias("spans"))
    )


def host_of(url: str | Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*(/[^?#]*)?", 1)


def query_of(url: str | Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)


def keys_of(host: Column, path: Column, query: Column, depth: int) -> Column:
    """Every (kind, pattern) that could match a capture; prefixes down to the list's own depth."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(
        F.size(steps) > 0,
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(steps), F.lit(depth))),
            lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern")),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    exact = F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("pattern")),
        F.struct(F.lit("url").alias("kind"), F.concat(host, path, query).alias("pattern")),
    )
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes, exact)))


def url_filter(captures: DataFrame, events: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """The captures with host, blocked, n_rules and the first rule that blocks them, as kind:pattern.

    ``events`` has kind, pattern, action (add or remove) and at (a timestamp).
    """
    listed = intervals(events)
    depth = listed.where("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 1
    made = ["host", "blocked", "n_rules", "rule"]
    captures = captures.select(*[c for c in captures.columns if c not in made])
    named = captures.withColumn("host", F.coalesce(host_of(F.col(url)), F.lit("")))
    distinct = named.select(F.col(url).alias("__u"), F.col(fetched_at).alias("__t"), F.col("host").alias("__h")).where("__h <> '' AND __t IS NOT NULL").distinct()
    keyed = distinct.select("__u", "__t", F.explode(keys_of(F.col("__h"), path_of(F.col("__u")), query_of(F.col("__u")), depth)).alias("k")).select(
        "__u", "__t", "k.kind", "k.pattern"
    )
    active = F.exists("spans", lambda s: (s.since <= F.col("__t")) & (s.until.isNull() | (F.col("__t") < s.until)))
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("kind"))
    hits = (
        split_join(keyed, listed, ["kind", "pattern"])
        .where(active)
        .groupBy("__u", "__t")
        .agg(F.count(F.lit(1)).alias("n_rules"), F.min(F.struct(rank.alias("r"), F.concat_ws(":", "kind", "pattern").alias("rule"))).alias("m"))
    )
    joined = named.join(hits, (F.col(url) == F.col("__u")) & (F.col(fetched_at) == F.col("__t")), "left")
    return joined.select(
        *captures.columns, "host", F.col("n_rules").isNotNull().alias("blocked"), F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.col("m.rule").alias("rule")
    )


def events_of(pages: DataFrame) -> DataFrame:
    """The fixed events and, so that the list grows with the corpus, dated ones on an eighth of its hosts."""
    spark = pages.sparkSession
    fixed = spark.createDataFrame(list(EVENTS), "kind string, pattern string, action string, day string").select("kind", "pattern", "action", F.col("day").cast("timestamp").alias("at"))
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct().withColumn("m", F.md5("pattern"))
    start = F.timestamp_add("DAY", F.conv(F.substring("m", 2, 2), 16, 10).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    grown = hosts.where(F.substring("m", 1, 1).isin("0", "1")).select(F.lit("host").alias("kind"), "pattern", F.lit("add").alias("action"), start.alias("at"))
    ended = hosts.where(F.substring("m", 1, 1) == "0").select(F.lit("host").alias("kind"), "pattern", F.lit("remove").alias("action"), F.timestamp_add("DAY", F.lit(60), start).alias("at"))
    return fixed.unionByName(grown).unionByName(ended)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    day = F.timestamp_add("DAY", F.pmod("page_id", F.lit(366)).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    captures = pages.select("page_id", "url", day.alias("fetched_at"))
    return url_filter(captures, events_of(pages)).drop("url")


_H = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', ''))"
_FIXED = ", ".join(f"('{k}', '{p}', '{a}', TIMESTAMP '{d}')" for k, p, a, d in EVENTS)
ORACLE = rf"""
WITH c AS (SELECT page_id, TIMESTAMP '2024-01-01' + to_days((page_id % 366)::INT) AS fetched_at, coalesce({_H}, '') AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*(/[^?#]*)?', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) AS query FROM pages),
h AS (SELECT DISTINCT host, md5(host) AS m FROM c WHERE host <> ''),
s AS (SELECT host, m, TIMESTAMP '2024-01-01' + to_days(('0x' || substr(m, 2, 2))::INT) AS ts FROM h WHERE m[1] IN ('0', '1')),
ev(kind, pattern, action, ts) AS (SELECT * FROM (VALUES {_FIXED}) UNION ALL SELECT 'host', host, 'add', ts FROM s
  UNION ALL SELECT 'host', host, 'remove', ts + to_days(60) FROM s WHERE m[1] = '0'),
iv AS (SELECT * FROM (SELECT kind, pattern, ts AS since, action, lead(ts) OVER (PARTITION BY kind, pattern ORDER BY ts) AS until FROM ev) WHERE action = 'add'),
hit AS (SELECT c.page_id, iv.kind, iv.pattern FROM c JOIN iv ON c.fetched_at >= iv.since AND (iv.until IS NULL OR c.fetched_at < iv.until)
  AND c.host <> '' AND CASE iv.kind WHEN 'domain' THEN c.host = iv.pattern OR ends_with(c.host, '.' || iv.pattern)
    WHEN 'host' THEN c.host = iv.pattern WHEN 'url' THEN c.host || c.path || c.query = iv.pattern
    ELSE c.host || c.path = iv.pattern OR starts_with(c.host || c.path, iv.pattern || '/') END),
r AS (SELECT page_id, count(*) AS n, min({{'r': list_position(['url', 'host', 'prefix', 'domain'], kind), 'rule': kind || ':' || pattern}}) AS m FROM hit GROUP BY 1)
SELECT c.page_id, c.fetched_at, c.host, r.n IS NOT NULL AS blocked, coalesce(r.n, 0)::BIGINT AS n_rules, r.m.rule AS rule
FROM c LEFT JOIN r USING (page_id)
"""
