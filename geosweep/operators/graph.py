"""Graph analytics over edge lists (src, dst) and node lists (id)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a session on one machine may choose one where none is named."""
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        path, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if path is None and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="geosweep-"))


def settled(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """The rows of ``df`` from a table in the checkpoint folder, read by its own or another session: cuts lineage in one job and survives lost executors."""
    import uuid

    ensure_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def simple(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges (src < dst) between known nodes, without loops and repeats."""
    known = nodes.select(F.col("id"))
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = both_ways(simple(nodes, edges)).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts (repeated edges count) and edges over possible pairs."""
    n = nodes.agg(F.count_distinct("id").alias("n_nodes"))
    known = nodes.select("id")
    e = edges.where("src <> dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    m = e.agg(F.count(F.lit(1)).alias("n_edges"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2.0
    return n.crossJoin(m).select("n_nodes", "n_edges", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(F.lit(0.0)).alias("density"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component, by label minimum and pointer jumps."""
    ensure_checkpoints(nodes.sparkSession)
    links = both_ways(simple(nodes, edges)).transform(settled)
    label = nodes.select("id", F.col("id").alias("component")).distinct().transform(settled)
    while True:
        near = links.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("c"))
        low = label.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("c"))
        jump = low.join(label.select(F.col("id").alias("c"), F.col("component").alias("d")), "c", "left")
        new = jump.select("id", F.least("c", F.coalesce("d", "c")).alias("new"), "component").transform(settled)
        label = new.select("id", F.col("new").alias("component"))
        if not new.where("new <> component").limit(1).count():
            return label


#: Neighbours in one row of the adjacency; a node with more of them has several, in different partitions.
ADJACENT = 4096
#: Rounds of PageRank in one job at most.
ROUNDS_A_JOB = 12


def _adjacency(links: DataFrame) -> DataFrame:
    """(src, part, deg, to): the neighbours of each node in rows of bounded length."""
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("deg") / ADJACENT)).cast("int")
    dealt = links.join(degree, "src").groupBy("src", part.alias("part")).agg(F.first("deg").alias("deg"), F.collect_list("dst").alias("to"))
    return dealt


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """Undirected PageRank with uniform teleport; the mass of nodes without edges is spread evenly.

    Stops after the first round that moves less than ``tolerance`` in all.  The adjacency is dealt once and
    kept in its partitions, so that a round shuffles only what nodes send, added up before it leaves a task; the
    neighbours of a hub lie in several rows and partitions, each of which gets the hub's rank.  Nodes without edges
    share one rank, a number of the driver's.  Several rounds make one job: as no round moves more than the one
    before it (by the damping), the rounds that are left are told from the pace so far, and a job that would go
    past the first round within the tolerance is done again with fewer.

    The rounds run in a session of their own without adaptive execution: hubs are split already, and planning
    the rest of a job anew after every round costs more than the round.
    """
    ensure_checkpoints(nodes.sparkSession)
    spark, rounds_session = nodes.sparkSession, nodes.sparkSession.newSession()
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))):
        rounds_session.conf.set(name, value)
    adjacency = settled(_adjacency(both_ways(simple(nodes, edges))), rounds_session)
    hubs = adjacency.where("part > 0").limit(1).count() > 0
    keys = ["src", "part"] if hubs else ["src"]
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = adjacency.select(*keys, "deg", "to").repartition(n_parts, *keys).sortWithinPartitions(*keys).persist()
    parts = adjacency.where("part > 0").groupBy(F.col("src").alias("id")).agg(F.max("part").alias("last")).transform(settled) if hubs else None
    ids = nodes.select("id").distinct()
    n = ids.count()
    linked = adjacency.select(F.col("src").alias("id")).distinct()
    n_loose = n - linked.count()

    def step(ranks: DataFrame, alone: float) -> tuple[DataFrame, float]:
        """(id, rank) after one more round; every node of an edge is sent something."""
        if hubs:
            ranks = ranks.join(parts, "id", "left").select("id", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("part"), "rank")
        met = ranks.withColumnRenamed("id", "src").hint("merge").join(spread, keys)
        sent = met.select(F.explode("to").alias("id"), (F.col("rank") / F.col("deg")).alias("s"))
        base = (1 - damping) / n + damping * n_loose * alone / n
        return sent.groupBy("id").agg((F.lit(base) + damping * F.sum("s")).alias("rank")), base

    ranks, alone = linked.withColumn("rank", F.lit(1.0 / max(n, 1))).transform(settled), 1.0 / max(n, 1)
    done, size, last = 0, ROUNDS_A_JOB, None
    while n and done < rounds:
        size = min(size, rounds - done)
        made, loose = ranks, alone
        for _ in range(size - 1):
            made, loose = step(made, loose)
        # the last round of a job by itself, from a table, to be compared with the one before
        before, loose_before = made.transform(settled) if size > 1 else made, loose
        made, loose = step(before, loose)
        made = made.transform(settled)
        change = made.join(before.select("id", F.col("rank").alias("was")), "id").agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("was"))), F.lit(0.0)))
        moved = change.first()[0] + n_loose * abs(loose - loose_before)
        if tolerance is not None and moved < tolerance and size > 1:
            size = (size + 1) // 2  # an earlier round of these may do
            continue
        ranks, alone, done = made, loose, done + size
        if tolerance is not None:
            if moved < tolerance:
                break
            pace = (moved / last) ** (1 / size) if last and 0 < moved < last else damping
            size = max(1, min(ROUNDS_A_JOB, int(np.log(tolerance / moved) / np.log(min(pace, 0.999)))))
        last = moved
    found = settled(ranks, spark)
    spread.unpersist()
    return ids.join(found, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(alone)))


#: Steps along edges that a task of betweenness takes, about.
STEPS = 10**9


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Brandes' betweenness, normalised by (n - 1)(n - 2) / 2, of graphs of any number of nodes.

    A search from a source stays in its component: each component is packed into one row of arrays, which
    tasks get with a part of its sources; a component must fit a task, the graph need not.  Each
    source is one breadth-first search by levels on arrays, so that work grows with nodes times edges of a component.
    """
    ids = nodes.select("id").distinct().transform(settled)
    n = ids.count()
    kept = simple(ids, edges).transform(settled)
    kind = nodes.schema["id"].dataType.simpleString()
    label = components(ids, kept)
    links = both_ways(kept).join(label.select(F.col("id").alias("src"), "component"), "src")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(np.sort(rows["src"].unique()))
        tails, heads = names.get_indexer(rows["src"]), names.get_indexer(rows["dst"]).astype(np.int32)
        order = np.lexsort((heads, tails))
        start = np.searchsorted(tails[order], np.arange(len(names) + 1)).astype(np.int64)
        return pd.DataFrame({"names": [names.tolist()], "start": [start.tobytes()], "heads": [heads[order].tobytes()], "n": [len(names)], "m": [len(rows)]})

    packed = links.groupBy("component").applyInPandas(pack, f"names array<{kind}>, start binary, heads binary, n long, m long").transform(settled)
    parts = F.least(F.col("n"), F.ceil(F.col("n").cast("double") * F.col("m") / STEPS)).cast("int")
    dealt = packed.select("*", parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    most = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8

    def run(batches):
        for batch in batches:
            for names, starts, ends, part, of in zip(batch["names"], batch["start"], batch["heads"], batch["part"], batch["parts"], strict=True):
                start, to = np.frombuffer(starts, np.int64), np.frombuffer(ends, np.int32)
                yield pd.DataFrame({"id": names, "b": _dependencies(start, to, range(part, len(start) - 1, of))})

    # rows are few and large: each goes to a task of its own as far as there are tasks
    spread = dealt.repartition(most, "names", "part").mapInPandas(run, f"id {kind}, b double")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    summed = spread.groupBy("id").agg(F.sum("b").alias("b"))
    return ids.join(summed, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(start: np.ndarray, to: np.ndarray, sources) -> np.ndarray:
    """Sum over sources of how much of their shortest paths passes through each node."""
    n, degree = len(start) - 1, np.diff(start)
    total = np.zeros(n)
    for s in sources:
        seen, paths, levels, front = np.zeros(n, bool), np.zeros(n), [], np.array([s])
        seen[s], paths[s] = True, 1.0
        while len(front):
            far = degree[front]
            v = np.repeat(front, far)
            w = to[np.arange(len(v)) + np.repeat(start[front] - (np.cumsum(far) - far), far)]
            new = ~seen[w]
            v, w = v[new], w[new]
            reached = np.bincount(w, weights=paths[v], minlength=n)
            front = np.flatnonzero(reached)
            seen[front], paths[front] = True, reached[front]
            levels.append((v, w))
        share = np.zeros(n)
        for v, w in reversed(levels):
            share += np.bincount(v, weights=paths[v] / paths[w] * (1 + share[w]), minlength=n)
        share[s] = 0.0
        total += share
    return total


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int, cap: int | None = None) -> DataFrame:
    """(id, hop) of all nodes within so many hops of the seeds; ``cap`` keeps the nearest, by (hop, id)."""
    links = both_ways(edges).distinct()
    seen = seeds.select("id", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        step = links.join(seen.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        seen = seen.unionByName(step.join(seen, "id", "left_anti").select("id", F.lit(h).alias("hop")))
    return seen.orderBy("hop", "id").limit(cap) if cap else seen


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def shortest_paths(edges: DataFrame, start, goal, max_depth: int = 8, limit: int = 10) -> DataFrame:
    """All shortest undirected paths of up to ``max_depth`` steps, as arrays of nodes, the first ``limit`` in order.

    Breadth-first levels from the start until the goal is met, then back from the goal through
    nodes one level lower: only nodes on shortest paths ever become part of a path.
    """
    ensure_checkpoints(edges.sparkSession)
    links = both_ways(edges).distinct().transform(settled)
    seen = links.where(F.col("src") == F.lit(start)).select(F.col("src").alias("id"), F.lit(0).alias("hop")).limit(1).transform(settled)
    depth = 0
    while depth < max_depth and not seen.where((F.col("id") == F.lit(goal)) & (F.col("hop") > 0)).limit(1).count():
        depth += 1
        front = seen.where(F.col("hop") == depth - 1).select(F.col("id").alias("src"))
        step = links.join(front, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        before, seen = seen, seen.unionByName(step.select("id", F.lit(depth).alias("hop"))).transform(settled)
        if not seen.where(F.col("hop") == depth).limit(1).count():
            seen = before
            break
    paths = seen.where((F.col("id") == F.lit(goal)) & (F.col("hop") > 0)).select(F.array("id").alias("path"), F.col("id").alias("src"), "hop")
    for _ in range(depth):
        lower = links.join(paths, "src").select("path", F.col("dst").alias("id"), (F.col("hop") - 1).alias("hop")).join(seen, ["id", "hop"])
        paths = lower.select(F.concat(F.array("id"), "path").alias("path"), F.col("id").alias("src"), "hop")
    return paths.where("hop = 0").select("path").orderBy("path").limit(limit)


def common_neighbours(edges: DataFrame, block: int = 1000) -> DataFrame:
    """Heuristic link suggestion: shared neighbours and Adamic-Adar weight of pairs that are not linked.

    A node with more than ``block`` neighbours is dealt to parts: each neighbour lies in one part on the
    right and in all on the left, so that a pair meets once and no task holds all pairs of a hot node.
    """
    links = both_ways(edges).distinct()
    parts = F.ceil(F.col("deg") / block).cast("int")
    deg = links.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("deg"))
    ends = lambda name: links.select(F.col("src").alias(name), F.col("dst").alias("via")).join(deg, "via")
    left = ends("a").select("a", "via", "deg", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = ends("b").select("b", "via", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    pairs = left.join(right, ["via", "part"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum(1 / F.log(F.col("deg").cast("double"))).alias("weight"))
    return pairs.join(links.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")


def unlinked_pairs(nodes: DataFrame, edges: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """Pairs within each group of ``by`` that have no edge; with ``limit`` a report of the first so many."""
    a, b = nodes.withColumnRenamed("id", "a"), nodes.withColumnRenamed("id", "b")
    have = both_ways(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return a.join(b, by).where("a < b").join(have, ["a", "b"], "left_anti").transform(lambda df: df if limit is None else df.orderBy("a", "b").limit(limit))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns standardised by population deviation; constant ones become 0."""
    stats = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.lit(0.0))
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*(z(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def merge_edges(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src", "dst", "type")) -> DataFrame:
    """Edge table after merging assertions: seen counts add up, the newest score and time stay."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.sum("seen").alias("seen"), F.max(F.struct("at", "score")).alias("m")).select(*keys, "seen", F.col("m.score").alias("score"), F.col("m.at").alias("at"))


def closure(tree: DataFrame, root_column: str = "id", parent: str = "parent_id") -> DataFrame:
    """(ancestor, id, depth) of a taxonomy of any depth, each node its own ancestor at depth 0; a cycle adds no pair twice."""
    ensure_checkpoints(tree.sparkSession)
    children = tree.select(F.col(root_column).alias("child"), F.col(parent).alias("id")).transform(settled)
    result = step = tree.select(F.col(root_column).alias("ancestor"), F.col(root_column).alias("id"), F.lit(0).alias("depth")).transform(settled)
    depth = 0
    while True:
        depth += 1
        step = step.join(children, "id").select("ancestor", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct()
        step = step.join(result, ["ancestor", "id"], "left_anti").transform(settled)
        if not step.limit(1).count():
            return result
        result = result.unionByName(step)


def rank_nodes(scores: DataFrame, score: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(score), "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))
