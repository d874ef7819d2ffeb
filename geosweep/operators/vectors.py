"""Nearest vectors by cosine: exact in blocks, or through an index of lists around centroids.

Work is dealt to blocks of a few thousand vectors by a few thousand queries of the same key, whatever the size of
the key; a block is one matrix product, and no more than k rows a query leave it.  Blocks of one query meet again
in a ranking of k rows a block.

The index fits centroids on a bounded sample, puts every vector into the list of its nearest one, and a query
looks only into the lists of the centroids nearest to it: as many as held ``RECALL`` of the nearest ten of the sample.
``exact`` looks into all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosweep.operators.graph import settled

#: Vectors and queries of a block at most, as far as a hash deals them evenly.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Vectors that centroids are fitted on, and lists, at most.
SAMPLE, MOST_LISTS = 20_000, 4096
#: Share of the sample's nearest neighbours that the probed lists must hold, and queries of the sample that are asked.
RECALL, ASKED, NEAREST = 0.95, 500, 10


def unit_rows(lists: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Vectors at length 1, one a row; zeros where a vector is null, of another length, without direction or not finite."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    length = np.asarray(pa.compute.list_value_length(lists).fill_null(-1))
    out = np.zeros((len(lists), size))
    fit = np.flatnonzero(length == size)
    if size and fit.size:
        values = lists.take(pa.array(fit)).flatten()
        x = np.asarray(values.cast(pa.float64()).fill_null(np.nan)).reshape(-1, size)
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
        out[fit] = np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0.0)
    return out


def block_top_k(queries: DataFrame, base: DataFrame, k: int, within: list[str] | None = None, above: float | None = 0.0) -> DataFrame:
    """(query_id, within, id, similarity, rank): the k most similar of the base rows of the same key, other than itself, ties by id.

    Queries have query_id, key, query; the base has id, key, vector.  ``within`` names query columns that are
    ranked apart (the key, say).  Only similarities over ``above`` count, if it is given.
    """
    within = within or []
    extra = [c for c in within if c != "key"]
    n_base, n_query = base.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("nb")), queries.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("nq"))
    counts = n_base.join(n_query, "key").transform(settled)
    # every block of vectors meets every block of queries of its key, once
    b = base.select("id", "key", "vector").join(counts, "key").withColumn("b_", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("q_", F.explode(F.sequence(F.lit(0), F.col("nq").cast("int") - 1))).drop("nb", "nq")
    q = queries.select("query_id", "key", "query", *extra).join(counts, "key").withColumn("q_", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).withColumn("b_", F.explode(F.sequence(F.lit(0), F.col("nb").cast("int") - 1))).drop("nb", "nq")
    kinds = {"query_id": queries, "key": queries, **dict.fromkeys(extra, queries), "id": base}
    schema, names = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in kinds.items()) + ", similarity double", list(kinds)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, hit, score = [], [], []
        size = int(np.bincount(np.asarray(pa.compute.list_value_length(left.column("vector")).fill_null(0))).argmax()) if left.num_rows else 0
        ids = left.column("id").to_numpy()
        x, y = unit_rows(left.column("vector"), size), unit_rows(right.column("query"), size)
        own = right.column("query_id").to_numpy()
        for from_row in range(0, len(y), 256):
            # the last bits depend on the place in the matrix: equal vectors shall be equal
            s = np.round(y[from_row : from_row + 256] @ x.T, 12)
            s[own[from_row : from_row + 256, None] == ids[None, :]] = -np.inf
            if above is not None:
                s[s <= above] = -np.inf
            for i, line in enumerate(s, from_row):
                least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
                near = np.flatnonzero((line >= least) & (line > -np.inf))
                near = near[np.lexsort((ids[near], -line[near]))[:k]]
                at.append(np.full(len(near), i))
                hit.append(near)
                score.append(line[near])
        at, hit, score = (np.concatenate(v) if v else np.zeros(0) for v in (at, hit, score))
        rows, found = right.take(pa.array(at.astype(np.int64))), left.column("id").take(pa.array(hit.astype(np.int64)))
        return pa.table([rows.column(c) for c in names if c != "id"] + [found, pa.array(score.astype(float))], names=[*names, "similarity"])

    met = b.groupBy("key", "b_", "q_").cogroup(q.groupBy("key", "b_", "q_")).applyInArrow(run, schema)
    w = Window.partitionBy("query_id", *within).orderBy(F.desc("similarity"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", *within, "id", "similarity", "rank")


def cosine_top_k(queries: DataFrame, base: DataFrame, k: int, positive_only: bool = True) -> DataFrame:
    """The k most similar rows of ``base`` (id, vector) for every query (query_id, query), each against all rows."""
    one = F.lit(0).alias("key")
    return block_top_k(queries.select("query_id", one, "query"), base.select("id", one, "vector"), k, above=0.0 if positive_only else None)


class VectorIndex:
    """Lists of vectors (id, vector) around centroids, written to the shared folder."""

    def __init__(self, base: DataFrame, lists: int | None = None, seed: int = 7, rounds: int = 10):
        self.spark = base.sparkSession
        total = base.count()
        n = max(1, min(MOST_LISTS, lists or round(np.sqrt(total))))
        # a hash picks the sample, so that a lost executor's rows are picked again
        share = base.where(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(total, 1)) + 1)) if total > SAMPLE else base
        sample = share.orderBy(F.xxhash64(F.col("id"), F.lit(seed))).select("vector").limit(SAMPLE).toArrow()
        sizes = np.asarray(pa.compute.list_value_length(sample.column("vector")).fill_null(0)) if sample.num_rows else np.zeros(0, int)
        self.size = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        x = unit_rows(sample.column("vector"), self.size)
        self.centroids = self._fit(x, n, seed, rounds)
        self.probes = self._probes(x)
        self.lists = settled(self._nearest(base.select("id", "vector"), "vector", 1))

    @staticmethod
    def _fit(x: np.ndarray, n: int, seed: int, rounds: int) -> np.ndarray:
        """Spherical k-means on the sample."""
        x = x[(x != 0).any(axis=1)]
        if not len(x):
            return np.zeros((1, x.shape[1]))
        centres = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
        for _ in range(rounds):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
        return centres

    def _probes(self, x: np.ndarray) -> int:
        """How many lists, nearest first, hold the wanted share of the neighbours of sampled queries."""
        if len(x) < 2:
            return 1
        s = x[:ASKED] @ x.T
        s[np.arange(len(s)), np.arange(len(s))] = -np.inf
        near = np.argsort(-s, axis=1, kind="stable")[:, : min(NEAREST, len(x) - 1)]
        home = (x @ self.centroids.T).argmax(axis=1)
        order = np.argsort(np.argsort(-(x[:ASKED] @ self.centroids.T), axis=1, kind="stable"), axis=1)
        places = np.sort(np.take_along_axis(order, home[near], axis=1).reshape(-1))
        return int(places[min(len(places) - 1, int(np.ceil(RECALL * len(places))) - 1)]) + 1

    def _nearest(self, rows: DataFrame, vector: str, probes: int) -> DataFrame:
        """Rows once for each of their nearest lists, as column key."""
        shared, size = self.spark.sparkContext.broadcast(self.centroids), self.size
        fields = T.StructType([*rows.schema.fields, T.StructField("key", T.IntegerType())])

        def run(batches):
            for batch in batches:
                s = unit_rows(batch.column(vector), size) @ shared.value.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns] + [pa.array(near.reshape(-1))], names=[*batch.schema.names, "key"])

        return rows.mapInArrow(run, fields)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, above: float | None = None) -> DataFrame:
        """(query_id, id, similarity, rank) of the k most similar for each query (query_id, query), in its nearest lists or in all."""
        asked = self._nearest(queries.select("query_id", "query"), "query", len(self.centroids) if exact else min(probes or self.probes, len(self.centroids)))
        return block_top_k(asked, self.lists, k, above=above)
