"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the text alone.  Trees grow level by level on binned features (so a
split search is a sum over histograms), and are kept as three arrays, split feature,
threshold and leaf value, each a complete binary tree per row; a block of documents walks
all trees together, one numpy step per level.

Fitting takes at most ``max_rows`` labelled rows, those of least id hash among the
training fold; only these are gathered, as statistics, on the driver.  Scoring is one map
over the documents.

Edge cases: null text counts as empty and has all-zero statistics; rows without a label
are just scored; labels that are null are left out, and of several on one document the
lowest counts; without two classes to learn from, every score is the share of the one
there is (one half without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosweep.llm.blocks import Block, finish, grams, pair, span_hashes
from geosweep.llm.frames import map_blocks, table

MAX_ROWS = 50_000
THRESHOLD = 0.3


def _flags(buf: np.ndarray, chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars.encode(), np.uint8)] = True
    return t[buf]


def _distinct_share(doc: np.ndarray, value: np.ndarray, n_docs: int, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct items and the most frequent item, as shares of ``count``."""
    _, first, times = np.unique(pair(finish(doc.astype(np.uint64)), value), return_index=True, return_counts=True)
    top = np.zeros(n_docs)
    np.maximum.at(top, doc[first], times)
    n = np.maximum(count, 1)
    return np.bincount(doc[first], minlength=n_docs) / n, top / n


def features(block: Block) -> np.ndarray:
    """One row of statistics per document."""
    buf, n_docs = block.buf, block.n_docs
    words = block.n_words.astype(float)
    n = np.maximum(words, 1)
    size = np.maximum(np.diff(block.offsets) - 1, 1).astype(float)
    length = (block.end - block.start).astype(float)
    doc = block.word_doc
    mean = np.bincount(doc, weights=length, minlength=n_docs) / n
    spread = np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=n_docs) / n - mean**2, 0))
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    per = lambda flags: block.per_doc(flags).astype(float)
    first_upper = np.bincount(doc, weights=upper[block.start], minlength=n_docs)
    last_upper = np.bincount(doc, weights=upper[block.end - 1] | _flags(buf, "!")[block.end - 1], minlength=n_docs)
    alone = np.bincount(doc, weights=(block.end - block.start == 1) & ~(upper | lower)[block.start], minlength=n_docs)
    h = block.words(lower=True)
    unique, top = _distinct_share(doc, h, n_docs, words)
    g = grams(h, 3)
    whole = np.flatnonzero(doc[: len(g)] == doc[2 : 2 + len(g)]) if len(g) else np.zeros(0, np.int64)
    fresh, top3 = _distinct_share(doc[whole], g[whole], n_docs, np.maximum(words - 2, 0))
    start, end, line_doc = block.lines
    lines = np.bincount(line_doc, minlength=n_docs).astype(float)
    new_lines, top_line = _distinct_share(line_doc, span_hashes(buf, start, end, False), n_docs, lines)
    columns = [
        np.log1p(words), mean, spread, per(upper) / size, per(lower) / size, per((buf >= 48) & (buf <= 57)) / size, per(buf >= 128) / size,
        first_upper / n, last_upper / n, alone / n, per(_flags(buf, "!")) / n, per(_flags(buf, "|")) / n, per(_flags(buf, "#*$%&")) / n,
        per(_flags(buf, "<>{}[]=_@/\\")) / n, per(_flags(buf, ".?")) / n, per(_flags(buf, ",;:")) / n, unique, top, fresh, top3, new_lines, top_line, words / np.maximum(lines, 1),
    ]
    return np.where(words[:, None] > 0, np.stack(columns, axis=1), 0.0) if n_docs else np.zeros((0, len(columns)))


@dataclass
class Forest:
    """Complete trees of one depth: per tree, inner nodes in heap order, then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)
        while node.flat[0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, ridge: float = 1.0) -> Forest:
    """Logistic boosting; a split is the best cut of a feature's histogram by second-order gain."""
    inner = 2**depth - 1
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    share = y.mean() if len(y) else 0.5
    none.base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(y) == 0 or share in (0.0, 1.0):
        return none
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), none.base)
    feature, threshold, leaf = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, float), (inner + 1, float)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            n, at = 2**d, 2**d - 1
            best = np.full(n, 1e-9)
            threshold[t, at : at + n] = np.inf  # without a gain everything goes left
            for j in range(width):
                cell = (node - at) * bins + binned[:, j]
                g = np.bincount(cell, weights=gradient, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                h = np.bincount(cell, weights=weight, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    cut = gain.argmax(axis=1)
                    value = gain[np.arange(n), cut]
                    better = value > best
                    best = np.where(better, value, best)
                    feature[t, at : at + n][better] = j
                    threshold[t, at : at + n][better] = edges[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        node -= inner
        g, h = np.bincount(node, weights=gradient, minlength=inner + 1), np.bincount(node, weights=weight, minlength=inner + 1)
        leaf[t] = rate * g / (h + ridge)
        margin += leaf[t, node]
    return Forest(feature, threshold, leaf, none.base)


def fold(doc_id: str, n: int):
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n).cast("int")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = 5, doc_id: str = "doc_id", text: str = "text") -> Forest:
    """Fit on at most ``max_rows`` labelled documents outside fold 0 (in order of an id hash).

    Of several texts of one id that of least statistics counts, so that the model can be made again.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col(doc_id).isNotNull() & (fold(doc_id, folds) != 0))
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.min("quality").cast("double").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    # at most max_rows rows of 16 bytes: a bound of its own, whatever the data
    known = docs.select(F.col(doc_id).alias("__id"), text).join(F.broadcast(chosen), "__id")
    schema = T.StructType([T.StructField("__x", T.ArrayType(T.FloatType()))])

    def statistics(_, block):
        x = features(block)
        return {"__x": pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))}

    rows = map_blocks(known, statistics, schema, ["__id", "__y"], text).groupBy("__id").agg(F.min("__x").alias("__x"), F.min("__y").alias("__y")).toArrow().sort_by("__id")
    x = np.asarray(rows.column("__x").combine_chunks().flatten(), float)
    return fit(x.reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1)), np.asarray(rows.column("__y"), float))


def score(docs: DataFrame, forest: Forest, keep: list[str] | None = None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with score (likelihood of quality 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def fn(_, block):
        s = shared.value.score(features(block).astype(np.float32).astype(float))
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_blocks(docs, fn, schema, keep if keep is not None else [c for c in docs.columns if c != text], text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
