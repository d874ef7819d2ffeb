"""Vector code compression: product codes from codebooks learnt over all vectors.

Each component x becomes the integer floor(scale * x), each vector is cut into equal parts,
and each part position has a codebook that starts as that part of the vectors of smallest id.

1. Vectors are written once, as packed integers, to the shared folder.
2. A round broadcasts a kd-tree per codebook (parts times entries short vectors, whatever
   the data).  Each task finds the nearest entries of its vectors by branch and bound, all
   vectors of a batch together, and sums them in integers; one row per entry and component
   leaves a task, Spark adds those up, and an entry becomes its parts' floored mean.
3. A last pass assigns again; errors add up by label before they are joined back.

The far side of a node is visited wherever its bound is not above the best distance, so also
where it is equal: an entry of lower index at the same distance is never missed, and which
entry wins depends on neither the tree nor the order of visits.

Integer sums are exact in any order: a lost executor's tasks give the same codebooks again.
Copies of a vector, however many, add up within their tasks.

Edge cases: a vector that is null or holds null, NaN or infinite components is dropped.
The length of the kept vector of smallest id counts; vectors of another length, of a length
that doesn't divide by the parts or of none, and such that hold a component of 65,536 or
more in size (their distances leave 64 bits) cannot be coded alike: they stay, with a null
code and a null error.  Null ids come after all others, rows that share an id in the order of
their components; with fewer vectors than entries the codebook is that much shorter.  A sum of
errors over nothing but null errors is null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosweep.llm.frames import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components below this have squared distances in 64 bits (up to 32 components a part).
LARGEST = 1 << 28
#: Vectors looked at together in a task.
ROWS = 8192
_FAR = np.iinfo(np.int64).max
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


class KdTree:
    """A codebook's entries, one at each node, cut at the median of the component that varies most."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.root = self._node(np.arange(len(book)))

    def _node(self, entries: np.ndarray):
        if not len(entries):
            return None
        axis = int(np.argmax(np.ptp(self.book[entries], axis=0)))
        entries = entries[np.argsort(self.book[entries, axis], kind="stable")]
        middle = len(entries) // 2
        return int(entries[middle]), axis, self._node(entries[:middle]), self._node(entries[middle + 1 :])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, the lowest index of equal ones."""
        at, best = np.full(len(x), len(self.book)), np.full(len(x), _FAR)
        self._visit(self.root, x, np.arange(len(x)), at, best)
        return at, best

    def _visit(self, node, x, rows, at, best) -> None:
        if node is None or not len(rows):
            return
        entry, axis, below, above = node
        distance = ((x[rows] - self.book[entry]) ** 2).sum(axis=1)
        better = (distance < best[rows]) | (distance == best[rows]) & (entry < at[rows])
        at[rows[better]], best[rows[better]] = entry, distance[better]
        gap = x[rows, axis] - self.book[entry, axis]
        low = gap < 0
        bound = gap**2
        for side, near, far in ((low, below, above), (~low, above, below)):
            self._visit(near, x, rows[side], at, best)
            # a bound that equals the best distance may hide an equal entry of lower index
            self._visit(far, x, rows[side & (bound <= best[rows])], at, best)


def packed(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(__id, __label, size, v): the vectors whose components are all finite, as integers of 32 bits; v is null if one is too large."""
    fields = T.StructType([T.StructField("__id", T.LongType()), vectors.schema[label], T.StructField("size", T.IntegerType()), T.StructField("v", T.BinaryType())])
    fields[1].name = fields.names[1] = "__label"
    source = vectors.select(F.col(vec_id).cast("long").alias("__id"), F.col(label).alias("__label"), F.col(vector).cast("array<double>").alias("__x"))

    def run(batches):
        for whole in batches:
            for from_row in range(0, whole.num_rows, ROWS):
                batch = whole.slice(from_row, ROWS)
                batch = batch.filter(batch.column("__x").is_valid())
                lists = batch.column("__x")
                size = np.asarray(pa.compute.list_value_length(lists), np.int64)
                flat = lists.flatten()
                x = np.asarray(flat.fill_null(float("nan")))
                row = np.repeat(np.arange(len(size)), size)
                good = np.bincount(row[~np.isfinite(x)], minlength=len(size)) == 0
                y = np.floor(np.where(np.isfinite(x), x, 0.0) * scale)
                fits = np.bincount(row[np.abs(y) >= LARGEST], minlength=len(size)) == 0
                raw = np.where(np.abs(y) < LARGEST, y, 0).astype("<i4").tobytes()
                edge = 4 * np.append(0, np.cumsum(size))
                values = [raw[edge[i] : edge[i + 1]] if fits[i] else None for i in np.flatnonzero(good)]
                kept = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([kept.column("__id"), kept.column("__label"), pa.array(size[good].astype(np.int32)), pa.array(values, pa.binary())], names=["__id", "__label", "size", "v"])

    return written(source.mapInArrow(run, fields))


def _matrix(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch can be coded, and their components."""
    column = batch.column("v")
    fit = np.asarray(column.is_valid()) & (np.asarray(batch.column("size")) == size)
    raw = b"".join(column.filter(pa.array(fit)).to_pylist())
    return fit, np.frombuffer(raw, "<i4").reshape(-1, size).astype(np.int64)


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """[part, entry, component] of the vectors of smallest id; None if they have no length that divides by the parts."""
    order = [F.asc_nulls_last("__id"), F.asc("size"), F.asc("v")]
    fit = rows.where(F.col("v").isNotNull())
    first = fit.orderBy(*order).select("size").first()
    if first is None or not first["size"] or first["size"] % parts:
        return None
    # a few vectors, whatever the data; equal ids by their components, whose bytes' order is any fixed one
    chosen = fit.where(F.col("size") == first["size"]).orderBy(*order).limit(entries).collect()
    x = np.stack([np.frombuffer(r["v"], "<i4") for r in chosen]).astype(np.int64)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def learn(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds of assignment to the nearest entry and floored means."""
    spark = rows.sparkSession
    parts, entries, width = books.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast([KdTree(book) for book in books])

        def run(batches, shared=shared):
            count = np.zeros((parts, entries), np.int64)
            total = np.zeros((parts, entries, width), np.int64)
            for batch in batches:
                _, x = _matrix(batch, parts * width)
                for p, tree in enumerate(shared.value):
                    own = x[:, p * width : (p + 1) * width]
                    at, _ = tree.nearest(own)
                    count[p] += np.bincount(at, minlength=entries)
                    np.add.at(total[p], at, own)
            slot = np.flatnonzero(np.repeat(count.reshape(-1), width))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count.reshape(-1)[slot // width]), pa.array(total.reshape(-1)[slot])], names=["slot", "n", "total"])

        sums = rows.select("size", "v").mapInArrow(run, "slot long, n long, total long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = books.copy()
        for r in sums.collect():
            books.reshape(-1)[r["slot"]] = r["total"] // r["n"]
    return books


def assigned(rows: DataFrame, books: np.ndarray | None) -> DataFrame:
    """(__id, __label, code, error) of each vector: its parts' nearest entries in hex, and their squared distances summed."""
    fields = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast(None if books is None else [KdTree(book) for book in books])

    def run(batches):
        for batch in batches:
            code, error = pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.int64())
            if shared.value is not None:
                parts, width = len(shared.value), shared.value[0].book.shape[1]
                fit, x = _matrix(batch, parts * width)
                found = [tree.nearest(x[:, p * width : (p + 1) * width]) for p, tree in enumerate(shared.value)]
                at = np.stack([a for a, _ in found], axis=1)
                text = np.stack([_HEX[at >> 4], _HEX[at & 15]], axis=2).reshape(-1)
                edge = np.arange(len(x) + 1, dtype=np.int32) * (2 * parts)
                place = pa.array(np.where(fit, np.cumsum(fit) - 1, 0), mask=~fit)
                code = pa.StringArray.from_buffers(len(x), pa.py_buffer(edge), pa.py_buffer(text)).take(place)
                error = pa.array(sum(d for _, d in found)).take(place)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), code, error], names=["__id", "__label", "code", "error"])

    return rows.mapInArrow(run, fields)


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """The kept vectors' ids, labels, codes and errors, and the codebooks [part, entry, component] that decode them."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    rows = packed(vectors, vec_id, vector, label, scale)
    books = first_books(rows, parts, entries)
    if books is not None:
        books = learn(rows, books, rounds)
    coded = assigned(rows, books).withColumnsRenamed({"__id": vec_id, "__label": label})
    return coded, np.zeros((parts, 0, 0), np.int64) if books is None else books


def decoded(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for, as doubles: its parts' entries one after the other."""
    value = F.lit(None).cast("array<double>")
    if books.size:
        entry = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1 for p in range(len(books))]
        book = [F.array(*[F.array(*[F.lit(float(c) / scale) for c in e]) for e in own]) for own in books]
        value = F.when(code.isNotNull(), F.concat(*[F.element_at(b, e) for b, e in zip(book, entry, strict=True)]))
    return value


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    # written, so that no vector is assigned twice, and the planner knows the sizes
    coded = written(coded)
    by_label = written(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL: a table of components, and codebooks by round."""
    ctes = [
        f"v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c AS MATERIALIZED (SELECT r, (i - 1) // (len(embedding) // {PARTS}) AS p, (i - 1) % (len(embedding) // {PARTS}) AS k, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM v))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, k, x FROM c WHERE r <= {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        ctes.append(f"d{n} AS (SELECT c.r, c.p, b{n}.e, sum((c.x - b{n}.x) * (c.x - b{n}.x)) AS d FROM c JOIN b{n} ON c.p = b{n}.p AND c.k = b{n}.k GROUP BY ALL)")
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, p, e, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)")
        if n < ROUNDS:
            mean = f"SELECT a{n}.p, e, k, CAST(floor_div AS BIGINT) AS x FROM (SELECT a{n}.p, e, k, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM a{n} JOIN c ON a{n}.r = c.r AND a{n}.p = c.p GROUP BY a{n}.p, e, k) AS a{n}"
            ctes.append(f"b{n + 1} AS MATERIALIZED (SELECT b{n}.p, b{n}.e, b{n}.k, coalesce(m.x, b{n}.x) AS x FROM b{n} LEFT JOIN ({mean}) m ON b{n}.p = m.p AND b{n}.e = m.e AND b{n}.k = m.k)")
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, k)) AS h FROM b{ROUNDS})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN coded USING (r), digest"


ORACLE = _oracle()
