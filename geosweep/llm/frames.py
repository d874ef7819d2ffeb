"""DataFrame plumbing of the corpus operators: block maps, block exchanges, skew-proof joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosweep.llm.blocks import blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only a session on one machine may do without that setting; elsewhere its absence is an error.
    """
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='geosweep-')}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))


def map_blocks(
    docs: DataFrame,
    fn: Callable[[pa.RecordBatch, object], dict[str, object]],
    schema: T.StructType,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """One output row per document: the ``keep`` columns as they are, then those that ``fn`` makes.

    A column of ``keep`` whose name ``fn`` also makes gives way to the new one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in keep if c not in schema.fieldNames()]
    out = T.StructType([docs.schema[c] for c in keep] + list(schema.fields))
    label = "__text"
    while label in keep:
        label += "_"
    reads = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(label))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, text=label):
            made = fn(part, block)
            columns = [part.column(c) for c in keep]
            columns += [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[f.name] for f in schema.fields)]
            yield pa.RecordBatch.from_arrays(
                [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return reads.mapInArrow(run, out)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in all documents (one scan of that column, one number back)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)).alias("n")).first()["n"]


#: Bytes of text of a document bucket while there are up to so many buckets.
BUCKET_BYTES, MANY = 6 << 20, 2000
#: Partitions of a block exchange at most; a task then takes several buckets, one after the other.
MOST_PARTITIONS = 8000


def deal(size: int) -> int:
    """How many document buckets to deal for so many bytes of text.

    One per 6 MB up to 2,000 (12 GB); from there their number grows with the square root of the
    input, as each sends a row to each reducer, and so does what one of them holds.
    """
    return spread(max(1, math.ceil(size / BUCKET_BYTES)))


def spread(n: int) -> int:
    return n if n <= MANY else math.ceil(math.sqrt(MANY * n))


def n_buckets(docs: DataFrame, text: str = "text") -> int:
    return deal(text_bytes(docs, text))


def partitions(spark: SparkSession, buckets: int) -> int:
    return max(min(buckets, MOST_PARTITIONS), parts(spark))


HEAVY_SHARE = 1000


def heavy_keys(rows: DataFrame, key: list[str], share: int = HEAVY_SHARE) -> list:
    """Keys that hold more than 1/share of all rows: fewer than ``share`` of them by the pigeonhole.

    That bound, and not the data, limits what comes to the driver.
    """
    total = rows.count()
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") * share > total).select(*key).collect()


def split_join(
    rows: DataFrame, unique: DataFrame, key: list[str], how: str = "inner", share: int = HEAVY_SHARE, heavy: list | None = None
) -> DataFrame:
    """Equi-join of many ``rows`` with a side that has one row a key, safe against hot keys.

    Keys with more than 1/share of the rows (fewer than ``share`` keys, whatever the data)
    are joined by broadcasting just their rows of ``unique``; the others by a shuffle in
    which no key holds more than 1/share of the rows.  ``rows`` is read twice to find
    them, so an expensive one should be written before; ``heavy`` gives keys known already.
    """
    heavy = heavy_keys(rows, key, share) if heavy is None else heavy
    if not heavy:
        return rows.join(unique, key, how)
    schema = T.StructType([rows.schema[k] for k in key])
    listed = F.broadcast(rows.sparkSession.createDataFrame(heavy, schema).coalesce(1))
    few = F.broadcast(unique.join(listed, key, "left_semi"))
    hot = rows.join(listed, key, "left_semi").join(few, key, how)
    cold = rows.join(listed, key, "left_anti").join(unique, key, how)
    return hot.unionByName(cold)


def deal_key(doc_id: str, text: str):
    """Hash that decides a document's bucket: of its id, or of its text where it has none."""
    return F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text).cast("string"))).otherwise(F.xxhash64(F.col(doc_id).cast("long")))


def dealt(docs: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(__b, __id, __text): documents dealt to buckets by a hash of their id (of their text, without one).

    A plan may read this several times; Spark then shuffles the texts once and reuses that exchange.
    """
    spark = docs.sparkSession
    return docs.select(
        F.pmod(deal_key(doc_id, text), F.lit(buckets)).cast("int").alias("__b"), F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text")
    ).repartition(partitions(spark, buckets), "__b")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


REQUEST = "__b int, __r int, __v binary"
REQUEST_ARROW = pa.schema([("__b", pa.int32()), ("__r", pa.int32()), ("__v", pa.binary())])


def reducer_of(keys, reducers: int):
    """Reducer of each 64-bit hash; monotone, so that sorted keys are sorted by reducer."""
    import numpy as np

    return ((keys >> np.uint64(32)) * np.uint64(reducers) >> np.uint64(32)).astype(np.int64)


def requests(bucket: int, reducers: int, keys, *more) -> pa.Table:
    """One packed row for each reducer that any of the sorted ``keys`` belongs to."""
    import numpy as np

    from geosweep.llm.blocks import pack

    cut = np.searchsorted(reducer_of(keys, reducers), np.arange(reducers + 1))
    some = np.flatnonzero(cut[1:] > cut[:-1])
    values = [pack(keys[cut[r] : cut[r + 1]], *(m[cut[r] : cut[r + 1]] for m in more)) for r in some]
    return pa.table(
        [pa.array(np.full(len(some), bucket, np.int32)), pa.array(some.astype(np.int32)), pa.array(values, pa.binary())], schema=REQUEST_ARROW
    )


def answers(asked: pa.Table, values: list[bytes]) -> pa.Table:
    """One reply row for each request row."""
    return pa.table([asked.column("__b"), asked.column("__r"), pa.array(values, pa.binary())], schema=REQUEST_ARROW)


def by_reducer(asked: DataFrame, reduce: Callable[[pa.Table], pa.Table], reducers: int) -> DataFrame:
    n = partitions(asked.sparkSession, reducers)
    return asked.repartition(n, "__r").groupBy("__r").applyInArrow(reduce, REQUEST)


def with_answers(docs_dealt: DataFrame, replies: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema, buckets: int) -> DataFrame:
    """``fn`` on each bucket's documents and the replies to it (None in a bucket without)."""
    n = partitions(docs_dealt.sparkSession, buckets)
    return docs_dealt.groupBy("__b").cogroup(replies.repartition(n, "__b").groupBy("__b")).applyInArrow(fn, schema)


def in_order(replies: pa.Table) -> list[bytes]:
    return [replies.column("__v")[int(i)].as_py() for i in pa.compute.sort_indices(replies, [("__r", "ascending")])]
