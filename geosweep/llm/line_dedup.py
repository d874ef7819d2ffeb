"""Line dedup: lines found in many documents stay in one of them only.

Each line's key is the line without surrounding white space and with A-Z in lower case.
Keys are exploded to rows as 128-bit content hashes, distinct documents are counted per
hash, and every key of at least ``min_chars`` code points in at least ``min_docs``
documents loses its lines except in the largest document id that holds it.  The other
lines keep their order.

Hot keys: the count is distributed by (key, document) first and partly summed before it
meets at the key; the join back broadcasts the fewer than 1,000 keys that hold over a
thousandth of all rows and shuffles the rest.

Edge cases: null text is one empty line; rows that share a document id are one document;
a null document id is no document in the count and never the one that keeps the line;
input columns named like the operator's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosweep.llm.blocks import Block, blocks, span_hashes
from geosweep.llm.frames import split_join, table, written

KEYS = ["__k1", "__k2"]


def line_keys(block: Block, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line's key, and whether the key is long enough."""
    start, end, _ = block.lines
    first = np.searchsorted(block.start, start)
    last = np.searchsorted(block.start, end) - 1
    some = last >= first
    a, b = start.copy(), start.copy()
    a[some], b[some] = block.start[first[some]], block.end[last[some]]
    points = np.concatenate([[0], np.cumsum((block.buf & 0xC0) != 0x80)])
    return span_hashes(block.buf, a, b, True), span_hashes(block.buf, a, b, True, 1), points[b] - points[a] >= min_chars


def _explode(min_chars: int, schema: pa.Schema):
    def run(batches):
        for part, block in blocks(batches, text="__text"):
            k1, k2, long = line_keys(block, min_chars)
            doc = block.lines[2][long]
            rows = np.unique(np.rec.fromarrays([doc, k1[long].view(np.int64), k2[long].view(np.int64)]))
            at = pa.array(np.ascontiguousarray(rows["f0"]))
            columns = [part.column(c).take(at) for c in ("__id", "__alt")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(rows[f])) for f in ("f1", "f2"))], schema=schema)

    return run


def _reassemble(keep: list[str], min_chars: int, schema: pa.Schema):
    def run(batches):
        for part, block in blocks(batches, text="__text"):
            k1, k2, _ = line_keys(block, min_chars)
            _, _, doc = block.lines
            drop = np.zeros(len(k1), bool)
            lists = part.column("__drops")
            flat = lists.flatten()
            owner = np.repeat(np.arange(block.n_docs), np.asarray(lists.value_lengths().fill_null(0)))
            if len(flat):
                # structs of (document, key) meet in one sort
                have = np.rec.fromarrays([doc, k1.view(np.int64), k2.view(np.int64)], names="d,a,b")
                want = np.rec.fromarrays([owner, *(np.asarray(flat.field(i)) for i in (0, 1))], names="d,a,b")
                drop = np.isin(have, want)
            made = [
                pa.array(np.bincount(doc, minlength=block.n_docs)),
                pa.array(np.bincount(doc[drop], minlength=block.n_docs)),
                block.without_lines(drop),
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], schema=schema)

    return run


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but the text, then n_lines, n_dropped and the remaining text as kept_text."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    keep = [c for c in docs.columns if c != text and c not in made.fieldNames()]
    source = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(text).cast("string").alias("__text"),
        F.col(doc_id).alias("__id"),
        # documents without an id are told apart by their text
        F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.lit(0)).alias("__alt"),
    )
    id_type = docs.schema[doc_id].dataType
    key_schema = T.StructType(
        [T.StructField("__id", id_type), T.StructField("__alt", T.LongType()), *(T.StructField(k, T.LongType()) for k in KEYS)]
    )
    lines = written(source.select("__text", "__id", "__alt").mapInArrow(_explode(min_chars, to_arrow_schema(key_schema)), key_schema))
    hot = (
        lines.groupBy(*KEYS)
        .agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__last"))
        .where(F.col("__n") >= min_docs)
        .select(*KEYS, "__last")
    )
    drops = (
        split_join(lines, hot, KEYS)
        .where(F.col("__id").isNull() | (F.col("__id") != F.col("__last")))
        .groupBy("__id", "__alt")
        .agg(F.collect_set(F.struct(*KEYS)).alias("__drops"))
        .select(F.col("__id").alias("__rid"), F.col("__alt").alias("__ralt"), "__drops")
    )
    # an alt hash only ever matters for rows without an id, so the join stays one on equality
    joined = source.join(drops, F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__alt") == F.col("__ralt")), "left")
    out = T.StructType([docs.schema[c] for c in keep] + made.fields)
    return joined.select(*[f"`{c}`" for c in keep], "__text", "__drops").mapInArrow(_reassemble(keep, min_chars, to_arrow_schema(out)), out)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the text that line dedup leaves."""
    done = line_dedup(docs)
    return done.select(
        *[
            F.col("kept_text").alias(c) if c == "text" else F.length("kept_text").cast("long").alias(c) if c == "n_chars" else F.col(c)
            for c in docs.columns
        ]
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


KEY_SQL = r"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql(source: str) -> str:
    """DuckDB SQL for (doc_id, n_lines, n_dropped, kept_text) over a relation of (doc_id, text)."""
    return f"""
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept_text
FROM (
  SELECT l.doc_id, l.line, l.pos, coalesce(l.doc_id IS DISTINCT FROM h.last, false) AND h.key IS NOT NULL AS dropped
  FROM (SELECT doc_id, pos, line, {KEY_SQL} AS key FROM (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM ({source}))) l
  LEFT JOIN (SELECT key, max(doc_id) AS last FROM (SELECT doc_id, {KEY_SQL} AS key FROM (
               SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM ({source})))
             WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3) h ON h.key = l.key)
GROUP BY doc_id
"""


ORACLE = f"SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM ({sql('SELECT doc_id, text FROM documents')})"
