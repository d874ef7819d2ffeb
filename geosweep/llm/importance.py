"""Target-distribution importance resampling by external sort-count.

Every word and pair of words of a text falls into a hash bucket; documents whose features
are more usual in the target than in the corpus get a positive weight, Gumbel noise by
document makes the draw a sample without replacement, and the highest scores are drawn.

1. Each block of documents writes its features' buckets as one packed uint16 stream, with
   the number of features of each document, to the shared folder.
2. Counts: each stream is sorted and run-length encoded; the runs of a task add up before
   one row per bucket leaves it.
3. The gains by bucket (a fixed number of them) go back to all executors, and a second
   pass over the streams gathers them and sums each document with ``np.add.reduceat``.
4. Ranks: a histogram of the scores (whole numbers, some 100,000 different ones at most,
   as gains are logarithms of counts) gives the least score that is drawn; only rows from
   there on are dealt to ranges of (score, id), numbered within a range, and moved by the
   sizes of the ranges before.

CRC-32 of a pair of words is put together from those of its words, so that each byte is
hashed once: appending n bytes to a text maps its checksum linearly.

Nothing is keyed by source, word or copy, so hot ones need no care: what a task sends is
one row for each bucket at most.

Edge cases: null and empty texts have no features and weigh 0; a null id counts as the
empty string in the noise and comes after all others in a tie; rows that share an id are
documents of their own, in a tie in the order of their weights and features; an empty
target has t = T = 0; empty documents give no rows.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosweep.llm.blocks import Block, blocks, pack, unpack
from geosweep.llm.frames import parts, table, written

BUCKETS = 10_000
SEED, MIN_WORDS, PERCENT, SCALE = 7, 20, 25, 1000
#: Words up to so many bytes are hashed together, one byte of all of them a step.
SHORT = 64

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@functools.cache
def _step() -> np.ndarray:
    """The register after one byte, by the register's low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


@functools.cache
def _shifts() -> np.ndarray:
    """[n, i, b]: what byte i of a checksum, if it is b, becomes when n zero bytes follow."""
    made = [np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(SHORT):
        made.append(_step()[made[-1] & 255] ^ made[-1] >> 8)
    return np.stack(made)


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that a checksum has in that of its text with n more bytes behind it."""
    crc, n = crc.copy(), n.copy()

    def shift(c, by):
        return np.bitwise_xor.reduce([_shifts()[by, i, c >> np.uint32(8 * i) & 255] for i in range(4)])

    while (far := np.flatnonzero(n > SHORT)).size:
        crc[far] = shift(crc[far], SHORT)
        n[far] -= SHORT
    return shift(crc, n)


def checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    first, size = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(min(int(size[0]), SHORT) if len(size) else 0):
        live = np.searchsorted(-size, -j, "left")
        c = crc[:live]
        crc[:live] = _step()[(c ^ buf[first[:live] + j]) & 255] ^ c >> 8
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[: np.searchsorted(-size, -SHORT, "left")]:
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    return out


def features(block: Block, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words by document, and the buckets of all words and pairs of words, document by document."""
    buf = _LOWER[block.buf]
    turn = np.flatnonzero(np.diff(_WORD_BYTE[buf], prepend=False, append=False))
    start, end = turn[0::2], turn[1::2]
    n = np.diff(np.searchsorted(start, block.offsets))
    crc = checksums(buf, start, end)
    doc = np.repeat(np.arange(block.n_docs), n)
    # a word's place: two for every word before it, less one for every document that ended
    some = n > 0
    place = 2 * np.arange(len(start)) - (np.cumsum(some) - some)[doc]
    stream = np.empty(int(2 * n.sum() - some.sum()), np.uint16)
    stream[place] = crc % np.uint32(n_buckets)
    two = np.flatnonzero(doc[1:] == doc[:-1])
    spaced = moved(crc[two], np.ones(len(two), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    stream[place[two] + 1] = (moved(spaced, (end - start)[two + 1]) ^ crc[two + 1]) % np.uint32(n_buckets)
    return n, stream


def streams(docs: DataFrame, doc_id: str | None, text: str, n_buckets: int) -> DataFrame:
    """(ids, words, stream): blocks of documents as packed bucket streams, in the shared folder."""
    source = docs.select((F.col(doc_id).cast("long") if doc_id else F.lit(0).cast("long")).alias("__id"), F.col(text).cast("string").alias("__text"))
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("stream", pa.binary())])

    def run(batches):
        for part, block in blocks(batches, text="__text"):
            n, stream = features(block, n_buckets)
            yield pa.RecordBatch.from_arrays([pa.array([part.column("__id").to_pylist()], schema[0].type), pa.array([n], schema[1].type), pa.array([pack(stream)], pa.binary())], schema=schema)

    return written(source.mapInArrow(run, "ids array<long>, words array<long>, stream binary"))


def bucket_counts(packed: DataFrame, n_buckets: int) -> np.ndarray:
    """Features in each bucket: each stream sorted and run-length encoded, the runs added up by task and then by bucket."""

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for value in batch.column("stream").to_pylist():
                ordered = np.sort(unpack(value)[0], kind="stable")
                at = np.flatnonzero(np.diff(ordered.astype(np.int32), prepend=-1))
                total[ordered[at]] += np.diff(at, append=len(ordered))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counts = np.zeros(n_buckets, np.int64)
    for row in packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of a nat by bucket: how much more usual it is in the target, with one feature added to each bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(__id, n_words, n_features, weight) of each document: the floored mean gain of its features."""
    schema = pa.schema([("__id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
    shared = packed.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in batches:
            for ids, words, value in zip(batch.column("ids"), batch.column("words"), batch.column("stream").to_pylist(), strict=True):
                words = np.asarray(words.values)
                n = np.maximum(2 * words - 1, 0)
                some = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if some.size:
                    first = (np.cumsum(n) - n)[some]
                    weight[some] = np.add.reduceat(shared.value[unpack(value)[0]], first) // n[some]
                yield pa.RecordBatch.from_arrays([ids.values, *map(pa.array, (words, n, weight))], schema=schema)

    return packed.mapInArrow(run, "__id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, quota: int, order: list) -> DataFrame:
    """The rows with rank 1, 2, ... in that order, null beyond the quota; without one task that sees them all."""
    n = parts(scored.sparkSession)
    # the number of a row within its range, and that of the range, in one: written, so that they stay
    numbered = written(scored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = dict(numbered.groupBy(part.alias("p")).count().collect())
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    if not starts:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    offset = F.broadcast(scored.sparkSession.createDataFrame(starts, "__p long, __before long").coalesce(1))
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return numbered.withColumn("__p", part).join(offset, "__p").select(*scored.columns, F.when(rank <= quota, rank).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    n_buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of each document."""
    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("a bucket's number has 16 bits")
    packed = streams(docs, doc_id, text, n_buckets)
    gain = gains(bucket_counts(packed, n_buckets), bucket_counts(streams(target, None, target_text, n_buckets), n_buckets))
    scored = written(weights(packed, gain).withColumn("score", F.col("weight") + noise(F.col("__id"), seed)))
    eligible = F.col("n_words") >= min_words
    histogram = sorted(scored.where(eligible).groupBy("score").count().collect(), reverse=True)
    quota = percent * sum(n for _, n in histogram) // 100
    least, drawn = None, 0
    for score, n in histogram:
        if drawn >= quota:
            break
        least, drawn = score, drawn + n
    chance = eligible & (F.col("score") >= F.lit(least).cast("long")) if least is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("__id"), F.desc("weight"), F.desc("n_features")]
    rest = scored.where(~chance).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(ranked(scored.where(chance), quota, order)).withColumnRenamed("__id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same in SQL: CRC-32 by its table over the bytes of each distinct feature.
ORACLE = f"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT doc_id, 'd' AS side, {_WORDS} AS w, row_number() OVER () AS r FROM documents
UNION ALL SELECT NULL, 'b', {_WORDS}, NULL FROM benchmark),
f AS (SELECT r, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
c AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(hex(f), 2 * i - 1, 2))::BIGINT)), lambda h, b: xor(t[(xor(h, b) & 255) + 1], h >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), tab),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM f JOIN c USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN c USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
x AS (SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h, w.r FROM w LEFT JOIN m USING (r) WHERE side = 'd'),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS rank FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (25 * (SELECT count(*) FROM z)) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)"""
