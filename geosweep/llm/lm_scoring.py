"""LM scoring by deleted interpolation.

The model is P(w | h) = l2 c(h, w) / c(h) + l1 c(w) / N + l0 / (V + 1), with weights l by
bucket of the context's frequency c(h) (powers of two).  Counts cover every training
document.  Expectation-maximisation learns the weights on a held-out tenth of the
training documents, whose own counts are deleted from the estimates meanwhile; the final
model has all counts.

1. Documents are packed to compressed blocks in the shared folder, once.
2. Each block asks reducers, by n-gram hash, for the counts of all its distinct n-grams,
   giving its own; the replies carry total and held-out counts (no dictionary travels).
3. EM passes over the held-out blocks' counts, until a pass gains less than ``TOLERANCE`` of likelihood a
   token, however many that takes (no pass loses any, so it ends); 60-odd sums come back per pass.
4. Blocks meet their replies once more and score their documents.

Hot n-grams: a block sends an n-gram once, so a reducer gets one entry per block for it.

Edge cases: null text has just its end token; a null id counts as the empty string for
the folds (so it is held out); repeated rows count and score as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosweep.llm.blocks import Block, blocks, finish, pack, pair, unpack
from geosweep.llm.frames import REQUEST, REQUEST_ARROW, in_order, partitions, requests, spread, table, written

BUCKETS = 21
END, START = np.uint64(0x656E64), np.uint64(0x73746172)
PACK_BYTES = 6 << 20
#: EM ends when a pass makes the held-out tokens more likely by less than this (nats a token).
TOLERANCE = 1e-5
#: n-gram hashes keep 56 bits: a share of 10**-4 of keys meets another at 10**13 n-grams
_KEY = ~np.uint64(0xFF)


def packs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__b, dev, docs, train_docs, __v): blocks of documents; those of the held-out fold apart, with odd numbers."""
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10
    source = docs.select(F.col(doc_id).cast("long").alias("__id"), fold.cast("int").alias("__fold"), F.col(text).cast("string").alias("__text"))
    schema = pa.schema([("__b", pa.int64()), ("dev", pa.bool_()), ("docs", pa.int64()), ("train_docs", pa.int64()), ("__v", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        waiting: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(dev: bool) -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(waiting[dev]).combine_chunks()
            block = Block(rows.column("__text").chunk(0))
            ids, fold = rows.column("__id").chunk(0), np.asarray(rows.column("__fold").chunk(0))
            value = pack(np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()), fold.astype(np.uint8), block.offsets, block.buf)
            number += 1
            waiting[dev], size[dev] = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number << 1 | dev]), pa.array([dev]), pa.array([block.n_docs]), pa.array([int((fold != 0).sum())]), pa.array([value], pa.binary())], schema=schema
            )

        for part, block in blocks(batches, 1 << 20, "__text"):
            held = np.asarray(part.column("__fold")) == 1
            length = np.diff(block.offsets)
            for dev in (False, True):
                if (held == dev).any():
                    waiting[dev].append(part.filter(pa.array(held == dev)))
                    size[dev] += int(length[held == dev].sum())
                    if size[dev] >= PACK_BYTES:
                        yield flush(dev)
        for dev in (False, True):
            if waiting[dev]:
                yield flush(dev)

    return written(source.mapInArrow(run, "__b long, dev boolean, docs long, train_docs long, __v binary"))


class Tokens:
    """Tokens of a pack: words in lower case, then an end for each document."""

    def __init__(self, value: bytes):
        ids, null, self.fold, offsets, buf = unpack(value)
        self.ids = pa.array(ids, mask=null.astype(bool))
        block = Block.__new__(Block)
        block.buf, block.offsets, block.n_docs = buf, offsets, len(ids)
        n = block.n_words
        last = np.cumsum(n + 1) - 1
        self.token = np.full(len(block.start) + block.n_docs, END, np.uint64)
        words = np.ones(len(self.token), bool)
        words[last] = False
        self.token[words] = block.words(lower=True)
        self.doc = np.repeat(np.arange(block.n_docs), n + 1)
        self.n_docs, self.n_tokens = block.n_docs, n + 1
        before = np.append(START, self.token[:-1])
        self.first = np.append(0, last[:-1] + 1) if block.n_docs else last
        before[self.first] = START
        self.before = before
        self.one = finish(self.token ^ np.uint64(0x9E37)) & _KEY | np.uint64(1)
        self.two = pair(before, self.token, 1) & _KEY | np.uint64(2)
        self.train = (self.fold != 0)[self.doc]
        self.dev = (self.fold == 1)[self.doc]

    def distinct(self):
        """Sorted distinct n-grams with their training and held-out counts here."""
        every = np.concatenate([self.one, self.two])
        unique, back = np.unique(every, return_inverse=True)
        counts = [np.bincount(back, weights=np.tile(x, 2), minlength=len(unique)).astype(np.uint32) for x in (self.train, self.dev)]
        return unique, counts, back


def _ask(reducers: int):
    def run(batches):
        for batch in batches:
            for b, v in zip(batch.column("__b").to_pylist(), batch.column("__v").to_pylist(), strict=True):
                unique, counts, _ = Tokens(v).distinct()
                rows = requests(0, reducers, unique, *counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows.num_rows, b, np.int64)), *(rows.column(c).combine_chunks() for c in ("__r", "__v"))], names=["__b", "__r", "__v"]
                )

    return run


WIDE = REQUEST.replace("__b int", "__b long")
WIDE_ARROW = pa.schema([("__b", pa.int64()), *list(REQUEST_ARROW)[1:]])


def total_counts(asked: pa.Table) -> pa.Table:
    """Replies with total training and held-out counts; the row of pack -1 has this reducer's N, N held out and V."""
    parts_ = [unpack(v) for v in asked.column("__v").to_pylist()]
    keys = np.concatenate([p[0] for p in parts_])
    unique, back = np.unique(keys, return_inverse=True)
    totals = [np.bincount(back, weights=np.concatenate([p[i] for p in parts_]), minlength=len(unique)) for i in (1, 2)]
    word = (unique & np.uint64(0xFF)) == 1
    own = [totals[0][word].sum(), totals[1][word].sum(), float((totals[0][word] > 0).sum())]
    cut = np.cumsum([len(p[0]) for p in parts_])[:-1]
    replies = [pack(a.astype(np.uint64), d.astype(np.uint64)) for a, d in zip(*(np.split(t[back], cut) for t in totals), strict=True)]
    return pa.table(
        [
            pa.array([*asked.column("__b").to_pylist(), -1], pa.int64()),
            pa.array([*asked.column("__r").to_pylist(), asked.column("__r")[0].as_py()], pa.int32()),
            pa.array([*replies, pack(np.array(own))], pa.binary()),
        ],
        schema=WIDE_ARROW,
    )


class Counts:
    """Counts at each token of a pack, from the replies to it."""

    def __init__(self, tokens: Tokens, replies: pa.Table, train_docs: float, dev_docs: float):
        unique, _, back = tokens.distinct()
        got = [unpack(v) for v in in_order(replies)]
        total, held = (np.concatenate([g[i] for g in got]).astype(np.float64)[back] for i in (0, 1))
        n = len(tokens.token)
        self.word, self.both, self.word_held, self.both_held = total[:n], total[n:], held[:n], held[n:]
        # the context of a token is the token before it, or a document's start
        self.context = np.append(train_docs, self.word[:-1])
        self.context_held = np.append(dev_docs, self.word_held[:-1])
        self.context[tokens.first], self.context_held[tokens.first] = train_docs, dev_docs


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def components(both, context, word, n: float, v: float) -> np.ndarray:
    """The three estimates, one row each: uniform, unigram, bigram."""
    return np.stack([np.full(len(word), 1 / (v + 1)), word / max(n, 1), both / np.maximum(context, 1)])


def expectation(weights: np.ndarray, bucket: np.ndarray, f: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected use of each component by bucket, and the log-likelihood by bucket."""
    share = weights[bucket].T * f
    total = share.sum(axis=0)
    share *= times / total
    return np.stack([np.bincount(bucket, weights=s, minlength=BUCKETS) for s in share], axis=1), np.bincount(bucket, weights=times * np.log(total), minlength=BUCKETS)


def maximisation(used: np.ndarray) -> np.ndarray:
    total = used.sum(axis=1, keepdims=True)
    return np.where(total > 0, used / np.maximum(total, 1e-300), 1 / used.shape[1])


def _meet(packed: DataFrame, replies: DataFrame, n: int, fn, schema) -> DataFrame:
    return packed.repartition(n, "__b").groupBy("__b").cogroup(replies.repartition(n, "__b").groupBy("__b")).applyInArrow(fn, schema)


def learn(held: DataFrame, n: float, v: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights by bucket from a table of packed (bucket, bigram, context, unigram, times) counts."""
    weights, last = np.full((BUCKETS, 3), 1 / 3), -np.inf
    names = ["bucket", "u0", "u1", "u2", "likelihood"]

    while True:

        def run(batches, weights=weights):
            used, likely = np.zeros((BUCKETS, 3)), np.zeros(BUCKETS)
            for batch in batches:
                for value in batch.column("__v").to_pylist():
                    both, context, word, times = (x.astype(np.float64) for x in unpack(value))
                    more, gain = expectation(weights, bucket_of(context), components(both, context, word, n, v), times)
                    used += more
                    likely += gain
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *(pa.array(np.ascontiguousarray(c)) for c in used.T), pa.array(likely)], names=names)

        rows = held.mapInArrow(run, "bucket long, u0 double, u1 double, u2 double, likelihood double").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()
        used, likely = np.zeros((BUCKETS, 3)), 0.0
        for r in sorted(rows):
            used[r["bucket"]] = [r[c] for c in names[1:4]]
            likely += r["likelihood"]
        weights = maximisation(used)
        if not likely - last > tolerance * used.sum():
            return weights
        last = likely


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    packed = packs(docs, doc_id, text)
    sizes = packed.agg(
        F.sum("train_docs").alias("train"), F.sum(F.expr("CASE WHEN dev THEN docs ELSE 0 END")).alias("dev"), F.count(F.lit(1)).alias("packs")
    ).first()
    train_docs, dev_docs, reducers = float(sizes["train"] or 0), float(sizes["dev"] or 0), spread(max(1, sizes["packs"]))
    asked = packed.select("__b", "__v").mapInArrow(_ask(reducers), WIDE)
    n_parts = partitions(docs.sparkSession, sizes["packs"])
    replies = written(asked.repartition(n_parts, "__r").groupBy("__r").applyInArrow(total_counts, WIDE))
    own = [unpack(r["__v"])[0] for r in replies.where("__b = -1").select("__v").collect()]
    n, n_held, v = np.sum(own, axis=0) if own else (0.0, 0.0, 0.0)
    replies = replies.where("__b >= 0")

    def held_counts(pack_: pa.Table, got: pa.Table) -> pa.Table:
        schema = pa.schema([("__v", pa.binary())])
        if not pack_.num_rows:
            return schema.empty_table()
        t = Tokens(pack_.column("__v")[0].as_py())
        c = Counts(t, got, train_docs, dev_docs)
        rows = np.stack([c.both - c.both_held, c.context - c.context_held, c.word - c.word_held])
        rows, times = np.unique(rows, axis=1, return_counts=True)
        return pa.table([pa.array([pack(*(x.astype(np.uint64) for x in rows), times.astype(np.uint32))], pa.binary())], schema=schema)

    held = written(_meet(packed.where("dev").select("__b", "__v"), replies.where("__b % 2 = 1"), n_parts, held_counts, "__v binary"))
    weights = learn(held, n - n_held, v)

    schema = pa.schema([("__id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(pack_: pa.Table, got: pa.Table) -> pa.Table:
        if not pack_.num_rows:
            return schema.empty_table()
        t = Tokens(pack_.column("__v")[0].as_py())
        c = Counts(t, got, train_docs, dev_docs)
        p = (weights[bucket_of(c.context)].T * components(c.both, c.context, c.word, n, v)).sum(axis=0)
        base = np.log10((c.word + 0.1) / (n + 0.1 * (v + 1)))
        by_doc = lambda x: np.bincount(t.doc, weights=x, minlength=t.n_docs)
        return pa.table(
            [t.ids, pa.array(t.fold == 0), pa.array(t.n_tokens.astype(np.int64)), pa.array(by_doc(c.word > 0).astype(np.int64)), pa.array(np.full(t.n_docs, int(n), np.int64)), pa.array(by_doc(base)), pa.array(by_doc(np.log10(p)))],
            schema=schema,
        )

    out = "__id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _meet(packed.select("__b", "__v"), replies, n_parts, score, out).withColumnRenamed("__id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
