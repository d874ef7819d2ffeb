"""Substring dedup by recompression.

Each round replaces a document's symbols by larger ones: a pair of neighbours whose left
symbol falls to the left half of the alphabet and whose right one to the right half
becomes one symbol, and a run of equal symbols left over becomes one symbol.  Halves are
drawn by hashing, and a new symbol's name is the hash of what it stands for, so every
executor gives equal pairs and runs the same name: names are global without a table.

Every symbol also knows the span of words that its making depended on.  Where that span
lies within two equal windows, both hold the symbol at the same offset.  A window's
anchor is the first such symbol of the highest level that has one (words themselves, of
level 0, always qualify), so equal windows have equal anchors.

1. Buckets of documents send the names of their anchors, each once, to reducers by name;
   the reply says which occur more than once in the corpus (reveal).
2. Only windows with a repeated anchor send a 96-bit digest of their words and their
   place; the reply lists those that also start earlier (verify).
3. Words covered by such windows go.

Hot passages: a bucket sends each name and each digest once however often it holds it, so
no reducer gets more than one entry per bucket for it.

Edge cases: null text has no words; documents under ``window`` words lose none; rows
without an id come after all others, and rows that share one, or have none, are ordered by
their text within a bucket and by bucket otherwise, so every pass sees one order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosweep.llm.blocks import Block, finish, gram_digest, pack, pair, unpack
from geosweep.llm.frames import REQUEST, REQUEST_ARROW, answers, by_reducer, dealt, in_order, n_buckets, requests, table, with_answers

ROUNDS = 6
_FAR = 1 << 30


def recompress(name: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
    """Levels of symbols as (name, start, lowest and highest word depended on)."""
    start = np.arange(len(name), dtype=np.int32)
    lo, hi = start, start
    levels = [(name, start, lo, hi)]
    for k in range(rounds):
        n = len(name)
        if n < 2:
            break
        right_half = finish(name ^ np.uint64(0x51ED270B7A3D * (k + 1))) >> np.uint64(63) == 1
        near = doc[1:] == doc[:-1]
        joins = ~right_half[:-1] & right_half[1:] & near
        head = np.ones(n, bool)
        head[1:] = ~joins
        at = np.flatnonzero(head)
        merged = np.zeros(n, bool)
        merged[:-1] = joins
        merged = merged[at]
        has_next, has_prev = np.append(near, False), np.append(False, near)
        up, down = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        # a left-half symbol is decided by its successor, a right-half one by its predecessor
        lo1 = np.where(right_half, np.where(has_prev, np.minimum(lo, lo[down]), -_FAR), np.where(has_next, np.minimum(lo, lo[up]), lo))
        hi1 = np.where(right_half, np.where(has_prev, np.maximum(hi, hi[down]), hi), np.where(has_next, np.maximum(hi, hi[up]), _FAR))
        name1, lo1, hi1, doc1, start1 = name[at], lo1[at], hi1[at], doc[at], start[at]
        name1 = np.where(merged, pair(name1, name[np.minimum(at + 1, n - 1)], 2), name1)

        same = ~merged[1:] & ~merged[:-1] & (name1[1:] == name1[:-1]) & (doc1[1:] == doc1[:-1])
        first = np.flatnonzero(np.append(True, ~same))
        size = np.diff(np.append(first, len(name1)))
        name, start, doc = name1[first], start1[first], doc1[first]
        name = np.where(size > 1, pair(name, size.astype(np.uint64), 3), name)
        last = first + size
        before = np.append(False, doc1[1:] == doc1[:-1])[first]
        after = np.append(doc1[1:] == doc1[:-1], False)[last - 1]
        lo = np.where(before, np.minimum(np.minimum.reduceat(lo1, first), lo1[np.maximum(first - 1, 0)]), -_FAR)
        hi = np.where(after, np.maximum(np.maximum.reduceat(hi1, first), hi1[np.minimum(last, len(hi1) - 1)]), _FAR)
        # what is merged in this round cannot belong to a run and depends on its parts alone
        alone = merged[first]
        lo, hi = np.where(alone, lo1[first], lo), np.where(alone, hi1[first], hi)
        levels.append((name, start, lo, hi))
    return levels


def anchors(words: np.ndarray, doc: np.ndarray, window: int, rounds: int = ROUNDS):
    """Starts of all windows, and the level and symbol that anchor each."""
    n = len(words) - window + 1
    at = np.flatnonzero(doc[: max(n, 0)] == doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
    levels = recompress(words, doc, rounds)
    level, symbol = np.zeros(len(at), np.int8), at.copy()
    open_, todo = np.arange(len(at)), at
    for k in range(len(levels) - 1, 0, -1):
        _, _, lo, hi = levels[k]
        # ends of spans never fall within a document, so the first symbol that depends on nothing before
        # the window is the only one to try; symbols that depend on their document's edge lie lower
        first = np.searchsorted(np.maximum.accumulate(lo), todo.astype(lo.dtype))
        good = np.append(hi, _FAR)[first] < todo + window
        level[open_[good]], symbol[open_[good]] = k, first[good]
        open_, todo = open_[~good], todo[~good]
    return at, level, symbol, levels


class _Bucket:
    """A bucket's documents in the order that decides which window is earlier."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pa.compute.sort_indices(rows, [("__id", "ascending"), ("__text", "ascending")], null_placement="at_end"))
        self.ids = rows.column("__id").combine_chunks()
        if isinstance(self.ids, pa.ChunkedArray):
            self.ids = pa.concat_arrays(self.ids.chunks) if self.ids.num_chunks else pa.array([], pa.int64())
        text = rows.column("__text").combine_chunks()
        self.block = Block(text)
        self.order = np.asarray(self.ids.fill_null(2**63 - 1), dtype=np.int64)
        self.words = self.block.words()

    def anchored(self, window: int):
        """Starts of all windows, the place of each one's anchor among the sorted names, these, and which occur twice."""
        at, level, symbol, levels = anchors(self.words, self.block.word_doc, window)
        place = np.zeros(len(at), np.int64)
        names, n = [np.zeros(0, np.uint64)], 0
        for k, (symbols, *_) in enumerate(levels):
            mine = np.flatnonzero(level == k)
            used = np.zeros(len(symbols), bool)
            used[symbol[mine]] = True
            names.append(finish(symbols[used] ^ np.uint64(k << 56 | k)))
            place[mine] = (np.cumsum(used) - 1 + n)[symbol[mine]]
            n += len(names[-1])
        unique, back, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        return at, back[place], unique, count > 1


def _ask_names(window: int, reducers: int):
    def fn(rows: pa.Table) -> pa.Table:
        b = _Bucket(rows)
        _, _, unique, twice = b.anchored(window)
        return requests(rows.column("__b")[0].as_py(), reducers, unique, twice.astype(np.uint8))

    return fn


def repeated_names(asked: pa.Table) -> pa.Table:
    """Reply to each request: per name, whether it occurs more than once in all buckets."""
    parts_ = [unpack(v) for v in asked.column("__v").to_pylist()]
    names, twice = (np.concatenate([p[i] for p in parts_]) for i in (0, 1))
    _, back, count = np.unique(names, return_inverse=True, return_counts=True)
    more = (count + np.bincount(back, weights=twice) > 1)[back]
    cut = np.cumsum([len(p[0]) for p in parts_])[:-1]
    return answers(asked, [pack(np.packbits(x)) for x in np.split(more, cut)])


def _bits(replies: pa.Table, unique: np.ndarray, reducers: int) -> np.ndarray:
    """The replies' bits in the order of the sorted names that were asked for."""
    from geosweep.llm.frames import reducer_of

    sizes = np.bincount(reducer_of(unique, reducers), minlength=reducers)
    flags = [np.unpackbits(unpack(v)[0])[:size] for v, size in zip(in_order(replies), sizes[sizes > 0], strict=True)]
    return np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)


def _sorted_by(first: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Order by a hash, and by ``then`` (and place) where hashes are equal; only those rows are sorted by all columns."""
    order = np.argsort(first)
    same = first[order[1:]] == first[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(order) else order
    rows = np.sort(order[tied])
    order[tied] = rows[np.lexsort([c[rows] for c in (*then[::-1], first)])]
    return order


def _ask_windows(window: int, reducers: int):
    def fn(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return REQUEST_ARROW.empty_table()
        b = _Bucket(rows)
        at, place, unique, _ = b.anchored(window)
        more = _bits(replies, unique, reducers)
        at = at[more[place]]
        digest = gram_digest(b.words, window)[at] if len(at) else gram_digest(b.words[:0], window)
        hi, lo = np.ascontiguousarray(digest["hi"]), np.ascontiguousarray(digest["lo"])
        order = _sorted_by(hi, lo, at)
        hi, lo, at = hi[order], lo[order], at[order]
        head = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))[: len(at)]
        number = rows.column("__b")[0].as_py()
        local = np.sort(at[~head]).astype(np.uint32)
        hi, lo, at = hi[head], lo[head], at[head]
        doc = b.block.word_doc[at]
        out = requests(number, reducers, hi, lo, b.order[doc], at.astype(np.uint32))
        own = pa.table([pa.array([number], pa.int32()), pa.array([-1 - number], pa.int32()), pa.array([pack(local)])], schema=REQUEST_ARROW)
        return pa.concat_tables([out, own])

    return fn


def later_windows(asked: pa.Table) -> pa.Table:
    """Reply to each request: places of its windows that also start earlier elsewhere."""
    if asked.column("__r")[0].as_py() < 0:  # what a bucket knows by itself goes back to it
        return asked.select(REQUEST_ARROW.names)
    asked = asked.take(pa.compute.sort_indices(asked, [("__b", "ascending")]))  # ties go to the lower bucket
    parts_ = [unpack(v) for v in asked.column("__v").to_pylist()]
    hi, lo, doc, at = (np.concatenate([p[i] for p in parts_]) for i in range(4))
    order = _sorted_by(hi, lo, doc, at)
    later = np.zeros(len(hi), bool)
    later[order[1:]] = (hi[order[1:]] == hi[order[:-1]]) & (lo[order[1:]] == lo[order[:-1]])
    cut = np.cumsum([len(p[0]) for p in parts_])[:-1]
    return answers(asked, [pack(np.sort(a[f])) for a, f in zip(np.split(at, cut), np.split(later, cut), strict=True)])


RESULT = "__id long, n_words long, n_removed long, kept_text string"


def _remove(window: int):
    schema = pa.schema([("__id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def fn(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        b = _Bucket(rows)
        cover = np.zeros(len(b.words) + window + 1, np.int32)
        for v in replies.column("__v").to_pylist():
            at = unpack(v)[0].astype(np.int64)
            cover[at] += 1
            cover[at + window] -= 1
        gone = np.cumsum(cover)[: len(b.words)] > 0
        n = b.block.n_words.astype(np.int64)
        removed = np.bincount(b.block.word_doc[gone], minlength=b.block.n_docs)
        return pa.table([b.ids, pa.array(n), pa.array(removed), b.block.joined_words(~gone)], schema=schema)

    return fn


def substring_dedup(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its id, n_words, n_removed and the words left, joined by one space, as kept_text."""
    buckets = n_buckets(docs, text)
    own = dealt(docs, buckets, doc_id, text)
    names = by_reducer(own.groupBy("__b").applyInArrow(_ask_names(window, buckets), REQUEST), repeated_names, buckets)
    asked = with_answers(own, names, _ask_windows(window, buckets), REQUEST, buckets)
    places = by_reducer(asked, later_windows, buckets)
    return with_answers(own, places, _remove(window), RESULT, buckets).withColumnRenamed("__id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT doc_id, list_sort(list(DISTINCT p)) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY 1),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
g1 AS (SELECT doc_id, unnest(ps) AS p FROM gone),
k AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept FROM e ANTI JOIN g1 ON e.doc_id = g1.doc_id AND e.p = g1.p GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(gone.ps), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN k USING (doc_id)
"""
