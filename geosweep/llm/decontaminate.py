"""Benchmark decontamination by pigeonhole edit matching.

Text is compared in lower case with every stretch of white space as one space.  A test
item of m characters has an error budget of k = floor(max_error * m) edits and is split
into k + 1 pieces: a passage within k edits of the item holds one of them unchanged.  An
Aho-Corasick automaton finds all pieces of all items in one scan of a document, and
Myers' bit-parallel algorithm gives the exact edit distance of the item to the best
passage around each hit.

A hit is verified in steps: the pigeonhole holds at every level when a stretch with budget
b is halved into stretches with budgets that sum to b - 1, so the stretch of two pieces
around a hit has to be within its own small budget before the next larger one is aligned,
and the whole item last.  Before the first alignment, what lies beside the hit in its
smallest stretch is cut once more into its budget plus one parts, one of which has to be
there.  So a chance hit costs a few substring tests, and no match is lost.

Items travel to the executors in blocks of bounded size, each block one scan; documents
are never shuffled, and whatever a document holds, its work stays within its row.

An item shorter than ``min_chars`` has too small a budget to be told from chance: it matches
without edits, by the caller's rule ``short``: "anywhere" at word bounds; "phrases", the same for
items of two words and more, while one word, which nearly every text may hold, has to be the whole
text; or "lines", as a whole line (one word as the whole text).

Edge cases: null or empty texts match nothing; items with equal texts each match, those without an id are reported as one; rows that share a document id
give one result, the nearest passage.  The stage judges every row by itself, whether it
shares its id or has none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosweep.llm.frames import table, written

MAX_ERROR = 0.12
MIN_CHARS = 24
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, max_error: float) -> tuple[int, list[tuple[int, str]]]:
    """Error budget of an item, and its budget-plus-one pieces with their offsets."""
    k = math.floor(max_error * len(item))
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def stretches(k: int) -> list[list[tuple[int, int]]]:
    """For each of k + 1 pieces the nested stretches (first piece, budget) to verify, smallest first."""
    found: list[list[tuple[int, int]]] = [[] for _ in range(k + 1)]

    def halve(first: int, budget: int) -> None:
        if budget:
            left = (budget - 1) // 2
            halve(first, left)
            halve(first + left + 1, budget - 1 - left)
            for piece in range(first, first + budget + 1):
                found[piece].append((first, budget))

    halve(0, k)
    return found


def myers(masks: dict[str, int], m: int, text: str, skip: int = 0) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and where that ends.

    The pattern is the m characters after the first ``skip`` that the masks were made of.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0) >> skip & full
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < best:
            best, at = score, j + 1
    return best, at


def beside(item: str, bounds: list[int], piece: int, levels: list[tuple[int, int]]) -> tuple[int, int, list[str]]:
    """Where in the item the rest of a piece's smallest stretch may begin and end, and parts of it of which one is whole."""
    if not levels:
        return 0, 0, []
    first, b = levels[0]
    # the piece is one end of that stretch
    low, high = (bounds[piece + 1], bounds[first + b + 1]) if piece == first else (bounds[first], bounds[piece])
    cut = [low + (high - low) * i // (b + 1) for i in range(b + 2)]
    return low - b, high + b, [item[x:y] for x, y in zip(cut, cut[1:], strict=False)]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], max_error: float, min_chars: int, short: str = "phrases"):
        import ahocorasick

        if short not in ("anywhere", "phrases", "lines"):
            raise ValueError(f"unknown rule {short}")
        self.items, self.short, owners = {}, {}, {}
        for n, (item_id, text) in enumerate(items):
            if len(text) < min_chars:
                if short == "lines" or short == "phrases" and " " not in text:
                    self.short.setdefault(text, []).append(item_id)
                else:  # one piece without a budget
                    self.items[n] = (item_id, len(text), None, None)
                    owners.setdefault(text, []).append((n, 0, (0, 0, []), []))
                continue
            k, cut = pieces(text, max_error)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            bounds = [offset for offset, _ in cut] + [len(text)]
            self.items[n] = (item_id, len(text), k, masks)
            for i, ((offset, piece), levels) in enumerate(zip(cut, stretches(k), strict=True)):
                inner = [(bounds[a], bounds[a + b + 1] - bounds[a], b) for a, b in levels[:-1]]
                owners.setdefault(piece, []).append((n, offset, beside(text, bounds, i, levels), inner))
        self.automaton = ahocorasick.Automaton()
        for piece, owner in owners.items():
            self.automaton.add_word(piece, (len(piece), owner))
        if owners:
            self.automaton.make_automaton()
        self.some = bool(owners)

    def _lines(self, text: str) -> Iterator[tuple[int, int, int]]:
        end, seen = 0, set()
        for line in text.split("\n"):
            end += len(line) + 1
            line = normal(line)
            # one word makes a line by chance too: it has to be the whole text
            if line in self.short and line not in seen and (" " in line or line == normal(text)):
                seen.add(line)
                stop = len(normal(text[: end - 1]))
                yield from ((item_id, 0, stop) for item_id in self.short[line])

    def match(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item id, edits, end of the passage) of every item that the text holds."""
        if self.short:
            yield from self._lines(text or "")
        text = normal(text)
        if not text or not self.some:
            return
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, int] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for n, offset, (left, right, parts), inner in owners:
                item_id, m, k, masks = self.items[n]
                begin = end + 1 - size - offset
                if k is None:
                    if n not in best and not (text[max(0, begin - 1) : begin].isalnum() and text[begin].isalnum()) and not (text[end].isalnum() and text[end + 1 : end + 2].isalnum()):
                        best[n] = (0, end + 1)
                    continue
                # the same alignment by another piece, or nothing left to better
                if n in tried and begin == tried[n] or n in best and best[n][0] == 0:
                    continue
                if parts:
                    near = text[max(0, begin + left) : max(0, begin + right)]
                    if not any(part in near for part in parts):
                        continue
                if any(myers(masks, m_, text[max(0, begin + a - b) : begin + a + m_ + b], a)[0] > b for a, m_, b in inner):
                    continue
                tried[n] = begin
                low = max(0, begin - k)
                distance, stop = myers(masks, m, text[low : begin + m + k])
                if distance <= k and (n not in best or distance < best[n][0]):
                    best[n] = (distance, low + stop)
        for n, (distance, stop) in best.items():
            yield self.items[n][0], distance, stop


@functools.lru_cache(maxsize=1)
def _matcher(items: tuple, max_error: float, min_chars: int, short: str) -> Matcher:
    return Matcher(list(items), max_error, min_chars, short)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_error: float = MAX_ERROR,
    min_chars: int = MIN_CHARS,
    block_chars: int = BLOCK_CHARS,
    short: str = "phrases",
) -> DataFrame:
    """(doc_id, item_id, edits, passage_end) for each document and item that it holds within the budget."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, math.ceil(2 * total / block_chars)) if total > block_chars else 1
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {id_type}, item_id long, edits int, passage_end int"
    source = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text"))
    found = None
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(n_blocks)) == b).collect()
        own = tuple(sorted(((r["item_id"], s) for r in rows if (s := normal(r["t"]))), key=lambda i: (i[0] is None, i[0] or 0, i[1])))
        shared = spark.sparkContext.broadcast(own)

        def run(batches, shared=shared):
            matcher = _matcher(shared.value, max_error, min_chars, short)
            for batch in batches:
                ids, texts = batch.column("__id"), batch.column("__text")
                at, made = [], []
                for i, value in enumerate(texts):
                    for hit in matcher.match(value.as_py()):
                        at.append(i)
                        made.append(hit)
                columns = list(zip(*made, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                    names=[doc_id, "item_id", "edits", "passage_end"],
                )

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    # rows that share an id: the nearest passage of each item
    return (
        found.groupBy(doc_id, "item_id")
        .agg(F.min(F.struct("edits", "passage_end")).alias("best"))
        .select(doc_id, "item_id", "best.edits", "best.passage_end")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(F.col("text").cast("string")).cast("string"))
    hits = decontaminate(docs.select(key.alias("row"), "text"), table(spark, sf_dir, "benchmark"), "row")
    # written, so that the planner knows its size and sends it round only while it is small
    hits = written(hits.select(F.col("row").alias("__row")).distinct())
    return docs.withColumn("__row", key).join(hits, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
