"""SentencePiece encoding with exact N-best segmentation, and decoding.

The lattice lies over the UTF-8 bytes of the text with one space put before it; a piece
is an edge with the model's score, and every byte is also an edge to its byte piece at a
penalty below all pieces, so each text has a segmentation and decoding gives the text
back byte for byte (a literal U+2581 too, which goes by bytes).

No piece spans two neighbouring bytes that stand side by side in no piece, so texts fall
apart there into chunks that can be segmented by themselves.  For all distinct chunks of
a block at once, numpy runs the Viterbi recursion forward and backward; the two together
give each chunk's best score and the loss of its second best.  The N best segmentations of
a text can only deviate in the N - 1 chunks of least loss: on these a backward A-star
search runs, to which the forward Viterbi scores are an exact heuristic, so that
hypotheses leave its queue in order of score.

Edge cases: null text encodes as empty text, to a single space piece; a chunk longer than
``LONG`` bytes takes a plain Viterbi loop instead of the vectorised one, with equal
scores; ties go to the longer last piece.  Input columns named like the operator's give way.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosweep.llm.blocks import Block, finish, span_hashes
from geosweep.llm.frames import map_blocks, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
LONG = 48
_RATIO = 0x9E3779B97F4A7C15 | 1


class Lattice:
    """Pieces of a model as byte strings with scores; picklable, of the model's fixed size.

    What is derived from them is made where it is used and goes with the lattice, so that a
    worker that lives on holds nothing of the models it has had before.
    """

    def __init__(self, pieces: list[tuple[bytes, int, float]], byte_ids: list[int], penalty: float):
        self.pieces, self.byte_ids, self.penalty = pieces, byte_ids, penalty
        self.longest = max((len(p) for p, _, _ in pieces), default=1)

    def __reduce__(self):
        return Lattice, (self.pieces, self.byte_ids, self.penalty)

    @functools.cached_property
    def ids(self) -> dict[bytes, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.pieces}

    @functools.cached_property
    def bytes_of(self) -> dict[int, bytes]:
        return {i: p for p, i, _ in self.pieces} | {b: bytes([n]) for n, b in enumerate(self.byte_ids)}

    @classmethod
    def load(cls, path: str) -> Lattice:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append((piece.replace("▁", " ").encode(), i, float(sp.get_score(i))))
        # pieces that a model all but forbids do not set the price of bytes
        return cls(pieces, byte_ids, min(s for _, _, s in pieces if s > -1e8) - 10.0)

    def decode(self, ids) -> bytes:
        """Bytes of the text that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]

    def edges(self, chunk: bytes):
        """For each end, the (start, id, score) of the edges that end there."""
        out = [[] for _ in range(len(chunk) + 1)]
        for start in range(len(chunk)):
            out[start + 1].append((start, self.byte_ids[chunk[start]], self.penalty))
            for size in range(1, min(self.longest, len(chunk) - start) + 1):
                if hit := self.ids.get(chunk[start : start + size]):
                    out[start + size].append((start, *hit))
        return out

    @staticmethod
    def forward(edges) -> list[float]:
        best = [0.0]
        for ending in edges[1:]:
            best.append(max(best[start] + score for start, _, score in ending))
        return best

    def nbest(self, chunk: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, by A-star from the end with forward scores as heuristic."""
        edges = self.edges(chunk)
        ahead = self.forward(edges)
        queue, ticket, out = [(-ahead[-1], 0, 0, len(chunk), 0.0, None)], 0, []
        while queue and len(out) < n:
            *_, at, behind, path = heapq.heappop(queue)
            if not at:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            for start, piece, score in edges[at]:
                ticket += 1  # among equals first what is nearest to the start, so that ties do not fan out
                heapq.heappush(queue, (-(ahead[start] + score + behind), start, ticket, start, score + behind, (piece, path)))
        return out


def _made_tables(lattice: Lattice):
    """Byte pairs within pieces; and a filter and sorted table of piece hashes."""
    inner = np.zeros((256, 256), bool)
    for p, _, _ in lattice.pieces:
        b = np.frombuffer(p, np.uint8)
        inner[b[:-1], b[1:]] = True
    keys = _piece_hashes([p for p, _, _ in lattice.pieces])
    order = np.argsort(keys)
    keys = keys[order]
    if (keys[1:] == keys[:-1]).any():
        raise ValueError("two pieces share a hash")
    maybe = np.zeros(1 << 20, bool)
    maybe[keys >> np.uint64(44)] = True
    step = np.cumprod(np.append(np.uint64(1), np.full(LONG, _RATIO, np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(LONG, pow(_RATIO, -1, 1 << 64), np.uint64)))
    return inner, keys, np.array([i for _, i, _ in lattice.pieces])[order], np.array([s for _, _, s in lattice.pieces])[order], maybe, step, back


def _tables(lattice: Lattice):
    """The lattice's tables, kept with it: a cache of its own would hold every lattice that a worker has ever had."""
    if "tables" not in vars(lattice):
        lattice.tables = _made_tables(lattice)
    return lattice.tables


@functools.cache
def _letters() -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)


def _piece_hashes(pieces: list[bytes]) -> np.ndarray:
    """Hash of each piece, all of one length at once."""
    out, size = np.zeros(len(pieces), np.uint64), np.array([len(p) for p in pieces], np.int64)
    for length in np.unique(size):
        mine = np.flatnonzero(size == length)
        chars = np.frombuffer(b"".join(pieces[i] for i in mine), np.uint8).reshape(len(mine), length)
        step = np.array([pow(_RATIO, i, 1 << 64) for i in range(length)], np.uint64)
        out[mine] = finish((_letters()[chars] * step).sum(axis=1, dtype=np.uint64) ^ np.uint64(length))
    return out


def viterbi(lattice: Lattice, chunks: np.ndarray, size: np.ndarray):
    """Best segmentation of many short chunks, the rows of a byte matrix.

    Best score, loss of the second best (inf without one), and per row, from the end, the
    ids of the best pieces (padded with -1).
    """
    _, keys, ids, scores, maybe, step, back = _tables(lattice)
    n, width = chunks.shape
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum(_letters()[chunks] * step[:width], axis=1, out=sums[:, 1:])
    most = min(lattice.longest, width)
    edge = {}  # by piece length: rows, starts, piece
    for length in range(1, most + 1):
        h = (sums[:, length:] - sums[:, :-length]) * back[: width + 1 - length]
        h = finish(h ^ np.uint64(length))
        row, start = np.nonzero(maybe[h >> np.uint64(44)])
        inside = start + length <= size[row]
        row, start = row[inside], start[inside]
        h = h[row, start]
        k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        real = keys[k] == h
        matrix = np.full((n, width + 1 - length), -np.inf)
        matrix[row[real], start[real]] = scores[k[real]]
        which = np.full((n, width + 1 - length), -1, np.int32)
        which[row[real], start[real]] = ids[k[real]]
        edge[length] = (matrix, which)
    ahead = np.full((n, width + 1), -np.inf)
    ahead[:, 0] = 0
    took = np.zeros((n, width + 1), np.int8)  # 0: the byte piece
    for end in range(1, width + 1):
        best = ahead[:, end - 1] + lattice.penalty
        for length in range(1, min(most, end) + 1):
            value = ahead[:, end - length] + edge[length][0][:, end - length]
            better = value >= best
            took[better & (value > -np.inf), end] = length
            best = np.where(better, value, best)
        ahead[:, end] = best
    rows = np.arange(n)
    total = ahead[rows, size]
    behind = np.full((n, width + 1), -np.inf)
    behind[rows, size] = 0
    for start in range(width - 1, -1, -1):
        best = behind[:, start + 1] + lattice.penalty
        for length in range(1, min(most, width - start) + 1):
            best = np.maximum(best, behind[:, start + length] + edge[length][0][:, start])
        behind[:, start] = np.where(start < size, best, behind[:, start])
    # walk back along the best path, taking its edges out of the search for the second best
    at, path, bytes_used = size.copy(), [], np.zeros((n, width), bool)
    byte_ids = np.array(lattice.byte_ids, np.int32)
    used = {length: np.zeros(m.shape, bool) for length, (m, _) in edge.items()}
    while (at > 0).any():
        live = np.flatnonzero(at > 0)
        length = took[live, at[live]].astype(np.int64)
        start = at[live] - np.maximum(length, 1)
        piece = np.full(n, -1, np.int32)
        byte = length == 0
        piece[live[byte]] = byte_ids[chunks[live[byte], start[byte]]]
        bytes_used[live[byte], start[byte]] = True
        for size_ in np.unique(length[~byte]):
            mine = length == size_
            piece[live[mine]] = edge[size_][1][live[mine], start[mine]]
            used[size_][live[mine], start[mine]] = True
        path.append(piece)
        at[live] = start
    second = np.full(n, -np.inf)
    for length, (m, _) in edge.items():
        value = np.where(used[length], -np.inf, ahead[:, : width + 1 - length] + m + behind[:, length:])
        second = np.maximum(second, value.max(axis=1, initial=-np.inf))
    value = np.where(bytes_used, -np.inf, ahead[:, :-1] + lattice.penalty + behind[:, 1:])
    second = np.maximum(second, value.max(axis=1, initial=-np.inf))
    return total, total - second, np.array(path, np.int32).T.reshape(n, -1)


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """First span of each distinct content, and which distinct content each span has."""
    h = span_hashes(buf, start, end, False)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return first, back


def _deviating(ids: np.ndarray, start: int, end: int, changes: list) -> np.ndarray:
    """ids[start:end] with the ids of some chunks, (from, to, new ids) in order, exchanged."""
    parts, at = [], start
    for a, b, new in changes:
        parts += [ids[at:a], np.array(new, np.int32)]
        at = b
    return np.concatenate([*parts, ids[at:end]]).astype(np.int32)


def segment(lattice: Lattice, buf: np.ndarray, starts: np.ndarray, nbest: int, others: list | None = None):
    """Documents (spans of ``buf`` from each start to the next) to ids and n-best scores.

    Flat ids, their offsets per document, and a (documents x nbest) array of scores with
    nan where a text has fewer segmentations.  ``others`` takes, per document, the ids of the
    segmentations after the best.
    """
    inner = _tables(lattice)[0]
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:-1] = ~inner[buf[:-1], buf[1:]]
    cut[starts] = True
    edge = np.flatnonzero(cut)
    start, end = edge[edge < starts[-1]], edge[edge > 0]
    first, back = _distinct(buf, start, end)
    size = (end - start)[first]
    best, loss, counts = np.zeros(len(first)), np.full(len(first), np.inf), np.zeros(len(first), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(size, kind="stable")
    order_size = size[order]
    at = 0
    while at < len(order) and order_size[at] <= LONG:
        width = int(order_size[at])
        width = min(LONG, width + width // 4)
        to = min(int(np.searchsorted(order_size, width, "right")), at + max(256, 400_000 // (width * width)))
        mine = order[at:to]
        width = int(order_size[to - 1])
        index = start[first[mine]][:, None] + np.arange(width)
        chunk = np.where(np.arange(width) < size[mine][:, None], buf[np.minimum(index, len(buf) - 1)], 0).astype(np.uint8)
        best[mine], loss[mine], path = viterbi(lattice, chunk, size[mine])
        path = path[:, ::-1]
        counts[mine] = (path >= 0).sum(axis=1)
        found.append((mine, path[path >= 0]))
        at = to
    again: dict[int, list] = {}

    def hypotheses(u: int):
        if u not in again:
            again[u] = lattice.nbest(buf[start[first[u]] : end[first[u]]].tobytes(), nbest)
        return again[u]

    for u in order[at:].tolist():
        top = hypotheses(u)
        best[u], counts[u] = top[0][0], len(top[0][1])
        loss[u] = top[0][0] - top[1][0] if len(top) > 1 else np.inf
        found.append((np.array([u]), np.array(top[0][1], np.int32)))
    # ids of distinct chunks in one array, then of all chunks in text order
    owner = np.concatenate([m for m, _ in found]) if found else order
    flat = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int32)
    place = np.zeros(len(first), np.int64)
    place[owner] = np.concatenate([[0], np.cumsum(counts[owner])])[:-1]
    n = counts[back]
    ends = np.cumsum(n)
    ids = flat[np.repeat(place[back] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    chunk_of = np.searchsorted(start, starts)
    offsets = np.concatenate([[0], ends])[chunk_of]
    # n best of each text: its best, with deviations in the chunks of least loss
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(chunk_of))
    scores = np.full((len(starts) - 1, nbest), np.nan)
    scores[:, 0] = np.bincount(doc, weights=best[back], minlength=len(starts) - 1)
    if nbest > 1:
        rank = np.lexsort((loss[back], doc))
        nth = np.arange(len(rank)) - chunk_of[doc[rank]]
        rank = rank[(nth < nbest - 1) & np.isfinite(loss[back][rank])]
        groups = np.searchsorted(doc[rank], np.arange(len(starts)))
        for d in range(len(starts) - 1):
            # a hypothesis is its loss and the chunks in which it deviates, each with the rank taken there
            best_of = [(0.0, ())]
            for c in rank[groups[d] : groups[d + 1]].tolist():
                top = hypotheses(int(back[c]))
                step = ((x + top[0][0] - s, (*taken, (c, r)) if r else taken) for x, taken in best_of for r, (s, _) in enumerate(top))
                best_of = heapq.nsmallest(nbest, step)
            scores[d, : len(best_of)] = scores[d, 0] - np.array([x for x, _ in best_of])
            if others is not None:
                others.append([_deviating(ids, int(offsets[d]), int(offsets[d + 1]), [(int(ends[c] - n[c]), int(ends[c]), hypotheses(int(back[c]))[r][1]) for c, r in sorted(taken)]) for _, taken in best_of[1:]])
    return ids, offsets, scores


FIELDS = {
    "n_bytes": T.LongType(), "n_pieces": T.LongType(), "score": T.DoubleType(), "nbest_scores": T.ArrayType(T.DoubleType()),
    "ids": T.ArrayType(T.IntegerType()), "nbest_ids": T.ArrayType(T.ArrayType(T.IntegerType())), "nbest_sha256": T.ArrayType(T.StringType()), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "round_trip": T.BooleanType(),
}
DIGESTS = ["n_bytes", "n_pieces", "score", "nbest_scores", "nbest_sha256", "ids_sha256", "decoded_sha256", "round_trip"]


def _bytes_of(lattice: Lattice):
    """All pieces in one byte array with offsets by id, for decoding in bulk."""
    top = max(lattice.bytes_of) + 1
    parts = [lattice.bytes_of.get(i, b"") for i in range(top)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), at


def encode_block(lattice: Lattice, block: Block, nbest: int, want: list[str]) -> dict[str, object]:
    # the newline that ends each document in a block becomes the space before the next one
    buf = np.empty(len(block.buf), np.uint8)
    buf[1:] = block.buf[:-1]
    buf[block.offsets[:-1]] = 0x20
    listed = {"nbest_ids", "nbest_sha256"} & set(want)
    others: list | None = [] if listed else None
    ids, offsets, scores = segment(lattice, buf, block.offsets, nbest, others)
    out: dict[str, object] = {"n_bytes": np.diff(block.offsets) - 1, "n_pieces": np.diff(offsets), "score": scores[:, 0]}
    have = ~np.isnan(scores)
    out["nbest_scores"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(have.sum(axis=1))]), pa.int32()), pa.array(scores[have]))
    if "ids" in want:
        out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
    if listed:
        every = [[ids[a:b].astype(np.int32), *(others[d] if others else ())] for d, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False))]
        if "nbest_ids" in want:
            flat = [x for doc in every for x in doc]
            inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.int32)])))
            out["nbest_ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)]), pa.int32()), inner)
        if "nbest_sha256" in want:
            out["nbest_sha256"] = [[hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in doc] for doc in every]
    if "ids_sha256" in want:
        data = memoryview(ids.astype("<i4").tobytes())
        out["ids_sha256"] = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]
    if {"decoded_sha256", "round_trip"} & set(want):
        flat, at = _bytes_of(lattice)
        n = np.diff(at)[ids]
        ends = np.cumsum(n)
        decoded = flat[np.repeat(at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        to = np.concatenate([[0], ends])[offsets]
        data, same = memoryview(decoded.tobytes()), memoryview(buf.tobytes())
        spans = list(zip(to, to[1:], strict=False))
        out["decoded_sha256"] = [hashlib.sha256(data[a + 1 : b]).hexdigest() for a, b in spans]
        out["round_trip"] = [data[a:b] == same[c:d] for (a, b), c, d in zip(spans, block.offsets, block.offsets[1:], strict=False)]
    return out


def encode(docs: DataFrame, want: list[str], keep: list[str] | None = None, text: str = "text", model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """Columns of ``want`` (see FIELDS) for each document; the model is read once, on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(Lattice.load(model))  # as large as the model file, whatever the data
    schema = T.StructType([T.StructField(c, FIELDS[c]) for c in want])
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    return map_blocks(docs, lambda _, block: encode_block(shared.value, block, nbest, want), schema, keep, text)


def decode(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with the text of their ids added as decoded_text."""
    shared = rows.sparkSession.sparkContext.broadcast(Lattice.load(model))

    @F.pandas_udf("string")
    def text(column):
        return column.map(lambda x: None if x is None else shared.value.decode(x).decode("utf-8", "replace"))

    return rows.withColumn("decoded_text", text(F.col(ids)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training rows: ids of each document's text, with score and round-trip check."""
    return encode(docs, ["n_pieces", "score", "nbest_scores", "ids", "round_trip"], ["doc_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), DIGESTS, ["doc_id"])
