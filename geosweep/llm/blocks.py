"""Vectorised text blocks shared by the corpus operators.

A block is a run of whole documents held as one UTF-8 byte array in which every
document ends with a newline that is not part of it.  Words (maximal runs of bytes
outside 0x20 and 0x09-0x0D) and lines are found with numpy on that array, and each
gets a 64-bit content hash, so an equal word has an equal hash on every executor.

Hashes are polynomial sums over a random byte table modulo 2**64 with a final
bijective mix.  Operators that decide on equality across the corpus widen them to
96 bits or more; see ``gram_digest``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PIECE = 1 << 17
#: Bytes of text handled at once; bounds the numpy temporaries of a Python worker.
BLOCK_BYTES = 1 << 20


@functools.cache
def _byte_table(lower: bool, lane: int = 0) -> np.ndarray:
    table = np.random.default_rng(20240229 + lane).integers(1, 2**64, size=256, dtype=U64, endpoint=False)
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


_RATIO = 0xD1342543DE82EF95  # odd, 5 modulo 8, hence invertible modulo 2**64


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(size, _RATIO, dtype=U64)
    back = np.full(size, pow(_RATIO, -1, 1 << 64), dtype=U64)
    step[0] = back[0] = 1
    return np.cumprod(step), np.cumprod(back)


def finish(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def pair(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """Ordered combination of two hash arrays; lanes are independent."""
    k = U64((0x9E3779B97F4A7C15 + 2 * lane * 0xA24BAED4963EE407) & (2**64 - 1) | 1)
    return finish(finish(a + U64((lane * 0x632BE59BD9B4E019 + 1) & (2**64 - 1))) * k + b)


def grams(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of every window of n items, built by doubling in log n steps."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    have, width, level, size = None, 0, h, 1
    while n:
        if n & 1:
            if have is None:
                have, width = level, size
            else:
                m = min(len(level), len(have) - size)
                have, width = pair(level[:m], have[size : size + m], lane), width + size
        n >>= 1
        if n:
            level, size = pair(level[:-size], level[size:], lane), 2 * size
    return have


def gram_digest(h: np.ndarray, n: int) -> np.ndarray:
    """96-bit digests of all windows of n items as a structured (hi, lo) array."""
    hi, lo = grams(h, n, 0), grams(h, n, 1)
    out = np.empty(len(hi), dtype=[("hi", "<u8"), ("lo", "<u4")])
    out["hi"], out["lo"] = hi, (lo >> U64(32)).astype(np.uint32)
    return out


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool, lane: int = 0) -> np.ndarray:
    """Content hash of each byte span; spans are in order and do not overlap."""
    out = np.zeros(len(start), dtype=U64)
    table, at = _byte_table(lower, lane), 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + _PIECE, "right")))
        piece = buf[base : int(end[to - 1])]
        size = _PIECE
        while size < len(piece):
            size *= 2
        up, down = _powers(size)
        sums = np.zeros(len(piece) + 1, dtype=U64)
        np.cumsum(table[piece] * up[: len(piece)], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        h = (sums[e] - sums[s]) * down[np.minimum(s, size - 1)]
        out[at:to] = finish(h + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15))
        at = to
    return out


class Block:
    """Documents as bytes, with their words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        nothing, end = pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary())
        joined = pc.binary_join_element_wise(texts, nothing, end)
        if isinstance(joined, pa.ChunkedArray):
            joined = joined.combine_chunks()
        self.n_docs = len(joined)
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)
        self.offsets = offsets[joined.offset : joined.offset + self.n_docs + 1]
        data = joined.buffers()[2]
        self.buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = self.buf[: int(self.offsets[-1])] if self.n_docs else self.buf[:0]

    @functools.cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~_SPACE[self.buf]
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            turn = np.concatenate([[0], turn])
        return turn[0::2], turn[1::2]

    @property
    def start(self) -> np.ndarray:
        return self._edges[0]

    @property
    def end(self) -> np.ndarray:
        return self._edges[1]

    @functools.cached_property
    def first_word(self) -> np.ndarray:
        """Index of each document's first word, and the number of words at the end."""
        return np.searchsorted(self.start, self.offsets)

    @functools.cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @functools.cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def words(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, lower)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte quantity over each document (without its final newline)."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:] - 1] - sums[self.offsets[:-1]] if self.n_docs else sums[:0]

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1] - 1].tobytes()

    @functools.cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (at its newline) and document of every line; an empty text has one."""
        end = np.flatnonzero(self.buf == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        return start, end, np.searchsorted(self.offsets[1:], end, "right")

    def without_lines(self, drop: np.ndarray) -> pa.Array:
        """Text of each document with the dropped lines gone and the others joined by newlines."""
        start, end, _ = self.lines
        keep = np.repeat(~drop, end - start + 1)
        kept = np.concatenate([[0], np.cumsum(keep)])[self.offsets]
        where = np.flatnonzero(keep)
        keep[where[kept[1:][kept[1:] > kept[:-1]] - 1]] = False
        size = np.maximum(np.diff(kept) - 1, 0)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.StringArray.from_buffers(self.n_docs, pa.py_buffer(at), pa.py_buffer(self.buf[keep]))

    def joined_words(self, keep: np.ndarray) -> pa.Array:
        """Text of each document from its kept words, joined by one space."""
        start, end, doc = self.start[keep], self.end[keep], self.word_doc[keep]
        # each kept word takes the byte that follows it along, turned into a space
        mark = np.zeros(len(self.buf) + 1, dtype=np.int8)
        mark[start] += 1
        mark[end + 1] -= 1
        out = self.buf[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
        to = np.concatenate([[0], np.cumsum(end - start + 1)])
        out[to[1:] - 1] = 0x20
        at = to[np.searchsorted(doc, np.arange(self.n_docs + 1))]
        some = at[1:] > at[:-1]
        drop = np.zeros(len(out), bool)
        drop[at[1:][some] - 1] = True
        at[1:] -= np.cumsum(some)
        return pa.StringArray.from_buffers(self.n_docs, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out[~drop]))


def blocks(batches, limit: int = BLOCK_BYTES, text: str = "text") -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of Arrow batches of about ``limit`` bytes of text, each with its block."""
    for batch in batches:
        column = batch.column(text)
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // limit, prepend=0)) if len(size) else []
        edges = [0, *[int(c) for c in cut if c], len(size)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, Block(part.column(text))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: byte planes apart, so that high zero bytes vanish."""
    import zstandard

    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((a.dtype.itemsize, 0), np.uint8)
        parts.append(a.dtype.str.encode() + b" " + str(len(a)).encode() + b"\n" + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(raw):
        stop = raw.index(b"\n", at)
        kind, n = raw[at:stop].split()
        dtype, n = np.dtype(kind.decode()), int(n)
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, stop + 1).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at = stop + 1 + n * dtype.itemsize
    return out
