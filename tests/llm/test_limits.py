"""What keeps the corpus operators within memory and time: caches that end, one try a level and window."""

import gc
import pickle
import sys
import weakref

import numpy as np

from geosweep.llm import blocks, substring_dedup
from geosweep.llm.sentencepiece_nbest import Lattice, segment


def test_a_worker_holds_no_former_lattice():
    lattice = Lattice([(b" a", 3, -1.0), (b"b", 4, -2.0), (b"ab", 5, -1.5)], list(range(10, 266)), -20.0)
    buf, starts = np.frombuffer(b" ab b", np.uint8), np.array([0, 5])
    want = segment(lattice, buf, starts, 2)
    sent = pickle.loads(pickle.dumps(lattice))
    got = segment(sent, buf, starts, 2)
    assert all(np.array_equal(x, y, equal_nan=True) for x, y in zip(want, got, strict=True))
    assert lattice.decode(want[0]) == b"ab b"
    # neither what was made for it nor a cache keeps it; its own tables are not sent along
    assert len(pickle.dumps(sent)) == len(pickle.dumps(lattice)) < 1 << 15
    gone = weakref.ref(sent)
    del sent
    gc.collect()
    assert gone() is None


def test_hashes_do_not_depend_on_the_piece(monkeypatch):
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 123, 5000).astype(np.uint8)
    edge = np.unique(rng.integers(0, 5000, 300))
    want = blocks.span_hashes(buf, edge[:-1], edge[1:], False)
    monkeypatch.setattr(blocks, "_PIECE", 16)
    assert np.array_equal(blocks.span_hashes(buf, edge[:-1], edge[1:], False), want)


def scanned(levels, at, window):
    """Anchors by trying every symbol of every level from the highest down."""
    found = []
    for a in at.tolist():
        for k in range(len(levels) - 1, -1, -1):
            _, _, lo, hi = levels[k]
            good = np.flatnonzero((lo >= a) & (hi < a + window))
            if len(good) or k == 0:
                found.append((k, int(good[0]) if len(good) else a))
                break
    return found


def texts():
    rng = np.random.default_rng(9)
    for letters, longest in ((2, 60), (5, 90), (1, 70), (1000, 200)):
        size = rng.integers(1, longest, 12)
        doc = np.repeat(np.arange(12), size)
        yield blocks.finish(rng.integers(0, letters, len(doc)).astype(np.uint64)), doc


def test_anchors_are_those_of_a_scan_in_one_try_a_level():
    for words, doc in texts():
        for window in (1, 5, 20):
            lines = 0

            def trace(frame, event, arg):
                nonlocal lines
                if frame.f_code is not substring_dedup.anchors.__code__:
                    return None
                lines += event == "line"
                return trace

            before = sys.gettrace()
            sys.settrace(trace)
            try:
                at, level, symbol, levels = substring_dedup.anchors(words, doc, window)
            finally:
                sys.settrace(before)
            assert list(zip(level.tolist(), symbol.tolist(), strict=True)) == scanned(levels, at, window)
            assert lines <= 12 * len(levels) + 12


def test_order_by_hash_is_that_of_all_columns():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        for values in (3, 1 << 60):
            hi, lo, at = rng.integers(0, values, n).astype(np.uint64), rng.integers(0, 3, n), rng.integers(0, 4, n)
            assert np.array_equal(substring_dedup._sorted_by(hi, lo, at), np.lexsort((at, lo, hi)))
