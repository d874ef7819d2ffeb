import random

import numpy as np
import pyarrow as pa

from geosweep.llm.blocks import Block, gram_digest, grams, pack, unpack
from geosweep.llm.substring_dedup import anchors

TEXTS = ["", None, "one", "  a\tb\n\nc  ", "é ü\x0bß", "a b a b", "\n", "word " * 50]


def test_words_match_a_plain_split():
    b = Block(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        words = [w for w in (text or "").replace("\x0b", " ").split()]
        assert b.n_words[i] == len(words)
    h = b.words()
    flat = [w for t in TEXTS for w in (t or "").split()]
    assert len(set(flat)) == len(np.unique(h))
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(0, len(flat), 7) for j in range(len(flat)))


def test_lower_case_folds_only_ascii():
    h = Block(pa.array(["ABC abc É é"])).words(lower=True)
    assert h[0] == h[1] and h[2] != h[3]


def test_joined_words_and_lines():
    b = Block(pa.array(["a  b\nc", "", "x y"]))
    assert b.joined_words(np.array([True, False, True, True, True])).to_pylist() == ["a c", "", "x y"]
    assert b.without_lines(np.array([True, False, False, False])).to_pylist() == ["c", "", "x y"]
    assert b.without_lines(np.array([True, True, False, True])).to_pylist() == ["", "", ""]


def test_grams_name_windows_by_content():
    h = Block(pa.array(["a b c d a b c d e"])).words()
    for n in (1, 2, 3, 4):
        g = grams(h, n)
        assert len(g) == 10 - n and (g[0] == g[4]) and len(np.unique(g)) == len(g) - max(0, 5 - n)
    assert gram_digest(h, 4)[0] == gram_digest(h, 4)[4]


def test_pack_round_trip():
    arrays = [np.arange(1000, dtype=np.uint64) * 977, np.zeros(0, np.uint32), np.array([True, False])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(5)
    for trial in range(30):
        vocabulary = rnd.choice([2, 3, 50])
        shared = [rnd.randrange(vocabulary) for _ in range(rnd.randint(20, 60))]
        texts = []
        for _ in range(3):
            around = [[rnd.randrange(vocabulary) for _ in range(rnd.randint(0, 30))] for _ in range(2)]
            texts.append(" ".join(f"w{x}" for x in around[0] + shared + around[1]))
        b = Block(pa.array(texts))
        at, level, symbol, levels = anchors(b.words(), b.word_doc, 20)
        windows = gram_digest(b.words(), 20)[at]
        seen = {}
        for w, a, k, s in zip(windows, at, level, symbol, strict=True):
            got = (int(k), int(levels[k][0][s]), int(levels[k][1][s] - a))
            assert seen.setdefault(w.tobytes(), got) == got
