"""The methods step by step against plain versions, and every query on empty tables and very long cells."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geosweep.llm import queries, quality_classifier, sentencepiece_nbest, substring_dedup, warc
from geosweep.llm.blocks import Block

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


# ---- recompression: content hashes against names given round by round


def named_by_rounds(name, doc, halves):
    """Symbols of each level with names from a dictionary of that round: pairs and runs get the next free number."""
    symbols = [(("word", int(w)), int(d), i, i + 1) for i, (w, d) in enumerate(zip(name, doc, strict=True))]
    levels = [symbols]
    for right in halves:
        paired, i = [], 0
        while i < len(symbols):
            s = symbols[i]
            t = symbols[i + 1] if i + 1 < len(symbols) else None
            if t and t[1] == s[1] and not right(s[0]) and right(t[0]):
                paired.append((("pair", s[0], t[0]), s[1], s[2], t[3], True))
                i += 2
            else:
                paired.append((*s, False))
                i += 1
        symbols, i = [], 0
        while i < len(paired):
            j = i + 1
            while j < len(paired) and not paired[i][4] and not paired[j][4] and paired[j][0] == paired[i][0] and paired[j][1] == paired[i][1]:
                j += 1
            symbols.append((paired[i][0] if j == i + 1 else ("run", paired[i][0], j - i), paired[i][1], paired[i][2], paired[j - 1][3]))
            i = j
        levels.append(symbols)
    return levels


def test_hash_names_are_the_names_of_global_rounds():
    rnd = random.Random(3)
    passage = [rnd.randrange(50) for _ in range(70)]
    docs = [[rnd.randrange(50) for _ in range(rnd.randint(0, 30))] + (passage if k % 2 else []) + [rnd.randrange(4)] * rnd.randint(0, 5) + [rnd.randrange(50) for _ in range(9)] for k in range(12)]
    words = np.random.default_rng(1).integers(1, 2**63, 50, dtype=np.uint64)
    name = words[np.concatenate(docs)]
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    levels = substring_dedup.recompress(name, doc)
    # the dictionary's symbols fall to the halves that their hash names fall to
    hashed: dict = {}

    def half(k):
        return lambda symbol: substring_dedup.finish(np.array([hashed[symbol]], np.uint64) ^ np.uint64(0x51ED270B7A3D * (k + 1)))[0] >> np.uint64(63) == 1

    plain = named_by_rounds(name, doc, [])
    for k, (names, start, *_) in enumerate(levels):
        assert [s[2] for s in plain[-1]] == start.tolist(), k
        for symbol, own in zip(plain[-1], names.tolist(), strict=True):
            assert hashed.setdefault(symbol[0], own) == own  # equal symbols, equal names
        assert len(set(hashed.values())) == len(hashed)  # different symbols, different names
        if k + 1 < len(levels):
            plain.append(named_by_rounds(name, doc, [half(j) for j in range(k + 1)])[-1])
    # symbols above single words reveal the shared passage beyond one window
    top = [s for level in plain[3:] for s in level]
    seen = defaultdict(set)
    for content, d, a, b in top:
        seen[content].add((d, b - a))
    assert max(size for places in seen.values() if len({d for d, _ in places}) > 1 for _, size in places) > 4
    shared = Counter()
    for content, d, a, b in plain[2]:
        shared[d] += (b - a) if len({x for x, _ in seen.get(content, ())} | {e for c, e, *_ in plain[2] if c == content}) > 1 else 0
    assert all(shared[d] > 40 for d in range(1, 12, 2))


# ---- gradient boosting


def plain_boosting(x, y, trees, depth, bins, rate, ridge):
    """Margins of all rows after boosting with loops over rows, features and cuts."""
    base = math.log(np.mean(y) / (1 - np.mean(y)))
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))) for j in range(x.shape[1])]
    margin = [base] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [max(b * (1 - b), 1e-9) for b in p]
        groups = [list(range(len(y)))]
        for _ in range(depth):
            after = []
            for rows in groups:
                best, chosen = 1e-9, None
                for j in range(x.shape[1]):
                    top, where = -math.inf, None
                    for c in cuts[j]:
                        left = [i for i in rows if x[i, j] <= c]
                        lg, lh, ag, ah = sum(g[i] for i in left), sum(h[i] for i in left), sum(g[i] for i in rows), sum(h[i] for i in rows)
                        gain = lg**2 / (lh + ridge) + (ag - lg) ** 2 / (ah - lh + ridge) - ag**2 / (ah + ridge)
                        if gain > top + 1e-12:
                            top, where = gain, (j, c)
                    if top > best + 1e-12:
                        best, chosen = top, where
                after += [rows, []] if chosen is None else [[i for i in rows if x[i, chosen[0]] <= chosen[1]], [i for i in rows if x[i, chosen[0]] > chosen[1]]]
            groups = after
        for rows in groups:
            for i in rows:
                margin[i] += rate * sum(g[k] for k in rows) / (sum(h[k] for k in rows) + ridge)
    return np.array(margin)


def test_boosting_against_plain_loops():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(60, 4)), 2)
    x[:, 3] = rng.integers(0, 3, 60)
    y = (x[:, 0] + x[:, 3] + rng.normal(size=60) / 2 > 1).astype(float)
    forest = quality_classifier.fit(x, y, trees=4, depth=3, bins=8)
    assert np.allclose(forest.score(x), 1 / (1 + np.exp(-plain_boosting(x, y, 4, 3, 8, 0.15, 1.0))), atol=1e-9)
    # the flattened arrays walk as single rows do
    for row in x[:20]:
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-total)))


# ---- segmentation on both sides of the length from which chunks are taken one by one


def test_segmentation_is_the_same_for_short_and_long_chunks():
    lattice = sentencepiece_nbest.Lattice.load(sentencepiece_nbest.MODEL)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("etaoinshrdlu") for _ in range(n)) for n in (*range(42, 56), 90)] + ["", " ", "zürich straße " * 3, "ß" * 30]
    block = Block(pa.array(texts, pa.string()))
    made = sentencepiece_nbest.encode_block(lattice, block, 3, ["ids", "score"])
    ids = pa.array(made["ids"]).to_pylist() if not isinstance(made["ids"], list) else made["ids"]
    for text, own, score in zip(texts, ids, list(made["score"]), strict=True):
        best, path = lattice.nbest((" " + text).encode(), 1)[0]
        assert math.isclose(float(score), best, rel_tol=1e-6, abs_tol=1e-4)
        total = sum(lattice.ids[lattice.bytes_of[i]][1] if i not in lattice.byte_ids else lattice.penalty for i in own)
        assert math.isclose(total, sum(lattice.ids[lattice.bytes_of[i]][1] if i not in lattice.byte_ids else lattice.penalty for i in path), rel_tol=1e-6)
        assert lattice.decode(list(own)) == text.encode()


# ---- empty tables, long payloads, repeated ids


def written(spark, tmp_path, **rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, tmp_path, name):
    assert queries.queries()[name](spark, written(spark, tmp_path)).collect() == []


def test_payload_of_several_chunks(spark, tmp_path):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdé\n") for _ in range(2_500_000))
    pages = [(5, "http://a/", long), (3, "http://a/", long), (9, None, long[:-1]), (None, "http://b/", "x" * 99), (4, "http://c/", None)]
    got = {r["page_id"]: r for r in warc.query(spark, written(spark, tmp_path, pages=pages)).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert (got[5]["record_type"], got[5]["refers_to"], got[3]["record_type"], got[9]["record_type"]) == ("revisit", 3, "response", "response")


def test_pipeline_with_repeated_ids_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(4)
    prose = lambda k: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(k)) + "."
    one, two = prose(80), prose(90)
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (None, prose(70), "en", "s", 1), (7, one, "en", "s", 1), (8, "", None, None, None), (9, None, None, None, None)]
    sf = written(spark, tmp_path, documents=rows, benchmark=[(1, "an item that no document of this corpus holds, at some length")])
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 2, None: 1}
    more = spark.read.parquet(f"{sf}/documents.parquet").select("*", *(F.lit(1).alias(c) for c in ("kept", "component_id", "ids", "row", "group")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        more = stage(spark, more, sf)
        assert {"kept", "component_id", "ids", "row", "group"} <= set(more.columns)
    assert more.count() == 3
