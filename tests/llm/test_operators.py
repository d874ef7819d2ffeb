"""Corpus operators against brute force on small fixtures with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geosweep.llm import decontaminate, frames, jaccard_join, line_dedup, lm_scoring, quality_classifier, quality_rules, sentencepiece_nbest, substring_dedup, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "Ro", "mé", "li") for b in ("n", "ve", "sk", "o")]
    passage = " ".join(rnd.choice(words) for _ in range(45))
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(0, 6))]
        if i % 5 == 0:
            lines.insert(rnd.randint(0, len(lines)), passage)
        if i % 4 == 0:
            lines.append("  A line that many documents share.  ")
        if i % 7 == 3 and rows:
            lines = (rows[-1][1] or "").split("\n")
            if i % 2:
                lines = [" ".join(lines[0].split()[:-1] + ["changed"])] + lines[1:]
        rows.append((i, "\n".join(lines)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "one two"), (n + 4, "the " * 70), (n + 5, "the " * 60), (None, "lonely text"), (n + 6, rows[0][1]), (n + 6, rows[0][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in corpus()], "doc_id long, text string, n_words string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def key(row):
    return (row[0] is None, row)


def test_substring_dedup(spark, docs):
    rows = sorted(corpus(), key=lambda r: (r[0] is None, r[0] or 0))
    seen, want = set(), []
    for i, text in rows:
        w, gone = WORD.findall(text or ""), set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[2])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_line_dedup(spark, docs):
    strip = "".join(map(chr, (32, 9, 10, 11, 12, 13)))
    norm = lambda line: line.strip(strip).translate(FOLD)
    owners = {}
    for i, text in corpus():
        for line in (text or "").split("\n"):
            if len(norm(line)) >= 20 and i is not None:
                owners.setdefault(norm(line), set()).add(i)
    hot = {k: max(v) for k, v in owners.items() if len(v) >= 3}
    want = []
    for i, text in corpus():
        lines = (text or "").split("\n")
        kept = [x for x in lines if norm(x) not in hot or hot[norm(x)] == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "n_words", "n_lines", "n_dropped", "kept_text"]
    got = [tuple(r) for r in out.drop("n_words").collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and hot
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def brute_links(rows, n, num, den):
    """Set size and component number of every row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [len(x) for x in sets], label


def family(seed=3):
    """Near copies whose members need not link to each other; some ids are repeated, some missing."""
    rnd, base = random.Random(seed), [f"w{k}" for k in range(120)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(1000)}"
        rows.append((None if i % 13 == 5 else 500 + i // 2 if i % 5 == 0 else 600 + i, " ".join(copy)))
    for i in range(30):  # more than FEW that share a variant of the base but need not link to it
        copy = base[:70] + [f"z{k}" for k in range(50)]
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = f"y{rnd.randrange(1000)}"
        rows.append((2000 + i, " ".join(copy)))
    other = [f"v{k}" for k in range(60)]
    apart = [f"u{k}" for k in range(60)]
    lonely = [f"t{k}" for k in range(60)]
    rows += [(1000, " ".join(other)), (1000, " ".join(apart)), (1001, " ".join([*other, "more"])), (1002, " ".join([*apart, "more"])), (1002, " ".join([*apart, "more"]))]
    return [*rows, (None, " ".join(lonely)), (None, " ".join([*lonely, "end"])), (None, None), (7000, "  "), (7000, "  ")]


@pytest.mark.parametrize("args", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join(spark, args):
    rows = corpus(1, 40) + family()
    sizes, label = brute_links(rows, *args)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, size int, cls string")
    want = sorted(((i, n, least.get(c)) for (i, _), n, c in zip(rows, sizes, label, strict=True)), key=str)
    for shuffled in (df.repartition(1), df.repartition(5, "text")):
        got = [tuple(r) for r in jaccard_join.jaccard_join(shuffled, jaccard_join.Rule(*args)).collect()]
        assert sorted(got, key=str) == want
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_jaccard_stage_keeps_one_row_of_each_group(spark):
    rows = corpus(1, 40) + family()
    sizes, label = brute_links(rows, 5, 4, 5)
    groups, want = {}, []
    for (i, t), n, c in zip(rows, sizes, label, strict=True):
        if n:
            groups.setdefault(c, []).append((i, t))
        else:
            want.append((i, t))
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, h int, none string, place string").repartition(4)
    out = jaccard_join.stage(spark, df, "")
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    for row in want:
        got.remove(row)
    left = {label[rows.index(r)]: r for r in got}
    assert len(got) == len(left) == len(groups)
    for c, (i, t) in left.items():
        ids = [j for j, _ in groups[c] if j is not None]
        assert (i, t) in groups[c] and i == (min(ids) if ids else None)
    assert jaccard_join.stage(spark, df.limit(0), "").count() == 0


def starred(spark, sets, rule):
    """Hub 0 with all other sets as its members, and the sets; those that link to the hub are of its component."""
    from geosweep.llm.blocks import pack

    df = spark.createDataFrame([(i, bytearray(pack(np.sort(np.array(sorted(s), np.uint64))))) for i, s in enumerate(sets)], "cls long, items binary")
    pairs = spark.createDataFrame([(0, i, True, 0) for i in range(1, len(sets))], "u long, v long, many boolean, score long")
    stars = jaccard_join.verify(pairs, df, rule)
    return stars.withColumn("component", F.when(F.col("linked"), F.lit(0)).otherwise(F.col("v"))), df


def test_members_without_a_partner_leave_no_rows(spark, monkeypatch):
    """A passage shared by many that do not link costs nothing behind the deviations, and the pair that links is found among them."""
    kept, tables = jaccard_join.written, []

    def counted(df):
        made = kept(df)
        tables.append((made.columns, made.count()))
        return made

    monkeypatch.setattr(jaccard_join, "written", counted)
    rule, many, found = jaccard_join.Rule(5, 4, 5), range(77), []
    for members in (20, 60):
        sets = [{*many, *range(100, 123)}] + [{*many, *range(1000 * i, 1000 * i + 23)} for i in range(1, members)]
        sets += [{*many, *range(200, 223)}, {*many, *range(200, 220), *range(300, 303)}]
        tables.clear()
        links = jaccard_join.deviating(*starred(spark, sets, rule), rule).collect()
        assert {tuple(sorted(r)) for r in links} == {(members, members + 1)}
        found.append(sum(n for columns, n in tables if "top" in columns))
    assert found[0] == found[1] < 100


@pytest.mark.parametrize("few", [2, 16])
def test_deviations_connect_what_links(spark, monkeypatch, few):
    """Links between members of a hub, of components of their own so far, connect all that brute force connects."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng, rule = np.random.default_rng(few), jaccard_join.Rule(5, 4, 5)
    for trial in range(3):
        passage, sets = list(range(60)), [{*range(60), *range(1000, 1040)}]
        for seed in range(6):
            base = [*passage, *range(2000 + 100 * seed, 2040 + 100 * seed)] if seed else sorted(sets[0])
            for copy in range(6):
                changed = rng.choice(100, rng.integers(0, 16), replace=False)
                sets.append({x for k, x in enumerate(base) if k not in changed} | {int(x) for x in rng.integers(5000 + 40 * seed, 5040 + 40 * seed, rng.integers(0, 12))})
        links = [tuple(r) for r in jaccard_join.deviating(*starred(spark, sets, rule), rule).collect()]
        linked = lambda a, b: rule.den * len(a & b) >= rule.num * len(a | b)  # noqa: E731, B023
        assert all(linked(sets[u], sets[v]) for u, v in links)
        every = [(u, v) for v in range(len(sets)) for u in range(v) if linked(sets[u], sets[v])]
        label = lambda edges: joined(len(sets), edges)  # noqa: E731, B023
        assert label(links + [(0, v) for u, v in every if u == 0]) == label(every) and links


@pytest.mark.parametrize("seed", range(3))
def test_members_of_a_hub_join_as_all_pairs_do(spark, monkeypatch, seed):
    """A hub that fits a task makes no row for each deviation, and its links connect what all pairs connect; so do those of a larger one."""
    rng, rule = np.random.default_rng(seed), jaccard_join.Rule(5, 4, 5)
    sets = [set(range(60)) | set(range(1000, 1040))]
    for family in range(8):
        base = [*range(60), *range(2000 + 100 * family, 2040 + 100 * family)]
        for _ in range(9):
            changed = rng.choice(100, rng.integers(0, 16), replace=False)
            sets.append({x for k, x in enumerate(base) if k not in changed} | {int(x) for x in rng.integers(5000 + 40 * family, 5040 + 40 * family, rng.integers(0, 12))})
    every = [(u, v) for v in range(len(sets)) for u in range(v) if rule.den * len(sets[u] & sets[v]) >= rule.num * len(sets[u] | sets[v])]
    stars, df = starred(spark, sets, rule)
    hub = [(u, v) for u, v in every if u == 0]
    large = [tuple(r) for r in jaccard_join.exploded(stars, df, rule).collect()]
    monkeypatch.setattr(jaccard_join, "exploded", None)
    small = [tuple(r) for r in jaccard_join.deviating(stars, df, rule).collect()]
    assert set(small) <= set(every) and len(small) < len(sets)
    assert joined(len(sets), small + hub) == joined(len(sets), large + hub) == joined(len(sets), every)
    # pairs in portions of one item each
    rows = stars.orderBy("v").collect()
    lists = [r["deviations"] for r in rows]
    at = np.append(0, np.cumsum([len(x) for x in lists]))
    found = jaccard_join.joining(rule, np.array([r["component"] for r in rows]), np.array([r["size"] for r in rows]), at, np.array([x for row in lists for x in row]), chunk=1)
    assert joined(len(sets), [(i + 1, j + 1) for i, j in found] + hub) == joined(len(sets), every)


def joined(n, edges):
    label = list(range(n))
    for u, v in edges:
        a, b = label[u], label[v]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_subsets_and_neighbourhoods_lose_no_link():
    """Any two sets within the allowed difference share a signature, whatever the scheme."""
    rng, rule = np.random.default_rng(5), jaccard_join.Rule(5, 4, 5)
    for trial in range(60):
        size = int(rng.integers(1, 120))
        x = rng.integers(0, 2**63, size).astype(np.uint64)
        change = int(rng.integers(0, rule.most(size, size) + 1)) // 2
        y = np.concatenate([x[change:], rng.integers(0, 2**63, change).astype(np.uint64)])
        sets, offsets = np.concatenate([x, y]), np.array([0, size, 2 * size])
        band = int(rule.band(size))
        need = rule.most(int(rule.bands[band + 1] - 1), int(min(rule.bands[band + 2] - 1, (rule.bands[band + 1] - 1) * 5 // 4))) + 1
        for spare in (0, need // 3, need, 2 * need):
            for doubles in (0, need // 4, need // 2):
                scheme = jaccard_join.Scheme(need + spare, doubles, spare)
                whole, less, owner = jaccard_join.signatures(sets, offsets, np.array([0, 1]), scheme, band)
                kept = jaccard_join.strongest(whole, whole.astype(np.int64) % 7, scheme)
                index = [set(whole[i][kept[i]]) | set(less[owner == i]) for i in (0, 1)]
                assert index[0] & index[1], (size, change, spare, doubles)


def test_allocation_always_covers_the_budget():
    rule = jaccard_join.Rule()
    for band in range(0, 60, 7):
        for docs_ in (10, 10**6, 10**11):
            s = jaccard_join.allocate(rule, band, docs_)
            high, top = int(rule.bands[band + 1] - 1), int(rule.bands[band + 2] - 1)
            assert s.segments + s.doubles == s.cells == rule.most(high, min(top, high * rule.den // rule.num)) + 1 + s.spare


def test_exchanges_stay_in_the_thousands_of_partitions(spark):
    for size in (0, 1 << 20, 1 << 30, 10**12, 10**14):
        n = frames.deal(size)
        assert 1 <= frames.partitions(spark, n) <= frames.MOST_PARTITIONS
        assert n <= 250_000 and size / n < 600 << 20
    assert frames.deal(10 << 30) == math.ceil((10 << 30) / frames.BUCKET_BYTES)


def test_decontaminate(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch quietly"
    near = item.replace("quick", "quack").replace("lazy", "hazy")
    far = item.replace("quick brown fox", "slow green ox").replace("wizards", "witches")
    rows = [(1, f"before {item.upper()} after"), (2, near.replace(" ", " \n ")), (3, far), (4, None), (5, ""), (6, "unrelated words " * 30), (7, item), (7, "x " + near)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, "the"), (13, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.decontaminate(docs_, items).collect()}
    assert got == {(1, 10): 0, (2, 10): 2, (7, 10): 0}
    assert decontaminate.decontaminate(docs_, items.limit(0)).count() == 0
    small = decontaminate.decontaminate(docs_, items, block_chars=40)
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in small.collect()} == got


@pytest.mark.parametrize("max_error", [0.08, 0.2])
def test_piece_search_finds_all_that_brute_force_finds(max_error):
    """Edited copies of items in random text: the same items at the same distances as aligning all of the text."""
    rnd = random.Random(6)
    draw = lambda n: "".join(rnd.choice("abcd e") for _ in range(n))
    items = [(n, decontaminate.normal("x" + draw(rnd.randint(30, 70)) + "y")) for n in range(8)]
    matcher, found = decontaminate.Matcher(items, max_error, 24), 0
    for _ in range(120):
        copy = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, 10)):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.randint(0, 2)] = draw(rnd.randint(0, 2))
        text = decontaminate.normal(draw(rnd.randint(0, 60)) + "".join(copy) + draw(rnd.randint(0, 60)))
        want = {}
        for n, item in items:
            masks = {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
            edits = decontaminate.myers(masks, len(item), text)[0]
            if edits <= math.floor(max_error * len(item)):
                want[n] = edits
        assert {n: edits for n, edits, _ in matcher.match(text)} == want
        found += len(want)
    assert found > 30
    for k in range(40):
        levels = decontaminate.stretches(k)
        assert len(levels) == k + 1 and all(x[-1:] == ([(0, k)] if k else []) for x in levels)
        assert all(a <= piece <= a + b for piece, x in enumerate(levels) for a, b in x)


def test_a_replaced_word_is_within_the_budget():
    """In an item of 85 characters, any word of up to ten letters may be another one."""
    item = "which substance carries most of the oxygen that reaches muscle tissue during activity"
    matcher = decontaminate.Matcher([(1, item)], decontaminate.MAX_ERROR, decontaminate.MIN_CHARS)
    assert len(item) == 85 and not list(matcher.match("a text of its own about oxygen and muscle tissue, and which substance reaches it"))
    words = item.split()
    for k in range(len(words)):
        for other in ("haemoglobe", "zinc"):
            copy = " ".join([*words[:k], other, *words[k + 1 :]])
            assert [h[0] for h in matcher.match(f"Q: {copy}? A: none")] == [1], copy


def test_short_items_and_rows_without_an_id(spark, tmp_path):
    item = "Which gas do plants take in from the air around them when they grow"
    items = spark.createDataFrame([(1, item), (2, "short one"), (None, "another long enough question without an id"), (3, "Yes")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "a\n Short  ONE \nb"), (2, "a short one within a line"), (None, "see: " + item), (None, "clean"), (5, item), (5, "clean too"), (6, "another long enough question without an id"), (7, None), (8, "yes"), (9, "no\nyes\nno")]
    docs_ = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    found = lambda short: {(r["doc_id"], r["item_id"]): (r["edits"], r["passage_end"]) for r in decontaminate.decontaminate(docs_, items, short=short).collect()}
    by_line = {(1, 2): (0, 11), (None, 1): (0, 5 + len(item)), (5, 1): (0, len(item)), (6, None): (0, len(rows[6][1])), (8, 3): (0, 3)}
    assert found("lines") == by_line
    assert found("phrases") == by_line | {(2, 2): (0, 11)}
    assert found("anywhere") == by_line | {(2, 2): (0, 11), (9, 3): (0, 6)}
    left = decontaminate.stage(spark, docs_, str(tmp_path))
    assert left.columns == docs_.columns and sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([rows[3], rows[5], rows[7], rows[9]], key=str)


def test_short_items_at_word_bounds():
    """Items below the size of a budget against a plain search of every place of the text."""
    rnd = random.Random(9)
    items = [(0, "ab"), (1, "a"), (2, "b a"), (3, "(a)"), (4, "ab ab"), (5, "ab")]
    matcher = decontaminate.Matcher(items, decontaminate.MAX_ERROR, decontaminate.MIN_CHARS, "anywhere")
    inside = lambda text, i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    for _ in range(400):
        text = decontaminate.normal("".join(rnd.choice("ab ()é") for _ in range(rnd.randint(0, 14))))
        want = {n for n, item in items for i in range(len(text)) if text.startswith(item, i) and not inside(text, i) and not inside(text, i + len(item))}
        assert {n for n, _, _ in matcher.match(text)} == want


def test_repeated_and_missing_ids_keep_one_order(spark):
    """Whatever the shuffle, the same words go; rows that share an id are ordered by text."""
    rnd = random.Random(8)
    passage = [f"p{k}" for k in range(30)]
    rows = [(i, " ".join([f"{rnd.random()}", *passage, f"{rnd.random()}"])) for i in (4, 4, None, None, None, 9)]
    got = []
    for n in (1, 3, 7):
        out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(n, F.rand(n)))
        got.append(sorted(map(str, out.collect())))
        assert sorted(r["n_removed"] for r in out.collect()) == [0, 30, 30, 30, 30, 30]
    assert got[0] == got[1] == got[2]


def test_long_texts_and_clashing_columns(spark):
    """A text of a megabyte and input columns named like results, through every operator on documents."""
    rnd = random.Random(12)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(180_000))
    rows = [(1, long, 7), (2, long + " end", 7), (3, "", 7), (4, None, 7)]
    clash = ["score", "n_words", "held_out", "component_id", "n_shingles", "edits", "kept", "ids", "n_removed", "n_dropped", "row", "group"]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").select("*", *(F.lit(0).alias(c) for c in clash[1:]))
    labels_ = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, score int")
    items = spark.createDataFrame([(9, long[500_000:500_120], 0)], "item_id long, text string, edits int")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()} == {1: 0, 2: 180_000, 3: 0, 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_tokens"] for r in lm_scoring.lm_scores(df).collect()} == {1: 180_001, 2: 180_002, 3: 1, 4: 1}
    assert quality_classifier.score(df, quality_classifier.train(df, labels_)).where("score BETWEEN 0 AND 1").count() == 4
    assert line_dedup.line_dedup(df).count() == 4 and quality_rules.quality_rules(df).where("n_words = 180000 OR n_words = 180001").count() == 2
    assert {(r["doc_id"], r["edits"]) for r in decontaminate.decontaminate(df, items).collect()} == {(1, 0), (2, 0)}
    assert sentencepiece_nbest.encode(df, ["score", "round_trip"]).where("round_trip").count() == 4


def test_myers_against_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(200):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 25)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
            row = new
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontaminate.myers(masks, len(p), t)[0] == min(row)


def test_lm_scores(spark, docs):
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs).collect()}
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    counts = Counter()
    tokens = lambda t: WORD.findall((t or "").translate(FOLD)) + ["\n"]
    for i, t in corpus():
        if fold(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in corpus():
        r, w = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (fold(i) == 0, len(w), n, sum(x in counts for x in w))
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm_scoring.lm_scores(empty(spark)).count() == 0


def test_lm_scores_against_a_model_in_dictionaries(spark):
    """Interpolated scores of a small corpus, with counts, deletion and expectation-maximisation done word by word."""
    rows = [(i, t) for i, t in corpus(11, 200) if i is not None]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    tokens = lambda t: ["<s>", *WORD.findall((t or "").translate(FOLD)), "</s>"]
    one, two, own_one, own_two = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        w = tokens(t)
        for counts, grams in ((one, w), (two, list(zip(w, w[1:], strict=False)))):
            if fold(i):
                counts.update(grams)
            if fold(i) == 1:
                (own_one if counts is one else own_two).update(grams)
    vocabulary = set(one) - {"<s>"}
    n, held_n, v = sum(one[x] for x in vocabulary), sum(own_one[x] for x in vocabulary), len(vocabulary)

    def parts(h, w, deleted):
        less = 1 if deleted else 0
        context = one[h] - less * own_one[h]
        return int(math.log2(context + 1)), [1 / (v + 1), (one[w] - less * own_one[w]) / (n - less * held_n), (two[h, w] - less * own_two[h, w]) / max(context, 1)]

    held = [parts(h, w, True) for i, t in rows if fold(i) == 1 for h, w in zip(tokens(t), tokens(t)[1:], strict=False)]
    weights = {b: [1 / 3] * 3 for b in range(lm_scoring.BUCKETS)}
    last = -math.inf
    while True:
        used, likely = {b: [0.0] * 3 for b in weights}, 0.0
        for b, f in held:
            total = sum(x * y for x, y in zip(weights[b], f, strict=True))
            likely += math.log(total)
            used[b] = [u + x * y / total for u, x, y in zip(used[b], weights[b], f, strict=True)]
        new = {b: [x / sum(u) for x in u] if sum(u) else [1 / 3] * 3 for b, u in used.items()}
        weights = new
        if likely - last <= 1e-5 * len(held):
            break
        last = likely
    want = {}
    for i, t in rows:
        w, total = tokens(t), 0.0
        for h, x in zip(w, w[1:], strict=False):
            b, f = parts(h, x, False)
            total += math.log10(sum(p * q for p, q in zip(weights[b], f, strict=True)))
        want[i] = total
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert held and len(got) == len(rows)
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-6, abs_tol=1e-9) for r in got)
    for h in ("<s>", *sorted(vocabulary - {"</s>"})):  # a distribution over the vocabulary and one unknown word
        b, _ = parts(h, "unknown word", False)
        assert math.isclose(sum(sum(p * q for p, q in zip(weights[b], parts(h, w, False)[1], strict=True)) for w in (*vocabulary, "unknown word")), 1)


def test_expectation_maximisation_recovers_weights():
    rng = np.random.default_rng(0)
    f = np.stack([np.full(4000, 0.01), rng.uniform(0.01, 0.1, 4000), np.where(rng.random(4000) < 0.6, 0.5, 0.0)])
    weights, bucket = np.full((lm_scoring.BUCKETS, 3), 1 / 3), np.full(4000, 5)
    last = -np.inf
    for _ in range(20):
        like = np.log((weights[bucket].T * f).sum(axis=0)).sum()
        assert like >= last - 1e-9
        last = like
        used, likely = lm_scoring.expectation(weights, bucket, f, np.ones(4000))
        assert math.isclose(likely.sum(), like)
        weights = lm_scoring.maximisation(used)
    assert np.allclose(weights.sum(axis=1), 1)


def test_quality_classifier(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
        rows.append((i, " ".join(words) + "." if good else " | ".join(words)))
        labels.append((i, int(good)))
    rows += [(300, None), (301, ""), (None, "x")]
    docs_, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5, None)], "doc_id long, quality int")
    out = quality_classifier.score(docs_, quality_classifier.train(docs_, marks), ["doc_id"]).collect()
    assert len(out) == 303 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    lone = quality_classifier.train(docs_, marks.limit(0))
    assert quality_classifier.score(docs_, lone, ["doc_id"]).where("score <> 0.5").count() == 0


def test_quality_rules(spark, docs):
    text = "A sound line of words that ends well.\nHome | News | Sport | More\nWe use cookies on this site.\n" + " ".join(f"word{k}" for k in range(30))
    bad = spark.createDataFrame([(1, text), (2, "a | b | c\n" * 30), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(bad, clean_text=True).collect()}
    assert got[1]["kept"] and got[1]["n_failed_lines"] == 2 and "cookies" not in got[1]["clean_text"] and got[1]["clean_text"].count("\n") == 1
    assert not got[2]["kept"] and got[3]["base_failed"] and got[3]["clean_text"] == ""
    rows = {}
    for r in quality_rules.quality_rules(docs).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for i, t in corpus():
        w, lines = WORD.findall(t or ""), (t or "").split("\n")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        r = rows[i][0]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
        assert r["n_dup_lines"] == sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])


def test_quality_rules_of_each_line(spark):
    prose = " ".join(f"word{k}" for k in range(79))
    lines = {
        "alle Rechte vorbehalten": True, "TOUS DROITS réservés": True, "Haga clic aquí para seguir": True, "Conditions d'utilisation": True,
        "Inicio › Noticias › Deportes": True, "a 1 › b 2 c 3 d 4 e 5 f 6": False, "see https://a.org and WWW.B.org": True, "xhttp://a yhttp://b": False,
        prose: False, prose + " privacy policy.": False, "": False, "### $$$ word": True,
    }
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_failed_lines"] == 1 for r in quality_rules.quality_rules(rows).collect()}
    assert {line: got[i] for i, line in enumerate(lines)} == lines


def test_sentencepiece(spark):
    lattice = sentencepiece_nbest.Lattice.load(sentencepiece_nbest.MODEL)

    def every(chunk, n):
        edges = lattice.edges(chunk)

        def walk(at):
            if not at:
                yield 0.0
            for start, _, score in edges[at]:
                for rest in walk(start):
                    yield rest + score

        return sorted(walk(len(chunk)), reverse=True)[:n]

    texts = ["", None, "hello", "the cat", "é▁\n", " a", "x" * 60, "word " * 40, "tab\tand 漢字 😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sentencepiece_nbest.decode(sentencepiece_nbest.encode(df, ["n_pieces", "score", "nbest_scores", "ids", "nbest_ids", "round_trip"], ["doc_id"])).collect()
    score_of = {}
    for edges in (lattice.edges(bytes(range(256))), *(lattice.edges((" " + (t or "")).encode()) for t in texts)):
        score_of.update({i: s for at in edges for _, i, s in at})
    for r in rows:
        # N different segmentations, each of the whole text, with the scores that were given
        assert r["nbest_ids"][0] == r["ids"] and len({tuple(x) for x in r["nbest_ids"]}) == len(r["nbest_ids"]) == len(r["nbest_scores"])
        assert all(lattice.decode(x).decode() == (texts[r["doc_id"]] or "") for x in r["nbest_ids"])
        assert np.allclose([sum(score_of[i] for i in x) for x in r["nbest_ids"]], r["nbest_scores"])
        text = texts[r["doc_id"]] or ""
        assert r["round_trip"] and r["decoded_text"] == text and r["n_pieces"] == len(r["ids"]) and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
        if len(text.encode()) < 10:
            assert np.allclose(r["nbest_scores"], every((" " + text).encode(), 4))


def test_url_filters(spark):
    events = spark.createDataFrame(
        [("domain", "bad.org", "add", "2024-01-01"), ("domain", "bad.org", "remove", "2024-02-01"), ("host", "a.ok.net", "add", "2024-03-01"), ("prefix", "ok.net/p", "add", "2024-01-01")],
        "kind string, pattern string, action string, day string",
    ).select("kind", "pattern", "action", F.col("day").cast("timestamp").alias("at"))
    rows = [
        (1, "http://x.bad.org/", "2024-01-15", "domain:bad.org"), (2, "http://x.bad.org/", "2024-02-01", None), (3, "http://notbad.org/", "2024-01-15", None),
        (4, "https://u@A.OK.net:8080/q?x", "2024-03-02", "host:a.ok.net"), (5, "http://ok.net/p/q", "2024-05-01", "prefix:ok.net/p"), (6, "http://ok.net/pq", "2024-05-01", None),
        (7, None, "2024-01-15", None), (8, "/relative", "2024-01-15", None), (9, "http://bad.org", None, None), (9, "http://bad.org", None, None),
    ]
    captures = spark.createDataFrame([(i, u, t, "clash") for i, u, t, _ in rows], "page_id long, url string, t string, rule string").withColumn("fetched_at", F.col("t").cast("timestamp"))
    got = sorted((r["page_id"], r["rule"]) for r in url_filters.url_filter(captures, events).collect() if r["rule"])
    assert got == [(i, w) for i, _, _, w in rows if w]
    assert url_filters.url_filter(captures, events).count() == len(rows)


def test_warc_round_trip(spark):
    big = "é" * 1500
    rows = [(3, "http://a/", big), (1, None, big), (2, "http://b/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n\r\n" + "z" * 200), (None, "u", big), (1, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, files = warc.write_archives(warc.chunk_table(warc.decide(pages), chunk=512))
    chunks = warc.read_archives(files, chunk=512).cache()
    got = sorted(((r["page_id"] is None, r["page_id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.payloads(chunks).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = data == big.encode() and i != 1
        want.append(((i is None, i or 0), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chunks.where("page_id = 1").groupBy().agg(F.max("chunk_no")).first()[0] == math.ceil(3000 / 512) - 1
    assert warc.payloads(warc.read_archives(warc.write_archives(warc.chunk_table(warc.decide(pages.limit(0))))[1])).count() == 0


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    base = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(6)]
    leak = " ".join(base[2].split()[:30])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)] + [(10, base[0], "en", "s", 1), (11, "a | b | c " * 20, "en", "s", 1), (12, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs_ = corpus_pipeline.written(stage(spark, docs_, str(tmp_path)))
        kept.append(sorted(r["doc_id"] for r in docs_.select("doc_id").collect()))
    assert kept == [[0, 1, 2, 3, 4, 5, 10], [0, 1, 2, 3, 4, 5, 10], [0, 1, 2, 3, 4, 5], [0, 1, 3, 4, 5], [0, 1, 3, 4, 5]]
    assert corpus_pipeline.run(spark, str(tmp_path)).where("round_trip").count() == 5
