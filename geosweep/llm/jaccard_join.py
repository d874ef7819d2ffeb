"""N-gram Jaccard join by universe partition and pigeonhole.

A document is its set of word n-grams, as 64-bit hashes.  Sets of equal content are one
class, and classes are the nodes of the link graph.  Linked sets x, y differ in at most
H = (1 - t) / (1 + t) (|x| + |y|) n-grams, and their sizes lie in one size band or in two
neighbours.  Each band k has a scheme that splits the universe of hashes into segments
with allowances z adding up to its H + 1 + E.  A segment in which two linked sets differ
in fewer than z n-grams agrees; as the others use up z differences each, agreeing
segments hold allowances of E + 1 or more together.  Allowance 1 asks for equal segments;
allowance 2 for equal ones or one n-gram of difference, found by one-deletion
neighbourhoods.

The spare E pays for a subset: a set is indexed by all its segments of allowance 1 but the E
weakest, in an order of content (those that most sets of the corpus have first, then by
hash).  Of E + 1 agreeing segments the strongest has the others before it on both sides, so
both sets keep it.  Empty segments and those with nothing but a passage that many documents
share are thus left out.  A set has signatures under the schemes of its own band and the
one below.  How many segments have allowance 2 and how
large E is (smaller segments, but weaker ones left out) is decided per scheme by the cost
of signatures and expected collisions at its documents' number.

Candidates never multiply within a bucket of equal signatures.  Each bucket has a hub,
its member with the most company, and members are verified against the hub.  What these
links connect is settled; a bucket whose other members lie in two components or more may
hold a link between them.  Such a pair has a member that does not link to the hub, so it
must, if it links itself, share many of the n-grams in which the two differ from the hub:
all but T of each one's (T the largest difference that its size allows).  A deviation counts
if members of two components have it, and if what they have alone comes to no more than T;
a member that has more than T alone is left out.  With the others' ordered by how many
members of the hub have them, rarest first, the two share one before they have passed more
than T without the other: such pairs are found by an equi-join on (hub, n-gram) and verified
too.  Where a hub's deviations fit a task (``TOGETHER``), they are one group there: the difference of two members follows
from their deviations alone.  Of a larger hub, where more than ``FEW`` members share a
deviation they are first verified against one of themselves, and only pairs that this does
not connect are formed.  So no link between different components is lost.

Edge cases: every row is a document, whether it shares its id or has none; a document of
fewer than n words has its whole word sequence as one n-gram; one without words, or with
null text, links with nothing and keeps its own id as its component; a component's id is
the smallest that any of its rows has, null if none has one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geosweep.llm.blocks import Block, finish, grams, pack, pair, unpack
from geosweep.llm.frames import (
    REQUEST,
    REQUEST_ARROW,
    answers,
    by_reducer,
    deal,
    deal_key,
    dealt,
    heavy_keys,
    in_order,
    map_blocks,
    requests,
    split_join,
    table,
    with_answers,
    written,
)

U = np.uint64


@dataclass
class Rule:
    """Sets of n-grams of ``words`` words link at a Jaccard similarity of num / den or more."""

    words: int = 3
    num: int = 9
    den: int = 10

    def most(self, a, b):
        """Largest difference of linked sets of sizes a and b."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def reach(self, a):
        """Largest difference of a set of size a from any set that it links to."""
        return self.most(a, a * self.den // self.num)

    @cached_property
    def bands(self) -> np.ndarray:
        """Lower ends of the size bands, as far as any document goes."""
        ends = [1]
        while ends[-1] < 1 << 40:
            ends.append(ends[-1] * self.den // self.num + 1)
        return np.array(ends)

    def band(self, size):
        return np.searchsorted(self.bands, size, "right") - 1


@dataclass(frozen=True)
class Scheme:
    cells: int  # H + 1 + spare equal parts of the universe
    doubles: int  # segments of two cells and allowance 2; the others have one cell and allowance 1
    spare: int  # a set leaves out so many of its segments of allowance 1, the weakest

    def segment(self, u: np.ndarray) -> np.ndarray:
        cell = ((u >> U(32)) * U(self.cells) >> U(32)).astype(np.int64)
        return np.where(cell < 2 * self.doubles, cell // 2, cell - self.doubles)

    @property
    def segments(self) -> int:
        return self.cells - self.doubles


#: Model of cost: bytes of a signature, and the share of documents that hold a given n-gram.
SIGNATURE, COMMON = 5, 1e-3


def allocate(rule: Rule, band: int, docs: int) -> Scheme:
    """Scheme of a band for so many documents, by the fewest bytes a document is expected to send.

    A chance candidate takes the two sets three times over.  A kept segment of k n-grams
    meets one of the others by chance where that has these too and no more, or, under
    allowance 2, where both have one at most.  The choice bears on cost alone: every
    scheme finds all links.
    """
    low, high, top = rule.bands[band], rule.bands[band + 1] - 1, rule.bands[band + 2] - 1
    need = rule.most(int(high), int(min(top, high * rule.den // rule.num))) + 1
    size = (low + high) / 2
    best, choice = math.inf, None
    for spare in sorted({0, need // 4, need * 2 // 5, need * 3 // 5, need}):
        cells = need + spare
        each = size / cells  # n-grams of a cell
        two = (1 + 2 * each) * math.exp(-2 * each)
        for doubles in sorted({0, need // 4, need // 2}):
            single = cells - 2 * doubles
            left_out, chance, p = float(min(spare, single)), 0.0, math.exp(-each)
            for k in range(8):
                weak = min(left_out, single * p)
                left_out -= weak
                chance += (single * p - weak) * min(1.0, docs * p * COMMON**k)
                p *= each / (k + 1)
            chance += doubles * two * min(1, docs * two)
            signatures = single + doubles * (2 + 2 * each)
            cost = SIGNATURE * signatures + 24 * size * chance
            if cost < best:
                best, choice = cost, Scheme(cells, doubles, spare)
    return choice


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all documents, sorted within each, and their offsets."""
    h, doc, count = block.words(lower=True), block.word_doc, block.n_words
    g = grams(h, n)
    whole = np.flatnonzero(doc[: len(g)] == doc[n - 1 : n - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
    owners, values = [doc[whole]], [g[whole]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            owners.append(short)
            values.append(pair(grams(h, k)[block.first_word[short]], np.full(len(short), k, U), 5))
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))[: len(owner)]
    return value[new], np.searchsorted(owner[new], np.arange(block.n_docs + 1))


def _sums(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(value, dtype=U)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Signatures keep their first 48 bits; a false match costs a candidate, which verification drops.
KEPT_BITS = ~U(0xFFFF)


def signatures(sets: np.ndarray, offsets: np.ndarray, which: np.ndarray, scheme: Scheme, name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of whole segments, a row for each chosen set; and of sets without an n-gram, with their rows."""
    size = np.diff(offsets)[which]
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(which)), size)
    value = sets[np.repeat(offsets[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    segment = scheme.segment(finish(value ^ U(0xC0FFEE)))
    term = finish(value + U(0x9E3779B97F4A7C15))
    n, doubles = scheme.segments, scheme.doubles
    slot = owner * n + segment
    order = np.argsort(slot, kind="stable")
    content = _sums(term[order], np.searchsorted(slot[order], np.arange(len(which) * n + 1)))
    label = finish(np.arange(n).astype(U) + U(name << 32))
    whole = pair(content, np.tile(label, len(which)), 6).reshape(len(which), n)
    near = segment < doubles
    less = pair(content[slot[near]] - term[near], label[segment[near]], 6)
    return whole & KEPT_BITS, less & KEPT_BITS, owner[near]


def strongest(whole: np.ndarray, times: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Which whole segments a set keeps: all but its ``spare`` weakest of allowance 1, the most frequent in the corpus."""
    kept = np.ones(whole.shape, bool)
    single = whole.shape[1] - scheme.doubles
    out = min(scheme.spare, single)
    if out == single:
        kept[:, scheme.doubles :] = False
    elif out:
        # both sides of a link see a segment's count and signature alike
        rank = ~np.minimum(times[:, scheme.doubles :], 0xFFFF).astype(U) << U(48) | whole[:, scheme.doubles :] >> U(16)
        kept[:, scheme.doubles :] = rank >= np.partition(rank, out, axis=1)[:, out : out + 1]
    return kept


def digests(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set, as two columns."""
    return _sums(finish(sets), offsets).view(np.int64), _sums(finish(sets ^ U(0xABCDEF)), offsets).view(np.int64)


def _keys(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return np.rec.fromarrays([np.asarray(d1, np.int64), np.asarray(d2, np.int64)], dtype=[("d1", np.int64), ("d2", np.int64)])


class _Bucket:
    """Sets of the classes whose text the bucket was chosen to send, one row each."""

    def __init__(self, rows: pa.Table, classes: np.ndarray, d1: np.ndarray, d2: np.ndarray, rule: Rule, schemes: dict[int, Scheme]):
        text = rows.column("__text")
        block = Block(pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string()))
        sets, offsets = shingle_sets(block, rule.words)
        have, first = np.unique(_keys(*digests(sets, offsets)), return_index=True)
        wanted = _keys(d1, d2)
        at = np.searchsorted(have, wanted)
        at = first[at]
        size = np.diff(offsets)[at]
        self.ids, self.size = classes, size
        self.sets = sets[np.repeat(offsets[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        sigs, owners, self.grids, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], [], 0
        band = rule.band(size)
        for k in np.unique(band):
            which = np.flatnonzero(band == k)
            for name in (int(k), int(k) - 1):
                if name in schemes:
                    whole, less, owner = signatures(self.sets, self.offsets, which, schemes[name], name)
                    self.grids.append((at, whole, schemes[name]))
                    at += whole.size + len(less)
                    sigs += [whole.ravel(), less]
                    owners += [np.repeat(which, whole.shape[1]), which[owner]]
        self.sigs, self.owner = np.concatenate(sigs), np.concatenate(owners)

    def kept(self, times: np.ndarray) -> np.ndarray:
        """Which signatures stay, by how often each occurs in the corpus."""
        kept = np.ones(len(self.sigs), bool)
        for at, whole, scheme in self.grids:
            mine = slice(at, at + whole.size)
            kept[mine] = strongest(whole, times[mine].reshape(whole.shape), scheme).ravel()
        return kept


def _ask(rule: Rule, schemes: dict[int, Scheme], reducers: int):
    def fn(rows: pa.Table, classes: pa.Table) -> pa.Table:
        if not rows.num_rows or not classes.num_rows:
            return REQUEST_ARROW.empty_table()
        number = rows.column("__b")[0].as_py()
        own = [np.asarray(classes.column(c), np.int64) for c in ("cls", "d1", "d2")]
        b = _Bucket(rows, *own, rule, schemes)
        unique, count = np.unique(b.sigs, return_counts=True)
        back = pa.table([pa.array([number], pa.int32()), pa.array([-1 - number], pa.int32()), pa.array([pack(*own)], pa.binary())], schema=REQUEST_ARROW)
        return pa.concat_tables([requests(number, reducers, unique, np.minimum(count, 2**31).astype(np.uint32)), back])

    return fn


def company(asked: pa.Table) -> pa.Table:
    """Reply to each request: how many classes of the corpus have each signature (0 where just one)."""
    if asked.column("__r")[0].as_py() < 0:
        return asked.select(REQUEST_ARROW.names)
    parts_ = [unpack(v) for v in asked.column("__v").to_pylist()]
    _, back = np.unique(np.concatenate([p[0] for p in parts_]), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([p[1] for p in parts_]))[back]
    total = np.where(total > 1, np.minimum(total, 2**31), 0).astype(np.uint32)
    cut = np.cumsum([len(p[0]) for p in parts_])[:-1]
    return answers(asked, [pack(x) for x in np.split(total, cut)])


MEMBERS = "sig long, cls long, score long, size long, items binary"


def _members(rule: Rule, schemes: dict[int, Scheme]):
    """Rows (sig, cls, score, size) for signatures in company, and (cls, size, items) for their classes."""
    schema = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("score", pa.int64()), ("size", pa.int64()), ("items", pa.binary())])

    def fn(rows: pa.Table, replies: pa.Table) -> pa.Table:
        mine = pa.compute.less(replies.column("__r"), 0) if replies.num_rows else None
        if not rows.num_rows or mine is None:
            return schema.empty_table()
        b = _Bucket(rows, *unpack(replies.filter(mine).column("__v")[0].as_py()), rule, schemes)
        unique, back = np.unique(b.sigs, return_inverse=True)
        got = in_order(replies.filter(pa.compute.invert(mine)))
        total = np.concatenate([unpack(v)[0] for v in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        total = total[back]
        total = np.where(b.kept(total), total, 0)
        score = np.bincount(b.owner, weights=total, minlength=len(b.ids)).astype(np.int64)
        at = np.flatnonzero(total > 0)
        own = b.owner[at]
        some = np.unique(own)
        n, m = len(at), len(some)
        items = [pack(b.sets[b.offsets[d] : b.offsets[d + 1]]) for d in some]
        return pa.table(
            [
                pa.array(np.append(b.sigs[at].view(np.int64), np.zeros(m, np.int64)), mask=np.append(np.zeros(n, bool), np.ones(m, bool))),
                pa.array(np.append(b.ids[own], b.ids[some])),
                pa.array(np.append(score[own], np.zeros(m, np.int64))),
                pa.array(np.append(b.size[own], b.size[some])),
                pa.array([None] * n + items, pa.binary()),
            ],
            schema=schema,
        )

    return fn


VERIFIED = "u long, v long, linked boolean, differ long, size long, score long, deviations array<long>"
#: Bytes of sets that one batch of verified pairs holds, about.
BATCH = 8 << 20


def _verify(rule: Rule):
    """Exact check of pairs, and for those in company (many) all n-grams in which v differs from u."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_()), ("differ", pa.int64()), ("size", pa.int64()), ("score", pa.int64()), ("deviations", pa.list_(pa.int64()))])

    def check(batch: pa.RecordBatch, sets) -> pa.RecordBatch:
        linked, lists, differs, sizes = [], [], [], []
        for x, y, many in zip(batch.column("a"), batch.column("b"), batch.column("many").to_pylist(), strict=True):
            x, y = sets(x.as_py()), sets(y.as_py())
            apart = np.setxor1d(x, y, assume_unique=True)
            shared = (len(x) + len(y) - len(apart)) // 2
            linked.append(bool(rule.den * shared >= rule.num * (len(apart) + shared)))
            differs.append(len(apart))
            sizes.append(len(y))
            lists.append(apart.view(np.int64) if many else None)
        arrays = [pa.array(linked, pa.bool_()), pa.array(differs, pa.int64()), pa.array(sizes, pa.int64()), batch.column("score"), pa.array(lists, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *arrays], schema=schema)

    def run(batches):
        sets = lru_cache(maxsize=64)(lambda value: unpack(value)[0])
        for batch in batches:
            step = max(1, batch.num_rows * BATCH // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                yield check(batch.slice(at, step), sets)

    return run


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (u, v, many, and score as it is) with their check; at most 50 sets, those of hubs with 2 % of all pairs, are broadcast."""
    by_u, by_v = (heavy_keys(pairs, [c], 50) for c in "uv")
    left = split_join(pairs, sets.select(F.col("cls").alias("u"), F.col("items").alias("a")), ["u"], heavy=by_u)
    both = split_join(left, sets.select(F.col("cls").alias("v"), F.col("items").alias("b")), ["v"], heavy=by_v)
    return both.select("u", "v", "score", "many", "a", "b").mapInArrow(_verify(rule), VERIFIED)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of an edge list (u, v): least label of neighbours, then of labels' labels."""
    edges = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    ends = edges.withColumnRenamed("v", "node")
    heavy = heavy_keys(ends, ["node"])
    while True:
        near = split_join(ends, label.select("node", "component"), ["node"], heavy=heavy).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("c"))
        low = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("c"), F.col("component").alias("old"))
        low = written(low)
        jump = split_join(low, label.select(F.col("node").alias("c"), F.col("component").alias("d")), ["c"], "left")
        new = written(jump.select("node", F.least("c", F.coalesce("d", "c")).alias("component"), "old"))
        changed = new.where("component <> old").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label


#: Members with a common deviation that are paired with each other at once.
FEW = 16


def reach(rule: Rule):
    """``Rule.reach`` of the column ``size``."""
    return F.floor((rule.den - rule.num) * (F.col("size") + F.floor(F.col("size") * rule.den / rule.num)) / (rule.den + rule.num))


def common(rows: DataFrame, rule: Rule) -> DataFrame:
    """Deviations that a member can share with one of another component that it links to, n times in all.

    ``lone`` counts a member's other deviations: what two members have alone may not come to more than the
    larger difference that a size allows.
    """
    keys = rows.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("lone").alias("least"))
    held = rows.join(keys.where("low <> high").select("hub", "item", "n", "least"), ["hub", "item"]).where(F.col("lone") + F.col("least") <= reach(rule))
    held = held.withColumn("lone", F.col("differ") - F.count(F.lit(1)).over(Window.partitionBy("hub", "v")))
    return held.where(F.col("lone") <= reach(rule)).drop("least")


#: Deviations of one hub that a task takes together.
TOGETHER = 1 << 21


def joining(rule: Rule, component: np.ndarray, size: np.ndarray, offsets: np.ndarray, items: np.ndarray, chunk: int = 1 << 20) -> list[tuple[int, int]]:
    """Linked members (positions) of one hub that join components, from all their deviations; pairs of one component are left out.

    Members go whose deviations no other component has, but for as many as their size allows; of the
    others each looks up its rarest ones, as far as two linked members can go without a common one.  Pairs
    are formed in portions, and the difference of two members is that of their deviations.
    """
    m, most = len(size), rule.reach(size)
    differ = np.diff(offsets)
    owner = np.repeat(np.arange(m), differ)
    own, item = owner, items
    while True:
        order = np.argsort(item, kind="stable")
        own, item = own[order], item[order]
        start = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
        if not len(start):
            return []
        low, high = (f.reduceat(component[own], start) for f in (np.minimum, np.maximum))
        n = np.diff(np.append(start, len(item)))
        held = np.repeat(low < high, n)
        lone = differ - np.bincount(own[held], minlength=m)
        stay = held & (lone <= most)[own]
        if stay.all():
            break
        own, item = own[stay], item[stay]
    n = np.repeat(n, n)
    order = np.lexsort((item, n, own))
    own, item = own[order], item[order]
    past = lone[own] + np.arange(len(own)) - np.searchsorted(own, own)
    near = past <= most[own]
    order = np.argsort(item[near], kind="stable")
    own, item, past = own[near][order], item[near][order], past[near][order]
    count = np.searchsorted(item, item, "right") - np.arange(len(item)) - 1
    ends, root, found, at = np.cumsum(count), {}, [], 0

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    while at < len(item):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
        k = count[at:to]
        i = np.repeat(np.arange(at, to), k)
        j = i + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        at = to
        a, b = own[i], own[j]
        allowed = rule.most(size[a], size[b])
        shared = differ[a] + differ[b] - allowed
        fit = (component[a] != component[b]) & (np.abs(size[a] - size[b]) <= allowed) & (2 * past[i] + shared <= 2 * differ[a]) & (2 * past[j] + shared <= 2 * differ[b])
        for pair_ in np.unique(np.minimum(a, b)[fit] * m + np.maximum(a, b)[fit]).tolist():
            x, y = divmod(pair_, m)
            p, q = top(int(component[x])), top(int(component[y]))
            if p == q:
                continue
            common_ = len(np.intersect1d(items[offsets[x] : offsets[x + 1]], items[offsets[y] : offsets[y + 1]], assume_unique=True))
            apart = int(differ[x] + differ[y]) - 2 * common_
            both = (int(size[x] + size[y]) - apart) // 2
            if rule.den * both >= rule.num * (apart + both):
                root[p] = q
                found.append((x, y))
    return found


def _joining(rule: Rule):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group.column("deviations").chunk(0) if group.num_rows else pa.array([], pa.list_(pa.int64()))
        v, component, size = (np.asarray(group.column(c)) for c in ("v", "component", "size"))
        found = joining(rule, component, size, np.append(0, np.cumsum(np.asarray(pa.compute.list_value_length(lists)))), np.asarray(lists.flatten()))
        pairs = np.sort(v[np.array(found, int).reshape(-1, 2)], axis=1)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run


def deviating(stars: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) between members of one hub that lie in different components so far, as many as join them."""
    stars = written(stars)
    large = written(stars.groupBy("u").agg(F.sum("differ").alias("n")).where(F.col("n") > TOGETHER).select("u"))
    if not large.limit(1).count():
        return stars.groupBy("u").applyInArrow(_joining(rule), "u long, v long")
    few = stars.join(F.broadcast(large), "u", "left_anti").groupBy("u").applyInArrow(_joining(rule), "u long, v long")
    return few.unionByName(exploded(stars.join(F.broadcast(large), "u", "left_semi"), sets, rule))


def exploded(stars: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The links of hubs too large for a task: a row for each deviation."""
    own = ["hub", "v", "component", "linked", "differ", "size"]
    rows = written(stars.select(F.col("u").alias("hub"), *own[1:], F.lit(0).cast("long").alias("lone"), F.explode("deviations").alias("item")))
    for _ in range(2):  # what is left out makes others' deviations lone
        rows = written(common(rows, rule).drop("n"))
    # up to and with its first common deviation a member has ``past`` of them without the other
    past = F.col("lone") + F.row_number().over(Window.partitionBy("hub", "v").orderBy("n", "item")) - 1
    placed = written(common(rows, rule).withColumn("past", past).where(F.col("past") <= reach(rule)).select(*own, "item", "past"))
    top = F.min(F.struct("past", "v", "component")).alias("top")
    keys = placed.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), top).where("low <> high")
    first = placed.join(keys, ["hub", "item"]).where(F.col("past") + F.col("top.past") <= reach(rule))
    first = first.select(*own, "item", "past", F.col("top.v").alias("top"), F.col("top.component").alias("top_component"), (F.col("n") > FEW).alias("full"))
    first = written(first)

    subs = first.where("full AND top_component <> component").groupBy(F.col("top").alias("u"), "v").agg(F.lit(0).cast("long").alias("score"), F.lit(False).alias("many"))
    subs = written(verify(written(subs), sets, rule).where("linked").select("u", "v"))
    met = subs.select(F.col("u").alias("top"), "v", F.lit(True).alias("met"))
    seen = first.where("full").join(met, ["top", "v"], "left").withColumn("met", (F.col("top_component") == F.col("component")) | F.coalesce("met", F.lit(False)))
    first = written(first.where("NOT full").withColumn("met", F.lit(False)).unionByName(seen))
    loose = first.where("NOT linked").select("hub", "item", *(F.col(c).alias(f"u_{c}") for c in ("v", "component", "differ", "size", "past", "met")))
    # two differences of a linking pair share at least half of what they hold beyond the
    # allowance: their first common n-gram leaves room for that many behind it on both sides
    allowed = F.floor((rule.den - rule.num) * (F.col("size") + F.col("u_size")) / (rule.den + rule.num))
    shared = F.col("differ") + F.col("u_differ") - allowed
    room = (2 * F.col("past") + shared <= 2 * F.col("differ")) & (2 * F.col("u_past") + shared <= 2 * F.col("u_differ"))
    same = [F.col(f"d.{c}") == F.col(f"l.{c}") for c in ("hub", "item")]
    apart = (F.col("component") != F.col("u_component")) & ~(F.col("met") & F.col("u_met")) & (F.abs(F.col("size") - F.col("u_size")) <= allowed)
    near = first.alias("d").join(loose.alias("l"), same[0] & same[1] & apart & room)
    near = near.select(F.least("u_v", "v").alias("u"), F.greatest("u_v", "v").alias("v")).distinct()
    near = written(near.select("u", "v", F.lit(0).cast("long").alias("score"), F.lit(False).alias("many")))
    return subs.unionByName(verify(near, sets, rule).where("linked").select("u", "v"))


def unsettled(inside: DataFrame, label: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (u, v) of hub and member with their deviations, of buckets whose members besides the hub lie in two components or more."""
    named = inside.join(label.withColumnRenamed("node", "v"), "v", "left").select("sig", "u", "v", F.coalesce("component", "v").alias("component"))
    named = written(named)
    mixed = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    pairs = written(split_join(named, mixed, ["sig"]).groupBy("u", "v").agg(F.first("component").alias("component")))
    # the component goes along in the place of a score
    return verify(pairs.select("u", "v", F.col("component").alias("score"), F.lit(True).alias("many")), sets, rule).withColumnRenamed("score", "component")


def linked_classes(sized: DataFrame, docs: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """(n_shingles, d1, d2, group, least): the component of every class and the smallest id in it."""
    key = ["n_shingles", "d1", "d2"]
    classes = sized.where("n_shingles > 0").groupBy(*key).agg(F.min("__id").alias("rep"), F.min("__k").alias("k"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), *key, "rep", "k"))
    # one row per size that occurs would grow with the longest text alone; bands make it its logarithm
    log_t = math.log(rule.den / rule.num)
    sizes = classes.groupBy(F.floor(F.log(F.col("n_shingles").cast("double")) / (log_t / 4)).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")
    ).collect()
    held: dict[int, int] = {}
    for r in sizes:
        for k in range(int(rule.band(r["low"])), int(rule.band(r["high"])) + 1):
            held[k] = held.get(k, 0) + r["n"]
    schemes = {k: allocate(rule, k, held.get(k, 0) + held.get(k + 1, 0)) for k in {*held, *(k - 1 for k in held)} if k >= 0}

    buckets = deal(sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    own = dealt(docs, buckets, doc_id, text)
    told = classes.select(F.pmod("k", F.lit(buckets)).cast("int").alias("__b"), "cls", "d1", "d2")
    asked = with_answers(own, told, _ask(rule, schemes, buckets), REQUEST, buckets)
    found = written(with_answers(own, by_reducer(asked, company, buckets), _members(rule, schemes), MEMBERS, buckets))
    members = found.where("sig IS NOT NULL").select("sig", "cls", "score", "size")
    sets = found.where("sig IS NULL").select("cls", "items")

    hubs = members.groupBy("sig").agg(F.max(F.struct("score", "cls", "size")).alias("h"), (F.count(F.lit(1)) > 2).alias("many"))
    hubs = hubs.select("sig", F.col("h.cls").alias("u"), F.col("h.size").alias("u_size"), "many")
    inside = split_join(members.select("sig", F.col("cls").alias("v"), "size", "score"), hubs, ["sig"]).where("u <> v")
    # a bucket of two has no third member that either could be linked to
    alike = rule.den * F.least("size", "u_size") >= rule.num * F.greatest("size", "u_size")
    inside = written(inside.select("sig", "u", "v", "score", "many", alike.alias("alike")).where("many OR alike"))
    pairs = written(inside.where("alike").select("u", "v", F.lit(0).cast("long").alias("score"), F.lit(False).alias("many")).distinct())
    links = written(verify(pairs, sets, rule).where("linked").select("u", "v"))
    label = components(links)
    more = written(deviating(unsettled(inside.where("many"), label, sets, rule), sets, rule))
    if more.limit(1).count():
        label = components(links.unionByName(more))
    group = F.coalesce("component", "cls").alias("group")
    grouped = written(classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").select(*key, "rep", group))
    least = grouped.groupBy("group").agg(F.min("rep").alias("least"))
    return split_join(grouped, least, ["group"]).select(*key, "group", "least")


def grouped_rows(docs: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """Per row: __id, __h (hash of its text), n_shingles, its component's number as group, and the smallest id in that as least."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("n_shingles", "d1", "d2", "n_bytes")])

    def digest(_, block):
        sets, offsets = shingle_sets(block, rule.words)
        d1, d2 = digests(sets, offsets)
        return {"n_shingles": np.diff(offsets), "d1": d1, "d2": d2, "n_bytes": np.diff(block.offsets)}

    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), deal_key(doc_id, text).alias("__k"), F.xxhash64(F.col(text).cast("string")).alias("__h"), text)
    sized = written(map_blocks(rows, digest, schema, ["__id", "__k", "__h"], text))
    classes = linked_classes(sized, docs, rule, doc_id, text)
    return split_join(sized, classes, ["n_shingles", "d1", "d2"], "left").select("__id", "__h", "n_shingles", "group", "least")


def jaccard_join(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id."""
    done = grouped_rows(docs, rule, doc_id, text)
    own = F.when(F.col("group").isNull(), F.col("__id")).otherwise(F.col("least"))
    return done.select(F.col("__id").alias(doc_id), "n_shingles", own.alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; n-grams of five words, similarity 0.8.

    The row of least id stays (rows without one come last, rows that share it by the hash of
    their text).  Of rows equal in id and text one stays; rows without words all stay.
    Both lists of rows are written first, so the planner broadcasts them only if small.
    """
    rows = written(grouped_rows(docs, Rule(5, 4, 5), "doc_id", "text").where("n_shingles > 0"))
    none, some = F.col("__id").isNull(), F.coalesce("__id", F.lit(0))
    place = F.struct(none.alias("none"), some.alias("id"), F.col("__h").alias("h"))
    first = rows.groupBy("group").agg(F.min(place).alias("first"))
    placed = rows.select("group", place.alias("place"))
    gone = written(split_join(placed, first, ["group"]).where("place <> first").select("place.*").distinct())
    twice = placed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place.*")
    twice = written(twice.join(gone, ["none", "id", "h"], "left_anti"))
    named = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns])
    own = F.col("c_doc_id").cast("long")
    named = named.select("*", own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(F.col("c_text").cast("string")).alias("h"))
    key = ["none", "id", "h"]
    rest = named.join(gone.unionByName(twice), key, "left_anti")
    once = named.join(twice, key, "left_semi").dropDuplicates([*key, "c_text"])
    return rest.unionByName(once).select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
