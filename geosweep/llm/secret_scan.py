"""Secret scans: patterns of known secrets, and a token-efficiency test for unknown ones.

A byte-pair vocabulary learnt from ordinary text spells words and names in few tokens, but
takes a token for one or two characters of a random string.  So every stretch of key-like
characters outside the patterns' own spans is encoded, and one with few characters per token
is a span of the kind ``random``, unless its shape is that of a known digest (hex of a usual
length, or a labelled base64 digest) or of an identifier (a UUID, numbers, a word in one case of
up to 40 letters, or words joined by marks, digits or capitals).

Patterns, leftmost and without overlap by kind; an assignment with too short a value is dropped
after it took its characters:

- ``assign``: a key word, ``:`` or ``=``, and a value of 6 characters or more; its span is all of it;
- ``access``: ``AKIA`` with its capitals and digits, 20 characters or more;
- ``hex``: lower-case hex of 24 characters or more.

The vocabulary file is read on the driver and sent along (its size is checked); each batch of
whole texts is first searched for anything key-like by one linear automaton, and only the
texts that hold such are looked at in Python.  No row meets another, so nothing is shuffled.

Edge cases: null and empty texts hold no spans; rows that share an id, have none or are equal are
scanned each by itself; spans count code points of the whole text, however long; a text of one
long stretch is one stretch, encoded in pieces whose ends may cost a token; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosweep.llm.frames import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_CHARS = 16
MAX_RATIO = 1.9
#: Bytes of a vocabulary file that may be sent to every executor.
MOST_BYTES = 64 << 20
#: Characters encoded at once: the merges of a longer stretch take time by its square.
PIECE = 256

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    # the whole runs of such characters: one that is too short holds no match that begins later and fits
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
#: A value that is too short is dropped only after it took its characters.
MIN_VALUE = 6
#: A text without any of these holds no span.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|[A-Za-z0-9+/_-]{%d}"""
STRETCH = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
DIGEST = re.compile(r"(?i:0x)?(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:md5|sha1|sha224|sha256|sha384|sha512)-[A-Za-z0-9+/]+={0,2}")
_WORD = r"(?:[a-z]{2,15}|[A-Z]{2,15}|[A-Za-z]?[a-z]{1,14}(?:[A-Z][a-z]{2,14})+|[A-Z][a-z]{1,14})[0-9]{0,3}|[0-9]+"
IDENTIFIER = re.compile(rf"(?i:[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}})|[-_/+]*(?:{_WORD})(?:[-_/+]+(?:{_WORD}))+[-_/+]*|[0-9]+|[A-Z]?[a-z]{{2,40}}|[A-Z]{{2,40}}|(?:[a-z]{{2,15}}|[A-Z][a-z]{{1,14}})(?:[A-Z][a-z]{{2,14}})+[0-9]{{0,3}}|(.)\1*")
#: How the vocabulary's own text was cut before its merges: fixed by the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, split: str):
    import tiktoken

    pairs = map(bytes.split, ranks.splitlines())
    return tiktoken.Encoding("secret_scan", pat_str=split, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def ratio(text: str, encoding) -> float:
    """Characters per token."""
    return len(text) / sum(len(encoding.encode_ordinary(text[i : i + PIECE])) for i in range(0, len(text), PIECE))


def spans(text: str, encoding, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, characters per token of a random one) in order of start, then of kind."""
    found = [(kind, *m.span(), None) for kind, pattern in PATTERNS.items() for m in pattern.finditer(text) if kind != "assign" or len(m[2]) >= MIN_VALUE]
    taken = sorted((a, b) for _, a, b, _ in found)
    i, reach = 0, -1
    for m in re.finditer(STRETCH % min_chars, text):
        a, b = m.span()
        # spans that begin before this stretch ends; the farthest end of them tells whether one meets it
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > a or DIGEST.fullmatch(m[0]) or IDENTIFIER.fullmatch(m[0]):
            continue
        if (r := ratio(m[0], encoding)) <= max_ratio:
            found.append(("random", a, b, r))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, split: str = SPLIT, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id and the array ``spans`` of (kind, start, end, ratio) of each row."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        ranks = file.read(MOST_BYTES + 1)
    if len(ranks) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes")
    shared = spark.sparkContext.broadcast(ranks)
    source = docs.select(F.col(doc_id), F.col(text).cast("string").alias("__text"))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])

    def run(batches):
        encoding = _encoding(shared.value, split)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            some = pc.match_substring_regex(texts, ANY % min(min_chars, 16))
            found = [spans(t.as_py(), encoding, min_chars, max_ratio) if s.as_py() else [] for t, s in zip(texts, some, strict=True)]
            rows = [[dict(zip(("kind", "start", "end", "ratio"), s, strict=True)) for s in of] for of in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=[doc_id, "spans"])

    return source.mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, ratio: double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    written_as = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, written_as)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", written_as)).alias("spans"),
    )
