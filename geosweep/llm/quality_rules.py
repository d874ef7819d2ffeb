"""Quality rules by line-first cleaning.

Every line is judged by itself, failing lines are taken out, and a document that loses
too large a share of its words that way is rejected, as is one that fails the
document-level base rules.  A line fails by punctuation (as many symbols as half its
words), as navigation (a bar of separators, a list of links), or as boilerplate (a short
line with a phrase of page furniture, in English, German, French or Spanish).

Edge cases: null text counts as empty text; a document without words fails the base
rule on length; every row gives one row, so repeated rows give repeated results; an
input column whose name the operator makes is replaced by the operator's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosweep.llm.blocks import Block, finish, grams, pair, span_hashes
from geosweep.llm.frames import map_blocks, table

#: Phrases that mark a line as page furniture (lower case), in four languages.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "enable javascript",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "terms of service",
    "terms of use",
    "we use cookies",
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "klicken sie hier",
    "nutzungsbedingungen",
    "wir verwenden cookies",
    "zum inhalt springen",
    "accepter tous les cookies",
    "aller au contenu",
    "cliquez ici pour",
    "conditions d'utilisation",
    "mentions légales",
    "nous utilisons des cookies",
    "politique de confidentialité",
    "tous droits réservés",
    "aceptar todas las cookies",
    "condiciones de uso",
    "haga clic aquí",
    "política de privacidad",
    "saltar al contenido",
    "todos los derechos reservados",
    "utilizamos cookies",
)
#: Symbols of the punctuation rule, separators of navigation bars, and how the
#: words of a list of links begin.
MARKS = "!#$%&*<>@^_{}~"
SEPARATORS = ("|", "›", "•", "→")
LINKS = ("http://", "https://", "www.")
#: A line of more words that holds a phrase is prose about it.
FURNITURE_WORDS = 40
WINDOW = 8

MEASURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_failed_lines", "n_removed_words")]
)


def _in(buf: np.ndarray, chars: str) -> np.ndarray:
    table_ = np.zeros(256, dtype=bool)
    table_[np.frombuffer(chars.encode(), np.uint8)] = True
    return table_[buf]


def _hits(low: bytes, phrase: str) -> np.ndarray:
    """Where ``phrase`` begins in the text."""
    mark, hits = phrase.encode(), []
    hit = low.find(mark)
    while hit >= 0:
        hits.append(hit)
        hit = low.find(mark, hit + len(mark))
    return np.array(hits, np.int64)


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _repeats(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (doc, value) items: whether an earlier equal item exists, and whether any other does."""
    _, first, back, count = np.unique(
        pair(finish(doc.astype(np.uint64)), value), return_index=True, return_inverse=True, return_counts=True
    )
    return first[back] != np.arange(len(value)), count[back] > 1


def measure(block: Block, window: int = WINDOW, max_loss: float = 0.5, text_out: bool = False) -> dict[str, object]:
    buf, n_words = block.buf, block.n_words.astype(np.int64)
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[block.start] += 1
    mark[block.end] -= 1
    in_word = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    word_chars = block.per_doc(in_word & ((buf & 0xC0) != 0x80))
    n_symbols = block.per_doc(_in(buf, "#*$%&|<>"))

    # lines: each ends with a newline, the last of a document with the block's own
    start, end, line_doc = block.lines
    words_at = np.searchsorted(block.start, np.append(start, len(buf)))
    line_words = np.diff(words_at)
    seen, _ = _repeats(line_doc, span_hashes(buf, start, end, False))
    n_dup = np.bincount(line_doc[seen & (line_words > 0)], minlength=block.n_docs)

    h = grams(block.words(), window)
    whole = block.word_doc[: len(h)] == block.word_doc[window - 1 :] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    _, twice = _repeats(block.word_doc[at], h[at])
    cover = np.zeros(len(block.start) + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    n_repeat = np.bincount(block.word_doc[np.cumsum(cover[:-1]) > 0], minlength=block.n_docs)

    # rules of a line: symbol-laden, navigation bar, links, page furniture
    low = buf.tobytes().lower()  # A-Z alone
    marks = _sums(_in(buf, MARKS))
    marks = marks[end] - marks[start]
    bars = sum(np.bincount(np.searchsorted(end, _hits(low, mark)), minlength=len(end)) for mark in SEPARATORS)
    begins = np.concatenate([_hits(low, mark) for mark in LINKS])
    begins = begins[np.isin(begins, block.start)] if len(begins) else begins
    links = np.bincount(np.searchsorted(end, begins), minlength=len(end))
    failed = (2 * marks >= line_words) & (marks >= 2)
    failed |= (3 * bars >= line_words) & (bars >= 2) | (2 * links >= line_words) & (links >= 2)
    failed &= line_words > 0
    for phrase in BOILERPLATE:
        at = np.searchsorted(end, _hits(low, phrase))
        failed[at[line_words[at] <= FURNITURE_WORDS]] = True
    removed = np.bincount(line_doc, weights=line_words * failed, minlength=block.n_docs).astype(np.int64)

    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & (removed <= max_loss * n_words),
        "n_lines": np.bincount(line_doc, minlength=block.n_docs),
        "n_failed_lines": np.bincount(line_doc[failed], minlength=block.n_docs), "n_removed_words": removed,
    }
    if text_out:
        out["clean_text"] = block.without_lines(failed)
    return out


def quality_rules(
    docs: DataFrame, keep: list[str] | None = None, text: str = "text", max_loss: float = 0.5, clean_text: bool = False
) -> DataFrame:
    """Measures and verdict per document; with ``clean_text`` also the text without its failed lines.

    ``max_loss`` is the share of words that a document may lose to the line rules.
    """
    schema = T.StructType(MEASURES.fields + ([T.StructField("clean_text", T.StringType())] if clean_text else []))
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    return map_blocks(docs, lambda _, block: measure(block, WINDOW, max_loss, clean_text), schema, keep, text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, each with the text that the line rules leave."""
    judged = quality_rules(docs, docs.columns, clean_text=True).where("kept")
    return judged.select(
        *[F.col("clean_text").alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "n_chars"],
        F.length("clean_text").cast("long").alias("n_chars"),
    ).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])


_ASCII_LOWER = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASES = " OR ".join("contains(low, '{}')".format(p.replace("'", "''")) for p in BOILERPLATE)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY 1),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS lw, {_ASCII_LOWER} AS low,
       len(regexp_extract_all(line, '[!#$%&*<>@^_{{}}~]')) AS marks,
       len(regexp_extract_all(line, '[{"".join(SEPARATORS)}]')) AS bars,
       len(regexp_extract_all(low, '(^|[\x20\x09-\x0D])(https?://|www[.])')) AS links,
       row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM l0),
l2 AS (SELECT *, (lw > 0 AND ((2 * marks >= lw AND marks >= 2) OR (3 * bars >= lw AND bars >= 2)
       OR (2 * links >= lw AND links >= 2))) OR (lw <= {FURNITURE_WORDS} AND ({_PHRASES})) AS failed FROM l1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE failed) AS n_failed_lines,
      coalesce(sum(lw) FILTER (WHERE failed), 0) AS removed, count(*) FILTER (WHERE nth > 1 AND lw > 0) AS n_dup FROM l2 GROUP BY 1),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
      length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      l.n_dup::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words,
      l.n_lines::BIGINT AS n_lines, l.n_failed_lines::BIGINT AS n_failed_lines, l.removed::BIGINT AS n_removed_words
      FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_removed_words <= 0.5 * n_words AS kept FROM m
"""
