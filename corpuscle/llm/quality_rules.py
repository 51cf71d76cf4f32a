"""Line-first cleaning: judge lines, remove those that fail, then reject documents that lost too much.

A line with a word fails when
  * boilerplate: of its words at least one in ``PHRASE_SHARE`` belongs to phrases of ``BOILERPLATE`` (ASCII case ignored, neither within a longer word),
  * navigation: it is a row of links or cells, with a separator ``|``, ``>`` or ``<`` for at least every third word,
  * symbols: it holds at least one of ``[#*$%&|<>]`` for every second word,
  * punctuation: it has at least 12 words and not one of ``. ! ? : ; ,`` and no byte beyond ASCII punctuation,
    or a run-on of exclamation marks: one ``!`` for every second word or more.
Lines without a word never fail.  A document is rejected when the base rules fail (fewer than 50 words, or more than half of
its words in repeated three-word windows) or when more than ``MOST_LOST`` percent of its word characters are in failed lines.

Edge cases: a null text counts as empty and has no words, so it is rejected; rows are judged one by one, repeated ids or
rows keep their own verdicts; other columns pass through ``clean`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import col, free_name, map_texts, named, row_schema
from .words import Piece, before, covered, mix, per_document, pieces, range_hash, windows, words

LEAST_WORDS = 50
MOST_REPEATED = 50      # percent of words
MOST_LOST = 50          # percent of word characters

# fixed values: phrases of page furniture and licences, lower case
BOILERPLATE = ("all rights reserved", "licensed under the", "released under the", "copyright (c)", "cookie policy", "privacy policy",
               "terms of use", "terms of service", "enable javascript", "click here", "sign up", "log in", "subscribe to our", "lorem ipsum")
PHRASE_SHARE = 5        # a paragraph may mention a privacy policy, a line of page furniture is little else

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SEPARATOR = np.isin(np.arange(256), list(b"|<>"))
_STOP = np.isin(np.arange(256), list(b".!?:;,")) | (np.arange(256) >= 128)
_PHRASES = [p.encode() for p in BOILERPLATE]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars"]


def _lines(piece: Piece):
    """(document, start, end) of all lines."""
    breaks = np.flatnonzero(piece.data == 10)
    document = np.concatenate([np.arange(piece.n), np.searchsorted(piece.offsets, breaks, "right") - 1])
    start = np.concatenate([piece.offsets[:-1], breaks + 1])
    order = np.lexsort((start, document))
    document, start = document[order], start[order]
    end = piece.offsets[document + 1]
    same = document[1:] == document[:-1]
    end[:-1][same] = start[1:][same] - 1
    return document, start, end


def _phrase_words(piece: Piece, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words of each line in phrases of BOILERPLATE; phrases hold no line break, none may reach into the next document or begin or end inside a word."""
    lower = piece.data.tobytes().lower()
    inside = np.zeros(len(start), np.int64)
    for phrase in _PHRASES:
        at = lower.find(phrase)
        while at >= 0:
            line, to = np.searchsorted(start, at, "right") - 1, at + len(phrase)
            if to <= end[line]:
                # the code points beside it; four bytes hold at least one
                left = lower[max(start[line], at - 4):at].decode(errors="ignore")[-1:]
                right = lower[to:min(end[line], to + 4)].decode(errors="ignore")[:1]
                if not left.isalnum() and not (phrase[-1:].isalnum() and right.isalnum()):
                    inside[line] += len(phrase.split())
            at = lower.find(phrase, at + 1)
    return inside


def judge(piece: Piece) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each document, and (document, start, end, failed) of each line."""
    w = words(piece)
    data = piece.data
    n = w.counts
    letters = before((data & 0xC0) != 0x80)       # code points
    long_before = np.concatenate([[0], np.cumsum(letters[w.end] - letters[w.start])])
    symbols = before(_SYMBOL[data])

    at, value = windows(w, 3)
    doc = w.document
    key = mix(value ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    sorted_key = key[order]
    twin = np.zeros(len(key), bool)
    same = sorted_key[1:] == sorted_key[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    repeated = covered(len(w.start), at[order[twin]], 3)

    line_doc, start, end = _lines(piece)
    word_from, word_to = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    n_words = word_to - word_from
    used = n_words > 0
    line_key = mix(range_hash(data, start[used], end[used]) ^ mix(line_doc[used].astype(np.uint64) + np.uint64(1)))
    _, firsts = np.unique(line_key, return_index=True)
    n_lines = np.bincount(line_doc[used], minlength=piece.n)
    distinct = np.bincount(line_doc[used][firsts], minlength=piece.n)

    def inside(mask):
        total = before(mask)
        return total[end] - total[start]

    stops, shouts = inside(_STOP[data]), inside(data == 33)
    in_phrases = _phrase_words(piece, start, end)
    failed = used & (((in_phrases > 0) & (PHRASE_SHARE * in_phrases >= n_words)) | (3 * inside(_SEPARATOR[data]) >= n_words) | (2 * (symbols[end] - symbols[start]) >= n_words)
                     | ((n_words >= 12) & (stops == 0)) | ((2 * shouts >= n_words) & (n_words >= 4)))
    lost = (long_before[word_to] - long_before[word_from]) * failed
    counts = {
        "n_words": n, "word_chars": np.diff(long_before[w.first]), "n_symbols": np.diff(symbols[piece.offsets]), "n_dup_lines": n_lines - distinct,
        "n_repeat_words": per_document(w, repeated), "n_lines": n_lines, "n_failed_lines": np.bincount(line_doc[failed], minlength=piece.n),
        "lost_chars": np.bincount(line_doc, weights=lost, minlength=piece.n).astype(np.int64)}
    return counts, line_doc, start, end, failed


def _cleaned(piece: Piece, line_doc, start, end, failed) -> list[str | None]:
    """Texts without their failed lines; None where no line failed."""
    out: list[str | None] = [None] * piece.n
    data = piece.data.tobytes()
    for d in np.unique(line_doc[failed]):
        lines = slice(*np.searchsorted(line_doc, [d, d + 1]))
        out[d] = b"\n".join(data[a:b] for a, b, bad in zip(start[lines], end[lines], failed[lines]) if not bad).decode()
    return out


def measure(documents: DataFrame, keep: list[str], text: str = "text", with_text: bool = False) -> DataFrame:
    """Columns ``keep``, the counts, ``base_failed``, ``kept`` and, if asked for, ``cleaned`` (null: text unchanged)."""
    source = documents.select(named(keep).alias("row"), col(text).alias("t"))
    out = [f"{c} long" for c in COUNTS] + ["cleaned string"] * with_text
    schema = row_schema(source, ", ".join(out))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(1)):
                counts, *lines = judge(piece)
                columns = [batch.column(0).slice(piece.first, piece.n), *(pa.array(counts[c], pa.int64()) for c in COUNTS)]
                if with_text:
                    columns.append(pa.array(_cleaned(piece, *lines), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["row", *COUNTS, *["cleaned"] * with_text])

    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (map_texts(source, run, schema)
            .withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars"))))


def clean(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; failed lines are gone from the text, and ``n_chars`` follows if it is there."""
    names = documents.columns
    new = free_name(names, "cleaned")
    kept = measure(documents, names, text, with_text=True).filter("kept")
    out = kept.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("cleaned").alias(new))
    fresh = {text: F.coalesce(col(new), col(text))}
    if "n_chars" in names:
        fresh["n_chars"] = F.when(col(new).isNull(), F.col("n_chars")).otherwise(F.length(col(new)).cast(documents.schema["n_chars"].dataType))
    return out.withColumns(fresh).select(*map(col, names))
