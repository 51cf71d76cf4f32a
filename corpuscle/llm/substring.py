"""Substring deduplication by a relative Lempel-Ziv parse against blocks of earlier documents.

A window is ``WINDOW`` consecutive words of a document.  The words of all windows that also occur in a document with a smaller id are removed.

The reference is what the corpus says for the first time: every window at its first place (smallest id, then text hash, then word).  Windows that follow one another
both in a document and among those first places make up a block, so the blocks hold each repeated window once, and a place in a document matches in one block only.
A document is parsed greedily from its first word: where the window that begins there has an earlier place, the longest match from that place is a factor (its
first word, its length, the document and the word in it that it repeats), and the parse goes on behind it; elsewhere one word is passed over.  A match goes on as long as
the next window stands next in the same block.  Windows that cross the end of a factor are in no factor; they are checked one by one.  Factors and the windows found at
their ends, merged, are the duplicate spans.  A parse meets every repeated window: one that begins at a word passed over would have begun a factor.

The reference index is distributed by window hash and built in steps, each of which decides less data exactly:
  1. Documents whose whole word sequence occurs earlier are one factor without a parse.  Only the first of such copies is parsed.
  2. Every window is represented by its anchor, the least hash of the shorter runs of ``GRAM`` words in it.  Equal windows have equal anchors, and
     neighbouring windows mostly share one, so the corpus is indexed with about one anchor per 15 words.  Anchors of a single document are dropped.
  3. Windows with a remaining anchor (a bit filter of fixed size tells; letting through too many costs time only) are aggregated to their
     first place, combined before the shuffle.  That index is written and joined with the windows that may be in it; both sides of the join
     are plain shuffles, so AQE splits the few windows that a large part of the documents has.
  4. The places found go to their documents, which are parsed one by one, and the words removed.
Windows are compared by 64-bit hashes.

Edge cases: a null text has no words; a null id is later than all others, so such rows are parsed against all with an id but never against each
other; rows of the same id never match each other; texts below ``WINDOW`` words lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import materialize, release
from .filters import bit_filter, maybe
from .frames import col, free_name, map_texts, named, row_schema
from .words import Piece, Words, before, covered, mix, per_document, pieces, windows, words

WINDOW = 50
GRAM = 25
_LAST = 2**63 - 1
ROW_HASH = "xxhash64(o, th)"


def anchors(w: Words, size: int, gram: int, at: np.ndarray) -> np.ndarray:
    """For every window (its first word in ``at``): the least hash of the runs of ``gram`` words in it."""
    least = np.zeros(len(w.start), np.uint64)
    where, value = windows(w, gram, 1)
    least[where] = value
    left, reach = size - gram + 1, 1
    while reach < left:
        step = min(reach, left - reach)
        least[:-step] = np.minimum(least[:-step], least[step:])
        reach += step
    return least[at]


def joined(piece: Piece, w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of every document joined by one space, as one buffer, and where each document begins in it."""
    sizes = (w.end - w.start + 1) * keep                    # with a space behind
    ends = before(sizes)
    use = np.zeros(len(piece.data) + 1, np.int8)
    np.add.at(use, w.start[keep], 1)
    np.add.at(use, w.end[keep], -1)
    inside = np.cumsum(use[:-1]) > 0
    out = np.full(int(ends[-1]), 32, np.uint8)
    length = (w.end - w.start)[keep]
    # byte k of the kept words lies k + (number of kept words before it) further on
    out[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = piece.data[inside]
    return out.tobytes(), ends[w.first]


def digests(piece: Piece, w: Words, keep: np.ndarray) -> list[str]:
    data, where = joined(piece, w, keep)
    return [hashlib.sha256(data[a:max(a, b - 1)]).hexdigest() for a, b in zip(where[:-1], where[1:])]


def greedy(at: np.ndarray, block: tuple[np.ndarray, ...], place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of one document: (index of the window that begins each, words in it), and the windows that cross the end of a factor.

    ``at`` are the words, in order, where windows with an earlier place begin; ``block`` tells their documents apart, ``place`` is the word there.
    """
    follows = (np.diff(at) == 1) & (np.diff(place) == 1)
    for part in block:
        follows &= part[1:] == part[:-1]
    stops = np.append(np.flatnonzero(~follows), len(at) - 1)
    end = at[stops[np.searchsorted(stops, np.arange(len(at)))]] + size      # behind the longest match from each window
    begins, k = [], 0
    while k < len(at):
        begins.append(k)
        k = int(np.searchsorted(at, end[k]))
    begins = np.array(begins, np.int64)
    inside = np.searchsorted(begins, np.arange(len(at)), "right") - 1
    return begins, end[begins] - at[begins], np.flatnonzero(at + size > end[begins[inside]])


def _survey(source: DataFrame, size: int, gram: int) -> DataFrame:
    """Per document: words, hashes of the whole sequence, digest of all words, distinct anchors."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column(3)):
                w = words(piece)
                at, _ = windows(w, size, 2)
                owner = w.document[at]
                least = anchors(w, size, gram, at)
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                least, owner = least[new], owner[new]
                lists = [np.unique(x).view(np.int64) for x in np.split(least, np.searchsorted(owner, np.arange(1, piece.n)))]
                whole = []
                for salt in (3, 4):
                    place = (np.arange(len(w.start)) - np.repeat(w.first[:-1], w.counts)).astype(np.uint64)
                    total = before(mix(w.hash + mix(place * np.uint64(2 * salt + 1))).view(np.int64))
                    whole.append(total[w.first[1:]] - total[w.first[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(piece.first, piece.n) for i in range(3)), pa.array(w.counts, pa.int64()), pa.array(whole[0]), pa.array(whole[1]),
                     pa.array(digests(piece, w, np.ones(len(w.start), bool))), pa.array(lists, pa.list_(pa.int64()))],
                    ["row", "o", "th", "n_words", "s1", "s2", "digest", "anchors"])

    return map_texts(source, run, row_schema(source, "o long, th long, n_words long, s1 long, s2 long, digest string, anchors array<long>"))


def _windows(source: DataFrame, size: int, gram: int, firsts: np.ndarray, shared: np.ndarray, repeated: np.ndarray | None = None) -> DataFrame:
    """Window hashes of the documents that may be first of their copies, where the anchor may be shared and the window may be repeated."""
    filters = source.sparkSession.sparkContext.broadcast((firsts, shared, repeated))

    def run(batches):
        firsts, shared, repeated = filters.value
        for batch in batches:
            o, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            may_be_first = maybe(firsts, batch.column(2).to_numpy().view(np.uint64))
            for piece in pieces(batch.column(3)):
                w = words(piece)
                at, value = windows(w, size, 2)
                owner = w.document[at]
                use = may_be_first[piece.first + owner] & maybe(shared, anchors(w, size, gram, at))
                if repeated is not None:
                    use &= maybe(repeated, value)
                at, value, owner = at[use], value[use], owner[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(o[piece.first + owner]), pa.array(th[piece.first + owner]), pa.array((at - w.first[owner]).astype(np.int32))],
                    ["window", "o", "th", "word"])

    return map_texts(source, run, "window long, o long, th long, word int")


def _only(source: DataFrame, members: np.ndarray) -> DataFrame:
    """Rows whose row hash may be a member, so that the others need not be shuffled."""
    shared = source.sparkSession.sparkContext.broadcast(members)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe(shared.value, batch.column("rh").to_numpy().view(np.uint64))))

    hashed = source.withColumn("rh", F.expr(ROW_HASH))
    return map_texts(hashed, run, hashed.schema).drop("rh")


def _parsed(source: DataFrame, hits: DataFrame, size: int, with_text: bool) -> DataFrame:
    """Factors, spans, words removed, digest and, if asked for, text of the documents that have hits."""
    def run(batches):
        for batch in batches:
            hit = batch.column(2)
            first_hit = hit.offsets.to_numpy() - hit.offsets[0].as_py() if len(hit) else np.zeros(1, np.int64)
            flat = hit.flatten()
            word, ref, text, place = (flat.field(name).to_numpy() for name in ("word", "o", "th", "place"))
            for piece in pieces(batch.column(1)):
                w = words(piece)
                remove, factors, spans = np.zeros(len(w.start), bool), [], []
                for d in range(piece.n):
                    mine = slice(first_hit[piece.first + d], first_hit[piece.first + d + 1])
                    order = np.unique(word[mine], return_index=True)[1]         # equal rows bring each place once more
                    at, of, there = word[mine][order].astype(np.int64), ref[mine][order], place[mine][order]
                    begins, length, across = greedy(at, (of, text[mine][order]), there, size)
                    factors.append([{"word": a, "words": n, "reference": r, "place": p} for a, n, r, p in
                                    zip(at[begins].tolist(), length.tolist(), of[begins].tolist(), there[begins].tolist())])
                    n = int(w.counts[d])
                    gone = covered(n, at[begins], length) | covered(n, at[across], size)
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                    spans.append([{"word": a, "words": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                    remove[w.first[d]:w.first[d + 1]] = gone
                columns = [batch.column(0).slice(piece.first, piece.n), pa.array(w.counts, pa.int64()), pa.array(per_document(w, remove), pa.int64()),
                           pa.array(digests(piece, w, ~remove)), pa.array(factors, _FACTORS), pa.array(spans, _SPANS)]
                if with_text:
                    data, where = joined(piece, w, ~remove)
                    columns.append(pa.array([data[a:max(a, b - 1)].decode() for a, b in zip(where[:-1], where[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_removed", "kept_sha256", "factors", "spans", *["kept_text"] * with_text])

    return map_texts(source.join(hits, ["o", "th"]).select("row", "t", "hits"), run,
                     row_schema(source, f"n_words long, n_removed long, kept_sha256 string, factors {_FACTOR_TYPE}, spans {_SPAN_TYPE}" + ", kept_text string" * with_text))


_FACTORS = pa.list_(pa.struct([(name, pa.int64()) for name in ("word", "words", "reference", "place")]))
_SPANS = pa.list_(pa.struct([(name, pa.int64()) for name in ("word", "words")]))
_FACTOR_TYPE = "array<struct<word: bigint, words: bigint, reference: bigint, place: bigint>>"
_SPAN_TYPE = "array<struct<word: bigint, words: bigint>>"


def parse(documents: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", size: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Columns ``keep`` as struct ``row``, n_words, n_removed, kept_sha256 (of the kept words, joined by a space), factors (word, words, and the reference
    document and place they repeat), spans (word, words: what is removed) and, if asked for, ``kept_text`` (null: nothing removed).  Words are numbered from 0."""
    source = documents.select(named(keep).alias("row"), F.coalesce(col(id).cast("long"), F.lit(_LAST)).alias("o"),
                              F.xxhash64(col(text)).alias("th"), col(text).alias("t"))
    slim = source.select("o", "th", F.expr(ROW_HASH).alias("rh"), "t")
    survey = materialize(_survey(source, size, gram), "survey")

    copies = survey.filter(F.col("n_words") >= size).groupBy("s1", "s2", "n_words").agg(F.min("o").alias("first"))
    known = materialize(survey.drop("anchors").join(copies, ["s1", "s2", "n_words"], "left"), "copies")
    copied = F.coalesce(F.col("o") > F.col("first"), F.lit(False))
    firsts = bit_filter(known.filter(F.col("o") == F.col("first")), F.expr(ROW_HASH))
    indexed = _only(survey.filter(F.col("n_words") >= size).select("o", "th", "anchors"), firsts).select("o", F.explode("anchors").alias("anchor"))
    shared = bit_filter(indexed.groupBy("anchor").agg(F.min("o").alias("a"), F.max("o").alias("b")).filter("a < b"), F.col("anchor"))

    found = _windows(slim, size, gram, firsts, shared)
    index = materialize(found.groupBy("window").agg(F.min(F.struct("o", "th", "word")).alias("at"), F.max("o").alias("last")).filter("at.o < last").drop("last"), "index")
    found = _windows(slim, size, gram, firsts, shared, bit_filter(index, F.col("window")))
    hit = F.struct("word", "at.o", "at.th", F.col("at.word").alias("place"))
    hits = materialize(found.join(index, "window").filter("o > at.o").groupBy("o", "th").agg(F.collect_list(hit).alias("hits"))
                       .join(known.filter(~copied).select("o", "th").distinct(), ["o", "th"], "left_semi"), "hits")

    for table in (survey, index):
        release(table)
    parsed = _parsed(_only(source, bit_filter(hits, F.expr(ROW_HASH))), hits, size, with_text)
    none = F.lit(0).cast("long")
    whole = F.when(copied, F.array(F.struct(none.alias("word"), F.col("n_words").alias("words"), F.col("first").alias("reference"), none.alias("place"))))
    span = F.when(copied, F.array(F.struct(none.alias("word"), F.col("n_words").alias("words"))))
    rest = (known.join(hits.select("o", "th"), ["o", "th"], "left_anti")
            .select("row", "n_words", F.when(copied, F.col("n_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
                    F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("digest")).alias("kept_sha256"),
                    whole.otherwise(F.array().cast(_FACTOR_TYPE)).alias("factors"), span.otherwise(F.array().cast(_SPAN_TYPE)).alias("spans"),
                    *([F.when(copied, F.lit("")).alias("kept_text")] if with_text else [])))
    return parsed.unionAll(rest)


def deduplicate(documents: DataFrame, id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut out; a text that loses words keeps the others joined by one space, ``n_chars`` follows if it is there."""
    names = documents.columns
    new = free_name(names, "kept_text")
    out = parse(documents, names, id, text, size, with_text=True).select(*[F.col("row").getField(c).alias(c) for c in names], F.col("kept_text").alias(new))
    fresh = {text: F.coalesce(col(new), col(text))}
    if "n_chars" in names:
        fresh["n_chars"] = F.when(col(new).isNull(), F.col("n_chars")).otherwise(F.length(col(new)).cast(documents.schema["n_chars"].dataType))
    return out.withColumns(fresh).select(*map(col, names))
