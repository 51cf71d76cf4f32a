"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over every word window of the documents.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.  A window is ``size`` consecutive
words of an item; a shorter item is one window.  A document window whose hash is in the set is verified word by word against
the benchmark window, so the result does not rest on hashes.

The set is broadcast only while it is provably small: the windows are counted first, and no more than ``SET_BYTES`` are sent.
For a larger benchmark a bit filter of fixed size picks document windows, which then meet the benchmark's in a join.

Edge cases: a null text, of a document or an item, has no words; an item without words has no window; a null item_id marks words but
is not counted among the items; repeated documents are judged one by one; repeated items count once; without benchmark rows nothing is hit.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import materialize
from .frames import col, free_name, map_texts, named, row_schema, unpack
from .words import LETTERS_AND_DIGITS, LOWER, Piece, Words, covered, per_document, pieces, windows, words

SIZE = 10
SET_BYTES = 64_000_000
_FILTER_BITS = 22
_WIDE_BITS = 28


def _lowered(piece: Piece) -> Piece:
    return Piece(piece.first, LOWER[piece.data], piece.offsets)


def _phrase(piece: Piece, w: Words, at: int, size: int) -> bytes:
    return b" ".join(piece.data[a:b].tobytes() for a, b in zip(w.start[at:at + size], w.end[at:at + size]))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct window: its number of words, hash, words, and the items that contain it."""
    source = benchmark.select(col(item).cast("string").alias("item"), col(text).alias("t"))

    def run(batches):
        for batch in batches:
            items = batch.column(0).to_pylist()
            for piece in map(_lowered, pieces(batch.column(1))):
                w = words(piece, LETTERS_AND_DIGITS)
                rows = []
                for length in sorted({min(int(n), size) for n in w.counts if n}):
                    at, value = windows(w, length)
                    owner = w.document[at]
                    fits = np.minimum(w.counts[owner], size) == length
                    rows += [(items[piece.first + d], length, int(h), _phrase(piece, w, a, length))
                             for d, a, h in zip(owner[fits], at[fits], value[fits].view(np.int64))]
                yield pa.RecordBatch.from_pylist([dict(zip(("item", "length", "hash", "phrase"), r)) for r in rows],
                                                 pa.schema([("item", pa.string()), ("length", pa.int32()), ("hash", pa.int64()), ("phrase", pa.binary())]))

    found = map_texts(source, run, "item string, length int, hash long, phrase binary")
    return found.groupBy("length", "hash", "phrase").agg(F.collect_set("item").alias("items"))


class WindowSet:
    """Benchmark windows by length: sorted hashes, a bit filter before the search, and the words that verify a hit."""

    def __init__(self, rows):
        self.phrases: dict[tuple[int, int], list[tuple[bytes, list[str]]]] = defaultdict(list)
        hashes = defaultdict(set)
        for length, value, phrase, items in rows:
            self.phrases[length, value % 2**64].append((phrase, items))
            hashes[length].add(value % 2**64)
        self.hashes = {n: np.array(sorted(h), np.uint64) for n, h in hashes.items()}
        self.filters = {}
        for n, h in self.hashes.items():
            self.filters[n] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[n][h >> np.uint64(64 - _FILTER_BITS)] = True

    def scan(self, piece: Piece) -> tuple[Words, list[tuple[int, int, int, list[str]]]]:
        """Words of the piece and its verified hits: (document, first word, length, items)."""
        w = words(piece, LETTERS_AND_DIGITS)
        document, hits = w.document, []
        for n, known in self.hashes.items():
            at, value = windows(w, n)
            maybe = np.flatnonzero(self.filters[n][value >> np.uint64(64 - _FILTER_BITS)])
            at, value = at[maybe], value[maybe]
            where = np.minimum(np.searchsorted(known, value), len(known) - 1)
            same = known[where] == value
            for a, h in zip(at[same].tolist(), value[same].tolist()):
                text = _phrase(piece, w, a, n)
                hits += [(int(document[a]), a, n, items) for phrase, items in self.phrases[n, h] if phrase == text]
        return w, hits


_SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in ("word", "words", "byte", "byte_end")]))
_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<word: bigint, words: bigint, byte: bigint, byte_end: bigint>>"


def _report(row: pa.Array, piece: Piece, w: Words, hits) -> pa.RecordBatch:
    """Counts, items and spans of each document from its hits (document, first word, length, items)."""
    marked = np.zeros(len(w.start), bool)
    items: dict[int, set] = defaultdict(set)
    by_length = defaultdict(set)
    for d, a, n, found in hits:
        by_length[n].add(a)
        items[d].update(found)
    for n, at in by_length.items():
        marked |= covered(len(w.start), np.array(sorted(at)), n)
    document = w.document
    follows = np.zeros(len(marked), bool)      # the word before is marked too, and of the same document
    follows[1:] = marked[:-1] & (document[1:] == document[:-1])
    begins = np.flatnonzero(marked & ~follows)
    ends = np.flatnonzero(marked & ~np.append(marked[1:] & follows[1:], False)) if len(marked) else begins
    spans = [[] for _ in range(piece.n)]
    for a, b in zip(begins.tolist(), ends.tolist()):
        d = document[a]
        spans[d].append({"word": a - w.first[d], "words": b - a + 1, "byte": w.start[a] - piece.offsets[d], "byte_end": w.end[b] - piece.offsets[d]})
    return pa.RecordBatch.from_arrays(
        [row.slice(piece.first, piece.n), pa.array(w.counts, pa.int64()), pa.array(per_document(w, marked), pa.int64()),
         pa.array([sorted(items[d]) if d in items else [] for d in range(piece.n)], pa.list_(pa.string())), pa.array(spans, _SPANS)],
        ["row", "n_words", "n_hit", "items", "spans"])


def _scan_broadcast(source: DataFrame, rows: list) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast([(r["length"], r["hash"], bytes(r["phrase"]), list(r["items"])) for r in rows])

    def run(batches):
        known = WindowSet(shared.value)
        for batch in batches:
            for piece in map(_lowered, pieces(batch.column(1))):
                yield _report(batch.column(0), piece, *known.scan(piece))

    return map_texts(source, run, row_schema(source, _FOUND))


def _scan_join(source: DataFrame, known: DataFrame) -> DataFrame:
    """For benchmarks beyond the broadcast bound: windows that pass a bit filter of fixed size are joined with the benchmark's."""
    place = F.shiftrightunsigned("hash", 64 - _WIDE_BITS) + 1      # bitmap buckets count from 1
    filter_rows = (known.select("length", place.alias("p")).groupBy("length", F.bitmap_bucket_number("p").alias("bucket"))
                   .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())
    filters = {}
    for r in filter_rows:
        bits = filters.setdefault(r["length"], np.zeros(1 << (_WIDE_BITS - 3), np.uint8))
        at = (r["bucket"] - 1) * 4096
        bits[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(filters)

    def candidates(batches):
        for batch in batches:
            for piece in map(_lowered, pieces(batch.column(1))):
                w, rows = words(piece, LETTERS_AND_DIGITS), []
                ids = batch.column(0).slice(piece.first, piece.n).to_pylist()
                for n, bits in shared.value.items():
                    at, value = windows(w, n)
                    bit = (value >> np.uint64(64 - _WIDE_BITS)).astype(np.int64)
                    keep = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    owner = w.document[at]
                    rows += [{"text_id": ids[owner[k]], "word": int(at[k] - w.first[owner[k]]), "length": n, "phrase": _phrase(piece, w, at[k], n)}
                             for k in np.flatnonzero(keep)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("text_id", pa.string()), ("word", pa.int64()), ("length", pa.int32()), ("phrase", pa.binary())]))

    named_texts = source.withColumn("text_id", F.sha2("t", 256))
    hits = (map_texts(named_texts.select("text_id", "t"), candidates, "text_id string, word long, length int, phrase binary").distinct()
            .join(known.select("length", "phrase", "items"), ["length", "phrase"])
            .groupBy("text_id").agg(F.collect_list(F.struct("word", "length", "items")).alias("hits")))

    def run(batches):
        for batch in batches:
            hits = batch.column(2).to_pylist()
            for piece in map(_lowered, pieces(batch.column(1))):
                w = words(piece, LETTERS_AND_DIGITS)
                yield _report(batch.column(0), piece, w, [(d, w.first[d] + h["word"], h["length"], h["items"])
                                                          for d in range(piece.n) for h in hits[piece.first + d] or []])

    return map_texts(named_texts.join(hits, "text_id", "left").select("row", "t", "hits"), run, row_schema(source, _FOUND))


def scan(documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", size: int = SIZE, set_bytes: int = SET_BYTES) -> DataFrame:
    """Columns ``keep`` as struct ``row``, with n_words, n_hit, the sorted ids of the items found, and the spans of words hit.

    A span counts words from 0 and bytes of the UTF-8 text, ends exclusive.
    """
    known = materialize(benchmark_windows(benchmark, size), "benchmark-windows")
    total = known.agg(F.sum(F.length("phrase") + 64 + 16 * F.size("items"))).first()[0] or 0
    source = documents.select(named(keep).alias("row"), col(text).alias("t"))
    return _scan_broadcast(source, known.collect()) if total <= set_bytes else _scan_join(source, known)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", size: int = SIZE,
                  set_bytes: int = SET_BYTES) -> DataFrame:
    """The documents without those that contain a benchmark window, or with such ``spans`` cut out of their texts."""
    names = documents.columns
    found = scan(documents, benchmark, names, text, size, set_bytes)
    if remove == "documents":
        return found.filter("n_hit = 0").select(*unpack("row", names))
    raw = F.col("row").getField(text).cast("binary")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("spans", lambda s: F.array(s.byte, s.byte_end))), F.array(F.length(raw).cast("long")))
    pairs = F.sequence(F.lit(0), F.size("spans"))
    rest = F.transform(pairs, lambda i: F.substring(raw, (F.get(edges, 2 * i) + 1).cast("int"), (F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)).cast("int")).cast("string"))
    cut = free_name(names, "cut")
    out = found.select("row", F.when(F.size("spans") > 0, F.array_join(rest, "")).alias(cut)).select(*unpack("row", names), cut)
    fresh = {text: F.coalesce(cut, col(text))}
    if "n_chars" in names:
        fresh["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(cut).cast(documents.schema["n_chars"].dataType))
    return out.withColumns(fresh).select(*map(col, names))
