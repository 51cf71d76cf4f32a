"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed-language text.

A word is a run of letters (and marks) of one script.  Per language, hashed trigrams of lower-cased letters (word edges included) are counted over all documents of the learning fold, as integers
gathered per task and added up in two shuffles of fixed-size blocks, so reruns agree and no task or driver holds more than the table.  A word's score under a language is the
log-likelihood of its trigrams.  Only languages of whose letters at least ``SCRIPT_SHARE`` are in a word's script are candidates for it (all of them, with
equal scores, if no language knows the script).  The best labelling of the words of a text, less ``PENALTY`` for every change of language, comes from Viterbi over all
words, however many; consecutive words of one label are a span.  The language of a text is the one whose spans hold most letters; the score is their share.

Size: the table has one column per language and 2**16 buckets, halved while it would exceed 2**24 numbers (down to 2**8), so the broadcast is bounded by 64 MB
up to 65,536 languages.

Edge cases: a null text is empty; a text without a letter is ``und`` with score 0, and so is every text if there is nothing to learn from; equal scores go to the language
first in code-point order; a null id counts as held out and is not learned from; repeated rows count as often as they occur; null languages are not learned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import added
from .frames import col, map_texts, named, row_schema
from .words import mix

# fixed values: first code point of each range and the script of its letters (public Unicode blocks)
SCRIPTS = [
    (0x0000, "Latin"), (0x0250, "Other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"),
    (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Katakana"), (0x3200, "Other"), (0x3400, "Han"),
    (0x4DC0, "Other"), (0x4E00, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Katakana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
NAMES = sorted({name for _, name in SCRIPTS} - {"Other"})

PENALTY = 12.0
SCRIPT_SHARE = 0.02
SMOOTHING = 0.5
FOLDS, HELD_OUT = 3, 1
_BLOCK = 1 << 12            # numbers per block of the gathered table
_LETTERS_A_PIECE = 4_000_000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: 2 for a letter, 1 for a mark, else 0; its lower case; its script (0 for none, else place in NAMES + 1)."""
    kinds, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LM":
            kinds[point] = 2 if kind == "L" else 1
            low = chr(point).lower()
            if len(low) == 1:
                lower[point] = ord(low)
    starts = np.array([s for s, _ in SCRIPTS])
    ids = np.array([0 if name == "Other" else NAMES.index(name) + 1 for _, name in SCRIPTS], np.uint8)
    scripts = ids[np.searchsorted(starts, np.arange(0x110000), "right") - 1]
    scripts[kinds < 2] = 0
    return kinds, lower, scripts


@dataclass
class Letters:
    """Words of some texts: ``gram`` bucket of each of their characters, where each word begins among those, its range in the text, its script, its letters; and the first word of each text."""
    gram: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    size: np.ndarray
    first: np.ndarray

    @property
    def word_of_gram(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, len(self.gram))))


def read(texts: list[str], bits: int) -> Letters:
    kinds, lower, scripts = _tables()
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    at = np.flatnonzero(kind)
    script = scripts[points[at]]
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    new |= edge[at]
    change = np.zeros(len(at), bool)
    change[1:] = (script[1:] != script[:-1]) & (script[1:] > 0) & (script[:-1] > 0)
    new |= change
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    low = lower[points[at]].astype(np.uint64)
    before, after = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[begin] = 0
    after[last] = 0
    gram = (mix((before << np.uint64(42)) | (low << np.uint64(21)) | after) >> np.uint64(64 - bits)).astype(np.int64)
    size = np.add.reduceat((kind[at] == 2).astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    known = np.maximum.reduceat(script, begin).astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    where = at[begin]
    first = np.searchsorted(where, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Letters(gram, begin, where - offsets[owner], at[last] + 1 - offsets[owner], known, size, first)


def _portions(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of at most ``_LETTERS_A_PIECE`` characters, or one text; a null is empty."""
    first, run, held = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and held + len(t) > _LETTERS_A_PIECE:
            yield first, run
            first, run, held = i, [], 0
        run.append(t)
        held += len(t)
    if run:
        yield first, run


@dataclass
class Model:
    """Languages in code-point order, log-probability of each bucket (row) under each (column), and which scripts (row) each is written in."""
    languages: list[str]
    bits: int
    logs: np.ndarray
    allowed: np.ndarray

    def scores(self, words: Letters) -> np.ndarray:
        """Score of every word under every language; minus infinity for those that its script rules out."""
        if not len(words.begin):
            return np.zeros((0, len(self.languages)))
        out = np.empty((len(words.begin), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.logs[words.gram, k], words.begin, dtype=np.float64)
        may = self.allowed[words.script]
        known = may.any(axis=1)
        out[~may] = -np.inf
        out[~known] = 0.0
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of every word: texts run side by side, one word of each at a step, the longest first."""
    labels = np.zeros(len(scores), np.int64)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    steps, at = int(lengths.max(initial=0)), first[:-1][order]
    if not steps:
        return labels
    running = np.searchsorted(-lengths[order], -np.arange(steps), "left")        # texts with more than t words
    total = scores[at[:running[0]]]
    stays, came = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
    for t in range(1, steps):
        k = running[t]
        here, have = at[:k] + t, total[:k]
        best = have.argmax(axis=1)
        leave = have[np.arange(k), best] - penalty
        stay = have >= leave[:, None]
        total[:k] = np.where(stay, have, leave[:, None]) + scores[here]
        stays[here], came[here] = stay, best
    label = total.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = running[t]
        here = at[:k] + t
        labels[here] = label[:k]
        if t:
            label[:k] = np.where(stays[here, label[:k]], label[:k], came[here])
    return labels


def fold(id: Column) -> Column:
    """Whether an id is held out from learning."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def learn(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", share: float = SCRIPT_SHARE) -> Model | None:
    """The model of all languages of the learning fold; None if there is none."""
    rows = documents.select(col(text).alias("t"), col(lang).cast("string").alias("l")).filter(~fold(col(id)) & F.col("l").isNotNull() & F.col("t").isNotNull())
    languages = sorted(r[0] for r in rows.select("l").distinct().collect())
    if not languages:
        return None
    bits, n = 16, len(languages)
    while bits > 8 and (n << bits) > 1 << 24:
        bits -= 1
    place = {name: k for k, name in enumerate(languages)}
    size = n * ((1 << bits) + len(NAMES) + 1)

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, texts in _portions(batch.column(0).to_pylist()):
                words = read(texts, bits)
                of = np.repeat(np.array([place[x] for x in names[first:first + len(texts)]], np.int64), np.diff(words.first))
                grams = np.bincount(words.gram * n + of[words.word_of_gram], minlength=n << bits)
                letters = np.bincount(words.script * n + of, weights=words.size, minlength=n * (len(NAMES) + 1))
                counts += np.concatenate([grams, letters.astype(np.int64)])
        salt = TaskContext.get().partitionId()
        used = [b for b in range(-(-size // _BLOCK)) if counts[b * _BLOCK:(b + 1) * _BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([salt] * len(used), pa.int32()),
                                          pa.array([counts[b * _BLOCK:(b + 1) * _BLOCK].tobytes() for b in used], pa.binary())], ["block", "salt", "sums"])

    counts = np.zeros(size, np.int64)
    for r in added(map_texts(rows, run, "block int, salt int, sums binary")).toLocalIterator():
        part = np.frombuffer(r["sums"], np.int64)
        counts[r["block"] * _BLOCK:r["block"] * _BLOCK + len(part)] += part
    grams, letters = counts[:n << bits].reshape(-1, n).astype(float), counts[n << bits:].reshape(-1, n).astype(float)
    logs = np.log(grams + SMOOTHING) - np.log(grams.sum(axis=0) + SMOOTHING * len(grams))
    allowed = letters >= share * np.maximum(letters.sum(axis=0), 1)
    allowed[0] = False                               # letters of no listed script tell nothing
    return Model(languages, bits, np.asfortranarray(logs, np.float32), allowed)


def identify(documents: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Columns ``keep`` (all by default) as struct ``row``, ``spans`` (start, end in code points, lang), ``lang_pred``, ``score``, and ``n_letters``."""
    source = documents.select(named(keep if keep is not None else documents.columns).alias("row"), col(text).cast("string").alias("t"))
    shared = source.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches):
        learned = shared.value
        for batch in batches:
            for first, texts in _portions(batch.column(1).to_pylist()):
                words = read(texts, learned.bits if learned else 16)
                n, count = len(learned.languages) if learned else 0, len(texts)
                owner = np.repeat(np.arange(count), np.diff(words.first))
                letters = np.bincount(owner, weights=words.size, minlength=count).astype(np.int64)
                if learned:
                    scores = learned.scores(words)
                    label = viterbi(scores, words.first, penalty)
                    held = np.bincount(owner * n + label, weights=words.size, minlength=count * n).reshape(count, n)
                    chosen = held.argmax(axis=1)
                    score = np.where(letters > 0, held.max(axis=1) / np.maximum(letters, 1), 0.0)
                    names = [learned.languages[c] if m else "und" for c, m in zip(chosen, letters)]
                    new = np.ones(len(label), bool)
                    new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                    begin = np.flatnonzero(new)
                    last = np.append(begin[1:], len(label)) - 1 if len(begin) else begin
                    values = pa.StructArray.from_arrays([pa.array(words.start[begin]), pa.array(words.end[last]),
                                                         pa.array([learned.languages[k] for k in label[begin]], pa.string())], fields=list(span))
                    offsets = np.searchsorted(owner[begin], np.arange(count + 1)).astype(np.int32)
                else:
                    score, names = np.zeros(count), ["und"] * count
                    values, offsets = pa.array([], span), np.zeros(count + 1, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(names, pa.string()),
                                                  pa.array(score), pa.array(letters)], ["row", "spans", "lang_pred", "score", "n_letters"])

    return map_texts(source, run, row_schema(source, "spans array<struct<start:long,end:long,lang:string>>, lang_pred string, score double, n_letters long"))


def predict(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score and n_spans of every document, learned from those that are not held out."""
    found = identify(documents, learn(documents, id, text, lang), [id], text)
    of = F.col("row").getField(id)
    return found.select(of.alias(id), fold(of).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
