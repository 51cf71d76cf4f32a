"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network in numpy, calibrated by a temperature.

Tokens are runs of letters and digits, and runs of other visible characters, case kept; they fall into ``BUCKETS`` buckets by hash.  Every bucket has a sparse random index
vector (``NONZERO`` entries of +1 or -1 among ``DIMENSIONS``); the context vector of a bucket is the sum of the index vectors of its neighbours up to ``REACH`` tokens away, over
all documents.  The sums are integers, gathered per task and added up in two shuffles of fixed-size blocks, so neither the vocabulary nor the corpus bounds them and reruns
agree.  The finished table (``BUCKETS`` x ``DIMENSIONS``) is of fixed size and is broadcast.

A document is the mean and the spread of its tokens' vectors, how alike vectors a few tokens apart are, and the logarithm of its length.  The network is trained on the driver from at most ``MOST_ROWS`` labelled rows, those with the least hash of the
id; a fifth of them only sets the temperature.  Only the text enters a score.

Edge cases: a null or blank text has zero vectors and still gets a score; labels that are null are left out, repeated ones count once, an id with both labels counts for both; without
labels, or with one label only, every score is the smoothed share of label 1; null ids count as held out; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark import TaskContext

from ..scratch import materialize
from .frames import col, map_texts, named, row_schema
from .words import Piece, pieces, range_hash

BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 2
REACH = 2
MOST_ROWS = 20_000
HIDDEN = 24
EPOCHS = 30
FOLDS = 5
_BLOCK = 256            # buckets per block of the gathered table
_SALTS = 16
LAGS = 3                # distances at which neighbouring vectors are compared
WIDTH = 2 * DIMENSIONS + LAGS + 1
_SLICE = 100_000        # tokens held as vectors at a time

_KIND = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every bucket's index vector."""
    random = np.random.default_rng(seed)
    return random.integers(0, DIMENSIONS, (NONZERO, BUCKETS)), random.choice(np.array([-1.0, 1.0]), (NONZERO, BUCKETS))


def tokens(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token, and where each document begins among them."""
    kind = _KIND[piece.data]
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[piece.offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    used = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[used], end[used]
    value = range_hash(piece.data, start, end)
    return (value >> np.uint64(64 - 14)).astype(np.int64), np.searchsorted(start, piece.offsets)


def _gather(texts: DataFrame) -> DataFrame:
    """Context sums of each task: block, salt, sums of its buckets and their counts."""
    def run(batches):
        places, signs = index_vectors()
        sums, counts = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                bucket, first = tokens(piece)
                counts += np.bincount(bucket, minlength=BUCKETS)
                owner = np.repeat(np.arange(piece.n), np.diff(first))
                for far in range(1, REACH + 1):
                    same = owner[far:] == owner[:-far]
                    a, b = bucket[:-far][same], bucket[far:][same]
                    for one, other in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            sums += np.bincount(one * DIMENSIONS + places[k][other], weights=signs[k][other], minlength=len(sums))
        table = np.concatenate([sums.reshape(BUCKETS, DIMENSIONS), counts[:, None]], axis=1).astype(np.int64)
        blocks = [b for b in range(BUCKETS // _BLOCK) if counts[b * _BLOCK:(b + 1) * _BLOCK].any()]
        salt = TaskContext.get().partitionId() % _SALTS
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([salt] * len(blocks), pa.int32()),
                                          pa.array([table[b * _BLOCK:(b + 1) * _BLOCK].tobytes() for b in blocks], pa.binary())], ["block", "salt", "sums"])

    return map_texts(texts, run, "block int, salt int, sums binary")


def _added(parts: DataFrame) -> DataFrame:
    """Blocks of one partition added up, one at a time as they arrive."""
    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, salt, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(data.as_buffer(), np.int64)
                total[block, salt] = total[block, salt] + part if (block, salt) in total else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
                                          pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "salt", "sums"])

    return map_texts(parts, run, "block int, salt int, sums binary")


def context_vectors(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Vectors of all buckets: mean context, less the mean of the corpus, drawn to zero for rare buckets."""
    parts = _gather(documents.select(col(text).alias("t")))
    salted = _added(parts.repartition("block", "salt"))
    whole = _added(salted.select("block", F.lit(0).alias("salt"), "sums").repartition("block"))
    table = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
    for r in whole.collect():
        table[r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK] += np.frombuffer(r["sums"], np.int64).reshape(_BLOCK, DIMENSIONS + 1)
    counts = table[:, -1:].astype(float)
    mean = table[:, :-1].sum(axis=0) / max(counts.sum(), 1)
    return ((table[:, :-1] - counts * mean) / (counts + 5)).astype(np.float32)


def pooled(documents: DataFrame, keep: list[str], vectors: np.ndarray, text: str = "text") -> DataFrame:
    """Columns ``keep`` as struct ``row``, and ``features``: mean and spread of the token vectors, likeness at each lag, log of the length."""
    source = documents.select(named(keep).alias("row"), col(text).alias("t"))
    shared = source.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        table = shared.value
        for batch in batches:
            for piece in pieces(batch.column(1)):
                bucket, first = tokens(piece)
                owner = np.repeat(np.arange(piece.n), np.diff(first))
                total, squares, alike = np.zeros((piece.n, DIMENSIONS)), np.zeros((piece.n, DIMENSIONS)), np.zeros((piece.n, LAGS))
                for a in range(0, len(bucket), _SLICE):
                    vector, of = table[bucket[a:a + _SLICE + LAGS]], owner[a:a + _SLICE + LAGS]
                    size = min(_SLICE, len(bucket) - a)
                    begin = np.flatnonzero(np.append(True, of[1:size] != of[:size - 1]))
                    for k in range(1, LAGS + 1):
                        m = min(size, len(of) - k)
                        if m > 0:
                            near = np.einsum("ij,ij->i", vector[:m], vector[k:k + m], dtype=np.float64) * (of[:m] == of[k:k + m])
                            alike[:, k - 1] += np.bincount(of[:m], weights=near, minlength=piece.n)
                    vector, of = vector[:size], of[:size]
                    total[of[begin]] += np.add.reduceat(vector, begin, axis=0, dtype=np.float64)
                    squares[of[begin]] += np.add.reduceat(vector * vector, begin, axis=0, dtype=np.float64)
                count = np.diff(first)[:, None]
                n = np.maximum(count, 1)
                mean = total / n
                features = np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean ** 2, 0)), alike / (squares.sum(axis=1, keepdims=True) + 1e-9), np.log1p(count)],
                                          axis=1).astype(np.float32)
                offsets = np.arange(piece.n + 1, dtype=np.int32) * features.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(features.ravel()))],
                                                 ["row", "features"])

    return map_texts(source, run, row_schema(source, "features array<float>"))


@dataclass
class Network:
    """Two layers; scores are probabilities of label 1."""
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Fit on four fifths of the rows, set the temperature on the others."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    held, rows = order[:len(x) // 5], order[len(x) // 5:]
    d = x.shape[1]
    prior = (y.sum() + 1) / (len(y) + 2)
    net = Network(x[rows].mean(axis=0) if len(rows) else np.zeros(d), x[rows].std(axis=0) + 1e-6 if len(rows) else np.ones(d), random.normal(0, d ** -0.5, (d, hidden)),
                  np.zeros(hidden), np.zeros(hidden), float(np.log(prior / (1 - prior))))
    if len(np.unique(y[rows])) < 2:
        return net
    net.w2 = random.normal(0, hidden ** -0.5, hidden)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    z = (x - net.shift) / net.scale
    t = 0
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(rows), max(1, len(rows) // 128)):
            h = np.tanh(z[batch] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -30, 30))) - y[batch]) / len(batch)
            back = np.outer(error, weights[2]) * (1 - h * h)
            gradients = [z[batch].T @ back + 1e-3 * weights[0], back.sum(axis=0), h.T @ error + 1e-3 * weights[2], np.array([error.sum()])]
            t += 1
            for i, g in enumerate(gradients):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] -= 0.005 * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if len(np.unique(y[held])) == 2:
        logit, truth = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        net.temperature = float(grid[np.argmin([np.logaddexp(0, np.where(truth > 0, -1, 1) * logit / g).mean() for g in grid])])
    return net


def fold(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(features: DataFrame, labels: DataFrame, id: str, label: str, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` labelled rows outside fold 0, those with the least hash of the id."""
    marked = labels.select(col(id).alias("id"), col(label).cast("double").alias("y")).dropna().filter(fold(F.col("id")) != 0).distinct()
    few = marked.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = features.select(F.col("row").getField(id).alias("id"), "features").join(few, "id").orderBy(F.xxhash64("id"), "id", "y", F.xxhash64("features")).limit(2 * most)
    table = rows.select("features", "y").toArrow()
    flat = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)
    return flat.reshape(-1, WIDTH).astype(float), table.column("y").to_numpy().astype(float)


def classify(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3,
             most: int = MOST_ROWS) -> DataFrame:
    """id, held_out, score and predicted of every document."""
    features = materialize(pooled(documents, [id], context_vectors(documents, text), text), "features")
    net = train(*training_rows(features, labels, id, label, most))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net(x.astype(float)))], ["row", "score"])

    scored = features.mapInArrow(run, row_schema(features, "score double"))
    return scored.select(F.col("row").getField(id).alias(id), (fold(F.col("row").getField(id)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
