"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies, its source's target size over the source's size.  The whole part is taken
outright; the fractional parts are settled by the pivotal method, weighted by size: two documents trade mass, in words, until
one of them is taken once more or not at all, the direction drawn so that every expectation is kept.  The words a source takes
therefore differ from its target by less than one document, although every document is drawn at random.

Blocks of about ``BLOCK`` documents of a source are settled by one task each and leave at most one document undecided.  These
meet in blocks of their own, level by level (a tree of fan-in ``FAN``), so no task ever sees a source as a whole.  The draws come from a
hash of the document and the level: reruns agree, wherever the rows lie.

Edge cases: a null text has size 0; null sources form one source, sorted last; documents without words take part with no words;
rows equal in every column (maps left out) are one unit with a multiplicity, settled together and shared out evenly, so a third of all rows
being equal costs one row; with a total of 0 words all targets are 0; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..scratch import materialize
from .frames import col, free_name, named

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5             # words of the mix per word of the input
MOST = 2.0              # copies of a document at most
BLOCK = 512
FAN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of every source.

    The number of sources is not bounded, so the level at which targets stop is found in Spark: with sources ordered by size per
    weight, those that stop are a prefix, and one running sum tells which.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    # when those with the least size per weight have stopped, the rest share what is left
    by_need = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    earlier, later = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((share * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
             / F.sum("weight").over(later))
    ranked = (by_source.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn.cast("int")))
              .withColumn("level", level).withColumn("place", F.row_number().over(by_need)))
    free = F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct("place", "level"))).over(everything)
    full = most * F.col("source_size")
    return (ranked.withColumn("free", F.coalesce(free["level"], F.lit(float("inf"))))
            .select("source", "source_size", "units", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("free") * F.col("weight"), full)).alias("target")))


def settle(p: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Pair fractional probabilities until all but one are 0 or 1; the index of that one, or -1."""
    p, words, draws = p.tolist(), words.tolist(), rng.random(len(p)).tolist()
    open_ = -1
    for i, q in enumerate(p):
        if not 0 < q < 1:
            continue
        if words[i] == 0:
            p[i] = float(draws[i] < q)
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = words[open_], words[i]
        fill, give = (1 - p[open_]) * a, q * b                # words the first lacks, and the second has
        empty, room = p[open_] * a, (1 - q) * b               # the other way round
        up, down = min(fill, give), min(empty, room)
        if draws[i] * (up + down) < down:
            p[open_], p[i] = (1.0, (give - fill) / b) if fill <= give else ((empty + give) / a, 0.0)
        else:
            p[open_], p[i] = (0.0, (give + empty) / b) if empty <= room else ((empty - room) / a, 1.0)
        if 0 < p[i] < 1:
            open_ = i
        elif not 0 < p[open_] < 1:
            open_ = -1
    return np.array(p), open_


def _round(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """One level of the tree: settle every (source, block); what stays undecided keeps a null ``more``."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k1", "ascending"), ("k2", "ascending")])
        keys = table.column("k1").to_numpy()
        rng = np.random.default_rng([seed, level, int(keys[0]) % 2**64, len(keys)])
        p, rest = settle(table.column("p").to_numpy(), table.column("size").to_numpy(), rng)
        if rest >= 0 and last:
            p[rest] = float(rng.random() < p[rest])
            rest = -1
        more = pa.array(np.where((p > 0) & (p < 1), -1, p).astype(np.int64), pa.int64(), mask=np.arange(len(p)) == rest)
        names = table.column_names
        return table.set_column(names.index("p"), "p", pa.array(p)).set_column(names.index("more"), "more", more)

    return rows.groupBy("source", "block").applyInArrow(run, rows.schema)


def with_keys(documents: DataFrame) -> tuple[DataFrame, str, str]:
    """Two hashes of the whole row, in columns of free names."""
    k1, k2 = free_name(documents.columns, "k1"), free_name(documents.columns, "k2")
    plain = [f.name for f in documents.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = named(plain)
    return documents.withColumns({k1: F.xxhash64(row), k2: F.xxhash64(F.lit(1), row)}), k1, k2


def copies(documents: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE,
           most: float = MOST, seed: int = 11, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per distinct row of ``documents``: k1, k2, id, source, size, m (how often it occurs), source_size, target, taken_copies (of all m)."""
    keyed, k1, k2 = with_keys(documents)
    units = materialize(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), col(id).alias("id"), col(source).cast("string").alias("source"),
                                     word_count(col(text)).alias("size"))
                        .groupBy("k1", "k2", "id", "source", "size").agg(F.count("*").alias("m")), "mix-units")
    goal = materialize(targets(units, weights, share, most), "mix-targets")
    blocks = F.ceil(F.col("units") / block)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("m")
    rows = (units.join(goal, units["source"].eqNullSafe(goal["source"])).drop(goal["source"])
            .withColumn("whole", F.floor(rate)).withColumn("p", rate - F.col("whole")).withColumn("block", F.pmod("k1", blocks.cast("long")))
            .withColumn("more", F.lit(None).cast("long")).drop("units"))
    widest = goal.agg(F.max(blocks)).first()[0] or 1
    done, level = [], 0
    while True:
        last = widest <= 1
        rows = materialize(_round(rows, level, last, seed), "mix-level")
        done.append(rows.filter("more IS NOT NULL"))
        if last:
            break
        rows = rows.filter("more IS NULL").withColumn("block", F.floor(F.col("block") / fan))
        widest, level = -(-widest // fan), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.withColumn("taken_copies", F.col("whole") + F.col("more")).drop("whole", "more", "p", "block")


def per_row(units: DataFrame) -> DataFrame:
    """The units of ``copies`` as one row per document row, with its own share as ``copies``."""
    i = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("i")
    even, rest = F.floor(F.col("taken_copies") / F.col("m")), F.col("taken_copies") % F.col("m")
    return units.select("*", i).withColumn("copies", even + (F.col("i") <= rest).cast("long")).drop("i")


def mix(documents: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    names = documents.columns
    taken = copies(documents, **settings).filter("taken_copies > 0").select("k1", "k2", "taken_copies")
    keyed, k1, k2 = with_keys(documents)
    whole = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), named(names).alias("row"))
    once = whole.join(taken, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("row").alias("row"), F.first("taken_copies").alias("n"))
    return (once.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select(*[F.col("row").getField(c).alias(c) for c in names]))
