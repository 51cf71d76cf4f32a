"""Line deduplication across documents: exact repeats, and lines within a few edits of an earlier line.  DataFrame functions only.

A line is what stands between line breaks and holds a word.  Lines are ordered by document id, text hash and line number.  A line is removed if an equal line comes earlier, or
one within the edits (insertions, deletions, substitutions of code points) that ``ALLOWED`` grants to the shorter of both: they grow with the length, one from 12 characters, two from 30.
Of shorter lines only equal ones are repeats: an edit would make one word of two.

Segment-partition join: a line is split into one segment more than its edits.  Of two lines that near at least one segment of the shorter is found unchanged in the
longer, at a place that differs by no more than the edits allow on either side.  The shorter line is indexed under (its length, segment number, segment), the longer
probes with its substrings at those places, for each length that is close enough.  Candidates are verified by a banded bit-parallel edit
distance: the 2 * EDITS + 1 cells of a column are bits of one number that slides along the diagonal.

Keys are first aggregated without texts, and only lines that share one are looked at again, as one row per text.  Segments that more than ``HOT`` lines share are keyed a second time, by halves of the other segments, of which at
least one must be unchanged too, so a common beginning or end of lines does not pair all that have it.  Lines pair only if the counts of their characters, and of
neighbouring characters, are odd for nearly the same ones.  Lines are told apart by 64-bit hashes.

Edge cases: a null text has no lines; a null id comes after all others; rows equal in id and text are judged alike, none is earlier than the other; blank lines are never
removed; an empty table gives an empty result; other columns are carried or ignored as asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import materialize, materialize_with, release
from .frames import col, free_name, named, unpack

ALLOWED = ((12, 1), (30, 2))     # from so many characters so many edits
EDITS = 2
HOT = 200
BROADCAST_ROWS = 500_000    # rows of one or two numbers
_LAST = 2**63 - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def banded_distance(pattern: Column, text: Column, edits: int = EDITS) -> Column:
    """Edit distance of two strings of at least ``edits`` characters, exact up to ``edits``; anything more if it is larger.

    Bit b of a column stands for the row b - edits behind the diagonal; ``up`` and ``down`` mark rows that exceed the row above by 1 or -1.  The distance is followed along the
    lower edge of the band down to the last row, then along that row.
    """
    band = (1 << (2 * edits + 1)) - 1
    long_ = lambda v: F.lit(v).cast("long")
    start = F.struct(long_(((1 << (edits + 1)) - 1) << edits).alias("up"), long_(0).alias("down"), long_(edits).alias("d"))

    def column(p: Column, t: Column, m: Column, state: Column, j: Column) -> Column:
        equal = long_(0)
        letter = F.get(t, j - 1)
        for b in range(2 * edits + 1):
            i = j - 1 - edits + b
            equal = equal + F.when((i >= 0) & (F.get(p, F.greatest(i, F.lit(0))) == letter), long_(1 << b)).otherwise(long_(0))

        def step(x):
            diagonal = (((x.bitwiseAND(state.up) + state.up).bitwiseXOR(state.up)).bitwiseOR(x).bitwiseOR(state.down)).bitwiseAND(long_(band))
            return _let(diagonal, lambda d0: _let(
                F.struct(d0.alias("d0"), state.down.bitwiseOR(F.bitwise_not(d0.bitwiseOR(state.up))).bitwiseAND(long_(band)).alias("more"), d0.bitwiseAND(state.up).alias("less")), after))

        def after(s):
            ahead = F.shiftright(s.d0, 1)
            bit = lambda v, at: F.expr("0L") if at is None else F.call_function("getbit", v, at).cast("long")
            row = (m - j + edits).cast("int")
            inside = F.greatest(F.lit(0), F.least(row, F.lit(2 * edits)))
            moved = F.when(row >= 2 * edits, 1 - bit(s.d0, F.lit(2 * edits))).otherwise(bit(s.more, inside) - bit(s.less, inside))
            return F.struct(s.less.bitwiseOR(F.bitwise_not(ahead.bitwiseOR(s.more))).bitwiseAND(long_(band)).alias("up"), ahead.bitwiseAND(s.more).alias("down"),
                            (state.d + moved).alias("d"))

        # along the last row the distance can still fall by 2 * edits; beyond that nothing more is computed
        return F.when(state.d > 3 * edits, state).otherwise(_let(equal, step))

    def whole(both):
        return F.aggregate(F.sequence(F.lit(1), F.size(both.t)), start, lambda s, j: column(both.p, both.t, F.size(both.p), s, j), lambda s: s.d)

    return _let(F.struct(F.split(pattern, "").alias("p"), F.split(text, "").alias("t")), whole)


def keyed(documents: DataFrame, id: str, text: str) -> DataFrame:
    """o (id, null last), th (hash of the text) and t of every document."""
    return documents.select(F.coalesce(col(id).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(col(text)).alias("th"), col(text).alias("t"))


def lines(documents: DataFrame) -> DataFrame:
    """o, th, no, line, h of all lines with a word, of documents with keys."""
    flat = documents.select("o", "th", F.posexplode(F.split("t", "\n")).alias("no", "line"))
    return flat.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def _segment(length: Column, i, edits) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i`` of a line of that length; the longer segments come last.  Numbers or columns."""
    base, rest = F.floor(length / (edits + 1)).cast("int"), (length % (edits + 1)).cast("int")
    return base * i + F.greatest(F.lit(0), rest - (edits + 1 - i)), base + (rest >= edits + 1 - i).cast("int")


def _allowed(length: Column, allowed) -> Column:
    """Edits granted to a line of that length."""
    return F.coalesce(*[F.when(length >= n, e) for n, e in reversed(allowed)], F.lit(0))


def _measured(all_lines: DataFrame, allowed) -> DataFrame:
    """Lines that are long enough for an edit, with their length and as 4 bytes per character, from which parts are cut without counting characters."""
    return all_lines.withColumn("n", F.length("line")).filter(F.col("n") >= allowed[0][0]).withColumn("wide", F.encode("line", "UTF-32"))


def _cut(start: Column, size: Column) -> Column:
    return F.substring(F.col("wide"), 4 * start + 1, 4 * size)


def _places(i: int, shorter_by: int, edits: int) -> range:
    """Shifts at which segment ``i`` (from 0) of a line shorter by that much has to be looked for."""
    return range(max(-i, shorter_by - (edits - i)), min(i, shorter_by + (edits - i)) + 1)


def _keys(edits: int) -> list[tuple[bool, int, int, int, int]]:
    """Keys of a measured line among lines with that many edits: (whether it probes, how much shorter the indexed line is, segment, its shift, edits)."""
    return [(False, 0, i, 0, edits) for i in range(edits + 1)] + [
        (True, less, i, shift, edits) for less in range(edits + 1) for i in range(edits + 1) for shift in _places(i, less, edits)]


def _listed(keys: list[tuple], first: int = 0) -> Column:
    """A constant list of keys, numbered from ``first``."""
    return F.array(*[F.struct(F.lit(first + at).alias("which"), *[F.lit(v).alias(name) for name, v in zip(("probe", "less", "i", "shift", "edits"), key)]) for at, key in enumerate(keys)])


def _all_keys(allowed) -> tuple[Column, Column]:
    """The keys of all levels as one list, and those that a line of ``n`` characters may have.

    Most lines are far from a border between two levels and have the keys of one level only.
    """
    levels = [_keys(e) for _, e in allowed]
    everything, widest = [key for level in levels for key in level], max(e for _, e in allowed)
    near = F.lit(False)
    for border, _ in allowed[1:]:
        near = near | F.col("n").between(border, border + widest)
    own = F.when(near, _listed(everything))
    for k in range(len(levels) - 1, -1, -1):
        own = own.when(F.col("n") >= allowed[k][0], _listed(levels[k], sum(map(len, levels[:k]))))
    return _listed(everything), own


def _dealt(long_lines: DataFrame, allowed) -> DataFrame:
    """h, which, key of all keys of measured lines, but those for which the indexed line would be of another level.

    The list of keys is a constant and one expression makes them all, row by row: an expression for each key is more than gets compiled.
    """
    rows = long_lines.select("h", "n", "wide", F.explode(_all_keys(allowed)[1]).alias("k")).select("h", "n", "wide", "k.*").withColumn("indexed", F.col("n") - F.col("less"))
    start, size = _segment(F.col("indexed"), F.col("i"), F.col("edits"))
    return (rows.filter(_allowed(F.col("indexed"), allowed) == F.col("edits"))
            .select("h", "which", F.xxhash64("indexed", "i", _cut(start + F.col("shift"), size)).alias("key")))


def _second_keys(rows: DataFrame, allowed, probing: bool) -> DataFrame:
    """Key once more by halves of the segments other than i: of these 2 * edits halves no more than ``edits`` are touched."""
    out = []
    for edits in sorted({e for _, e in allowed}):
        for i in range(edits + 1):
            a, w = _segment(F.col("indexed"), i, edits)
            for half in (0, 1):
                size = F.floor(w / 2).cast("int") if half == 0 else w - F.floor(w / 2).cast("int")
                at = a if half == 0 else a + F.floor(w / 2).cast("int")
                for shift in range(-edits, edits + 1) if probing else (0,):
                    out.append(F.when((F.col("edits") == edits) & (F.col("i") != i), F.xxhash64(F.col("key"), F.lit(2 * i + half), _cut(at + shift, size))))
    return rows.withColumn("wide", F.encode("line", "UTF-32")).select(F.explode(F.array_compact(F.array(*out))).alias("key"), "h", "odd1", "odd2")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose rows have been counted, if there are few."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def near_lines(documents: DataFrame, places: DataFrame, allowed=ALLOWED, hot: int = HOT) -> DataFrame:
    """Pairs of different lines within the edits allowed: a, b (hashes) and where each comes first (first_a, first_b).

    ``documents`` have keys, ``places`` are h, o, th and no of all their lines.  The keys of all lines are aggregated once, combined before the shuffle and without their
    texts, to find those that different lines share.  The lines that have such keys come next, and only their first places are opened for the text.
    """
    allowed = tuple(sorted(allowed))
    edits = max(e for _, e in allowed)
    dealt = _dealt(_measured(lines(documents), allowed), allowed)
    shared, seen = materialize_with(dealt.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x < y").select("key"), "shared")
    # which key of a line it is (the place in the list of keys) tells the rest
    hits = materialize(dealt.join(_small(shared, seen["rows"]), "key").select("h", "which", "key").distinct(), "hits")

    wanted, seen = materialize_with(hits.select("h").distinct(), "wanted")
    firsts, seen = materialize_with(places.join(_small(wanted, seen["rows"]), "h", "left_semi").groupBy("h").agg(F.min(F.struct("o", "th", "no")).alias("first")), "firsts")
    spot = firsts.select("h", "first.*")
    opened = documents.join(_small(spot.select("o", "th").distinct(), seen["rows"]), ["o", "th"], "left_semi")
    # an edit changes the parity of at most two counts of characters, and of at most four counts of neighbours
    odd = lambda items, seed: F.expr(f"aggregate({items}, 0L, (odd, c) -> odd ^ shiftleft(1L, pmod(hash(c, {seed}), 64)))")
    single, double = odd("split(line, '')", 1), odd("zip_with(split(line, ''), slice(split(line, ''), 2, n), (a, b) -> concat(a, b))", 2)
    texts = materialize(lines(opened).drop("h").join(_small(spot, seen["rows"]), ["o", "th", "no"]).groupBy("h").agg(F.first("line").alias("line"))
                        .withColumn("n", F.length("line")).withColumns({"odd1": single, "odd2": double}), "texts")

    found = (hits.join(texts, "h").withColumn("k", F.get(_all_keys(allowed)[0], F.col("which"))).select(*hits.columns, "line", "n", "odd1", "odd2", "k.probe", "k.i", "k.edits", (F.col("n") - F.col("k.less")).alias("indexed")))
    index, probe = found.filter("NOT probe"), found.filter("probe")
    crowded, seen = materialize_with(index.groupBy("key").count().filter(F.col("count") > hot).select("key"), "crowded")
    slim = lambda side: side.select("key", "h", "odd1", "odd2").distinct()
    pair = lambda x, y: (slim(x).alias("x").join(slim(y).alias("y"), "key")
                         .filter(F.expr(f"x.h <> y.h AND bit_count(x.odd1 ^ y.odd1) <= {2 * edits} AND bit_count(x.odd2 ^ y.odd2) <= {4 * edits}"))
                         .select(F.expr("least(x.h, y.h)").alias("a"), F.expr("greatest(x.h, y.h)").alias("b")))
    if seen["rows"]:
        apart, close = (lambda side, how=how: side.join(_small(crowded, seen["rows"]), "key", how) for how in ("left_anti", "left_semi"))
        pairs = pair(apart(index), apart(probe)).unionAll(pair(_second_keys(close(index), allowed, False), _second_keys(close(probe), allowed, True)))
    else:
        pairs = pair(index, probe)
    pairs = materialize(pairs.distinct(), "pairs")
    side = lambda s: texts.select(F.col("h").alias(s), F.col("line").alias(f"line_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    granted = _allowed(F.least(F.length("line_a"), F.length("line_b")), allowed)
    near = F.abs(F.length("line_a") - F.length("line_b")) <= granted
    links = both.filter(F.when(near, banded_distance(F.col("line_a"), F.col("line_b"), edits) <= granted).otherwise(F.lit(False))).select("a", "b")
    for s in "ab":
        links = links.join(firsts.select(F.col("h").alias(s), F.col("first").alias(f"first_{s}")), s)
    links = materialize(links.select("a", "b", "first_a", "first_b"), "near-lines")
    for table in (shared, hits, wanted, firsts, texts, crowded, pairs):
        release(table)
    return links


def decide(documents: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", allowed=ALLOWED, hot: int = HOT) -> DataFrame:
    """Columns ``keep`` as struct ``row``, n_lines, n_exact, n_near (lines removed) and removed (their numbers, from 0, in order)."""
    rows = keyed(documents, id, text)
    places = materialize(lines(rows).select("h", "o", "th", "no"), "places")
    pairs = near_lines(rows, places, allowed, hot)
    nearest = pairs.select(F.col("a").alias("h"), F.col("first_b").alias("near")).unionAll(pairs.select(F.col("b").alias("h"), F.col("first_a").alias("near")))
    repeated = places.groupBy("h").agg(F.min(F.struct("o", "th", "no")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    marks = (repeated.select("h", "first", F.lit(None).cast(nearest.schema["near"].dataType).alias("near"))
             .unionAll(nearest.select("h", F.lit(None).cast(nearest.schema["near"].dataType).alias("first"), "near"))
             .groupBy("h").agg(F.min("first").alias("first"), F.min("near").alias("near")))
    here = F.struct("o", "th", "no")
    exact = F.coalesce(here > F.col("first"), F.lit(False))
    gone = (places.join(marks, "h").withColumn("exact", exact).filter(F.col("exact") | F.coalesce(here > F.col("near"), F.lit(False)))
            .groupBy("o", "th").agg(F.array_sort(F.collect_set(F.struct("no", "exact"))).alias("gone")))
    sizes = places.groupBy("o", "th").agg(F.count_distinct("no").alias("n_lines"))
    source = documents.select(named(keep).alias("row"), F.coalesce(col(id).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(col(text)).alias("th"))
    count = lambda flag: F.coalesce(F.size(F.filter("gone", lambda g: g.exact == flag)), F.lit(0)).cast("long")
    return source.join(sizes.join(gone, ["o", "th"], "left"), ["o", "th"], "left").select(
        "row", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(count(True)).cast("long").alias("n_exact"),
        F.when(F.col("gone").isNull(), 0).otherwise(count(False)).cast("long").alias("n_near"), F.coalesce(F.transform("gone", lambda g: g.no), F.array().cast("array<int>")).alias("removed"))


def deduplicate(documents: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents without removed lines, with all their columns; ``n_chars`` follows the text if it is there."""
    names = documents.columns
    new = free_name(names, "rest")
    decided = decide(documents, names, id, text, **settings)
    body = F.col("row").getField(text)
    rest = F.filter(F.split(body, "\n"), lambda line, i: ~F.array_contains("removed", i))
    out = decided.select(*unpack("row", names), F.when(F.size("removed") > 0, F.array_join(rest, "\n")).alias(new))
    fresh = {text: F.coalesce(col(new), col(text))}
    if "n_chars" in names:
        fresh["n_chars"] = F.when(col(new).isNull(), F.col("n_chars")).otherwise(F.length(col(new)).cast(documents.schema["n_chars"].dataType))
    return out.withColumns(fresh).select(*map(col, names))
