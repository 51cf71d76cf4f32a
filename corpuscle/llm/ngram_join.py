"""N-gram Jaccard join: near-duplicate documents by prefix filters under several global token orders.

A document is the set of its distinct shingles (``SIZE`` consecutive words).  Two documents link when their Jaccard similarity is at least
``PERCENT`` / 100.  If it is, then under any fixed order of all tokens the first n - ceil(n * PERCENT / 100) + 1 tokens of both must share one.  All orders
used here put tokens known to be frequent last, by classes of their frequency, and differ in how they arrange the tokens of a class.  A candidate pair has
to share prefix tokens under the first order, as many as the sizes demand and at positions that leave room for enough further ones, and under each further order; only then
are the sets intersected, exactly.

Steps, each for the whole corpus:
  1. Survey: size and fingerprint of each set.  Equal sets are one class with one representative.  Tokens that repeat within a task are counted there and
     summed; those above ``FREQUENT`` form the frequency classes.  (Every order is valid; frequencies decide speed only.)
  2. Prefix tokens under the first order are aggregated, combined before the shuffle, to find those of at least two sets.
  3. The sets' shared prefix tokens are joined in stars, never in all pairs: each token's most central set (its token stands earliest) is compared with the others, and
     of its stars each set is verified against the one it shares most tokens with.  Sets found similar become a component.
  4. The pairs of sets of still different components that share a prefix token and pass all filters are verified, so no link is lost.
Bit filters of fixed size keep everything else out of the shuffles; they only ever let too much through.

Edge cases: a null or wordless text has the empty set and is linked with nothing (its component is its own id); a text of fewer words than ``SIZE`` is one shingle;
rows with equal sets share a component whatever their ids, repeated ids included; a null id is never the smallest unless a component has no other, then the
component is null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import connected_components
from ..scratch import materialize, materialize_with, release
from .filters import bit_filter, maybe
from .frames import col, map_texts, named, row_schema
from .words import LOWER, Piece, before, mix, pieces, windows, words

SIZE = 5
PERCENT = 75
ORDERS = 3
FREQUENT = 16           # summed repetitions from which a token counts as frequent
BROADCAST_TOKENS = 2_000_000
STAR_ROUNDS = 1
_BATCH_TOKENS = 2_000_000
_TOKEN_BITS = 58        # the frequency class stands above them
_MASK = np.uint64((1 << _TOKEN_BITS) - 1)
_LAST = 2**63 - 1
_ROW_HASH = "xxhash64(o, th)"


def shingle_sets(piece: Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of every document (A-Z lower-cased), sorted, and where each document begins among them."""
    w = words(Piece(piece.first, LOWER[piece.data], piece.offsets))
    at, value = windows(w, size)
    owner = w.document[at]
    for short in range(1, size):
        if (w.counts == short).any():
            more_at, more = windows(w, short)
            whole = w.counts[w.document[more_at]] == short
            at, value, owner = np.append(at, more_at[whole]), np.append(value, more[whole]), np.append(owner, w.document[more_at[whole]])
    if len(owner) and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    tokens = value >> np.uint64(64 - _TOKEN_BITS)
    edges = np.searchsorted(owner, np.arange(piece.n + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[new], before(new)[edges]


def permuted(tokens: np.ndarray, order: int) -> np.ndarray:
    """The place of tokens in the arrangement number ``order``, a bijection of the token values."""
    for k in range(order):
        tokens = (tokens * np.uint64((0x9E3779B97F4A7C15 + 2 * k) | 1)) & _MASK
        tokens = tokens ^ (tokens >> np.uint64(29))
    return tokens


def _sums(tokens: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    total = before(mix(tokens + np.uint64(salt << 60)).view(np.int64))
    return total[first[1:]] - total[first[:-1]]


def _survey(source: DataFrame, size: int) -> DataFrame:
    def run(batches):
        sets, seen, held = [], set(), 0

        def repeated():
            value, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            sets.clear()
            seen.clear()
            return value[count > 1].view(np.int64), count[count > 1]

        for batch in batches:
            for piece in pieces(batch.column("t")):
                tokens, first = shingle_sets(piece, size)
                n = np.diff(first)
                s1, s2 = _sums(tokens, first, 1) ^ n, _sums(tokens, first, 2)
                for d, s in enumerate(s1.tolist()):
                    if s not in seen:
                        seen.add(s)
                        sets.append(tokens[first[d]:first[d + 1]])
                        held += int(n[d])
                part = slice(piece.first, piece.first + piece.n)
                again, held = (repeated(), 0) if held > _BATCH_TOKENS else ((), held)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[part] for c in ("row", "o", "th")), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2),
                                                  _counts(piece.n, *again)], _SURVEY)
        if held:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                              pa.nulls(1, pa.int64()), _counts(1, *repeated())], _SURVEY)

    return map_texts(source.select("row", "o", "th", "t"), run, row_schema(source, "o long, th long, n long, s1 long, s2 long, frequent array<struct<token: bigint, count: bigint>>"))


_SURVEY = ["row", "o", "th", "n", "s1", "s2", "frequent"]


def _counts(rows: int, tokens=np.zeros(0, np.int64), counts=np.zeros(0, np.int64)) -> pa.Array:
    """Lists of (token, count): all in the last row."""
    offsets = np.zeros(rows + 1, np.int32)
    offsets[-1] = len(tokens)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], ["token", "count"]))


class Orders:
    """Global token orders: frequent tokens last by class, the others by an arrangement."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.classes = tokens[order], classes[order].astype(np.uint64)
        self.first_bits = np.zeros(1 << 20, bool)
        self.first_bits[self.tokens >> np.uint64(_TOKEN_BITS - 20)] = True

    def keys(self, tokens: np.ndarray, order: int) -> np.ndarray:
        """Sort keys; the token can be read back from those of order 0."""
        key = permuted(tokens, order)
        if len(self.tokens):
            at = np.flatnonzero(self.first_bits[tokens >> np.uint64(_TOKEN_BITS - 20)])
            place = np.minimum(np.searchsorted(self.tokens, tokens[at]), len(self.tokens) - 1)
            same = self.tokens[place] == tokens[at]
            key[at[same]] |= self.classes[place[same]] << np.uint64(_TOKEN_BITS)
        return key


def prefix_length(n, percent: int):
    """How many first tokens of a set of n must meet those of any similar set."""
    return n - (n * percent + 99) // 100 + 1


def _prefixes(source: DataFrame, firsts, orders, size: int, percent: int, only=None) -> DataFrame:
    """Prefix tokens under order 0 of the sets that may be first of their class: token, sid, n, pos."""
    shared = source.sparkSession.sparkContext.broadcast((firsts, *orders, only))

    def run(batches):
        firsts, tokens, classes, only = shared.value
        known = Orders(tokens, classes)
        for batch in batches:
            batch = batch.filter(pa.array(maybe(firsts, batch.column("rh").to_numpy().view(np.uint64))))
            for piece in pieces(batch.column("t")):
                tokens, first = shingle_sets(piece, size)
                n = np.diff(first)
                sid = _sums(tokens, first, 1) ^ n
                key = known.keys(tokens, 0)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    key[a:b].sort()
                place = np.arange(len(key)) - np.repeat(first[:-1], n)
                owner = np.repeat(np.arange(piece.n), n)
                use = place < prefix_length(n, percent)[owner]
                if only is not None:
                    use &= maybe(only, key << np.uint64(64 - _TOKEN_BITS))
                owner = owner[use]
                yield pa.RecordBatch.from_arrays([pa.array((key[use] & _MASK).view(np.int64)), pa.array(sid[owner]), pa.array(n[owner].astype(np.int32)),
                                                  pa.array(place[use].astype(np.int32))], ["token", "sid", "n", "pos"])

    return map_texts(source.select(F.expr(_ROW_HASH).alias("rh"), "t"), run, "token long, sid long, n int, pos int")


def _sets(source: DataFrame, chosen, orders, size: int, percent: int) -> DataFrame:
    """Tokens of the chosen sets, and their prefixes under the further orders."""
    shared = source.sparkSession.sparkContext.broadcast((chosen, *orders))

    def run(batches):
        chosen, tokens, classes = shared.value
        known = Orders(tokens, classes)
        for batch in batches:
            batch = batch.filter(pa.array(maybe(chosen, batch.column("rh").to_numpy().view(np.uint64))))
            for piece in pieces(batch.column("t")):
                tokens, first = shingle_sets(piece, size)
                n = np.diff(first)
                sid = _sums(tokens, first, 1) ^ n
                columns = [pa.array(sid), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.view(np.int64)))]
                for k in range(1, ORDERS):
                    key = known.keys(tokens, k)
                    length = prefix_length(n, percent)
                    parts = [np.partition(key[a:b], p - 1)[:p] if b > a else key[:0] for a, b, p in zip(first[:-1].tolist(), first[1:].tolist(), length.tolist())]
                    flat = np.concatenate(parts) if parts else key[:0]
                    columns.append(pa.ListArray.from_arrays(pa.array(before(np.where(n > 0, length, 0)).astype(np.int32)), pa.array(flat.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["sid", "tokens", *(f"prefix{k}" for k in range(1, ORDERS))])

    found = map_texts(source.select(F.expr(_ROW_HASH).alias("rh"), "t"), run, "sid long, tokens array<long>" + "".join(f", prefix{k} array<long>" for k in range(1, ORDERS)))
    return found.groupBy("sid").agg(*[F.first(c).alias(c) for c in found.columns[1:]])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``similar``: prefix filters of the further orders first, then the exact intersection."""
    left = sets.select(*[F.col(c).alias(f"a_{c}") for c in sets.columns])
    right = sets.select(*[F.col(c).alias(f"b_{c}") for c in sets.columns])
    both = pairs.join(left, pairs["a"] == left["a_sid"]).join(right, F.col("b") == right["b_sid"])
    near = F.lit(True)
    for k in range(1, ORDERS):
        near = near & F.arrays_overlap(f"a_prefix{k}", f"b_prefix{k}")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - common
    return both.select("a", "b", F.when(near, 100 * common >= percent * union).otherwise(F.lit(False)).alias("similar"))


def _sized(percent: int) -> Column:
    return F.expr(f"100L * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")


def _room(percent: int) -> Column:
    """Behind a first common token at these positions enough tokens are left."""
    return F.expr(f"{100 + percent}L * least(a_n - a_pos, b_n - b_pos) >= {percent} * (a_n + b_n)")


def _counted(percent: int) -> Column:
    """Enough common tokens in the prefixes: all but those behind the prefix that ends first are among them."""
    behind = " , ".join(f"{n} - ({n} - floor(({n} * {percent}L + 99) / 100) + 1)" for n in ("a_n", "b_n"))
    return F.expr(f"{100 + percent}L * (common + greatest({behind})) >= {percent} * (a_n + b_n)")


def components(documents: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT,
               broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """Columns ``keep`` as struct ``row``, o and th (id, null last, and hash of the text), n_shingles, component_id, first_th (hash of the text that stands for the component)."""
    source = documents.select(named(keep).alias("row"), F.coalesce(col(id).cast("long"), F.lit(_LAST)).alias("o"),
                              F.xxhash64(col(text)).alias("th"), col(text).alias("t"))
    survey = materialize(_survey(source, size), "survey")
    known = survey.filter("n IS NOT NULL").drop("frequent")
    classes = materialize(known.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("o", "th")).alias("first")), "classes")
    representative = classes.select(F.col("s1").alias("sid"), F.expr("xxhash64(first.o, first.th)").alias("rh"))
    firsts = bit_filter(representative, F.col("rh"))

    frequent = (survey.select(F.explode("frequent").alias("f")).groupBy("f.token").agg(F.sum("f.count").alias("c")).filter(F.col("c") >= FREQUENT)
                .select("token", F.least(F.floor(F.log2("c")), F.lit(63)).cast("int").alias("class")))
    # a bounded number of frequent tokens is sent; the most frequent when there are more, the others then take part as if they were rare
    most = frequent.orderBy(F.desc("class"), "token").limit(broadcast_tokens).toPandas()
    orders = (most["token"].to_numpy(np.int64).view(np.uint64), most["class"].to_numpy())

    prefixes = _prefixes(source, firsts, orders, size, percent)
    meeting = prefixes.groupBy("token").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).filter("x < y")
    shared = materialize(meeting.select("token"), "shared")
    may_meet = bit_filter(shared, F.shiftleft("token", 64 - _TOKEN_BITS))
    members = materialize(_prefixes(source, firsts, orders, size, percent, may_meet).distinct().join(shared, "token", "left_semi"), "members")

    label = None            # sid -> component, for sets that have a link
    edges = tested = None
    used = [shared, members]
    for step in range(STAR_ROUNDS + 1):
        if label is None:
            own = members.withColumn("c", F.col("sid"))
        else:
            own = members.join(label, "sid", "left").withColumn("c", F.coalesce("cluster", "sid")).drop("cluster")
        parted = own.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("token")
        if label is not None:
            own = materialize(own.join(parted, "token", "left_semi"), "parted")
            used.append(own)
        if step < STAR_ROUNDS:
            head = own.groupBy("token").agg(F.min(F.struct("pos", "sid", "n", "c")).alias("head"))
            # a pair counted too low here, because not all its tokens have the same hub, is left to the last step
            star = (own.join(head, "token").filter("c <> head.c")
                    .select(F.col("head.sid").alias("hub"), "sid", F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("head.n").alias("b_n"), F.col("head.pos").alias("b_pos"))
                    .filter(_sized(percent)).groupBy("sid", "hub", "a_n", "b_n").agg(F.count("*").alias("common")).filter(_counted(percent))
                    .groupBy("sid").agg(F.max(F.struct("common", "hub"))["hub"].alias("hub")))
            # each set is "a" of one pair, so its tokens are sent to the hub once
            pairs = star.select(F.col("sid").alias("a"), F.col("hub").alias("b"))
        else:
            x = own.select("token", *[F.col(c).alias(f"a_{c}") for c in ("sid", "n", "pos", "c")])
            y = own.select("token", *[F.col(c).alias(f"b_{c}") for c in ("sid", "n", "pos", "c")])
            met = (x.join(y, (x["token"] == y["token"]) & F.expr("a_sid < b_sid AND a_c <> b_c") & _sized(percent) & _room(percent))
                   .select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"), "a_n", "b_n").distinct())
            prefix = own.groupBy("sid").agg(F.collect_list("token").alias("prefix"))
            for side in "ab":
                met = met.join(prefix.select(F.col("sid").alias(side), F.col("prefix").alias(f"{side}_prefix")), side)
            pairs = met.withColumn("common", F.size(F.array_intersect("a_prefix", "b_prefix"))).filter(_counted(percent)).select("a", "b")
        if tested is not None:
            pairs = pairs.join(tested.select(F.col("a").alias("ta"), F.col("b").alias("tb")), F.expr("least(a, b) = ta AND greatest(a, b) = tb"), "left_anti")
        pairs, seen = materialize_with(pairs, "pairs")
        used.append(pairs)
        if not seen["rows"]:
            continue
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        sets = _sets(source, bit_filter(representative.join(wanted, "sid", "left_semi"), F.col("rh")), orders, size, percent)
        found, seen = materialize_with(_verified(pairs, sets, percent), "verified", links=F.sum(F.col("similar").cast("long")))
        used.append(found)
        done = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tested = done if tested is None else tested.unionAll(done)
        links = found.filter("similar").select(F.col("a").alias("p"), F.col("b").alias("q"))
        if seen["links"]:
            edges = links if edges is None else edges.unionAll(links)
            label = connected_components(edges, keys=()).select(F.col("p").alias("sid"), "cluster")

    for table in used:      # what follows reads the survey, the classes and the labels only
        release(table)
    grouped = classes.withColumn("cluster", F.col("s1"))
    if label is not None:
        grouped = classes.join(label, classes["s1"] == label["sid"], "left").withColumn("cluster", F.coalesce("cluster", "s1")).drop("sid")
    least = grouped.groupBy("cluster").agg(F.min("first").alias("least"))
    placed = grouped.join(least, "cluster").select("s1", "s2", "n", "least")
    return (known.join(placed, ["s1", "s2", "n"], "left")
            .select("row", "o", "th", F.col("n").alias("n_shingles"),
                    F.nullif(F.coalesce(F.col("least.o"), F.col("o")), F.lit(_LAST)).alias("component_id"),
                    F.col("least.o").alias("first_o"), F.col("least.th").alias("first_th")))


def deduplicate(documents: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of every group of near duplicates, that with the smallest id, with all its columns; wordless documents all stay."""
    names = documents.columns
    source = documents.select(named(names).alias("row"), F.coalesce(col(id).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(col(text)).alias("th"))
    wordless = ~F.coalesce(F.col("row").getField(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    heads = (components(documents, [id], id, text, **settings).filter("o = first_o AND th = first_th").select("o", "th").distinct())
    one = source.filter(~wordless).join(heads, ["o", "th"]).groupBy("o", "th").agg(F.first("row").alias("row"))
    return one.select("row").unionAll(source.filter(wordless).select("row")).select(*[F.col("row").getField(c).alias(c) for c in names])
