"""The registered queries of this subpackage, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, decontamination, language, line_dedup, mixing, ngram_join, pii, quality_model, quality_rules, repair, sharding, substring, whitening
from .frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


WORD = r"[^\x20\x09-\x0D]+"


_WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PHRASES = ", ".join(f"('{p}', {len(p.split())}, {str(p[-1].isalnum()).lower()})" for p in quality_rules.BOILERPLATE)


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
l AS (SELECT r, i, string_split(t, chr(10))[i] AS line FROM (SELECT r, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
m AS (SELECT r, i, line, len(regexp_extract_all(line, '{WORD}')) AS n, length(array_to_string(regexp_extract_all(line, '{WORD}'), '')) AS chars,
  length(regexp_replace(line, '[^|<>]', '', 'g')) AS seps, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms,
  length(regexp_replace(line, '[^!]', '', 'g')) AS shouts, regexp_matches(line, '[.!?:;,]|[^\x00-\x7F]') AS stops FROM l),
ph AS (SELECT r, i, p, k, bare, string_split(low, p) AS s FROM (SELECT r, i, translate(line, '{_UPPER}', '{_SMALL}') AS low FROM m) JOIN (VALUES {_PHRASES}) x(p, k, bare) ON contains(low, p)),
pw AS (SELECT r, i, sum(k * len(list_filter(range(1, len(s)), lambda a: NOT regexp_matches(CASE WHEN s[a] = '' AND a > 1 THEN p ELSE s[a] END, '[\p{{L}}\p{{N}}]$')
  AND NOT (bare AND regexp_matches(CASE WHEN s[a + 1] = '' AND a + 1 < len(s) THEN p ELSE s[a + 1] END, '^[\p{{L}}\p{{N}}]')))))::BIGINT AS inside FROM ph GROUP BY r, i),
j AS (SELECT m.*, n > 0 AND ((coalesce(inside, 0) > 0 AND {quality_rules.PHRASE_SHARE} * inside >= n) OR 3 * seps >= n OR 2 * syms >= n OR (n >= 12 AND NOT stops)
  OR (2 * shouts >= n AND n >= 4)) AS failed FROM m LEFT JOIN pw USING (r, i)),
ll AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (n > 0) AS n_lines,
  count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(chars) FILTER (failed), 0)::BIGINT AS lost_chars FROM j GROUP BY r),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT i + k) AS c FROM rep, range(3) x(k) GROUP BY r),
o AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  n_dup_lines, coalesce(c, 0) AS n_repeat_words, n_lines, n_failed_lines, lost_chars FROM w JOIN ll USING (r) LEFT JOIN cov USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {quality_rules.MOST_LOST} * word_chars AS kept FROM o""")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of line-first cleaning for every document."""
    return quality_rules.measure(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("row", F.col("row.doc_id")).withColumnRenamed("row", "doc_id")


@query(f"""
WITH b AS (SELECT item_id, {_WORDS2} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS2} AS ws FROM documents),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
cov AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS k FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (r) LEFT JOIN it USING (r)""")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    rows = mixing.per_row(mixing.copies(table(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT r, o, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (SELECT r, o, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
dup AS (SELECT r, i FROM (SELECT *, min(o) OVER (PARTITION BY g) AS least FROM win) WHERE o > least),
gone AS (SELECT DISTINCT r, i + k AS i FROM dup, range(50) x(k)),
word AS (SELECT r, i, ws[i] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
k AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows that begin in an earlier one."""
    return substring.parse(table(spark, sf_dir, "documents"), ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query(f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT r, o, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM (SELECT r, o, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, any_value(o) AS o, count(*) AS n FROM sh GROUP BY r),
pair AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.r <> b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM pair JOIN n a ON x = a.r JOIN n b ON y = b.r WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(r, s) AS (SELECT r, r FROM n UNION SELECT reach.r, e.y FROM reach JOIN e ON reach.s = e.x),
least AS (SELECT reach.r, min(n.o) AS o FROM reach JOIN n ON reach.s = n.r GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, nullif(coalesce(least.o, d.o), 9223372036854775807) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)""")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and near-duplicate component of every document."""
    return (ngram_join.components(table(spark, sf_dir, "documents"), ["doc_id"])
            .select(F.col("row.doc_id").alias("doc_id"), "n_shingles", "component_id"))


def _spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of the base kinds, a digest of their spans, and all spans."""
    found = pii.detect(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s.kind.isin(*kinds))).cast("long")
    base = F.filter("spans", lambda s: s.kind.isin(*pii.BASE))
    return found.select(F.col("row.doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in pii.BASE], F.sha2(_spans_text(base), 256).alias("base_sha256"),
                        _spans_text(F.col("spans")).alias("spans"), count(*pii.ADDED).alias("n_added"))


@query(f"""
WITH RECURSIVE shard AS (SELECT i AS k, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(sharding.SHARDS)}) r(i)),
par AS (SELECT list(('0x' || substr(md5(name), 1, 15))::BIGINT % {sharding.SLOTS} ORDER BY k) AS offs,
  list(('0x' || substr(md5(name), 16, 15))::BIGINT % {sharding.SLOTS - 1} + 1 ORDER BY k) AS skip FROM shard),
fill(claim, slot, taken, nxt) AS (
  SELECT -1, -1::BIGINT, repeat('0', {sharding.SLOTS})::BIT, list_transform(range({len(sharding.SHARDS)}), lambda x: 0::BIGINT) UNION ALL
  SELECT claim, (offs[s + 1] + j * skip[s + 1]) % {sharding.SLOTS}, set_bit(taken, ((offs[s + 1] + j * skip[s + 1]) % {sharding.SLOTS})::INTEGER, 1),
    list_transform(nxt, lambda v, i: CASE WHEN i = s + 1 THEN j + 1 ELSE v END)
  FROM (SELECT claim + 1 AS claim, (claim + 1) % {len(sharding.SHARDS)} AS s, taken, nxt, offs, skip,
    list_filter(range(nxt[(claim + 1) % {len(sharding.SHARDS)} + 1], {sharding.SLOTS}), lambda j: get_bit(taken, ((offs[(claim + 1) % {len(sharding.SHARDS)} + 1]
      + j * skip[(claim + 1) % {len(sharding.SHARDS)} + 1]) % {sharding.SLOTS})::INTEGER) = 0)[1] AS j FROM fill, par WHERE claim < {sharding.SLOTS - 1})),
lookup AS (SELECT slot, name FROM fill JOIN shard ON claim % {len(sharding.SHARDS)} = k WHERE claim >= 0)
SELECT doc_id, slot, name AS shard FROM (SELECT doc_id,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents) JOIN lookup USING (slot)""")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "slot", "shard")


_CHAT_RAW = r"regexp_matches({0}, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\\\\|\\:|\\n')"


def _chat_escaped(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}\\:{c[1:]}')"
    return text


@query(f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT *, CASE WHEN {_CHAT_RAW.format('text')} THEN {_chat_escaped('text')} ELSE text END AS body,
  CASE WHEN {_CHAT_RAW.format('role')} OR contains(role, chr(10)) THEN replace({_chat_escaped('role')}, chr(10), '\\n') ELSE role END AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + {len(chat.BEGIN) + len(chat.END) + 2})::BIGINT AS formatted_chars, count(*) FILTER (body <> text OR head <> role) AS escaped_turns,
  true AS identical FROM t GROUP BY conv_id""")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, all read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = chat.format_chats(rows.unionByName(probe))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(chat.masked(F.col("formatted"), F.col("loss_spans")), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
                       F.col("escaped_turns").cast("long").alias("escaped_turns"), "identical")


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and which of them repeat an earlier line, exactly or within the edits allowed."""
    found = line_dedup.decide(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_exact", "n_near", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def _repair_fold() -> str:
    """SQL that folds rows (c initial or null, cut, four best edits so far as cost in nine digits and letters) into the best edits for each state of the grammar."""
    best = [f"a.k{s}" for s in range(4)]

    def plus(key: str, cost: str, letters: str) -> str:
        return f"lpad((substr({key}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({key}, 10) || '{letters}'"

    options: dict[int, list[str]] = {s: [plus(best[s], str(repair.DELETE), "D")] for s in range(4)}
    for state in range(4):
        for letters, cost, before in (("", 0, state), ("I", repair.INSERT, repair.NEXT[state][repair.WANTED[state]])):
            for c, after in repair.NEXT[before].items():
                options[after].append(f"CASE WHEN b.c = '{c}' THEN {plus(best[state], f'{cost} + b.cut', letters + 'K')} END")
            c = repair.WANTED[before]
            options[repair.NEXT[before][c]].append(f"CASE WHEN b.c IS NOT NULL AND b.c <> '{c}' THEN {plus(best[state], f'{cost + repair.REROLE} + b.cut', letters + 'R')} END")
    fields = ", ".join(f"'k{s}': least({', '.join(options[s])})" for s in range(4))
    return f"{{'c': NULL::VARCHAR, 'cut': 0, {fields}}}"


_CRC = """list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT), lambda h, b:
  xor(h >> 8, crc[(xor(h, b) & 255) + 1]), 4294967295::BIGINT)"""
_SOLID = r"regexp_extract_all(text, '[^\x20\x09-\x0D]')"


@query(rf"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda h, k: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END, i) ORDER BY i) AS crc FROM range(256) r(i)),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor({_CRC}, 4294967295) % 20 AS kind FROM c, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, CASE WHEN len({_SOLID}) = 0 THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN {_SOLID}[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'c': CASE WHEN fault NOT IN ('b', 'd') THEN c END, 'cut': (fault = 't')::INTEGER, 'k0': '', 'k1': '', 'k2': '', 'k3': ''}} ORDER BY i) AS rs, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
  FROM f GROUP BY conv_id),
g AS (SELECT *, list_reduce(rs, lambda a, b: {_repair_fold()}, {{'c': NULL::VARCHAR, 'cut': 0, 'k0': '000000000', 'k1': '900000000', 'k2': '900000000', 'k3': '900000000'}}) AS k FROM st),
b AS (SELECT *, least(k.k0, k.k3, lpad((substr(k.k1, 1, 9)::INTEGER + 4)::VARCHAR, 9, '0') || substr(k.k1, 10) || 'II', lpad((substr(k.k2, 1, 9)::INTEGER + 2)::VARCHAR, 9, '0') || substr(k.k2, 10) || 'I') AS won FROM g),
e AS (SELECT *, substr(won, 1, 9)::BIGINT AS cost, substr(won, 10) AS audit FROM b),
w(conv_id, audit, roles, texts, n, r, last, outs) AS (SELECT conv_id, audit, roles, texts, 0, 0, '', []::VARCHAR[] FROM e UNION ALL
  SELECT conv_id, audit, roles, texts, n + 1, CASE WHEN x = 'I' THEN r ELSE r + 1 END, CASE WHEN x = 'D' THEN last WHEN x = 'K' THEN substr(roles[r + 1], 1, 1) WHEN last = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN x = 'D' THEN outs ELSE list_append(outs, CASE WHEN x = 'K' THEN roles[r + 1] WHEN last = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN x = 'I' THEN '' ELSE texts[r + 1] END) END
  FROM (SELECT *, substr(audit, n + 1, 1) AS x FROM w WHERE n < length(audit))),
z AS (SELECT conv_id, array_to_string(outs, chr(10)) AS whole FROM w WHERE n = length(audit))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    found = repair.report(repair.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query()
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and in how many spans of one language it falls."""
    return language.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    return whitening.components_of(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
