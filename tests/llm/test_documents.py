"""Operators on documents against plain Python, and their edge cases."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import decontamination, line_dedup, mixing, ngram_join, pii, quality_model, quality_rules, sharding, substring
from corpuscle.llm.queries import ORACLES

from . import helpers as h


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    texts = [h.prose(r, r.randint(30, 300)) for _ in range(40)]
    passage = h.prose(r, 70)
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, f"src{i % 4}"))
        if i % 5 == 0:
            rows.append((100 + i, t, f"src{i % 3}"))
        if i % 4 == 0:
            w = t.split(" ")
            w[r.randrange(len(w))] = "changed"
            rows.append((200 + i, " ".join(w), "src1"))
        if i % 3 == 0:
            rows.append((300 + i, h.prose(r, 60) + "\n" + passage + "\n" + h.prose(r, 40), "src2"))
    rows += [(None, texts[0], None), (None, "short one", None), (900, None, "src0"), (901, "", "src0"), (902, "a b", "src3"), (903, "a b", "src3"), (7, texts[3], "src1")]
    return rows, h.documents(spark, rows)


# --- op 1

ALPHABETS = ("0123456789", "012@.a-+", "1.2.", "+1 ()-.5", "4 -0", "a@b.-é+1 ")


def regex_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                  "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_base_spans_equal_regexes():
    r, anchors = random.Random(1), pii.automaton()
    for _ in range(20_000):
        text = "".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randint(0, 40)))
        assert [s for s in pii.find(text, anchors) if s[0] in pii.BASE] == regex_spans(text), text


@pytest.mark.parametrize("text,kind,value", [
    ("see https://bob:pw@host.example/x now", "url", "https://bob:pw@host.example/x"), ("IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
    ("account number 1234-5678 90", "account", "1234-5678 90"), ("SSN 123-45-6789", "ssn", "123-45-6789"), ('token = "ab12ab12ab12ab12ab12"', "secret", "ab12ab12ab12ab12ab12"),
    ("at 12 Old Mill street", "street", "12 Old Mill street")])
def test_pii_added_spans(text, kind, value):
    assert [(k, text[a:b]) for k, a, b in pii.find(text, pii.automaton()) if k in pii.ADDED] == [(kind, value)]


@pytest.mark.parametrize("text,value", [
    ("IBAN: DE89 3704 0044 0532 0130 00 BIC: COBADEFF", "DE89 3704 0044 0532 0130 00"), ("IBAN DE89370400440532013000 2024-01-01", "DE89370400440532013000"),
    ("IBAN GB29 NWBK 6016 1331 9268 19 A holder", "GB29 NWBK 6016 1331 9268 19"), ("iban NO93 8601 1117 947 BIC DNBANOKK AND OTHER NAMES", "NO93 8601 1117 947"),
    ("IBAN DE89 3704 0044 0532 0130 00 EUR 100 2024 BIC COBADEFF", "DE89 3704 0044 0532 0130 00"), ("IBAN XX46 3704 0044 0532 0130 00 BIC", "XX46 3704 0044 0532 0130 00")])
def test_pii_iban_before_other_words(text, value):
    assert [(k, text[a:b]) for k, a, b in pii.find(text, pii.automaton()) if k in pii.ADDED] == [("iban", value)]


@pytest.mark.parametrize("text,kind,value", [
    ("at 12 Martin Luther King Junior Street now", "street", "12 Martin Luther King Junior Street"), ("1600 Pennsylvania Ave, Washington", "street", "1600 Pennsylvania Ave"),
    ("to 7b Évry Hill Drive.", "street", "7b Évry Hill Drive"), ("9 Sunset Boulevard", "street", "9 Sunset Boulevard"), ("(221 Baker St.)", "street", "221 Baker St"),
    ("350 W 42nd Street", "street", "350 W 42nd Street"), ("Kontonummer 12345678", "account", "12345678"), ("Girokonto-Nr. 12345678", "account", "12345678"),
    ("Account Number: 12345678", "account", "12345678"), ("IBANs: DE89 3704 0044 0532 0130 00 and others", "iban", "DE89 3704 0044 0532 0130 00")])
def test_pii_more_cues(text, kind, value):
    assert [(k, text[a:b]) for k, a, b in pii.find(text, pii.automaton()) if k in pii.ADDED] == [(kind, value)]


@pytest.mark.parametrize("unit", ["token=", "https://u:p@h/", "https://u:p@h.org", "password: ", "iban ", "account no ", "ssn 123-", "a@b.", "+1 ", "1.", "12 Main ", "secret=a1", "://"])
def test_pii_a_megabyte_of_cues_in_linear_time(unit):
    anchors, text = pii.automaton(), unit * (1_000_000 // len(unit))
    pii.find(text[:10_000], anchors)
    begin = time.process_time()
    pii.find(text, anchors)
    assert time.process_time() - begin < 8


def test_pii_streets_in_linear_time():
    text = "Main Street " * 100_000
    assert pii.find(text, pii.automaton()) == [] and pii.find("on 12 May Dr. Who, in 1453 St. Peter, 3 of us drive", pii.automaton()) == []
    assert pii.find("4 " + text, pii.automaton()) == [("street", 0, 13)]


@pytest.mark.parametrize("text", ["https://host.example/x", "iban DE00 3704 0044 0532 0130 00", "the account of 1999", "ssn 000-12-1234", "a token of thanks", "the street"])
def test_pii_leaves_clean_text(text):
    assert pii.find(text, pii.automaton()) == []


def test_pii_frame(spark):
    rows = [(1, "é mail a.b@c.de, +1 (743) 555-3824", "s"), (2, None, "s"), (2, "none", "s")]
    got = {(r.row.doc_id, len(r.spans)) for r in pii.detect(h.documents(spark, rows), ["doc_id"]).collect()}
    assert got == {(1, 2), (2, 0)}
    texts = {r.doc_id: r.text for r in pii.redact(h.documents(spark, rows[:2])).collect()}
    assert texts == {1: "é mail [email], [phone]", 2: None}
    assert pii.detect(h.awkward(spark), ["doc_id", "row", "a.b"]).count() == 10 and pii.redact(h.awkward(spark)).columns[-5] == "a.b"
    assert pii.detect(h.empty(spark), ["doc_id"]).count() == 0


# --- op 2

@pytest.mark.parametrize("set_bytes", [decontamination.SET_BYTES, 0])
def test_decontamination(spark, set_bytes):
    r = random.Random(3)
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (10, "Zwölf Äpfel"), (2, "One two three four five six seven eight nine ten"), (3, None), (4, "..."),
             (None, "nobody owns this item here"), (2, "One two three four five six seven eight nine ten")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x, one two three four five six seven eight nine ten! eleven-twelve y"), (2, "one two three"), (3, None), (4, "die zwölf äpfel; zwölf Äpfel"), (5, ""),
            (6, "ZWÖLF äpfel"), (7, "so nobody owns this item here"), (8, " ".join(r.choice("abc") for _ in range(500))), (8, "zwölf äpfel")]
    found = decontamination.scan(h.documents(spark, rows), bench, ["doc_id"], set_bytes=set_bytes).collect()
    got = sorted((x.row.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in found)
    want = []
    for i, t in rows:
        n, hit, names = h.marked_words(t, items)
        want.append((i, n, len(hit), tuple(sorted(names))))
    assert got == sorted(want)
    kept = decontamination.decontaminate(h.documents(spark, rows), bench, set_bytes=set_bytes)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, t in rows if not h.marked_words(t, items)[1])
    cut = {x.doc_id: x.text for x in decontamination.decontaminate(h.documents(spark, rows[:4]), bench, remove="spans", set_bytes=set_bytes).collect()}
    assert cut == {1: "x,  y", 2: "one two three", 3: None, 4: "die zwölf äpfel; "}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.scan(h.awkward(spark), bench, ["doc_id", "row", "a.b"]).collect()
    assert len(found) == 10 and sum(x.n_hit > 0 for x in found) == 2
    assert decontamination.scan(h.awkward(spark), none, ["doc_id"]).agg(F.sum("n_hit")).first()[0] == 0
    assert decontamination.decontaminate(h.awkward(spark), bench, remove="spans").columns == h.awkward(spark).columns
    assert decontamination.scan(h.empty(spark), bench, ["doc_id"]).count() == 0


# --- op 3

def test_settle_keeps_words():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 500):
        p, words = rng.random(n), rng.integers(0, 50, n)
        out, rest = mixing.settle(p.copy(), words, rng)
        fractional = [i for i, q in enumerate(out) if 0 < q < 1]
        assert fractional == ([rest] if rest >= 0 else [])
        moved = words > 0
        assert abs((out * words)[moved].sum() - (p * words)[moved].sum()) < 1e-6 * max(1, words.sum())


def test_settle_is_unbiased():
    rng = np.random.default_rng(1)
    p, words = np.array([0.2, 0.7, 0.4, 0.9]), np.array([3, 5, 2, 9])
    total = np.zeros(4)
    for _ in range(20_000):
        out, rest = mixing.settle(p.copy(), words, rng)
        if rest >= 0:
            out[rest] = rng.random() < out[rest]
        total += out
    assert np.allclose(total / 20_000, p, atol=0.015)


def filled(sizes, weights):
    """Targets by sharing the excess again and again."""
    target, free, left = {}, dict(zip(sizes, weights)), 1.5 * sum(sizes.values())
    while True:
        each = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in each if each[s] > 2 * sizes[s]]
        if not over:
            return {**target, **each}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del free[s]


@pytest.mark.parametrize("block,fan", [(512, 64), (3, 2)])
def test_mixing(spark, corpus, block, fan):
    rows, df = corpus
    units = mixing.copies(df, block=block, fan=fan)
    got = mixing.per_row(units).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(h.WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled({s: sizes[s] for s in order}, [(3, 1, 2)[i % 3] for i in range(len(order))])
    largest = max(len(h.WORD.findall(t or "")) for _, t, _ in rows)
    assert len(got) == len(rows) and all(0 <= x.copies <= 2 for x in got)
    for s in order:
        mine = [x for x in got if x.source == s]
        assert abs(mine[0].target - want[s]) < 1e-6 and mine[0].source_size == sizes[s]
        assert abs(sum(x.copies * x.size for x in mine) - want[s]) <= largest
    again = mixing.per_row(mixing.copies(df.repartition(7), block=block, fan=fan)).collect()
    key = lambda x: (x.k1, x.k2, x.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    if block == 512:
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns
        assert mixed.count() == sum(x.copies for x in got)


def test_mixing_edges(spark):
    assert mixing.copies(h.empty(spark)).count() == 0 and mixing.mix(h.empty(spark)).count() == 0
    odd = h.awkward(spark)
    rows = mixing.per_row(mixing.copies(odd)).collect()
    assert len(rows) == 10 and all(0 <= x.copies <= 2 for x in rows)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() == sum(x.copies for x in rows)
    same = h.documents(spark, [(1, "a b c", "s")] * 300 + [(2, "d", "t")])
    rows = mixing.per_row(mixing.copies(same)).collect()
    assert len(rows) == 301
    blank = mixing.copies(h.documents(spark, [(1, None, "s"), (2, "", "t")])).collect()
    assert all(x.target == 0 and x.taken_copies == 0 for x in blank)


# --- op 4

def test_ngram_join(spark, corpus):
    rows, df = corpus
    want = h.near_components([(i, t) for i, t, _ in rows])
    got = ngram_join.components(df, ["doc_id", "text"]).collect()
    key = lambda i, t, n, c: (str(i), str(t), n, str(c))
    assert sorted(key(x.row.doc_id, x.row.text, x.n_shingles, x.component_id) for x in got) == sorted(
        key(i, t, len(h.shingles(t)), c) for (i, t, _), c in zip(rows, want))
    kept = ngram_join.deduplicate(df).collect()
    groups = {}
    for (i, t, _), c in zip(rows, want):
        if h.shingles(t):
            groups.setdefault(c, []).append(i)
    wordless = sum(not h.shingles(t) for _, t, _ in rows)
    assert len(kept) == len(groups) + wordless


def test_ngram_join_many_near_copies(spark, monkeypatch):
    """Frequent tokens go last, and links are found whatever the frequencies say."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in r.sample(range(60), r.randint(0, 3)):
            w[k] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    for frequent, most in ((2, 10), (10**9, 10)):
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        got = {x.row.doc_id: x.component_id for x in ngram_join.components(h.documents(spark, rows), ["doc_id"], broadcast_tokens=most).collect()}
        assert [got[i] for i in range(40)] == h.near_components(rows)


def test_ngram_join_edges(spark):
    assert ngram_join.components(h.empty(spark), ["doc_id"]).count() == 0 and ngram_join.deduplicate(h.empty(spark)).count() == 0
    odd = h.awkward(spark)
    got = ngram_join.components(odd, ["doc_id", "row", "a.b"]).collect()
    assert sorted((str(x.row.doc_id), x.n_shingles > 0, str(x.component_id)) for x in got) == sorted([
        ("1", False, "1"), ("2", False, "2"), ("3", False, "3"), ("4", True, "4"), ("4", True, "4"), ("4", True, "4"), ("None", True, "None"), ("None", False, "None"),
        ("5", True, "5"), ("6", True, "5")])
    kept = ngram_join.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == 8


# --- op 5

def test_lookup_table():
    table = sharding.lookup_table(("a", "b", "c"), 101)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    more = sharding.lookup_table(("a", "b", "c", "d"), 101)
    moved = sum(x != y for x, y in zip(table, more) if y != 3)
    assert moved < 35           # besides the slots of the newcomer few change hands
    for bad in ((("a",), 100), ((), 101)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding(spark):
    odd = h.awkward(spark).withColumn("slot", F.lit("taken"))
    out = sharding.shard(odd)
    assert out.columns == [*odd.columns, "_slot", "shard"] and out.count() == 10
    assert {r.shard for r in out.collect()} <= set(sharding.SHARDS)
    assert sharding.shard(h.empty(spark)).count() == 0
    same_id = sharding.shard(h.documents(spark, [(1, f"text {i}") for i in range(300)]))
    assert same_id.select("shard").distinct().count() == len(sharding.SHARDS)


# --- op 6

@pytest.mark.parametrize("size,gram", [(50, 25), (7, 4)])
def test_substring(spark, corpus, size, gram):
    rows, df = corpus
    kept = h.windows_removed([(i, t) for i, t, _ in rows], size)
    got = substring.parse(df, ["doc_id", "text"], size=size, gram=gram, with_text=True).collect()
    want = sorted((str(i), str(t), len(h.WORD.findall(t or "")), len(h.WORD.findall(t or "")) - len(k), h.sha(" ".join(k))) for (i, t, _), k in zip(rows, kept))
    assert sorted((str(x.row.doc_id), str(x.row.text), x.n_words, x.n_removed, x.kept_sha256) for x in got) == want
    for x in got:
        covered, mine = set(), h.WORD.findall(x.row.text or "")
        for f in x.factors:
            assert f.words >= size and f.reference < (x.row.doc_id if x.row.doc_id is not None else 2**63 - 1)
            assert any(mine[f.word:f.word + f.words] == h.WORD.findall(t or "")[f.place:f.place + f.words] for i, t, _ in rows if i == f.reference)
            covered.update(range(f.word, f.word + f.words))
        spans = {k for s in x.spans for k in range(s.word, s.word + s.words)}
        assert covered <= spans and len(spans) == x.n_removed == sum(s.words for s in x.spans)
        if x.kept_text is not None:
            assert h.sha(x.kept_text) == x.kept_sha256


def test_substring_greedy(spark):
    """Factors against a parse in plain Python: passages of several earlier documents one after another, overlapping, repeated inside a document, and cut by an older one."""
    r = random.Random(11)
    a, b, c = (h.WORD.findall(h.prose(r, 60)) for _ in range(3))
    own = lambda n: h.WORD.findall(h.prose(r, n))
    docs = [(1, a + own(5) + b), (2, own(9) + c + a[20:] + own(3)), (3, b + c), (4, a[:40] + b[10:50] + b[10:50] + own(2) + c[5:]), (5, own(4) + c + a[20:45] + a + a),
            (6, a + own(1) + a[:30] + a[10:55]), (7, b[30:] + c[:30] + own(20)), (9, ["x"] * 40), (10, ["x"] * 55 + own(3)), (11, a[:7] + own(30) + a[:6]), (12, b + c + own(1))]
    docs = [(i, " ".join(w)) for i, w in docs]
    got = {x.row.doc_id: x for x in substring.parse(h.documents(spark, docs), ["doc_id"], size=7, gram=4).collect()}
    want = dict(zip([i for i, _ in docs], h.relative_parse(docs, 7)))
    assert {i: [tuple(f) for f in x.factors] for i, x in got.items()} == want and sum(map(len, want.values())) > 20
    assert any(x.n_removed > sum(f.words for f in x.factors) for x in got.values())      # windows across the end of a factor


def test_substring_edges(spark):
    odd = h.awkward(spark)
    got = sorted((str(x.row.doc_id), x.n_words, x.n_removed) for x in substring.parse(odd, ["doc_id", "row", "a.b"]).collect())
    assert ("6", 60_000, 60_000) in got and sum(r for _, _, r in got) == 60_000 and len(got) == 10
    assert substring.deduplicate(odd).columns == odd.columns
    assert substring.parse(h.empty(spark), ["doc_id"]).count() == 0


# --- op 7

def labelled(spark, n=300):
    r = random.Random(2)
    rows = [(i, h.prose(r, 60) if i % 3 else " ".join(r.choice(("ZAP!!", "###", "BUY%%")) for _ in range(60))) for i in range(n)]
    return h.documents(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_classifier(spark):
    docs, labels = labelled(spark)
    got = quality_model.classify(docs, labels).collect()
    again = {x.doc_id: x.score for x in quality_model.classify(docs, labels).collect()}
    import zlib
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and again[x.doc_id] == x.score
    held = [x for x in got if x.held_out]
    assert len(held) > 20 and np.mean([x.predicted == (x.doc_id % 3 > 0) for x in held]) > 0.95


def test_classifier_edges(spark):
    docs, labels = labelled(spark, 30)
    none = labels.filter("false")
    assert {x.score for x in quality_model.classify(docs, none).collect()} == {0.5}
    one = quality_model.classify(docs, labels.filter("quality = 1")).collect()
    assert len({round(x.score, 9) for x in one}) == 1 and one[0].score > 0.5
    odd = quality_model.classify(h.awkward(spark), labels.unionByName(labels).withColumn("quality", F.when(F.col("doc_id") > 2, F.col("quality")))).collect()
    assert len(odd) == 10 and all(0 <= x.score <= 1 for x in odd)
    assert quality_model.classify(h.empty(spark), labels).count() == 0


# --- op 8

def test_rules_counts(spark, corpus):
    rows, df = corpus
    odd = [(1, "a b c a b c\n\na b c a b c\n x"), (2, "### $$ |"), (3, "ç d e"), (4, "\n\n"), (5, None)]
    for r, (i, t) in zip(sorted(quality_rules.measure(h.documents(spark, odd), ["doc_id"]).collect(), key=lambda x: x.row.doc_id), odd):
        w = h.WORD.findall(t or "")
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        rep = {k + d for k, g in enumerate(tri) if tri.count(g) > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if h.WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)), t
        assert r.base_failed and not r.kept


def test_rules_clean(spark):
    good = h.prose(random.Random(1), 120)
    junk = "\n".join(" | ".join(f"cell{i}{k}" for k in range(12)) for i in range(8))
    mixed = good + "\nHome | News | About | Contact\nAll rights reserved. Cookie policy."
    docs = h.documents(spark, [(1, good), (2, junk), (3, mixed), (4, "too short"), (None, good)])
    kept = {x.doc_id: x for x in quality_rules.clean(docs).collect()}
    assert set(kept) == {1, 3, None} and kept[1].text == good and kept[3].text == good and kept[3].n_chars == len(good)
    odd = h.awkward(spark)
    out = quality_rules.clean(odd)
    assert out.columns == odd.columns and {x.doc_id for x in out.collect()} <= {5, 6}
    assert quality_rules.measure(odd, ["doc_id", "row", "a.b"]).count() == 10 and quality_rules.clean(h.empty(spark)).count() == 0


def test_rules_phrases(spark):
    r = random.Random(1)
    clean, more = (h.prose(r, 80).replace("\n", " ") for _ in range(2))
    long = f"{clean} The catalog in question has a privacy policy. {more}"
    alone = ["The catalog in question.", "A design up to date.", "The blog in é.", "log inné.", "élog in."]
    said = f"{clean} {more}\nHe said \u201clog in\u201d.\nCopyright (c)2024 Somebody.\nBy clicking sign up you agree to the terms of service and the privacy policy."
    rows = [(1, long), (2, "cata"), (3, "log in. Then more."), (4, said), *((10 + i, f"{clean}\n{t}") for i, t in enumerate(alone))]
    got = {x.row.doc_id: x for x in quality_rules.measure(h.documents(spark, rows), ["doc_id"]).collect()}
    assert {i: x.n_failed_lines for i, x in got.items()} == {1: 0, 2: 0, 3: 1, 4: 3} | {10 + i: 0 for i in range(len(alone))}
    assert got[1].kept and got[4].kept and got[4].lost_chars == sum(len(w) for t in said.split("\n")[1:] for w in t.split())
    assert quality_rules.clean(h.documents(spark, [(1, long)])).first().text == long
    con = duckdb.connect()
    more = [(30, "log in log in"), (31, "log inlog in and copyright (c)copyright (c) x"), (32, "LOG IN. Sign Up!"), (33, None), (34, "\n\nclick here\n")]
    con.register("documents", h.documents(spark, rows + more).toArrow())
    want = dict(con.execute(f"SELECT doc_id, n_failed_lines FROM ({ORACLES['op8_quality_rules']})").fetchall())
    assert want == {x.row.doc_id: x.n_failed_lines for x in quality_rules.measure(h.documents(spark, rows + more), ["doc_id"]).collect()}


def test_text_column_of_any_name(spark):
    body = h.prose(random.Random(3), 80)
    docs = spark.createDataFrame([(1, body)], "doc_id long, `a.b` string")
    assert quality_rules.clean(docs, "a.b").first()["a.b"] == body


# --- op 9

def test_banded_distance(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        a = [r.choice("abcé") for _ in range(r.randint(6, 40))]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(b))
            r.choice((lambda: b.insert(at, r.choice("abcé")), lambda: b.__setitem__(at, r.choice("abcé")), lambda: len(b) > 5 and b.pop(at)))()
        rows.append(("".join(a), "".join(b)))
    for k in (1, 2, 3):
        got = spark.createDataFrame(rows, "a string, b string").filter(F.abs(F.length("a") - F.length("b")) <= k).select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), k).alias("d")).collect()
        assert all(min(x.d, k + 1) == min(h.edits(x.a, x.b), k + 1) for x in got)


@pytest.mark.parametrize("allowed,hot", [(((12, 2),), 200), (((12, 3),), 2), (line_dedup.ALLOWED, 200), (line_dedup.ALLOWED, 1)])
def test_line_dedup(spark, allowed, hot):
    r = random.Random(9)
    base = ["".join(r.choice("abcde fghé") for _ in range(r.choice((r.randint(5, 40), 11, 12, 13, 28, 29, 30, 31, 32)))) for _ in range(20)] + ["same beginning of them all " + "".join(r.choice("xyz") for _ in range(12)) for _ in range(12)]
    rows = []
    for i in range(25):
        lines = []
        for _ in range(r.randint(1, 5)):
            line = list(r.choice(base))
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                at = r.randrange(len(line))
                r.choice((lambda: line.insert(at, "q"), lambda: line.__setitem__(at, "z"), lambda: line.pop(at)))()
            lines.append("".join(line))
        rows.append((i, "\n".join(lines + [""] * (i % 2))))
    grant = lambda n: max((e for at, e in allowed if n >= at), default=0)
    seen, want = [], {}
    for i, t in rows:
        gone = []
        for no, line in enumerate(t.split("\n")):
            if not h.WORD.search(line):
                continue
            if line in {x for x, _ in seen}:
                gone.append((no, True))
            elif any((k := grant(min(len(x), len(line)))) and abs(len(x) - len(line)) <= k and h.edits(x, line) <= k for x, _ in seen):
                gone.append((no, False))
            seen.append((line, i))
        want[i] = (sum(map(lambda x: bool(h.WORD.search(x)), t.split("\n"))), sum(e for _, e in gone), sum(not e for _, e in gone), [no for no, _ in gone])
    got = {x.row.doc_id: (x.n_lines, x.n_exact, x.n_near, x.removed) for x in line_dedup.decide(h.documents(spark, rows), ["doc_id"], allowed=allowed, hot=hot).collect()}
    assert got == want
    if hot == 200:
        texts = {x.doc_id: x.text for x in line_dedup.deduplicate(h.documents(spark, rows), allowed=allowed).collect()}
        for i, t in rows:
            assert texts[i] == "\n".join(x for no, x in enumerate(t.split("\n")) if no not in want[i][3])


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "Share on Facebook\nHome\nlog in"), (2, "Share on Facebok\nHomes\nlog on\nShare on Facebook")]
    got = {x.row.doc_id: x.removed for x in line_dedup.decide(h.documents(spark, rows), ["doc_id"]).collect()}
    assert got == {1: [], 2: [0, 3]}


def test_line_dedup_edges(spark):
    odd = h.awkward(spark)
    got = line_dedup.decide(odd, ["doc_id", "row", "a.b"]).collect()
    assert len(got) == 10 and {x.row.doc_id: x.n_exact for x in got}[6] == 1 and sum(x.n_exact + x.n_near for x in got) == 1
    assert line_dedup.deduplicate(odd).columns == odd.columns and line_dedup.decide(h.empty(spark), ["doc_id"]).count() == 0


def test_near_lines_share_a_key_made_by_one_expression(spark):
    import random
    from corpuscle.llm import line_dedup
    rng, rows, near = random.Random(5), [], []
    for n in [*range(10, 36), 90] * 3:
        line = "".join(rng.choice("abcdeé𝄞") for _ in range(n))
        other = list(line)
        for _ in range(dict.fromkeys(range(12), 0).get(n, 1 if n < 31 else 2)):
            at = rng.randrange(len(other))
            other[at:at + 1] = rng.choice(["", "xy", "z"])
        rows += [line, "".join(other)]
        near.append((line, "".join(other)))
    lines = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "h long, line string")
    allowed = line_dedup.ALLOWED
    dealt = line_dedup._dealt(line_dedup._measured(lines, allowed), allowed)
    specs = dealt.select(F.get(line_dedup._all_keys(allowed)[0], F.col("which")).alias("k"), "h", "key").select("h", "key", "k.probe").distinct().collect()
    index, probe = ({h: {r.key for r in specs if r.h == h and r.probe == side} for h in range(len(rows))} for side in (False, True))
    for i, (a, b) in enumerate(near):
        short, long = sorted((2 * i, 2 * i + 1), key=lambda h: len(rows[h]))
        granted = 2 if len(rows[short]) >= 30 else 1 if len(rows[short]) >= 12 else 0
        if granted and a != b and len(rows[long]) - len(rows[short]) <= granted and (granted == 2 or len(a) < 31):
            assert index[short] & probe[long], (a, b)
