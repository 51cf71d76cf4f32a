"""Plain-Python counterparts of the text operators, and awkward documents."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(random, n, vocabulary=400):
    """``n`` words of a made-up language, with stops, in lines."""
    words = ["".join(random.choice("aeiourstlné") for _ in range(random.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(random.choice(words) + (". " if random.random() < 0.1 else ".\n" if random.random() < 0.05 else " "))
    return "".join(out).strip() + "."


def documents(spark, rows):
    """Rows (doc_id, text[, source]) as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows and ids, one long text, extra columns whose names clash."""
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None, "a", "x"), (2, "", None, None), (3, " \n\t ", "a", "x"), (4, "Some words here.", "a", None), (4, "Some words here.", "a", None),
            (4, "Other words, the same id.", "b", "y"), (None, "No id at all but words.", "b", "y"), (None, None, None, None), (5, long_text, "b", None), (6, long_text, "b", None)]
    full = [(i, t, "en", s, None if t is None else len(t), e, 7, "k", e, "x", "y", "z", "w") for i, t, s, e in rows]
    return spark.createDataFrame(full, SCHEMA + ", row string, n_words int, k1 string, `a.b` string, __cleaned string, __kept string, __rest string, cleaned string")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def windows_removed(docs, size):
    """doc index -> kept words, for op 6."""
    order = [10**30 if i is None else i for i, _ in docs]
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for o, w in zip(order, words):
        for k in range(len(w) - size + 1):
            g = tuple(w[k:k + size])
            first[g] = min(first.get(g, o), o)
    out = []
    for o, w in zip(order, words):
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < o:
                gone.update(range(k, k + size))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def relative_parse(docs, size):
    """doc index -> factors (word, words, reference, place), word by word, for op 6; ids differ and are not null."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k:k + size]), (i, k))
    out = []
    for i, _ in docs:
        w, k, factors = words[i], 0, []
        while k <= len(w) - size:
            ref, place = first[tuple(w[k:k + size])]
            if ref == i:
                k += 1
                continue
            n = size
            while k + n < len(w) and first[tuple(w[k + n - size + 1:k + n + 1])] == (ref, place + n - size + 1):
                n += 1
            factors.append((k, n, ref, place))
            k += n
        out.append(factors)
    return out


def shingles(text, size=5):
    w = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def near_components(docs, percent=75):
    """Smallest id reachable by links of each document."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = Counter((a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1:])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        known = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(known) if known else None
    return [least[root(i)] for i in range(len(docs))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def marked_words(text, items, size=10):
    """(words, which are hit, items found) for op 2."""
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: cut.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    w = low(text)
    hit, found = set(), set()
    for item, t in items:
        iw = low(t)
        n = min(size, len(iw))
        for k in range(len(iw) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j:j + n] == iw[k:k + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), hit, found
