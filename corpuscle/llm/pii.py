"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, the ``://`` of schemes, and words that announce an identifier.  Around each anchor a
deterministic parser expands to both sides and validates what it finds.  Nothing is searched where no anchor is.

Base kinds, leftmost and non-overlapping within their kind, matches that fail a check dropped without another try:
  email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
  ip     four numbers joined by dots, none above 255
  card   digits, single spaces or hyphens between them allowed; 12 to 19 digits with a valid Luhn sum
  phone  ``+``, a digit, then digits, spaces, dots, hyphens and parentheses, a digit last; 9 to 15 digits
Added kinds, each behind an announcing word or scheme:
  url      an address with a user name or password before the host
  iban     after "iban": country, check digits and account with a valid remainder modulo 97; it has the length of its country, else it ends at the last group that makes it valid
  account  after "account", "acct", "konto", "compte", "cuenta", their plurals and compounds listed in ``CUES``: 6 to 18 digits, single hyphens or spaces between
  ssn      after "ssn" or "social security": ddd-dd-dddd, with no part of zeros
  secret   after "token", "secret", "password", "passwd", "api_key", "apikey": ``=`` or ``:``, then a word of 16 characters or more that holds both a letter and a digit
  street   a house number of up to five digits, capitalised words or ordinals, then "street", "avenue", "road", "lane" or a capitalised word of ``STREETS`` as a whole word; the latter
           need a name in between, which for an abbreviation is more than a month ("12 May Dr. Who")

Positions count code points, ends exclusive.

Edge cases: a null text is empty and has no spans; every row is searched by itself, so repeated ids, rows and extra columns do not matter; an anchor at either end of a text
expands no further.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import col, free_name, map_texts, named, row_schema

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "ssn", "secret", "street")
KINDS = BASE + ADDED

# fixed values: the words that announce an identifier
_KONTO = tuple(f"{a}konto{b}" for a in ("", "bank", "giro", "spar", "spenden") for b in ("", "s", "nr", "nummer", "nummern"))
CUES = {"iban": ("iban", "ibans"), "account": ("account", "accounts", "acct", "accts", *_KONTO, "konten", "compte", "comptes", "cuenta", "cuentas"),
        "ssn": ("ssn", "ssns", "social security"),
        "secret": ("token", "secret", "password", "passwd", "api_key", "apikey"), "street": ("street", "avenue", "road", "lane")}

STREETS = ("drive", "boulevard", "court", "place", "square", "terrace", "highway", "parkway", "way", "circle", "crescent", "close", "alley", "trail")
STREETS_SHORT = ("st", "ave", "rd", "ln", "dr", "blvd", "ct", "pl", "sq", "ter", "hwy", "pkwy", "cir", "cres", "trl")
_MONTHS = frozenset("january february march april may june july august september october november december".split())

# lengths of the IBAN registry
IBAN_LENGTHS = {country: int(length) for length, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}

_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_DIGITS = frozenset("0123456789")
_PHONE = _DIGITS | frozenset(" ().-")
_SLICE = 200

_AFTER_CUE = r"[\s\"'-]{0,2}(?i:numbers?|nummern?|n[uú]m[eé]ros?|nos?|nr|num)?[\s\"'.:#=-]{0,4}"
_PARSERS = {
    "iban": re.compile(_AFTER_CUE + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])"),
    "account": re.compile(_AFTER_CUE + r"([0-9](?:[ -]?[0-9]){5,17})(?![0-9])"),
    "ssn": re.compile(_AFTER_CUE + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
}
_SECRET_HEAD = re.compile(r"[\"']?\s{0,2}[=:]\s{0,2}[\"']?")
_SECRET_RUN = re.compile(r"[A-Za-z0-9_+/.=-]*")
_SECRET_LEAST = 16
_URL = re.compile(r"://([^\s/@:\"'<>]+(?::[^\s/@\"'<>]*)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:/[^\s\"'<>]*)?)")
_HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?$")
_ORDINAL = re.compile(r"[0-9]{1,5}(?:st|nd|rd|th)", re.IGNORECASE)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, (c if c in "@+" else "digit", 1))
    found.add_word("://", ("url", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title(), *[cue[:-1].upper() + "s"] * cue.endswith("s")}:
                found.add_word(form, (kind, len(cue)))
    for cue in STREETS + STREETS_SHORT:
        for form in (cue.upper(), cue.capitalize()):
            found.add_word(form, ("street", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def iban_end(value: str) -> int:
    """Where the IBAN at the beginning of ``value`` ends, 0 without one.  Groups behind it may belong to the next word or number."""
    ends = [i for i in range(len(value), 0, -1) if i == len(value) or value[i] == " "]
    own = IBAN_LENGTHS.get(value[:2])
    ends.sort(key=lambda i: i - value.count(" ", 0, i) != own)       # that of the country first, then from the longest
    return next((i for i in ends if iban(value[:i])), 0)


def _emails(text: str, signs: list[int]):
    done = 0
    for at in signs:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end, labels = at + 1, 0
        while True:
            begin = end
            while end < len(text) and text[end] in _LABEL:
                end += 1
            if end == begin:
                end = begin - (labels > 0)          # the dot before an empty label stays outside
                break
            labels += 1
            if end >= len(text) or text[end] != ".":
                break
            end += 1
        if start < at and labels >= 2:
            done = end
            yield "email", start, end


def _runs(positions: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive positions."""
    runs: list[tuple[int, int]] = []
    begin = last = -2
    for p in positions:
        if p != last + 1:
            if last >= 0:
                runs.append((begin, last + 1))
            begin = p
        last = p
    if last >= 0:
        runs.append((begin, last + 1))
    return runs


def _chains(text: str, runs: list[tuple[int, int]], joints: str):
    """Runs of digits with one of ``joints`` between each two."""
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and not (run[0] == chain[-1][1] + 1 and text[run[0] - 1] in joints):
            yield chain
            chain = []
        chain.append(run)
    if chain:
        yield chain


def _numbers(text: str, runs: list[tuple[int, int]]):
    for chain in _chains(text, runs, "."):
        for i in range(0, len(chain) - 3, 4):
            if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or "0") <= 255 for a, b in chain[i:i + 4]):
                yield "ip", chain[i][0], chain[i + 3][1]
    for chain in _chains(text, runs, " -"):
        n = sum(b - a for a, b in chain)
        if 12 <= n <= 19 and luhn("".join(text[a:b] for a, b in chain)):
            yield "card", chain[0][0], chain[-1][1]


def _phones(text: str, plus: list[int]):
    for at in plus:
        if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
            continue
        end, last, digits, counted = at + 2, 0, 1, 0
        while end < len(text) and text[end] in _PHONE:
            if text[end] in _DIGITS:
                digits += 1
                if end >= at + 3:
                    last, counted = end, digits
            end += 1
        if last and 9 <= counted <= 15:
            yield "phone", at, last + 1


def _streets(text: str, cues: list[tuple[int, int]]):
    """House numbers in front of street words, with nothing but capitalised words in between."""
    done = 0
    house: dict[int, int] = {}          # of the street words seen so far, by their beginning; a later one need not go further back
    for begin, end in cues:
        if begin > 0 and text[begin - 1].isalnum() or end < len(text) and text[end].isalnum():
            continue
        at, number = begin, -1
        while at > 0 and text[at - 1] == " ":
            start = at - 1
            while start > 0 and (text[start - 1].isalnum() or text[start - 1] in ".'\u2019-"):
                start -= 1
            word = text[start:at - 1]
            if m := _HOUSE.search(word):
                number = start + m.start()
                break
            if not (word[:1].isupper() and not any(map(str.isdigit, word)) or _ORDINAL.fullmatch(word)):
                break
            at = start
            if at in house:
                number = house[at]
                break
        house[begin] = number
        if number < done:
            continue
        cue, names = text[begin:end].lower(), text[number:begin].split()[1:]
        plain = cue not in STREETS and cue not in STREETS_SHORT
        if plain or names and not (cue in STREETS_SHORT and len(names) == 1 and names[0].lower() in _MONTHS):
            done = end
            yield "street", number, end


class _Secrets:
    """Values behind cues of secrets.  Many cues may lie in one run of characters; it is read once, and remembered by its end, its last digit and its last letter."""

    def __init__(self, text: str):
        self.text, self.end, self.digit, self.letter = text, -1, -1, -1

    def at(self, cue_end: int) -> tuple[int, int] | None:
        head = _SECRET_HEAD.match(self.text, cue_end)
        if not head:
            return None
        start = head.end()
        if start >= self.end:
            self.end = _SECRET_RUN.match(self.text, start).end()
            self.digit = next((i for i in range(self.end - 1, start - 1, -1) if self.text[i].isdigit()), -1)
            self.letter = next((i for i in range(self.end - 1, start - 1, -1) if self.text[i].isalpha()), -1)
        return (start, self.end) if self.end - start >= _SECRET_LEAST and min(self.digit, self.letter) >= start else None


def _announced(text: str, kind: str, begin: int, end: int, done: int, secrets: _Secrets) -> tuple[int, int] | None:
    """What a cue at text[begin:end] announces, if it begins at ``done`` or later."""
    if kind == "url":
        start = begin
        while start > done and text[start - 1] in _ALNUM:
            start -= 1
        if begin < done or start > 0 and start == done and text[start - 1] in _ALNUM:
            return None                             # begins inside the URL before it
        m = _URL.match(text, begin)
        return (start, m.end()) if m and start < begin else None
    if kind == "secret":
        return secrets.at(end)
    if begin > 0 and text[begin - 1].isalnum() or end < len(text) and text[end].isalnum():
        return None
    m = _PARSERS[kind].match(text, end)
    if not m:
        return None
    value, end = m[1], m.end(1)
    if kind == "iban":
        end = m.start(1) + iban_end(value)
        ok = end > m.start(1)
    else:
        ok = kind == "account" or "000" != value[:3] and "00" != value[4:6] and "0000" != value[7:]
    return (m.start(1), end) if ok else None


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as listed."""
    signs, plus, digits, spans = [], [], [], []
    done = dict.fromkeys(ADDED, 0)
    cues = []
    for last, (kind, length) in anchors.iter(text):
        if kind == "digit":
            digits.append(last)
        elif kind == "@":
            signs.append(last)
        elif kind == "+":
            plus.append(last)
        else:
            cues.append((kind, last + 1 - length, last + 1))
    if signs:
        spans += _emails(text, signs)
    if digits:
        spans += _numbers(text, _runs(digits))
    if plus:
        spans += _phones(text, plus)
    secrets = _Secrets(text)
    for kind, begin, end in cues:
        if kind != "street" and (found := _announced(text, kind, begin, end, done[kind], secrets)) and found[0] >= done[kind]:
            spans.append((kind, *found))
            done[kind] = found[1]
    for kind, a, b in _streets(text, [cue[1:] for cue in cues if cue[0] == "street"]):
        if a >= done[kind]:
            spans.append((kind, a, b))
            done[kind] = b
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPAN_TYPE = "array<struct<kind: string, start: bigint, end: bigint>>"


def detect(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` as struct ``row``, and all spans of each document."""
    source = documents.select(named(keep).alias("row"), col(text).alias("t"))

    def run(batches):
        anchors = automaton()
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, anchors)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _SPANS)], ["row", "spans"])

    return map_texts(source, run, row_schema(source, f"spans {_SPAN_TYPE}"))


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; of overlapping spans the first, and longest, gives the name."""
    names = documents.columns
    found = detect(documents, names, text)
    # a span is kept if it begins at or behind the end of those kept before
    step = lambda done, s: F.when(s.start < F.coalesce(F.element_at(done, -1)["end"], F.lit(0).cast("long")), done).otherwise(F.concat(done, F.array(s)))
    ordered = F.array_sort("spans", lambda a, b: F.when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).otherwise(
        F.when(a.end > b.end, -1).when(a.end < b.end, 1).otherwise(0)))
    apart = F.aggregate(ordered, F.array().cast(_SPAN_TYPE), lambda done, s: F.when(F.size(done) == 0, F.array(s)).otherwise(step(done, s)))
    mark = free_name(names, "apart")
    out = found.select(*[F.col("row").getField(c).alias(c) for c in names], apart.alias(mark))
    body = col(text)
    pieces = F.transform(F.sequence(F.lit(0), F.size(mark) - 1), lambda i: F.concat(
        F.substring(body, (F.when(i == 0, 0).otherwise(F.get(mark, i - 1)["end"]) + 1).cast("int"),
                    (F.get(mark, i)["start"] - F.when(i == 0, 0).otherwise(F.get(mark, i - 1)["end"])).cast("int")),
        F.lit("["), F.get(mark, i)["kind"], F.lit("]")))
    cut = F.concat(F.array_join(pieces, ""), F.substring(body, (F.element_at(mark, -1)["end"] + 1).cast("int"), F.length(body)))
    return out.withColumn(text, F.when(F.size(mark) > 0, cut).otherwise(body)).select(*map(col, names))
