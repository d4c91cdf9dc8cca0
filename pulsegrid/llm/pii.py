"""Personal data under disguise: normalise, detect, and map the spans back.

Plain identifiers are found in the text itself (the base spans). Then a chain of transducers
rewrites the text: look-alike characters to ASCII, spelled digits to digits, "(at)", "[dot]" and
their spoken forms to ``@`` and ``.``, single spelled digits beside a ``.`` to digits. Each rewritten character carries the source range it came
from, so what the same detectors find in the rewritten text maps back to source offsets. A span
found this way is added if it covers a rewritten character and no base span of its kind reaches out of it or equals it.

All detectors are linear in the text: an email is looked for around each ``@``, a number run is
consumed once. Offsets are code points, the end is exclusive.

Defined results: null and empty texts have no spans; the digest is that of the empty string.
Repeated rows give repeated results, null ids stay null, extra columns are ignored by ``detect``
and kept by ``redact``. No rows give no rows.
"""

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]").search


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text):
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def _octet(part):
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _ips(text):
    return [m.span() for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]


def _cards(text):
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def _phones(text):
    out, at = [], text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list:
    """(kind index, start, end) by kind, then start."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT(text):
        out += [(1, *s) for s in _ips(text)] + [(2, *s) for s in _cards(text)] + [(3, *s) for s in _phones(text)]
    return out


# Letters of other scripts that look like ASCII letters, in the same order as the ASCII ones.
_ALIKE = ("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅοανιρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ",
          "aeopcyxijsdhqwABEKMHOPCTYXIJSoavipTukABEZHIKMNOPTYXiag")


def _alike_table() -> dict:
    """Character to ASCII text: full-width and styled forms by their decomposition, decimal digits by value."""
    table = {ord(a): b for a, b in zip(*_ALIKE)}
    for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474)]:
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain.isascii():
            table[c] = plain
    for c in range(0x660, 0x1FBFA):
        if unicodedata.category(chr(c)) == "Nd":
            table[c] = str(unicodedata.decimal(chr(c)))
    return table | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD), "")


_ALIKE_OF = _alike_table()
_ALIKE_RE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_ALIKE_OF)) + "]")
# a quick look: the same characters below U+10000 (one bitmap), or anything above
_ALIKE_LOW = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_ALIKE_OF) if c < 0x10000) + "]").search
_HIGH = re.compile("[\U00010000-\U0010ffff]").search
# The digit words.
_WORD_DIGIT = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}
_SPELLED = "|".join(f"[{w[0].upper()}{w[0]}]{w[1:]}|{w.upper()}" for w in _WORD_DIGIT)
# a digit word that stands alone and goes on: what every spelled run has
_SPOKEN = re.compile(rf"(?:[^A-Za-z0-9](?=[zotfsenZOTFSEN])|\A)(?:{_SPELLED})[ -]|[0-9][ -]++(?:{_SPELLED})").search
_RUN = re.compile(rf"(?:\b(?:[Pp]lus|PLUS)[ -]+|\+ ?)?(?<![A-Za-z0-9])(?:{_SPELLED}|[0-9]++)(?:[ -]++(?:{_SPELLED}|[0-9]++))++(?![A-Za-z])")
_AT = re.compile(r"\s{0,2}[(\[{<]\s{0,2}(?:at|At|AT|@)\s{0,2}[)\]}>]\s{0,2}"
                 r"| (?:at|AT) (?=[A-Za-z0-9-]{1,63}(?:\s{0,2}[(\[{<]\s{0,2}(?:dot|Dot|DOT)| (?:dot|DOT) ))")
_DOT = re.compile(r"\s{0,2}[(\[{<]\s{0,2}(?:dot|Dot|DOT|\.)\s{0,2}[)\]}>]\s{0,2}| (?:dot|DOT) (?=[A-Za-z0-9])")
# a single digit word beside a dot, as it stands or as it is left by the others
_LONE = re.compile(rf"(?<![A-Za-z0-9])(?:{_SPELLED})(?=\.[A-Za-z0-9])|(?<=[A-Za-z0-9]\.)(?:{_SPELLED})(?![A-Za-z0-9])")
# quick looks: the bracketed forms of _AT and _DOT (the spoken ones have a "dot"), and what _LONE needs
_BRACKET = re.compile(r"[(\[{<]\s{0,2}(?:at|At|AT|@|dot|Dot|DOT|\.)\s{0,2}[)\]}>]").search
_BY_DOT = re.compile(r"[oerxntOERXNT]\.[A-Za-z0-9]|[A-Za-z0-9]\.[zotfsenZOTFSEN]").search


def _digits(m):
    words = re.split("[ -]+", m[0].lower())
    if not any(w in _WORD_DIGIT for w in words):
        return m[0]
    return "".join("+" if w in ("plus", "+") else _WORD_DIGIT.get(w, w) for w in words)


class Rewritten:
    """A text with, for every character, the source range it stands for."""

    def __init__(self, text):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def apply(self, pattern, output):
        text, starts, ends, changed, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            to = output(m)
            if to == m[0]:
                continue
            a, b = m.span()
            text += [self.text[at:a], to]
            starts += [self.start[at:a], np.full(len(to), self.start[a])]
            ends += [self.end[at:a], np.full(len(to), self.end[b - 1])]
            changed += [self.changed[at:a], np.ones(len(to), bool)]
            at = b
        if at:
            self.text = "".join(text) + self.text[at:]
            self.start = np.concatenate([*starts, self.start[at:]])
            self.end = np.concatenate([*ends, self.end[at:]])
            self.changed = np.concatenate([*changed, self.changed[at:]])


def _disguised(text: str) -> bool:
    """True for every text without look-alike characters that the transducers change."""
    return bool("dot" in text or "Dot" in text or "DOT" in text or _BRACKET(text) or _SPOKEN(text) or _BY_DOT(text) and _LONE.search(text))


def hidden_spans(text: str, base: list) -> list:
    """Spans that only the rewritten text shows, in source offsets."""
    alike = not text.isascii() and (_ALIKE_LOW(text) or _HIGH(text))
    if not (alike or _disguised(text)):
        return []
    r = Rewritten(text)
    if alike:
        r.apply(_ALIKE_RE, lambda m: _ALIKE_OF[ord(m[0])])
    r.apply(_RUN, _digits)
    r.apply(_AT, lambda m: "@")
    r.apply(_DOT, lambda m: ".")
    r.apply(_LONE, lambda m: _WORD_DIGIT[m[0].lower()])
    out = []
    for kind, a, b in base_spans(r.text):
        s, e = int(r.start[a]), int(r.end[b - 1])
        if r.changed[a:b].any() or e - s != b - a:
            # base spans are sorted by kind and start and do not overlap within a kind
            first, last = bisect_right(base, (kind, s, s)), bisect_left(base, (kind, e))
            first -= first > 0 and base[first - 1][0] == kind and base[first - 1][2] > s
            if all(s <= x and y <= e and (s, e) != (x, y) for _, x, y in base[first:last]):
                out.append((kind, s, e))
    return out


def spans_of(text: str):
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    return base, sorted(base + hidden_spans(text, base))


def _line(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Per document the counts and digest of the base spans, and all spans as text."""
    def run(batches):
        for b in batches:
            counts, digest, lines = [], [], []
            for t in b.column(1):
                base, every = spans_of(t.as_py() or "")
                counts.append([sum(k == i for k, _, _ in base) for i in range(4)] if base else [0, 0, 0, 0])
                digest.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(every))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(n[:, i]) for i in range(4)), pa.array(digest, pa.string()), pa.array(lines, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    spans = sorted((a, b, k) for k, a, b in spans_of(text)[1])
    if not spans:
        return text
    out, at, merged = [], 0, []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text="text") -> DataFrame:
    """``docs`` with the identifiers in its text replaced; null stays null."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            new = [None if t is None else redacted(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)],
                                             docs_names)

    docs_names = docs.columns
    return docs.mapInArrow(run, docs.schema)
