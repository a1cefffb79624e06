"""Personal data, also where it is disguised, by offset-preserving transducers.

Four kinds are looked for in a text as it stands (base spans).  Then a chain of transducers
rewrites disguises: characters that look like ASCII ones (full-width, mathematical, Greek and
Cyrillic letters, digits of other scripts, invisible characters), digits spelled as words, and
"at", "dot" and "plus" in words, brackets or entities, and odd marks between fours of digits.  Every character that they write keeps the span of
source characters that it stands for, so a match in the rewritten text is mapped back to the
source.  Such a span is added if it overlaps no base span of its kind; base spans always stay.

Defined cases: null and empty texts have no spans; spans of different kinds may overlap, those
of one kind never do; repeated rows get the same spans; further columns are handed on.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairwright.llm.common import doc_texts, slices, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match cannot begin inside a run of digits: the run's start would have matched.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    """Leftmost matches: each @ with the longest run of local characters before it and a domain after it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _ip(match: str) -> bool:
    return all(len(part.lstrip("0")) < 4 and int(part) <= 255 for part in match.split("."))


def _card(match: str) -> bool:
    digits = NO_DIGIT.sub("", match)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone(match: str) -> bool:
    return 8 <= len(NO_DIGIT.sub("", match)) <= 15


def _all(pattern: re.Pattern, text: str, valid: Callable[[str], bool]) -> list[Span]:
    return [m.span() for m in pattern.finditer(text) if valid(m.group())]


def base_spans(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        found["ip"], found["card"] = _all(IP, text, _ip), _all(CARD, text, _card)
        if "+" in text:
            found["phone"] = _all(PHONE, text, _phone)
    return found


# ------------------------------------------------------------------------- transducers

#: Letters of other scripts that look like these ASCII ones, in their order.
ALIKE = str.maketrans(
    "АВЕКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρɑɡı",
    "ABEKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXoavikpagi",
)
INVISIBLE = "­​‌‍⁠﻿"
_DASHES = dict.fromkeys(map(ord, "‐‑‒–—−"), "-")
_SPACES = dict.fromkeys(map(ord, "    　"), " ")
_DOTS = dict.fromkeys(map(ord, "․。｡"), ".")
#: Digits in words, of the corpus's four languages.
SPELLED = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
} | {"oh": "0"}
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
_GAP = r"[\x20,-]{1,2}"
#: Three digits in words or more, one after the other (plain digits may stand between them).
RUN = re.compile(rf"(?i)\b(?:{_NUMBER})(?:{_GAP}(?:{_NUMBER}|[0-9])){{2,}}\b")
NUMBER = re.compile(rf"(?i)(?:{_NUMBER})|[0-9]")
#: Digits in words between plain ones.
BETWEEN = re.compile(rf"(?i)(?<=[0-9])(?:{_GAP}(?:{_NUMBER}))+(?={_GAP}[0-9])")
AT = re.compile(
    r"(?i)\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|(?<=[a-z0-9._%+-])\s+at\s+(?=[a-z0-9-]+\s*(?:[\[({<]|\.|\s(?:dot|point|punkt|punto)\b))"
    r"|(?<=[a-z0-9._%+-])\s+(?:arroba|arobase)\s+(?=[a-z0-9-]+\s*(?:[\[({<]|\.|\s(?:dot|point|punkt|punto)\b))|&#0*64;|&#x0*40;|&commat;|%40|(?<=[a-z0-9._%+-])\s+@\s*(?=[a-z0-9-]+\.)|(?<=[a-z0-9._%+-])@\s+(?=[a-z0-9-]+\.)"
)
DOT = re.compile(
    r"(?i)\s*[\[({<]\s*(?:dot|\.|point|punkt|punto)\s*[\])}>]\s*|(?<=[a-z0-9-])\s+dot\s+(?=[a-z0-9])"
    r"|(?<=[0-9])\s+(?:point|punkt|punto)\s+(?=[0-9])|&#0*46;|&#x0*2e;|&period;|(?<=[a-z0-9-])\s+\.\s+(?=[a-z]{2,}\b)"
)
#: Dots in German or Spanish words, of an address only: an English "at this point in" is none.
SPOKEN = re.compile(r"(?i)(?:(?<=\s)at\s+|@\s*)[a-z0-9-]+(?:\s+(?:punkt|punto)\s+[a-z0-9-]+)+|(?<=\s)(?:arroba|arobase)\s+[a-z0-9-]+(?:\s+(?:point|punkt|punto)\s+[a-z0-9-]+)+")
SPOKEN_DOT = re.compile(r"(?i)\s+(?:point|punkt|punto)\s+")
PLUS = re.compile(r"(?i)\bplus\s+(?=[0-9])")
#: What parts the fours of a card number, other than one space or hyphen.
FOURS = re.compile(r"(?<=[0-9]{4})(?:[\s./_,·-]{2,3}|[./_,·\t\n])(?=[0-9]{4})")
#: Texts without any of these are not rewritten.
STRANGE = re.compile("[" + INVISIBLE + "ɑɡı Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९ -―․ ⁠⁰-₟℀-⅏−①-⓿　-。！-｡\U0001d400-\U0001d7ff]")
#: The tests of disguised(): each is as wide as the alternatives of the transducers that it stands for.
_WORD = re.compile(r"\b(?:dot|plus)\b")
_BRACKET = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|point|punkt|punto)\s*[\])}>]|&(?:#0*64|#x0*40|commat|#0*46|#x0*2e|period);|%40")
_AT_WORD = re.compile(r"\s(?:arroba|arobase)\s+[a-z0-9-]+\s*(?:[\[({<]|\.|\s(?:dot|point|punkt|punto)\b)")
_NUMBER_DOT = re.compile(r"[0-9]\s+(?:point|punkt|punto)\s+[0-9]")
_BETWEEN = re.compile(rf"(?<=[0-9])(?:{_GAP}(?:{_NUMBER}))+(?={_GAP}[0-9])")
_LOOSE = re.compile(r"\s@|@\s")
_LOOSE_DOT = re.compile(r"\.(?<=\s\.)\s")
_AT = re.compile(r"at(?<=\sat)\s+[a-z0-9-]+\s*(?:[\[({<]|\.|\s(?:dot|point|punkt|punto)\b)")
_FOURS = re.compile(r"[0-9]{4}(?:[\s./_,·-]{2,3}|[./_,·\t\n])[0-9]{4}")
_SPOKEN = re.compile(r"(?:\sat\s+|@\s*)[a-z0-9-]+\s+(?:punkt|punto)\s")
_SPELLED = re.compile(rf"\b(?:{_NUMBER}){_GAP}(?:{_NUMBER}|[0-9]){_GAP}(?:{_NUMBER}|[0-9])")


def _lower(text: str) -> str:
    """Lower case, as patterns that ignore case see it."""
    return (text if text.isascii() else text.replace("İ", "i").replace("ı", "i").replace("ſ", "s")).lower()


def disguised(text: str) -> bool:
    """Whether a text has anything that the transducers rewrite (true whenever they would); cheap tests first."""
    if STRANGE.search(text) or "@" in text and _LOOSE.search(text) or _LOOSE_DOT.search(text):
        return True
    low = _lower(text)
    if ("dot" in low or "plus" in low) and _WORD.search(low) or _AT.search(low) or ("punkt" in low or "punto" in low) and _SPOKEN.search(low) or _BRACKET.search(low) or _SPELLED.search(low):
        return True
    if ("arroba" in low or "arobase" in low) and _AT_WORD.search(low):
        return True
    return bool(DIGIT.search(text) and (_FOURS.search(text) or _NUMBER_DOT.search(low) or _BETWEEN.search(low)))


class Tape:
    """A rewritten text, in parts that tell the source spans of their characters.

    A part (at, start, end, plain) begins at a place of the text; if it is plain, its characters stand for those of the source from
    start on, else all of them for the whole span.  There are as many parts as rewritings, whatever the text's length.
    """

    def __init__(self, text: str, parts: list[tuple[int, int, int, bool]] | None = None):
        self.text = text
        self.parts = [(0, 0, len(text), True)] if parts is None else parts
        self.places = [p[0] for p in self.parts]

    def _of(self, place: int) -> tuple[int, int, int, bool]:
        return self.parts[bisect.bisect_right(self.places, place) - 1]

    def source(self, start: int, end: int) -> Span:
        at, low, _, plain = self._of(start)
        first = low + start - at if plain else low
        at, low, high, plain = self._of(end - 1)
        return first, low + end - at if plain else high

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Parts replaced; a written character stands for the whole part, or for its own one where lengths agree."""
        if not edits:
            return self
        text, at = [], 0
        for lo, hi, new in edits:
            text += [self.text[at:lo], new]
            at = hi
        text.append(self.text[at:])
        parts: list[tuple[int, int, int, bool]] = []
        size = at = 0
        for lo, hi, new in [*(e for e in edits if len(e[2]) != e[1] - e[0]), (len(self.text), len(self.text), "")]:
            size = self._copy(parts, size, at, lo)
            if new:
                parts.append((size, *self.source(lo, hi), False))
                size += len(new)
            at = hi
        return Tape("".join(text), parts or [(0, 0, 0, True)])

    def _copy(self, parts: list, size: int, start: int, end: int) -> int:
        """Append what stands for the text from start to end; gives the new size."""
        i = bisect.bisect_right(self.places, start) - 1
        while start < end:
            at, low, high, plain = self.parts[i]
            stop = min(end, self.places[i + 1] if i + 1 < len(self.places) else end)
            parts.append((size, low + start - at, low + stop - at, True) if plain else (size, low, high, False))
            size, start, i = size + stop - start, stop, i + 1
        return size


def _letters(tape: Tape) -> Tape:
    edits = []
    for m in STRANGE.finditer(tape.text):
        c = m.group()
        new = "" if c in INVISIBLE else _DASHES.get(ord(c)) or _SPACES.get(ord(c)) or _DOTS.get(ord(c)) or _alike(ord(c))
        if new is None:
            digit = unicodedata.digit(c, None)
            new = str(digit) if digit is not None else unicodedata.normalize("NFKC", c).translate(ALIKE)
        if new != c and new.isascii():
            edits.append((m.start(), m.end(), new))
    return tape.rewrite(edits)


def _alike(code: int) -> str | None:
    found = ALIKE.get(code)
    return None if found is None else chr(found)


def _digits(tape: Tape) -> Tape:
    """Runs of digits in words; the gaps between them go, each digit stands for its own word."""
    edits = []
    for run in RUN.finditer(tape.text):
        at = run.start()
        for m in NUMBER.finditer(tape.text, run.start(), run.end()):
            if m.start() > at:
                edits.append((at, m.start(), ""))
            edits.append((m.start(), m.end(), SPELLED.get(m.group().lower(), m.group())))
            at = m.end()
    return tape.rewrite(edits)


def _between(tape: Tape) -> Tape:
    """Digits in words that stand between plain ones become digits; the gaps stay."""
    edits = []
    for run in BETWEEN.finditer(tape.text):
        edits += [(*m.span(), SPELLED[m.group().lower()]) for m in NUMBER.finditer(tape.text, run.start(), run.end())]
    return tape.rewrite(edits)


def _marks(pattern: re.Pattern, mark: str) -> Callable[[Tape], Tape]:
    return lambda tape: tape.rewrite([(m.start(), m.end(), mark) for m in pattern.finditer(tape.text)])


def _spoken(tape: Tape) -> Tape:
    """Dots in words between the parts of a domain."""
    edits = []
    for m in SPOKEN.finditer(tape.text):
        edits += [(*d.span(), ".") for d in SPOKEN_DOT.finditer(tape.text, m.start(), m.end())]
    return tape.rewrite(edits)


TRANSDUCERS = (_letters, _digits, _between, _spoken, _marks(DOT, "."), _marks(AT, "@"), _marks(PLUS, "+"), _marks(FOURS, "-"))


def normalise(text: str) -> Tape:
    tape = Tape(text)
    for step in TRANSDUCERS:
        tape = step(tape)
    return tape


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and added spans by kind."""
    base, added = base_spans(text), {k: [] for k in KINDS}
    if disguised(text):
        tape = normalise(text)
        if tape.text != text:
            for kind, spans in base_spans(tape.text).items():
                starts, end = [a for a, _ in base[kind]], -1
                for lo, hi in (tape.source(*s) for s in spans):  # by ascending start, as those of base are, which do not overlap
                    before = bisect.bisect_left(starts, hi) - 1  # the last one that begins before hi
                    if lo >= end and (before < 0 or base[kind][before][1] <= lo):
                        added[kind].append((lo, hi))
                        end = hi
    return base, added


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end,added>> of every text, in code points; no shuffle."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column(1).to_pylist():
                both = all_spans(text)
                rows.append(sorted(((k, a, b, bool(more)) for more, found in enumerate(both) for k in KINDS for a, b in found[k]), key=lambda s: (KINDS.index(s[0]), s[1])))
            spans = pa.array([[dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in r] for r in rows], pa.list_(span))
            yield pa.RecordBatch.from_arrays([part.column(0), spans], names=["doc_id", "spans"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,added:boolean>>")


def redacted(text: str) -> str:
    """text with every span replaced by its kind in brackets; spans that overlap are replaced together."""
    base, added = all_spans(text)
    spans = sorted((a, b, k) for found in (base, added) for k in KINDS for a, b in found[k])
    out, at, kind, end = [], 0, "", -1
    for a, b, k in spans:
        if a < end:
            end = max(end, b)
            continue
        if kind:
            out.append(f"[{kind.upper()}]")
            at = end
        out.append(text[at:a])
        kind, end = k, b
    if kind:
        out.append(f"[{kind.upper()}]")
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all rows and columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            new = [t if not t else redacted(t) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans, as op1 returns them."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [all_spans(t) for t in part.column(1).to_pylist()]
            columns = [
                part.column(0),
                *(pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in KINDS),
                pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([listed({k: base[k] + added[k] for k in KINDS}) for base, added in found], pa.string()),
                pa.array([sum(map(len, added.values())) for _, added in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
