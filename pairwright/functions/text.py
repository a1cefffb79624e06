"""Text functions, as column expressions where Spark has the semantics."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.udf import vectorized

#: Characters stripped from the edges of a normalised text, and phrases of refusals and of nothing to do.
EDGES = " \t\n\r.,!?;:'\""
REFUSAL = r"\b(cannot|can't|unable|no available tool|no tool|not equipped|unsupported|none of (?:the )?(?:provided|available) (?:functions|tools))\b"
NOTHING_TO_DO = ("already complete", "already completed", "already closed", "no action needed", "nothing to do")
NUMBER = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
SEPARATORS = r"(?i)\s*(?:,|;|\band\b|\n|•)\s*"  # of the items of an answer that is a set
CALL_MARKS = ("<tool_call", '"tool_call"', '"tool_calls"', '"arguments"')
LABELS = ("CALL", "ANSWER", "CLARIFY", "REFUSE", "NOOP")


def normalise(value: str) -> str:
    """NFKC, case folded, white space joined, edge punctuation stripped."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split()).strip(EDGES)


@vectorized("string")
def _normalised(text: pd.Series) -> pd.Series:
    """normalise() over a column: Spark has neither NFKC nor case folding."""
    return text.map(lambda t: None if t is None else normalise(t))


def normalize_text(text: Column) -> Column:
    """normalise() of a column.  Of texts of ASCII alone the JVM makes the same; only the others are handed to Python."""
    text = F.col(text) if isinstance(text, str) else text
    plain = ~F.regexp_like(text, F.lit(r"[^\x00-\x7f]"))
    edge = "[ .,!?;:'\"]+"  # other white space has become blanks
    joined = F.regexp_replace(F.lower(text), r"[\x09-\x0d\x1c-\x1f ]+", " ")
    return F.when(plain, F.regexp_replace(joined, rf"\A{edge}|{edge}\z", "")).otherwise(_normalised(F.when(~plain, text)))


@functools.lru_cache(1)
def foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What case folding does to letters that lower() leaves as they are: single letters, and those that become several."""
    left = {c: c.casefold() for c in map(chr, range(0x20000)) if c.lower() == c and c.casefold() != c}
    return {c: f for c, f in left.items() if len(f) == 1}, {c: f for c, f in left.items() if len(f) > 1}


def fold(text: Column) -> Column:
    """Case folding: lower(), and the foldings of the letters that it leaves as they are.

    But for the sharp s such letters are rare, so they are looked at only where one stands.
    """
    single, several = foldings()
    rest = {k: v for k, v in several.items() if k != "ß"}
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rest.items()))
    spelled = F.aggregate(pairs, F.translate(plain, "".join(single), "".join(single.values())), lambda s, p: F.replace(s, p["k"], p["v"]))
    low = [c for c in [*single, *rest] if ord(c) < 0x300]  # a few; the others begin above, among other scripts
    return F.when(F.regexp_like(plain, F.lit("[" + "".join(low) + "\\x{300}-\\x{1ffff}]")), spelled).otherwise(plain)


def normalize_query(text: Column) -> Column:
    """All runs of a-z and 0-9, joined by one space."""
    return F.array_join(F.regexp_extract_all(fold(text), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def whitespace_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), r"(?U)\s+", " "))


def five_grams(text: Column) -> Column:
    """Distinct five-character pieces of the normalised query with two spaces at each side."""
    padded = F.concat(F.lit("  "), normalize_query(text), F.lit("  "))
    return F.when(F.length(padded) < 5, F.array(padded)).otherwise(F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=(.{5}))"), F.lit(1))))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def event_slug(title: Column) -> Column:
    return F.regexp_replace(whitespace_query(title), " ", "-")


def looks_like_call(text: Column) -> Column:
    found = F.lit(False)
    for mark in CALL_MARKS:
        found = found | F.contains(F.lower(text), F.lit(mark))
    return found


def unwrapped(text: Column, any_case: bool = False) -> Column:
    """The body of a text that is one call block as a whole, else the text itself, stripped."""
    stripped = stripped_text(text)
    pattern = ("(?is)" if any_case else "(?s)") + r"\A<tool_call>(?U:\s)*(.*?)(?U:\s)*</tool_call>\z"
    return F.when(F.regexp_like(stripped, F.lit(pattern)), F.regexp_extract(stripped, pattern, 1)).otherwise(stripped)


def stripped_text(text: Column) -> Column:
    """Without white space (Unicode's, and the separators U+001C to U+001F) at its edges."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def refuses(text: Column) -> Column:
    return F.regexp_like(text, F.lit("(?i)" + REFUSAL))


def first_number(text: Column) -> Column:
    """The first number in a text, commas left out; null without one."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(",")), NUMBER, 1), F.lit("")).cast("double")


def answer_pieces(text: Column) -> Column:
    pieces = F.split(text, SEPARATORS)
    return F.filter(pieces, lambda p: p != "")


def mentions_slot(normalised: Column, slots: Column) -> Column:
    spaced = F.replace(normalised, F.lit("_"), F.lit(" "))
    return F.exists(slots, lambda s: F.contains(spaced, F.replace(s, F.lit("_"), F.lit(" "))))


def mentions_any(normalised: Column, markers: Column) -> Column:
    return F.exists(markers, lambda m: F.contains(normalised, m))


def template_family(domain: Column, label: Column, pair_id: Column) -> Column:
    group = F.regexp_extract(pair_id, r"([0-9]+)$", 1).cast("int") % 5
    return F.concat_ws("-", domain, F.lower(label), group.cast("string"))


def family_split(family: Column) -> Column:
    group = F.regexp_extract(family, r"([0-9]+)$", 1).cast("int")
    return F.when(group < 3, "train").when(group == 3, "validation").otherwise("test")


def variant_of(task_id: Column) -> Column:
    return F.regexp_extract(task_id, r"^.*-(act|abstain)$", 1)


def pair_of(task_id: Column) -> Column:
    return F.regexp_extract(task_id, r"^(.*)-(?:act|abstain)$", 1)


def stratum_of(pair_id: Column) -> Column:
    """struct<domain, label> from the first abstention label that the pair id names; null without one."""
    found = F.lit(None).cast("struct<domain:string,label:string>")
    for label in reversed(LABELS[1:]):
        mark = f"-{label.lower()}-"
        domain = F.substring_index(pair_id, mark, 1)
        found = F.when(F.contains(pair_id, F.lit(mark)), F.when(domain != "", F.struct(domain.alias("domain"), F.lit(label).alias("label")))).otherwise(found)
    return found


def script_safe(json_text: Column) -> Column:
    return F.replace(json_text, F.lit("</"), F.lit("<\\/"))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.2f%%", value.cast("double") * 100))


@vectorized("string")
def general_format(value: pd.Series) -> pd.Series:
    """Numbers as C's %g gives them; Java's differs."""
    return value.map(lambda v: None if v is None or v != v else f"{v:g}")


_SLUG = re.compile(r"[a-z0-9][a-z0-9._-]*\Z")


def is_slug(value: object) -> bool:
    return isinstance(value, str) and bool(_SLUG.match(value))


def slug_ok(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\A[a-z0-9][a-z0-9._-]*\z"))
