"""Text functions as column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text knows it; Java's own class is ASCII only.
WS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN, _GAP = "[0-9a-z]+", "[\\t ]"
TOKEN = f"{_RUN}(?:[-']{_RUN})*"
HEADING = _GAP + "{0,3}" + "#{1,6}" + _GAP + "+[^\\n]*"
PARAGRAPH = f"\\n[{WS}]*\\n"
_OPENING = "[(\\['\"]"
BOUNDARY = f"(?<=[?!.])[{WS}]+(?={_OPENING}?[0-9A-Z])"

#: Ordered by their ends.
STOP_WORDS = tuple(
    "a had did and be the are there where were these have if of which with i will from an can been then when in "
    "on do who to into their or for your as has was does is this its at that what it but you how by why".split()
)


def normalize(text: Column) -> Column:
    """Curly quotes become straight ones and a long dash becomes a spaced hyphen; white space stays."""
    return F.replace(F.translate(text, "’‘“”", "''\"\""), F.lit("—"), F.lit(" - "))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words, joined by single inner apostrophes or hyphens; null gives none."""
    return F.regexp_extract_all(F.lower(normalize(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))


def without_stop_words(words: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def content_tokens(text: Column) -> Column:
    """Tokens without stop words; all of them where nothing else would be left."""
    t = tokens(text)
    kept = without_stop_words(t)
    return F.when(F.size(kept) > 0, kept).otherwise(t)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def squeeze(text: Column) -> Column:
    """White space runs become one space, none at the ends.  Only runs that are not one space already are matched."""
    return F.trim(F.regexp_replace(text, f"[{WS}]{{2,}}|[{WS}&&[^ ]]", " "))


def is_heading(text: Column) -> Column:
    """Whether the stripped text is one Markdown heading line."""
    return strip(text).rlike(f"\\A{HEADING}\\z")


def sentences(text: Column) -> Column:
    """Array of sentences.  Blank lines and headings always separate; else an end mark, white space and a capital or digit."""
    alone = F.regexp_replace(normalize(F.coalesce(text, F.lit(""))), f"(?md)^{HEADING}$", "\n\n$0\n\n")
    # white space at the ends of a paragraph is no boundary, as it lacks a mark before or a word after it
    parts = F.transform(F.split(alone, PARAGRAPH), lambda p: F.split(p, BOUNDARY))
    return F.filter(F.transform(F.flatten(parts), squeeze), lambda s: s != "")


def canonical(text: Column) -> Column:
    """The token stream between blanks, so that a match falls on token bounds; one blank without tokens."""
    t = tokens(text)
    return F.when(F.size(t) > 0, F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))).otherwise(F.lit(" "))
