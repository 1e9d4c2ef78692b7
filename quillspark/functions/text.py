"""Text views and splitters as Column builders.

Null texts behave as empty ones.  A no-break space counts as a space.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BACK_MATTER = r"(?im)^#{1,3}\s*(?:references|bibliography|appendix)\b"
COMMENT = r"(?s)<!--.*?-->"
KEPT_LINE = r"^\s*[^\s#*|>-]"
FOOTNOTE = r"^\s*\[\^"
WORD = r"[\p{L}\p{N}_]+"


def clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\u00a0", " ")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def _body(text: Column) -> Column:
    return F.regexp_replace(F.split(clean(text), BACK_MATTER, 2)[0], COMMENT, "")


def prose(text: Column) -> Column:
    """One line of running text: back matter, comments, headings, lists, tables,
    quotes and footnotes removed."""
    return F.array_join(F.filter(lines(_body(text)), lambda x: x.rlike(KEPT_LINE) & ~x.rlike(FOOTNOTE)), " ")


SECTION_LINE = r"(?m)^(?:\\(?:sub)?section\*?\{([^}]*)\}|#{2,3}[^\S\n]+(.+))$"


def section_bodies(text: Column) -> Column:
    """The texts under a document's section headings, none without headings."""
    parts = F.split(F.regexp_replace(clean(text), SECTION_LINE, "\u0001$1$2\u0001"), "\u0001")
    # heading and body take turns after what stands before the first heading
    return F.filter(parts, lambda x, i: (i > 0) & (i % 2 == 0))


def prose_paragraphs(text: Column) -> Column:
    """As ``prose`` with lines stripped and blank lines kept."""
    stripped = F.transform(lines(_body(text)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(stripped, lambda x: (x == "") | (x.rlike(KEPT_LINE) & ~x.rlike(FOOTNOTE)))
    return F.array_join(kept, "\n")


def without_parentheses(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^)]*\)", "")


def word_count(text: Column) -> Column:
    """Words of letters, digits and underscores, one at least."""
    return F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1))


def spaced_words(text: Column) -> Column:
    """How many runs of non-space a text has."""
    return F.regexp_count(text, F.lit(r"\S+"))


def sentences(text: Column, least: int) -> Column:
    """Sentences of at least so many space-separated words."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: spaced_words(s) >= least)


def tokens(text: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


# Java's classes, of which Python's parser knows the names.
_CLASSES = {"CATEGORY_SPACE": " \t\n\x0b\f\r", "CATEGORY_DIGIT": "0123456789"}


def _first(nodes) -> tuple[set[str], bool]:
    """The characters that a match of parsed pattern nodes can begin with, and
    whether it can be empty; LookupError if they aren't few."""
    found: set[str] = set()
    for op, arg in nodes:
        kind = str(op)
        if kind in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if kind == "LITERAL":
            own, empty = {chr(arg)}, False
        elif kind == "IN":
            own, empty = set(), False
            for sub, what in arg:
                if str(sub) == "RANGE":
                    own |= set(map(chr, range(what[0], what[1] + 1)))
                else:
                    own |= {chr(what)} if str(sub) == "LITERAL" else set(_CLASSES[str(what)])
        elif kind == "BRANCH":
            parts = [_first(x) for x in arg[1]]
            own, empty = set().union(*(p[0] for p in parts)), any(p[1] for p in parts)
        elif kind == "SUBPATTERN":
            own, empty = _first(arg[3])
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            own, empty = _first(arg[2])
            empty = empty or arg[0] == 0
        else:
            raise LookupError(kind)
        found |= own
        if not empty:
            return found, False
    return found, True


@cache
def quick(pattern: str) -> str:
    """The same matches, tried only where a character stands that one can begin
    with; the pattern as it is where that can't be told."""
    flags, rest = re.fullmatch(r"((?:\(\?[im]+\))?)(.*)", pattern, re.S).groups()
    try:
        first, empty = _first(re._parser.parse(pattern))
    except (LookupError, re.error):
        return pattern
    if empty or len(rest) < 3 or any(ord(c) > 126 for c in first):
        return pattern
    return f"{flags}(?=[{''.join(f'\\x{ord(c):02x}' for c in sorted(first))}])(?:{rest})"


def count(text: Column, *patterns: str) -> Column:
    """Matches of all patterns together."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(quick(p)))
    return total


def per_thousand(n: Column, words: Column) -> Column:
    """1000 n / words to two decimals, rounded half up in whole numbers."""
    return F.expr("0.0D") + F.floor((F.lit(200000) * n + words) / (F.lit(2) * words)).cast("double") / 100


def spread(values: Column) -> Column:
    """Population deviation over mean of an array of numbers; 0 if empty."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    mean = total / F.greatest(n, F.lit(1))
    return F.when(n > 0, F.sqrt(F.greatest(squares / F.greatest(n, F.lit(1)) - mean * mean, F.lit(0.0)))).otherwise(0.0), mean
