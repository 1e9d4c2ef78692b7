"""Text without accents and compatibility forms, in lower case.

The tables are made from Python's Unicode data: a character's compatibility
decomposition less its combining marks.  Characters that become one or none are
translated; those that become several are looked up by code point in a paged
table, only in texts that have any.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = 256


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@cache
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that become one or none, and those that become several."""
    one, many = {}, {}
    for code in range(128, sys.maxunicode + 1):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            bare = _bare(c)
            if bare != c:
                (one if len(bare) < 2 else many)[c] = bare
    return one, many


@cache
def _several() -> tuple[str, list[int], list[str]]:
    """A pattern of the characters that become several, the page of each 256 code
    points (0: none of them), and the pages' entries."""
    codes = sorted(ord(c) for c in tables()[1])
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    pattern = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"
    numbers = {page: k + 1 for k, page in enumerate(sorted({code // PAGE for code in codes}))}
    pages = [numbers.get(k, 0) for k in range(0x110000 // PAGE)]
    entries = [""] * (PAGE * (len(numbers) + 1))
    for c, bare in tables()[1].items():
        entries[numbers[ord(c) // PAGE] * PAGE + ord(c) % PAGE] = bare
    return pattern, pages, entries


def fold(text: Column) -> Column:
    """Lower case without accents, marks and compatibility forms; null for null."""
    one, _ = tables()
    gone = [c for c, bare in one.items() if not bare]
    kept = [(c, bare) for c, bare in one.items() if bare]
    # most characters are ASCII: they are passed over before the larger tests
    beyond = r"[^\x00-\x7F]"
    plain = F.when(~text.rlike(beyond), text).otherwise(F.translate(text, "".join(c for c, _ in kept) + "".join(gone), "".join(bare for _, bare in kept)))
    pattern, pages, entries = _several()
    # constants of the plan; their size follows from Unicode alone
    pages_ = F.from_json(F.lit(json.dumps(pages)), "array<int>")
    entries_ = F.from_json(F.lit(json.dumps(entries)), "array<string>")

    def spelled(c: Column) -> Column:
        code = F.ascii(c)
        page = F.get(pages_, F.floor(code / PAGE).cast("int"))
        entry = F.get(entries_, (page * PAGE + code % PAGE).cast("int"))
        return F.when((page > 0) & (entry != ""), entry).otherwise(c)

    return F.lower(F.when(plain.rlike(f"(?={beyond}){pattern}"), F.array_join(F.transform(F.split(plain, ""), spelled), "")).otherwise(plain))
