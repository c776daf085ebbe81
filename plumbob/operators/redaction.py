"""Personal data in texts, replaced by its kind.

All detectors look at the original text. What they find, personal data and
things that only look like it (dates, versions, long numbers), are spans with a
weight per character; of overlapping ones the choice with the greatest total
stands, and the text is rewritten once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return len(set(digits)) > 1 and luhn(digits)


def _is_address(text: str) -> bool:
    return all(int(part) <= 255 for part in text.split("."))


def _is_phone(text: str) -> bool:
    return 7 <= len(_digits(text)) <= 15


def _is_date(text: str) -> bool:
    a, b, c = (int(p) for p in re.split("[-/.]", re.split("[T ]", text)[0]))
    month_day = (b, c) if a > 31 else (b, a)
    return 1 <= max(month_day) <= 31 and 1 <= min(month_day) <= 12


def _is_version(text: str) -> bool:
    parts = text.split(".")
    return len(parts) != 4 or not _is_address(text)


@dataclass(frozen=True)
class Finder:
    """``token`` replaces a span; None keeps it as it is."""

    kind: str
    token: str | None
    weight: int
    pattern: str
    check: Callable[[str], bool] = bool


# No letter or digit beside a number, and no further part of a dotted one.
_L, _R = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"

# What is found, what replaces it, and its weight per character.
FINDERS = (
    Finder("email", "[EMAIL]", 9, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    Finder("ssn", "[SSN]", 8, rf"{_L}(?<!-)[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_R}(?!-[0-9])"),
    Finder(
        "card",
        "[CARD]",
        8,
        rf"{_L}(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}(?:\1[0-9]{{1,3}})?|[0-9]{{4}}([ -])[0-9]{{6}}\2[0-9]{{5}}){_R}",
        _is_card,
    ),
    Finder("ip", "[IP]", 7, rf"{_L}(?<![0-9]\.)(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{_R}(?!\.[0-9])", _is_address),
    Finder("date", None, 6, rf"{_L}(?:[0-9]{{4}}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2[0-9]{{4}})(?:[T ][0-9]{{2}}:[0-9]{{2}})?{_R}", _is_date),
    Finder("version", None, 6, rf"{_L}(?<![0-9]\.)[0-9]+(?:\.[0-9]+){{2,}}{_R}", _is_version),
    Finder("number", None, 6, rf"{_L}[0-9]{{20,}}{_R}"),
    Finder("phone", "[PHONE]", 5, rf"(?<![0-9A-Za-z+])\+[0-9](?:[ ().-]{{0,2}}[0-9]){{6,14}}{_R}", _is_phone),
    Finder("phone", "[PHONE]", 5, rf"{_L}(?<![.+-])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_R}(?![.-][0-9])", _is_phone),
    Finder("phone", "[PHONE]", 5, rf"{_L}(?<![.+-])0[0-9]{{1,4}}(?:[ /-][0-9]{{2,4}}){{2,4}}{_R}(?![.-][0-9])", _is_phone),
)
_COMPILED = tuple((f, re.compile(f.pattern)) for f in FINDERS)
_GROUP = re.compile("[0-9]+")
_MAYBE = re.compile("[0-9@]")


def spans(text: str) -> list[tuple[int, int, int, Finder]]:
    """``(end, start, weight, finder)`` of everything found, by end."""
    found = []
    for finder, pattern in _COMPILED:
        if finder.kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            # A phone number may run into a number after it, so each of its ends counts.
            ends = [m.start() + e.end() for e in _GROUP.finditer(m[0])] if finder.kind == "phone" else [m.end()]
            for end in ends:
                if finder.check(text[m.start() : end]):
                    found.append((end, m.start(), finder.weight * (end - m.start()), finder))
    return sorted(found, key=lambda s: (s[0], -s[1], s[3].token is None, s[3].kind))


def chosen(found: list[tuple[int, int, int, Finder]]) -> list[tuple[int, int, int, Finder]]:
    """The spans without overlap of the greatest total weight; of equal choices that with the earlier one."""
    ends = [s[0] for s in found]
    best, take = [0], []
    for i, (_, start, weight, _) in enumerate(found):
        before = bisect_right(ends, start, 0, i)
        take.append(before if best[before] + weight > best[i] else None)
        best.append(max(best[i], best[before] + weight))
    kept, i = [], len(found)
    while i:
        if take[i - 1] is None:
            i -= 1
        else:
            kept.append(found[i - 1])
            i = take[i - 1]
    return kept[::-1]


def redact_text(text: str | None) -> str | None:
    if not text or not _MAYBE.search(text):
        return text
    out, at = [], 0
    for end, start, _, finder in chosen(spans(text)):
        if finder.token:
            out += (text[at:start], finder.token)
            at = end
    return "".join(out) + text[at:]


def redacted(text: Column) -> Column:
    """A text column with personal data replaced by its kind; null stays null."""

    @F.pandas_udf("string")
    def rewritten(values: pd.Series) -> pd.Series:
        return values.map(redact_text, na_action="ignore")

    return rewritten(text)
