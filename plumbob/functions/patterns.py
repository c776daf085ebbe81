"""Regular expressions written for Python, run by Spark.

Rules arrive with Python syntax. Spark evaluates them with Java's engine, which
differs in a few spellings; the differences are rewritten and what has no
counterpart is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

# The two patterns used by derived rules.
EMAIL_RULE = r"^[^@]+@[^@]+\.[^@]+$"
PHONE_RULE = r"^\+?[\d\s\-\(\)]{7,15}$"

# Named formats for conformity checks.
FORMATS = {
    "e164": r"\+[1-9]\d{1,14}",
    "iso_country2": r"[A-Z]{2}",
    "iso_country3": r"[A-Z]{3}",
    "iso_currency": r"[A-Z]{3}",
    "iso_language": r"[a-z]{2}",
    "iso_date": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])",
    "iso_datetime": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "ipv4": r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)",
    "email": EMAIL_RULE,
}

_TOKEN = re.compile(
    r"(?P<escape>\\.)|(?P<cls>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<named>\(\?P<(?P<name>\w+)>)"
    r"|(?P<back>\(\?P=(?P<back_name>\w+)\))|(?P<cond>\(\?\()|(?P<open>\{,(?=\d*\}))",
    re.S,
)


class UnsupportedPattern(ValueError):
    """The pattern is valid Python but has no Spark counterpart."""


def _group(name: str) -> str:
    return re.sub(r"_", "U95", name)


def _in_class(text: str) -> str:
    """Inside a class, Java gives ``[`` and ``&&`` a meaning Python does not."""
    head = 2 if text.startswith("[^") else 1
    body = text[head:-1]
    if body.startswith("]"):
        body = "\\" + body
    body = re.sub(r"\\.|\[|&&", lambda m: {"[": r"\[", "&&": r"&\&"}.get(m[0], m[0]), body, flags=re.S)
    return text[:head] + body + "]"


def to_java(pattern: str) -> str:
    """Rewrite a Python pattern for Java; raises on what cannot be rewritten."""
    re.compile(pattern)

    def swap(m: re.Match) -> str:
        if m["escape"]:
            return {r"\Z": r"\z"}.get(m["escape"], m["escape"])
        if m["cls"]:
            return _in_class(m["cls"])
        if m["named"]:
            return f"(?<{_group(m['name'])}>"
        if m["back"]:
            return rf"\k<{_group(m['back_name'])}>"
        if m["cond"]:
            raise UnsupportedPattern(f"conditional group in {pattern!r}")
        return "{0,"

    return _TOKEN.sub(swap, pattern)


def full_match(text: Column, pattern: str) -> Column:
    r"""Whole-string match; plain ``rlike`` searches, and ``$`` stops before ``\n``."""
    return text.rlike(rf"(?U)\A(?:{to_java(pattern)})\z")
