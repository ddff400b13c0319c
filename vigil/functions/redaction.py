"""PII redaction of log bodies (P1) and the redacted flag.

The collector runs RE2, whose ``\\b`` and ``\\s`` are ASCII-only.  Java regexes
are used here, so the word boundary becomes ASCII lookarounds (both ends of
the card pattern are digits, so this equals RE2's ``\\b``) and ``\\s`` becomes
RE2's exact class ``[\\t\\n\\f\\r ]``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (AUTHOR_REPLACEMENT, CARD_TOKEN, EMAIL_PATTERN, EMAIL_TOKEN,
                        REDACTION_TOKENS)

CARD_PATTERN_JAVA = r"(?<![0-9A-Za-z_])[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}(?![0-9A-Za-z_])"
AUTHOR_PATTERN_JAVA = r'"author":[\t\n\f\r ]*"[^"]*"'


def redact(body: Column) -> Column:
    """Email, then card number, then JSON author — in that order.

    Each pattern only runs on bodies that can match it (an '@', four digits in
    a row, the literal ``"author":``); the guards are exact, they only skip work.
    """
    b = F.when(body.contains("@"), F.regexp_replace(body, F.lit(EMAIL_PATTERN), F.lit(EMAIL_TOKEN))) \
         .otherwise(body)
    b = F.when(b.rlike("[0-9]{4}"), F.regexp_replace(b, F.lit(CARD_PATTERN_JAVA), F.lit(CARD_TOKEN))) \
         .otherwise(b)
    b = F.when(b.contains('"author":'), F.regexp_replace(b, F.lit(AUTHOR_PATTERN_JAVA),
                                                          F.lit(AUTHOR_REPLACEMENT))).otherwise(b)
    return b


def is_redacted(body: Column) -> Column:
    cond = None
    for tok in REDACTION_TOKENS:
        c = body.contains(tok)
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False))
