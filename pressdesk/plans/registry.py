"""Queries by name, each with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


# What P.WS stands for, spelled out for a regex engine whose \s is ASCII.
_SPACE = (
    r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def rx(pattern: str) -> str:
    """A pattern as a SQL literal for RE2."""
    pattern = pattern.replace(P.UNICODE, "").replace("(?iU)", "(?i)").replace("(?iu)", "(?i)")
    pattern = pattern.replace("*+", "*").replace(P.WS, _SPACE)
    return lit(pattern)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACE_CHARS = "||".join(
    f"chr({ord(c)})" for c in P.WS_CHARS
)


def strip_sql(text: str) -> str:
    return f"trim({text}, {SPACE_CHARS})"


def wide_sql(text: str) -> str:
    return f"translate({text}, {lit(P.WIDE_FROM)}, {lit(P.WIDE_TO)})"


def decode_sql(text: str) -> str:
    for hidden, character in P.EMAIL_DECODING:
        if hidden.startswith("(?"):
            text = f"regexp_replace({text}, {rx(hidden)}, '{character}', 'g')"
        else:
            text = f"replace({text}, '{hidden}', '{character}')"
    return text


def phone_sql(text: str) -> str:
    """Normalised phone; ``text`` is evaluated once in a one-element list."""
    kept = f"regexp_replace({wide_sql('r')}, '[^\\p{{Nd}}\\-\\(\\)\\+]', '', 'g')"
    kept = f"regexp_replace({kept}, '\\((\\p{{Nd}}+)\\)', '\\1-', 'g')"
    kept = f"trim(regexp_replace({kept}, '-+', '-', 'g'), '-')"
    grouped = (
        "CASE WHEN regexp_matches(p, '^\\p{Nd}{10}$') AND substr(p, 1, 2) IN ('03', '06') "
        "THEN substr(p, 1, 2) || '-' || substr(p, 3, 4) || '-' || substr(p, 7) "
        "WHEN regexp_matches(p, '^\\p{Nd}{10}$') "
        "THEN substr(p, 1, 3) || '-' || substr(p, 4, 3) || '-' || substr(p, 7) "
        "WHEN regexp_matches(p, '^\\p{Nd}{11}$') "
        "THEN substr(p, 1, 3) || '-' || substr(p, 4, 4) || '-' || substr(p, 8) ELSE p END"
    )
    return f"list_transform(list_transform([{text}], lambda r: {kept}), lambda p: {grouped})[1]"


def valid_phone_sql(phone: str) -> str:
    return f"length(replace({phone}, '-', '')) >= 10 AND substr({phone}, 1, 1) IN ('0', '+')"


def valid_person_sql(name: str) -> str:
    return f"length({name}) BETWEEN 2 AND 10 AND NOT regexp_matches({name}, {lit(P.NOT_A_PERSON)})"


def first_email_sql(text: str, blocked: str) -> str:
    """First allowed address of a text, patterns in order."""
    picks = [
        f"list_filter(regexp_extract_all({text}, {rx(p)}), lambda e: NOT contains(lower(e), '{blocked}'))[1]"
        for p in P.EMAIL_PATTERNS
    ]
    return f"coalesce({', '.join(picks)}, '')"


def url_encode_sql(text: str) -> str:
    return f"replace(url_encode({text}), '%2F', '/')"


def columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in exprs.items())


def squeeze(sql: str) -> str:
    return re.sub(r"\n\s*", " ", sql).strip()
