"""Column functions on text. All run inside the JVM; none needs a shuffle."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_SITE, SiteRules
from . import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` reads it.

    Inside higher-order functions a plain column expression is evaluated again for every
    element, and the optimizer may move a column's definition into a lambda that reads it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def word_list(words: Sequence[str]) -> Column:
    """Words or patterns as one array literal."""
    quoted = ("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({', '.join(quoted)})")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words. ``text`` is read once per word: pass a column."""
    return F.exists(word_list(words), lambda word: F.contains(text, word))


# --- normalisation --------------------------------------------------------------------


def ustrip(text: Column) -> Column:
    """Strip all Unicode white space at both ends (Spark's ``trim`` strips only blanks)."""
    return F.btrim(text, F.lit(P.WS_CHARS))


def collapse_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"{P.UNICODE}[{P.WS}]+", " "))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Only texts beyond ASCII, which NFKC leaves as it is, go to the Arrow UDF.

    For columns of a table; within a page the parser has made the form already.
    """

    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    beyond_ascii = F.when(F.length(text) != F.octet_length(text), text)
    return F.coalesce(F.arrow_udf(compose, "string")(beyond_ascii), text)


def normalize_text(text: Column) -> Column:
    """NFKC, runs of white space to one blank, no white space at the ends."""
    return collapse_space(nfkc(text))


def to_halfwidth(text: Column) -> Column:
    """Full-width digits, hyphen, parentheses and blank to ASCII."""
    return F.translate(text, P.WIDE_FROM, P.WIDE_TO)


def decode_email(text: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """Undo the usual ways of hiding an e-mail address, in a fixed order."""
    for step in P.EMAIL_DECODING:
        if step in P.EMAIL_DECODING_BARE and not site.bare_words:
            continue
        hidden, character = step
        if hidden.startswith("(?"):
            text = F.regexp_replace(text, hidden, character)
        else:
            text = F.replace(text, F.lit(hidden), F.lit(character))
    return text


def normalize_phone(phone: Column) -> Column:
    """Digits, hyphens and a plus sign only; 10 and 11 bare digits are grouped."""

    def group(digits: Column) -> Column:
        city = F.startswith(digits, F.lit("03")) | F.startswith(digits, F.lit("06"))
        return (
            F.when(
                digits.rlike(r"^\p{Nd}{10}$"),
                F.when(city, F.regexp_replace(digits, "^(..)(....)(....)$", "$1-$2-$3"))
                .otherwise(F.regexp_replace(digits, "^(...)(...)(....)$", "$1-$2-$3")),
            )
            .when(
                digits.rlike(r"^\p{Nd}{11}$"),
                F.regexp_replace(digits, "^(...)(....)(....)$", "$1-$2-$3"),
            )
            .otherwise(digits)
        )

    kept = F.regexp_replace(to_halfwidth(phone), r"[^\p{Nd}\-\(\)\+]", "")
    kept = F.regexp_replace(kept, r"\((\p{Nd}+)\)", "$1-")
    return let(F.btrim(F.regexp_replace(kept, "-+", "-"), F.lit("-")), group)


def clean_phone_last_resort(phone: Column) -> Column:
    """Half-width without blanks and parentheses; empty when shorter than 10 characters."""
    return let(
        F.regexp_replace(to_halfwidth(phone), f"{P.UNICODE}[{P.WS}\\(\\)]", ""),
        lambda cleaned: F.when(F.length(cleaned) >= 10, cleaned).otherwise(F.lit("")),
    )


def site_name_clean(name: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """A page's site name as a company name: without the suffix, never the site itself."""
    return let(
        ustrip(F.replace(name, F.lit(site.site_name_suffix), F.lit(""))),
        lambda cleaned: F.when(cleaned != site.site_name_self, cleaned).otherwise(F.lit("")),
    )


def contact_truncate(block: Column) -> Column:
    return F.substring(block, 1, P.CONTACT_BLOCK_CHARS)


def sheet_key(keyword: Column) -> Column:
    """A keyword as a sheet name: at most 31 characters, reserved ones replaced."""
    return F.translate(
        F.substring(keyword, 1, P.SHEET_KEY_CHARS), P.SHEET_KEY_FROM, "_" * len(P.SHEET_KEY_FROM)
    )


def percent_encode(text: Column) -> Column:
    """Percent-encoding of a query value that keeps ``/`` and ``~`` and encodes a blank as %20."""
    encoded = F.url_encode(text)
    for form, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded


def run_label(run_time: Column) -> Column:
    """One run's time stamp as an output name."""
    return F.date_format(run_time, "yyyyMMdd_HHmmss")


# --- predicates -----------------------------------------------------------------------


def valid_phone(phone: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    digits = F.length(F.replace(phone, F.lit("-"), F.lit("")))
    valid = (digits >= 10) & F.substring(phone, 1, 1).isin("0", "+")
    if site.max_phone_digits is not None:
        valid = valid & (digits <= site.max_phone_digits)
    return valid


def allowed_email(email: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    return ~F.contains(F.lower(email), F.lit(site.blocked_email_substring))


def valid_person(name: Column) -> Column:
    return F.length(name).between(2, 10) & ~name.rlike(P.NOT_A_PERSON)


def page_flags(text: Column) -> dict[str, Column]:
    """Which of the main contact words a text holds."""
    return {
        "has_inquiry": F.contains(text, F.lit("お問い合わせ")),
        "has_person": F.contains(text, F.lit("担当")),
        "has_phone": contains_any(text, ("TEL", "電話")),
        "has_at": F.contains(text, F.lit("@")),
    }


# --- matching -------------------------------------------------------------------------


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match or its group, empty when there is none."""
    return F.regexp_extract(text, pattern, group)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches or their group, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_valid_match(
    candidates: Column,
    patterns: Sequence[str],
    valid: Callable[[Column], Column],
    group: int = 0,
    clean: Callable[[Column], Column] | None = None,
) -> Column:
    """Candidates x patterns x matches in this nesting: the first that is valid, else empty.

    Both folds stop matching once a value is found.
    """

    def from_pattern(text: Column, pattern: Column) -> Column:
        found = F.regexp_extract_all(text, pattern, F.lit(group))
        if clean is not None:
            found = F.transform(found, clean)
        return or_empty(first(F.filter(found, valid)))

    def fold(items: Column, pick: Callable[[Column], Column]) -> Column:
        return F.aggregate(
            items,
            F.lit(""),
            lambda picked, item: F.when(picked != "", picked).otherwise(pick(item)),
        )

    in_order = word_list(patterns)
    return fold(candidates, lambda text: fold(in_order, lambda p: from_pattern(text, p)))
