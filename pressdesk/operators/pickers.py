"""Rules that pick one value per field, each in its own order of preference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_SITE, SiteRules
from ..functions import patterns as P
from ..functions.text import (
    all_matches,
    allowed_email,
    clean_phone_last_resort,
    contains_any,
    first_match,
    first_valid_match,
    let,
    normalize_phone,
    or_empty,
    ustrip,
    valid_person,
    valid_phone,
    word_list,
)

# Only the start of a word, or where the last match ended, can start an address: trying
# every character of every word finds the same and takes longer.
_LOCAL_PART_START = r"(?:(?<![a-zA-Z0-9._%+-])|\G)"
_EMAILS = tuple(_LOCAL_PART_START + pattern for pattern in P.EMAIL_PATTERNS)


def company_from_text(text: Column) -> Column:
    return first_match(text, P.COMPANY_IN_TEXT, 1)


def person(text: Column) -> Column:
    """The first label whose first match is a valid name; later matches are not tried."""

    def by_label(pattern: Column) -> Column:
        return let(
            ustrip(F.call_function("regexp_extract", text, pattern, F.lit(1))),
            lambda name: F.when(valid_person(name), name).otherwise(F.lit("")),
        )

    picked = F.aggregate(
        word_list(P.PERSON_LABELS),
        F.lit(""),
        lambda found, pattern: F.when(found != "", found).otherwise(by_label(pattern)),
    )
    return F.when(contains_any(text, P.PERSON_LABEL_WORDS), picked).otherwise(F.lit(""))


def email_pick_structural(candidates: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    return first_valid_match(candidates, _EMAILS, lambda e: allowed_email(e, site))


def email_pick_context(decoded: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """Within up to 50 characters after an e-mail label."""
    windows = all_matches(decoded, P.EMAIL_WINDOW)
    picked = first_valid_match(windows, _EMAILS, lambda e: allowed_email(e, site))
    return F.when(decoded.rlike(P.EMAIL_TAIL), picked).otherwise(F.lit(""))


def email_pick_full(decoded: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    picked = first_valid_match(F.array(decoded), _EMAILS, lambda e: allowed_email(e, site))
    return F.when(decoded.rlike(P.EMAIL_TAIL), picked).otherwise(F.lit(""))


def phone_pick_structural(candidates: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    return first_valid_match(
        candidates, P.PHONE_PATTERNS, lambda p: valid_phone(p, site), 1, normalize_phone
    )


def phone_pick_labelled(text: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    return F.when(
        contains_any(text, P.PHONE_LABELLED_WORDS),
        first_valid_match(
            F.array(text), P.PHONE_LABELLED, lambda p: valid_phone(p, site), 1, normalize_phone
        ),
    ).otherwise(F.lit(""))


def phone_pick_contact(text: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """The first run of phone characters after a contact word, in the same sentence."""
    picked = let(
        normalize_phone(first_match(text, P.PHONE_NEAR_CONTACT, 1)),
        lambda phone: F.when(valid_phone(phone, site), phone).otherwise(F.lit("")),
    )
    near = let(F.lower(text), lambda lower: contains_any(lower, P.PHONE_NEAR_CONTACT_WORDS))
    # Without any run of phone characters each contact word would be followed to the end.
    return F.when(near & text.rlike(P.PHONE_RUN), picked).otherwise(F.lit(""))


def last_resort_email(page_text: Column, site: SiteRules = DEFAULT_SITE) -> Column:
    """The page's first address; none when that one is blocked."""
    picked = let(
        first_match(page_text, _LOCAL_PART_START + P.EMAIL_ASCII),
        lambda email: F.when(allowed_email(email, site), email).otherwise(F.lit("")),
    )
    return F.when(page_text.rlike(P.EMAIL_TAIL), picked).otherwise(F.lit(""))


def last_resort_phone(page_text: Column) -> Column:
    picked = clean_phone_last_resort(first_match(page_text, P.PHONE_LAST_RESORT, 1))
    return F.when(contains_any(page_text, P.PHONE_LABELLED_WORDS), picked).otherwise(F.lit(""))


def fall_back(stage: Column, *later: Column) -> Column:
    """The first non-empty stage; later ones are not evaluated once one is found."""
    if not later:
        return or_empty(stage)
    rest = fall_back(*later)
    return let(stage, lambda value: F.when(value != "", value).otherwise(rest))
