"""Site parameters. Every rule that names a particular site takes its words from here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SiteRules:
    """Words and addresses that differ from one news-release site to another."""

    base_url: str = "https://newswire.example"
    search_path: str = "/search?search_word="
    page_parameter: str = "&search_page="
    link_substring: str = "/rd/p/"
    blocked_email_substring: str = "newswire"
    site_name_suffix: str = "のプレスリリース"
    site_name_self: str = "NEWSWIRE"
    footer_guard: tuple[str, str] = ("Copyright", "NEWSWIRE")

    # Harvest limits of one run.
    max_pages: int = 5
    max_articles: int = 100

    # The bare words "at" and "dot" count as an obfuscated "@" and "." wherever they
    # occur, also inside longer words. False turns these two rules off.
    bare_words: bool = True
    # Upper bound on a phone's length without hyphens; None sets no bound.
    max_phone_digits: int | None = None


DEFAULT_SITE = SiteRules()
