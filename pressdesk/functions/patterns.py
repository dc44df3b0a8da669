"""Word lists and patterns that decide what counts as contact data.

White space and digits are Unicode's, as in Python: inside brackets ``WS`` stands for what
``\\s`` and ``str.strip`` cover there, which in Java needs the ``(?U)`` flag and four
control characters more; digits are ``\\p{Nd}``.
"""

from __future__ import annotations

UNICODE = "(?U)"
WS = r"\s\x1C-\x1F"
# The same set as plain characters, for trim.
WS_CHARS = "".join(
    chr(c)
    for lo, hi in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(lo, hi + 1)
)

# --- fixed values: page regions -------------------------------------------------------

# Tried in this order; a leading dot means a class token.
AREA_SELECTORS = (
    "main", "article", ".content", ".main-content",
    ".article-content", ".release-content", ".press-release",
)
BOILERPLATE_TAGS = ("header", "footer", "nav")
BOILERPLATE_CLASS = "header|footer|nav|menu|sidebar"
CONTACT_WORDS = (
    "メディア関係者限定", "本件に関するお問い合わせ", "プレスリリースに関するお問い合わせ",
    "報道関係者お問い合わせ先", "広報担当", "PR担当", "取材依頼", "問い合わせ先",
    "お問合せ先", "お問合わせ先", "問合せ先", "問合わせ先", "連絡先",
    "ご連絡先", "Contact", "CONTACT", "広報窓口", "プレスお問い合わせ",
    "報道関係者", "メディア問い合わせ", "取材申し込み", "プレスコンタクト",
)
# A text holds a contact word if it holds one of these, which contain no other.
CONTACT_WORD_STEMS = tuple(
    w for w in CONTACT_WORDS if not any(o != w and o in w for o in CONTACT_WORDS)
)
_HEADING = "(?:問い?合わ?せ|連絡先|広報)"
# A bracketed heading ends at the first closing bracket, so the look-ahead for the contact
# word and the possessive rest match what plain repetition would, without backtracking.
CONTACT_BLOCKS = (
    f"【(?=[^】]*?{_HEADING})[^】]*+】([^【]+)",
    f"■[^■\\n]*{_HEADING}[^■\\n]*([^■]+)",
    f"▼[^▼\\n]*{_HEADING}[^▼\\n]*([^▼]+)",
    f"●[^●\\n]*{_HEADING}[^●\\n]*([^●]+)",
    f"＜(?=[^＞]*?{_HEADING})[^＞]*+＞([^＜]+)",
)
CONTACT_BLOCK_CHARS = 500

# --- fixed values: company and person -------------------------------------------------

COMPANY_BLOCK_CLASS = "release-company"
COMPANY_LINK_CLASS = "link-to-company"
COMPANY_ANY_CLASS = "company"
COMPANY_HEADER_CLASSES = ("content-header-sub-text", "release-header__company")
SITE_NAME_PROPERTY = "og:site_name"

COMPANY_IN_TEXT = f"{UNICODE}(株式会社[^{WS}、。；;]{{1,30}})"

_NAME = "([一-龥ぁ-んァ-ヶー]{2,10})"
_COLON = f"[:：][{WS}]*"
PERSON_LABELS = (
    f"{UNICODE}担当者?{_COLON}{_NAME}",
    f"{UNICODE}広報担当{_COLON}{_NAME}",
    f"{UNICODE}PR担当{_COLON}{_NAME}",
    f"{UNICODE}([一-龥]{{2,4}}[{WS}]+[一-龥]{{2,4}})[{WS}]*(?:まで|宛|様|氏)",
    f"{UNICODE}連絡先{_COLON}{_NAME}",
    f"{UNICODE}問い合わせ先{_COLON}{_NAME}",
    f"{UNICODE}お問い?合わ?せ先?{_COLON}{_NAME}",
    f"{UNICODE}広報{_COLON}{_NAME}",
    f"{UNICODE}ご担当{_COLON}{_NAME}",
    f"{UNICODE}責任者{_COLON}{_NAME}",
)
# Without one of these words no label can match.
PERSON_LABEL_WORDS = ("担当", "連絡先", "合", "広報", "責任者", "まで", "宛", "様", "氏")
NOT_A_PERSON = "会社|株式|法人|企業|部|課|室|チーム"

# --- fixed values: e-mail -------------------------------------------------------------

EMAIL_LABELS = ("メール", "Mail", "Email", "E-mail", "e-mail")
EMAIL_TOKENS = ("@", "[at]", "(at)", "[dot]", "(dot)")
EMAIL_ASCII = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_PATTERNS = (
    EMAIL_ASCII,
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Zぁ-ゔァ-ヴー]{2,}",
)
# What follows the local part in both; quick to rule out, as it starts with a plain "@".
EMAIL_TAIL = r"@[a-zA-Z0-9.-]+\.[a-zA-Zぁ-ゔァ-ヴー]{2,}"
EMAIL_WINDOW = r"(?iu)(?:メール|Mail|Email|E-mail|e-mail|連絡先)[^。\n]{0,50}"
# In this order.
EMAIL_DECODING = (
    (r"(?i)\[at\]|\(at\)", "@"),
    (r"(?i)\[dot\]|\(dot\)", "."),
    ("＠", "@"),
    ("．", "."),
    (f"{UNICODE}[{WS}]*+[Aa][Tt][{WS}]*+", "@"),
    (f"{UNICODE}[{WS}]*+[Dd][Oo][Tt][{WS}]*+", "."),
    ("&#64;", "@"),
    ("&#46;", "."),
)
# The two of them that fire on plain words.
EMAIL_DECODING_BARE = EMAIL_DECODING[4:6]

# --- fixed values: phone --------------------------------------------------------------

# In lower case, tested ignoring case. Longer labels that contain one of these (a phone
# number label, "contact by phone") need no entry: the test is for a substring.
PHONE_LABELS = ("tel", "ｔｅｌ", "電話", "℡", "☎", "phone", "t:", "t：", "ｔ:", "ｔ：")
WIDE_FROM = "０１２３４５６７８９－（）　"
WIDE_TO = "0123456789-() "
_RUN = rf"([0-9０-９\-－\(\){WS}（）]{{10,20}})"
PHONE_RUN = UNICODE + _RUN
_DIGIT = r"[\p{Nd}０-９]"
PHONE_PATTERNS = (
    rf"{UNICODE}(?:TEL|Tel|tel|電話|℡|ＴＥＬ)[:：{WS}]*{_RUN}",
    rf"{UNICODE}T[:：][{WS}]*{_RUN}",
    rf"{UNICODE}電話番号[:：][{WS}]*{_RUN}",
    r"(0\p{Nd}{1,4}[-－]\p{Nd}{1,4}[-－]\p{Nd}{3,4})",
    rf"(０{_DIGIT}{{1,4}}[－-]{_DIGIT}{{1,4}}[－-]{_DIGIT}{{3,4}})",
    rf"{UNICODE}(\(0\p{{Nd}}{{1,4}}\)[{WS}]*\p{{Nd}}{{1,4}}[-－]?\p{{Nd}}{{3,4}})",
    rf"{UNICODE}(（0{_DIGIT}{{1,4}}）[{WS}]*{_DIGIT}{{1,4}}[－-]?{_DIGIT}{{3,4}})",
    r"(0\p{Nd}{9,10})",
    rf"(０{_DIGIT}{{9,10}})",
    rf"{UNICODE}(\+81[-{WS}]?\p{{Nd}}{{1,4}}[-{WS}]?\p{{Nd}}{{1,4}}[-{WS}]?\p{{Nd}}{{3,4}})",
)
PHONE_LABELLED = PHONE_PATTERNS[:3]
# Without one of these words none of the labelled patterns can match.
PHONE_LABELLED_WORDS = ("TEL", "Tel", "tel", "電話", "℡", "ＴＥＬ", "T:", "T：")
PHONE_NEAR_CONTACT = f"(?iU)(?:問い?合わ?せ|連絡先|Contact|広報)[^。]*?{_RUN}"
# In lower case; the same for the pattern above.
PHONE_NEAR_CONTACT_WORDS = ("問", "連絡先", "contact", "広報")
PHONE_LAST_RESORT = (
    rf"{UNICODE}(?:TEL|Tel|tel|電話)[:：{WS}]*([0-9０-９\-－\(\){WS}]{{10,20}})"
)

# --- fixed values: output -------------------------------------------------------------

SHEET_KEY_FROM = "/\\?*[]:<>|"
SHEET_KEY_CHARS = 31
DEFAULT_KEYWORD = "サプリ"
