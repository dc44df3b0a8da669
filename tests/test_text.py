"""Text functions against Python's own notion of text, on all kinds of characters."""

import re
import unicodedata
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressdesk.functions import patterns as P
from pressdesk.functions import text as T
from pressdesk.operators import candidates as C
from pressdesk.operators import pickers as K

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
ALPHABET = SPACES + "​᠎" + "aAtTdDoOlLeE@.＠．[]()&#64;:：T電話℡ＴＥＬｔｅｌ0123456789０３９－-+٣é゛ｶﾞﾊﾟ①㈱ﬁÅ山田担当先連絡問合わせ株式会社、。"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=60, max_size=60)


def run(spark, function, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(4)
    rows = df.select("i", function(F.col("t")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def check(spark, function, python, values):
    for value, got in zip(values, run(spark, function, values)):
        assert got == python(value), repr(value)


few = settings(max_examples=4, deadline=None, derandomize=True)


def python_pattern(pattern):
    """The same pattern for Python, whose classes are Unicode without a flag."""
    pattern = pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("(?iu)", "(?i)")
    return pattern.replace(r"\p{Nd}", r"\d").replace(P.WS, r"\s")


@given(texts)
@few
def test_normalize_text(spark, values):
    check(spark, T.normalize_text, lambda s: " ".join(unicodedata.normalize("NFKC", s).split()), values)


@given(texts)
@few
def test_ustrip(spark, values):
    check(spark, T.ustrip, str.strip, values)


@given(texts)
@few
def test_decode_email(spark, values):
    def python(s):
        for token, char in (("[at]", "@"), ("(at)", "@"), ("[dot]", "."), ("(dot)", "."), ("＠", "@"), ("．", "."),
                            (None, "at"), (None, "dot"), ("&#64;", "@"), ("&#46;", ".")):
            if token:
                s = re.sub(re.escape(token), char, s, flags=re.I)
            else:
                s = re.sub(rf"\s*{char}\s*", {"at": "@", "dot": "."}[char], s, flags=re.I)
        return s

    check(spark, T.decode_email, python, values)


@given(texts)
@few
def test_halfwidth(spark, values):
    wide = dict(zip(map(ord, "０１２３４５６７８９－（）　"), "0123456789-() "))
    check(spark, T.to_halfwidth, lambda s: s.translate(wide), values)


@given(texts)
@few
def test_percent_encode(spark, values):
    check(spark, T.percent_encode, quote, [v + "~/*+ é語" for v in values])


@pytest.mark.parametrize("pattern", P.PHONE_PATTERNS + P.PERSON_LABELS + (P.COMPANY_IN_TEXT,))
def test_patterns_match_as_in_python(spark, pattern):
    import random

    random.seed(pattern)
    pieces = ["TEL", "Tel", "電話", "℡", "ＴＥＬ", "T：", "T:", "電話番号：", "担当者：", "担当:", "広報担当：", "PR担当：", "連絡先：",
              "問い合わせ先：", "お問合せ：", "広報：", "ご担当：", "責任者：", "まで", "様", "株式会社", "03-1234-5678", "０３－１２３４－５６７８",
              "(03) 1234-5678", "（03）１２３４－５６７８", "0312345678", "０３１２３４５６７８", "+81-3-1234-5678", "٠١٢٣٤٥٦٧٨٩",
              "山田太郎", "山田　太郎", "営業部", " ", "　", "\x1c", "\xa0", "\n", "x", "。"]
    values = ["".join(random.choices(pieces, k=random.randint(2, 8))) for _ in range(300)]
    compiled = re.compile(python_pattern(pattern))
    check(spark, lambda t: T.all_matches(t, pattern, 1), compiled.findall, values)


def test_email_start_rule_finds_the_same(spark):
    values = ["a@b.com_x@y.jp", "x.a@b.com@c.de", "%a@b.co-c@d.ee", "a..b@c.d.ef g@h.ij", "@a.bc", "ああa@b.cd", "a@b.c1 d@e.fg"]
    pattern = P.EMAIL_PATTERNS[0]
    check(spark, lambda t: T.all_matches(t, K._LOCAL_PART_START + pattern), lambda s: re.findall(pattern, s), values)


@pytest.mark.parametrize(
    "raw, phone",
    [
        ("０３－１２３４－５６７８", "03-1234-5678"), ("(03) 1234-5678", "03-1234-5678"), ("（０３）１２３４５６７８", "03-12345678"),
        ("0312345678", "03-1234-5678"), ("06 1234 5678", "06-1234-5678"), ("0120123456", "012-012-3456"),
        ("09012345678", "090-1234-5678"), ("--03--1234-5678--", "03-1234-5678"), ("+81 3 1234 5678", "+81312345678"),
        ("03‐1234‐5678", "03-1234-5678"), ("(", "("), ("", ""), ("(a)", "()"), ("123", "123"),
    ],
)
def test_normalize_phone(spark, raw, phone):
    assert run(spark, T.normalize_phone, [raw]) == [phone]


@pytest.mark.parametrize(
    "label, expected",
    [("TEL", True), ("ｔｅｌ", True), ("ホテル", False), ("mentelle", True), ("お電話番号", True), ("contact:", True),
     ("T ：", False), ("☎", True), ("iPhone", True), ("連絡先（電話）", True), ("連絡先", False), ("", False)],
)
def test_phone_label(spark, label, expected):
    assert run(spark, C.is_phone_label, [label]) == [expected]


def test_site_name_and_sheet_key(spark):
    assert run(spark, T.site_name_clean, ["　K社のプレスリリース ", "NEWSWIRE", " のプレスリリース", "NEWSWIREの"]) == [
        "K社", "", "", "NEWSWIREの"]
    assert run(spark, T.sheet_key, ["a/b\\c?d*e[f]g:h<i>j|k", "語" * 40]) == ["a_b_c_d_e_f_g_h_i_j_k", "語" * 31]


def test_boost_order_and_length(spark):
    from pressdesk.operators.regions import contact_boost

    long = "【連絡先】" + "あ" * 700
    assert run(spark, contact_boost, [long]) == ["あ" * 500 + " " + long]
    assert run(spark, contact_boost, ["x■広報 abc"]) == ["c x■広報 abc"]
    both = "【広報】a＜広報＞b＜c"
    assert run(spark, contact_boost, [both]) == ["b a＜広報＞b＜c " + both]


def test_contact_headings_match_as_plain_repetition(spark):
    import random

    random.seed(5)
    heading = "(?:問い?合わ?せ|連絡先|広報)"
    plain = [f"【[^】]*{heading}[^】]*】([^【]+)", f"＜[^＞]*{heading}[^＞]*＞([^＜]+)"]
    pieces = ["【", "】", "＜", "＞", "問合せ", "連絡先", "広報", "あ", "\n", "■", "x"]
    values = ["".join(random.choices(pieces, k=random.randint(2, 14))) for _ in range(600)]
    for pattern, fast in zip(plain, (P.CONTACT_BLOCKS[0], P.CONTACT_BLOCKS[4])):
        check(spark, lambda t: T.all_matches(t, fast, 1), re.compile(pattern).findall, values)
        check(spark, lambda t: T.first_match(t, fast), lambda s: (re.search(pattern, s) or [""])[0], values)
