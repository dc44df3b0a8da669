"""Hand-written pages, one per rule, with the record they must give."""

import pytest

from pressdesk.operators.contacts import FIELDS, extract_contacts


def art(inner, outside=""):
    return f"<html><body><article>{inner}</article>{outside}</body></html>"


def li(text):
    return art(f"<ul><li>{text}</li></ul>")


def bold(after):
    return art(f"<p><strong>Phone</strong>{after}</p>")


# name: (html, {field: value}); fields not named must be empty.
PAGES = {
    # company
    "company_div": ('<div class="a release-company"> <b>株式会社X</b> Y </div>', {"company": "株式会社X Y"}),
    "company_link": ('<a class="link-to-company">K社</a>', {"company": "K社"}),
    "company_class_pattern": ('<span class="x mycompanyname">K社</span>', {"company": "K社"}),
    "company_class_not_on_p": ('<p class="mycompany">K社</p>', {}),
    "company_selector_list": (
        '<h2 class="release-header__company">A</h2><p class="content-header-sub-text">B</p>',
        {"company": "A"},
    ),
    "company_step_order": ('<a class="link-to-company">A</a><div class="release-company">B</div>', {"company": "B"}),
    "company_meta": (
        '<head><meta property="og:site_name" content=" K社のプレスリリース "></head>', {"company": "K社"}),
    "company_meta_self": ('<meta property="og:site_name" content="NEWSWIREのプレスリリース">', {}),
    "company_empty_element_skips_meta": (
        '<div class="release-company"></div><meta property="og:site_name" content="K社">', {}),
    "company_empty_element_then_text": (
        '<div class="release-company"> </div><article>株式会社テスト、本社</article>', {"company": "株式会社テスト"}),
    "company_in_text_prefix_only": (art("ABC株式会社 x"), {}),
    # area
    "area_main_before_article": (
        "<article>担当：山田太郎</article><main>担当：佐藤花子</main>", {"person": "佐藤花子"}),
    "area_article_before_content": (
        '<div class="content">担当：山田太郎</div><article>担当：佐藤花子</article>', {"person": "佐藤花子"}),
    "area_content": ('<p>担当：山田太郎</p><div class="content">担当：佐藤花子</div>', {"person": "佐藤花子"}),
    "area_main_content": ('<p>担当：山田太郎</p><div class="main-content">担当：佐藤花子</div>', {"person": "佐藤花子"}),
    "area_article_content": ('<p>担当：山田太郎</p><b class="article-content">担当：佐藤花子</b>', {"person": "佐藤花子"}),
    "area_release_content": ('<p>担当：山田太郎</p><i class="release-content">担当：佐藤花子</i>', {"person": "佐藤花子"}),
    "area_press_release": ('<p>担当：山田太郎</p><i class="press-release">担当：佐藤花子</i>', {"person": "佐藤花子"}),
    "area_class_is_a_token": (
        '<p>担当：山田太郎</p><div class="contents">担当：佐藤花子</div>', {"person": "山田太郎"}),
    "area_body_strips": (
        "<body><header>担当：山田太郎</header><div class='top-menu'>担当：山田太郎</div>担当：佐藤花子</body>",
        {"person": "佐藤花子"},
    ),
    "area_body_keeps_itself": ("<body class='nav'>担当：佐藤花子</body>", {"person": "佐藤花子"}),
    "area_article_does_not_strip": (art("<nav>担当：山田太郎</nav>担当：佐藤花子"), {"person": "山田太郎"}),
    "area_none": ("担当：佐藤花子 TEL 03-1234-5678", {"person": "佐藤花子", "phone": "03-1234-5678"}),
    # contact section
    "section_word_order": (
        art("<p>Contact 担当：山田太郎</p><p>取材依頼 担当：佐藤花子</p>"), {"person": "佐藤花子"}),
    "section_document_order": (
        art("<p>連絡先 担当：山田太郎</p><p>連絡先 担当：佐藤花子</p>"), {"person": "山田太郎"}),
    "section_climbs_li_and_th": (
        art("<p>担当：山田太郎</p><section><ul><li>連絡先</li></ul>担当：佐藤花子</section>"), {"person": "佐藤花子"}),
    "section_leaves_area": (
        "<div>担当：佐藤花子<article>連絡先 担当：山田太郎</article></div>", {"person": "佐藤花子"}),
    "section_guard": (
        art("<p>取材依頼 担当：山田太郎 Copyright <b>NEWS</b>WIRE</p><p>連絡先 担当：佐藤花子</p>"),
        {"person": "佐藤花子"},
    ),
    "section_guard_needs_both": (
        art("<p>取材依頼 担当：山田太郎 Copyright</p><p>連絡先 担当：佐藤花子</p>"), {"person": "山田太郎"}),
    "section_from_comment": (
        art("<div>担当：山田太郎</div><div><!-- 連絡先 -->担当：佐藤花子</div>"), {"person": "佐藤花子"}),
    "section_from_script": (
        art("<div>担当：山田太郎</div><div><script>'連絡先'</script>担当：佐藤花子</div>"), {"person": "佐藤花子"}),
    "section_case_sensitive": (
        art("<p>担当：山田太郎</p><p>contact 担当：佐藤花子</p>"), {"person": "山田太郎"}),
    "section_without_block": ("<main>担当：山田太郎<b>連絡先</b></main>", {"person": "山田太郎"}),
    "contact_table_split_word": (
        art("担当：山田太郎<table><tr><th>連<b>絡先</b></th><td>担当：佐藤花子</td></tr></table>"),
        {"person": "佐藤花子"},
    ),
    # tree shape
    "unclosed_p": (art("<p>連絡先<p>担当：佐藤花子"), {"person": "佐藤花子"}),
    "unclosed_li": (
        art("<ul><li>TEL 03-1111-2222<li>x@y.example</ul>"),
        {"phone": "03-1111-2222", "email": "03-1111-2222x@y.example"},
    ),
    "unclosed_b": (art("<p><b>電話 03-1234-5678<p>担当：佐藤花子"), {"phone": "03-1234-5678", "person": "佐藤花子"}),
    "ruby_is_left_out": (art("<div>担当：<ruby>山田<rt>やまだ</rt></ruby>太郎</div>"), {"person": "山田"}),
    "stray_end_tags": (art("<div>担当：</p></span>佐藤花子</div>"), {"person": "佐藤花子"}),
    "entities": (art("<ul><li>a&#64;b.example</li></ul>"), {"email": "a@b.example"}),
    "named_entity": (art("<ul><li>a&commat;b.example</li></ul>"), {"email": "a@b.example"}),
    # person
    "person_1": (art("担当者：山田太郎"), {"person": "山田太郎"}),
    "person_2_after_rejected_1": (art("担当：営業部 広報担当：山田太郎"), {"person": "山田太郎"}),
    "person_3_after_rejected_1": (art("担当：株式会社 PR担当：山田太郎"), {"person": "山田太郎", }),
    "person_4": (art("山田　太郎 まで"), {"person": "山田　太郎"}),
    "person_5": ("<main>連絡先：鈴木一郎</main>", {"person": "鈴木一郎"}),
    "person_6": ("<main>問い合わせ先: 高橋次郎</main>", {"person": "高橋次郎"}),
    "person_7": ("<main>お問合せ： 田中三郎</main>", {"person": "田中三郎"}),
    "person_8": (art("広報：中村四郎"), {"person": "中村四郎"}),
    "person_10": (art("責任者：小林五郎"), {"person": "小林五郎"}),
    "person_only_first_match_per_label": (art("担当：営業部 担当：山田太郎"), {}),
    "person_ideographic_blank_after_colon": (art("担当：　山田太郎"), {"person": "山田太郎"}),
    # e-mail
    "email_cell": (art("<table><tr><td>E-mail</td><td>ＰＲ＠ex.jp</td></tr></table>"), {"email": "PR@ex.jp"}),
    "email_cell_label_case": (art("<table><tr><td>EMAIL</td><td>a@ex.jp</td></tr></table>"), {"email": "a@ex.jp"}),
    "email_cell_before_list": (
        art("<ul><li>b@ex.jp</li></ul><table><tr><th>メール</th><td>a@ex.jp</td></tr></table>"), {"email": "a@ex.jp"}),
    "email_cell_is_label_and_value": (
        art("<table><tr><td>Mail</td><td>Mail a</td><td>b@ex.jp</td></tr></table>"), {"email": "b@ex.jp"}),
    "email_nested_table": (
        art("<table><tr><td>x</td><td><table><tr><td>Mail</td><td>a@ex.jp</td></tr></table></td></tr></table>"),
        {"email": "a@ex.jp"},
    ),
    "email_outside_area": (art("本文", "<footer><ul><li>a@ex.jp</li></ul></footer>"), {"email": "a@ex.jp"}),
    "email_blocked_then_next": (li("desk@newswire.example a@ex.jp"), {"email": "a@ex.jp"}),
    "email_blocked_ignores_case": (li("desk@NewsWire.example"), {}),
    "email_obfuscated": (art("<div>Mail: pr [at] ex(dot)co[dot]jp</div>"), {}),
    "email_obfuscated_tight": (art("<div>Mail: pr[at]ex(dot)co[dot]jp</div>"), {"email": "pr@ex.co.jp"}),
    "email_spoken": (art("<div>Mail: pr at ex dot jp</div>"), {"email": "pr@ex.jp"}),
    "email_bare_at_corrupts": (art("<div>Mail: kato@ex.jp</div>"), {"email": "o@ex.jp"}),
    "email_kana_domain": (art("<div>Mail: a@ex.ジェーピー</div>"), {"email": "a@ex.ジェーピー"}),
    "email_window_cuts": (art("<div>Mail " + "あ" * 35 + "abcdefgh@ex.com</div>"), {"email": "abcdefgh@ex.co"}),
    "email_past_window": (art("<div>Mail " + "あ" * 40 + "abcdefgh@ex.com</div>"), {"email": "abcdefgh@ex.com"}),
    "email_no_label": (art("<div>a@ex.jp</div>"), {"email": "a@ex.jp"}),
    # phone
    "phone_1": (li("TEL：03-1234-5678"), {"phone": "03-1234-5678"}),
    "phone_2": (li("T: 0120-111-222"), {"phone": "0120-111-222"}),
    "phone_3": (li("電話番号：０３－１２３４－５６７８"), {"phone": "03-1234-5678"}),
    "phone_4": (li("Phone is 06-1234-5678"), {"phone": "06-1234-5678"}),
    "phone_5": (bold("０３－１２３４－５６７８"), {"phone": "03-1234-5678"}),
    "phone_6": (li("Phone (03) 1234-5678"), {"phone": "03-1234-5678"}),
    "phone_7": (bold("（03）１２３４－５６７８"), {"phone": "03-1234-5678"}),
    "phone_8_ten": (li("phone 0612345678"), {"phone": "06-1234-5678"}),
    "phone_8_ten_other": (li("phone 0120123456"), {"phone": "012-012-3456"}),
    "phone_8_eleven": (li("phone 09012345678"), {"phone": "090-1234-5678"}),
    "phone_9": (bold("０３１２３４５６７８"), {"phone": "03-1234-5678"}),
    "phone_10": (li("Phone +81-3-1234-5678"), {"phone": "+81-3-1234-5678"}),
    "phone_two_in_a_row": (li("TEL 03-1234-5678 0120-111-222"), {"phone": "03-1234-56780120-11"}),
    "phone_label_inside_word": (li("hotel 03-1234-5678"), {"phone": "03-1234-5678"}),
    "phone_unlabelled_item": (li("03-1234-5678"), {}),
    "phone_too_short": (li("T: 03-123-567 8"), {}),
    "phone_too_short_but_for_hyphens": (li("TEL 03-123-567 8"), {"phone": "03-123-5678"}),
    "phone_other_dash": (li("Phone 03‐1234‐5678"), {}),
    "phone_cell_then_text": (
        art("<table><tr><th>ＴＥＬ</th><td>03 1234 5678 </td></tr></table>"), {"phone": "03-1234-5678"}),
    "phone_wide_label_in_cell": (
        art("本文", "<table><tr><th>℡</th><td>03-1234-5678</td></tr></table>"), {"phone": "03-1234-5678"}),
    "phone_bold_then_element": (bold('<span title="a&quot;b">03-1234-5678</span>'), {"phone": "03-1234-5678"}),
    "phone_bold_then_link_target": (bold('<a href="tel:0312345678">call</a>'), {"phone": "03-1234-5678"}),
    "phone_bold_then_blank": (bold(" <i>03-1234-5678</i>"), {}),
    "phone_bold_then_comment": (bold("<!--03-1234-5678-->"), {"phone": "03-1234-5678"}),
    "phone_in_text": (art("<div>電話：　０３－１２３４－５６７８</div>"), {"phone": "03-1234-5678"}),
    "phone_near_contact": (art("<div>Contact us 0312345678</div>"), {"phone": "03-1234-5678"}),
    "phone_near_contact_other_sentence": (art("<div>Contact us。0312345678</div>"), {}),
    # whole page as the last resort
    "last_phone_as_it_is": (art("<p>本文</p>", "<div>TEL 0312345678</div>"), {"phone": "0312345678"}),
    "last_phone_short": (art("<p>本文</p>", "<div>TEL 0312-34   -</div>"), {}),
    "last_email": (art("<p>本文</p>", "<div>kato@ex.jp</div>"), {"email": "kato@ex.jp"}),
    "last_email_blocked_gives_up": (art("<p>本文</p>", "<div>a@newswire.example b@ex.jp</div>"), {}),
    "last_not_with_person": (art("<p>担当：山田太郎</p>", "<div>TEL 0312345678</div>"), {"person": "山田太郎"}),
    "last_after_strip": ("<body><footer>TEL 0312345678</footer>本文</body>", {}),
    # contact blocks
    "boost_bracket": (
        art("担当：山田太郎 【広報お問い合わせ】担当：佐藤花子 【以上】"), {"person": "佐藤花子"}),
    "boost_last_block_in_front": (
        art("【連絡先】担当：山田太郎＜広報＞担当：佐藤花子＜"), {"person": "佐藤花子"}),
    "boost_marker_on_one_line_takes_one_character": (
        art("担当：山田太郎 ■広報 担当：佐藤花子"), {"person": "山田太郎"}),
    "boost_marker_over_lines": (
        art("担当：山田太郎 ■広報 連絡\n担当：佐藤花子 ■"), {"person": "佐藤花子"}),
    # nothing to read
    "empty": ("", {}),
    "rejected_by_tokenizer": ("<article>担当：山田太郎</article><![broken[", {}),
    "null": (None, {}),
}


@pytest.fixture(scope="module")
def records(spark):
    pages = spark.createDataFrame([(n, h) for n, (h, _) in PAGES.items()], "url string, html string")
    return {r.url: r for r in extract_contacts(pages).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_page(records, name):
    expected = {f: PAGES[name][1].get(f, "") for f in FIELDS}
    assert {f: records[name][f] for f in FIELDS} == expected


def test_one_record_per_page_without_nulls(records):
    assert len(records) == len(PAGES)
    assert all(value is not None for r in records.values() for value in r)


def test_invariants(records):
    for r in records.values():
        assert "newswire" not in r.email.lower()
        assert r.phone == "" or len(r.phone) >= 10


def test_flags_off(spark):
    from pressdesk.config import SiteRules

    pages = spark.createDataFrame(
        [("at", art("<div>Mail: kato@ex.jp</div>")), ("two", li("TEL 03-1234-5678 0120-111-222"))],
        "url string, html string",
    )
    rows = {r.url: r for r in extract_contacts(pages, SiteRules(bare_words=False, max_phone_digits=11)).collect()}
    assert rows["at"].email == "kato@ex.jp"
    assert rows["two"].phone == "03-1234-5678"


def test_independent_of_partitions(spark, sf_dir):
    from pressdesk.sources import derived as D

    pages = D.press_articles(spark, sf_dir).drop("k")
    one = sorted(extract_contacts(pages.repartition(1)).collect())
    assert one == sorted(extract_contacts(pages.repartition(7)).collect())
