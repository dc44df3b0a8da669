import re

from pressdesk.llm import rules


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {r for r in set(runs) if runs.count(r) > 1} if len(runs) < 2000 else None
    covered = {i + k for i, r in enumerate(runs) if many and r in many for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_odd_rows(odd, none):
    judged = rules.apply_rules(odd).collect()
    short = {(r.doc_id, *expected(r.text)) for r in odd.collect() if len(r.text or "") < 1000}
    assert short <= {tuple(r)[:6] for r in judged}
    assert len(judged) == odd.count()
    for r in judged:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.apply_rules(none).count() == 0


def test_sketches_merge(odd):
    """Adding the sketches of two parts gives the sketch of the whole."""
    counted = rules.counts(odd)
    parts = rules.sketches(counted.filter("n_words % 2 = 0")).unionByName(rules.sketches(counted.filter("n_words % 2 = 1")))
    key = ["lang", "source", "measure", "bucket"]
    merged = parts.groupBy(*key).sum("n").collect()
    assert sorted(map(tuple, merged), key=repr) == sorted(map(tuple, rules.sketches(counted).collect()), key=repr)


def test_outlier_of_its_group_goes(spark):
    clean = "plain words in a row that say nothing much at all here "
    rows = [(i, clean + f"number {i}", "en", "a") for i in range(150)] + [(999, "#$ " * 4 + clean, "en", "a")]
    judged = rules.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert [r.doc_id for r in judged.filter("not kept").collect()] == [999]


def _text(i, words, symbols, phrase, lines):
    """A text of its own words: so many symbols, a phrase said twice, one line repeated."""
    own = [f"{'ab' * words}{i}x{k}{'#' * (k < symbols)}" for k in range(40)]
    said = [f"say{i}", "it", "once", "more", "now"] * 2 if phrase else []
    rows = [" ".join(f"row{i}{c}{k}" for c in "abcde") for k in range(9 + lines)]
    return "\n".join([" ".join(own + said), *(x for k in range(lines) for x in ("again", rows[k])), *rows[lines:]])


def test_fences_follow_each_source(spark):
    """A clean and a dirty source of one language get different cuts for each measure."""
    rows = []
    for i in range(600):
        rows.append((i, _text(i, 2, i % 2, False, 1), "en", "clean"))
        rows.append((1000 + i, _text(i, 4 + i % 3, 5 + i % 9, i % 4 == 0, 3 + i % 5), "en", "dirty"))
    odd = [(5000, _text(7, 2, 30, False, 1), "en", "clean"), (5001, _text(8, 2, 1, False, 40), "en", "clean"),
           (5002, _text(9, 9, 1, False, 1), "en", "clean")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, source string")
    limits = {r.f_source: r for r in rules.fences(rules.sketches(rules.counts(docs))).collect()}
    for m in rules.MEASURES:
        assert limits["clean"][f"high_{m}"] < limits["dirty"][f"high_{m}"]
    gone = {r.doc_id for r in rules.apply_rules(docs).filter("not kept and not base_failed").collect()}
    assert gone == {5000, 5001, 5002}


def test_a_fence_is_the_shrunk_quantile(spark):
    """The fences of one group by the definition, from sorted values."""
    docs = spark.createDataFrame([(i, _text(i, 2, i % 7, False, 1), "en", "a") for i in range(203)],
                                 "doc_id bigint, text string, lang string, source string")
    counted = rules.counts(docs)
    limits = rules.fences(rules.sketches(counted)).first()
    values = sorted(r[0] for r in counted.select(rules.bucket("symbols")).collect())
    low, middle, high = (values[-(-203 * p // 10) - 1] for p in (1, 5, 9))
    assert abs(limits.high_symbols - (high + 2 * (high - middle))) < 1e-9
    assert abs(limits.low_symbols - (low - 2 * (middle - low))) < 1e-9


def test_one_symbol_condemns_no_text(spark):
    rows = [(i, _text(i, 2, 0, False, 1), "en", "a") for i in range(400)] + [(999, _text(999, 2, 1, False, 1), "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert rules.apply_rules(docs).filter("not kept").count() == 0
