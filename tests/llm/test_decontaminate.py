from pressdesk.llm import decontaminate as D

ITEMS = [
    (1, "A train leaves Paris at 30 km per hour and Alice walks 12 miles to meet Bob"),
    (2, "two words"), (3, None), (3, ""), (4, "only five literal tokens here"),
    (5, "Numbers 1 2 3 4 5 6 7 8 9 10 11"),
]
DOCS = [
    (1, "Hello. A train leaves Rome at 45 km per hour and Carol walks 7 miles to meet Dave and more"),
    (2, "Hello. A train leaves Rome at 45 km per hour and Carol walks 45 miles to meet Carol"),
    (3, None), (4, "clean text only"), (5, ""), (6, "so: ONLY FIVE LITERAL tokens HERE."), (7, ITEMS[0][1]),
    (8, "A train leaves Paris at 30 km per hour"), (9, "Numbers 1 2 3 4 5 6 7 8 9 10 11"), (1, "another text of one"),
    (None, ITEMS[0][1]), (10, "x " * 50_000 + ITEMS[0][1].upper()), (11, ITEMS[0][1]), (11, ITEMS[0][1]),
]
OTHERS = ", hash string, row string, item_id string, block int, `a.b` string"


def frames(spark):
    items = spark.createDataFrame([(*x, "x") for x in ITEMS], "item_id bigint, text string, hash string")
    docs = spark.createDataFrame([(*x, "x", "x", "x", 1, "x") for x in DOCS], "doc_id bigint, text string" + OTHERS)
    return docs, items


def test_verdicts(spark):
    docs, items = frames(spark)
    judged = D.judge(docs.select("doc_id", "text"), items).collect()
    assert len(judged) == len(DOCS)
    got = {(r.doc_id, r.contaminated) for r in judged}
    # 2: one number stands for two. 8: too little of the item. 9, 10: plain copies, one in other letters.
    assert got == {
        (1, True), (1, False), (2, False), (3, False), (4, False), (5, False), (6, True), (7, True), (8, False),
        (9, True), (None, True), (10, True), (11, True),
    }
    assert {r.item_id for r in judged if r.doc_id == 6} == {4}


def test_clean_keeps_rows_whole(spark):
    docs, items = frames(spark)
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 3, 4, 5, 8]


def test_empty(spark):
    docs, items = frames(spark)
    assert D.judge(docs.select("doc_id", "text").limit(0), items).count() == 0
    assert D.judge(docs.select("doc_id", "text"), items.limit(0)).filter("contaminated").count() == 0


def test_given_items(spark, sf_dir):
    """Against a search for each item's text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = lambda t: " ".join((t or "").lower().split())
    asked = [plain(r.text) for r in items.collect()]
    expected = {r.doc_id for r in docs.collect() if any(a in plain(r.text) for a in asked)}
    assert {r.doc_id for r in D.judge(docs.select("doc_id", "text"), items).filter("contaminated").collect()} == expected


def test_near_copies(spark):
    """One occurrence of a repeated name or unit differs: the windows with it are left out, not the copy."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    middle = "the small shop near the old river sells bread and milk to people who come by boat every morning"
    other = "every bird had flown over those tall green hills where nobody lives any longer since long ago"
    items = [(1, f"we saw Paris when {middle} and then went back to Paris"),
             (2, f"it took 1 minute until {other} and then it took 5 minutes more"), (3, " ".join(words))]
    texts = {1: items[0][1][:-5] + "Rome", 2: items[1][1].replace("1 minute", "2 minutes"),
             3: "so here is " + " ".join(words[10:40]), 4: "so here is " + " ".join(words[10:22])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    judged = D.judge(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: r.contaminated for r in judged} == {1: True, 2: True, 3: True, 4: False}
    assert {r.doc_id: round(r.covered, 3) for r in judged if r.doc_id > 2} == {3: round(23 / 52, 3), 4: round(5 / 52, 3)}


def verdicts(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    judged = D.judge(docs, asked).collect()
    return [r.contaminated for r in sorted(judged)]


def test_reparameterised(spark):
    """New names, longer names, names at sentence starts, number words, other letter case, short items."""
    train = ITEMS[0][1]
    apples = "Tom has 3 apples. Tom buys 5 more. How many does Tom have?"
    copies = [
        train.upper(), train.lower(), apples.replace("Tom", "Ann").replace("3", "7").replace("5", "2"),
        train.replace("Alice", "Mary Jane").replace("Bob", "Bob Smith"),
        train.replace("30", "thirty").replace("12", "twelve"), train.replace("30", "twenty five").replace("12", "sixty-one"),
        "so what is 12 + 7 ? nobody knows", "what is 40 + 8 ?", "Hi all", "We asked Dr. Miller about the old bridge and Dr. Miller said no",
    ]
    items = [train, apples, "What is 12 + 7 ?", "hi ALL",
             "We asked Dr. Jones about the old bridge and Dr. Jones said no"]
    assert verdicts(spark, items, copies) == [True] * len(copies)
    clean = [
        "hi all of you", "what is 12 - 8 ?", apples.replace("Tom buys", "Ann buys").replace("apples", "pears"),
        "The bridge is old. Tom has a car.", "1 2 3 4 5 6 7 8 9 10 11 12 13 14",
    ]
    assert verdicts(spark, items, clean) == [False] * len(clean)


def test_names(spark):
    """A capital at a sentence start is a name only by what the rest of its own text says."""
    def names(*texts):
        tokens = D._Tokens([t.encode() for t in texts], D.Known(D._code))
        slot = dict(zip(tokens.first.tolist(), tokens.slot.tolist()))
        return [w.decode() for i, w in enumerate(tokens.words) if slot.get(i)]

    assert names("Ann ran. Then Ann sat.", "Ann ran.") == ["Ann", "Ann"]
    assert names("The dog saw The Hague. Then the cat.") == ["The"]
    assert names("we met Mr. Smith. Smith sat") == ["Mr.", "Smith"]
    assert names("he ran 3 4 km on 5 May") == ["3", "km", "5", "May"]


def test_long_items_are_linear(spark):
    """Slots of a long alignment are counted, not compared with one another."""
    import time

    item = " ".join(f"x{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} {i}" for i in range(8000))
    start = time.monotonic()
    assert verdicts(spark, [item], [item, item.replace("7", "8"), "xaaa 0"])[0]
    assert time.monotonic() - start < 30
