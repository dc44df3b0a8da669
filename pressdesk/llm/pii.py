"""Personal data: spans of four kinds, and of terms that give a protected entity away.

Everything is a column expression or a join. A pattern's matches come from one extraction; their
places are running sums over the lengths of the matches and of the texts between them.

Method. An entity is a protected value (an address, number). Terms are words of four letters or
more, lower-cased, anywhere in a document but inside an e-mail address. With n documents, where
each row is one,

    information of an entity   I(e)    = -log2(docs with e / n)
    disclosure by a term       D(t, e) = log2(P(e | t) / P(e)) / I(e),   P(e | t) = docs with e and t / docs with t

D is 1 if a term only occurs where the entity does, and 0 if it says nothing about it. Terms that
share at least ``SUPPORT`` different texts with an entity are removed where D is ``REMOVE`` or
more and generalised from ``GENERALISE``, in every document. Exact copies of a text count in all of
the above, and as one text for the support. Only entities with enough texts meet the words of their
documents, and candidates meet those of the corpus behind a blocked Bloom filter of bounded size,
so only words that may be candidates are shuffled.

Defined cases: null text is empty and has no span; rows with equal id and text get equal spans;
rows without id are handled like others; spans of different kinds may overlap, a term's span
overlaps none of the four kinds; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import keep, packed, unpacked
from .urls import block_count, bloom_filter, probe

# The kinds in order. Each pattern matches as if it were greedy from the leftmost
# place; possessive repeats and look-behinds only spare tries that cannot succeed.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
# What a text must hold for a kind to be looked for.
SIGNS = {
    "email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{4,}"

SUPPORT = 3
GENERALISE = 0.85
REMOVE = 0.95

_BLOCK = 256
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _scan(lengths: Column, start: Column) -> Column:
    """Running sums before each element."""
    empty = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(
        lengths, empty,
        lambda a, n: F.struct((a.at + n).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")),
    ).out


def running(lengths: Column) -> Column:
    """Running sums, made in blocks so that a very long array costs no square of its length."""
    zero = F.lit(0).cast("bigint")

    def in_blocks(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / F.lit(_BLOCK)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda b: F.slice(x, b * F.lit(_BLOCK) + 1, F.lit(_BLOCK))
        )

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, n: a + n))
        return F.flatten(F.zip_with(blocks, _scan(sums, zero), _scan))

    found = let(lengths, lambda x: F.when(F.size(x) > 0, let(in_blocks(x), summed)))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def located(text: Column, pattern: str) -> Column:
    """All matches: ``start, end`` in code points and ``value``.

    What a lambda reads is bound first: an expression inside it would run for every match.
    """

    def match(x: Column) -> Column:
        start = x.at + F.length(x.before)
        return F.struct(
            start.alias("start"), (start + F.length(x.m)).alias("end"), x.m.alias("value"),
        )

    def placed(parts: Column) -> Column:
        n = F.size(parts.m)
        before = F.slice(parts.gaps, F.lit(1), n)
        lengths = F.zip_with(before, parts.m, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint"))
        rows = F.arrays_zip(
            parts.m.alias("m"), running(lengths).alias("at"), before.alias("before"),
        )
        return F.transform(rows, match)

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps")
    )
    return let(parts, placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    figures = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    added = F.transform(
        figures,
        lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48)
        .when(F.ascii(c) >= 53, 2 * (F.ascii(c) - 48) - 9)
        .otherwise(2 * (F.ascii(c) - 48)),
    )
    return F.aggregate(added, F.lit(0), lambda a, d: a + d) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """Matches of a kind that hold, none in a text without its sign."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    some = F.filter(located(text, PATTERNS[kind]), lambda m: holds(kind, m.value))
    return F.when(F.rlike(text, F.lit(SIGNS[kind])), some).otherwise(none)


def entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind in ("email", "ip") else digits(value))


def _span(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(
        m.start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m.end.alias("end"), F.lit(kind).alias("kind")
    )


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s.kind == kind


def base_spans(matches: dict[str, Column]) -> Column:
    """Spans of all kinds by start, then kind."""
    spans = [F.transform(matches[kind], _span(kind)) for kind in KINDS]
    return F.array_sort(F.concat(*spans))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def keyed(docs: DataFrame) -> DataFrame:
    """Null text read as empty, and a number for the id and the text of a row."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"text": text, "_key": F.xxhash64("doc_id", text)})


def _entity(kind: str) -> Callable[[Column], Column]:
    return lambda m: entity(kind, m.value)


def words(text: Column) -> Column:
    """The different words of a text that may be terms."""
    outside = F.when(F.rlike(text, F.lit(SIGNS["email"])), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(TERM), F.lit(0)))


def holding(docs: DataFrame) -> DataFrame:
    """``copies, entities, terms`` of each different text that may hold a protected value."""
    entities = [F.transform(found(F.col("text"), kind), _entity(kind)) for kind in KINDS]
    with_data = docs.filter(F.rlike("text", F.lit("|".join(SIGNS.values()))))
    both = F.struct(F.array_distinct(F.concat(*entities)).alias("entities"), words(F.col("text")).alias("terms"))
    texts = with_data.select(F.xxhash64("text").alias("_text"), both.alias("both")).groupBy("_text").agg(
        F.count(F.lit(1)).alias("copies"), F.first("both").alias("both")
    )
    return texts.select("copies", "both.entities", "both.terms")


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    """``docs`` per key, for keys with enough different texts."""
    counts = rows.groupBy(*by).agg(F.sum("copies").alias("docs"), F.count(F.lit(1)).alias("texts"))
    return counts.filter(F.col("texts") >= SUPPORT).drop("texts")


def candidates(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """``term, entity, both``: documents with both, for terms that share enough texts with an entity."""
    blocks = block_count(entities.count())
    rows = texts.select("copies", "terms", F.explode("entities").alias("entity"))
    asked = probe(rows, "entity", bloom_filter(entities, "entity", blocks), blocks).filter("_maybe")
    pairs = asked.select("copies", "entity", F.explode("terms").alias("term"))
    return _counted(pairs, "term", "entity").withColumnRenamed("docs", "both")


def _possible(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``_key, term``: words of each document that the Bloom filter takes for one of ``terms``."""
    blocks = block_count(terms.count())
    own = docs.select("_key", F.explode(words(F.col("text"))).alias("term"))
    return probe(own, "term", bloom_filter(terms, "term", blocks), blocks).filter("_maybe").select("_key", "term")


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, docs``: how many documents hold each of ``terms``; counted before the join."""
    counted = _possible(docs, terms).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    return counted.join(terms, "term")


def words_among(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``_key, term, action``: which of ``terms`` occur in which documents."""
    return _possible(docs, terms).join(terms, "term").distinct()


def disclosures(docs: DataFrame) -> DataFrame:
    """``term, action`` for what is to go."""
    texts = keep(holding(docs), "holding")
    per_entity = keep(_counted(texts.select("copies", F.explode("entities").alias("entity")), "entity"), "entities")
    pairs = keep(candidates(texts, per_entity), "candidates")
    per_term = document_counts(docs, pairs.select("term").distinct())
    n = docs.select("_key").agg(F.count(F.lit(1))).first()[0] or 1
    told_by = pairs.join(per_term, "term").join(per_entity.withColumnRenamed("docs", "holders"), "entity")
    information = F.greatest(F.log2(F.lit(float(n)) / F.col("holders")), F.lit(1e-9))
    gain = F.log2(F.col("both") / F.col("docs") * F.lit(float(n)) / F.col("holders"))
    most = told_by.groupBy("term").agg(F.max(gain / information).alias("disclosure"))
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    return keep(most.filter(F.col("disclosure") >= GENERALISE).select("term", action.alias("action")), "terms")


def _clear(span: Column, base: Column) -> Column:
    return ~F.exists(base, lambda b: (b.start < span.end) & (span.start < b.end))


def term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Spans of the terms of a document, named by what is done about them."""
    named = F.transform(
        located(text, TERM),
        lambda m: F.struct(
            m.start.alias("start"), F.lit(len(KINDS)).alias("rank"), m.end.alias("end"),
            F.try_element_at(terms, F.lower(m.value)).alias("kind"),
        ),
    )
    return F.filter(named, lambda s: s.kind.isNotNull() & _clear(s, base))


def find(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``_base`` and ``_spans``, arrays of ``start, rank, end, kind``.

    Base spans are found in one pass. Only documents that may hold a term are moved, to meet the
    list of their terms.
    """
    rows = keyed(docs)
    places = words_among(rows, disclosures(rows))
    by_doc = keep(
        places.groupBy("_key").agg(
            F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("_terms")
        ),
        "places",
    )
    blocks = block_count(by_doc.count())
    base = base_spans({kind: found(F.col("text"), kind) for kind in KINDS})
    asked = probe(rows, "_key", bloom_filter(by_doc, "_key", blocks), blocks)
    # Each row is in one of the two parts, and its spans are looked for there.
    sure = asked.filter(~F.col("_maybe")).withColumn("_base", base).withColumn("_spans", F.col("_base"))
    held = asked.filter("_maybe").join(by_doc, "_key", "left").withColumn("_base", base)
    some = F.when(F.col("_terms").isNull(), F.col("_base")).otherwise(
        F.array_sort(F.concat("_base", term_spans(F.col("text"), F.col("_terms"), F.col("_base"))))
    )
    return sure.drop("_maybe", "_key").unionByName(
        held.withColumn("_spans", some).drop("_maybe", "_terms", "_key")
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans of each document."""
    spans = find(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("_base", _is(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return spans.select(
        "doc_id", *counts, F.sha2(told(F.col("_base")), 256).alias("base_sha256"), told(F.col("_spans")).alias("spans")
    )


def merged(spans: Column) -> Column:
    """Spans in order, those that overlap as one with the label of the first."""
    def add(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last.start, last["rank"], F.greatest(last.end, s.end).alias("end"), last.kind)
        longer = longer.cast(SPAN)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))
        apart = F.concat(out, F.array(s))
        return F.when(last.end > s.start, joined).otherwise(apart)

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), add)


def label(kind: Column) -> Column:
    return F.when(kind == "remove", "").when(kind == "generalise", "[TERM]").otherwise(
        F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its label; rows without any are unchanged."""
    spans = find(packed(docs, "doc_id", "text")).withColumn("_spans", merged(F.col("_spans")))
    text = F.col("text")
    pieces = F.transform(
        "_spans",
        lambda s, i: F.concat(
            F.substring(
                text, (_end(i) + 1).cast("int"), (s.start - _end(i)).cast("int")
            ),
            label(s.kind),
        ),
    )
    rest = F.substring(text, (_end(F.size("_spans")) + 1).cast("int"), F.length(text))
    changed = F.when(F.size("_spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return unpacked(spans.withColumn("text", changed), docs, "doc_id", "text")


def _end(i: Column) -> Column:
    """End of the span before number ``i``."""
    return F.coalesce(F.get(F.col("_spans"), i - 1).end, F.lit(0).cast("bigint"))
