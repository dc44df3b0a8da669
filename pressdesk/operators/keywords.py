"""Texts against a keyword list, however long: one walk through an automaton per text.

All keywords are put into one Aho-Corasick automaton on the driver; tasks get it once and walk each
text through it, so a text costs its length and its matches, not the number of keywords.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nodes import rows_of

HITS = "array<struct<kw_pos:int,keyword:string>>"


def automaton(keywords: Sequence[str]) -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    """The automaton of the distinct keywords, and where each stands in the list."""
    places: dict[str, list[int]] = {}
    for i, keyword in enumerate(keywords):
        places.setdefault(keyword, []).append(i)
    found = ahocorasick.Automaton()
    for keyword in places:
        if keyword:
            found.add_word(keyword, keyword)
    found.make_automaton()
    return found, places


def keyword_hits(df: DataFrame, text: str, keywords: Sequence[str]) -> Column:
    """The list entries that a text contains, in list order; none for a null text.

    An entry that the list holds twice counts twice; the empty keyword is in every text.
    """
    shared = df.sparkSession.sparkContext.broadcast(automaton(keywords))

    def search(texts: pa.Array) -> pa.Array:
        walk, places = shared.value
        anywhere = places.get("", [])
        ends, positions, words = [0], [], []
        for value in texts:
            value = value.as_py()
            if value is not None:
                met = {k for _, k in walk.iter(value)} if len(walk) else set()
                entries = sorted([(i, k) for k in met for i in places[k]] + [(i, "") for i in anywhere])
                positions += [i for i, _ in entries]
                words += [k for _, k in entries]
            ends.append(len(positions))
        hits = pa.StructArray.from_arrays(
            [pa.array(positions, pa.int32()), pa.array(words, pa.string())], names=["kw_pos", "keyword"]
        )
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)

    return F.arrow_udf(search, HITS)(F.col(text))


def keyword_search(documents: DataFrame, keywords: Sequence[str], text: str = "text") -> DataFrame:
    """Documents by the keywords they contain: one row per document and list entry; no shuffle."""
    return (
        rows_of(documents, keyword_hits(documents, text, keywords), "_pos", "_hit")
        .select("*", "_hit.kw_pos", "_hit.keyword")
        .drop("_pos", "_hit", text)
    )
