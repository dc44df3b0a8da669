"""The node table: one row per node of a page, subtrees as intervals of node numbers.

For work on many elements of a page at once. The array form of ``nodes`` looks at a subtree once
for each element; here ``[ord, end_ord]`` intervals are met with the nodes inside them by one sort
per page and running values over it, so a page costs its nodes plus what comes out.

Rows are keyed by columns of the page that tell pages apart; a page is never split, as it comes
from one HTML string. Windows and aggregates of one call share the exchange by page.

Defined cases: a page without nodes has no rows; an element without readable text has the empty
text; intervals nest or are apart, as those of a tree do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions.text import ustrip
from . import nodes as N


def node_table(pages: DataFrame, key: list[str]) -> DataFrame:
    """``key, node`` from pages with their ``nodes``."""
    return N.rows_of(pages.select(*key, "nodes"), F.col("nodes"), "_pos", "node").select(*key, "node")


def _in_order(key: list[str]):
    return W.partitionBy(*key).orderBy(F.col("node.ord"))


def _whole(key: list[str]):
    return _in_order(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def covered(key: list[str], outer: Column) -> Column:
    """Whether a node lies in the subtree of a node for which ``outer`` holds, or is such a node.

    Among the subtrees that begin at or before a node one holds it if the furthest end is not
    before it.
    """
    so_far = _in_order(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    furthest = F.max(F.when(outer, F.col("node.end_ord"))).over(so_far)
    return F.coalesce(furthest >= F.col("node.ord"), F.lit(False))


def strip_boilerplate(rows: DataFrame, key: list[str]) -> DataFrame:
    """Pages without a content area lose the headers, footers and menus below their body."""
    node = F.col("node")
    selected = [N.has_class(s[1:]) if s.startswith(".") else N.is_tag(s) for s in P.AREA_SELECTORS]
    area = reduce(lambda a, b: a | b, [F.coalesce(s(node), F.lit(False)) for s in selected])
    boilerplate = N.is_tag(*P.BOILERPLATE_TAGS)(node) | N.has_class_matching(P.BOILERPLATE_CLASS)(node)
    body = F.when(N.is_tag("body")(node), F.struct(node.ord.alias("ord"), node.end_ord.alias("end_ord")))
    known = rows.withColumns({
        "_area": F.max(area).over(_whole(key)), "_body": F.min(body).over(_whole(key)),
    })
    inside = (node.ord > F.col("_body.ord")) & (node.ord <= F.col("_body.end_ord"))
    marked = known.withColumn("_gone", covered(key, boilerplate & inside & ~F.col("_area")))
    return marked.filter(~F.col("_gone")).select(*key, "node")


def element_texts(rows: DataFrame, key: list[str], asked: Column, separator: str = " ") -> DataFrame:
    """``key, ord, tag, text`` of the asked elements, which may nest: their stripped pieces put together.

    A running count of open elements gives every element its level and every piece the number
    of elements around it. Elements on one level are apart, so the last one that began before a
    piece holds it: pieces are repeated once per level, as often as they come out.
    """
    node, readable = F.col("node"), N.is_text(F.col("node"))
    piece = F.when(readable, ustrip(node.text))
    asked = F.coalesce(asked & node.kind.isin("element", "document"), F.lit(False))

    def event(at: Column, step: int, owner: Column, text: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(step).alias("step"), owner.alias("owner"),
                        text.cast("string").alias("piece"))

    own = F.struct(node.ord.alias("ord"), node.tag.alias("tag"))
    none, nobody = F.lit(None), F.lit(None).cast("struct<ord:int,tag:string>")
    begins_ends = F.array(event(node.ord, 1, own, none), event(node.end_ord + 1, -1, nobody, none))
    events = F.when(asked, begins_ends).otherwise(F.array(event(node.ord, 0, nobody, piece)))
    single = (
        rows.filter(asked | (readable & (piece != "")))
        .select(*key, F.explode(events).alias("_e")).select(*key, "_e.*")
    )
    open_now = W.partitionBy(*key).orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    levelled = single.withColumn("_open", F.sum("step").over(open_now)).filter((F.col("step") >= 0) & (F.col("_open") > 0))
    first_level = F.when(F.col("step") > 0, F.col("_open")).otherwise(F.lit(1).cast("bigint"))
    placed = levelled.withColumn("_level", F.explode(F.sequence(first_level, F.col("_open"))))
    upto = W.partitionBy(*key, "_level").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = placed.withColumn("owner", F.last("owner", ignorenulls=True).over(upto))
    pieces = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))
    return held.groupBy(*key, "owner").agg(F.array_sort(pieces).alias("_pieces")).select(
        *key, "owner.ord", "owner.tag", F.array_join(F.col("_pieces.piece"), separator).alias("text")
    )
