"""Markup of nested blocks: quotes, lists and tables hold blocks of their own.

nodes: one row per block, list item, table section, row and cell, with
`doc_id`, `node`, `parent` (null at the top), `depth` (0 at the top), `ord`
among its siblings, `kind`, and the fields of its kind, null elsewhere:

* h: level, anchor (the id it bears), inline (markup); p: inline, align; code, pre: text; pre: href of a snapshot
* figure: href, alt, inline (the caption); list: ordered, start; table: inline (the caption)
* cell: in_head, header, colspan, rowspan, align; pagebreak: page (from 0), label
* item, thead, tbody, row, quote, rule: none

The tree is folded from its deepest level up. A fold groups each row by its
parent if it is of the deepest level and by itself otherwise, so parents meet
their children without a join, and all folds keep the document as partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import squeeze, xml_text
from quire.operators.inlines import attributes, void_tag
from quire.operators.toc import PLAIN_WEIGHT

FIELDS = {
    "kind": "string", "level": "int", "anchor": "string", "inline": "string", "text": "string", "align": "string", "href": "string", "alt": "string", "ordered": "boolean",
    "start": "int", "in_head": "boolean", "header": "boolean", "colspan": "int", "rowspan": "int", "page": "int", "label": "string",
}
#: The alternative text of a table's snapshot. Fixed value.
SNAPSHOT = "Original table as it appeared in the PDF"
CHILD = "array<struct<ord:int,kind:string,inline:string,markup:string>>"


def _blank(text: Column) -> Column:
    return squeeze(text) == ""


def _element(tag: Column, attrs: Column, inner: Column) -> Column:
    return F.concat(F.lit("<"), tag, attrs, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))


def inner_markup() -> Column:
    """The children that show something, on lines of their own."""
    return F.array_join(F.transform(F.filter("children", lambda c: c["markup"] != ""), lambda c: c["markup"]), "\n")


def node_markup() -> Column:
    """The markup of a node from its fields, its children and their `inner` markup, indented by its depth; empty where there is nothing to show."""
    f = {name: F.col(f"f.{name}") for name in FIELDS}
    indent = F.repeat(F.lit("  "), F.col("depth"))
    inner = F.col("inner")
    only = F.get("children", F.lit(0))
    one_paragraph = (F.size("children") == 1) & (only["kind"] == "p")
    aligned = F.when(f["align"] != "left", F.concat(F.lit("align-"), f["align"]))
    none, inline, no_attrs = F.lit(""), F.coalesce(f["inline"], F.lit("")), F.lit("")

    def lines(*pieces: Column) -> Column:
        return F.concat_ws("\n", *pieces)

    def around(tag: str | Column, attrs: Column, body: Column) -> Column:
        name = F.lit(tag) if isinstance(tag, str) else tag
        return lines(F.concat(indent, F.lit("<"), name, attrs, F.lit(">")), body, F.concat(indent, F.lit("</"), name, F.lit(">")))

    image = F.concat(indent, F.lit("  "), void_tag("img", src=f["href"], alt=f["alt"]))
    caption = F.when(f["inline"].isNotNull(), F.concat(indent, F.lit("  <figcaption>"), f["inline"], F.lit("</figcaption>")))
    snapshot = F.concat(indent, F.lit("  "), void_tag("img", src=f["href"], alt=F.lit(SNAPSHOT)))
    pre = F.concat(indent, F.lit('<pre class="table-fallback">'), xml_text(f["text"]), F.lit("</pre>"))
    number = (f["page"] + 1).cast("string")
    marker = void_tag("span", **{"class": F.lit("source-page"), "id": F.concat(F.lit("page-"), number), "epub:type": F.lit("pagebreak"), "role": F.lit("doc-pagebreak"), "aria-label": F.coalesce(f["label"], number)})
    table_caption = F.when(f["inline"].isNotNull(), F.concat(indent, F.lit("  <caption>"), f["inline"], F.lit("</caption>")))
    table = lines(table_caption, F.nullif(inner, none))
    heads = F.coalesce(f["header"], F.lit(False)) | F.coalesce(f["in_head"], F.lit(False))
    cell_attrs = attributes(
        colspan=F.when(f["colspan"] > 1, f["colspan"].cast("string")), rowspan=F.when(f["rowspan"] > 1, f["rowspan"].cast("string")),
        scope=F.when(heads, F.when(f["in_head"], "col").otherwise("row")), **{"class": aligned},
    )
    cell_body = F.when(one_paragraph, F.coalesce(only["inline"], none)).when(_blank(inner), none).otherwise(F.concat(F.lit("\n"), inner, F.lit("\n"), indent, F.lit("  ")))
    tag = F.when(f["ordered"], "ol").otherwise("ul")
    kind = f["kind"]
    return (
        F.when(kind == "h", F.concat(indent, _element(F.concat(F.lit("h"), f["level"].cast("string")), attributes(id=f["anchor"]), inline)))
        .when(kind == "p", F.when(_blank(inline), none).otherwise(F.concat(indent, _element(F.lit("p"), attributes(**{"class": aligned}), inline))))
        .when(kind == "list", F.when(inner == "", none).otherwise(around(tag, attributes(start=F.when(f["ordered"] & (f["start"] != 1), f["start"].cast("string"))), inner)))
        .when(kind == "item", F.when(_blank(inner), none).when(one_paragraph, F.concat(indent, F.lit("<li>"), only["inline"], F.lit("</li>"))).otherwise(around("li", no_attrs, inner)))
        .when(kind == "table", F.when(table == "", none).otherwise(around("table", no_attrs, table)))
        .when(kind.isin("thead", "tbody"), F.when(inner == "", none).otherwise(around(kind, no_attrs, inner)))
        .when(kind == "row", around("tr", no_attrs, inner))
        .when(kind == "cell", F.concat(indent, _element(F.when(heads, "th").otherwise("td"), cell_attrs, cell_body)))
        .when(kind == "figure", F.when(f["href"].isNull(), none).otherwise(around("figure", no_attrs, lines(image, caption))))
        .when(kind == "code", F.concat(indent, F.lit("<pre><code>"), xml_text(f["text"]), F.lit("</code></pre>")))
        .when(kind == "pre", F.when(f["href"].isNull(), pre).otherwise(lines(pre, around("figure", F.lit(' class="table-snapshot"'), snapshot))))
        .when(kind == "quote", F.when(_blank(inner), none).otherwise(around("blockquote", no_attrs, inner)))
        .when(kind == "rule", F.concat(indent, F.lit("<hr/>")))
        .when(kind == "pagebreak", F.concat(indent, marker))
        .otherwise(none)
    )


def depth_of(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]


def nested_markup(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(doc_id, node, ord, markup) of the blocks at the top; empty markup is kept. deepest: the largest depth, read off the nodes if not given."""
    deepest = depth_of(nodes) if deepest is None else deepest
    given = set(nodes.columns)
    fields = F.struct(*[(F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
    tree = nodes.select("doc_id", "node", "parent", F.col("depth").cast("int").alias("depth"), F.col("ord").cast("int").alias("ord"), fields.alias("f"), F.array().cast(CHILD).alias("children")).repartition("doc_id")
    inner, markup = inner_markup(), node_markup()
    for depth in range(deepest, 0, -1):
        at = F.col("depth") == depth
        child = F.when(at, F.struct("ord", "f.kind", "f.inline", markup.alias("markup")))
        rows = tree.withColumn("inner", inner).select("doc_id", F.when(at, F.col("parent")).otherwise(F.col("node")).alias("node"), F.when(~at, F.struct("parent", "depth", "ord", "f")).alias("own"), child.alias("child"))
        # a row of the level above has no children before this fold
        folded = rows.groupBy("doc_id", "node").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("child")).alias("children"))
        tree = folded.select("doc_id", "node", "own.parent", "own.depth", "own.ord", "own.f", "children")
    return tree.withColumn("inner", inner).select("doc_id", "node", "ord", markup.alias("markup"))


#: Nodes that are no blocks and so name no kind as JSON, and what the array of a node's children is called there if not `blocks`. Fixed values.
PARTS = ("item", "row", "cell")
ARRAYS = {"list": "items", "row": "cells"}


def own_json() -> Column:
    """Characters of a node's own fields as JSON, nulls left out."""
    kind = F.when(~F.col("kind").isin(*PARTS), F.col("kind")).alias("kind")
    return F.length(F.to_json(F.struct(kind, *[c for c in FIELDS if c not in ("kind", "anchor", "inline", "in_head")], "inlines")))


def tree_facts(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(doc_id, node, top, top_ord, weight) of every node: the block at the top that it lies in, that block's place, and how large that block comes out.

    nodes: as for the markup, with `inlines` (an array) beside or instead of `inline`; every parent is a row. Paragraphs and headings weigh the characters
    of their inlines as JSON, code and fallbacks their text, lists and tables what they hold as JSON, quotes what their blocks weigh, all else a constant.

    The same fold as the markup's, from the deepest level up; it carries sizes and the ids of a block's nodes, so no node looks for its top by a join.
    """
    deepest = depth_of(nodes) if deepest is None else deepest
    given = set(nodes.columns)
    wanted = [(F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()]
    held = F.col("inlines") if "inlines" in given else F.lit(None).cast("array<string>")
    plain = nodes.select("doc_id", "node", "parent", F.col("depth").cast("int").alias("depth"), F.col("ord").cast("int").alias("ord"), *wanted, held.alias("inlines"))
    own = plain.select("doc_id", "node", F.struct("parent", "depth", "ord", "kind", own_json().alias("json"), F.coalesce(F.length(F.to_json("inlines")), F.lit(2)).alias("inlines"), F.coalesce(F.length("text"), F.lit(0)).alias("text")).alias("own"))
    none = F.lit(0).cast("long")
    tree = own.select("doc_id", "node", "own", F.lit(0).cast("long").alias("n"), none.alias("json"), none.alias("weight"), *[F.lit(2).cast("long").alias(c) for c in ("head", "body")], F.array("node").alias("nodes")).repartition("doc_id")
    kind, listed = F.col("own.kind"), 2 + F.col("json") + F.greatest(F.col("n") - 1, F.lit(0))
    array = F.lit(3) + F.coalesce(F.create_map(*[F.lit(v) for k, name in ARRAYS.items() for v in (k, len(name))])[kind], F.lit(len("blocks"))) + F.when(F.col("own.json") > 2, 1).otherwise(0)
    sections = F.col("head") + F.col("body")
    json = (
        F.when(kind.isin("thead", "tbody"), listed).when(kind == "table", F.col("own.json") + len(',"head":,"body":') + sections)
        .when(kind.isin(*PARTS, "list", "quote"), F.col("own.json") + array + listed).otherwise(F.col("own.json"))
    )
    weight = (
        F.when(kind.isin("p", "h"), F.col("own.inlines")).when(kind.isin("code", "pre"), F.col("own.text")).when(kind == "list", listed)
        .when(kind == "table", sections).when(kind == "quote", F.col("weight")).otherwise(PLAIN_WEIGHT)
    )
    for depth in range(deepest, 0, -1):
        at = F.col("own.depth") == depth
        rows = tree.select("doc_id", F.when(at, F.col("own.parent")).otherwise(F.col("node")).alias("node"), F.when(~at, F.col("own")).alias("own"), at.alias("at"), kind.alias("kind"), json.alias("json"), weight.alias("weight"), "nodes")

        def total(c: str, of: Column, least: int = 0) -> Column:
            return F.coalesce(F.sum(F.when(F.col("at") & of, F.col(c))), F.lit(least)).cast("long")

        every = F.lit(True)
        tree = rows.groupBy("doc_id", "node").agg(
            F.first("own", ignorenulls=True).alias("own"), F.count_if("at").alias("n"), total("json", every).alias("json"), total("weight", every).alias("weight"),
            total("json", F.col("kind") == "thead", 2).alias("head"), total("json", F.col("kind") == "tbody", 2).alias("body"), F.flatten(F.collect_list("nodes")).alias("nodes"),
        )
    # read off the struct before the explode: pruning fields of structs beside an exploded array loses columns
    tops = tree.select("doc_id", "nodes", F.col("node").alias("top"), F.col("own.ord").alias("top_ord"), weight.cast("long").alias("weight"))
    return tops.select("doc_id", F.explode("nodes").alias("node"), "top", "top_ord", "weight")
