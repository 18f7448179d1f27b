"""Paragraphs: where lines break into blocks, and blocks from them.

Lines keep the order of the document, so a paragraph may go on over a page's
end; leading and margins are those of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import LIST_MARKER, join_lines, join_styles, squeeze, strip, unclosed_delimiter
from quire.operators.inlines import INLINE, cut_inlines

#: Shares of the leading and the em that end a paragraph.
LOOSE, INDENT, SHORT, RESIZED = 1.35, 0.5, 2.5, 0.1


def with_page_measures(lines: DataFrame) -> DataFrame:
    """Adds the page's leading and column edges, the line before in the document, and whether the page is set with indents."""
    page = Window.partitionBy("doc_id", "page")
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    before = F.struct("plain", "x", "w", "em", "bold", "baseline_y", "heading_level", "page")
    near = lines.withColumn("plain", squeeze(F.col("text"))).withColumn("before", F.lag(before).over(order)).withColumn("gap", F.col("baseline_y") - F.col("before.baseline_y"))
    here = F.col("before.page") == F.col("page")
    sized = near.withColumn("left_edge", F.min("x").over(page)).withColumn("right_edge", F.max(F.col("x") + F.col("w")).over(page)).withColumn("leading", F.coalesce(F.median(F.when(here & (F.col("gap") > 0), F.col("gap"))).over(page), F.lit(0.0)))
    normal = F.coalesce(here, F.lit(False)) & ~((F.col("leading") > 0) & (F.col("gap") > F.col("leading") * LOOSE))
    indented = normal & (F.col("x") - F.col("left_edge") > F.when(F.col("em") == 0, 1).otherwise(F.col("em")) * INDENT)
    return sized.withColumn("n_normal", F.count_if(normal).over(page)).withColumn("n_indented", F.count_if(indented).over(page)).withColumn("indent_style", (F.col("n_normal") > 0) & (F.col("n_indented") / F.col("n_normal") > 0.5))


def mark_breaks(lines: DataFrame) -> DataFrame:
    """Adds `breaks`: whether a line starts a block. lines: with heading_level."""
    both = with_page_measures(lines)
    em = F.coalesce(F.nullif("em", F.lit(0)), F.nullif("before.em", F.lit(0)), F.lit(1))
    last = F.col("before.plain")
    loose = (F.col("leading") > 0) & (F.col("gap") > F.col("leading") * LOOSE)
    ends_short = F.col("before.x") + F.col("before.w") < F.col("right_edge") - em * SHORT
    by_text = (
        F.when(last.rlike("[-\\u2010\\u00AD]\\z") | unclosed_delimiter(last), False)
        .when(loose, True)
        .when(F.col("indent_style") & (F.col("x") - F.col("left_edge") > em * INDENT), True)
        .when(F.col("plain").rlike(LIST_MARKER), True)
        .when(ends_short & last.rlike("[.!?\"'”’)\\]]\\z"), True)
        .when(F.abs(F.col("em") - F.col("before.em")) / em > RESIZED, True)
        .otherwise(F.col("bold") != F.col("before.bold"))
    )
    heading, before = F.col("heading_level"), F.col("before.heading_level")
    normal = (F.col("leading") <= 0) | ((F.col("gap") > 0) & (F.col("gap") <= F.col("leading") * LOOSE))
    wrapped = (heading != 0) & (heading == before) & normal
    at_heading = ((heading != 0) | (before != 0)) & ~wrapped
    return both.withColumn("breaks", F.col("before").isNull() | at_heading | by_text)


def confidence(conf: Column) -> Column:
    """Aggregate of the runs' confidences, 0 to 100: their median as a share, 0.8 if none is known."""
    return F.coalesce(F.median(conf) / 100, F.lit(0.8))


def blocks(lines: DataFrame) -> DataFrame:
    """One row per block in document order: kind (h, list, p), level, joined text, its inlines by style, first page, bounds and lines."""
    marked = mark_breaks(lines)
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    numbered = marked.withColumn("ord", (F.sum(F.col("breaks").cast("int")).over(order) - 1).cast("int"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "text"))), lambda s: s["text"])
    coded = numbered.withColumn("codes", F.coalesce("styles", F.repeat(F.lit("0"), F.length("text")))) if "styles" in lines.columns else numbered.withColumn("codes", F.lit(None).cast("string"))
    styled = F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "text", F.col("codes").alias("styles")))), lambda s: F.struct(s["text"].alias("text"), s["styles"].alias("styles")))
    grouped = coded.groupBy("doc_id", "ord").agg(
        F.min("page").alias("page"), F.min_by("heading_level", F.struct("page", "line_no")).alias("level"), join_lines(texts).alias("text"), F.when(F.bool_or(F.regexp_like("codes", F.lit("[^0_]"))), join_styles(styled)).alias("styles"), F.count("*").alias("n_lines"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    ).filter(strip(F.col("text")) != "")
    marker = F.col("text").rlike(LIST_MARKER)
    kind = F.when(F.col("level") > 0, "h").when(marker, "list").otherwise("p")
    start = F.regexp_extract("text", r"^(\d+)[.)]\s+", 1)
    kinds = grouped.withColumn("kind", kind).withColumn("ordered", F.when(kind == "list", start != "")).withColumn("list_start", F.when((kind == "list") & (start != ""), start.cast("int")))
    # the marker is taken off the text and its styles alike
    plain = F.when(F.col("kind") == "list", F.regexp_replace("text", LIST_MARKER, "")).otherwise(F.col("text"))
    bare = kinds.withColumn("styles", F.substr("styles", F.length("text") - F.length(plain) + 1)).withColumn("text", plain)
    return bare.withColumn("inlines", cut_inlines(F.col("text"), F.col("styles")).cast(f"array<{INLINE}>")).drop("styles")
