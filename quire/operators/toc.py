"""Table of contents and chapters from blocks, as windows over each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip

DEEPEST, LEAST_HEADINGS, LEAST_BLOCKS, LARGEST = 3, 3, 3, 200_000
#: Kinds of blocks that are never parted from what stands before them, and the weight of those without text. Fixed values.
ATOMIC = ("table", "list", "pre", "code", "figure", "quote")
PLAIN_WEIGHT = 32


def build_toc(blocks: DataFrame) -> DataFrame:
    """Entries of the headings: depth at most one below the entry before, parent, play order.

    depth_i = min(cap_i, depth_{i-1} + 1) has the closed form i + min(0, least cap_j - j so far).
    """
    heads = blocks.filter((F.col("kind") == "h") & (strip(F.col("text")) != ""))
    all_heads = blocks.filter(F.col("kind") == "h").groupBy("doc_id").agg(F.min("level").alias("least"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    capped = heads.join(all_heads, "doc_id").withColumn("cap", F.least(F.col("level") - F.col("least") + 1, F.lit(DEEPEST))).withColumn("rn", F.row_number().over(order))
    deep = capped.withColumn("depth", (F.col("rn") + F.least(F.lit(0), F.min(F.col("cap") - F.col("rn")).over(order))).cast("int"))
    parent: Column = F.lit(None).cast("int")
    for d in range(2, DEEPEST + 1):
        parent = F.when(F.col("depth") == d, F.last(F.when(F.col("depth") == d - 1, F.col("ord")), ignorenulls=True).over(order)).otherwise(parent)
    return deep.select("doc_id", "ord", F.col("text").alias("label"), "level", "depth", parent.alias("parent_ord"), (F.col("rn") + 1).alias("play_order"))


def toc_facts(toc: DataFrame) -> DataFrame:
    """Entries and depth of each document's table of contents."""
    return toc.groupBy("doc_id").agg(F.count("*").alias("entries"), F.max("depth").alias("depth"))


def split_level(blocks: DataFrame) -> DataFrame:
    """The heading level that starts chapters: 1 or 2 if there are enough of it, else none."""
    count = blocks.groupBy("doc_id").agg(F.count_if((F.col("kind") == "h") & (F.col("level") == 1)).alias("h1"), F.count_if((F.col("kind") == "h") & (F.col("level") == 2)).alias("h2"))
    return count.select("doc_id", "h1", "h2", F.when(F.col("h1") >= LEAST_HEADINGS, 1).when(F.col("h2") >= LEAST_HEADINGS, 2).alias("split_level"))


def chapter_groups(blocks: DataFrame) -> DataFrame:
    """Adds `grp`, the split group of each block, 0 for what comes before the first split heading."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    splits = F.coalesce((F.col("kind") == "h") & (F.col("level") == F.col("split_level")), F.lit(False))
    doc = Window.partitionBy("doc_id")
    h1, h2 = (F.count_if((F.col("kind") == "h") & (F.col("level") == k)).over(doc) for k in (1, 2))
    leveled = blocks.withColumn("split_level", F.when(h1 >= LEAST_HEADINGS, 1).when(h2 >= LEAST_HEADINGS, 2))
    return leveled.withColumn("grp", F.sum(splits.cast("int")).over(order).cast("int"))


def merge_tiny(grouped: DataFrame) -> DataFrame:
    """Adds `chapter`: groups with few substantive blocks join the one before."""
    facts = grouped.groupBy("doc_id", "grp").agg(F.count_if(~F.col("kind").isin("pagebreak", "rule")).alias("substantive"))
    order = Window.partitionBy("doc_id").orderBy("grp")
    kept = (F.lag("grp").over(order).isNull() | (F.col("substantive") >= LEAST_BLOCKS)).cast("int")
    numbered = facts.withColumn("kept", kept).withColumn("chapter", F.sum("kept").over(order).cast("int"))
    return grouped.join(numbered.select("doc_id", "grp", "substantive", "chapter"), ["doc_id", "grp"])


def json_length(value: Column) -> Column:
    """Characters of a value as JSON, nulls left out."""
    return F.length(F.to_json(value))


def block_weight(blocks: DataFrame) -> Column:
    """How large a block comes out, roughly: the characters of its JSON for paragraphs, headings, lists, tables and quotes, its text for code, a constant for the rest.

    A column `weight` of blocks, if there is one, is taken as it is, and a column `inlines` measured; else the text counts as one plain inline.
    """
    if "weight" in blocks.columns:
        return F.col("weight")
    plain = F.array(F.struct(F.lit("text").alias("t"), F.col("text").alias("s")))
    held = F.col("inlines") if "inlines" in blocks.columns else plain
    kind = F.col("kind")
    item = F.array(F.struct(F.array(F.struct(F.lit("p").alias("kind"), held.alias("inlines"))).alias("blocks")))
    return (
        F.when(kind.isin("p", "h", "quote", "table"), json_length(held)).when(kind == "list", json_length(item)).when(kind.isin("code", "pre"), F.length("text")).otherwise(PLAIN_WEIGHT)
    )


def guard_size(merged: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Adds `part`: chapters above the size are packed greedily; a part starts only before a block that may be parted.

    Where a part starts depends on every block before, so it is a fold over the blocks of a chapter, which keeps the
    starts only: it takes linear time, and a block's part is the number of starts up to it.
    """
    chapter = Window.partitionBy("doc_id", "chapter")
    sized = merged.withColumn("weight", block_weight(merged)).withColumn("breakable", ~F.col("kind").isin(*ATOMIC))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, b: Column) -> Column:
        fresh = (s["held"] + b["weight"] > largest) & (s["n"] > 0) & b["breakable"]
        return F.struct((F.when(fresh, 0).otherwise(s["held"]) + b["weight"]).cast("long").alias("held"), (F.when(fresh, 0).otherwise(s["n"]) + 1).alias("n"), F.when(fresh, F.concat(s["starts"], F.array(b["ord"]))).otherwise(s["starts"]).alias("starts"))

    both = sized.withColumn("total", F.sum("weight").over(chapter))
    packed = both.filter(F.col("total") > largest).groupBy("doc_id", "chapter").agg(F.sort_array(F.collect_list(F.struct("ord", "weight", "breakable"))).alias("b"))
    starts = packed.select("doc_id", F.explode(F.aggregate("b", start, step, lambda s: s["starts"])).alias("ord"), F.lit(1).alias("starts"))
    part = F.coalesce(F.sum("starts").over(chapter.orderBy("ord")), F.lit(0)).cast("int")
    return both.join(starts, ["doc_id", "ord"], "left").withColumn("part", part).drop("total", "breakable", "starts")


def chapters(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row per chapter part: number, id, href, title, continuation, blocks. titles: doc_id, title."""
    return chapters_of(guard_size(merge_tiny(chapter_groups(blocks))), titles)


def chapters_of(parts: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """The chapters of blocks that are divided already."""
    first = F.struct("ord")
    heading = F.when((F.col("kind") == "h") & (F.col("level") == F.col("split_level")) & (strip(F.col("text")) != ""), F.col("text"))
    title = parts.groupBy("doc_id", "chapter").agg(F.min_by(heading, first).alias("heading"))
    rows = parts.groupBy("doc_id", "chapter", "part").agg(F.count("*").alias("n_blocks"), F.min("ord").alias("first_ord"), F.sum("weight").alias("weight")).join(title, ["doc_id", "chapter"])
    rows = rows.join(titles, "doc_id", "left") if titles is not None else rows.withColumn("title", F.lit("Untitled"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter", "part")) - 1
    name = F.concat(F.lit("ch"), F.lpad(number.cast("string"), 3, "0"))
    shown = F.concat(F.coalesce("heading", "title"), F.when(F.col("part") > 0, " (cont.)").otherwise(""))
    return rows.select("doc_id", number.alias("chapter_no"), name.alias("id"), F.concat(name, F.lit(".xhtml")).alias("href"), shown.alias("title"), (F.col("part") > 0).alias("continuation"), "n_blocks", "first_ord", "weight")
