"""Marked content: which spans are open around each text item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "page"]


def tag_texts(items: DataFrame) -> DataFrame:
    """The text items outside artifacts with all their columns, and `mcid`, the id of the nearest open span that has one.

    items: doc_id, page, seq (its own on each page), type (text, begin, end; any other is passed over), str, mc_id, mc_tag. An end closes the last span still open; one
    without such a span is ignored, and spans without an end stay open to the end of their page.

    The stack of spans is replayed by windows over each page. At any depth the last begin is the one that is open, so an end
    learns from it what it closes, and a text reads its id off the last begin at its own depth among the spans with ids.
    """
    page = Window.partitionBy(*KEYS).orderBy("seq")

    def at(depth: str) -> Window:
        return Window.partitionBy(*KEYS, depth).orderBy("seq")

    begins = F.col("type") == "begin"
    events = items.select(*KEYS, "seq", "type", F.struct("mc_id", F.coalesce(F.col("mc_tag") == "Artifact", F.lit(False)).alias("artifact")).alias("span"), F.struct("*").alias("item"))
    level = F.sum(F.when(begins, 1).when(F.col("type") == "end", -1).otherwise(0)).over(page)
    # ends beyond the outermost span leave the depth at 0
    deep = events.withColumn("level", level).withColumn("depth", F.col("level") - F.least(F.lit(0), F.min("level").over(page)))
    before = F.coalesce(F.lag("depth").over(page), F.lit(0))
    touched = deep.withColumn("touched", F.when(begins, F.col("depth")).when(F.col("depth") < before, before))
    met = touched.withColumn("met", F.when(F.col("touched").isNotNull(), F.last(F.when(begins, F.col("span")), ignorenulls=True).over(at("touched"))))

    def still_open(counted: Column) -> Column:
        return F.sum(F.when(F.col("met").isNull() | ~counted, 0).when(begins, 1).otherwise(-1)).over(page)

    held = met.withColumn("artifacts", still_open(F.col("met.artifact"))).withColumn("named", still_open(F.col("met.mc_id").isNotNull()))
    nearest = F.last(F.when(begins, F.col("span.mc_id")), ignorenulls=True).over(at("named"))
    tagged = held.withColumn("mcid", F.when(F.col("named") > 0, nearest))
    return tagged.filter((F.col("type") == "text") & (F.col("item.str") != "") & (F.col("artifacts") == 0)).select("item.*", "mcid")
