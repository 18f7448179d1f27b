"""Headings: body size, candidates, and levels from numbering or size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import heading_depth, squeeze
from quire.operators.lines import modal_em, round_em

#: How much larger than the body, longest candidate, and how much smaller a size starts a new level.
LARGER, LONGEST, NEW_LEVEL, LEVELS, LEAST_NUMBERED = 1.12, 120, 0.05, 4, 3


def body_em(lines: DataFrame) -> DataFrame:
    """The size that most text of a document is set in."""
    return modal_em(lines.withColumn("plain", squeeze(F.col("text"))), ["doc_id"], "plain", ["page", "line_no"]).withColumnRenamed("em", "body")


def is_candidate(text: Column, em: Column, bold: Column, body: Column) -> Column:
    n = F.length(text)
    larger = (body > 0) & (em >= body * LARGER)
    run_in = bold & (n <= 80) & (body > 0) & (em >= body * 0.95)
    capitals = (n <= 60) & text.rlike(r"^[^\p{Ll}]+\z") & text.rlike(r"\p{Lu}") & (body > 0) & (em >= body * 0.9)
    return n.between(1, LONGEST) & ~text.rlike(r"[.!?:;,]\z") & (larger | run_in | capitals)


def candidates(lines: DataFrame) -> DataFrame:
    """The lines with `plain` text, the document's `body` size and whether they are heading candidates. Windows over the document, no join."""
    sized = lines.withColumn("plain", squeeze(F.col("text"))).withColumn("size", round_em(F.col("em")).cast("double"))
    weighed = sized.withColumn("weight", F.sum(F.length("plain")).over(Window.partitionBy("doc_id", "size")))
    body = F.max_by("size", F.struct("weight", -F.col("page"), -F.col("line_no"))).over(Window.partitionBy("doc_id"))
    both = weighed.withColumn("body", body).drop("weight")
    return both.withColumn("candidate", is_candidate(F.col("plain"), F.col("em"), F.col("bold"), F.col("body")))


def level_of_sizes(sizes: Column) -> Column:
    """From an array of sizes, an array of (em, level): sizes fall, and one more than 5 % below the first of its level starts a new one."""
    start = F.struct(F.lit(0.0).alias("head"), F.lit(0).alias("level"), F.array().cast("array<struct<em:double,level:int>>").alias("out"))

    def step(s: Column, em: Column) -> Column:
        fresh = (s["level"] == 0) | ((s["head"] - em) / s["head"] > NEW_LEVEL)
        level = s["level"] + fresh.cast("int")
        return F.struct(F.when(fresh, em).otherwise(s["head"]).alias("head"), level.alias("level"), F.concat(s["out"], F.array(F.struct(em.alias("em"), level.alias("level")))).alias("out"))

    return F.aggregate(F.sort_array(sizes, asc=False), start, step, lambda s: s["out"])


def size_levels(lines: DataFrame, scope: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The level of each size among the candidates of a page (or another scope)."""
    sizes = lines.filter("candidate").groupBy(*scope).agg(F.collect_set(round_em(F.col("em")).cast("double")).alias("sizes"))
    return sizes.select(*scope, F.explode(level_of_sizes(F.col("sizes"))).alias("s")).select(*scope, "s.em", "s.level")


def numbered_documents(lines: DataFrame) -> DataFrame:
    """Documents in which enough candidates are numbered for numbers to give the levels."""
    return lines.groupBy("doc_id").agg(F.count_if(F.col("candidate") & heading_depth(F.col("plain")).isNotNull()).alias("n_numbered")).withColumn("numbered", F.col("n_numbered") >= LEAST_NUMBERED)


def detect_headings(lines: DataFrame, scope: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Adds `heading_level`, 1 to 4, or 0 for other lines."""
    found = candidates(lines).withColumn("depth", heading_depth(F.col("plain")))
    sizes = F.collect_set(F.when(F.col("candidate"), F.col("size"))).over(Window.partitionBy(*scope))
    numbered = F.count_if(F.col("candidate") & F.col("depth").isNotNull()).over(Window.partitionBy("doc_id")) >= LEAST_NUMBERED
    both = found.withColumn("sizes", sizes).withColumn("numbered", numbered)
    # worked out for candidates only
    by_size = F.get(F.filter(level_of_sizes(F.col("sizes")), lambda v: v["em"] == F.col("size")), F.lit(0))["level"]
    level = F.least(F.greatest(F.coalesce(F.when(F.col("numbered"), F.col("depth")), by_size, F.lit(1)), F.lit(1)), F.lit(LEVELS))
    return both.withColumn("heading_level", F.when(F.col("candidate"), level).otherwise(0)).drop("size", "sizes", "depth", "numbered", "candidate", "body")
