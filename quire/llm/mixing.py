"""Mix sources to target weights with hash-threshold histograms.

Every document has a hash; a source's partial pass takes the documents whose
hash is at or below a threshold. The threshold comes from nested histograms:
tokens are summed by (source, hash bucket), the bucket in which the running
sum crosses the budget is found, and only that bucket is refined with the next
bits of the hash. Documents are never sorted, and every level ships one row
per source and bucket at most, pre-aggregated before the shuffle.

Edge cases: a null or blank text has size 0 and takes nothing; a null source
is a source of its own (last in order); rows that differ in id, text or source,
nulls included, have hashes of their own, for `mixed_documents` also those that
differ in any other column; equal rows are numbered, so that any number of them
can be taken. What is taken depends on the rows alone, not on how they are
dealt. Columns of docs may have any names, but a column `repeats` gives way to
the result's; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, checkpointed, small

#: Bits of the hash that each level of the histogram resolves; together all 63.
LEVEL_BITS = (12, 12, 12, 12, 15)
HASH_BITS = sum(LEVEL_BITS)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source (`source`, `source_size`): adds `target`.

    Weights repeat over the sources in code point order, null last. Targets
    are min(cap, level * weight); the level that spends the whole budget is
    read off the sources in order of cap / weight, so that no loop is needed:
    a source is capped when the level left by those before it reaches its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    everyone = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # levels fall from the first source that stays below its cap on: its level, the largest, holds for all after it
    level = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(everyone)
    return (
        ranked.withColumn("level", left / weight_left)
        .withColumn("first_open", level)
        .withColumn("target", F.when(F.col("first_open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first_open") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def row_hash(columns: list[Column], seed: int) -> Column:
    """HASH_BITS bits of a hash of the columns; nulls count, and tell columns apart."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)]), 64 - HASH_BITS)


def spread_repeats(rows: DataFrame, seed: int) -> DataFrame:
    """rows, those of which share a `hash` are equal, with the hash of such rows renewed by their number among them.

    Equal rows cannot be told apart, so which of them has which number makes no
    difference. They are numbered inside each partition, behind those of the
    partitions before, so no task gathers all copies of a row.
    """
    repeated = checkpointed(rows.groupBy(F.col("hash").alias("h")).count().filter("count > 1").select("h"))
    n = repeated.count()
    if not n:
        return rows
    hashes = small(repeated, n)
    single = rows.join(hashes, F.col("hash") == F.col("h"), "left_anti")
    many = checkpointed(rows.join(hashes, F.col("hash") == F.col("h"), "left_semi").select(F.struct(*rows.columns).alias("r"), F.col("hash").alias("old"), F.spark_partition_id().alias("part")))
    held = many.groupBy(F.col("old").alias("h"), F.col("part").alias("p")).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("h").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("h", "p", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("old", "part").orderBy(F.lit(0)))
    numbered = many.withColumn("place", place).join(offsets, (F.col("old") == F.col("h")) & (F.col("part") == F.col("p")))
    fresh = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "old", F.col("before") + F.col("place")), 64 - HASH_BITS)
    return single.unionByName(numbered.withColumn("fresh", fresh).select(*[F.col("fresh").alias("hash") if c == "hash" else F.col(f"r.{c}") for c in rows.columns]))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> tuple[DataFrame, int]:
    """From (source, size, hash): one row per source with its `target`, whole `passes` and hash `threshold`; and their number.

    A source takes whole passes first, floor(target / size), then one partial
    pass up to its hash threshold; the threshold's last step is taken only if
    that brings the sum nearer to the target.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = checkpointed(
        source_targets(sizes, weights, max_repeats)
        .withColumn("passes", F.least(passes, F.lit(max_repeats)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    )
    n_sources = plan.count()

    # open: for each source the prefix of the hash (of `used` bits) whose bucket holds the threshold, and the budget left inside it
    opened, used = plan.select("source", "budget", F.lit(0).cast("long").alias("prefix")), 0
    for bits in LEVEL_BITS:
        bucket = F.shiftright("hash", HASH_BITS - used - bits)
        inside = sized.withColumnRenamed("source", "s").join(small(opened, n_sources), F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("hash", HASH_BITS - used) == F.col("prefix")))
        histogram = inside.groupBy("source", "budget", bucket.alias("prefix")).agg(F.sum("size").alias("held"))
        running = F.sum("held").over(Window.partitionBy("source").orderBy("prefix"))
        crossed = histogram.withColumn("upto", running).filter(F.col("upto") > F.col("budget"))
        # the first bucket whose running sum passes the budget; none if everything fits
        opened = checkpointed(
            crossed.groupBy("source").agg(F.min_by(F.struct("prefix", (F.col("budget") - F.col("upto") + F.col("held")).alias("budget"), "held"), "prefix").alias("b")).select("source", "b.budget", "b.prefix", "b.held")
        )
        used += bits
    # all bits are used: the last bucket is one hash value, taken if at least half of it is wanted
    last = opened.select(F.col("source").alias("s"), F.when(F.col("budget") * 2 >= F.col("held"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))
    threshold = F.when(F.col("budget") > 0, F.coalesce("threshold", F.lit(2**HASH_BITS - 1))).otherwise(-1)
    return checkpointed(plan.join(small(last, n_sources), F.col("s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "passes", threshold.alias("threshold"))), n_sources


def with_plan(rows: DataFrame, plan: DataFrame, n_sources: int, max_repeats: int) -> DataFrame:
    """rows (source, hash, ...) with their source's plan, and how often each is taken; neither sorts nor moves the rows."""
    renamed = plan.withColumnRenamed("source", "plan_source")
    repeats = F.least(F.col("passes") + (F.col("hash") <= F.col("threshold")).cast("long"), F.lit(max_repeats).cast("long"))
    return rows.join(small(renamed, n_sources), F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("repeats", repeats)


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken from it."""
    hashed = row_hash([F.col(id_col), F.col(text_col), F.col(source_col)], seed)
    sized = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hashed.alias("hash")))
    spread = spread_repeats(sized, seed)
    sized = sized if spread is sized else checkpointed(spread)
    plan, n_sources = mixing_plan(sized.select("source", "size", "hash"), weights, max_repeats)
    return with_plan(sized, plan, n_sources, max_repeats).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The documents that the mix takes, all columns, and `repeats`, how often it takes each."""
    hashed = row_hash([F.to_json(c) if docs.schema[i].dataType.typeName() in ("map", "variant") else docs[c] for i, c in enumerate(docs.columns)], seed)
    # the caller's columns travel in a struct, apart from those of the plan
    named = spread_repeats(docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), hashed.alias("hash")), seed)
    sized = checkpointed(named.select("source", word_count(F.col(f"row.{text_col}")).alias("size"), "hash"))
    plan, n_sources = mixing_plan(sized, weights, max_repeats)
    mixed = with_plan(named, plan, n_sources, max_repeats).filter(F.col("repeats") > 0)
    return mixed.select(*[F.col(f"row.{c}").alias(c) for c in docs.columns if c != "repeats"], "repeats")
