"""A training corpus from raw documents: language ID, near-dedup, decontamination, masking, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs; all but the last return the columns of
docs. Rows of docs may repeat, and any column may be null: such rows are
judged by the rules of the stage's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, table
from quire.llm.decontaminate import overlapping_items
from quire.llm.language_id import UNKNOWN, language_of
from quire.llm.minhash import near_duplicates
from quire.llm.mixing import mixed_documents
from quire.llm.pii import mask_personal_data


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: those without text or letters."""
    return docs.filter(language_of(docs)["lang"] != UNKNOWN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; so does one of equal rows.

    Documents without an id cannot be told apart and stay. Texts that share an
    id are judged one by one; of equal ids the text with the smaller digest comes
    first.
    """
    # the caller's columns travel in a struct, apart from those of the joins
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    digest = F.md5(F.coalesce(F.concat(F.lit("t"), "body"), F.lit("")).cast("binary"))
    counts = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n"), (F.min(digest) != F.max(digest)).alias("differ")).filter("n > 1")
    repeats = checkpointed(counts.select(F.col("id").alias("again"), "differ"))
    if repeats.isEmpty():
        dropped = near_duplicates(rows.select("id", "body"), shingle_words=5, percent=80, id_col="id", text_col="body").filter(~F.col("kept")).select(F.col("doc_id").alias("gone"))
        return rows.join(dropped, F.col("id") == F.col("gone"), "left_anti").select("doc.*")
    marked = rows.join(repeats, F.col("id") == F.col("again"), "left").withColumn("digest", F.when(F.col("again").isNotNull(), digest))
    # one row for each text of an id that repeats, and keys below all ids for those of ids with several texts
    first = marked.filter(F.col("again").isNotNull()).groupBy("id", "digest").agg(F.first("doc").alias("doc"), F.first("body").alias("body"), F.first("differ").alias("differ"))
    least = rows.agg(F.least(F.min("id"), F.lit(0))).first()[0]
    texts = checkpointed(first.withColumn("key", F.when(F.col("differ"), F.lit(least) - 1 - F.monotonically_increasing_id()).otherwise(F.col("id"))))
    single = marked.filter(F.col("again").isNull()).select("doc", "body", F.col("id").alias("key"))
    every = single.unionByName(texts.select("doc", "body", "key"))
    near = checkpointed(near_duplicates(every.select("key", "body"), shingle_words=5, percent=80, id_col="key", text_col="body").select("doc_id", "component_id"))
    plain = near.filter((F.col("component_id") >= least) & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("gone"))
    # groups with a text under a key of its own: the smallest id is looked for
    held = near.filter(F.col("component_id") < least).join(texts.select("key", "id", "digest"), F.col("doc_id") == F.col("key"), "left")
    placed = held.select("component_id", "doc_id", F.struct(F.coalesce("id", "doc_id").alias("id"), F.coalesce("digest", F.lit("")).alias("digest"), "doc_id").alias("place"))
    firsts = placed.groupBy(F.col("component_id").alias("group")).agg(F.min("place")["doc_id"].alias("first"))
    others = placed.join(firsts, F.col("component_id") == F.col("group")).filter(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias("gone"))
    return every.join(plain.unionByName(others), F.col("key") == F.col("gone"), "left_anti").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever its id, null included."""
    items = table(spark, sf_dir, "benchmark").withColumn("item_id", F.lit(0))
    return docs.filter(F.size(overlapping_items(docs, items)) == 0)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is masked by its kind."""
    return mask_personal_data(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the times each is taken."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: The stages need trained models and hashes that SQL lacks; a test holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
