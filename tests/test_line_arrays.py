"""Lines on arrays against the columns that define them, and plans in which words are never rows."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import glyph_join, lines
from quire.plans import documents
from quire.plans.extract import extract, extract_documents
from quire.plans.queries import queries
from quire.sources.layout import layout_runs, mixed_runs, tracked_runs
from tests.conftest import SMALL

TOKENS = ["a", "b", "é", "1", "2.", "-", "(", "[b]", "word", "longer", "Straße", "日本語", "日", "😀", "=", "·", "non-", "end.", "CAPS", " ", "a b", "　", "\t", "x\ty", "\x1f", "a\x1fb", "w" * 45, "•", "1)", "soft­"]


@pytest.fixture(scope="module")
def docs(spark):
    """Letters set apart, white space of all kinds, lines too loose and too tight for what they take over, and rows that share an id."""
    dice = random.Random(3)
    kinds = [TOKENS, list("abcdefgh12"), ["the", "word", "letters", "reading."], ["w" * 30, "ab", "c"]]
    rows = [(i, "\n".join(dice.choice([" ", "  "]).join(dice.choice(dice.choice(kinds)) for _ in range(dice.choice([1, 3, 7, 13, 60]))) for _ in range(dice.choice([0, 1, 5, 30])))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n "), (53, "a b c d e f g h " * 40), (54, "twice here\nand more words\n" * 4), (54, "twice here\nand more words\n" * 4)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def plain(df):
    def shown(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(shown, r)) for r in df.select(*sorted(df.columns)).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_letter_spaced_lines(docs):
    placed = lines.cluster_lines(tracked_runs(layout_runs(docs)))
    assert plain(documents.calibrated_text(docs)) == plain(glyph_join.calibrated_text(placed).select(*glyph_join.KEYS, "text", "ratio", "uncertain"))


def test_thresholds_of_clusters_and_of_spaces(docs):
    held = glyph_join.collect_lines(lines.cluster_lines(tracked_runs(layout_runs(docs)))).withColumn("ratio", glyph_join.cluster_ratio(glyph_join.gaps(F.col("runs"))))
    assert plain(documents.cluster_calibration(docs)) == plain(held.select(*glyph_join.KEYS, "ratio").filter("ratio IS NOT NULL"))
    r = lines.cluster_lines(layout_runs(docs)).withColumn("run_no", F.col("run_no") * 2)
    spaces = r.withColumn("run_no", F.col("run_no") + 1).withColumn("x", F.col("x") + F.col("advance")).withColumn("str", F.lit(" ")).withColumn("advance", F.lit(3))
    held = glyph_join.collect_lines(r.unionByName(spaces)).withColumn("ratio", glyph_join.space_ratio(glyph_join.gaps(F.col("runs"))))
    assert plain(documents.space_calibration(docs)) == plain(held.select(*glyph_join.KEYS, "ratio").filter("ratio IS NOT NULL"))


@pytest.mark.parametrize("manner", ["plain", "styled", "mixed"])
def test_documents_read_as_their_runs_do(docs, manner):
    """The pass over texts and the one over pages of runs, some of which lie in several batches."""
    n = F.col("run_no")
    laid = layout_runs(docs)
    given = {"plain": laid, "styled": laid.withColumn("italic", n % 11 == 3).withColumn("mono", n % 13 == 5), "mixed": mixed_runs(laid)}[manner]
    by_runs, by_text = extract(given), extract_documents(docs, manner)
    assert by_text.assembled.schema.simpleString() == by_runs.assembled.schema.simpleString()
    assert plain(by_text.assembled) == plain(by_runs.assembled)
    assert plain(by_text.warnings) == plain(by_runs.warnings)


def test_lines_taken_over_from_page_to_page(spark, docs):
    """A batch of one page each gives what one batch of all gives."""
    given = mixed_runs(layout_runs(docs))
    whole = plain(lines.assemble_lines(given))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert plain(lines.assemble_lines(given)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["g1_calibrated_text", "g3_space_calibration", "g4_cluster_calibration", "l1_lines", "l1_warnings", "a2_body_em", "f5_heading_candidates", "h1_headings", "b2_breaks", "b1_blocks", "b7_block_inlines"])
def test_words_are_never_rows(spark, name):
    """Texts are dealt once and read once; no words are dealt or sorted."""
    found = plan(queries()[name](spark, SMALL))
    assert found.count("FileScan parquet") == 1
    below = found[found.index("ArrowEvalPython") :]
    assert below.count("Exchange") == 1 and "Window" not in below and "posexplode" not in found
