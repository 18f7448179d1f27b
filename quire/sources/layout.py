"""Positioned text: a table scan, and a synthetic layout of plain documents for tests and driver queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The layout's measures, in points.
RUNS_PER_LINE, LINES_PER_PAGE, MARGIN, LEADING, ADVANCE = 12, 40, 72, 14, 6


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout_runs(docs: DataFrame) -> DataFrame:
    """One run per word: short paragraphs are set larger and bold, 12 words to a line, 40 lines to a page.

    All windows share the document as partition, so the words are shuffled once.
    """
    paragraphs = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "p"))
    # the words of a paragraph are found once and counted before they part ways
    split = paragraphs.select("doc_id", "para", F.explode(F.array(F.array_remove(F.split("p", " "), ""))).alias("words"))
    words = split.select("doc_id", "para", F.size("words").alias("para_len"), F.posexplode("words").alias("k", "str"))
    order = Window.partitionBy("doc_id").orderBy("para", "k")
    placed = (
        words.withColumn("run_no", (F.row_number().over(order) - 1).cast("int"))
        .withColumn("line", (F.sum((F.col("k") % RUNS_PER_LINE == 0).cast("int")).over(order) - 1).cast("int"))
        .withColumn("em", F.when(F.col("para_len") <= 6, 14).otherwise(10))
        .withColumn("advance", F.length("str") * ADVANCE)
    )
    before = Window.partitionBy("doc_id", "line").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("advance") + F.when(F.col("em") == 14, 4).otherwise(3)
    return placed.select(
        "doc_id", F.floor(F.col("line") / LINES_PER_PAGE).cast("int").alias("page"), "run_no", "str",
        (F.coalesce(F.sum(step).over(before), F.lit(0)) + MARGIN).cast("int").alias("x"),
        (F.col("line") % LINES_PER_PAGE * LEADING + MARGIN).cast("int").alias("baseline_y"),
        "em", "advance", F.lit("F1").alias("font_key"), (F.col("para_len") <= 6).alias("bold"), F.lit(False).alias("skewed"), F.col("line").alias("laid_line"),
    )


def tracked_runs(runs: DataFrame) -> DataFrame:
    """Letter-spaced text: one run per character."""
    line = Window.partitionBy("doc_id", "laid_line").orderBy("run_no")
    words = runs.withColumn("word", F.row_number().over(line) - 1).withColumn("chars", F.coalesce(F.sum(F.length("str")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = words.select("doc_id", "page", "laid_line", "run_no", "baseline_y", "em", "word", "chars", F.posexplode(F.split("str", "")).alias("k", "ch")).filter(F.col("ch") != "")
    index = F.col("chars") + F.col("k")
    return each.select("doc_id", "page", "laid_line", (F.col("run_no") * 1000 + F.col("k")).alias("run_no"), F.col("ch").alias("str"), (F.lit(MARGIN) + 9 * index + 6 * F.col("word")).cast("int").alias("x"), "baseline_y", "em", F.lit(ADVANCE).alias("advance"), F.lit("F1").alias("font_key"), F.lit(False).alias("bold"), F.lit(False).alias("skewed"))


def mixed_runs(runs: DataFrame) -> DataFrame:
    """The words in six manners, by line: plain; a run for each character; with space glyphs; with spaces between a word's letters; the first characters only; in another font, some raised and small, some turned."""
    line = Window.partitionBy("doc_id", "laid_line").orderBy("run_no")
    words = runs.withColumn("word", F.row_number().over(line) - 1).withColumn("chars", F.coalesce(F.sum(F.length("str")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    manner, word = F.col("laid_line") % 6, F.col("word")

    def run(k: int | Column, text: Column, x: Column, advance: Column, em: Column = F.col("em"), y: Column = F.col("baseline_y"), skewed: Column = F.lit(False)) -> Column:
        return F.struct((F.col("run_no") * 1000 + k).alias("run_no"), text.alias("str"), x.cast("int").alias("x"), y.cast("int").alias("baseline_y"), em.cast("int").alias("em"), advance.cast("int").alias("advance"), skewed.alias("skewed"))

    letters = F.filter(F.split("str", ""), lambda c: c != "")
    each = F.transform(letters, lambda c, k: run(k, c, F.lit(MARGIN) + 9 * (F.col("chars") + k) + 6 * word, F.lit(ADVANCE)))
    whole, raised = run(0, F.col("str"), F.col("x"), F.col("advance")), word % 3 == 1
    pieces = (
        F.when(manner == 1, each).when(manner == 2, F.array(whole, run(1, F.lit(" "), F.col("x") + F.col("advance"), F.lit(3))))
        .when(manner == 3, F.array(run(0, F.array_join(letters, " "), F.col("x"), F.col("advance")))).when(manner == 4, F.filter(each, lambda r: r["x"] < MARGIN + 45))
        .when(manner == 5, F.array(run(0, F.col("str"), F.col("x"), F.col("advance"), F.when(raised, 6).otherwise(F.col("em")), F.col("baseline_y") - F.when(raised, 3).otherwise(0), word % 10 == 7)))
        .otherwise(F.array(whole))
    )
    return words.select("doc_id", "page", "bold", F.when(manner == 5, "F2").otherwise("F1").alias("font_key"), F.explode(pieces).alias("r")).select("doc_id", "page", "r.*", "font_key", "bold")


def marked_items(runs: DataFrame) -> DataFrame:
    """A stream of text items with marked content, from the number n of each word on its page.

    Every 9th word opens a span without an id, every 5th of these an artifact; the next word opens one with an id inside it. The inner one
    ends two words later, the outer one four. After every 13th word stands an end that need not close anything.
    """
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("run_no")) - 1
    none = F.lit(None).cast("string")

    def item(o: int, kind: str, mc_id: Column = none, tag: Column = none) -> Column:
        return F.struct(F.lit(o).alias("o"), F.lit(kind).alias("type"), mc_id.alias("mc_id"), tag.alias("mc_tag"))

    n_ = F.col("n")
    items = F.array(
        F.when(n_ % 9 == 0, item(0, "begin", none, F.when(n_ % 45 == 0, "Artifact").otherwise("Div"))),
        F.when(n_ % 9 == 1, item(0, "begin", F.concat(F.lit("m"), n_), F.lit("P"))),
        item(1, "text"),
        F.when((n_ % 9 == 3) | (n_ % 9 == 5), item(2, "end")),
        F.when(n_ % 13 == 12, item(3, "end")),
    )
    return runs.withColumn("n", n).select("doc_id", "page", "n", "str", F.explode(F.array_compact(items)).alias("i")).select("doc_id", "page", (n_ * 4 + F.col("i.o")).alias("seq"), "i.type", F.when(F.col("i.type") == "text", F.col("str")).alias("str"), "i.mc_id", "i.mc_tag")


def text_items(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text items, font styles and viewports that give the runs back, but for what must fall out.

    By the number n of a word on its page: every 101st has a short transform, every 103rd no text, every 97th is turned; words 0 to 4 of each
    45 lie in an artifact, 10 to 14 in a marked span. The page is 792 points high, y growing upwards.
    """
    n = F.col("n")
    numbered = runs.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("run_no")) - 1)
    em, x, y, zero = (F.col(c).cast("double") if c else F.lit(0.0) for c in ("em", "x", "baseline_y", ""))
    plain = F.when(n % 97 == 5, F.array(zero, em, -em, zero, x, 792 - y)).otherwise(F.array(em, zero, zero, em, x, 792 - y))
    transform = F.when(n % 101 == 7, F.slice(plain, 1, 4)).otherwise(plain)
    font = F.when(F.col("bold"), "g1-Bold").when(n % 50 == 1, "g2").when(n % 70 == 2, "g3").otherwise("g4")
    none = F.lit(None).cast("string")

    def item(o: int, kind: str, mc_id: Column = none, tag: Column = none) -> Column:
        return F.struct(F.lit(o).alias("o"), F.lit(kind).alias("type"), mc_id.alias("mc_id"), tag.alias("mc_tag"))

    items = F.array(
        F.when(n % 45 == 0, item(0, "begin", none, F.lit("Artifact"))).when(n % 45 == 10, item(0, "begin", F.concat(F.lit("m"), n), F.lit("P"))), item(1, "text"), F.when((n % 45 == 4) | (n % 45 == 14), item(2, "end")),
    )
    each = numbered.select("doc_id", "page", "n", "str", "advance", transform.alias("transform"), font.alias("font_name"), F.explode(F.array_compact(items)).alias("i"))
    text = F.col("i.type") == "text"
    found = each.select(
        "doc_id", "page", (n * 3 + F.col("i.o")).cast("int").alias("seq"), "i.type", F.when(text, F.when(n % 103 == 9, "").otherwise(F.col("str"))).alias("str"), F.when(text, F.col("transform")).alias("transform"),
        F.col("advance").cast("double").alias("width"), F.when(n % 5 == 0, 0.0).otherwise(0.8).alias("height"), "font_name", "i.mc_id", "i.mc_tag",
    )
    pages = runs.select("doc_id", "page").distinct()
    families = F.array(F.struct(F.lit("g1-Bold").alias("f"), F.lit("Serif").alias("family")), F.struct(F.lit("g2").alias("f"), F.lit("Courier New").alias("family")), F.struct(F.lit("g3").alias("f"), F.lit("Sans Oblique").alias("family")))
    styles = pages.select("doc_id", "page", F.explode(families).alias("s")).select("doc_id", "page", F.col("s.f").alias("font_name"), "s.family")
    viewports = pages.select("doc_id", "page", F.array(*[F.lit(float(v)) for v in (1, 0, 0, -1, 0, 792)]).alias("viewport"))
    return found, styles, viewports
