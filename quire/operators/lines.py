"""Lines from positioned runs: clustering, modal size, weight, bounds and leading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quire.functions.text import let, strip
from quire.operators import line_arrays
from quire.operators.glyph_join import RUN_FIELDS, collect_lines

#: Runs closer than this share of the larger em lie on one line, as tenths.
SAME_LINE_TENTHS = 4
BOLD_SHARE = 0.6
#: Scripts: largest size and offset from the baseline, as shares of the line's em. Fixed values.
SCRIPT_SIZE, SCRIPT_OFFSET = 0.75, (0.2, 0.6)
#: Characters that make a page more than a scan. Fixed value.
SCANNED = 40


def round_em(em: Column) -> Column:
    """To one decimal, halves up."""
    return F.floor(em * 10 + 0.5) / 10


def cluster_lines(runs: DataFrame) -> DataFrame:
    """Adds `line_no` (per page) to the upright runs; a run starts a line if its baseline leaves the run before it."""
    order = Window.partitionBy("doc_id", "page").orderBy("baseline_y", "x", "run_no")
    apart = F.abs(F.col("baseline_y") - F.lag("baseline_y").over(order)) * 10 >= F.greatest("em", F.lag("em").over(order)) * SAME_LINE_TENTHS
    starts = F.when(F.lag("run_no").over(order).isNull() | apart, 1).otherwise(0)
    return runs.filter(~F.col("skewed")).withColumn("starts", starts).withColumn("line_no", (F.sum("starts").over(order) - 1).cast("int")).drop("starts")


def modal_em(runs: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """The most common em of each group, weighted by characters; of equals the one met first."""
    weighed = runs.groupBy(*keys, round_em(F.col("em")).alias("em")).agg(F.sum(F.length(text)).alias("weight"), F.min(F.struct(*order)).alias("first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("weight"), "first")
    return weighed.withColumn("r", F.row_number().over(best)).filter("r = 1").select(*keys, "em")


def line_fact_columns(baseline: bool = True) -> list[Column]:
    """Bounds, median baseline if wanted, bold majority and number of runs."""
    top = F.min(F.col("baseline_y") - F.col("em"))
    return [
        F.min("x").alias("x"), (F.max(F.col("x") + F.col("advance")) - F.min("x")).alias("w"), top.alias("y"), (F.max("baseline_y") - top).alias("h"), *([F.median("baseline_y").alias("baseline_y")] if baseline else []),
        (F.sum(F.when(F.col("bold"), F.length("str")).otherwise(0)) > F.sum(F.length("str")) * BOLD_SHARE).alias("bold"), F.count("*").alias("n_runs"),
    ]


def line_facts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("doc_id", "page", "line_no").agg(*line_fact_columns())


def modal_em_of(runs: Column, chars: Callable[[Column], Column] = lambda r: F.length(r["str"])) -> Column:
    """`modal_em` of a line's runs in an array, from left to right; chars: the characters of a run."""
    sizes = F.array_distinct(F.transform(runs, lambda r: round_em(r["em"]).cast("double")))

    def weight(em: Column) -> Column:
        return F.aggregate(F.filter(runs, lambda r: round_em(r["em"]) == em), F.lit(0), lambda n, r: n + chars(r))

    def heaviest(ems: Column) -> Column:
        best = F.array_max(F.transform(ems, lambda em, i: F.struct(weight(em).alias("weight"), (-i).alias("first"), em.alias("em"))))["em"]
        return F.when(F.size(ems) == 1, F.get(ems, F.lit(0))).otherwise(best)

    return let(sizes, heaviest)


def script_of(run: Column, em: Column, base: Column) -> Column:
    """sup or sub for a run much smaller than its line's modal em and off its median baseline; null for others."""
    off = (base - run["baseline_y"]) / F.when(em == 0, 1).otherwise(em)
    return F.when((run["em"] < em * SCRIPT_SIZE) & F.abs(off).between(*SCRIPT_OFFSET), F.when(off > 0, "sup").otherwise("sub"))


def script_marks(placed: DataFrame) -> DataFrame:
    """(doc_id, page, run_no, script) of all runs."""
    lines = collect_lines(placed, F.median("baseline_y").alias("base")).withColumn("em", modal_em_of(F.col("runs")))
    marks = F.transform("runs", lambda r: F.struct(r["run_no"].alias("run_no"), script_of(r, F.col("em"), F.col("base")).alias("script")))
    return lines.select("doc_id", "page", F.explode(marks).alias("m")).select("doc_id", "page", "m.*")


def median_leading(lines: DataFrame) -> DataFrame:
    """The median positive distance between the lines of each page; 0 if there is none."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    gap = lines.withColumn("gap", F.col("baseline_y") - F.lag("baseline_y").over(order))
    return gap.groupBy("doc_id", "page").agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0.0)).alias("leading"))


def detracked_warning(lines: DataFrame) -> DataFrame:
    """One warning for each document with repaired lines. lines: doc_id, detracked."""
    found = lines.groupBy("doc_id").agg(F.count_if("detracked").alias("n")).filter("n > 0")
    what = F.when(F.col("n") == 1, " line had").otherwise(" lines had")
    return found.select("doc_id", F.lit("letter-spacing").alias("code"), F.concat(F.col("n").cast("string"), what, F.lit(" letters set apart, which were joined")).alias("message"))


def page_chars(runs: DataFrame) -> DataFrame:
    """(doc_id, page, chars, n_skewed): characters of all runs without white space at their ends, and runs that are turned."""
    return runs.groupBy("doc_id", "page").agg(F.sum(F.length(strip(F.col("str")))).alias("chars"), F.count_if(F.col("skewed") & (F.col("str") != "")).alias("n_skewed"))


def scanned_pages(runs: DataFrame, least: int = SCANNED) -> DataFrame:
    """Pages whose text is too short to be more than a scan."""
    return page_chars(runs).filter(F.col("chars") < least).select("doc_id", "page", "chars")


def page_warnings(pages: DataFrame) -> DataFrame:
    """(doc_id, page, code, message): pages that look scanned, pages with turned runs and pages with a line of uncertain spacing, but for letter-spaced ones; page 0 for a document's letter-spaced lines. pages: of `pages_read`."""
    facts = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page", "chars", "n_skewed", "unsure")).alias("pages"), F.sum("n_detracked").alias("n"))

    def warning(page: Column, code: str, *message: Column) -> Column:
        return F.struct(page.alias("page"), F.lit(code).alias("code"), F.concat(*message).alias("message"))

    def of_page(p: Column) -> Column:
        shown, read = (p["page"] + 1).cast("string"), p["chars"] >= SCANNED
        return F.array_compact(F.array(
            F.when(~read, warning(p["page"], "page-skipped", F.lit("Page "), shown, F.lit(" has no text; it may be a scan"))),
            F.when(read & (p["n_skewed"] > 0), warning(p["page"], "rotated-text", p["n_skewed"].cast("string"), F.lit(" turned runs were left out of page "), shown)),
            F.when(p["unsure"], warning(p["page"], "space-heuristic-uncertain", F.lit("The spaces of page "), shown, F.lit(" are uncertain"))),
        ))

    repaired = warning(F.lit(0), "letter-spacing", F.col("n").cast("string"), F.when(F.col("n") == 1, " line had").otherwise(" lines had"), F.lit(" letters set apart, which were joined"))
    found = F.concat(F.flatten(F.transform("pages", of_page)), F.array_compact(F.array(F.when(F.col("n") > 0, repaired))))
    return facts.select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.*")


#: Runs of pages that are worked on at once, but for a larger page.
AT_ONCE = 200_000


def _page_reader(fields: list[str]) -> Callable[..., Column]:
    @F.arrow_udf(from_arrow_type(line_arrays.PAGE))
    def read(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Pages in the order of their documents: what lines take over from those before goes on from page to page."""
        taken: dict = {}
        fonts: dict = {}
        last, number = None, -1
        for docs, pages, held in batches:
            out = []
            ends = held.offsets.to_numpy() - held.offsets[0].as_py()
            values = docs.to_pylist()
            at = 0
            while at < len(docs):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, side="right")) - 1)
                numbers = []
                for value in values[at:to]:
                    number += number < 0 or value != last
                    last = value
                    numbers.append(number)
                runs = line_arrays.runs_of(held.slice(at, to - at), np.array(numbers), pages.slice(at, to - at), fonts)
                found = line_arrays.assembled(runs, number + 1, taken).flatten()
                out.append(found)
                for key in [k for k in taken if k[0] != number]:
                    del taken[key]
                at = to
            yield pa.concat_arrays(out) if out else pa.array([], line_arrays.PAGE)

    # not deterministic, lest the order it reads in be thought of no use
    return read.asNondeterministic()


def pages_read(runs: DataFrame) -> DataFrame:
    """One row per page: doc_id, page, chars, n_skewed, whether a line that was not letter-spaced is of uncertain spacing (`unsure`), `n_detracked`, and the `lines` of readable pages.

    Runs are dealt once, by document, and collected by page; a document's pages are read in order.
    """
    fields = [c for c in (*RUN_FIELDS, "skewed") if c in runs.columns and c != "em_chars"]
    pages = runs.repartition("doc_id").groupBy("doc_id", "page").agg(F.collect_list(F.struct(*fields)).alias("held")).sortWithinPartitions("doc_id", "page")
    return pages.select("doc_id", F.col("page").alias("of_page"), _page_reader(fields)("doc_id", F.col("page").cast("long"), "held").alias("r")).select("doc_id", F.col("of_page").alias("page"), *[f"r.{c}" for c in ("chars", "n_skewed", "unsure", "n_detracked", "lines")])


def lines_of_pages(pages: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The lines of `pages_read`, one a row. kinds: the types of their bounds."""
    return pages.select("doc_id", "page", F.explode("lines").alias("l")).select("doc_id", "page", *[F.col(f"l.{c}").cast(kinds[c]).alias(c) if c in kinds else F.col(f"l.{c}") for c in line_arrays.LINE.names])


def bounds_of(runs: DataFrame) -> dict[str, str]:
    """The types of the bounds of these runs' lines."""
    return dict(runs.agg(*line_fact_columns(baseline=False)[:4]).dtypes)


def assemble_lines(runs: DataFrame) -> DataFrame:
    """Lines of the readable pages: facts, modal em, text with the threshold it was joined at, whether that is uncertain, whether letters were set apart, the runs that are sup or sub, and the styles of its characters.

    The pass over the pages loses Spark's track of the partitioning: lines, a tenth of the runs, are dealt once more, for all that follows.
    """
    return lines_of_pages(pages_read(runs), bounds_of(runs)).repartition("doc_id")
