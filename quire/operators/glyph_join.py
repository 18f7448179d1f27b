"""Words from runs: spaces are put where the gap between runs exceeds a threshold, read off the line itself, passed on by the lines before, or fixed.

A line is one row with its runs in an array, from left to right, and all that
is read off it are functions of that array. Thresholds are passed on from line
to line of a document, among lines that begin with the same font and size:
lines with a threshold of their own and lines that take one over as it is are
settled by windows; only where a line had to move what it took over are the
lines of its kind gone through in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from quire.functions.text import WS, join_verdict, let

#: Fixed thresholds, as shares of an em.
CELL_GAP, LEAST, MOST, DEFAULT = 1.2, 0.16, 1.0, 0.25
CELL_BREAK = "\x1f"
KEYS = ["doc_id", "page", "line_no"]
RUN_FIELDS = ["x", "baseline_y", "run_no", "str", "em", "advance", "font_key", "em_chars", "bold", "italic", "mono"]
#: Style codes: of plain text, and of what is put between runs.
PLAIN, BETWEEN = "0", "_"
#: What a text has too many spaces for, and the factors that move a threshold. Fixed values.
TIGHTER, LOOSER, TRIES = 1.4, 0.7, 2


def collect_lines(placed: DataFrame, *more: Column) -> DataFrame:
    """One row per line: `runs`, from left to right, and other aggregates."""
    fields = [c for c in RUN_FIELDS if c in placed.columns]
    return placed.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("runs"), *more)


def gaps(runs: Column) -> Column:
    """For every run but the first: its text, the distance to the run before as a share of the larger em, whether a space is there already, and the width of a space glyph at either side."""

    def between(a: Column, b: Column) -> Column:
        em = F.greatest(a["em"], b["em"]).cast("double")
        em = F.when(em == 0, 1.0).otherwise(em)
        space = F.when(a["str"] == " ", a["advance"]).when(b["str"] == " ", b["advance"]) / em
        return F.struct(((b["x"] - a["x"] - a["advance"]) / em).alias("gap"), (a["str"].endswith(" ") | b["str"].startswith(" ")).alias("spaced"), space.alias("space"), b["str"].alias("str"))

    n = F.size(runs)
    return F.zip_with(F.slice(runs, 1, n - 1), F.slice(runs, 2, n - 1), between)


def clamp(ratio: Column) -> Column:
    return F.least(F.greatest(ratio, F.lit(LEAST)), F.lit(MOST))


def median_of(values: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    return let(F.array_sort(values), middle)


def space_ratio(held: Column) -> Column:
    """The threshold of a line with space glyphs: median tracking and 45 % of the median space; null without any."""
    spaces = F.transform(F.filter(held, lambda g: g["space"] > 0), lambda g: g["space"])
    tracking = F.transform(F.filter(held, lambda g: g["space"].isNull()), lambda g: g["gap"])
    found = clamp(F.greatest(F.lit(0.0), F.coalesce(median_of(tracking), F.lit(0.0))) + F.lit(0.45) * median_of(spaces))
    return F.when(F.exists(held, lambda g: g["space"] > 0), found)


def otsu_split(values: Column) -> Column:
    """The split of sorted values with the largest variance between the two sides, the first of equals: its variance, the number of low values and both sides' means."""
    n, total = F.size(values), F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("low"), F.lit(0.0).alias("variance"), F.lit(0).alias("n_low"), F.lit(0.0).alias("mean_low"), F.lit(0.0).alias("mean_high"))

    def step(all_of_it: Column) -> Callable[[Column, Column], Column]:
        def at(s: Column, v: Column) -> Column:
            low, high, share = s["low"] / s["i"], (all_of_it - s["low"]) / (n - s["i"]), s["i"] / n
            variance = F.when(s["i"] > 0, share * (1 - share) * F.pow(low - high, 2)).otherwise(0.0)
            better = variance > s["variance"]
            kept = {"variance": variance, "n_low": s["i"], "mean_low": low, "mean_high": high}
            return F.struct((s["i"] + 1).alias("i"), (s["low"] + v).alias("low"), *[F.when(better, new).otherwise(s[c]).alias(c) for c, new in kept.items()])

        return at

    return let(total, lambda t: F.aggregate(values, start, step(t)))


def cluster_ratio(held: Column) -> Column:
    """The threshold of a line whose gaps fall into two clusters, halfway between their means; null for others."""
    sound = F.array_sort(F.filter(F.transform(held, lambda g: g["gap"]), lambda v: v.between(-0.05, 3)))

    def judged(values: Column) -> Column:
        def clear(b: Column) -> Column:
            two = (b["variance"] > 0) & (b["mean_high"] - b["mean_low"] >= 0.2) & (b["n_low"] / F.size(values) >= 0.4)
            return F.when(two, clamp((b["mean_low"] + b["mean_high"]) / 2))

        # without a gap that stands out there is nothing to split
        apart = (F.size(values) >= 6) & (F.element_at(values, -1) - F.element_at(values, 1) >= 0.2)
        return F.when(apart, let(otsu_split(values), clear))

    return F.when(F.size(held) >= 6, let(sound, judged))


def own_ratio(held: Column) -> Column:
    return F.coalesce(space_ratio(held), cluster_ratio(held))


def joined(runs: Column, held: Column, ratio: Column, cell: str = CELL_BREAK, space: str = " ") -> Column:
    """The text of a line at a threshold."""

    def piece(g: Column) -> Column:
        return F.concat(F.when(g["gap"] >= CELL_GAP, cell).when((g["gap"] >= F.greatest(ratio, F.lit(LEAST))) & ~g["spaced"], space).otherwise(""), g["str"])

    return F.concat(F.get(runs, F.lit(0))["str"], F.array_join(F.transform(held, piece), ""))


def joined_styles(runs: Column, held: Column, codes: Column, ratio: Column) -> Column:
    """The styles of a line's text, a character of code for each of its characters; codes: those of the runs. Null if no run has a style."""

    def coded(run: Column, code: Column) -> Column:
        return F.struct(F.repeat(code, F.length(run["str"])).alias("str"))

    rest = F.zip_with(held, F.slice(codes, 2, F.size(codes)), lambda g, c: F.struct(g["gap"].alias("gap"), g["spaced"].alias("spaced"), F.repeat(c, F.length(g["str"])).alias("str")))
    return F.when(F.exists(codes, lambda c: c != PLAIN), joined(F.zip_with(runs, codes, coded), rest, ratio, BETWEEN, BETWEEN))


def joined_with_retries(runs: Column, held: Column, ratio: Column) -> Column:
    """Struct of text, ratio and uncertain: a line joined at a threshold, which is moved twice at most while the text has too many spaces or too few."""

    def judged(r: Column) -> Column:
        return let(joined(runs, held, r), lambda t: F.struct(t.alias("text"), r.alias("ratio"), join_verdict(t).alias("verdict")))

    def again(found: Column) -> Column:
        moved = found["ratio"] * F.when(found["verdict"] == "too-low", TIGHTER).otherwise(LOOSER)
        return F.when(found["verdict"] == "ok", found).otherwise(judged(moved))

    found = judged(ratio)
    for _ in range(TRIES):
        found = let(found, again)
    return let(found, lambda f: F.struct(f["text"].alias("text"), f["ratio"].alias("ratio"), (f["verdict"] != "ok").alias("uncertain")))


def alone(runs: Column) -> Column:
    """A line of one run is that run."""
    return F.struct(F.get(runs, F.lit(0))["str"].alias("text"), F.lit(DEFAULT).alias("ratio"), F.lit(False).alias("uncertain"))


def calibrated_text(placed: DataFrame) -> DataFrame:
    """Lines joined at their own threshold or the fixed one, with retries: text, ratio and whether it stays uncertain."""
    lines = collect_lines(placed.filter("str <> ''")).withColumn("gaps", gaps(F.col("runs"))).withColumn("own", own_ratio(F.col("gaps")))
    found = F.when(F.size("runs") == 1, alone(F.col("runs"))).otherwise(joined_with_retries(F.col("runs"), F.col("gaps"), F.coalesce("own", F.lit(DEFAULT))))
    return lines.withColumn("found", found).select(*KEYS, "found.*")


# --- thresholds that lines take over from those before

FOUND = StructType([StructField("text", StringType()), StructField("ratio", DoubleType()), StructField("uncertain", BooleanType())])
_SPACES = re.compile(WS.replace("\\\\", "\\") + "+")


def _joined(first: str, held: list[dict], ratio: float) -> tuple[str, str]:
    """`joined` and its verdict, for one line."""
    least = max(ratio, LEAST)
    text = first + "".join((CELL_BREAK if g["gap"] >= CELL_GAP else " " if g["gap"] >= least and not g["spaced"] else "") + g["str"] for g in held)
    plain = text.replace(CELL_BREAK, " ")
    tokens = [t for t in _SPACES.split(plain) if t]
    letters, n = sum(map(len, tokens)), len(tokens)
    if n >= 4 and (letters / n < 2 or sum(len(t) == 1 for t in tokens) / n > 0.6):
        return text, "too-low"
    return text, "too-high" if " " not in plain and letters > 40 else "ok"


@F.pandas_udf(FOUND)
def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of documents in order of their kind, page and number; `redo` marks the kinds to go through, `begins` the first line of each."""
    taken = DEFAULT
    for frame in parts:
        texts: list[str | None] = [None] * len(frame)
        ratios: list[float | None] = [None] * len(frame)
        unsure: list[bool | None] = [None] * len(frame)
        columns = (frame[c].tolist() for c in ("redo", "begins", "passes", "first", "gaps"))
        for i, (redo, begins, passes, first, held) in enumerate(zip(*columns, strict=True)):
            if not redo:
                continue
            if begins:
                taken = DEFAULT
            if first is None:
                # settled: a threshold of its own, or one run
                taken = taken if pd.isna(passes) else passes
                continue
            ratio = taken
            text, verdict = _joined(first, held, ratio)
            for _ in range(TRIES):
                if verdict == "ok":
                    break
                ratio *= TIGHTER if verdict == "too-low" else LOOSER
                text, verdict = _joined(first, held, ratio)
            texts[i], ratios[i], unsure[i] = text, ratio, verdict != "ok"
            if verdict == "ok":
                taken = ratio
        yield pd.DataFrame({"text": texts, "ratio": pd.array(ratios, "Float64"), "uncertain": pd.array(unsure, "boolean")})


def with_taken_thresholds(lines: DataFrame) -> DataFrame:
    """lines (KEYS, runs, ...) with `found`: text, ratio and uncertain of each, thresholds passed on among a document's lines that begin with one font and size; and `styles`, of `codes`. `runs` and `codes` are given up.

    All windows have the document as partition. The Python part reads the lines in the order of the last
    window; it gets pieces only of lines whose kind had a threshold moved.
    """
    font, size = F.get("runs", F.lit(0))["font_key"], F.get("runs", F.lit(0))["em"].cast("double")
    kind = ["doc_id", "kind_font", "kind_size"]
    held = lines.withColumn("gaps", gaps(F.col("runs"))).withColumn("own", own_ratio(F.col("gaps"))).withColumn("kind_font", font).withColumn("kind_size", F.floor(size * 10 + 0.5))
    several = F.size("runs") > 1
    settled = F.when(~several, alone(F.col("runs"))).when(F.col("own").isNotNull(), joined_with_retries(F.col("runs"), F.col("gaps"), F.col("own")))
    first = held.withColumn("settled", settled).withColumn("several", several)
    passes = F.when(F.col("several") & ~F.col("settled.uncertain"), F.col("settled.ratio"))
    order = Window.partitionBy(*kind).orderBy("page", "line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    taken = first.withColumn("passes", passes).withColumn("taken", F.coalesce(F.last("passes", ignorenulls=True).over(before), F.lit(DEFAULT))).withColumn("begins", F.row_number().over(order) == 1)
    rest = F.when(F.col("settled").isNull(), joined_with_retries(F.col("runs"), F.col("gaps"), F.col("taken")))
    tried = taken.withColumn("rest", rest)
    moved = F.col("rest").isNotNull() & ~F.col("rest.uncertain") & (F.col("rest.ratio") != F.col("taken"))
    marked = tried.withColumn("redo", F.max(moved).over(Window.partitionBy(*kind)))
    again = F.col("redo") & F.col("settled").isNull()
    pieces = F.struct(F.col("redo").alias("redo"), F.col("begins").alias("begins"), F.col("passes").alias("passes"), F.when(again, F.get("runs", F.lit(0))["str"]).alias("first"), F.when(again, F.transform("gaps", lambda g: F.struct(g["gap"].alias("gap"), g["spaced"].alias("spaced"), g["str"].alias("str")))).alias("gaps"))
    sorted_lines = marked.withColumn("pieces", pieces).sortWithinPartitions(*kind, "page", "line_no")
    # not deterministic, lest the order it reads in be thought of no use
    redone = sorted_lines.withColumn("redone", _in_order.asNondeterministic()("pieces"))
    found = F.when(F.col("redone.text").isNotNull(), F.col("redone")).otherwise(F.coalesce("settled", "rest"))
    styles = joined_styles(F.col("runs"), F.col("gaps"), F.col("codes"), F.col("found.ratio"))
    return redone.withColumn("found", found).withColumn("styles", styles).select(*[c for c in lines.columns if c not in ("runs", "codes")], "styles", "found")
