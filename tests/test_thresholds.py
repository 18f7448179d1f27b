"""Thresholds that lines take over from the lines before them."""

import pytest
from pyspark.sql import functions as F

from quire.operators import glyph_join, lines
from quire.plans.extract import extract

RUN = "doc_id long, page int, run_no int, str string, x int, baseline_y int, em int, advance int, font_key string, bold boolean, skewed boolean"


def line(doc, page, y, pieces, gap, font="F1", em=10):
    """Runs of six points a character, so many tenths of an em apart."""
    x, out = 72, []
    for k, text in enumerate(pieces):
        out.append((doc, page, page * 10_000 + y * 100 + k, text, x, y, em, 6 * len(text), font, False, False))
        x += 6 * len(text) + gap
    return out


FILL = "a line of many plain words that make a page".split()


@pytest.fixture(scope="module")
def found(spark):
    """The second line moves the threshold, other fonts keep theirs, a certain line of its own sets it again; document 2 has nothing to take over."""
    rows = [
        *line(1, 0, 80, FILL, 3), *line(1, 0, 100, "abcde", 3), *line(1, 0, 120, FILL, 3), *line(1, 0, 140, FILL, 3, font="F2"),
        *line(1, 1, 80, "abcde", 3), *line(1, 1, 100, ["one", "two"], 3), *line(1, 1, 120, [w for f in FILL for w in (f, " ")][:-1], 0), *line(1, 1, 140, ["x", "y"], 4),
        *line(2, 0, 80, ["one", "two"], 3), *line(2, 0, 100, FILL, 3), *line(2, 0, 120, ["w" * 50, "v" * 50], 1), *line(2, 0, 140, ["one", "two"], 3), *line(2, 0, 160, ["one"], 3),
    ]
    return {(r["doc_id"], r["page"], r["line_no"]): r for r in lines.assemble_lines(spark.createDataFrame(rows, RUN)).collect()}


def test_thresholds_are_passed_on(found):
    plain, glued = " ".join(FILL), "".join(FILL)
    texts = {k: r["text"] for k, r in found.items()}
    assert texts[1, 0, 0] == plain and texts[1, 0, 1] == "abcde"
    # 0.35 came from the line before; it is too much here and moved to 0.245, and so on
    assert texts[1, 0, 2] == (plain if len(glued) > 40 else glued)
    assert texts[1, 0, 3] == plain and found[1, 0, 3]["ratio"] == 0.25
    assert found[1, 0, 1]["ratio"] == pytest.approx(0.35)
    # a line of its own threshold over the page's end
    assert found[1, 1, 3]["ratio"] == found[1, 1, 2]["ratio"] != 0.25
    assert texts[2, 0, 0] == "one two" and found[2, 0, 0]["ratio"] == 0.25


def test_uncertain_lines_pass_nothing_on(found):
    assert found[2, 0, 2]["uncertain"] and found[2, 0, 3]["ratio"] == 0.25 and found[2, 0, 3]["text"] == "one two"
    assert found[2, 0, 4]["ratio"] == 0.25 and not found[2, 0, 4]["uncertain"]


def test_verdicts_agree(spark):
    """The verdict of the ordered part is that of the column expression."""
    texts = ["a b c d", "word " * 9, "x" * 41, "x" * 41 + "\x1f", "x y" * 20, " ", "", "a\tb c\nd e", "ab cd ef gh", "　a b c", "x" * 20 + "\t" + "y" * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", glyph_join.join_verdict(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == [glyph_join._joined(r["t"], [], 0.25)[1] for r in rows]


def test_no_lines(spark):
    empty = extract(spark.createDataFrame([], RUN))
    assert empty.lines.count() == empty.blocks.count() == empty.warnings.count() == 0


def test_turned_runs_and_scans_are_reported(spark):
    rows = [*line(1, 0, 80, FILL + FILL, 3), *line(1, 1, 80, ["short"], 3)]
    rows = [(*r[:10], i == 2 * len(FILL) - 1) for i, r in enumerate(rows)]
    got = extract(spark.createDataFrame(rows, RUN))
    assert sorted((r["page"], r["code"]) for r in got.warnings.collect()) == [(0, "rotated-text"), (1, "page-skipped")]
    assert [r["text"] for r in got.lines.collect()] == [" ".join(FILL + FILL[:-1])]
