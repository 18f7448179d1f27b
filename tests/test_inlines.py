"""Styles cut out of the joined text of blocks."""

import pytest

from quire.plans.extract import extract
from quire.publish.serialize import block_nodes, package_files
from tests.test_thresholds import FILL as SHORT
from tests.test_thresholds import RUN

FILL = [*SHORT, "and", "go", "on"]

STYLED = RUN + ", italic boolean, mono boolean"


def block(doc, lines):
    """Lines of (text, gap before, style) runs, ten points high."""
    rows = []
    for k, pieces in enumerate(lines):
        x = 72
        for n, (text, gap, style) in enumerate(pieces):
            x += gap
            up = {"sup": -3, "sub": 3}.get(style, 0)
            rows.append((doc, 0, k * 100 + n, text, x, 80 + 14 * k + up, 6 if up else 10, 6 * len(text), "F1", style == "b", False, style == "i", style == "code"))
            x += 6 * len(text)
    return rows


@pytest.fixture(scope="module")
def found(spark):
    fill = [(w, 3, "") for w in FILL]
    rows = [
        *block(1, [[("let", 0, "b"), ("ter", 0, ""), ("here", 3, ""), ("and", 3, "i"), ("there", 3, "i"), ("go", 3, "code"), *fill]]),
        *block(2, [[*fill, ("mag", 3, "i"), ("-", 0, "i")], [("azine", 0, ""), ("on", 3, "b"), *fill]]),
        *block(3, [[("1.", 0, "b"), ("First", 3, "b"), ("item", 3, ""), *fill]]),
        *block(4, [[("x", 0, ""), ("2", 0, "sup"), ("y", 3, ""), *fill]]),
        *block(5, [fill]),
    ]
    return as_rows(extract(spark.createDataFrame(rows, STYLED)).blocks)


def as_rows(blocks):
    rows = blocks.collect()
    assert len(rows) == 5
    return blocks.sparkSession.createDataFrame(rows, blocks.schema)


@pytest.fixture(scope="module")
def inlines(found):
    return {r["doc_id"]: (r["kind"], [(i["s"], "".join(c for c in ("b", "i", "code", "sub", "sup") if i[c])) for i in r["inlines"]]) for r in found.collect()}


REST = " ".join(FILL)


def test_a_word_set_in_two_styles_stays_one(inlines):
    assert inlines[1][1] == [("let", "b"), ("ter here ", ""), ("and there ", "i"), ("go", "code"), (f" {REST}", "")]


def test_hyphens_are_healed_across_styles(inlines):
    assert inlines[2][1] == [(f"{REST} ", ""), ("mag", "i"), ("azine ", ""), ("on", "b"), (f" {REST}", "")]


def test_list_markers_are_taken_off(inlines):
    assert inlines[3] == ("list", [("First", "b"), (f" item {REST}", "")])


def test_scripts_and_plain_text(inlines):
    assert inlines[4][1] == [("x", ""), ("2", "sup"), (f" y {REST}", "")]
    assert inlines[5][1] == [(REST, "")]


def test_packages_hold_the_inlines(spark, found):
    meta = spark.createDataFrame([(k, "T", "en", "A", "12345678-1234-1234-1234-123456789abc", "2024-01-02T03:04:05Z") for k in range(1, 6)], "doc_id long, title string, language string, creator string, uuid string, modified string")
    pages = {r["doc_id"]: bytes(r["data"]).decode() for r in package_files(block_nodes(found), meta, b"").filter("path LIKE '%ch000.xhtml'").collect()}
    assert "<p><strong>let</strong>ter here <em>and there </em><code>go</code> a line" in pages[1]
    assert "<em>mag</em>azine <strong>on</strong> a line" in pages[2]
    assert "<ol>\n  <li><strong>First</strong> item a line" in pages[3] and "x<sup>2</sup> y" in pages[4]
