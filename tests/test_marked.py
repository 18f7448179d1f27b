"""Marked content by windows against a stack, and the plan: items are dealt once."""

import random

from pyspark.sql import functions as F

from quire.operators.marked import tag_texts
from quire.operators.text_items import text_runs
from quire.plans.queries import queries
from tests.conftest import SMALL

ITEM = "doc_id long, page int, seq long, type string, str string, mc_id string, mc_tag string, level long"


def by_stack(rows):
    out, stacks = set(), {}
    for doc, page, seq, kind, text, mc_id, tag, _ in sorted(rows, key=lambda r: r[:3]):
        stack = stacks.setdefault((doc, page), [])
        if kind == "begin":
            stack.append((mc_id, tag))
        elif kind == "end" and stack:
            stack.pop()
        elif kind == "text" and text and all(t != "Artifact" for _, t in stack):
            out.add((doc, page, seq, text, next((i for i, _ in reversed(stack) if i is not None), None)))
    return out


def test_windows_equal_a_stack(spark):
    dice = random.Random(5)
    rows = []
    for doc in range(6):
        for page in range(4):
            for seq in range(dice.choice([0, 3, 80])):
                kind = dice.choice(["text", "begin", "begin", "end", "end", "other", None])
                rows.append((doc, page, seq * 2, kind, dice.choice(["a", "b", "", None]), dice.choice([None, f"m{seq}"]), dice.choice([None, "P", "P", "P", "Artifact"]), 7))
    tagged = tag_texts(spark.createDataFrame(rows, ITEM).repartition(5))
    assert tagged.columns == [c.split()[0] for c in ITEM.split(", ")] + ["mcid"]
    got = tagged.collect()
    assert {(r["doc_id"], r["page"], r["seq"], r["str"], r["mcid"]) for r in got} == by_stack(rows)
    assert {r["level"] for r in got} == {7} and len(got) == len(by_stack(rows))


def test_no_items(spark):
    assert tag_texts(spark.createDataFrame([], ITEM)).collect() == []


def test_pages_without_viewport_keep_their_runs(spark):
    items = spark.createDataFrame([(1, 0, 0, "text", "a", None, None, [1.0, 0.0, 0.0, 1.0, 5.0, 6.0], 4.0, 2.0, "f"), (1, 1, 0, "text", "b", None, None, [1.0, 0.0, 0.0, 1.0, 5.0, 6.0], 4.0, 2.0, "f")], "doc_id long, page int, seq long, type string, str string, mc_id string, mc_tag string, transform array<double>, width double, height double, font_name string")
    styles = spark.createDataFrame([(1, 0, "f", "Courier"), (1, 0, "g", "Sans Bold")], "doc_id long, page int, font_name string, family string")
    viewports = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, -1.0, 0.0, 100.0])], "doc_id long, page int, viewport array<double>")
    got = {r["str"]: r for r in text_runs(items, styles, viewports).collect()}
    assert got["a"]["font_key"] == "Courier|f" and got["a"]["mono"] and got["a"]["x"] == 5.0
    assert got["b"]["font_key"] == "f|f" and got["b"]["x"] is None


def test_marked_items_are_dealt_once(spark):
    items = spark.createDataFrame([], ITEM).repartition(3).withColumn("n", F.lit(1))
    plan = tag_texts(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "mcid" in queries()["j6_marked_content"](spark, SMALL).columns
