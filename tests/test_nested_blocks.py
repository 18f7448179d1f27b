"""Nested markup of small trees, edge cases among them; the driver query holds the rest against SQL."""

from quire.publish.nested_blocks import nested_markup

NODE = "doc_id long, node long, parent long, depth int, ord int, kind string, inline string, ordered boolean, start int"


def markup(spark, rows):
    return {(r["doc_id"], r["node"]): r["markup"] for r in nested_markup(spark.createDataFrame(rows, NODE)).collect()}


def test_order_depth_and_documents(spark):
    rows = [(1, 1, None, 0, 0, "list", None, True, 3), (1, 3, 1, 1, 1, "item", None, None, None), (1, 2, 1, 1, 0, "item", None, None, None), (1, 4, 2, 2, 0, "p", "one", None, None), (1, 5, 3, 2, 0, "p", "two", None, None), (1, 6, 3, 2, 1, "rule", None, None, None), (2, 1, None, 0, 0, "p", "other", None, None)]
    assert markup(spark, rows) == {(1, 1): '<ol start="3">\n  <li>one</li>\n  <li>\n    <p>two</p>\n    <hr/>\n  </li>\n</ol>', (2, 1): "<p>other</p>"}


def test_what_holds_nothing_is_empty(spark):
    kinds = ["quote", "list", "table", "p", "unknown", "figure"]
    assert set(markup(spark, [(1, i, None, 0, i, k, None, None, None) for i, k in enumerate(kinds)]).values()) == {""}
    nested = [(1, 1, None, 0, 0, "quote", None, None, None), (1, 2, 1, 1, 0, "list", None, False, None), (1, 3, 2, 2, 0, "item", None, None, None), (1, 4, 3, 3, 0, "p", " \t", None, None)]
    assert markup(spark, nested) == {(1, 1): ""}


def test_no_nodes(spark):
    assert markup(spark, []) == {}
