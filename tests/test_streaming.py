"""Pages as a stream: documents leave whole, once, with their repeated and late pages as stated."""

import time

from quire.streaming.pages import pages_of, runs_of, whole_documents
from quire.plans.queries import st_blocks
from quire.sources.layout import layout_runs

PAGE = "doc_id long, page int, n_pages int, packed string"


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_documents_leave_whole_and_once(spark, tmp_path):
    pages = stream(spark, tmp_path, [
        [(1, 1, 3, "b"), (2, 0, 1, "x"), (None, 0, 1, "n"), (4, None, 1, "n"), (3, 0, 2, "waits")],
        [(1, 0, 3, "a"), (1, 1, 3, "again"), (5, 0, None, "n")],
        [(1, 2, 3, "c"), (1, 2, 3, "c")],
    ])
    q = whole_documents(pages).writeStream.format("memory").queryName("whole").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("whole").collect())
    assert got == [(1, 0, "a", True, True), (1, 1, "b", True, False), (1, 2, "c", True, False), (2, 0, "x", True, True)]


def test_an_unfinished_document_leaves_as_incomplete(spark, tmp_path):
    pages = stream(spark, tmp_path, [[(3, 1, 4, "late"), (3, 0, 4, "early")]])
    q = whole_documents(pages, "1 second").writeStream.format("memory").queryName("unfinished").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("unfinished").count():
            time.sleep(1)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("unfinished").orderBy("page").collect()] == [(3, 0, "early", False, True), (3, 1, "late", False, False)]


def test_runs_survive_packing(spark):
    docs = spark.createDataFrame([(1, 'A "title"\nwords \\ and <marks> ☃ here'), (2, "")], "doc_id long, text string")
    laid = layout_runs(docs)
    back = runs_of(pages_of(laid), laid.drop("doc_id", "page").schema).select(*laid.columns)
    assert back.schema.simpleString() == laid.schema.simpleString()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, laid.collect()))


def test_a_stream_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert st_blocks(spark, str(tmp_path)).count() == 0


def test_waiting_pages_lie_on_disk(spark, tmp_path, monkeypatch):
    """The store of the query is RocksDB, and the session's settings are as before."""
    import json

    from quire.streaming import pages

    monkeypatch.setattr(pages, "shared_folder", lambda s: f"{tmp_path}/shared")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    laid = spark.createDataFrame([(k, "a few words of a text\n" * 300) for k in range(5)], "doc_id long, text string")
    laid.write.parquet(f"{tmp_path}/in/documents.parquet")
    got = st_blocks(spark, f"{tmp_path}/in")
    assert got.select("doc_id").distinct().count() == 5
    assert spark.conf.get(provider, None) == before
    with open(f"{tmp_path}/shared/state/offsets/0") as f:
        assert json.loads(f.read().split("\n")[1])["conf"][provider].endswith("RocksDBStateStoreProvider")
