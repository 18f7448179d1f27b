"""Documents from a stream of pages.

Headings need the sizes of a whole document, so a document waits in the state store until its last page has come; then its runs go
through the same plans as in batch. The state is keyed by document: it holds the pages so far, packed by Spark, and is dropped when the
document leaves. A page that comes again while its document waits is kept once. Given `patience`, a document that does not grow for that long
leaves with the pages it has, as incomplete; a page that comes after its document has left waits as a document of its own. Waiting for a time
needs a trigger that goes on: a run over what is there would never end, so without patience documents wait in the state for the next run.
Rows without a document, a page or a number of pages are left out; numbers of pages that differ count by the largest.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StructField, StructType

from quire.plans.extract import extract

PAGE_KEYS = ["doc_id", "page"]
STATE = "pages array<int>, packed array<string>, n_pages int"
#: Waiting pages are kept in RocksDB, on the executors' disks, with changes alone in the checkpoint: the default store holds them all in memory.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
RELEASED = "doc_id long, page int, packed string, complete boolean, first boolean"


def pages_of(runs: DataFrame) -> DataFrame:
    """One row per page: doc_id, page, n_pages of its document, and its runs packed as text."""
    fields = [c for c in runs.columns if c not in PAGE_KEYS]
    # a list for each column: names and brackets of every run would be most of the text
    held = F.collect_list(F.struct(*fields))
    each = runs.groupBy(*PAGE_KEYS).agg(F.to_json(F.struct(*[held[c].alias(c) for c in fields])).alias("packed"))
    total = runs.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    return each.join(total, "doc_id").select(*PAGE_KEYS, "n_pages", "packed")


def runs_of(released: DataFrame, run_fields: StructType) -> DataFrame:
    """The runs of released pages. run_fields: their columns but for document and page."""
    packed = StructType([StructField(f.name, ArrayType(f.dataType)) for f in run_fields])
    columns = released.select(*PAGE_KEYS, F.from_json("packed", packed).alias("p"))
    each = F.arrays_zip(*[F.col("p")[f.name] for f in run_fields]).cast(f"array<{run_fields.simpleString()}>")
    return columns.select(*PAGE_KEYS, F.explode(each).alias("r")).select(*PAGE_KEYS, "r.*")


def whole_documents(pages: DataFrame, patience: str | None = None) -> DataFrame:
    """The stream of pages (doc_id, page, n_pages, packed), each released with the last of its document: doc_id, page, packed, complete, and `first` on one row of each document.

    The observation `documents` counts documents, pages and incomplete documents of each batch for listeners.
    """
    wait = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)

    def gather(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, packed, n = state.get if state.exists else ([], [], 0)
        held = dict(zip(seen, packed, strict=True))
        if not state.hasTimedOut:
            for part in parts:
                for page, total, data in zip(part["page"], part["n_pages"], part["packed"], strict=True):
                    held.setdefault(int(page), data)
                    n = max(n, int(total))
            if len(held) < n:
                state.update((list(held), list(held.values()), n))
                if wait is not None:
                    state.setTimeoutDuration(wait)
                return
        if state.exists:
            state.remove()
        order = sorted(held)
        yield pd.DataFrame({"doc_id": key[0], "page": order, "packed": [held[p] for p in order], "complete": len(held) >= n, "first": [p == order[0] for p in order]})

    known = pages.filter("doc_id IS NOT NULL AND page IS NOT NULL AND n_pages IS NOT NULL")
    released = known.groupBy("doc_id").applyInPandasWithState(gather, RELEASED, STATE, "append", GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout)
    return released.observe("documents", F.count_if("first").alias("documents"), F.count("*").alias("pages"), F.count_if(~F.col("complete") & F.col("first")).alias("incomplete"))


def extract_stream(pages: DataFrame, run_fields: StructType, out: str, checkpoint: str, patience: str | None = None, **trigger) -> StreamingQuery:
    """Starts the query that writes each batch's documents as `blocks` and `toc` under `out`. A batch that is repeated overwrites what it wrote, so each document is written once. trigger: as of `DataStreamWriter.trigger`; by default what is there now."""
    if patience is not None and not trigger.get("processingTime"):
        raise ValueError("patience needs a processing time trigger")

    # the tables are there even if no document ever comes
    none = extract(runs_of(pages.sparkSession.createDataFrame([], RELEASED), run_fields))
    for name, rows in (("blocks", none.blocks), ("toc", none.toc)):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            if kept.isEmpty():
                return
            found = extract(runs_of(kept, run_fields))
            for name, rows in (("blocks", found.blocks), ("toc", found.toc)):
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            kept.unpersist()

    conf = pages.sparkSession.conf
    before = {k: conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        conf.set(k, v)
    try:
        # a query goes on with the settings it was started with
        return whole_documents(pages, patience).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all machines see; a folder of our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return tempfile.mkdtemp(prefix="quire-stream-") if base is None else f"{base}/stream-{os.urandom(8).hex()}"
