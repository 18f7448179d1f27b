"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: maximal runs of characters other than space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest side, in rows, that an operator may mark for broadcast.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared checkpoint folder.

    `spark.checkpoint.dir` decides; where it is unset, a folder of our own is
    used in local mode and a cluster is refused, as its machines would not see it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark df for broadcast if its counted rows are within the bound; else leave it to the optimizer."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lookup(rows: DataFrame, unique: DataFrame, key: str, large: Column) -> DataFrame:
    """The inner join of rows with unique (one row per key). Keys with many rows, marked `large` in unique, are joined apart, by broadcast if there are few of them."""
    hot = unique.filter(large)
    n = hot.count()
    if not n:
        return rows.join(unique, key)
    rest = rows.join(small(hot.select(key), n), key, "left_anti").join(unique.filter(~large), key)
    # both parts in as many partitions as before: small files add up
    return rows.join(small(hot, n), key).unionByName(rest).coalesce(rows.rdd.getNumPartitions())


def id_bucket(col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo `mod`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup a partition sorted by `key` so that no group is cut: a batch's last group is held until the next shows that it has ended."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch[key] == batch[key].iloc[-1]).all(axis=1).to_numpy()
        start = 0 if last.all() else len(last) - int(last[::-1].argmin())
        if start or (held and (held[-1][key].iloc[-1] != batch[key].iloc[0]).any()):
            held.append(batch.iloc[:start])
            yield pd.concat(held)
            held = []
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held)


class Forest:
    """Union-find over the ids of one batch."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, v: int) -> int:
        parent = self.parent
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    def join(self, u: int, v: int) -> bool:
        """Whether u and v were apart."""
        u, v = self.root(u), self.root(v)
        self.parent[max(u, v)] = min(u, v)
        return u != v

    def links(self) -> list[tuple[int, int]]:
        return [(v, r) for v in self.parent if (r := self.root(v)) != v]
