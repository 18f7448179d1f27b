"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets.

A hash rotates a unit vector by fast Hadamard transforms with random signs and
takes the nearest vertex of the cross-polytope, the coordinate of largest
size with its sign. One to three such hashes, the more the larger the labels are, make
a bucket of a table, so that buckets do not grow with the data. Every vector is
filed under its most likely combinations of vertices, so two vectors meet
where their probes do. In each bucket all cosines are taken in blocks, and a
pair is counted only in the first bucket (in the order of the tables' probes)
that both vectors lie in. Buckets give counts and the links of a spanning
forest, never a row per pair. Buckets above `BLOCK` members are cut into
blocks, and every two blocks of a bucket are compared in a task of their own.

Equal vectors of a label form a class first; its copies are counted, not compared.

Edge cases: a vector that is null, empty or zero, or holds null or non-finite
components, and one without a label, links with nothing; vectors of different
length never link; rows that repeat a vec_id count as vectors of their own in
n_links and share a component; a null vec_id is counted by others but has a null component and
stays; columns of the table may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS, Forest, checkpointed, lookup, small, whole_groups
from quire.llm.components import connected_components

#: By hashes to a bucket: vertices of one hash considered for the probes, probes to a vector and table, and tables. Each misses a pair of 64 components at cosine 0.93 with probability below 1e-6.
VERTICES, PROBES, TABLES = {1: 5, 2: 4, 3: 4}, {1: 4, 2: 8, 3: 24}, {1: 3, 2: 5, 3: 5}
#: Members of a bucket up to which its hashes are not refined, members compared in one block, and copies of a vector from which they are joined apart.
FILLED, BLOCK, LARGE = 4096, 4096, 1000
SEED = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), 2)
        h *= 2
        x = x.reshape(len(x), n)
    return x


def padded_length(length: int) -> int:
    return max(4, 1 << (length - 1).bit_length())


def hashes_for(members: int, length: int) -> int:
    """Hashes to a bucket for a label with so many vectors."""
    return next((k for k in (1, 2) if members * PROBES[k] <= FILLED * (2 * padded_length(length)) ** k), 3)


def bucket_codes(x: np.ndarray, hashes: int, tables: int | None = None) -> np.ndarray:
    """For unit rows: the codes of each row's probes, so many for each table, distinct within a row."""
    size, tables, probes = padded_length(x.shape[1]), tables or TABLES[hashes], PROBES[hashes]
    padded = np.zeros((len(x), size), np.float32)
    padded[:, : x.shape[1]] = x
    rnd, out = np.random.default_rng(SEED), []
    combos = sorted(product(range(min(VERTICES[hashes], size)), repeat=hashes), key=sum)
    for t in range(tables):
        vertices, loss = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rnd.choice(np.array([-1, 1], np.float32), size)) / np.float32(np.sqrt(size))
            top = np.argsort(-np.abs(y), 1)[:, : VERTICES[hashes]]
            value = np.take_along_axis(y, top, 1)
            vertices.append(top * 2 + (value > 0))
            # leaving the nearest vertex costs the more, the farther its coordinate is ahead
            loss.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        cost = np.stack([sum(loss[i][:, c[i]] for i in range(hashes)) for c in combos], 1)
        best = np.argsort(cost, 1, kind="stable")[:, :probes]
        code = np.stack([sum((vertices[i][:, c[i]].astype(np.int64)) * (2 * size) ** i for i in range(hashes)) for c in combos], 1)
        out.append((np.take_along_axis(code, best, 1) * tables + t) % (2**31 - 1))
    return np.stack(out, 1).reshape(len(x), -1) if len(x) else np.zeros((0, tables * probes), np.int64)


def usable(vectors: list, kind: type) -> list[np.ndarray | None]:
    """The vectors as arrays, None for those that link with nothing."""
    out = []
    for v in vectors:
        a = None if v is None or any(e is None for e in v) else np.array(v, kind)
        out.append(a if a is not None and len(a) and np.isfinite(a).all() and np.any(a) else None)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps the squares of very large and very small components
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(rows: DataFrame, kind: type) -> DataFrame:
    """vec_id, label and the vector's bytes and their digest, null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = usable(batch.column("embedding").to_pylist(), kind)
            vec = [None if v is None or lab is None else (v + kind(0)).tobytes() for v, lab in zip(found, batch.column("label").to_pylist(), strict=True)]
            prints = [None if v is None else xxhash.xxh3_128_digest(v) for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vec, pa.binary()), pa.array(prints, pa.binary())], names=["vec_id", "label", "vec", "print"])

    return rows.mapInArrow(run, "vec_id long, label long, vec binary, print binary")


def _hashed(classes: DataFrame, kind: type, hashes: int) -> DataFrame:
    columns = ["class_id", "label", "print", "least", "length", "n", "vec", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == length))
                x = unit_rows(np.frombuffer(b"".join(part.column("vec").to_pylist()), kind).reshape(part.num_rows, -1))
                codes = bucket_codes(x, hashes).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns[:-1]), listed], names=columns)

    return classes.mapInArrow(run, "class_id long, label long, print binary, least long, length int, n long, vec binary, codes array<int>")


def first_table(a: np.ndarray, b: np.ndarray, probes: int) -> np.ndarray:
    """For rows of codes that share one: the first table in which they do, and there the smallest shared code, as one number each."""
    none = np.iinfo(np.int32).max
    out = np.full(len(a), none, np.int32)
    for t in range(a.shape[1] // probes):
        part = slice(t * probes, (t + 1) * probes)
        left = np.flatnonzero(out == none)
        if not len(left):
            break
        x, y = a[left, part], b[left, part]
        out[left] = np.where((x[:, :, None] == y[:, None, :]).any(2), x, none).min(1)
    return out


def linked_pairs(x: np.ndarray, codes: np.ndarray, code: np.ndarray, group: np.ndarray, block: np.ndarray, crossed: np.ndarray, threshold: float, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group that link and are counted in this bucket; if `crossed`, only those between the two blocks."""

    def keep(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
        p, q = p[ok], q[ok]
        ok = first_table(codes[p], codes[q], probes) == code[p]
        return p[ok], q[ok]

    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    few = np.repeat(sizes <= 32, sizes)
    for d in range(1, int(sizes[sizes <= 32].max(initial=1))):
        p = np.flatnonzero(few[:-d] & (group[d:] == group[:-d]) & (~crossed[:-d] | (block[d:] != block[:-d])))
        for k in range(0, len(p), 100_000):
            yield keep(p[k : k + 100_000], p[k : k + 100_000] + d)
    for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        y = x[start : start + size]
        for s in range(0, size, 128):
            # the product only finds candidates; one order of summation decides
            p, q = np.nonzero(y[s : s + 128] @ y.T >= threshold - 1e-9)
            p, q = p + start + s, q + start
            ok = (p < q) & (~crossed[p] | (block[p] != block[q]))
            yield keep(p[ok], q[ok])


def _met(dealt: DataFrame, kind: type, threshold: float, probes: int) -> DataFrame:
    """Rows (id, links, other): additions to a class's number of linked vectors, and links that join it to others.

    The rows of a group lie together.
    """

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        group = part.groupby(["label", "length", "code", "i", "j"], sort=False).ngroup().to_numpy()
        ids, n, counts, forest = part.class_id.to_numpy(), part.n.to_numpy(), np.zeros(len(part), np.int64), Forest()
        for length, rows in pd.Series(np.arange(len(part))).groupby(part.length.to_numpy()):
            r, sub = rows.to_numpy(), part.iloc[rows.to_numpy()]
            x = unit_rows(np.frombuffer(b"".join(sub.vec), kind).reshape(len(sub), -1))
            for p, q in linked_pairs(x, np.stack(sub.codes), sub.code.to_numpy(), group[r], sub.block.to_numpy(), (sub.i != sub.j).to_numpy(), threshold, probes):
                p, q = r[p], r[q]
                np.add.at(counts, p, n[q])
                np.add.at(counts, q, n[p])
                for u, v in zip(ids[p].tolist(), ids[q].tolist(), strict=True):
                    forest.join(u, v)
        counted = pd.DataFrame({"id": ids, "links": counts, "other": -1})[counts > 0]
        return pd.concat([counted, pd.DataFrame(forest.links(), columns=["id", "other"]).assign(links=0)])[["id", "links", "other"]].astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ["label", "length", "code", "i", "j"]):
            yield judge(part)

    return dealt.mapInPandas(run, "id long, links long, other long")


def link_embeddings(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    given = checkpointed(_vectors(rows, kind))
    grouped = given.filter(F.col("vec").isNotNull()).groupBy("label", "print").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    numbered = grouped.select(F.monotonically_increasing_id().alias("class_id"), "label", "print", "least", F.octet_length("vec").alias("length"), "n", "vec")
    # an upper bound of the classes of a label and length
    most = given.filter(F.col("vec").isNotNull()).groupBy("label", F.octet_length("vec").alias("length")).count().orderBy(F.desc("count")).first()
    hashes = hashes_for(most["count"], most["length"] // np.dtype(kind).itemsize) if most else 1
    hashed = checkpointed(_hashed(numbered, kind, hashes))
    classes = hashed.select("class_id", "label", "print", "least", "n")
    bucket = ["label", "length", "code"]
    sizes = hashed.select("label", "length", F.explode("codes").alias("code")).groupBy(bucket).agg(F.count("*").alias("held")).filter(F.col("held") > 1).withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int"))
    sizes = checkpointed(sizes.select(*bucket, "blocks"))
    n_buckets = sizes.count()
    # few buckets are broadcast, and the vectors move once; else ids find their buckets first
    carried = ["n", "vec", "codes"] if n_buckets <= BROADCAST_ROWS else []
    filed = hashed.select("class_id", "label", "length", *carried, F.explode("codes").alias("code")).join(small(sizes, n_buckets), bucket)
    # block i meets block j in group (i, j), i <= j: each of its rows goes there as the one side or the other
    dealt = (
        filed.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("class_id", *bucket, *carried, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    if not carried:
        dealt = dealt.join(hashed.select("class_id", "n", "vec", "codes"), "class_id")
    found = checkpointed(_met(dealt.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j"), kind, threshold, PROBES[hashes]))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    # rows of one id hold their classes together
    spread = given.filter(F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("vec_id")
    same_id = given.join(spread, "vec_id").join(classes.select("label", "print", "class_id"), ["label", "print"]).select("vec_id", "class_id")
    held_together = same_id.join(same_id.groupBy("vec_id").agg(F.min("class_id").alias("b")), "vec_id").select(F.col("class_id").alias("a"), "b").filter("a > b")
    joined = connected_components(found.filter(F.col("other") >= 0).select(F.col("id").alias("a"), F.col("other").alias("b")).unionAll(held_together))
    placed = classes.join(counts, F.col("class_id") == F.col("id"), "left").drop("id").join(joined, F.col("class_id") == F.col("id"), "left").select("label", "print", "least", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = checkpointed(placed.join(least, "component").select(F.struct("label", "print").alias("class"), "n", "n_links", "component_id"))
    real = lookup(given.filter(F.col("vec").isNotNull()).select("vec_id", F.struct("label", "print").alias("class")), placed, "class", F.col("n") >= LARGE).select("vec_id", "n_links", "component_id")
    rest = given.filter(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return real.unionByName(rest).select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
