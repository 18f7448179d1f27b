"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of hashed word shingles. Equal sets form a class at once and
only one document of each class goes on. Its signature is cut into bands;
documents that share a band's bucket are candidates. In each bucket all
members are first compared with three centres, which joins nearly all groups
with a number of pairs linear in the bucket. Buckets whose members still lie
in different components are then compared in blocks, and only
links that join components come back: no candidate link between components is
lost, none inside one is paid for, and no task holds more than two blocks.

A candidate pair, of either kind, is verified in two steps. Batches of its signatures are
compared one after another, and after each batch the pair is dropped if the
posterior probability that its similarity reaches the threshold is below
`MISS`. Survivors are confirmed on their full shingle sets.

Edge cases: a null or blank text has an empty set and links with nothing; a
text shorter than a shingle is one shingle of all its words; rows that share
an id share its component, whatever their texts link with; a null doc_id links with nothing, keeps a null
component and stays; columns of docs may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Forest, checkpointed, whole_groups
from quire.llm.components import connected_components

#: At similarity 0.8 all bands miss a pair with probability (1 - 0.8**ROWS)**BANDS, about 1e-7.
BANDS, ROWS = 40, 5
#: Signature values compared before each decision, and the accepted probability of dropping a pair that reaches the threshold.
BATCH, MISS = 40, 1e-7
CENTRES, SEED = 3, 11
#: Members of a bucket to a block.
BLOCK = 1024
#: Bits for each document in the filter of those whose sets are needed, and its most bits.
FILTER_BITS, MAX_FILTER_BITS = 8, 1 << 28
#: Word hashes that a task remembers.
REMEMBERED = 500_000

_RANDOM = np.random.default_rng(SEED)
_A = (_RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
_B = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, words split at ASCII white space."""
    known = word_hashes()
    if len(known) > REMEMBERED:
        known.clear()
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(best, ((x[None, i : i + 2048] ^ _B[:, None]) * _A[:, None]).min(1), out=best)
    return best


def short_signature(shingles: np.ndarray) -> np.ndarray:
    """The lowest byte of each value: equal values stay equal, so matches are only overcounted and no pair is dropped for it."""
    return signature(shingles).astype(np.uint8)


def band_keys(sig: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(row, seed=k) - (1 << 63) for k, row in enumerate(sig.reshape(BANDS, ROWS).tobytes()[i : i + 4 * ROWS] for i in range(0, 4 * ROWS * BANDS, 4 * ROWS))]


@lru_cache(maxsize=None)
def least_matches(threshold: float, values: int = BANDS * ROWS) -> np.ndarray:
    """After each batch of n values, the fewest matches m at which P(similarity >= threshold | m of n) is not below MISS (uniform prior)."""

    def reaches(m: int, n: int) -> float:
        return sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return np.array([next(m for m in range(n + 1) if reaches(m, n) >= MISS) for n in range(BATCH, values + 1, BATCH)])


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of two signature matrices that no batch rules out."""
    left, matches = np.arange(len(a)), np.zeros(len(a), int)
    for k, least in enumerate(least_matches(threshold, a.shape[1])):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[left] += (a[left, part] == b[left, part]).sum(1)
        left = left[matches[left] >= least]
    return left


def _fingerprints(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, keys = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "keys"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, print binary, keys array<long>")


def _id_filter(ids: DataFrame) -> tuple[bytearray, int]:
    """A bitmap of hashed ids, of bounded size: which documents are certainly not among ids. Too full, it only stops to save work."""
    bits = 1 << 16
    while bits < min(ids.count() * FILTER_BITS, MAX_FILTER_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    # the bitmap functions count from 1, and a bucket has 32,768 bits
    parts = ids.select((F.bitmap_bucket_number(at + 1) - 1).alias("part"), F.bitmap_bit_position(at + 1).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    out = bytearray(bits // 8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = r["bitmap"]
    return out, bits


def _sets(rows: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """Signature and shingle set of the needed documents and a few others; the texts are not shuffled."""
    bitmap, bits = _id_filter(needed)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array(held[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([short_signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "sig", "shingles"])

    kept = rows.filter(F.col("doc_id").isNotNull()).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at"), "text")
    return kept.mapInArrow(run, "id long, sig binary, shingles binary")


def _joining(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components inside a bucket. mixed: key, doc_id, component, outside (of the bucket's main component), n (its members)."""

    def judge(part: pd.DataFrame) -> list[tuple[int, int]]:
        if not part.outside.any():
            return []
        sets = [np.frombuffer(s, np.uint64) for s in part.shingles]
        sigs = np.stack([short_signature(s) for s in sets])
        ids, comp, block, size = part.doc_id.to_numpy(), part.component.to_numpy(), part.block.to_numpy(), np.array([len(s) for s in sets])
        crossed, forest, links = bool((part.i != part.j).iloc[0]), Forest(), []
        for i in np.flatnonzero(part.outside.to_numpy()).tolist():
            other = (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if crossed:
                other &= block != block[i]
            near = np.flatnonzero(other)
            near = near[survivors(np.broadcast_to(sigs[i], (len(near), sigs.shape[1])), sigs[near], percent / 100)]
            for j in near.tolist():
                if forest.root(int(comp[i])) == forest.root(int(comp[j])):
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (size[i] + size[j] - common):
                    forest.join(int(comp[i]), int(comp[j]))
                    links.append((int(ids[i]), int(ids[j])))
        return links

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = ["key", "i", "j"]
        for part in whole_groups(batches, key):
            found = [link for _, group in part.groupby(key, sort=False) for link in judge(group)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", "doc_id", "component", "outside", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.join(sets.select(F.col("id").alias("doc_id"), "shingles"), "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * |a and b| >= percent * |a or b|."""

    def both(pairs: DataFrame, what: str) -> DataFrame:
        a, b = (sets.select(F.col("id").alias(f"{x}_id"), F.col(what).alias(f"{x}_{what}")) for x in "ab")
        return pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id")).select("a", "b", f"a_{what}", f"b_{what}")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[f"{x}_sig"]), np.uint8).reshape(len(batch), -1) for x in "ab")
                yield batch.iloc[survivors(a, b, percent / 100)][["a", "b"]]

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.a_shingles, batch.b_shingles, strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch[keep][["a", "b"]]

    kept = both(pairs, "sig").mapInPandas(prune, "a long, b long")
    return both(kept, "shingles").mapInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    prints = checkpointed(_fingerprints(rows, shingle_words))
    # one class per set of shingles; its copies need no comparison
    classes = prints.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("rep"))
    labelled = checkpointed(prints.join(classes, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"), F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")))

    # an id with several texts holds their classes together
    spread = labelled.filter(F.col("rep").isNotNull()).groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    held_together = labelled.select("doc_id", "rep").join(spread.select("doc_id", "least"), "doc_id").filter(F.col("rep") > F.col("least")).select(F.col("rep").alias("a"), F.col("least").alias("b"))

    bands = labelled.filter(F.col("keys").isNotNull()).select("doc_id", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    members = checkpointed(bands.join(shared, "key"))
    names = [f"c{k}" for k in range(CENTRES)]
    centres = [F.min_by("doc_id", F.xxhash64(F.lit(k), "doc_id")) if k else F.min("doc_id") for k in range(CENTRES)]
    buckets = members.groupBy("key", "n").agg(*[c.alias(name) for c, name in zip(centres, names, strict=True)]).select("key", F.array_distinct(F.array(*names)).alias("centres"))
    starred = members.join(buckets, "key").select(F.col("doc_id").alias("x"), F.explode("centres").alias("y")).filter(F.col("x") != F.col("y"))
    pairs = starred.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    sets = checkpointed(_sets(rows, members.select("doc_id").distinct(), shingle_words))
    links = checkpointed(_verified(pairs, sets, percent).unionAll(held_together).coalesce(sets.rdd.getNumPartitions()))

    joined = connected_components(links)
    # a bucket with at most one member besides its centres has been compared whole
    large = members.join(buckets.select("key", F.size("centres").alias("centres")), "key").filter(F.col("n") - F.col("centres") > 1)
    placed = large.select("key", "n", "doc_id").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # the component that most members of a bucket lie in; only pairs with a member outside it can be new
    held = placed.groupBy("key", "component").agg(F.count("*").alias("held"))
    main = held.groupBy("key").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.count("*").alias("parts")).filter(F.col("parts") > 1)
    mixed = placed.join(main.select("key", "main"), "key").select("key", "doc_id", "component", (F.col("component") != F.col("main")).alias("outside"), "n")
    links = links.unionAll(_joining(mixed, sets, percent))

    final = connected_components(links).withColumnRenamed("id", "rep")
    component = F.coalesce("component", "rep", "doc_id")
    out = labelled.select("doc_id", "n_shingles", "rep").join(final, "rep", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
