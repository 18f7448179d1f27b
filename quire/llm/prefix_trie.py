"""The trie of shared conversation prefixes, by partition refinement.

Conversations are rebuilt (`rebuilt_turns`), and equal ones stand for each
other from then on (`representatives`), with the number of their copies. At
first all form one class. A round splits every active class by its members'
next turn; the classes that come out are the nodes of the next depth. A class
of one representative is retired: the rest of it is a unary chain, whose
numbers follow from what is left of the conversation. A class whose turns fit
a task is refined to its end there, many such classes to a task; only larger
ones go through another round. Then the larger classes are folded back from
the deepest round to the root, each adding up its children.

A turn is known by the SHA-256 of its role and text, a class by its smallest
member, a node by that and its depth. Turns are numbered by sorted ranges, so
neither one conversation with many turns nor one with many copies has to fit a
task; all groups are summed before they are shuffled. A digest of members
reads their ids as a stream of sorted blocks.

Edge cases: rows without conv_id belong to no conversation and are left out; a
null role or text is empty; turns of equal number are ordered by role, then by
the turn's SHA-256, and repeated rows are turns of their own; conversations
without turns end at the root; texts of any length count whole; columns of the
table may have any names; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, checkpointed, id_bucket, lookup, whole_groups

#: Turns of a class that one task may refine, members from which a class is joined by broadcast, ids to a block of a digest.
LOCAL_TURNS, LARGE_CLASS, ID_BLOCK = 2_000, 1_000, 4_096
#: Conversations to a block that shares the first one's beginning, and one more than the most turns shared.
BLOCK_SIZE, SHARED = 20, 4
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ender long, ender_copies long"


def numbered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, part, k, before, digest, words): k is a turn's place among those of its conversation in its part, before their words so far."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    # the number tells equal rows apart, which may be dealt anyhow
    turns = named.select("conv", "turn", "role", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k, before = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            conv, words = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if not len(conv):
                continue
            if conv[0] != last:
                last, k, before = conv[0], 0, 0
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            lengths = np.diff(np.append(starts, len(conv)))
            summed = np.cumsum(words) - words
            place, upto = np.arange(len(conv)) - np.repeat(starts, lengths), summed - np.repeat(summed[starts], lengths)
            place[: lengths[0]] += k
            upto[: lengths[0]] += before
            last, k, before = conv[-1], int(place[-1]) + 1, int(upto[-1] + words[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(place), pa.array(upto), batch.column(1), batch.column(2)], ["conv", "part", "k", "before", "digest", "words"])

    return checkpointed(dealt.mapInArrow(number, "conv long, part int, k long, before long, digest binary, words long"))


def rebuilt_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every conversation, its first h turns taken from the first one of its block: (conv, size) and (conv, pos, digest, words, left, words_left), what is left including the turn."""
    numbered = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    parts = numbered.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    order = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = checkpointed(parts.select("conv", "part", "n", "w", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"), F.coalesce(F.sum("w").over(order), F.lit(0)).alias("words_first")))
    # of each conversation the few turns that others may begin with
    near = numbered.join(placed.filter(F.col("first") < SHARED - 1), ["conv", "part"]).withColumn("pos", F.col("first") + F.col("k")).filter(F.col("pos") < SHARED - 1)
    heads = near.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("heads"))
    sizes = placed.groupBy("conv").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    every = sizes.join(heads, "conv").select("conv", "n", "w", "heads", id_bucket("conv", SHARED).alias("h"))
    first = every.select(F.col("conv").alias("base"), F.col("heads").alias("base_heads"))
    both = every.withColumn("base", F.col("conv") - F.col("conv") % BLOCK_SIZE).join(first, "base", "left")
    taken = F.slice(F.coalesce("base_heads", F.array().cast(first.schema["base_heads"].dataType)), 1, F.col("h").cast("int"))
    own_words = F.col("w") - F.aggregate(F.filter("heads", lambda t: t["pos"] < F.col("h")), F.lit(0).cast("long"), lambda s, t: s + t["words"])
    facts = checkpointed(both.select("conv", "h", taken.alias("taken"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"), "w", own_words.alias("own_words")).withColumn("size", F.size("taken") + F.col("own")))
    shared = facts.select("conv", "size", "own_words", "taken", F.posexplode("taken").alias("pos", "t"))
    rest = F.aggregate(F.slice("taken", F.col("pos") + 1, F.size("taken")), F.col("own_words"), lambda s, t: s + t["words"])
    begun = shared.select("conv", F.col("pos").cast("long").alias("pos"), "t.digest", "t.words", (F.col("size") - F.col("pos")).alias("left"), rest.alias("words_left"))
    whole = placed.join(facts.select("conv", "h", "size", "w", F.size("taken").alias("n_taken")).withColumnRenamed("w", "all_words"), "conv")
    own = numbered.join(whole.drop("n", "w"), ["conv", "part"]).withColumn("own_pos", F.col("first") + F.col("k")).filter(F.col("own_pos") >= F.col("h"))
    pos = F.col("own_pos") - F.col("h") + F.col("n_taken")
    went_on = own.select("conv", pos.alias("pos"), "digest", "words", (F.col("size") - pos).alias("left"), (F.col("all_words") - F.col("words_first") - F.col("before")).alias("words_left"))
    return facts.select("conv", F.col("size").cast("long").alias("size")), checkpointed(begun.unionByName(went_on))


def representatives(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, rep, copies): equal conversations, by size and three hashes over all turns, and their smallest id."""
    hashes = [F.bit_xor(F.xxhash64(F.lit(k), "pos", "digest")).alias(f"x{k}") for k in range(3)]
    key = ["size", "x0", "x1", "x2"]
    known = turns.groupBy("conv").agg(*hashes)
    keyed = checkpointed(convs.join(known, "conv", "left").select("conv", "size", *[F.coalesce(c, F.lit(0)).alias(c) for c in key[1:]]))
    groups = checkpointed(keyed.groupBy(*key).agg(F.min("conv").alias("rep"), F.count("*").alias("copies")))
    return checkpointed(lookup(keyed, groups, key, F.col("copies") > LARGE_CLASS).select("conv", "rep", "copies"))


def member_digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) from (rep, conv): the SHA-256 of each group's ids in ascending order, comma-joined. Ids are joined to blocks wherever they lie, and a group's blocks are read as a stream."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]])) if len(rep) else []
            spans = [(s, min(s + ID_BLOCK, e)) for a, e in zip(cuts, [*cuts[1:], len(rep)], strict=True) for s in range(a, e, ID_BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([rep[s] for s, _ in spans], pa.int64()), pa.array([conv[s] for s, _ in spans], pa.int64()), pa.array([",".join(map(str, conv[s:e].tolist())) for s, e in spans], pa.string())], ["rep", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held.hexdigest()], pa.string())], ["rep", "ends_sha256"])

        for batch in batches:
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if rep != last:
                    if last is not None:
                        yield row()
                    last, held = rep, hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
        if last is not None:
            yield row()

    dealt = members.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(blocks, "rep long, first long, ids string")
    return dealt.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digested, "rep long, ends_sha256 string")


def refine(turns: pd.DataFrame, depth: int) -> list[tuple]:
    """Nodes (as NODE) below the parents of some classes, to their ends. turns: parent, conv, copies, pos from depth on, digest, words, left, words_left."""
    rows = turns.sort_values(["conv", "pos"])
    rest: dict[int, list[tuple]] = defaultdict(list)
    copies: dict[int, int] = {}
    active: dict[int, list[int]] = defaultdict(list)
    for parent, conv, n, *turn in zip(*(rows[c].tolist() for c in ("parent", "conv", "copies", "digest", "words", "left", "words_left")), strict=True):
        if conv not in copies:
            copies[conv] = n
            active[parent].append(conv)
        rest[conv].append(tuple(turn))
    nodes, forks, at = [], {}, depth
    while active:
        split: dict[int, list[int]] = {}
        for parent, members in active.items():
            by_turn: dict[bytes, list[int]] = defaultdict(list)
            for c in members:
                if at - depth < len(rest[c]):
                    by_turn[rest[c][at - depth][0]].append(c)
            for group in by_turn.values():
                least = min(group)
                if len(group) == 1:
                    # retired: what is left is a chain
                    for i, (_, _, left, words_left) in enumerate(rest[least][at - depth :]):
                        ends = (least, copies[least]) if left == 1 else (None, None)
                        nodes.append([least, at + i + 1, least if i else parent, copies[least], int(left > 1), 1, (copies[least] - 1) * words_left, *ends])
                else:
                    n = sum(copies[c] for c in group)
                    ender = next((c for c in group if rest[c][at - depth][2] == 1), None)
                    forks[least, at + 1] = node = [least, at + 1, parent, n, 0, 0, (n - 1) * rest[least][at - depth][1], ender, copies.get(ender)]
                    nodes.append(node)
                    split[least] = group
        active, at = split, at + 1
    # fold back: children come before their parents
    for node in sorted(nodes, key=lambda n: -n[1]):
        up = forks.get((node[2], node[1] - 1))
        node[5] = max(node[5], 1)
        if up is not None:
            up[4], up[5], up[6] = up[4] + 1, up[5] + node[5], up[6] + node[6]
    return nodes


def refined_locally(turns: DataFrame, depth: int) -> DataFrame:
    """`refine` for classes that fit a task each, many to a task. turns: as there, and cls, the class of each."""
    names = ["cls", "parent", "conv", "copies", "pos", "digest", "words", "left", "words_left"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, ["cls"]):
            yield pd.DataFrame(refine(whole, depth), columns=[f.split()[0] for f in NODE.split(", ")]).astype({"ender": "Int64", "ender_copies": "Int64"})

    return turns.select(*names).repartition("cls").sortWithinPartitions("cls").mapInPandas(run, NODE)


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", local_turns: int = LOCAL_TURNS,
) -> DataFrame:
    """One row per node: its smallest member, depth, its parent's, members, children, leaves below, words saved below, and the digest of the members that end in it."""
    convs, turns = rebuilt_turns(conversations, conv_col, turn_col, role_col, text_col)
    same = representatives(convs, turns)
    total = same.agg(F.count("*").alias("n"), F.min("conv").alias("least")).first()
    reps = same.filter(F.col("conv") == F.col("rep")).select("conv", "copies")
    active = checkpointed(turns.join(reps, "conv").withColumn("cls", F.lit(total.least).cast("long")))
    empty = convs.filter("size = 0").join(reps, "conv").select(F.struct("conv", "copies").alias("ends")).first()
    root = conversations.sparkSession.createDataFrame([(total.least, None, total.n, 0, *(empty.ends if empty else (None, None)))] if total.n else [], "cls long, parent long, n_convs long, words long, ender long, ender_copies long")
    levels, finished = [root], []
    while True:
        depth = len(levels) - 1
        heads = active.filter(F.col("pos") == depth)
        ends = F.max(F.when(F.col("left") == 1, F.struct("conv", "copies")))
        classes = checkpointed(
            heads.groupBy("cls", "digest").agg(F.min("conv").alias("fresh"), F.sum("copies").alias("n_convs"), F.count("*").alias("n_reps"), F.sum("left").alias("turns_left"), F.max("words").alias("words"), ends.alias("ends"))
        ).withColumn("fate", F.when(F.col("n_reps") == 1, "retire").when(F.col("turns_left") <= local_turns, "local").otherwise("split"))
        fates = {r.fate for r in classes.select("fate").distinct().collect()}
        if not fates:
            break
        moved = lookup(heads.select("cls", "digest", "conv"), classes.select("cls", "digest", "fresh", "n_reps", "fate"), ["cls", "digest"], F.col("n_reps") > LARGE_CLASS)
        moved = moved.select("conv", "fresh", "fate")
        active = checkpointed(active.withColumnRenamed("cls", "parent").join(moved, "conv").withColumnRenamed("fresh", "cls"))
        done = []
        if "retire" in fates:
            top, last = F.col("pos") == depth, F.col("left") == 1
            done.append(active.filter("fate = 'retire'").select(
                F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("copies").alias("n_convs"),
                (F.col("left") > 1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * F.col("words_left")).alias("saved_tokens"), F.when(last, F.col("conv")).alias("ender"), F.when(last, F.col("copies")).alias("ender_copies"),
            ))
        if "local" in fates:
            done.append(checkpointed(refined_locally(active.filter("fate = 'local'"), depth)))
        finished.append(done)
        if "split" not in fates:
            break
        levels.append(classes.filter("fate = 'split'").select(F.col("fresh").alias("cls"), F.col("cls").alias("parent"), "n_convs", "words", F.col("ends.conv").alias("ender"), F.col("ends.copies").alias("ender_copies")))
        active = active.filter((F.col("fate") == "split") & (F.col("pos") > depth)).select("conv", "pos", "digest", "words", "left", "words_left", "copies", "cls")
    # fold back: each level's children are what was finished in its round and the level below
    nodes, below = [n for done in finished for n in done], None
    for depth in range(len(levels) - 1, -1, -1):
        tops = [n.filter(F.col("depth") == depth + 1) for n in (finished[depth] if depth < len(finished) else [])] + ([below] if below is not None else [])
        level = levels[depth]
        if tops:
            kids = None
            for t in tops:
                part = t.select("parent_conv_id", "n_leaves", "saved_tokens")
                kids = part if kids is None else kids.unionByName(part)
            summed = kids.groupBy(F.col("parent_conv_id").alias("cls")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            level = level.join(summed, "cls", "left")
        else:
            level = level.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "n_leaves", "saved")})
        below = checkpointed(level.select(
            F.col("cls").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "ender", "ender_copies",
        ))
        nodes.append(below)
    every = nodes[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    # of most nodes no or one conversation is the end; only groups of copies need a digest of their own
    digests = member_digests(same.filter("copies > 1"))
    alone = every.filter(F.coalesce("ender_copies", F.lit(0)) <= 1).withColumn("ends_sha256", F.sha2(F.coalesce(F.col("ender").cast("string"), F.lit("")).cast("binary"), 256))
    groups = every.filter("ender_copies > 1").join(digests, F.col("ender") == F.col("rep"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return alone.select(result).unionByName(groups.select(result))
