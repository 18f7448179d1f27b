"""The prefix trie against a plain one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quire.llm import prefix_trie as trie

FIELDS = "conv_id long, turn long, role string, text string, depth string, cls double, parent int, digest string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    ends = {p: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), key=str)


def run(spark, rows, parts=3, **options):
    frame = spark.createDataFrame([(*r, "x", 1.5, 3, "y") for r in rows], FIELDS).repartition(parts)
    return sorted(map(tuple, trie.prefix_trie(frame, **options).collect()), key=str)


def random_rows(seed, n=70):
    """Conversations that share beginnings of any length, copies among them."""
    r, made = random.Random(seed), []
    for c in r.sample(range(-60, 400), n):
        old = list(r.choice(made)) if made and r.random() < 0.7 else []
        turns = old[: r.randrange(len(old) + 1)] + [(r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, " x\ty "])) for _ in range(r.randrange(5))]
        if r.random() < 0.3 and old:
            turns = old
        made.append(turns)
        yield from ((c, k, role, text) for k, (role, text) in enumerate(turns))


@pytest.mark.parametrize("local_turns", [0, 60, 2_000])
def test_random_tries(spark, local_turns):
    """All classes through rounds, some finished in a task, and all."""
    rows = list(random_rows(3))
    assert run(spark, rows, local_turns=local_turns) == brute(rows)


def test_edge_rows(spark, monkeypatch):
    """Null ids, turns, roles and texts, ties, repeated rows, long conversations with a late fork, a large group of copies, conversations without turns."""
    monkeypatch.setattr(trie, "LARGE_CLASS", 20)
    monkeypatch.setattr(trie, "ID_BLOCK", 7)
    rows = [(None, 1, "user", "lost"), (5, None, "user", "first"), (5, 2, None, None), (5, 2, "", ""), (5, 2, "user", "b"), (5, 2, "user", "a"), (5, 2, "user", "a"), (5, -1, "user", "z")]
    rows += [(1000 + c, t, "user", f"shared {t}") for c in range(0, 60) for t in range(3)]
    rows += [(c, t, "user", "same" if t < 90 else f"{c}") for c in (2000, 2020, 2040) for t in range(100)]
    rows += [(c, 0, "user", "word " * 20_000) for c in (3001, 3002, 3003)] + [(c, 0, "user", "alone") for c in range(4001, 4020)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_numbering_over_parts(spark):
    """One conversation with most rows is numbered over many parts."""
    rows = [(7, t, "user", f"t {t}") for t in range(3000)] + [(27, 0, "user", "t 0"), (27, 5, "user", "q")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = trie.numbered_turns(spark.createDataFrame([(*r, "x", 1.5, 3, "y") for r in rows], FIELDS), "conv_id", "turn", "role", "text")
        assert numbered.filter("conv = 7").select("part").distinct().count() > 1
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
