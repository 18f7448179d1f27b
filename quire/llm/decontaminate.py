"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND.

Items are indexed by length class, powers of two, so that a passage's length
follows from an item alone; mean lengths are taken over all items. For each
class a training text is cut into overlapping passages, long enough that each
of its items lies whole in one of them. A passage is a query of its distinct words;
all items that score at least `RETRIEVE` of what they score against themselves
come back. Scores are divided by that self-score beforehand, so one threshold
holds for all items and upper bounds are as tight as they can be. Words weigh
by their rarity in the training texts, counted over all of them. As an item's
rarest words make up most of its score, a passage is searched only if it holds
enough of those of some item; any other stays below the threshold. A retrieved
item counts only if the passage holds enough of the five-word shingles of its
question and of its answer, or of the whole item if it has no answer.

Indexes hold at most `BLOCK_ITEMS` items together; more items make more of them,
which are searched one after another, so what is broadcast does not grow with their number.

Edge cases: a null or blank text holds no item, a null or blank item is in no
text; repeated items are found together; an empty benchmark finds nothing;
rows are judged one by one, so repeated documents and empty tables need
nothing special.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items whose indexes are searched together, and the least length class of items, in words.
BLOCK_ITEMS, LEAST_SPAN = 20_000, 64
#: BM25's saturation and length weight, postings to a block, and the share of its self-score at which an item is retrieved.
K1, B, BLOCK, RETRIEVE = 1.2, 0.75, 32, 0.6
#: Share of an item's self-score that its rarest words make up, of which a passage must hold all but 1 - RETRIEVE.
RARE = 0.6
#: Words to a shingle, the share of an item's question and answer that a passage must hold.
SHINGLE, OVERLAP = 5, 0.8

_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, split at ASCII characters that are neither letters nor digits."""
    return text.translate(_FOLD).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Postings by term, in blocks that know their largest weight. items: (id, question, answer), each of up to `span` words; mean: words to an item, of all items; seen: texts of `texts` that hold a term."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], span: int, mean: float, seen: dict[bytes, int], texts: int) -> None:
        self.ids = [i for i, _, _ in items]
        self.parts = [(shingles(q), shingles(a)) for _, q, a in items]
        counts = [Counter(q + a) for _, q, a in items]
        lengths = [c.total() for c in counts]
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        self.rare: dict[bytes, list[tuple[int, float]]] = {}
        self.needed: list[float] = []
        for d, (c, n) in enumerate(zip(counts, lengths, strict=True)):
            weight = {t: math.log(1 + (max(texts - seen.get(t, 0), 0) + 0.5) / (seen.get(t, 0) + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for t, f in c.items()}
            whole, rare = sum(weight.values()), 0.0
            for t, w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
                self.postings.setdefault(t, []).append((d, w / whole))
                if rare < RARE:
                    self.rare.setdefault(t, []).append((d, w / whole))
                    rare += w / whole
            self.needed.append(RETRIEVE - (1 - rare) - 1e-6)
        self.block_max = {t: [max(w for _, w in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for t, p in self.postings.items()}
        self.bound = {t: max(m) for t, m in self.block_max.items()}
        self.rare_bound = {t: max(w for _, w in p) for t, p in self.rare.items()}
        self.span = span

    def worth_a_search(self, rare_words: set[bytes]) -> bool:
        held: dict[int, float] = {}
        for t in rare_words:
            for d, w in self.rare[t]:
                held[d] = held.get(d, 0.0) + w
                if held[d] >= self.needed[d]:
                    return True
        return False

    def search(self, terms: set[bytes]) -> list[int]:
        """All items that score RETRIEVE or more against the terms, by block-max WAND."""
        cursors = [[0, t, self.postings[t]] for t in terms if t in self.postings]
        found, least = [], RETRIEVE - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[2][c[0]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.bound[c[1]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][2][cursors[pivot][0]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][2][cursors[pivot + 1][0]][0] == item:
                pivot += 1
            # the blocks that the item would lie in bound its score more tightly
            near, ends = 0.0, []
            for c in cursors[: pivot + 1]:
                i = c[0] // BLOCK
                while i < len(self.block_max[c[1]]) and c[2][min((i + 1) * BLOCK, len(c[2])) - 1][0] < item:
                    i += 1
                if i < len(self.block_max[c[1]]):
                    near += self.block_max[c[1]][i]
                    ends.append(c[2][min((i + 1) * BLOCK, len(c[2])) - 1][0] + 1)
            if near >= least:
                if cursors[0][2][cursors[0][0]][0] == item:
                    if sum(c[2][c[0]][1] for c in cursors[: pivot + 1]) >= least:
                        found.append(item)
                    target = item + 1
                else:
                    target = item
            else:
                beyond = [cursors[pivot + 1][2][cursors[pivot + 1][0]][0]] if pivot + 1 < len(cursors) else []
                target = max(item + 1, min(ends + beyond, default=item + 1))
            for c in cursors[: pivot + 1]:
                while c[0] < len(c[2]) and c[2][c[0]][0] < target:
                    # whole blocks that end before the target are skipped
                    skip = (c[0] // BLOCK + 1) * BLOCK
                    c[0] = skip if skip < len(c[2]) and c[2][skip - 1][0] < target else c[0] + 1
            cursors = [c for c in cursors if c[0] < len(c[2])]
        return found

    def items_in(self, words: list[bytes]) -> set[int]:
        step, least = self.span, min(self.needed)
        weight = np.fromiter(map(self.rare_bound.get, words, repeat(0.0)), float, len(words))
        bounds, places = np.concatenate(([0.0], np.cumsum(weight))), np.flatnonzero(weight)
        starts = np.arange(0, max(len(words) - step, 1), step)
        ends = np.minimum(starts + 2 * step, len(words))
        found: set[int] = set()
        # repeated words only raise the bound, so no passage that holds an item is lost
        for k in np.flatnonzero(bounds[ends] - bounds[starts] >= least - 1e-6).tolist():
            s, e = int(starts[k]), int(ends[k])
            near = places[np.searchsorted(places, s) : np.searchsorted(places, e)]
            if not self.worth_a_search({words[i] for i in near.tolist()}):
                continue
            terms = {w for w in words[s:e] if w in self.bound}
            hits = [d for d in self.search(terms) if d not in found]
            if hits:
                held: dict[int, set] = {}
                for d in hits:
                    if all(self._holds(part, words[s:e], held) for part in self.parts[d]):
                        found.add(d)
        return {self.ids[d] for d in found}

    @staticmethod
    def _holds(part: set[tuple[bytes, ...]], words: list[bytes], held: dict[int, set]) -> bool:
        if not part:
            return True
        n = len(next(iter(part)))
        if n not in held:
            held[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        return len(part & held[n]) >= OVERLAP * len(part)


def item_parts(text: str, answer: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item; without an answer, all its words are the question."""
    words = words_of((text or "").encode())
    return words, words_of((answer or "").encode())


def span_of(n: int) -> int:
    """The length class of an item: the next power of two, LEAST_SPAN at least. It depends on the item alone."""
    return max(LEAST_SPAN, 1 << (n - 1).bit_length())


def _mean_words(items: DataFrame) -> float:
    """Words to an item, over all items with any."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = [len(q) + len(a) for batch in batches for q, a in map(item_parts, batch.text, batch.answer)]
        yield pd.DataFrame({"n": [sum(1 for s in sizes if s)], "words": [sum(sizes)]})

    found = items.select("text", "answer").mapInPandas(count, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    return (found["words"] or 0) / max(found["n"] or 0, 1)


def _searcher(shared: Broadcast):  # noqa: ANN202
    @F.pandas_udf("array<long>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            words = (words_of(t or b"") for t in batch)
            yield pd.Series([sorted(set().union(*(index.items_in(w) for index in shared.value))) if w else [] for w in words])

    return search


def _texts_with(docs: DataFrame, text_col: str, terms: Broadcast) -> tuple[dict[bytes, int], int]:
    """In how many texts each of the terms occurs, and the number of texts; one row per term and task is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, texts = Counter(), 0
        for batch in batches:
            for text in batch.text:
                seen.update(terms.value.intersection(words_of(text)))
            texts += len(batch)
        yield pd.DataFrame({"term": [b"", *seen.keys()], "n": [texts, *seen.values()]})

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("text"))
    found = {bytes(r["term"]): r["n"] for r in rows.mapInPandas(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


def overlapping_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> Column:
    """A column for docs: the sorted ids of the benchmark items that the text holds."""
    sc = benchmark.sparkSession.sparkContext
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"), answer.alias("answer")).filter(F.col("text").isNotNull() & F.col("item").isNotNull())
    blocks = max(1, math.ceil(items.count() / BLOCK_ITEMS))
    mean = _mean_words(items)
    columns = []
    for k in range(blocks):
        rows = sorted(items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect(), key=lambda r: (r["item"], r["text"], r["answer"] or ""))
        spans: dict[int, list] = {}
        for r in rows:
            question, reply = item_parts(r["text"], r["answer"])
            if question or reply:
                spans.setdefault(span_of(len(question) + len(reply)), []).append((r["item"], question, reply))
        terms = frozenset(w for some in spans.values() for _, q, a in some for w in q + a)
        known = _texts_with(docs, text_col, sc.broadcast(terms)) if terms else ({}, 0)
        indexes = [Index(some, span, mean, *known) for span, some in sorted(spans.items())]
        columns.append(_searcher(sc.broadcast(indexes))(F.col(text_col).cast("binary")))
    return F.array_sort(F.array_distinct(F.concat(*columns))) if len(columns) > 1 else columns[0]


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per document: n_items, the ids of the items it holds joined by commas, and contaminated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), overlapping_items(docs, benchmark, text_col, answer_col=answer_col).alias("items"))
    return rows.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), (F.size("items") > 0).alias("contaminated"))
