"""Encode texts with a byte-level BPE by replaying its merges over the words of the corpus, and decode the ids.

Each task cuts its part of the corpus into blocks, gathers the distinct words
that it has not met yet and lays their bytes end to end. An inverted index
holds, for every merge, the positions of the token pairs that it joins. The
merges are replayed in rank order, each over all its positions at once; a
merge looks up only the two pairs that its token makes with its neighbours,
and files them under their own merges. A word whose new pair has a rank that
was already replayed is brought up to date before the replay goes on, so the
result is that of encoding word by word. Texts are never shuffled.

Memory is bounded by a block, the ids of one text and the words remembered.

Edge cases: a null text counts as empty and has no ids; ids of rows are passed
on as they are, null and repeated ones too, and equal rows are encoded one by
one; a text of any length is encoded whole, in segments cut where the
tokenizer always cuts; columns of docs may have any names; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Code points to a block and to a segment of a long text; words that a task remembers before it starts again.
BLOCK, SEGMENT, REMEMBERED = 1 << 21, 1 << 20, 500_000
#: Positions from which a merge is applied to all of them together.
AT_ONCE = 24
#: A word ends for sure where white space follows something else.
CUT = regex.compile(r"(?<=\S)(?=\s)")


class MergeReplay:
    """The merges of one vocabulary, and the ids of the words met so far."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.first_merge = np.array([[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        # every pair of tokens that makes a token
        self.merge_of = {self.rank[t[:i]] << 20 | self.rank[t[i:]]: r for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank}
        self.pair_codes = np.array(sorted(self.merge_of), np.int64)
        self.pair_ranks = np.array([self.merge_of[p] for p in self.pair_codes.tolist()], np.int64)
        self.reset()

    def reset(self) -> None:
        """Forget the words; their ids lie end to end in `ids`, word k's from `starts[k]` on, `lengths[k]` of them."""
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.lengths = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))

    def learn(self, words: list[str]) -> None:
        """Add words that are not known yet."""
        raw = [w.encode() for w in words]
        whole = [self.rank.get(r, -1) for r in raw]
        found, sizes = self.replay([r for r, k in zip(raw, whole, strict=True) if k < 0])
        single = np.array(whole, np.int64)
        lengths = np.ones(len(words), np.int64)
        lengths[single < 0] = sizes
        starts = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.empty(starts[-1], np.int32)
        in_vocabulary = np.repeat(single >= 0, lengths)
        ids[in_vocabulary] = single[single >= 0]
        ids[~in_vocabulary] = found
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, starts[:-1] + len(self.ids)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(data), np.cumsum([len(w) for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        merges = np.full(n, -1, np.int64)
        merges[:-1] = self.first_merge[data[:-1], data[1:]]
        merges[ends - 1] = -1
        # the inverted index: positions under the rank of the merge that joins the pair at them
        order = np.argsort(merges, kind="stable")
        order = order[np.searchsorted(merges[order], 0) :]
        ranks, firsts = np.unique(merges[order], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(ranks, np.split(order, firsts[1:]), strict=True)} if len(ranks) else {}
        # the words as linked lists of tokens; scalars are read from the arrays, runs of positions from numpy's views of them
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1], before[starts] = -1, -1
        word = np.repeat(np.arange(len(words), dtype=np.int32), ends - starts)
        state = [array("i", x.astype(np.int32).tobytes()) for x in (self.byte_id[data], merges, after, before)]
        views = [np.frombuffer(x, np.int32) for x in state]
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            positions = index.pop(r)
            filed = []
            if len(positions) >= AT_ONCE:
                filed, positions = self.merge_at_once(r, np.array(positions, np.int64), word, *views)
            for m, p in filed + self.merge_in_order(r, sorted(positions), *state):
                if m in index:
                    index[m].append(p)
                else:
                    index[m] = [p]
                    heapq.heappush(queue, m)
        alive = views[0] >= 0
        return views[0][alive], np.add.reduceat(alive.astype(np.int64), starts)

    def merge_in_order(self, r: int, positions: list[int], token: array, merge: array, after: array, before: array) -> list[tuple[int, int]]:
        """Merge the pairs of rank r from left to right; what gets a rank up to r is merged before the next. Returns (rank, position) of the other new pairs."""
        filed, late, merge_of = [], [], self.merge_of
        for p in positions:
            s = r
            while True:
                # the pair at p may have gone since it was filed
                if merge[p] == s:
                    q = after[p]
                    token[p], token[q], merge[p], merge[q] = s, -1, -1, -1
                    after[p] = end = after[q]
                    if end >= 0:
                        before[end] = p
                        m = merge_of.get(s << 20 | token[end])
                        if m is not None:
                            merge[p] = m
                            if m > r:
                                filed.append((m, p))
                            else:
                                heapq.heappush(late, (m, p))
                    start = before[p]
                    if start >= 0:
                        m = merge_of.get(token[start] << 20 | s)
                        if m is None:
                            merge[start] = -1
                        else:
                            merge[start] = m
                            if m > r:
                                filed.append((m, start))
                            else:
                                heapq.heappush(late, (m, start))
                if not late:
                    break
                s, p = heapq.heappop(late)
        return filed

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair_codes, pairs), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == pairs, self.pair_ranks[at], -1)

    def merge_at_once(self, r: int, at: np.ndarray, word: np.ndarray, token: np.ndarray, merge: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
        """The same for many positions together, but for those in words where the order may matter: where pairs touch or a new one has a rank up to r. Returns the new pairs and the positions left."""
        at = np.unique(at[merge[at] == r])
        gone = after[at]
        end, start = after[gone], before[at]
        new_right = np.where(end >= 0, self.ranks_of(r << 20 | token[end].astype(np.int64)), -1)
        new_left = np.where(start >= 0, self.ranks_of(token[start].astype(np.int64) << 20 | r), -1)
        ordered = (merge[gone] == r) | ((end >= 0) & (merge[end] == r)) | ((new_right >= 0) & (new_right <= r)) | ((new_left >= 0) & (new_left <= r))
        left = []
        if ordered.any():
            apart = ~np.isin(word[at], word[at[ordered]])
            left = at[~apart].tolist()
            at, gone, end, start, new_right, new_left = (x[apart] for x in (at, gone, end, start, new_right, new_left))
        token[at], token[gone], merge[at], merge[gone], after[at] = r, -1, new_right, -1, end
        before[end[end >= 0]] = at[end >= 0]
        merge[start[start >= 0]] = new_left[start >= 0]
        ranks, where = np.concatenate([new_right, new_left]), np.concatenate([at, start])
        return list(zip(ranks[ranks >= 0].tolist(), where[ranks >= 0].tolist(), strict=True)), left

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the segments end to end, and how many each has."""
        if len(self.number) > REMEMBERED:
            self.reset()
        words = [self.pattern.findall(s) for s in segments]
        self.learn(list(set().union(*words).difference(self.number)))
        number = self.number.__getitem__
        k = np.fromiter((number(w) for ws in words for w in ws), np.int64, sum(map(len, words)))
        lengths = self.lengths[k]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[k] - upto[:-1], lengths) + np.arange(upto[-1])]
        word_ends = np.cumsum([0, *map(len, words)])
        return ids, np.diff(upto[word_ends])


@lru_cache(maxsize=2)
def _replay(path: str, pattern: str) -> MergeReplay:
    return MergeReplay(path, pattern)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> pa.Array:
    return pa.array(_replay(path, "").bytes_of, pa.large_binary())


def segments_of(text: str) -> Iterator[str]:
    """The text cut into segments of about SEGMENT code points, only between words."""
    at = 0
    while len(text) - at > SEGMENT and (cut := CUT.search(text, at + SEGMENT)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and `ids`, the token ids of its text. path: a vocabulary of ranks; pattern: the pre-tokenizer's words."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(path, pattern)
        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                start, chars, done = at, 0, []
                block: list[str] = []
                parts: list[int] = []
                while at < len(batch) and chars < BLOCK:
                    n_parts = 0
                    for s in segments_of(texts[at].as_py()):
                        block.append(s)
                        chars, n_parts = chars + len(s), n_parts + 1
                        if chars >= BLOCK:
                            done.append(replay.encode(block))
                            block, chars = [], chars % BLOCK
                    parts.append(n_parts)
                    at += 1
                    if done:
                        break
                if block:
                    done.append(replay.encode(block))
                ids = np.concatenate([d[0] for d in done])
                upto = np.concatenate([[0], np.cumsum(np.concatenate([d[1] for d in done]))])
                offsets = upto[np.concatenate([[0], np.cumsum(parts)])]
                yield pa.RecordBatch.from_arrays([rows.slice(start, at - start), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return named.mapInArrow(encoded, StructType([named.schema["doc_id"], StructField("ids", ArrayType(IntegerType(), False), False)]))


def decode_ids(tokens: DataFrame, path: str, ids_col: str = "ids", result_col: str = "decoded") -> DataFrame:
    """tokens with the bytes that its ids stand for; null ids have none. An id outside the vocabulary is an error."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            taken = _token_bytes(path).take(lists.flatten())
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
            offsets = ends[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])] if len(taken) else np.zeros(len(batch) + 1, np.int64)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(offsets.astype(np.int64).tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([*batch.columns, data.cast(pa.binary())], [*batch.schema.names, result_col])

    return tokens.mapInArrow(decoded, StructType([*tokens.schema.fields, StructField(result_col, BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each row's ids and of the bytes decoded from them."""
    both = decode_ids(encode_texts(docs, path, pattern, id_col, text_col), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
