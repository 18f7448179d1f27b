"""Gated recurrent language model with a class-factored softmax, in numpy.

The vocabulary's head, the most frequent words, is cut by rank into classes; a
word's probability is that of its class times that of the word in its class,
both from the recurrent state. All other words are the tail, in classes of their own
by frequency: a band for each doubling of the rank, and one for the words that
tasks do not know. The state gives a tail class's probability, and in it a
word's share follows its count over all training texts. The state is carried
from window to window through a whole document.

Counts and network cover all training texts. The network is trained by
truncated backpropagation in shards whose number grows with the corpus: each
shard starts a round from the same weights, and the rounds' weights are
averaged.

Edge cases: a null or blank text is its end token alone; a word that no
training text holds counts 0; without training texts every token has the same
base probability and the network keeps its first weights; a null id is
trained on; rows that repeat a document are scored one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from copy import copy
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, id_bucket, whole_groups

#: Words that every task knows the counts of, words of the head, and words to a class.
HOT, HEAD, CLASS = 100_000, 4096, 64
#: Inputs for the words of a tail class, by their last two bytes; units; steps of a window; lanes of a batch.
ENDINGS, UNITS, STEPS, LANES = 64, 32, 32, 512
#: Tokens to a shard, rounds and step size of the training. A round's part of a shard must fill its lanes: their longest document decides how many windows there are.
SHARD_TOKENS, ROUNDS, RATE = 1_600_000, 4, 0.06
#: Tokens scored together (the longest document decides how many windows there are), words counted before they are handed on, bytes of text split at once, models averaged at once.
BATCH_TOKENS, FLUSH, SLICE, AVERAGED = 5_000_000, 400_000, 8_000_000, 8
#: Shards that a task trains one after the other, on average; it hands on one model.
TOGETHER = 4
#: Tokens whose outputs are worked out at once when scoring, weights updated and rows summed at once: they fit a processor's cache.
TILE, BLOCK, ROWS = 4096, 16_384, 256
#: Uses of an input in a window from which on they are summed by a call of their own.
OFTEN = 8
#: Logits whose exponentials, and the sums of these, float32 holds with room to spare.
HIGH = 60.0
END, SEED = b"", 7
HALF = np.float32(0.5)
#: The sum of squared gradients that the adaptive steps start from.
FIRST_SQUARES = 1e-4


class Tokens:
    """The tokens of texts (a binary or string array): words once each, the end token last, and for each token its word's place; sizes: of the texts, in tokens."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(_as_text(texts)))
        found = split.flatten()
        empty = np.asarray(pc.binary_length(found)) == 0
        within = np.diff(np.asarray(split.offsets)).astype(np.int64)
        if empty.any():
            text_of = np.repeat(np.arange(len(within)), within)
            within -= np.bincount(text_of[empty], minlength=len(within))
            found = found.filter(pa.array(~empty))
        kinds = found.dictionary_encode()
        self.sizes = within + 1
        self.words = pa.concat_arrays([_as_bytes(kinds.dictionary), pa.array([END], pa.binary())])
        self.places = np.full(int(self.sizes.sum()), len(self.words) - 1, np.int32)
        inside = np.ones(len(self.places), bool)
        inside[np.cumsum(self.sizes) - 1] = False
        self.places[inside] = np.asarray(kinds.indices)


def _as_text(texts: pa.Array) -> pa.Array:
    return texts if pa.types.is_string(texts.type) else texts.view(pa.string())


def _as_bytes(words: pa.Array) -> pa.Array:
    return words.view(pa.binary())


def endings(words: pa.Array) -> np.ndarray:
    """Input ids of words (binary) outside the hot ones, by their last two bytes."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size, text = np.diff(ends), np.append(np.frombuffer(data or b"", np.uint8), np.uint8(0)).astype(np.int64)
    last, before = np.maximum(ends[1:] - 1, 0), np.maximum(ends[1:] - 2, 0)
    mixed = np.where(size > 0, text[last] * 31 + np.where(size > 1, text[before], 0), 0)
    return (HEAD + mixed % ENDINGS).astype(np.int32)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts with about SLICE bytes of `text`, in order; a longer text is a part of its own."""
    part = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), np.int64)) // SLICE
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def band(rank: int) -> int:
    """Tail class of a hot word outside the head, from 1 on; 0 is that of the words outside the hot ones."""
    return (rank // HEAD).bit_length()


class Model:
    """Weights by name. hot: words and counts, most frequent first; the head is its beginning. cold_weight: of the words outside."""

    def __init__(self, hot: list[tuple[bytes, int]], cold_weight: float) -> None:
        rnd = np.random.default_rng(SEED)
        head = hot[:HEAD]
        self.hot = pa.array([w for w, _ in hot], pa.binary())
        bands_of = np.array([band(i) for i in range(len(hot))], np.int32)
        self.input = np.where(np.arange(len(hot)) < HEAD, np.arange(len(hot)), endings(self.hot) + bands_of * ENDINGS).astype(np.int32) if hot else np.zeros(1, np.int32)
        self.logs = np.log10(np.array([c for _, c in hot] or [0]) + 1.0)
        self.classes = max(1, -(-len(head) // CLASS))
        bands = 1 + band(max(len(hot) - 1, 0))
        u = UNITS
        self.w = {
            "x": (rnd.normal(size=(HEAD + bands * ENDINGS, 3 * u)) * 0.1).astype(np.float32),
            "u": (rnd.normal(size=(u, 3 * u)) / np.sqrt(u)).astype(np.float32),
            "c": np.zeros((u, self.classes + bands), np.float32),
            "o": np.zeros((self.classes, u, CLASS), np.float32),
            "cb": np.zeros(self.classes + bands, np.float32),
            "ob": np.full((self.classes, CLASS), -1e4, np.float32),  # places without a word
        }
        # at first the network gives the counts' own distribution
        share = np.zeros(self.classes + bands)
        for i, (_, c) in enumerate(head):
            share[i // CLASS] += c + 1
            self.w["ob"][i // CLASS, i % CLASS] = np.log(c + 1)
        for i, (_, c) in enumerate(hot[HEAD:], HEAD):
            share[self.classes + band(i)] += c + 1
        share[self.classes] = max(cold_weight, 1)
        self.tail_logs = np.log10(share[self.classes :])
        self.w["cb"] = np.log(np.maximum(share, 1e-9)).astype(np.float32)
        #: The class of each input id.
        every = np.arange(HEAD + bands * ENDINGS)
        self.target = np.where(every < HEAD, every // CLASS, self.classes + (every - HEAD) // ENDINGS).astype(np.int16)

    def ids(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Input ids (head words by their rank, others by their tail class and ending) and ranks among the hot words, -1 outside them."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        ranks = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.hot), -1))
        return np.where(ranks < 0, endings(words), self.input[np.maximum(ranks, 0)]), ranks

    def pack(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.w.values()]).tobytes()

    def unpack(self, data: bytes) -> None:
        flat, at = np.frombuffer(data, np.float32), 0
        for k, v in self.w.items():
            self.w[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size

    def step(self, h: np.ndarray, x: np.ndarray, gates: np.ndarray, cand: np.ndarray, recur: np.ndarray) -> np.ndarray:
        """The next states (units x lanes) from the tokens' inputs; fills the gates (update, reset), the candidate and its recurrent part. Gates and candidate may lie in place of the inputs."""
        u = UNITS
        hu = self.w["u"].T @ h
        np.add(x[: 2 * u], hu[: 2 * u], out=gates)
        # the logistic function by way of tanh
        gates *= HALF
        np.tanh(gates, out=gates)
        gates *= HALF
        gates += HALF
        recur[:] = hu[2 * u :]
        np.add(gates[u:] * recur, x[2 * u :], out=cand)
        np.tanh(cand, out=cand)
        out = h - cand
        out *= gates[:u]
        out += cand
        return out

    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """The output weights of the classes and of the words in each class, with their biases as last row of units."""
        return np.concatenate((self.w["c"], self.w["cb"][None]), 0), np.concatenate((self.w["o"], self.w["ob"][:, None]), 1)

    def output(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, None]:
        """Natural log-probability of each id from its state (of a tail word: of its class)."""
        return self.outputs(np.concatenate((h, np.ones((len(ids), 1), np.float32)), 1), ids, self.wide())

    def outputs(self, h: np.ndarray, ids: np.ndarray, wide: tuple[np.ndarray, np.ndarray], grad: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """As output, from the states and a column of ones (ids x units + 1) and the wide weights; with grad, also the loss's gradient by state (ids x units), and in grad that by the wide weights."""
        u, n = UNITS, len(ids)
        target = self.target[ids]
        # classes in a row, those of the head first
        order = np.argsort(target, kind="stable")
        h, ids, target = h.take(order, 0), ids.take(order), target.take(order)
        outer, total, sorted_logp = softmax(h @ wide[0], target)
        bounds = np.searchsorted(target, np.arange(self.classes + 1)).tolist()
        used, m = [(k, bounds[k], bounds[k + 1]) for k in range(self.classes) if bounds[k] < bounds[k + 1]], bounds[-1]
        inner, words = np.empty((m, CLASS), np.float32), wide[1]
        for k, a, b in used:
            np.dot(h[a:b], words[k], out=inner[a:b])
        inner, inner_total, logs = softmax(inner, ids[:m] % CLASS)
        sorted_logp[:m] += logs
        logp = np.empty(n)
        logp[order] = sorted_logp
        if grad is None:
            return logp, None
        # what a row's exponentials are divided by is taken from its states and its result, which are narrower
        total, inner_total = np.reciprocal(total)[:, None], np.reciprocal(inner_total)[:, None]
        added(h * total, outer, grad[0])
        sorted_dh, back, scaled = outer @ wide[0][:u].T, np.empty((m, u), np.float32), (h[:m] * inner_total).T
        for k, a, b in used:
            np.dot(scaled[:, a:b], inner[a:b], out=grad[1][k])
            np.dot(inner[a:b], words[k, :u].T, out=back[a:b])
        if len(used) < self.classes:
            grad[1][np.diff(bounds) == 0] = 0
        sorted_dh *= total
        back *= inner_total
        sorted_dh[:m] += back
        dh = np.empty_like(sorted_dh)
        dh[order] = sorted_dh
        return logp, dh


def added(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """out = x.T @ y, for few columns and many rows, by blocks of rows."""
    whole = len(x) // ROWS * ROWS
    np.dot(x[whole:].T, y[whole:], out=out)
    if whole:
        out += np.matmul(x[:whole].reshape(-1, ROWS, x.shape[1]).transpose(0, 2, 1), y[:whole].reshape(-1, ROWS, y.shape[1])).sum(0)


def softmax(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: its exponentials, in place of the logits, with the total subtracted at its target; their total; the natural log-probability of the target."""
    n, k = logits.shape
    hit = np.arange(0, n * k, k) + target
    picked, ones = logits.ravel().take(hit), np.ones(k, np.float32)
    # rows are moved only if one could leave the range of the exponentials
    if n and (logits.max() > HIGH or picked.min() < -HIGH):
        top = logits.max(1)
        picked -= top
        logits -= top[:, None]
    powers = np.exp(logits, out=logits)
    total = powers @ ones
    powers.ravel()[hit] -= total
    return powers, total, picked.astype(np.float64) - np.log(total)


def lanes(docs: list[np.ndarray], most: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest lanes first."""
    heap = [(0, k) for k in range(min(most, len(docs)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, k = heapq.heappop(heap)
        dealt[k].append(i)
        heapq.heappush(heap, (n + len(docs[i]), k))
    return sorted(dealt, key=lambda d: -sum(len(docs[i]) for i in d))


def windows(docs: list[np.ndarray], most: int, mixed: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows (steps x lanes) of ids, document numbers and document starts; -1 where a lane has ended. Ended lanes drop out. Mixed: the documents of a lane in random order, else the long ones first."""
    dealt = lanes(docs, most)
    if mixed:
        rnd = np.random.default_rng(SEED)
        dealt = [rnd.permutation(d).tolist() for d in dealt]
    if not docs:
        return
    sizes = np.array([len(d) for d in docs])
    every = np.concatenate(dealt).astype(np.int64)
    flat, which = np.concatenate([docs[i] for i in every.tolist()]), np.repeat(every, sizes[every])
    length = np.array([sizes[d].sum() for d in dealt])
    first = np.cumsum(length) - length
    for s in range(0, int(length.max()), STEPS):
        live = int((length > s).sum())
        at = s + np.arange(STEPS)[:, None]
        there = at < length[:live]
        place = np.where(there, first[:live] + at, 0)
        ids, number = np.where(there, flat[place], np.int32(-1)), np.where(there, which[place], -1)
        before = which[first[:live] + s - 1] if s else np.full(live, -1)
        yield ids, number, number != np.concatenate((before[None], number[:-1]))


def score(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document, a tail word counting as its class."""
    out, h, wide = np.zeros(len(docs)), np.zeros((UNITS, min(LANES, len(docs))), np.float32), model.wide()
    for ids, number, start in windows(docs, LANES):
        steps, live = ids.shape
        states, h = np.ones((steps, live, UNITS + 1), np.float32), h[:, :live].copy()
        gates, cand, recur = (np.empty((k * UNITS, live), np.float32) for k in (2, 1, 1))
        inputs, starts = np.maximum(ids, 0), start.any(1).tolist()
        for t in range(steps):
            if starts[t]:
                h[:, start[t]] = 0  # a fresh array of the step before
            states[t, :, :UNITS] = h.T
            h = model.step(h, np.ascontiguousarray(model.w["x"].take(inputs[t], 0).T), gates, cand, recur)
        tile = max(1, TILE // live)
        for t in range(0, steps, tile):
            part = slice(t, t + tile)
            real = np.flatnonzero(ids[part] >= 0)
            h_part = states[part].reshape(-1, UNITS + 1)
            logp, _ = model.outputs(h_part if len(real) == len(h_part) else h_part[real], ids[part].ravel()[real], wide)
            out += np.bincount(number[part].ravel()[real], logp, len(docs))
    return out


def train(model: Model, docs: list[np.ndarray]) -> None:
    """One pass of truncated backpropagation over the documents, by adaptive gradient steps."""
    most, u = min(64, len(docs)), UNITS
    count = most * STEPS  # a window with few lanes left takes a smaller step
    # gradients are sums over a window; their means' squares are these over count * count
    first = np.float32(FIRST_SQUARES * count * count)
    # all weights but the inputs in a row, and their gradients, in the same places
    wide = model.wide()
    flat = np.concatenate([model.w["u"].ravel(), *(v.ravel() for v in wide)])
    found, squares, by_input = np.zeros_like(flat), np.full_like(flat, first), np.full_like(model.w["x"], first)
    ends = np.cumsum([0, model.w["u"].size, *(v.size for v in wide)]).tolist()
    (recurrent, *wide), grad = ([row[a:b].reshape(v.shape) for v, a, b in zip((model.w["u"], *wide), ends, ends[1:], strict=False)] for row in (flat, found))
    model.w |= {"x": model.w["x"].copy(), "u": recurrent, "c": wide[0][:u], "cb": wide[0][u], "o": wide[1][:, :u], "ob": wide[1][:, u]}
    room, rate = np.empty(BLOCK, np.float32), np.float32(RATE)
    h = np.zeros((u, most), np.float32)
    for ids, _, start in windows(docs, most, mixed=True):
        h, dx = _backward(model, h[:, : ids.shape[1]].copy(), ids, start, wide, grad)
        used, g = _by_row(ids, dx)
        held = by_input.take(used, 0)
        held += g * g
        by_input[used] = held
        g *= rate
        g /= np.sqrt(held, out=held)
        model.w["x"][used] = model.w["x"].take(used, 0) - g
        # places without a word have no gradient and stay
        for a in range(0, len(flat), BLOCK):
            g, held, step = found[a : a + BLOCK], squares[a : a + BLOCK], room[: len(flat) - a]
            np.multiply(g, g, out=step)
            held += step
            np.sqrt(held, out=step)
            np.divide(g, step, out=step)
            step *= rate
            flat[a : a + BLOCK] -= step


def _by_row(ids: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs that a window used and the sum of the gradients by each: of those used often one by one, of the others all at once, use by use."""
    real = np.flatnonzero(ids >= 0)
    flat = ids.ravel()[real]
    order = np.argsort(flat.astype(np.int16), kind="stable")
    flat = flat.take(order)
    first = np.concatenate(([0], np.flatnonzero(flat[1:] != flat[:-1]) + 1))
    times = np.concatenate((first[1:], [len(flat)])) - first
    # those used most often first
    most = np.argsort((-times).astype(np.int16), kind="stable")
    first, times = first.take(most), times.take(most)
    rows = np.ascontiguousarray(dx.transpose(0, 2, 1)).reshape(-1, dx.shape[1]).take(real.take(order), 0)
    g = rows.take(first, 0)
    often = int(np.searchsorted(-times, -OFTEN))
    for i, (a, n) in enumerate(zip(first[:often].tolist(), times[:often].tolist(), strict=True)):
        np.add.reduce(rows[a : a + n], 0, out=g[i])
    for n in range(1, OFTEN):
        end = int(np.searchsorted(-times, -n))
        g[often:end] += rows.take(first[often:end] + n, 0)
    return flat.take(first), g


def gradient(model: Model, h: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The gradients of a window's loss from the states h it is entered with: by weight, and by each token's input; and the states it is left in, as `h`."""
    u, wide = UNITS, model.wide()
    grad = [np.zeros_like(v) for v in (model.w["u"], *wide)]
    h, dx = _backward(model, h, ids, start, wide, grad)
    return {"u": grad[0], "c": grad[1][:u], "cb": grad[1][u], "o": grad[2][:, :u], "ob": grad[2][:, u], "h": h}, dx


def _backward(model: Model, h: np.ndarray, ids: np.ndarray, start: np.ndarray, wide: tuple[np.ndarray, np.ndarray], grad: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As gradient; those by the recurrent and the wide weights are left in grad."""
    (steps, live), u = ids.shape, UNITS
    inputs = np.ascontiguousarray(model.w["x"].take(np.maximum(ids, 0), 0).transpose(0, 2, 1))
    # gates and candidates take the place of the inputs, gradients that of the shares: what a window needs should stay near the processor
    gates, cand, states, recur = inputs[:, : 2 * u], inputs[:, 2 * u :], *(np.empty((steps, u, live), np.float32) for _ in range(2))
    starts = start.any(1).tolist()
    for t in range(steps):
        if starts[t]:
            h[:, start[t]] = 0  # a fresh array of the step before
        states[t] = h
        h = model.step(h, inputs[t], gates[t], cand[t], recur[t])
    known = np.ones((steps, live, u + 1), np.float32)
    known[:, :, :u] = states.transpose(0, 2, 1)
    known, real = known.reshape(-1, u + 1), np.flatnonzero(ids >= 0)
    full = len(real) == ids.size
    _, given = model.outputs(known if full else known[real], ids.ravel()[real], wide, grad[1:])
    if not full:
        dout, given = given, np.zeros((ids.size, u), np.float32)
        given[real] = dout
    given = np.ascontiguousarray(given.reshape(steps, live, u).transpose(0, 2, 1))
    # what a step's gates and candidate take of the gradient by the state after it
    d, by_cand = np.empty((steps, 3, u, live), np.float32), np.empty((steps, u, live), np.float32)
    for t in range(steps):
        z, r, c, rest = gates[t, :u], gates[t, u:], cand[t], 1 - gates[t, :u]
        share = states[t] - c
        share *= z
        np.multiply(share, rest, out=d[t, 0])
        np.multiply(c, c, out=share)
        np.subtract(1, share, out=share)
        np.multiply(rest, share, out=by_cand[t])
        np.multiply(by_cand[t], r, out=d[t, 2])
        np.subtract(1, r, out=share)
        share *= recur[t]
        np.multiply(d[t, 2], share, out=d[t, 1])
    by_state, passed = np.zeros((steps, u, live), np.float32), np.empty((u, live), np.float32)
    flat, recurrent = d.reshape(steps, 3 * u, live), model.w["u"]
    for t in range(steps - 1, -1, -1):
        d[t] *= by_state[t]
        if t:
            before = by_state[t - 1]
            np.matmul(recurrent, flat[t], out=before)
            before += np.multiply(by_state[t], gates[t, :u], out=passed)
            before += given[t]
            if starts[t]:
                before[:, start[t]] = 0
    np.sum(np.matmul(states, flat.transpose(0, 2, 1)), 0, out=grad[0])
    np.multiply(by_cand, by_state, out=d[:, 2])
    return h, flat


# --- over the corpus ---------------------------------------------------------


def _counts(texts: DataFrame) -> DataFrame:
    """word (bytes), c: over all texts; each task counts before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged() -> pa.RecordBatch:
            kinds = pa.concat_arrays([b.column(0) for b in held]).dictionary_encode()
            total = np.bincount(np.asarray(kinds.indices), np.concatenate([np.asarray(b.column(1)) for b in held]), len(kinds.dictionary))
            return pa.RecordBatch.from_arrays([kinds.dictionary, pa.array(total.astype(np.int64))], names=["word", "c"])

        for part in chain.from_iterable(map(slices, batches)):
            found = Tokens(part.column("text"))
            held.append(pa.RecordBatch.from_arrays([found.words, pa.array(np.bincount(found.places, minlength=len(found.words)))], names=["word", "c"]))
            if sum(b.num_rows for b in held) > 2 * FLUSH:
                held = [merged()]
                if held[0].num_rows > FLUSH:
                    yield held.pop()
        if held:
            yield merged()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _hot_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """At most HOT words, those above a count that a histogram of the counts gives; most frequent first, of equals by word."""
    bucket = F.floor(F.log2("c") * 32)
    sizes = sorted(((r["b"], r["least"], r["k"]) for r in counts.groupBy(bucket.alias("b")).agg(F.min("c").alias("least"), F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for _, low, k in sizes:
        if total + k > HOT:
            break
        total, least = total + k, low
    if least is None:
        return []
    rows = counts.filter(F.col("c") >= least).toPandas()
    return sorted(((bytes(w), int(c)) for w, c in zip(rows["word"], rows["c"], strict=True)), key=lambda x: (-x[1], x[0]))


def _average(models: DataFrame) -> bytes | None:
    """The weights' average, by the tokens each was trained on; AVERAGED at a time, so the driver holds that many at most."""

    def mean(data: pd.Series, n: pd.Series) -> bytes:
        total = sum(np.frombuffer(d, np.float32) * np.float64(k) for d, k in zip(data, n, strict=True))
        return (total / n.sum()).astype(np.float32).tobytes()

    def join(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [int(part["shard"].min()) // AVERAGED], "n": [int(part["n"].sum())], "data": [mean(part["data"], part["n"])]})

    models = checkpointed(models)
    while models.count() > AVERAGED:
        models = checkpointed(models.groupBy(F.floor(F.col("shard") / AVERAGED)).applyInPandas(join, models.schema))
    rows = models.orderBy("shard").collect()
    return mean(pd.Series([bytes(r["data"]) for r in rows]), pd.Series([r["n"] for r in rows])) if rows else None


def _trainer(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Trains a copy of the shared model on each shard of a partition sorted by shard; gives the copies' average, by their tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, least = 0.0, 0, 0
        for part in whole_groups(batches, ["shard"]):
            for shard, rows in part.groupby("shard"):
                own = copy(shared.value)
                own.w = {k: v.copy() for k, v in own.w.items()}
                docs = [np.frombuffer(d, np.int16).astype(np.int32) for d in sorted(rows["ids"])]
                train(own, docs)
                least = least if n else int(shard)
                k = sum(map(len, docs))
                total, n = total + np.frombuffer(own.pack(), np.float32) * np.float64(k), n + k
        if n:
            yield pd.DataFrame({"shard": [least], "n": [n], "data": [(total / n).astype(np.float32).tobytes()]})

    return run


def _deal() -> Column:
    """What deals a document, doc_id and text, to its shard and round."""
    return F.xxhash64(F.lit(SEED + 1), "doc_id", "text")


def _ids(places: np.ndarray, by_word: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The input ids of the tokens as 16-bit numbers, a binary value for each text."""
    ends = np.concatenate(([0], np.cumsum(sizes * 2))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(by_word.astype(np.int16)[places])])


def trained(texts: DataFrame, n_tokens: int, hot: list[tuple[bytes, int]], cold_weight: float) -> Model:
    """texts: doc_id, text (bytes) of the training documents, n_tokens in all; each is trained on in one round."""
    model = Model(hot, cold_weight)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(map(slices, batches)):
            found = Tokens(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("deal"), _ids(found.places, shared.value.ids(found.words)[0], found.sizes)], names=["deal", "ids"])

    _fit(model, texts.select(_deal().alias("deal"), "text").mapInArrow(run, "deal long, ids binary"), n_tokens)
    return model


def _fit(model: Model, encoded: DataFrame, n_tokens: int) -> None:
    """encoded: deal and ids of the training documents, n_tokens in all; each is trained on in one round."""
    shards = max(2, round(n_tokens / SHARD_TOKENS))
    dealt = checkpointed(encoded.select("ids", F.pmod("deal", F.lit(shards)).alias("shard"), F.pmod(F.shiftright("deal", 32), F.lit(ROUNDS)).alias("round")))
    for k in range(ROUNDS):
        shared = encoded.sparkSession.sparkContext.broadcast(model)
        sorted_shards = dealt.filter(F.col("round") == k).select("ids", "shard").repartition(max(2, shards // TOGETHER), "shard").sortWithinPartitions("shard")
        data = _average(sorted_shards.mapInPandas(_trainer(shared), "shard long, n long, data binary"))
        if data is not None:
            model.unpack(data)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Held out is every document whose id's crc32 leaves 2 when divided by 7.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (id_bucket(id_col, 7) == 2).alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    texts = rows.filter(~F.col("held_out")).select("doc_id", "text")
    counts = checkpointed(_counts(texts))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = _hot_words(counts)
    cold_weight = float(n - sum(c for _, c in hot) + v - len(hot) + 1)
    model = Model(hot, cold_weight)
    first = docs.sparkSession.sparkContext.broadcast(model)
    log_all = float(np.log10(n + v + 1))
    facts = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = first.value
        for part in chain.from_iterable(map(slices, batches)):
            found = Tokens(part.column("text"))
            by_word, ranks = model.ids(found.words)
            text_of = np.repeat(np.arange(len(found.sizes)), found.sizes)

            def each(by_word: np.ndarray, places: np.ndarray = found.places, text_of: np.ndarray = text_of, k: int = len(found.sizes)) -> np.ndarray:
                return np.bincount(text_of, by_word[places], k)

            logs = np.where(ranks < 0, 0.0, model.logs[np.maximum(ranks, 0)])
            inner = np.where(ranks < HEAD, 0.0, logs)
            shares = np.where(by_word < HEAD, 0.0, model.tail_logs[np.maximum(by_word - HEAD, 0) // ENDINGS])
            # the words that tasks do not know, once for each text that holds them
            cold = np.flatnonzero((ranks < 0)[found.places])
            pairs, times = np.unique(text_of[cold] * np.int64(len(found.words)) + found.places[cold], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(found.sizes) + 1) * np.int64(len(found.words)))
            tails = pa.StructArray.from_arrays([found.words.take(pa.array(pairs % len(found.words))), pa.array(times, pa.int64())], names=["word", "f"])
            base = each(logs) - found.sizes * log_all
            cols = [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(found.sizes), pa.array(each((ranks >= 0).astype(float)).astype(np.int64)), pa.array(base), pa.array(each(inner - shares))]
            cols += [part.column("deal"), _ids(found.places, by_word, found.sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tails)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "deal", "ids", "tail"])

    encoded = checkpointed(rows.withColumn("deal", _deal()).mapInArrow(encode, facts + ", deal long, ids binary, tail array<struct<word binary, f long>>"))
    _fit(model, encoded.filter(~F.col("held_out")).select("deal", "ids"), n)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judge(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            logs = score(shared.value, [np.frombuffer(d.as_buffer(), np.int16).astype(np.int32) for p in parts for d in p.column("ids")]) / np.log(10)
            for p in parts:
                own, logs = logs[: p.num_rows], logs[p.num_rows :]
                yield pa.RecordBatch.from_arrays([*p.columns[:6], pa.array(np.asarray(p.column("score")) + own)], names=p.schema.names[:7])

        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += batch.column("ids").nbytes // 2
            if held > BATCH_TOKENS:
                yield from judge(parts)
                parts, held = [], 0
        if parts:
            yield from judge(parts)

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "ids").mapInArrow(run, facts)
    # words outside the hot ones meet their counts in a join; none of them is frequent
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.f").join(counts, "word", "left")
    gained = tail.groupBy("row").agg(F.sum(F.col("f") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("gain"), F.sum(F.when(F.col("c") > 0, F.col("f")).otherwise(0)).alias("more"))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.join(gained, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base_score") + gain).alias("base_score"), (F.col("score") + gain).alias("score"))
