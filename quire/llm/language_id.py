"""Language ID by hierarchical discrimination with linear support vector machines.

First the family: languages whose sampled texts have similar byte n-grams are
grouped by average linkage until there are about as many families as languages in
one (the square root of their number), so that close languages share a family and
no family is large; one linear machine per family scores a text.
Then, inside the winning family, one-versus-one linear machines vote between
the closely related languages. Texts are bags of hashed byte bigrams and
trigrams; a machine is a table of weights, so a text of any length is scored
whole by looking up and averaging the weights of its n-grams.

Training reads a bounded sample of labelled rows (`SAMPLE_PER_LANGUAGE` for each
language at most, about `SAMPLE` in all, at least one of each language; those
with the smallest hash of id and text), never a held-out row. Tasks turn the whole
texts of the sample into n-gram shares, so what comes to the driver is bounded by
its rows, and there only the rows of one training step are spread over all n-grams.
The model grows with the power 1.5 of the number of languages.

Edge cases: a text that is null or has no letter is `und` with score 0; so is
everything if no labelled training row exists; one learned language is always
predicted; repeated rows are predicted alike and train once; a null id counts as
an empty one; columns of docs may have any names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import id_bucket

#: Bounds of the fit: texts per language and in all.
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 2000
HASH_BITS, EPOCHS, L2, SEED = 14, 12, 1e-4, 5
UNKNOWN = "und"

#: Lower case for ASCII letters; all else that is no letter or high byte becomes a blank.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def ngrams(text: bytes) -> np.ndarray:
    """Hashed bigrams and trigrams of a text with one blank around it and between its words; those across words are left out by folding."""
    b = FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = b == 32
    b = b[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)  # runs of blanks become one
    pair = b[:-1] << 8 | b[1:]
    triple = pair[:-1] << 8 | b[2:]
    shift = np.uint32(32 - HASH_BITS)
    return np.concatenate(((pair * np.uint32(2654435761)) >> shift, (triple * np.uint32(2246822519) + np.uint32(374761393)) >> shift))


def profile(text: bytes) -> np.ndarray:
    """The n-grams' shares in a whole text."""
    x = np.bincount(ngrams(text), minlength=1 << HASH_BITS)
    return (x / max(x.sum(), 1.0)).astype(np.float32)


class Profiles:
    """Rows of n-gram shares, times a scale of each n-gram; kept by the n-grams that they hold, and spread over all of them only when indexed."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.rows, self.shape = rows, (len(rows), 1 << HASH_BITS)
        self.scale = np.ones(self.shape[1], np.float32)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), self.shape[1]), np.float32)
        for k, i in enumerate(at):
            grams, shares = self.rows[i]
            out[k, grams] = shares * self.scale[grams]
        return out

    def mean(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1], np.float32)
        for i in at:
            grams, shares = self.rows[i]
            out[grams] += shares * self.scale[grams]
        return out / np.float32(len(at))


def train_svm(x: np.ndarray | Profiles, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine between the rows of x with y = 1 and y = -1, on the squared hinge loss, by averaged gradient steps in small batches."""
    rnd = np.random.default_rng(SEED)
    norm = float(np.mean([v @ v for r in rows.tolist() for v in x[[r]]]))
    w, b, total, total_b, n = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 0
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    for epoch in range(EPOCHS):
        order = rnd.permutation(len(y))
        rate = 1 / (1 + 0.3 * epoch)
        for part in np.array_split(order, max(1, len(y) // 16)):
            xs = x[rows[part]]
            slack = np.maximum(0, 1 - y[part] * (xs @ w + b)) * y[part] * weight[part]
            w = w * np.float32(1 - L2 * rate) + (rate / (len(part) * norm)) * (slack.astype(np.float32) @ xs)
            b += rate * float(slack.mean()) * 0.1
            if epoch >= EPOCHS // 3:
                total, total_b, n = total + w, total_b + b, n + 1
    return total / n, total_b / n


@dataclass
class Model:
    languages: list[str]
    families: list[list[int]]
    weights: np.ndarray  # n-gram x machine
    bias: np.ndarray
    pairs: list[tuple[int, int, int]]  # machine, the language above 0, the one below

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        grams = ngrams(text)
        # long texts piece by piece: the gathered weights of one piece at a time are in memory
        total = sum((self.weights[grams[i : i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(grams), 65536)), np.zeros(self.weights.shape[1]))
        margin = total / max(len(grams), 1) + self.bias
        family = int(np.argmax(margin[: len(self.families)])) if len(self.families) > 1 else 0
        if len(self.families) > 1:
            rest = np.delete(margin[: len(self.families)], family)
            score = sigmoid(margin[family] - rest.max())
        else:
            score = 1.0
        members = self.families[family]
        if len(members) > 1:
            votes, sums, least = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
            for machine, a, b in self.pairs:
                if a in votes:
                    m = margin[machine]
                    votes[a if m >= 0 else b] += 1
                    sums[a] += m
                    sums[b] -= m
                    least[a], least[b] = min(least[a], sigmoid(2 * m)), min(least[b], sigmoid(-2 * m))
            best = max(members, key=lambda k: (votes[k], sums[k], -k))
            score *= least[best]
        else:
            best = members[0]
        return self.languages[best], float(score)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def families_of(means: np.ndarray) -> list[list[int]]:
    """Average linkage on the cosine of the languages' mean profiles (square roots damp the commonest n-grams), down to the root of their number, none above twice that."""
    root = np.sqrt(means)
    alike = root @ root.T
    groups, number = [[i] for i in range(len(means))], isqrt(len(means))
    while len(groups) > number:
        fits = [(i, j) for i, j in combinations(range(len(groups)), 2) if len(groups[i]) + len(groups[j]) <= 2 * number]
        if not fits:
            break
        _, i, j = max((float(alike[np.ix_(groups[i], groups[j])].mean()), -i, -j) for i, j in fits)
        groups[-i] += groups.pop(-j)
    return groups


def fit(samples: list[tuple[str, tuple[np.ndarray, np.ndarray]]]) -> Model:
    """samples: language, and the n-grams of a profile with their shares."""
    languages = sorted({lang for lang, _ in samples})
    y = np.array([languages.index(lang) for lang, _ in samples], int)
    x, every = Profiles([p for _, p in samples]), np.arange(len(y))
    groups = families_of(np.stack([x.mean(np.flatnonzero(y == k)) for k in range(len(languages))])) if languages else []
    # rare n-grams weigh more: profiles are sums of few large and many small shares
    if len(y):
        x.scale = (1 / np.sqrt(x.mean(every) + 1e-6)).astype(np.float32)
    machines, pairs = [], []
    for g in groups if len(groups) > 1 else []:
        machines.append(train_svm(x, every, np.where(np.isin(y, g), 1.0, -1.0)))
    for g in groups:
        for a, b in combinations(g, 2):
            rows = np.flatnonzero((y == a) | (y == b))
            pairs.append((len(machines), a, b))
            machines.append(train_svm(x, rows, np.where(y[rows] == a, 1.0, -1.0)))
    weights = np.stack([w * x.scale for w, _ in machines], 1) if machines else np.zeros((1 << HASH_BITS, 0), np.float32)
    return Model(languages, groups, weights, np.array([b for _, b in machines]), pairs)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def labelled_sample(docs: DataFrame, held_out: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, tuple[np.ndarray, np.ndarray]]]:
    """Language of the sampled rows, and the n-grams of their profiles with their shares.

    Hashes are thinned per language first, by the language's row count, so the texts that are
    ranked number a few times the sample. Equal rows count once.
    """
    rows = docs.filter(~held_out & F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()
    if not counts:
        return []
    each = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE // len(counts)))
    hashed = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1 << 30, int((2 * each + 20) / r["count"] * (1 << 30)) + 1))])
    thin = rows.select(F.col(lang_col).alias("lang"), hashed.alias("h"), F.col(text_col).cast("binary").alias("text")).filter(F.col("h") < bound[F.col("lang")])

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, shares = [], []
            for text in batch.column("text"):
                p = profile(text.as_py())
                used = np.flatnonzero(p)
                grams.append(used.astype(np.uint16).tobytes())
                shares.append(p[used].tobytes())
            data = [pa.array(grams, pa.binary()), pa.array(shares, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), *data], names=["lang", "h", "grams", "shares"])

    found = thin.mapInArrow(profiles, "lang string, h long, grams binary, shares binary").dropDuplicates(["lang", "h"])
    kept = found.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "grams", "shares"))), 1, each).alias("sample"))
    found = kept.select("lang", F.explode("sample").alias("s")).select("lang", "s.*").collect()
    return [(r["lang"], (np.frombuffer(r["grams"], np.uint16), np.frombuffer(r["shares"], np.float32))) for r in sorted(found, key=lambda r: (r["lang"], r["h"]))]


def _predictor(model: Broadcast):  # noqa: ANN202
    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(UNKNOWN, 0.0) if t is None else model.value.predict(t) for t in batch], columns=["lang", "score"])

    return predict


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Column:
    """A column for docs: struct of lang and score, by a model fitted on the documents that are not held out."""
    model = fit(labelled_sample(docs, id_bucket(id_col, 5) == 0, id_col, text_col, lang_col))
    text = F.when(has_letter(F.col(text_col)), F.col(text_col).cast("binary"))
    return _predictor(docs.sparkSession.sparkContext.broadcast(model))(text)


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and a score from 0 to 1.

    Held out is every document whose id's crc32 is a multiple of 5.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (id_bucket(id_col, 5) == 0).alias("held_out"), language_of(docs, id_col, text_col, lang_col).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
