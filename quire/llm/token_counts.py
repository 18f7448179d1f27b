"""Count a BPE tokenizer's tokens with a compiled finite-state transducer.

A byte-pair encoding is canonical exactly if each pair of neighbours in it is,
so the last token of every prefix of a word follows from those of the shorter
prefixes. Only prefixes that start inside the longest suffix which some token
could still continue matter: that window of (last token, relative count) is
the transducer's state. Its transitions read a byte and carry the change in
the number of tokens; the last byte of a word has transitions of its own,
since the vocabulary marks word ends. States are compiled when first met.

Texts are cut into chunks. A chunk's state map is (head, count, tail): at a
reset, white space or a letter or digit before a mark that is none, the transducer
starts again, so whatever state a chunk is entered in, all that
depends on it is the head before its first reset; what it is left in is
the tail after its last one. Maps compose associatively, `FAN` neighbours to a
task and round, so a text of any length takes a logarithmic number of rounds: a
parallel prefix scan over its chunks. Only a run of letters without any reset
travels as it is.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); ids are passed on as they
are, null and repeated ones too; equal rows are counted one by one; columns of
docs may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, whole_groups

#: Code points to a chunk, and chunks whose maps one task composes in a round.
CHUNK, FAN = 1 << 16, 64
#: Words, states and pairs that a task remembers before it starts again.
REMEMBERED = 300_000

ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Unicode's White_Space, which the vocabulary's pre-tokenizer drops.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
#: Places where the pre-tokenizer always cuts and no form of normalization reaches across.
RESET = regex.compile(r"(?<=[\p{L}\p{N}])(?=[.,;:!?()\"\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
RESET_MARKS = '.,;:!?()"\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f'
#: The pre-tokenizer's pieces; fixed values of the vocabulary file's format.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Transducer:
    """Counts the tokens of one pre-token; symbols 0-255 are bytes, 256-511 bytes that end a word."""

    def __init__(self, vocabulary: dict) -> None:
        model = vocabulary["model"]
        end, number = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_symbols())}

        def symbols(token: str) -> tuple[int, ...]:
            body = token.removesuffix(end) if token != end else token
            s = [number[c] for c in body]
            return (*s[:-1], s[-1] + 256) if len(body) < len(token) else tuple(s)

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {symbols(t) for t in model["vocab"]}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.specials = [t["content"] for t in vocabulary["added_tokens"] if t["special"]]
        self.reset()

    def reset(self) -> None:
        """State 0 is the start; a state is (window of symbols, last token and relative count of each prefix in it)."""
        self.pairs: dict[tuple, bool] = {}
        self.number: dict[tuple, int] = {((), ((None, 0),)): 0}
        self.states: list[tuple] = [((), ((None, 0),))]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, parts: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        while len(parts) > 1:
            best = min(((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            parts = [*parts[: best[1]], parts[best[1]] + parts[best[1] + 1], *parts[best[1] + 2 :]]
        return parts

    def canonical(self, a: tuple[int, ...] | None, b: tuple[int, ...]) -> bool:
        if (a, b) not in self.pairs:
            whole = [] if a is None else [a]
            self.pairs[a, b] = self.merged([(s,) for s in (a or ()) + b]) == [*whole, b]
        return self.pairs[a, b]

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The move from a state on a symbol: the next state and the change in the number of tokens."""
        window, history = self.states[state]
        text = (*window, symbol)
        # history[k] belongs to the prefix that ends k symbols into the window
        for k in range(len(text)):
            token = text[k:]
            if token in self.tokens and self.canonical(history[k][0], token):
                break
        else:
            raise ValueError("the vocabulary lacks a symbol")
        change = history[k][1] + 1
        entries = (*history, (token, change))
        start = next((i for i in range(len(text)) if text[i:] in self.prefixes), len(text))
        key = (text[start:], tuple((t, c - change) for t, c in entries[start:]))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][symbol] = got = (self.number[key], change)
        return got

    def count(self, word: bytes) -> int:
        if len(self.states) > REMEMBERED or len(self.pairs) > REMEMBERED:
            self.reset()
        state, n, moves = 0, 0, self.moves
        for symbol in word[:-1]:
            state, change = moves[state].get(symbol) or self.compile(state, symbol)
            n += change
        last = word[-1] + 256
        return n + (moves[state].get(last) or self.compile(state, last))[1]


class WordCounts(dict):
    """Tokens of each word (bytes without ASCII white space), worked out when first asked for."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer
        self.special = regex.compile("|".join(map(regex.escape, sorted(transducer.specials, key=len, reverse=True))) or r"(?!)")
        self.piece = regex.compile(PIECE)
        self.pieces: dict[str, int] = {}

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.count(word)
        return n

    def count(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        n = len(self.special.findall(text)) if "<" in text else 0
        for part in self.special.split(text) if n else [text]:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # letter by letter, as a final sigma would otherwise get its own form
            plain = part.lower() if "\u03a3" not in part else "".join(c.lower() for c in part)
            for piece in [plain] if plain.isascii() and plain.isalpha() else self.piece.findall(plain):
                if (k := self.pieces.get(piece)) is None:
                    k = self.pieces[piece] = self.transducer.count(piece.encode())
                n += k
        return n

    def trim(self) -> None:
        for kept in (self, self.pieces):
            if len(kept) > REMEMBERED:
                kept.clear()


@lru_cache(maxsize=1)
def word_counts(path: str) -> WordCounts:
    with open(path, encoding="utf-8") as f:
        return WordCounts(Transducer(json.load(f)))


#: A chunk's state map: (head, tokens, tail), or (text, None, None) if it holds no reset.
Map = tuple[bytes, int | None, bytes | None]


def chunk_map(text: bytes, counts: WordCounts) -> Map:
    counts.trim()
    words = text.split()
    if not text or (len(words) == 1 and len(words[0]) == len(text)):
        plain = text.decode("utf-8", "replace")
        cuts = [m.start() for m in RESET.finditer(plain)]
        if not cuts or any(len(set(s[1:]) & set(RESET_MARKS)) for s in counts.transducer.specials):
            return text, None, None
        head, middle, tail = (p.encode() for p in (plain[: cuts[0]], plain[cuts[0] : cuts[-1]], plain[cuts[-1] :]))
        return head, counts.count(middle) if middle else 0, tail
    head = words.pop(0) if words and text[:1] not in ASCII_SPACE else b""
    tail = words.pop() if words and text[-1:] not in ASCII_SPACE else b""
    return head, sum(map(counts.__getitem__, words)), tail


def compose(a: Map, b: Map, counts: WordCounts) -> Map:
    if a[1] is None:
        return (a[0] + b[0], *b[1:])
    if b[1] is None:
        return (*a[:2], a[2] + b[0])
    middle = a[2] + b[0]
    return a[0], a[1] + b[1] + (counts[middle] if middle else 0), b[2]


def total(m: Map, counts: WordCounts) -> int:
    return sum(counts[w] for w in (m[0], m[2]) if w) + (m[1] or 0)


def scan(maps: list[Map], counts: WordCounts) -> Map:
    """Compose neighbours pairwise until one map is left."""
    while len(maps) > 1:
        maps = [reduce(lambda a, b: compose(a, b, counts), maps[i : i + 2]) for i in range(0, len(maps), 2)]
    return maps[0]


MAPS = "row long, k int, head binary, n long, tail binary"


def _composed(maps: DataFrame, vocabulary_path: str) -> DataFrame:
    """One round of the scan: FAN neighbouring maps of a text become one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = word_counts(vocabulary_path)
        for part in whole_groups(batches, ["row", "g"]):
            out = []
            for (row, g), group in part.groupby(["row", "g"], sort=False):
                counts.trim()
                maps = [(h, None if pd.isna(n) else int(n), t) for h, n, t in zip(group["head"], group["n"], group["tail"], strict=True)]
                out.append((row, g, *scan(maps, counts)))
            yield pd.DataFrame(out, columns=["row", "k", "head", "n", "tail"]).astype({"n": "Int64"})

    near = maps.withColumn("g", F.floor(F.col("k") / FAN).cast("int"))
    return near.repartition("row", "g").sortWithinPartitions("row", "g", "k").mapInPandas(run, MAPS)


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit. The vocabulary file must lie at the path on every executor."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def count_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary_path)
        for batch in batches:
            n = [total(chunk_map(t, counts), counts) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary_path)
        for batch in batches:
            heads, n, tails = zip(*[chunk_map(t, counts) for t in batch.column("piece").to_pylist()], strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_bytes", "k")), pa.array(heads, pa.binary()), pa.array(n, pa.int64()), pa.array(tails, pa.binary())], names=["row", "doc_id", "n_bytes", "k", "head", "n", "tail"])

    # nearly all texts are one chunk and stay where they are
    whole = rows.filter(F.length("text") <= chunk).select("doc_id", "n_bytes", F.col("text").cast("binary").alias("text")).mapInArrow(count_whole, "doc_id long, n_bytes long, n_tokens long")
    long = rows.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    last = F.floor((F.length("text") - 1) / chunk).cast("int")
    pieces = long.select("row", "doc_id", "n_bytes", "text", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("row", "doc_id", "n_bytes", "k", F.substr("text", F.col("k") * chunk + 1, F.lit(chunk)).cast("binary").alias("piece"))
    # the written maps fix the row numbers
    mapped = checkpointed(pieces.mapInArrow(map_chunks, "row long, doc_id long, n_bytes long, k int, head binary, n long, tail binary"))
    maps, left = mapped.select("row", "k", "head", "n", "tail"), (mapped.agg(F.max("k")).first()[0] or 0) + 1
    while left > 1:
        maps, left = checkpointed(_composed(maps, vocabulary_path)), -(-left // FAN)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary_path)
        for batch in batches:
            maps = zip(*(batch.column(c).to_pylist() for c in ("head", "n", "tail")), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([total(m, counts) for m in maps], pa.int64())], names=["row", "n_tokens"])

    counted = mapped.filter("k = 0").select("row", "doc_id", "n_bytes").join(maps.mapInArrow(finish, "row long, n_tokens long"), "row").drop("row")
    return whole.unionByName(counted).withColumn("over_limit", F.col("n_tokens") > limit)
