"""The synthetic layout of `quire.sources.layout` on arrays: all words of some documents at once, cut out of the bytes of their texts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa

from quire.sources.layout import ADVANCE, LEADING, LINES_PER_PAGE, MARGIN, RUNS_PER_LINE


@dataclass
class Runs:
    """Runs of documents, one entry of every array for each; a text is `size` bytes of `buf` from `at`, of `chars` characters."""

    doc: np.ndarray
    page: np.ndarray
    run_no: np.ndarray
    x: np.ndarray
    y: np.ndarray
    em: np.ndarray
    advance: np.ndarray
    font: np.ndarray
    at: np.ndarray
    size: np.ndarray
    chars: np.ndarray
    buf: np.ndarray
    flags: dict[str, np.ndarray] = field(default_factory=dict)
    laid_line: np.ndarray | None = None
    #: What a text had before letters were joined, if not the same.
    chars_before: np.ndarray | None = None

    def __post_init__(self) -> None:
        # half the bytes to move
        for k, v in vars(self).items():
            if k != "at" and isinstance(v, np.ndarray) and v.dtype == np.int64:
                setattr(self, k, v.astype(np.int32))

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, which: np.ndarray) -> Runs:
        """The runs at these places, or where true."""
        own = {k: v[which] for k, v in vars(self).items() if isinstance(v, np.ndarray) and k != "buf"}
        return replace(self, **own, flags={k: v[which] for k, v in self.flags.items()})


def text_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each begins and ends in them."""
    texts = texts.cast(pa.large_string()) if len(texts) else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def leads(buf: np.ndarray) -> np.ndarray:
    """Whether a byte is the first of its character."""
    return (buf & 0xC0) != 0x80


def counted(flags: np.ndarray) -> np.ndarray:
    """How many are true before each place, and in all."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Whether any of the keys differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def spread(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For stretches that begin at these places: the lengths of all, and for each place the one it belongs to."""
    lengths = np.diff(np.append(first, n))
    return lengths, np.repeat(np.arange(len(first)), lengths)


def layout(texts: pa.ListArray) -> Runs:
    """The runs of `layout_runs`; texts: those of each document, of which there is more than one only where rows share an id."""
    row_doc = np.repeat(np.arange(len(texts)), np.diff(texts.offsets.to_numpy()))
    buf, offs = text_parts(texts.flatten())
    blank = (buf == 32) | (buf == 10)
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    full = offs[1:] > offs[:-1]
    begin, end = offs[:-1][full], offs[1:][full] - 1
    first[begin], last[end] = ~blank[begin], ~blank[end]
    at, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = len(at)
    row = np.searchsorted(offs, at, side="right") - 1
    broken = counted(buf == 10)
    para = broken[at] - broken[offs[row]]
    doc = row_doc[row] if n else np.zeros(0, np.int64)
    para_first = np.flatnonzero(starts_of(row, para))
    para_len, of = spread(para_first, n)
    k, para_len = np.arange(n) - para_first[of], para_len[of]
    if len(row_doc) > len(np.unique(row_doc)):
        order = np.lexsort((k, para, doc))
        at, stop, para, doc, k, para_len = (v[order] for v in (at, stop, para, doc, k, para_len))
    line = np.cumsum(k % RUNS_PER_LINE == 0) - 1
    # equal places of rows that share an id are peers, which a running sum counts together
    peer = np.append(np.flatnonzero(starts_of(doc, para, k))[1:], n) - 1
    line = np.repeat(line[peer], np.diff(np.append(-1, peer)))
    doc_first = np.flatnonzero(starts_of(doc))
    _, of = spread(doc_first, n)
    run_no = np.arange(n) - doc_first[of]
    before = np.append(0, np.cumsum(k % RUNS_PER_LINE == 0))[doc_first] if n else np.zeros(0, np.int64)
    line = line - before[of]
    size = stop - at
    chars = size if not len(buf) or buf.max() < 128 else (c := counted(leads(buf)))[stop] - c[at]
    short = para_len <= 6
    step = chars * ADVANCE + np.where(short, 4, 3)
    passed = np.cumsum(step) - step
    line_first = np.flatnonzero(starts_of(doc, line))
    _, of = spread(line_first, n)
    no = np.zeros(n, bool)
    return Runs(
        doc, line // LINES_PER_PAGE, run_no, MARGIN + passed - passed[line_first][of], line % LINES_PER_PAGE * LEADING + MARGIN, np.where(short, 14, 10), chars * ADVANCE, np.ones(n, np.int64),
        at, size, chars, buf, {"bold": short, "skewed": no}, line,
    )


def in_line(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a laid line: its number, and how many characters stand before it."""
    n = len(runs)
    first = np.flatnonzero(starts_of(runs.doc, runs.laid_line))
    _, of = spread(first, n)
    passed = np.cumsum(runs.chars) - runs.chars
    return np.arange(n) - first[of], passed - passed[first][of]


def letters(runs: Runs, more: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every character of the runs: the run, its number in it, its place in the bytes, and its size."""
    begin = np.append(np.flatnonzero(leads(runs.buf)), len(runs.buf))
    before = counted(leads(runs.buf))[runs.at]
    of = np.repeat(np.arange(len(runs)), runs.chars)
    k = np.arange(len(of)) - np.repeat(np.cumsum(runs.chars) - runs.chars, runs.chars)
    j = before[of] + k
    return of, k, begin[j], begin[j + 1] - begin[j]


def tracked(runs: Runs) -> Runs:
    """`tracked_runs`: a run for each character."""
    word, passed = in_line(runs)
    of, k, at, size = letters(runs)
    each, n = runs.take(of), len(of)
    no = np.zeros(n, bool)
    return replace(each, run_no=each.run_no * 1000 + k, x=MARGIN + 9 * (passed[of] + k) + 6 * word[of], advance=np.full(n, ADVANCE), at=at, size=size, chars=np.ones(n, np.int64), flags={"bold": no, "skewed": no})


def joined_runs(parts: list[Runs]) -> Runs:
    """The runs of all parts, whose texts lie in the same bytes."""
    own = {k: np.concatenate([getattr(p, k) for p in parts]) for k, v in vars(parts[0]).items() if isinstance(v, np.ndarray) and k != "buf"}
    return replace(parts[0], **own, flags={k: np.concatenate([p.flags[k] for p in parts]) for k in parts[0].flags})


def with_spaces(runs: Runs, scale: int) -> Runs:
    """A space glyph after every run, 3 points wide."""
    n = len(runs)
    buf = np.append(runs.buf, np.uint8(32))
    space = replace(runs, run_no=runs.run_no * scale + 1, x=runs.x + runs.advance, advance=np.full(n, 3), at=np.full(n, len(runs.buf)), size=np.ones(n, np.int64), chars=np.ones(n, np.int64), buf=buf)
    return joined_runs([replace(runs, run_no=runs.run_no * scale, buf=buf), space])


def mixed(runs: Runs) -> Runs:
    """`mixed_runs`: the words in six manners, by line. The runs of a manner come together."""
    word, passed = in_line(runs)
    manner = runs.laid_line % 6
    spaced = runs.take(manner == 3)
    # letters set apart: each with a space behind it, but for the last
    of, k, at, size = letters(spaced)
    last = k == spaced.chars[of] - 1
    length = size + ~last
    place = np.cumsum(length) - length
    apart = np.full(int(length.sum()), 32, np.uint8)
    for shift in range(int(size.max()) if len(size) else 0):
        has = size > shift
        apart[place[has] + shift] = runs.buf[at[has] + shift]
    buf = np.concatenate([runs.buf, apart])
    runs = replace(runs, buf=buf, run_no=runs.run_no * 1000)
    begin = np.flatnonzero(k == 0)
    total = np.add.reduceat(length, begin) if len(begin) else np.zeros(0, np.int64)
    set_apart = replace(runs.take(manner == 3), at=len(spaced.buf) + place[begin], size=total, chars=spaced.chars * 2 - 1)
    spaces = with_spaces(runs.take(manner == 2), 1)

    def each(which: np.ndarray) -> Runs:
        some, w, p = runs.take(which), word[which], passed[which]
        of, k, at, size = letters(some)
        out, n = some.take(of), len(of)
        return replace(out, run_no=out.run_no + k, x=MARGIN + 9 * (p[of] + k) + 6 * w[of], advance=np.full(n, ADVANCE), at=at, size=size, chars=np.ones(n, np.int64))

    some = each(manner == 4)
    other, w = runs.take(manner == 5), word[manner == 5]
    raised = w % 3 == 1
    other = replace(other, em=np.where(raised, 6, other.em), y=other.y - 3 * raised, font=np.full(len(other), 2), flags=other.flags | {"skewed": w % 10 == 7})
    parts = [runs.take(manner == 0), each(manner == 1), spaces, set_apart, some.take(some.x < MARGIN + 45), other]
    return joined_runs([replace(p, buf=spaces.buf) for p in parts])
