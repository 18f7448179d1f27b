"""Lines from runs on arrays: what `lines` and `glyph_join` define on columns, for all runs of some documents at once.

The functions take whole documents, which come one after the other. A line's runs lie side by side from left to right, and what is read off
a line is a sum or a sort within its stretch. Sums of gaps are added up in the order in which the columns add them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.functions.text import OPERATORS, WS_CHARS
from quire.operators.glyph_join import CELL_GAP, DEFAULT, LEAST, LOOSER, MOST, TIGHTER, TRIES
from quire.sources.layout_arrays import Runs, counted, leads, spread, starts_of, text_parts

SAME_LINE_TENTHS, BOLD_SHARE, SCANNED = 4, 0.6, 40
SCRIPT_SIZE, SCRIPT_OFFSET = 0.75, (0.2, 0.6)
#: Separators by code, and the marks they leave among the styles.
NOTHING, SPACE, CELL = 0, 1, 2
SEPARATORS = np.frombuffer(b"\0 \x1f", np.uint8)
PLAIN, BETWEEN = ord("0"), ord("_")
#: White space of one byte, and of more by the bytes they begin with.
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in WS_CHARS if ord(c) < 128]] = True
_BLANKS = [np.frombuffer(c.encode(), np.uint8) for c in WS_CHARS if ord(c) >= 128]
_BLANK_LEADS, _BLANK_ENDS = np.zeros(256, bool), np.zeros(256, bool)
_BLANK_LEADS[[b[0] for b in _BLANKS]] = _BLANK_ENDS[[b[-1] for b in _BLANKS]] = True


def blanks(buf: np.ndarray, cell: bool = True) -> np.ndarray:
    """Which bytes are white space as browsers know it; cell: cell breaks too."""
    found = _BLANK[buf]
    if cell:
        found |= buf == 31
    maybe = np.flatnonzero(_BLANK_LEADS[buf])
    for b in _BLANKS if len(maybe) else []:
        at = maybe[maybe + len(b) <= len(buf)]
        for shift, byte in enumerate(b):
            at = at[buf[at + shift] == byte]
        for shift in range(len(b)):
            found[at + shift] = True
    return found


def gathered(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all texts, one after the other."""
    if len(size) and size.max() == 1 == size.min():
        return buf[at]
    out = np.cumsum(size) - size
    return buf[np.repeat(at - out, size) + np.arange(int(size.sum()))]


def strings(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


def texts_of(runs: Runs) -> pa.Array:
    return strings(gathered(runs.buf, runs.at, runs.size), np.append(0, np.cumsum(runs.size)))


def stripped_chars(runs: Runs) -> np.ndarray:
    """The characters of each text without white space at its ends."""
    out = runs.chars.copy()
    full = np.flatnonzero(runs.size > 0)
    a, b = runs.buf[runs.at[full]], runs.buf[runs.at[full] + runs.size[full] - 1]
    odd = full[_BLANK[a] | _BLANK_LEADS[a] | _BLANK[b] | _BLANK_ENDS[b]]
    if len(odd):
        out[odd] = pc.utf8_length(pc.utf8_trim(texts_of(runs.take(odd)), WS_CHARS)).to_numpy()
    return out


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, values.dtype)


def page_facts(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each page of sorted runs: its first run, its characters and its turned runs."""
    first = np.flatnonzero(starts_of(runs.doc, runs.page))
    return first, summed(stripped_chars(runs), first), summed((runs.flags["skewed"] & (runs.size > 0)).astype(np.int64), first)


def in_order(keys: tuple[np.ndarray, ...]) -> bool:
    """Whether rows are sorted by these keys."""
    open_, ok = np.ones(max(len(keys[0]) - 1, 0), bool), True
    for k in keys:
        ok = ok and not (open_ & (k[1:] < k[:-1])).any()
        open_ &= k[1:] == k[:-1]
    return ok


def place(v: np.ndarray) -> np.ndarray:
    """For sorting: what has no place comes first."""
    return np.where(np.isnan(v), -np.inf, v) if v.dtype.kind == "f" else v


def order_by(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by these keys; whole numbers are put together as long as they fit into one."""
    merged: list[np.ndarray] = []
    room = 0
    for k in keys:
        if k.dtype.kind != "i" or not len(k):
            merged.append(k)
            room = 0
            continue
        low = int(k.min())
        width = int(k.max()) - low + 1
        if room > width:
            merged[-1] = merged[-1] * width + (k - low)
            room //= width
        else:
            merged.append(k.astype(np.int64) - low)
            room = 2**62 // width
    return np.argsort(merged[0], kind="stable") if len(merged) == 1 else np.lexsort(merged[::-1])


def sorted_runs(runs: Runs) -> Runs:
    """In the order in which lines are found in pages."""
    keys = (runs.doc, runs.page, place(runs.y), place(runs.x), runs.run_no)
    return runs if in_order(keys) else runs.take(order_by(*keys))


@dataclass
class Lines:
    """Runs in the order of their lines, and where each line begins."""

    runs: Runs
    line_no: np.ndarray
    first: np.ndarray
    count: np.ndarray
    of: np.ndarray

    def __len__(self) -> int:
        return len(self.first)

    @property
    def doc(self) -> np.ndarray:
        return self.runs.doc[self.first]

    @property
    def page(self) -> np.ndarray:
        return self.runs.page[self.first]


def grouped(runs: Runs, line_no: np.ndarray) -> Lines:
    """Lines of runs that have their line's number, each from left to right."""
    keys = (runs.doc, runs.page, line_no, place(runs.x), place(runs.y), runs.run_no)
    if not in_order(keys):
        order = order_by(*keys)
        runs, line_no = runs.take(order), line_no[order]
    first = np.flatnonzero(starts_of(runs.doc, runs.page, line_no))
    count, of = spread(first, len(runs))
    return Lines(runs, line_no[first], first, count, of)


def cluster(runs: Runs) -> tuple[Runs, np.ndarray]:
    """The upright runs in order of their page, each with the number of its line."""
    if runs.flags["skewed"].any():
        runs = runs.take(~runs.flags["skewed"])
    runs = sorted_runs(runs)
    if not len(runs):
        return runs, np.zeros(0, np.int64)
    opens = starts_of(runs.doc, runs.page)
    starts = opens.copy()
    starts[1:] |= np.abs(runs.y[1:] - runs.y[:-1]) * 10 >= np.maximum(runs.em[1:], runs.em[:-1]) * SAME_LINE_TENTHS
    no = np.cumsum(starts) - 1
    first = np.flatnonzero(opens)
    _, of = spread(first, len(runs))
    return runs, no - no[first][of]


@dataclass
class Gaps:
    """Before every run but the first of its line, as entries of arrays as long as the runs: `has`, the gap, whether a space is there, and the width of a space glyph at either side (nan for none)."""

    has: np.ndarray
    gap: np.ndarray
    spaced: np.ndarray
    space: np.ndarray


def gaps(lines: Lines) -> Gaps:
    r, n = lines.runs, len(lines.runs)
    has = np.ones(n, bool)
    has[lines.first] = False
    em = np.ones(n)
    em[1:] = np.maximum(r.em[1:], r.em[:-1])
    em[em == 0] = 1.0
    gap, space, spaced = np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
    gap[1:] = (r.x[1:] - r.x[:-1] - r.advance[:-1]) / em[1:]
    full = r.size > 0
    begins, ends = np.zeros(n, bool), np.zeros(n, bool)
    begins[full], ends[full] = r.buf[r.at[full]] == 32, r.buf[r.at[full] + r.size[full] - 1] == 32
    spaced[1:] = ends[:-1] | begins[1:]
    glyph = begins & (r.size == 1)
    if glyph.any():
        space[1:] = np.where(glyph[:-1], r.advance[:-1], np.where(glyph[1:], r.advance[1:], np.nan)) / em[1:]
    space[~has] = np.nan
    return Gaps(has, gap, spaced, space)


def medians(values: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """The median of the values of each line, nan without any."""
    out = np.full(n, np.nan)
    if len(values):
        order = np.lexsort((values, line))
        v, g = values[order], line[order]
        first = np.flatnonzero(starts_of(g))
        count, _ = spread(first, len(v))
        out[g[first]] = (v[first + (count - 1) // 2] + v[first + count // 2]) / 2
    return out


def clamp(ratio: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(ratio, LEAST), MOST)


def space_ratio(lines: Lines, g: Gaps) -> np.ndarray:
    """nan where the columns' is null."""
    n = len(lines)
    wide = g.has & (g.space > 0)
    if not wide.any():
        return np.full(n, np.nan)
    spaces = medians(g.space[wide], lines.of[wide], n)
    narrow = g.has & np.isnan(g.space) & ~np.isnan(spaces)[lines.of]
    tracking = medians(g.gap[narrow], lines.of[narrow], n)
    return clamp(np.maximum(0.0, np.where(np.isnan(tracking), 0.0, tracking)) + 0.45 * spaces)


def cluster_ratio(lines: Lines, g: Gaps, wanted: np.ndarray | None = None) -> np.ndarray:
    """nan where the columns' is null; wanted: the lines to look at."""
    n, out = len(lines), np.full(len(lines), np.nan)
    sound = g.has & (g.gap >= -0.05) & (g.gap <= 3)
    among = counted(sound)
    ends = np.append(lines.first[1:], len(lines.runs))
    size = among[ends] - among[lines.first]
    fit = (lines.count - 1 >= 6) & (size >= 6)
    if wanted is not None:
        fit &= wanted
    if not fit.any():
        return out
    low, high = np.minimum.reduceat(np.where(sound, g.gap, np.inf), lines.first), np.maximum.reduceat(np.where(sound, g.gap, -np.inf), lines.first)
    fit[fit] &= high[fit] - low[fit] >= 0.2
    values, begin = g.gap[sound], among[lines.first]
    # lines of about one length at once, a row each; those left over are longer than any before
    width, left = 8, np.flatnonzero(fit)
    while len(left):
        rows, left = left[size[left] <= width], left[size[left] > width]
        for part in np.array_split(rows, max(1, len(rows) * width // 2_000_000)) if len(rows) else []:
            out[part] = _split(values, begin[part], size[part], width)
        width = width * 3 // 2
    return out


def _split(values: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """`cluster_ratio` of lines with so many values from these places."""
    place = np.arange(width)
    within = place < size[:, None]
    v = np.full((len(size), width), np.inf)
    v[within] = values[(begin[:, None] + place)[within]]
    v.sort(axis=1)
    v[~within] = 0.0
    # added up from the first value on, as a fold does
    total_to = np.cumsum(v, axis=1)
    total = total_to[np.arange(len(size)), size - 1][:, None]
    n, i = size[:, None].astype(float), place[1:].astype(float)
    low = total_to[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_low, mean_high, share = low / i, (total - low) / (n - i), i / n
        variance = share * (1 - share) * np.square(mean_low - mean_high)
    variance[~within[:, 1:]] = -1.0
    best = np.argmax(variance, axis=1)
    row = np.arange(len(size))
    a, b = mean_low[row, best], mean_high[row, best]
    two = (variance[row, best] > 0) & (b - a >= 0.2) & ((best + 1) / size >= 0.4)
    return np.where(two, clamp((a + b) / 2), np.nan)


def own_ratio(lines: Lines, g: Gaps) -> np.ndarray:
    spaces = space_ratio(lines, g)
    return np.where(np.isnan(spaces), cluster_ratio(lines, g, np.isnan(spaces)), spaces)


def separators(lines: Lines, g: Gaps, ratio: np.ndarray) -> np.ndarray:
    """The code of what goes before each run, its line joined at a threshold."""
    least = np.maximum(ratio, LEAST)[lines.of]
    return np.where(g.has & (g.gap >= CELL_GAP), CELL, np.where(g.has & (g.gap >= least) & ~g.spaced, SPACE, NOTHING)).astype(np.int8)


def joined(lines: Lines, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of the lines: their bytes, and where each line begins and ends in them."""
    r, put = lines.runs, (between != NOTHING).astype(np.int64)
    size = r.size + put
    end = np.cumsum(size)
    begin = end - size
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    has = put.astype(bool)
    out[begin[has]] = SEPARATORS[between[has]]
    if len(r.size) and r.size.max() == 1 == r.size.min():
        out[begin + put] = r.buf[r.at]
    elif len(out):
        own = np.ones(len(out), bool)
        own[begin[has]] = False
        out[own] = gathered(r.buf, r.at, r.size)
    return out, np.append(begin[lines.first], len(out))


OK, TOO_LOW, TOO_HIGH = 0, 1, 2


def verdicts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """`join_verdict` of texts."""
    n = len(offs) - 1
    out = np.zeros(n, np.int8)
    blank = blanks(buf)
    lead = leads(buf) if len(buf) and buf.max() >= 128 else None
    word = ~blank
    begin = word.copy()
    begin[1:] &= blank[:-1]
    inner = offs[:-1][offs[:-1] < len(buf)]
    begin[inner] = word[inner]
    tokens = counted(begin)
    n_tokens = tokens[offs[1:]] - tokens[offs[:-1]]
    chars = counted(word if lead is None else word & lead)
    letters = chars[offs[1:]] - chars[offs[:-1]]
    at = np.flatnonzero(begin)
    # a token's letters are those up to the next token, as white space counts none
    length = np.diff(np.append(chars[at], chars[-1]))
    ones = counted(length == 1)
    singles = ones[tokens[offs[1:]]] - ones[tokens[offs[:-1]]]
    apart = counted((buf == 32) | (buf == 31))
    with np.errstate(divide="ignore", invalid="ignore"):
        loose = (n_tokens >= 4) & ((letters / n_tokens < 2) | (singles / n_tokens > 0.6))
    out[(letters > 40) & (apart[offs[1:]] == apart[offs[:-1]])] = TOO_HIGH
    out[loose] = TOO_LOW
    return out


def subset(lines: Lines, g: Gaps, which: np.ndarray) -> tuple[Lines, Gaps]:
    """Some of the lines, in their order."""
    count = lines.count[which]
    first = np.cumsum(count) - count
    at = np.repeat(lines.first[which] - first, count) + np.arange(int(count.sum()))
    return Lines(lines.runs.take(at), lines.line_no[which], first, count, np.repeat(np.arange(len(which)), count)), Gaps(g.has[at], g.gap[at], g.spaced[at], g.space[at])


class Texts:
    """Texts of lines as they are found; a later one takes the place of one before."""

    def __init__(self, n: int) -> None:
        self.parts: list[pa.Array] = []
        self.n, self.at = 0, np.full(n, -1, np.int64)

    def put(self, which: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> None:
        self.parts.append(strings(buf, offs))
        self.at[which] = self.n + np.arange(len(which))
        self.n += len(which)

    def array(self) -> pa.Array:
        whole = pa.concat_arrays(self.parts) if self.parts else pa.array([], pa.large_string())
        return whole if np.array_equal(self.at, np.arange(len(whole))) else whole.take(pa.array(self.at))


def join_with_retries(lines: Lines, g: Gaps, ratio: np.ndarray, texts: Texts, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins these lines at thresholds, which are moved twice at most; the thresholds at last, and whether a text stays uncertain. Their texts are put."""
    some, h = (lines, g) if len(which) == len(lines) else subset(lines, g, which)
    ratio, left = ratio.copy(), np.arange(len(which))
    buf, offs = joined(some, separators(some, h, ratio))
    texts.put(which, buf, offs)
    found = verdicts(buf, offs)
    for _ in range(TRIES):
        bad = np.flatnonzero(found != OK)
        left = left[bad]
        if not len(left):
            break
        ratio[left] *= np.where(found[bad] == TOO_LOW, TIGHTER, LOOSER)
        some, h = subset(some, h, bad)
        buf, offs = joined(some, separators(some, h, ratio[left]))
        texts.put(which[left], buf, offs)
        found = verdicts(buf, offs)
    unsure = np.zeros(len(which), bool)
    unsure[left[found != OK] if len(left) else left] = True
    return ratio, unsure


def calibrated(lines: Lines) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """`calibrated_text`: text, ratio and uncertain of each line."""
    g, n = gaps(lines), len(lines)
    own = own_ratio(lines, g)
    texts, single = Texts(n), lines.count == 1
    ratio, unsure = join_with_retries(lines, g, np.where(np.isnan(own), DEFAULT, own), texts, np.arange(n))
    one = np.flatnonzero(single)
    if len(one):
        some, h = subset(lines, g, one)
        texts.put(one, *joined(some, np.zeros(len(one), np.int8)))
    ratio[single], unsure[single] = DEFAULT, False
    return texts.array(), ratio, unsure


#: Rounds in which thresholds are passed on for all lines at once, more of them while no more lines than these wait in a stretch on average; lines that still wait are gone through one by one.
ROUNDS, PER_STRETCH = 6, 100


def taken_thresholds(lines: Lines, g: Gaps, taken_before: dict | None = None) -> tuple[Texts, np.ndarray, np.ndarray]:
    """Texts, ratios and uncertain of lines whose thresholds are passed on among those of a document that begin with one font and size.

    A line with a threshold of its own ends a stretch; within one, all lines are tried at what they take over, the first
    that moved it is settled with those before, and the others are tried once more. taken_before: what was taken over last, by document, font and size, from which they go on and which is kept up.
    """
    n = len(lines)
    texts, ratio, unsure = Texts(n), np.full(n, DEFAULT), np.zeros(n, bool)
    if not n:
        return texts, ratio, unsure
    own = own_ratio(lines, g)
    one, several = np.flatnonzero(lines.count == 1), lines.count > 1
    if len(one):
        some, _ = subset(lines, g, one)
        texts.put(one, *joined(some, np.zeros(len(one), np.int8)))
    sure = np.flatnonzero(several & ~np.isnan(own))
    passes = np.full(n, np.nan)
    if len(sure):
        ratio[sure], unsure[sure] = join_with_retries(lines, g, own[sure], texts, sure)
        passes[sure] = np.where(unsure[sure], np.nan, ratio[sure])
    font, em = lines.runs.font[lines.first], np.floor(lines.runs.em[lines.first] * 10 + 0.5)
    doc = lines.doc
    order = np.lexsort((np.arange(n), em, font, doc))
    begins = starts_of(doc[order], font[order], em[order])
    carried = passes[order]
    stretch = np.cumsum(begins | np.append(False, ~np.isnan(carried[:-1]))) - 1
    first = np.flatnonzero(starts_of(stretch))
    initial = np.full(len(first), DEFAULT)
    later = ~begins[first]
    initial[later] = carried[first[later] - 1]
    if taken_before:
        for s in np.flatnonzero(begins[first]):
            i = order[first[s]]
            initial[s] = taken_before.get((doc[i], font[i], em[i]), DEFAULT)
    waits = np.flatnonzero((several & np.isnan(own))[order])
    which, of = order[waits], stretch[waits]
    now = initial.copy()
    rounds = 0
    # a round settles a line of each stretch at least
    while len(which) and (rounds < ROUNDS or len(which) < PER_STRETCH * np.count_nonzero(starts_of(of))):
        rounds += 1
        tried = now[of]
        # lines are joined in their own order
        line_order = np.argsort(which, kind="stable")
        r, u = np.empty(len(which)), np.empty(len(which), bool)
        r[line_order], u[line_order] = join_with_retries(lines, g, tried[line_order], texts, which[line_order])
        ratio[which], unsure[which] = r, u
        moved = np.flatnonzero(~u & (r != tried))
        if not len(moved):
            which, of = which[:0], of[:0]
            break
        firsts = moved[starts_of(of[moved])]
        now[of[firsts]] = r[firsts]
        after = np.full(len(now), len(which))
        after[of[firsts]] = firsts
        left = np.arange(len(which)) > after[of]
        which, of = which[left], of[left]
    for i, s in zip(which, of, strict=True):
        at = np.array([i])
        r, u = join_with_retries(lines, g, now[s : s + 1], texts, at)
        ratio[i], unsure[i] = r[0], u[0]
        if not u[0]:
            now[s] = r[0]
    if taken_before is not None:
        last = np.append(first[1:], n) - 1
        closing = np.append(begins[first][1:], True)
        for s in np.flatnonzero(closing):
            i = order[last[s]]
            taken_before[doc[i], font[i], em[i]] = now[s] if np.isnan(carried[last[s]]) else carried[last[s]]
    return texts, ratio, unsure


def round_em(em: np.ndarray) -> np.ndarray:
    return np.floor(em * 10 + 0.5) / 10


def modal_em(lines: Lines, weight: np.ndarray) -> np.ndarray:
    """The em that most characters of each line have, of equals the one met first."""
    em = round_em(lines.runs.em)
    if not len(em):
        return em
    out = em[lines.first]
    mixed = np.flatnonzero(np.minimum.reduceat(em, lines.first) != np.maximum.reduceat(em, lines.first))
    if len(mixed):
        take = np.isin(lines.of, mixed)
        line, size, w, place = lines.of[take], em[take], weight[take], np.flatnonzero(take)
        order = np.lexsort((place, size, line))
        line, size, w, place = line[order], size[order], w[order], place[order]
        first = np.flatnonzero(starts_of(line, size))
        line, size, w, place = line[first], size[first], summed(w, first), place[first]
        best = np.lexsort((place, -w, line))
        best = best[starts_of(line[best])]
        out[line[best]] = size[best]
    return out


_GLYPH, _MARK = r"[\p{L}\p{N}]", r"[^ \p{L}\p{N}]"
#: For texts whose characters are all of the first plane, as `text.looks_tracked`.
TRACKED = rf"(?s)(?:^| ){_GLYPH}(?:(?: {_MARK})* {_GLYPH}){{3}}(?: |\z)"
OPERATOR = rf"(?:^| )[{''.join(map(re.escape, OPERATORS))}](?: |\z)"
# a character beyond the first plane stands for two: it is no token of one
_WIDE = re.compile("[\U00010000-\U0010FFFF]")


def detrack(runs: Runs) -> tuple[Runs, np.ndarray]:
    """The runs with letters that were set apart joined, and which those are."""
    changed = np.zeros(len(runs), bool)
    # the shortest such text has four letters and three spaces
    maybe = np.flatnonzero(runs.size >= 7)
    spaces = counted(runs.buf == 32)
    maybe = maybe[spaces[runs.at[maybe] + runs.size[maybe]] - spaces[runs.at[maybe]] >= 3]
    if not len(maybe):
        return runs, changed
    some = runs.take(maybe)
    texts = texts_of(some)
    wide = counted(runs.buf >= 0xF0)
    shown = texts
    if wide[-1]:
        odd = np.flatnonzero(wide[some.at + some.size] > wide[some.at])
        if len(odd):
            plain = texts.to_pylist()
            for i in odd:
                plain[i] = _WIDE.sub("..", plain[i])
            shown = pa.array(plain, pa.large_string())
    found = pc.and_not(pc.match_substring_regex(shown, TRACKED), pc.match_substring_regex(shown, OPERATOR)).to_numpy(zero_copy_only=False).astype(bool)
    at = maybe[found]
    changed[at] = True
    if not len(at):
        return runs, changed
    whole = gathered(runs.buf, runs.at[at], runs.size[at])
    kept = whole != 32
    line = np.repeat(np.arange(len(at)), runs.size[at])
    size = np.bincount(line[kept], minlength=len(at))
    out = replace(runs, at=runs.at.copy(), size=runs.size.copy(), chars=runs.chars.copy(), buf=np.concatenate([runs.buf, whole[kept]]), chars_before=runs.chars)
    out.at[at] = len(runs.buf) + np.cumsum(size) - size
    out.chars[at] -= runs.size[at] - size
    out.size[at] = size
    return out, changed


LINE = pa.struct([
    ("line_no", pa.int32()), ("x", pa.float64()), ("w", pa.float64()), ("y", pa.float64()), ("h", pa.float64()), ("bold", pa.bool_()), ("n_runs", pa.int64()), ("detracked", pa.bool_()), ("baseline_y", pa.float64()), ("em", pa.float64()),
    ("scripts", pa.list_(pa.struct([("run_no", pa.int32()), ("script", pa.string())]))), ("styles", pa.string()), ("text", pa.string()), ("ratio", pa.float64()), ("uncertain", pa.bool_()),
])
PAGE = pa.struct([("page", pa.int32()), ("chars", pa.int64()), ("n_skewed", pa.int64()), ("unsure", pa.bool_()), ("n_detracked", pa.int64()), ("lines", pa.list_(LINE))])


def assembled(runs: Runs, n_docs: int, taken_before: dict | None = None) -> pa.ListArray:
    """The pages of each document, with the lines of those that are readable, as `assemble_lines` has them."""
    runs = sorted_runs(runs)
    first, chars, n_skewed = page_facts(runs)
    doc, page = runs.doc[first], runs.page[first]
    _, of = spread(first, len(runs))
    kept = (runs.size > 0) & ~runs.flags["skewed"] & (chars >= SCANNED)[of] if len(runs) else np.zeros(0, bool)
    line_doc, line_page, lines = _lines(runs if kept.all() else runs.take(kept), taken_before)
    # both are in the order of documents and pages
    line_first = np.flatnonzero(starts_of(line_doc, line_page))
    has = np.zeros(len(first), np.int64)
    if len(line_first):
        width = int(max(page.max(), line_page.max())) + 1
        which = np.searchsorted(doc.astype(np.int64) * width + page, line_doc[line_first].astype(np.int64) * width + line_page[line_first])
        has[which] = np.diff(np.append(line_first, len(line_doc)))
    ends = np.append(0, np.cumsum(has))
    detracked, unsure = (lines.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("detracked", "uncertain"))
    repaired, doubted = counted(detracked), counted(unsure & ~detracked)
    columns = [
        pa.array(page, pa.int32()), pa.array(chars, pa.int64()), pa.array(n_skewed, pa.int64()), pa.array(doubted[ends[1:]] > doubted[ends[:-1]]), pa.array(repaired[ends[1:]] - repaired[ends[:-1]]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines),
    ]
    return listed(doc, n_docs, pa.StructArray.from_arrays(columns, fields=list(PAGE)))


def runs_of(held: pa.ListArray, docs: np.ndarray, pages: pa.Array, fonts: dict) -> Runs:
    """Runs from a list of structs for each page. docs: the numbers of their documents; fonts: numbers by name, to which new ones are added."""
    count = np.diff(held.offsets.to_numpy())
    each = held.flatten()
    columns = {each.type.field(i).name: each.field(i) for i in range(each.type.num_fields)}

    def numbers(name: str, kind: pa.DataType) -> np.ndarray:
        return columns[name].cast(kind, safe=False).to_numpy(zero_copy_only=False)

    buf, offs = text_parts(columns["str"])
    lead = counted(leads(buf))
    names = columns["font_key"].dictionary_encode()
    codes = np.array([fonts.setdefault(f, len(fonts)) for f in [*names.dictionary.to_pylist(), None]])
    font = codes[names.indices.fill_null(len(codes) - 1).to_numpy()]
    flags = {c: columns[c].fill_null(False).to_numpy(zero_copy_only=False).astype(bool) for c in ("bold", "italic", "mono", "skewed") if c in columns}
    x, y, em, advance = (numbers(c, pa.float64()) for c in ("x", "baseline_y", "em", "advance"))
    run_no = columns["run_no"].cast(pa.int64()).fill_null(0).to_numpy()
    return Runs(np.repeat(docs, count), np.repeat(pages.fill_null(-1).to_numpy(), count), run_no, x, y, em, advance, font, offs[:-1], np.diff(offs), lead[offs[1:]] - lead[offs[:-1]], buf, flags)


def listed(doc: np.ndarray, n_docs: int, rows: pa.Array) -> pa.ListArray:
    """Rows as a list for each document, which come in their order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), rows)


def _lines(runs: Runs, taken_before: dict | None) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Document, page and facts of the lines of runs that have text and are upright."""
    runs, changed = detrack(runs)
    runs = replace(runs, flags=runs.flags | {"changed": changed})
    lines = grouped(*cluster(runs))
    r, first, n = lines.runs, lines.first, len(lines)
    before = r.chars if r.chars_before is None else r.chars_before
    g = gaps(lines)
    texts, ratio, unsure = taken_thresholds(lines, g, taken_before)
    em = modal_em(lines, before)

    def lowest(v: np.ndarray) -> np.ndarray:
        return np.fmin.reduceat(v, first) if n else v[:0]

    def highest(v: np.ndarray) -> np.ndarray:
        return np.fmax.reduceat(v, first) if n else v[:0]

    x, top, base = lowest(r.x), lowest(r.y - r.em), highest(r.y).astype(float)
    uneven = lowest(r.y) != base
    if uneven.any():
        take = uneven[lines.of]
        base[uneven] = medians(r.y[take].astype(float), lines.of[take], n)[uneven]
    bold = summed(np.where(r.flags["bold"], r.chars, 0), first) > summed(r.chars, first) * BOLD_SHARE
    # sup and sub: runs much smaller than their line and off its baseline
    small = r.em < em[lines.of] * SCRIPT_SIZE
    at = np.flatnonzero(small)
    line = lines.of[at]
    off = (base[line] - r.y[at]) / np.where(em[line] == 0, 1, em[line])
    moved = (np.abs(off) >= SCRIPT_OFFSET[0]) & (np.abs(off) <= SCRIPT_OFFSET[1])
    at, line, off = at[moved], line[moved], off[moved]
    marks = pa.StructArray.from_arrays([pa.array(r.run_no[at], pa.int32()), pa.array(np.where(off > 0, "sup", "sub").tolist(), pa.string())], fields=list(LINE.field("scripts").type.value_type))
    scripts = pa.ListArray.from_arrays(pa.array(np.searchsorted(line, np.arange(n + 1)), pa.int32()), marks)
    code = np.full(len(r), PLAIN, np.uint8)
    for bit, name in enumerate(("bold", "italic", "mono")):
        if name in r.flags:
            code += (r.flags[name] << bit).astype(np.uint8)
    code[at] += np.where(off > 0, 16, 8).astype(np.uint8)
    styled = np.flatnonzero(highest(code) != PLAIN) if n else first
    styles = pa.nulls(n, pa.string())
    if len(styled):
        some, h = subset(lines, g, styled)
        put = separators(some, h, ratio[styled]) != NOTHING
        put[some.first] = False
        count = lines.count[styled]
        codes = code[np.repeat(first[styled] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        length = some.runs.chars + put
        end = np.cumsum(length)
        out = np.repeat(codes, length)
        out[(end - length)[put]] = BETWEEN
        place = np.full(n, -1)
        place[styled] = np.arange(len(styled))
        each = strings(out, np.append((end - length)[some.first], len(out)))
        styles = each.take(pa.array(place, mask=place < 0)).cast(pa.string())
    columns = [
        pa.array(lines.line_no, pa.int32()), *(pa.array(v.astype(float), from_pandas=True) for v in (x, highest(r.x + r.advance) - x, top, highest(r.y) - top)), pa.array(bold), pa.array(lines.count, pa.int64()), pa.array(highest(r.flags["changed"].astype(np.int8)) > 0),
        pa.array(base, from_pandas=True), pa.array(em.astype(float), from_pandas=True), scripts, styles, texts.array().cast(pa.string()), pa.array(ratio), pa.array(unsure),
    ]
    return lines.doc, lines.page, pa.StructArray.from_arrays(columns, fields=list(LINE))
