"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as browsers know it, for regular expressions.
WS = "[\\x09-\\x0D\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: The same characters one by one.
WS_CHARS = "".join(c for c in map(chr, range(0x10000)) if re.match(WS.replace("\\\\", "\\"), c))
#: Operator tokens: text that holds one is a formula, not letter-spaced words. Fixed values.
OPERATORS = ["=", "+", "*", "/", "<", ">", "±", "×", "÷", "≤", "≥", "≠"]
#: Prefixes that keep their hyphen at a line's end. Fixed values.
HYPHEN_PREFIXES = ["non", "self", "co", "pre", "re", "anti", "multi", "inter", "sub", "semi", "e", "x", "ex", "post", "pro", "quasi", "pseudo"]
#: What a list item starts with. Fixed value.
LIST_MARKER = r"(?i)^(\d+[.)]|[a-z][.)]|\([a-z0-9]+\)|[•·▪◦‣–—*])\s+"


def squeeze(text: Column) -> Column:
    """Cell breaks and runs of white space become one space; none at the ends.

    The pattern passes over printable ASCII by one comparison, and over single spaces, which stay.
    """
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\x1f"), F.lit(" ")), rf"(?![!-~])(?:{WS}{{2,}}|(?! ){WS})", " "))


def xml_escape(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;")) if attribute else out


def xml_sanitize(text: Column) -> Column:
    """Without characters that XML forbids or discourages."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\u009F\\uFFFE\\uFFFF]", "")


def xml_text(text: Column) -> Column:
    return xml_escape(xml_sanitize(text))


def strip(text: Column) -> Column:
    """Without white space, as browsers know it, at the ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def looks_tracked(text: Column, least: int = 4) -> Column:
    """Whether so many single letters or digits stand in a row among the tokens, other single characters between them aside. Formulas are never meant.

    A single character is one of the first plane: any other counts as two.
    """
    glyph, mark = r"[\p{L}\p{N}&&[\x{0}-\x{FFFF}]]", r"[^ \p{L}\p{N}\x{10000}-\x{10FFFF}]"
    operator = rf"(?:^| )[{''.join(map(re.escape, OPERATORS))}](?: |\z)"
    return text.rlike(rf"(?:^| ){glyph}(?:(?: {mark})* {glyph}){{{least - 1}}}(?: |\z)") & ~text.rlike(operator)


def detrack(text: Column) -> Column:
    # a text without spaces has nothing to join
    return F.when(text.contains(" ") & looks_tracked(text), F.replace(text, F.lit(" "), F.lit(""))).otherwise(text)


def detrack_runs(text: Column, least: int = 4) -> Column:
    """Only the stretches of at least so many single-character tokens are joined, and only if the text is letter-spaced at all."""
    tokens = F.split(text, " ")
    start = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("run"), F.lit(True).alias("first"))

    def flushed(s: Column) -> Column:
        piece = F.when(F.size(s["run"]) >= least, F.array_join(s["run"], "")).otherwise(F.array_join(s["run"], " "))
        return F.when(F.size(s["run"]) == 0, s["out"]).when(s["first"], piece).otherwise(F.concat(s["out"], F.lit(" "), piece))

    def step(s: Column, t: Column) -> Column:
        single = F.length(t) == 1
        held = F.when(single, F.concat(s["run"], F.array(t))).otherwise(F.array().cast("array<string>"))
        before = s["first"] & (F.size(s["run"]) == 0)
        out = F.when(single, s["out"]).when(before, t).otherwise(F.concat(flushed(s), F.lit(" "), t))
        return F.struct(out.alias("out"), held.alias("run"), (s["first"] & single).alias("first"))

    joined = F.aggregate(tokens, start, step, flushed)
    return F.when(looks_tracked(text, least), joined).otherwise(text)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def join_verdict(text: Column) -> Column:
    """Whether a joined line has too many spaces (too-low threshold) or too few (too-high)."""
    folded = F.translate(text, WS_CHARS + "\x1f", " " * (len(WS_CHARS) + 1))

    def counts(tokens: Column) -> Column:
        letters = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t))
        return F.struct(F.size(tokens).alias("n"), letters.alias("letters"), F.size(F.filter(tokens, lambda t: F.length(t) == 1)).alias("singles"))

    def judged(c: Column) -> Column:
        loose = (c["n"] >= 4) & ((c["letters"] / c["n"] < 2) | (c["singles"] / c["n"] > 0.6))
        return F.when(loose, "too-low").when((c["letters"] > 40) & ~text.contains(" ") & ~text.contains("\x1f"), "too-high").otherwise("ok")

    return let(let(F.filter(F.split(folded, " "), lambda t: t != ""), counts), judged)


def unclosed_delimiter(text: Column) -> Column:
    def net(a: str, b: str) -> Column:
        return F.length(F.replace(text, F.lit(b), F.lit(""))) - F.length(F.replace(text, F.lit(a), F.lit("")))

    return (net("(", ")") > 0) | (net("[", "]") > 0)


def heading_depth(text: Column) -> Column:
    """Dot depth of a numbered heading, null without a number."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)\s+\S", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def joins_without_hyphen(left: Column, right: Column) -> Column:
    """Whether a hyphen at the end of left only splits a word that goes on in right."""
    word, after = F.regexp_extract(left, "(\\p{L}+)[-\\u2010\\u00AD]\\z", 1), F.regexp_extract(right, r"^(\p{L}+)", 1)
    return (word != "") & (after != "") & ~F.lower(word).isin(HYPHEN_PREFIXES) & after.rlike(r"^\p{Ll}")


def heals(last: Column, line: Column) -> Column:
    """Whether a word that a line's end split goes on in the next line, white space aside."""
    end = F.rtrim(last, F.lit(WS_CHARS + "\x1f"))
    # few lines end in a hyphen, and the patterns are dear
    return F.when(end.endswith("-") | end.endswith("\u2010") | end.endswith("\u00ad"), joins_without_hyphen(squeeze(last), squeeze(line))).otherwise(False)


def join_lines(lines: Column) -> Column:
    """An array of lines as one text, split words joined; a fold, since a joined word may be split again.

    The fold keeps the last line, with what was joined to it, apart from the text before, which it only appends to.
    """

    def state(done: Column, last: Column) -> Column:
        return F.struct(done.alias("done"), last.alias("last"))

    def step(s: Column, line: Column) -> Column:
        sep = F.when(s["last"].endswith("\x1f") | line.startswith("\x1f"), "").otherwise(" ")
        joins = heals(s["last"], line)
        return F.when(joins, state(s["done"], F.concat(F.regexp_replace(s["last"], "[-\\u2010\\u00AD]\\z", ""), line))).otherwise(state(F.concat(s["done"], s["last"], sep), line))

    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    rest = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    return F.when(F.size(lines) == 0, "").otherwise(F.aggregate(rest, state(F.lit(""), first), step, lambda s: F.concat(s["done"], s["last"])))


def join_styles(lines: Column) -> Column:
    """The styles of `join_lines`' text, a character of code for each of its characters. lines: an array of (text, styles)."""

    def state(last: Column, done: Column, styles: Column) -> Column:
        return F.struct(last.alias("last"), done.alias("done"), styles.alias("styles"))

    def step(s: Column, line: Column) -> Column:
        apart = F.when(s["last"].endswith("\x1f") | line["text"].startswith("\x1f"), "").otherwise("_")
        joins = heals(s["last"], line["text"])
        healed = F.regexp_replace(s["last"], "[-\\u2010\\u00AD]\\z", "")
        return F.when(joins, state(F.concat(healed, line["text"]), s["done"], F.concat(F.left(s["styles"], F.length(healed)), line["styles"]))).otherwise(state(line["text"], F.concat(s["done"], s["styles"], apart), line["styles"]))

    first = F.get(lines, F.lit(0))
    return F.aggregate(F.slice(lines, 2, F.size(lines)), state(first["text"], F.lit(""), first["styles"]), step, lambda s: F.concat(s["done"], s["styles"]))


def filename_stem(raw: Column) -> Column:
    kept = F.regexp_replace(raw, r'[/\\?%*:|"<>\x00-\x1F\x7F]', "")
    return F.btrim(F.btrim(F.regexp_replace(kept, WS + "+", " "), F.lit(". ")))


def epub_filename(title: Column, author: Column, source: Column, most: int = 120) -> Column:
    stems = F.struct(*[filename_stem(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((title, "t"), (author, "a"), (F.regexp_replace(source, r"(?i)\.pdf\z", ""), "s"))])

    def name(s: Column) -> Column:
        stem = F.when((s["t"] != "") & (s["a"] != ""), F.concat_ws(" - ", s["t"], s["a"])).when(s["t"] != "", s["t"]).otherwise(s["s"])
        return F.when(stem == "", "converted.epub").otherwise(F.concat(F.rtrim(F.left(stem, F.lit(most)), F.lit(". ")), F.lit(".epub")))

    # the stems of long titles are worked out once
    return F.get(F.transform(F.array(stems), name), F.lit(0))


def normalize_path(path: Column) -> Column:
    """Without `.` and empty segments, `..` taken back."""

    def step(out: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), out).when(part == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def split_fragment(href: Column) -> Column:
    """path and fragment; a null fragment is not an empty one."""
    at = F.locate("#", href)
    return F.struct(F.when(at > 0, F.left(href, at - 1)).otherwise(href).alias("path"), F.when(at > 0, F.substr(href, at + 1)).alias("fragment"))


def hue(text: Column) -> Column:
    """A stable colour angle: 31 h + code point, modulo 360."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda h, c: (h * 31 + F.ascii(c)) % 360)


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no function for it."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKD", t))


def anchor(text: Column, block_id: Column) -> Column:
    slug = F.regexp_replace(F.trim(F.regexp_replace(nfkd(F.lower(text)), r"[^\w\s-]", "")), r"\s+", "-")
    slug = F.btrim(F.left(slug, F.lit(48)), F.lit("-"))
    return F.when(slug == "", block_id).otherwise(F.concat_ws("-", slug, block_id))


def ascii_segment(raw: Column, fallback: str = "asset", most: int = 64) -> Column:
    out = F.left(F.btrim(F.regexp_replace(nfkd(raw), r"[^\w.-]+", "-"), F.lit("-")), F.lit(most))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))
