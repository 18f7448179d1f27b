"""Inline text: runs of one style merged, and their markup."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType

from quire.functions.text import WS, let, squeeze, xml_escape, xml_sanitize, xml_text

#: Styles from the outermost element to the innermost. Fixed values.
STYLES = {"b": "strong", "i": "em", "code": "code", "sub": "sub", "sup": "sup"}
#: Links that leave the package. Fixed value.
EXTERNAL = r"(?i)^(https?:|mailto:)"


def merge_runs(runs: DataFrame, block: list[str], order: list[str]) -> DataFrame:
    """One row (block, ord, s, styles) for each stretch of runs of a block with the same styles, joined by single spaces. runs: str and the style columns, null or false where absent."""
    plain = runs.withColumn("s", squeeze(F.col("str"))).filter("s <> ''")
    style = F.struct(*[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in STYLES])
    by = Window.partitionBy(*block).orderBy(*order)
    marked = plain.withColumn("style", style).withColumn("new", F.coalesce(F.col("style") != F.lag("style").over(by), F.lit(True)).cast("int")).withColumn("ord", F.sum("new").over(by).cast("int") - 1)
    pieces = F.transform(F.sort_array(F.collect_list(F.struct(*order, "s"))), lambda p: p["s"])
    return marked.groupBy(*block, "ord", "style").agg(F.array_join(pieces, " ").alias("s")).select(*block, "ord", "s", *[F.col(f"style.{c}").alias(c) for c in STYLES])


INLINE = "struct<t:string,s:string,b:boolean,i:boolean,code:boolean,sub:boolean,sup:boolean>"


_BLANKS = re.compile(WS.replace("\\\\", "\\") + "+")
_INLINE = pa.struct([("t", pa.string()), ("s", pa.string()), *[(c, pa.bool_()) for c in STYLES]])
_STRETCH = re.compile(r"(?s)(.)\1*")


def _stretches(text: str, styles: str) -> list[tuple[int, str]]:
    """Mask and text of the inlines of a styled text."""
    for pattern, put in ((r"(.)_(?=\1)", r"\1\1"), ("0_", "00"), ("_0", "00"), (r"(.)_", r"\1\1")):
        styles = re.sub(pattern, put, styles)
    out: list[tuple[int, str]] = []
    spaced = True
    for m in _STRETCH.finditer(styles):
        piece = _BLANKS.sub(" ", text[m.start() : m.end()].replace("\x1f", " "))
        if spaced and piece.startswith(" "):
            piece = piece[1:]
        if piece:
            out.append((ord(m[1]) - 48, piece))
            spaced = piece.endswith(" ")
    if out:
        out[-1] = (out[-1][0], out[-1][1].rstrip(" "))
    return [p for p in out if p[1]]


@F.arrow_udf(ArrayType(from_arrow_type(_INLINE)))
def _cut(texts: pa.Array, styles: pa.Array) -> pa.Array:
    ends, masks, said = [0], [], []
    for text, codes in zip(texts.to_pylist(), styles.to_pylist(), strict=True):
        for mask, piece in [] if text is None or codes is None else _stretches(text, codes):
            masks.append(mask)
            said.append(piece)
        ends.append(len(said))
    bits = np.array(masks, np.int64)
    flags = [pa.array(np.ones(len(bits), bool), pa.bool_(), mask=(bits >> k & 1) == 0) for k in range(len(STYLES))]
    each = pa.StructArray.from_arrays([pa.array(["text"] * len(said), pa.string()), pa.array(said, pa.string()), *flags], fields=list(_INLINE))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)


def cut_inlines(text: Column, styles: Column) -> Column:
    """The inlines of a text: stretches of one style, white space squeezed as in the whole. styles: a code for each character, `_` for what was put between runs; null if there are none.

    A space between runs of one style has that style, else it stays plain if a side is, else it goes with what is before it.
    """
    plain = F.struct(F.lit("text").alias("t"), squeeze(text).alias("s"), *[F.lit(None).cast("boolean").alias(c) for c in STYLES])
    return F.when(styles.isNull(), let(plain, lambda i: F.filter(F.array(i), lambda v: v["s"] != ""))).otherwise(_cut(F.when(styles.isNotNull(), text), styles))


def styled_markup(text: Column, styles: dict[str, Column]) -> Column:
    """Escaped text in the elements of its styles."""

    def wrap(inner: Column, name: str) -> Column:
        tag = STYLES[name]
        return F.when(styles[name], F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)

    return reduce(wrap, reversed(list(STYLES)), xml_text(text))


def inline_markup(inlines: DataFrame, block: list[str]) -> DataFrame:
    """The markup of each block's inlines in order."""
    piece = styled_markup(F.col("s"), {c: F.col(c) for c in STYLES})
    return inlines.groupBy(*block).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", piece.alias("m")))), lambda p: p["m"]), "").alias("markup"))


def attributes(**values: Column) -> Column:
    """Attributes in the given order; null ones are left out."""
    return F.concat_ws("", *[F.concat(F.lit(f' {name}="'), xml_escape(xml_sanitize(v), attribute=True), F.lit('"')) for name, v in values.items()])


def void_tag(name: str, **values: Column) -> Column:
    return F.concat(F.lit(f"<{name}"), attributes(**values), F.lit("/>"))


def link_markup(href: Column, children: Column) -> Column:
    """A link where it leads somewhere; any other, null ones included, leaves its children."""
    return F.when(href.isNotNull(), F.concat(F.lit("<a"), attributes(href=href), F.lit(">"), children, F.lit("</a>"))).otherwise(F.concat(F.lit("<span>"), children, F.lit("</span>")))


def external_href(href: Column) -> Column:
    return F.when(href.rlike(EXTERNAL), href)


def thousandths(x: Column) -> Column:
    """A number to three decimals, halves up, without trailing zeros."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.floor(x * 1000 + 0.5) / 1000), r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    return F.when(x.isNotNull(), shown)


def image_markup(href: Column, alt: Column, width_em: Column, baseline: Column) -> Column:
    """An image in the line: width in em, baseline as a share of its height; nothing without a file."""
    style = F.nullif(F.concat_ws(";", F.concat(F.lit("width:"), thousandths(width_em), F.lit("em")), F.concat(F.lit("vertical-align:"), thousandths(-baseline * 100), F.lit("%"))), F.lit(""))
    return F.when(href.isNull(), "").otherwise(void_tag("img", src=href, alt=alt, **{"class": F.lit("inline-math"), "style": style}))


def internal_hrefs(links: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds `href`, where a link to a block leads from the chapter it stands in: null if nowhere.

    links: doc_id, from_href, target_ord; placed: doc_id, ord, chapter_href, anchor (headings only). Links to blocks without an anchor lead to the
    top of another file, and nowhere within their own.
    """
    targets = placed.select("doc_id", F.col("ord").alias("target_ord"), F.col("chapter_href").alias("to_href"), "anchor")
    same = F.col("to_href") == F.col("from_href")
    mark = F.concat(F.lit("#"), "anchor")
    href = F.when(same, mark).otherwise(F.concat("to_href", F.coalesce(mark, F.lit(""))))
    return links.join(targets, ["doc_id", "target_ord"], "left").withColumn("href", href)
