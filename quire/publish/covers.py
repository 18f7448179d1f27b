"""Covers as data: sizes, scores, the choice among candidates, and what a made-up cover shows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.text import WS_CHARS, hue, strip

#: Limits and sizes of covers. Fixed values.
LEAST_RATIO, MOST_RATIO, MOST_PIXELS = 1.25, 1.9, 4_000_000
LEAST_SCORE, LEAST_LONG_EDGE, LEAST_PIXELS = 90, 800, 400_000
LARGEST_UPLOAD, LEAST_EDGE, LONG_EDGE_HIGH = 25 * 1024 * 1024, 100, 2560
USER, RENDERED, SYNTHESIZED = 100, 50, 0
TITLE_LINES, AUTHOR_LINES = 6, 2


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def fit_long_edge(w: Column, h: Column, target: Column) -> Column:
    """Struct of w, h and scaled: never larger than given, nor above the pixel limit if scaled."""
    edge = F.greatest(w, h)
    plain = target / edge
    scale = F.when(w * plain * h * plain > MOST_PIXELS, F.sqrt(MOST_PIXELS / (w * h))).otherwise(plain)

    def size(v: Column) -> Column:
        return F.when(edge <= target, v.cast("long")).otherwise(F.greatest(F.lit(1), half_up(v * scale)))

    return F.struct(size(w).alias("w"), size(h).alias("h"), (edge > target).alias("scaled"))


def cover_ratio(w: Column, h: Column) -> Column:
    return F.when(w == 0, 0.0).otherwise(h / w)


def embedded_score(coverage: Column, w: Column, h: Column, page: Column, mime: Column) -> Column:
    """How well an image serves as cover."""
    good = cover_ratio(w, h).between(LEAST_RATIO, MOST_RATIO)
    return coverage * 100 + F.least(F.greatest(w, h), F.lit(3000)) / 100 + F.when(good, 25).otherwise(0) - F.when(page > 0, 15).otherwise(0) - F.when(mime == "image/gif", 20).otherwise(0)


def accepts_embedded(score: Column, w: Column, h: Column) -> Column:
    return (score >= LEAST_SCORE) & (F.greatest(w, h) >= LEAST_LONG_EDGE) & (w * h >= LEAST_PIXELS)


#: Pages that are rendered in search of a cover. Fixed value.
PAGES_TRIED = 2


def select_cover(candidates: DataFrame) -> DataFrame:
    """The best candidate of each document by score, of equal ones that of the first page. candidates: doc_id, source, page, score, usable.

    Of the rendered pages only the first two are tried, whatever else is there.
    """
    best = F.max_by(F.struct("source", "page", "score"), F.struct("score", -F.coalesce("page", F.lit(0))))
    tried = (F.col("source") != "rendered") | (F.col("page") < PAGES_TRIED)
    return candidates.filter(F.col("usable") & tried).groupBy("doc_id").agg(best.alias("c")).select("doc_id", "c.source", "c.page", "c.score")


def is_blank(mean: Column, deviation: Column) -> Column:
    """Of a page's luminance."""
    return (mean > 250) & (deviation < 2)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def looks_like_svg(name: Column, mime: Column, head: Column, probed: Column) -> Column:
    """By type, name, or the first bytes of a file that is no known image."""
    start = F.lower(F.ltrim(head, F.lit(WS_CHARS)))
    return F.coalesce(mime == "image/svg+xml", F.lit(False)) | name.rlike(r"(?i)\.svg\z") | (probed.isNull() & (start.startswith("<?xml") | start.startswith("<svg")))


def upload_refusal(size: Column, svg: Column, w: Column, h: Column) -> Column:
    """Why a user's cover is refused, null if it is taken; w and h are null for files that are no image."""
    return F.when(size > LARGEST_UPLOAD, "size").when(svg, "svg").when(w.isNull() | h.isNull(), "unreadable").when(F.least(w, h) < LEAST_EDGE, "small")


def wrap_words(text: Column, width: Column) -> Column:
    """Lines of whole words, each as long as fits the width in characters; a longer word has a line of its own. A fold over the words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(s: Column, word: Column) -> Column:
        longer = F.when(s["line"] == "", word).otherwise(F.concat_ws(" ", s["line"], word))
        fits = (F.length(longer) <= width) | (s["line"] == "")
        return F.struct(F.when(fits, s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))).alias("lines"), F.when(fits, longer).otherwise(word).alias("line"))

    return F.aggregate(words, start, step, lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))))


def synthesized_cover(title: Column, authors: Column, title_width: int, author_width: int) -> list[Column]:
    """What a cover without an image shows: the hue of its title, and the lines of title and authors."""
    named = F.array_join(F.filter(authors, lambda a: strip(a) != ""), ", ")
    shown = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))
    return [hue(title).alias("hue"), F.slice(wrap_words(shown, F.lit(title_width)), 1, TITLE_LINES).alias("title_lines"), F.slice(wrap_words(named, F.lit(author_width)), 1, AUTHOR_LINES).alias("author_lines")]


#: File name endings of image types. Fixed values.
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/svg+xml": "svg"}


def asset_names(assets: DataFrame, cover_ending: str = "jpg") -> DataFrame:
    """Adds `name`, a file name of its own for each asset of a document in order: one that is taken is numbered from 1 until it is free. assets: doc_id, ord, base (ASCII), mime.

    A number can only meet names whose base ends in a hyphen and digits, so assets that share the base without such
    endings are named together, in order, and all others of the document apart from them.
    """
    ending = F.create_map(*[F.lit(v) for kv in EXTENSIONS.items() for v in kv])[F.col("mime")]
    plain = assets.withColumn("ending", ending).withColumn("stem", F.regexp_replace("base", r"(-[0-9]+)+\z", ""))
    family = ["doc_id", "ending", "stem"]
    own = F.max(F.col("base") != F.col("stem")).over(Window.partitionBy(*family))
    nth = F.row_number().over(Window.partitionBy("doc_id", "base", "ending").orderBy("ord")) - 1 + ((F.col("base") == "cover") & (F.col("ending") == cover_ending)).cast("int")
    simple = F.when(nth == 0, F.concat_ws(".", "base", "ending")).otherwise(F.concat(F.col("base"), F.lit("-"), nth.cast("string"), F.lit("."), F.col("ending")))
    numbered = plain.withColumn("mixed", own).withColumn("name", simple)
    names = [*assets.columns, "name"]
    schema = StructType([*assets.schema.fields, StructField("name", StringType())])

    def allot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The families in which numbers may meet names, one after the other: the set of used names and each base's last number are carried along."""
        last, used, numbers = None, set(), {}
        for batch in batches:
            given = []
            for key, base, end in zip(batch[family].itertuples(index=False, name=None), batch["base"], batch["ending"], strict=True):
                if key != last:
                    last, used, numbers = key, {f"cover.{cover_ending}"}, {}
                name, n = f"{base}.{end}", numbers.get(base, 1)
                while name in used:
                    name, n = f"{base}-{n}.{end}", n + 1
                numbers[base] = n
                used.add(name)
                given.append(name)
            yield batch.assign(name=given)[names]

    met = numbered.filter("mixed").select(*assets.columns, "ending", "stem").repartition(*family).sortWithinPartitions(*family, "ord")
    return numbered.filter("NOT mixed").select(names).unionByName(met.mapInPandas(allot, schema))
