"""Runs from text items: transforms to page space, fonts to styles, marked content to ids and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import canonical
from quire.operators.marked import KEYS, tag_texts

#: Names of fonts that tell a style. Fixed values.
BOLD = r"(?i)bold|black|heavy|semib|demib|[-_]700|[-_]800|[-_]900"
ITALIC = r"(?i)italic|oblique"
MONO = r"(?i)mono|courier|consolas|menlo|typewriter"


def font_styles(family: Column, font: Column) -> list[Column]:
    both = F.concat_ws(" ", family, font)
    return [both.rlike(BOLD).alias("bold"), both.rlike(ITALIC).alias("italic"), family.rlike(MONO).alias("mono")]


def text_runs(items: DataFrame, styles: DataFrame, viewports: DataFrame) -> DataFrame:
    """Runs of the text items outside artifacts.

    items: doc_id, page, seq, type (text, begin, end), str, transform, width, height, font_name, mc_id, mc_tag; styles: doc_id, page, font_name, family;
    viewports: doc_id, page, viewport. Items without text or with a short transform are left out; a font without style stands for its own family.
    A page without a viewport gives runs without a place. Items are dealt once, by page; the styles of a page come to them as one list.
    """
    sound = items.filter((F.col("type") != "text") | ((F.col("str") != "") & (F.size("transform") >= 6)))
    fonts = styles.groupBy(*KEYS).agg(F.sort_array(F.collect_set(F.struct("font_name", "family"))).alias("fonts"))
    styled = tag_texts(sound).join(fonts, KEYS, "left").join(viewports, KEYS, "left")
    own = F.get(F.filter("fonts", lambda f: f["font_name"] == F.col("font_name")), F.lit(0))
    family = F.coalesce(own["family"], "font_name")
    placed = styled.withColumn("box", canonical(F.col("viewport"), F.col("transform"), F.col("width"), F.col("height")))
    return placed.select(*KEYS, F.col("seq").alias("run_no"), "str", "box.*", F.col("box.w").alias("advance"), F.concat_ws("|", family, "font_name").alias("font_key"), *font_styles(family, F.col("font_name")), "mcid")
