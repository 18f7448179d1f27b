"""Admission of files, and titles, authors and language from what a file, its metadata and its headings say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip

LARGEST_FILE = 200 * 1024 * 1024
#: Titles that writers of files leave behind. Fixed values.
GARBAGE_START = r"(?i)^(untitled|document\d*|microsoft word|microsoft powerpoint|slide\d*)"
GARBAGE_END = r"(?i)\.(docx?|pptx?|pages|indd|tex)\z"


def admission(name: Column, mime: Column, size: Column) -> Column:
    """Why a file is refused: type or size; null if it is taken."""
    pdf = F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(name.rlike(r"(?i)\.pdf\z"), F.lit(False))
    return F.when(~pdf, "type").when(size > LARGEST_FILE, "size")


def load_error(kind: Column) -> Column:
    """The class of an error, null without one."""
    return F.when(kind == "PasswordException", "password").when(kind == "InvalidPDFException", "invalid").when(kind.isNotNull(), "other")


def garbage_title(title: Column) -> Column:
    return title.rlike(GARBAGE_START) | title.rlike(GARBAGE_END)


def file_stem(name: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf\z", ""), "[_-]+", " "))


def split_authors(text: Column, by: str = "[,;]") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), by), lambda a: strip(a)), lambda a: a != "")


def extract_uuid(identifier: Column) -> Column:
    return F.nullif(F.regexp_extract(identifier, r"^urn:uuid:([0-9a-fA-F-]{36})\z", 1), F.lit(""))


def document_meta(raw: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, title, title_source, authors, language): the first of the embedded title, the info title unless left behind by a writer, the first heading and the file's name.

    raw: doc_id, xmp_title, info_title, info_author, info_language, file_name; headings: doc_id, ord, text.
    """
    first = headings.groupBy("doc_id").agg(strip(F.min_by("text", "ord")).alias("heading"))
    both = raw.join(first, "doc_id", "left")
    xmp, info, heading = (F.nullif(strip(F.col(c)), F.lit("")) for c in ("xmp_title", "info_title", "heading"))
    info = F.when(~garbage_title(info), info)
    stem = F.coalesce(F.nullif(file_stem(F.col("file_name")), F.lit("")), F.lit("Untitled"))
    source = F.when(xmp.isNotNull(), "xmp").when(info.isNotNull(), "info").when(heading.isNotNull(), "first-heading").otherwise("filename")
    language = F.coalesce(F.nullif("info_language", F.lit("")), F.lit("en"))
    return both.select("doc_id", F.coalesce(xmp, info, heading, stem).alias("title"), source.alias("title_source"), split_authors(F.col("info_author")).alias("authors"), language.alias("language"))
