"""From positioned runs to chapters, one lazy plan; every step keeps the document as partition."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from quire.operators import headings, lines, paragraphs, toc
from quire.plans import documents


@dataclass
class Extracted:
    """What is read off runs; each part is planned when it is first asked for."""

    runs: DataFrame
    level_scope: tuple[str, ...] = ("doc_id", "page")

    @cached_property
    def pages(self) -> DataFrame:
        return lines.pages_read(self.runs)

    @cached_property
    def assembled(self) -> DataFrame:
        return lines.lines_of_pages(self.pages, lines.bounds_of(self.runs)).repartition("doc_id")

    @cached_property
    def lines(self) -> DataFrame:
        return headings.detect_headings(self.assembled, self.level_scope)

    @cached_property
    def blocks(self) -> DataFrame:
        return paragraphs.blocks(self.lines)

    @cached_property
    def toc(self) -> DataFrame:
        return toc.build_toc(self.blocks)

    @cached_property
    def chapters(self) -> DataFrame:
        return toc.chapters(self.blocks)

    @cached_property
    def warnings(self) -> DataFrame:
        return lines.page_warnings(self.pages)


@dataclass
class ExtractedDocuments(Extracted):
    """What is read off documents that are laid out in a manner: `runs` are their texts, which go through without a row for each word."""

    manner: str = "plain"

    @cached_property
    def pages(self) -> DataFrame:
        return documents.document_pages(self.runs, self.manner)

    @cached_property
    def assembled(self) -> DataFrame:
        return lines.lines_of_pages(self.pages, documents.BOUNDS).repartition("doc_id")


def extract_documents(docs: DataFrame, manner: str = "plain") -> ExtractedDocuments:
    """docs: doc_id, text."""
    return ExtractedDocuments(docs, manner=manner)


def extract(runs: DataFrame, level_scope: tuple[str, ...] = ("doc_id", "page")) -> Extracted:
    return Extracted(runs, level_scope)
