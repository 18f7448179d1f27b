"""Archives from file tables and file tables from archives.

A package is small (one book), so a document's files meet in one group; the
same files always give the same bytes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize_path

MIMETYPE = b"application/epub+zip"
#: All entries bear one date, so equal files give equal archives.
DATE = (1980, 1, 1, 0, 0, 0)


def pack(files: DataFrame) -> DataFrame:
    """(doc_id, data) from (doc_id, ord, path, data): `mimetype` first and stored, the rest deflated in order. Paths must be ASCII."""

    def archive(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            head = zipfile.ZipInfo("mimetype", DATE)
            z.writestr(head, MIMETYPE, zipfile.ZIP_STORED)
            for path, data in part.sort_values(["ord", "path"])[["path", "data"]].itertuples(index=False):
                if not path.isascii():
                    raise ValueError(f"a path is not ASCII: {path}")
                z.writestr(zipfile.ZipInfo(path, DATE), bytes(data), zipfile.ZIP_DEFLATED, 6)
        return pd.DataFrame({"doc_id": [part["doc_id"].iloc[0]], "data": [out.getvalue()]})

    return files.filter(F.col("path") != "mimetype").groupBy("doc_id").applyInPandas(archive, "doc_id long, data binary")


ENTRIES = "doc_id long, ord int, path string, data binary, error string"


def unpack(archives: DataFrame) -> DataFrame:
    """One row per entry of each archive; an unreadable one is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, data in batch[["doc_id", "data"]].itertuples(index=False):
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        rows += [(doc_id, k, i.filename, z.read(i), None) for k, i in enumerate(z.infolist()) if not i.is_dir()]
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
                    rows.append((doc_id, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "path", "data", "error"]).astype({"ord": "Int32"})

    return archives.select("doc_id", "data").mapInPandas(run, ENTRIES)


NODES = "doc_id long, path string, malformed string, node int, parent int, tag string, prefix string, parent_tag string, attrs map<string,string>, text string"


def elements(data: bytes) -> list[list]:
    """(number, parent, tag, prefix, parent's tag, attributes, text before the first child) of each element, in document order. Names are local ones."""
    found: list[list] = []
    stack: list[int] = []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.namespace_prefixes = True

    def start(name: str, attrs: dict[str, str]) -> None:
        # uri, local name and prefix, as far as there are any
        parts = name.split(" ")
        up = stack[-1] if stack else None
        keys = {k.split(" ")[1] if " " in k else k: v for k, v in attrs.items()}
        stack.append(len(found))
        found.append([len(found), up, parts[min(1, len(parts) - 1)], parts[2] if len(parts) > 2 else None, None if up is None else found[up][2], keys, None])

    def text(s: str) -> None:
        # later children have later numbers: text after one is not the element's first
        if stack and stack[-1] == len(found) - 1:
            found[-1][6] = (found[-1][6] or "") + s

    def skipped(name: str, is_parameter: bool) -> None:
        if not is_parameter:
            raise expat.ExpatError(f"undefined entity {name}")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.SkippedEntityHandler = start, lambda name: stack.pop(), text, skipped
    parser.Parse(data, True)
    return found


def xml_nodes(files: DataFrame) -> DataFrame:
    """One row per element of each XML file (doc_id, path, data); a malformed file is one row with the parser's message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, path, data in batch[["doc_id", "path", "data"]].itertuples(index=False):
                try:
                    rows += [(doc_id, path, None, *e) for e in elements(bytes(data or b""))]
                except expat.ExpatError as e:
                    rows.append((doc_id, path, str(e), *[None] * 7))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "malformed", "node", "parent", "tag", "prefix", "parent_tag", "attrs", "text"]).astype({"node": "Int32", "parent": "Int32"})

    return files.select("doc_id", "path", "data").mapInPandas(run, NODES)


def resolved(base: Column, href: Column) -> Column:
    """A link's path in the archive, from the path of the file that holds it."""
    plain = F.coalesce(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), href)
    folder = F.regexp_extract(base, r"^(.*/)?[^/]*\z", 1)
    return normalize_path(F.concat(folder, plain))
