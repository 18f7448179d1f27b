"""Package validation: every rule is a query that returns issues.

Rules come in the order of the package's layers. A layer's fatal issues shut
off the layers above it for that document, by anti joins, as a reader could
not get that far either.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.functions.text import split_fragment
from quire.publish.package import resolved, unpack, xml_nodes

LARGE_PACKAGE, LARGE_PAGE, LEAST_COVER, GOOD_COVER = 50 * 1024 * 1024, 300_000, 100, 1000
CONTAINER, XHTML = "META-INF/container.xml", "application/xhtml+xml"


def issue(df: DataFrame, when: Column | None, severity: str, code: str, message: Column | str, path: Column | None = None) -> DataFrame:
    rows = df if when is None else df.filter(when)
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select("doc_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.cast("string").alias("message"), (path if path is not None else F.lit(None)).cast("string").alias("path"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def number(data: Column, at: int, n: int) -> Column:
    """An unsigned little-endian number in binary data."""
    pieces = [F.conv(F.hex(F.substring(data, at + 1 + k, 1)), 16, 10).cast("long") * 256**k for k in range(n)]
    return reduce(lambda a, b: a + b, pieces)


def check_bytes(archives: DataFrame, large: int = LARGE_PACKAGE) -> DataFrame:
    """The first entry must be an uncompressed, plain `mimetype`; packages above `large` bytes get a warning."""
    d = F.col("data")
    full = archives.filter(F.octet_length(d) >= 58)
    zipped = full.filter(F.hex(F.substring(d, 1, 4)) == "504B0304")
    named = number(d, 26, 2) == 8
    name, content = F.decode(F.substring(d, 31, 8), "iso-8859-1"), F.decode(F.substring(d, 39, 20), "iso-8859-1")
    return union([
        issue(archives, F.octet_length(d) > large, "warning", "epub-large", "the package is very large"),
        issue(archives, F.coalesce(F.octet_length(d) < 58, F.lit(True)), "error", "zip-truncated", "too short for an archive"),
        issue(full, F.hex(F.substring(d, 1, 4)) != "504B0304", "error", "zip-magic", "not a zip archive"),
        issue(zipped, number(d, 6, 2) != 0, "error", "mimetype-flags", "the first entry has flags"),
        issue(zipped, number(d, 8, 2) != 0, "error", "mimetype-compressed", "the first entry is compressed"),
        issue(zipped, ~named | (name != "mimetype"), "error", "mimetype-not-first", "the first entry is not mimetype"),
        issue(zipped, number(d, 28, 2) != 0, "error", "mimetype-extra-field", "the first entry has an extra field"),
        issue(zipped, named & (name == "mimetype") & (number(d, 28, 2) == 0) & (content != "application/epub+zip"), "error", "mimetype-content", "mimetype has other content"),
    ])


@F.pandas_udf(StructType([StructField("w", LongType()), StructField("h", LongType())]))
def jpeg_size(data: pd.Series) -> pd.DataFrame:
    """Width and height in a JPEG's frame header, found by a walk over its segments; null if there is none."""

    def walk(b: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while b is not None and at + 9 < len(b):
            marker = b[at + 1]
            if b[at] != 0xFF:
                at += 1
            elif marker in (0x01, 0xD8) or 0xD0 <= marker <= 0xD7:  # markers without a length
                at += 2
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
            else:
                length = int.from_bytes(b[at + 2 : at + 4], "big")
                if length < 2:
                    break
                at += 2 + length
        return None, None

    return pd.DataFrame([walk(b) for b in data], columns=["w", "h"], dtype="Int64")


def probe_image(data: Column) -> Column:
    """mime, width and height from the header of a PNG, JPEG or GIF; null for others."""

    def big(at: int) -> Column:
        return F.conv(F.hex(F.substring(data, at + 1, 4)), 16, 10).cast("long")

    size = F.octet_length(data)
    png = (size >= 24) & (F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(data, 13, 4)) == "49484452")
    gif = (size >= 10) & F.hex(F.substring(data, 1, 6)).isin("474946383761", "474946383961")
    jpeg = F.when((size >= 4) & (F.hex(F.substring(data, 1, 3)) == "FFD8FF"), data)

    def probe(mime: str, w: Column, h: Column) -> Column:
        return F.struct(F.lit(mime).alias("mime"), w.cast("long").alias("w"), h.cast("long").alias("h"))

    walked = jpeg_size(jpeg)
    return F.when(png, probe("image/png", big(16), big(20))).when(gif, probe("image/gif", number(data, 6, 2), number(data, 8, 2))).when(walked["w"].isNotNull(), probe("image/jpeg", walked["w"], walked["h"]))


def incomplete() -> Column:
    return reduce(lambda x, y: x | y, [F.coalesce(c, F.lit("")) == "" for c in ("id", "href")])


def usable(raw_items: DataFrame) -> DataFrame:
    """Complete manifest items, with their path in the archive."""
    return raw_items.filter(~incomplete()).withColumn("path", resolved(F.col("opf"), F.col("href")))


def check_structure(packages: DataFrame, raw_items: DataFrame, refs: DataFrame, spines: DataFrame, paths: DataFrame) -> DataFrame:
    """Manifest, spine and navigation. packages: doc_id, opf; raw_items: doc_id, opf, id, href, media_type, properties; refs: doc_id, node, id; spines: doc_id, toc; paths: doc_id, path of the archive."""
    found = [issue(raw_items, incomplete(), "error", "manifest-item-incomplete", "an item lacks id or href", F.col("href"))]
    items = usable(raw_items)
    found.append(issue(items.join(paths, ["doc_id", "path"], "left_anti"), None, "error", "manifest-href-unresolved", "an item is not in the archive", F.col("path")))
    found.append(issue(packages.join(refs, "doc_id", "left_anti"), None, "error", "spine-empty", "the spine is empty"))
    found.append(issue(refs, F.coalesce("id", F.lit("")) == "", "error", "spine-idref-missing", "a spine entry has no idref"))
    refs = refs.filter(F.col("id") != "")
    found.append(issue(refs.join(items, ["doc_id", "id"], "left_anti"), None, "error", "spine-idref-unresolved", F.col("id")))
    found.append(issue(refs.join(items, ["doc_id", "id"]), ~F.col("media_type").eqNullSafe(F.lit(XHTML)), "error", "spine-media-type", F.col("media_type"), F.col("path")))

    # incomplete items count as well
    navs = packages.join(raw_items.filter(F.array_contains("properties", "nav")).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    found.append(issue(navs, F.coalesce("n", F.lit(0)) != 1, "error", "nav-count", "there must be one navigation document"))
    spine = packages.join(spines.groupBy("doc_id").agg(F.max("toc").alias("id")), "doc_id", "left")
    found.append(issue(spine, F.col("id").isNull(), "warning", "ncx-not-referenced", "the spine names no ncx"))
    found.append(issue(spine.filter("id IS NOT NULL").join(items, ["doc_id", "id"], "left_anti"), None, "error", "ncx-unresolved", F.col("id")))
    known = items.select("doc_id", "path").unionAll(packages.select("doc_id", "opf"))
    orphans = paths.join(packages, "doc_id").filter((F.col("path") != "mimetype") & ~F.col("path").startswith("META-INF/")).join(known, ["doc_id", "path"], "left_anti")
    found.append(issue(orphans, None, "warning", "orphan-file", "a file is not in the manifest", F.col("path")))
    return union(found)


def check_metadata(meta: DataFrame) -> DataFrame:
    """meta: doc_id, title, language, identifier, creator, modified, cover of each package."""
    return union([
        issue(meta, F.col("modified").isNull(), "error", "dcterms-modified-missing", "no modification time"),
        issue(meta, ~F.col("modified").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z"), "error", "dcterms-modified-format", F.col("modified")),
        issue(meta, ~F.coalesce("identifier", F.lit("")).rlike(r"^urn:uuid:[0-9a-fA-F-]{36}\z"), "error", "identifier-format", F.col("identifier")),
        *[issue(meta, F.coalesce(t, F.lit("")) == "", "error", "metadata-missing", t) for t in ("title", "language")],
        issue(meta, F.coalesce("creator", F.lit("")).isin("", "Unknown"), "warning", "creator-unknown", "no author"),
        issue(meta, F.col("cover").isNull(), "error", "cover-meta-missing", "no cover is named"),
        issue(meta, F.col("cover") == "", "error", "cover-meta-empty", "the cover's name is empty"),
    ])


def check_cover(meta: DataFrame, items: DataFrame, files: DataFrame, refs: DataFrame, guides: DataFrame) -> DataFrame:
    """The cover's item, image, guide entry and page. items: as of usable(); files: doc_id, path, data; guides: doc_id of packages whose guide names a cover."""
    found = []
    covers = meta.filter(F.col("cover") != "").select("doc_id", F.col("cover").alias("id")).join(items, ["doc_id", "id"], "left")
    found.append(issue(covers, F.col("path").isNull(), "error", "cover-meta-unresolved", F.col("id")))
    covers = covers.filter(F.col("path").isNotNull())
    found.append(issue(covers, ~F.array_contains("properties", "cover-image"), "error", "cover-image-property-missing", "the cover item lacks its property", F.col("path")))
    images = covers.join(files, ["doc_id", "path"], "left").withColumn("image", probe_image(F.col("data")))
    some = F.octet_length("data") > 0
    w, h = F.col("image.w"), F.col("image.h")
    found += [
        issue(images, F.col("data").isNull(), "error", "cover-file-missing", "the cover is not in the archive", F.col("path")),
        issue(images, F.octet_length("data") == 0, "error", "cover-file-empty", "the cover is empty", F.col("path")),
        issue(images, some & F.col("image").isNull(), "error", "cover-undecodable", "the cover is no known image", F.col("path")),
        issue(images, F.col("image.mime").isNotNull() & ~F.col("image.mime").eqNullSafe(F.col("media_type")), "error", "cover-mime-mismatch", F.col("image.mime"), F.col("path")),
        issue(images, F.least(w, h) < LEAST_COVER, "error", "cover-too-small", "the cover is too small", F.col("path")),
        issue(images, (F.least(w, h) >= LEAST_COVER) & (F.greatest(w, h) < GOOD_COVER), "warning", "cover-low-resolution", "the cover is small", F.col("path")),
    ]
    # what follows is judged only where the cover was found; a guide of a package without is not looked at
    shown = images.filter("data IS NOT NULL").select("doc_id", F.element_at(F.split("href", "/"), -1).alias("cover_name")).dropDuplicates(["doc_id"])
    found.append(issue(shown.join(guides, "doc_id", "left_anti"), None, "warning", "guide-cover-missing", "the guide names no cover"))
    # the first entry of the spine, resolved or not; an empty spine opens with nothing
    first = refs.groupBy("doc_id").agg(F.min_by("id", "node").alias("id"))
    opening = shown.join(first, "doc_id", "left").join(items.select("doc_id", "id", "href", "path"), ["doc_id", "id"], "left")
    opens = F.coalesce(F.col("href").contains("cover"), F.lit(False))
    found.append(issue(opening, ~opens, "error", "cover-page-not-first", "the spine does not open with the cover", F.coalesce("path", "id")))
    shown = opening.filter(opens).join(files, ["doc_id", "path"])
    found.append(issue(shown, ~F.decode("data", "utf-8").contains(F.col("cover_name")), "error", "cover-page-missing-image", "the cover page lacks the cover", F.col("path")))
    return union(found)


def check_pages(pages: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """XHTML and its links. pages: doc_id, path, data; nodes: their elements (doc_id, path, malformed, tag, parent_tag, attrs); paths: doc_id, path of the archive."""
    found, a = [], F.col("attrs")
    found.append(issue(nodes, F.col("malformed").isNotNull(), "error", "xhtml-malformed", F.col("malformed"), F.col("path")))
    sound = nodes.filter("malformed IS NULL")
    sound_pages = pages.join(sound.select("doc_id", "path").distinct(), ["doc_id", "path"])
    text = F.decode("data", "iso-8859-1")
    found.append(issue(sound_pages, ~text.rlike('(?i)encoding="utf-8"'), "warning", "xhtml-no-xml-encoding", "no encoding is declared", F.col("path")))
    found.append(issue(sound_pages.join(sound.filter((F.col("tag") == "meta") & (F.col("parent_tag") == "head") & a["charset"].isNotNull()), ["doc_id", "path"], "left_anti"), None, "warning", "xhtml-no-meta-charset", "no charset is declared", F.col("path")))
    found.append(issue(sound_pages, F.octet_length("data") > LARGE_PAGE, "warning", "xhtml-large", "the page is very large", F.col("path")))
    links = sound.filter((F.col("tag") == "a") & a["href"].isNotNull() & ~a["href"].rlike("(?i)^(https?:|mailto:)")).select("doc_id", F.col("path").alias("page"), a["href"].alias("href"))
    parts = links.withColumn("f", split_fragment(F.col("href"))).select("doc_id", "page", "href", F.when(F.col("f.path") == "", F.col("page")).otherwise(resolved(F.col("page"), F.col("f.path"))).alias("path"), F.col("f.fragment").alias("id"))
    found.append(issue(parts.join(paths, ["doc_id", "path"], "left_anti"), None, "error", "internal-link-unresolved", F.col("href"), F.col("page")))
    ids = sound.select("doc_id", "path", a["id"].alias("id")).filter("id IS NOT NULL")
    found.append(issue(parts.filter("id IS NOT NULL AND id <> ''").join(paths, ["doc_id", "path"], "left_semi").join(ids, ["doc_id", "path", "id"], "left_anti"), None, "warning", "fragment-unresolved", F.col("href"), F.col("page")))
    return union(found)


def validate(archives: DataFrame) -> DataFrame:
    """Issues (doc_id, severity, code, message, path) of the archives (doc_id, data).

    All rules read the same entries and XML elements, which are kept (and rebuilt where an executor is lost).
    """
    entries = unpack(archives).persist()
    found = [check_bytes(archives), issue(entries, F.col("error").isNotNull(), "error", "zip-unreadable", F.col("error"))]
    docs = archives.select("doc_id").distinct()
    open_docs = docs.join(entries.filter("error IS NOT NULL"), "doc_id", "left_anti")
    files = entries.filter("error IS NULL").select("doc_id", "path", "data")
    paths = files.select("doc_id", "path").distinct()

    container = files.filter(F.col("path") == CONTAINER)
    found.append(issue(open_docs.join(container, "doc_id", "left_anti"), None, "error", "container-missing", "there is no container file", F.lit(CONTAINER)))
    container_nodes = xml_nodes(container)
    found.append(issue(container_nodes, F.col("malformed").isNotNull(), "error", "container-malformed", F.col("malformed"), F.lit(CONTAINER)))
    roots = container_nodes.filter("tag = 'rootfile'").groupBy("doc_id").agg(F.min_by(F.col("attrs")["full-path"], "node").alias("opf"))
    named = container_nodes.filter("malformed IS NULL").select("doc_id").distinct().join(roots, "doc_id", "left")
    found.append(issue(named, F.coalesce("opf", F.lit("")) == "", "error", "rootfile-missing", "the container names no package file"))
    rooted = roots.filter(F.col("opf") != "")
    opf_files = rooted.join(files.withColumnRenamed("path", "opf"), ["doc_id", "opf"])
    found.append(issue(rooted.join(opf_files, "doc_id", "left_anti"), None, "error", "rootfile-unresolved", "the package file is not in the archive", F.col("opf")))
    opf = xml_nodes(opf_files.withColumnRenamed("opf", "path")).persist()
    found.append(issue(opf, F.col("malformed").isNotNull(), "error", "opf-malformed", F.col("malformed"), F.col("path")))

    good = opf.filter("malformed IS NULL")
    packages = good.select("doc_id", "path").distinct().withColumnRenamed("path", "opf")
    a = F.col("attrs")
    raw_items = good.filter("tag = 'item'").select("doc_id", F.col("path").alias("opf"), a["id"].alias("id"), a["href"].alias("href"), a["media-type"].alias("media_type"), F.split(F.coalesce(a["properties"], F.lit("")), r"\s+").alias("properties"))
    refs = good.filter("tag = 'itemref'").select("doc_id", "node", a["idref"].alias("id"))
    spines = good.filter("tag = 'spine'").select("doc_id", a["toc"].alias("toc"))
    found.append(check_structure(packages, raw_items, refs, spines, paths))

    def first(tag: str) -> Column:
        return F.min_by(F.when(F.col("tag") == tag, F.trim(F.coalesce("text", F.lit("")))), F.when(F.col("tag") == tag, F.col("node")))

    def first_meta(when: Column, value: Column) -> Column:
        own = (F.col("tag") == "meta") & (F.col("parent_tag") == "metadata") & when
        return F.min_by(F.when(own, value), F.when(own, F.col("node")))

    # a prefixed cover is the mistake that the rule is for
    cover = first_meta((a["name"] == "cover") & F.col("prefix").isNull(), F.coalesce(a["content"], F.lit("")))
    modified = first_meta(a["property"] == "dcterms:modified", F.trim(F.coalesce("text", F.lit(""))))
    meta = good.groupBy("doc_id").agg(*[first(t).alias(t) for t in ("title", "language", "identifier", "creator")], modified.alias("modified"), cover.alias("cover"))
    found.append(check_metadata(meta))
    items = usable(raw_items)
    guides = good.filter((F.col("tag") == "reference") & (a["type"] == "cover")).select("doc_id")
    found.append(check_cover(meta, items, files, refs, guides))

    pages = items.filter("media_type = 'application/xhtml+xml'").select("doc_id", "path").distinct().join(files, ["doc_id", "path"])
    found.append(check_pages(pages, xml_nodes(pages).persist(), paths))
    return union(found)


def is_valid(archives: DataFrame, issues: DataFrame) -> DataFrame:
    """ok: no issue is an error."""
    counts = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    both = archives.select("doc_id").join(counts, "doc_id", "left")
    return both.select("doc_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("ok"))
