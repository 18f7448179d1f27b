"""Driver queries of the validator: each layer of rules on relations of packages with planted faults.

Every document is a package; which faults it has follows from its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.publish import validate as V
from quire.sources.layout import read_table

OPF, XHTML = "OEBPS/content.opf", "application/xhtml+xml"
ITEM = "array<struct<id string, href string, media_type string, properties array<string>>>"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").select("doc_id", "lang", "source")


def _packages(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(OPF).alias("opf"))


def _item(name: str, href: Column | str, media_type: Column | str, prop: Column | str = "") -> Column:
    values = [c if isinstance(c, Column) else F.lit(c) for c in (name, href, media_type, prop)]
    return F.struct(*[c.alias(n) for c, n in zip(values[:3], ("id", "href", "media_type"), strict=True)], F.array(values[3]).alias("properties"))


def _items(docs: DataFrame, items: list[Column]) -> DataFrame:
    return docs.select("doc_id", F.lit(OPF).alias("opf"), F.inline(F.array(*items).cast(ITEM)))


def _found(issues: DataFrame) -> DataFrame:
    return issues.select("doc_id", "severity", "code", "path")


def v_bytes(s: SparkSession, d: str) -> DataFrame:
    """First entries with wrong marks, flags, names and contents, cut and missing archives; above 58 bytes counts as large."""
    i = F.col("doc_id")

    def pick(when: Column, bad: str, good: str) -> Column:
        return F.when(when, bad).otherwise(good)

    name, content = pick(i % 8 == 5, "mimetypo", "mimetype"), pick(i % 9 == 4, "application/epub+zap", "application/epub+zip")
    whole = F.concat(pick(i % 7 == 0, "00000000", "504B0304"), F.lit("1400"), pick(i % 5 == 0, "0800", "0000"), pick(i % 6 == 1, "0800", "0000"), F.lit("00" * 16), pick(i % 11 == 3, "0900", "0800"), pick(i % 13 == 2, "0400", "0000"), F.hex(name), F.hex(content), pick(i % 3 == 0, "AA", ""))
    data = F.when(i % 19 != 0, F.unhex(F.when(i % 17 == 0, F.left(whole, F.lit(114))).otherwise(whole)))
    return _found(V.check_bytes(_docs(s, d).select("doc_id", data.alias("data")), large=58))


def v_structure(s: SparkSession, d: str) -> DataFrame:
    """Incomplete and unresolved items, items without a type, broken spines, none or two navigation documents, unlisted files."""
    docs, i = _docs(s, d), F.col("doc_id")
    items = _items(docs, [
        _item("img", "images/cover.png", "image/png", "cover-image"),
        _item("nav", "nav.xhtml", XHTML, F.when(i % 6 == 0, "").otherwise("nav")),
        _item("ncx", F.when(i % 7 != 0, "toc.ncx"), "application/x-dtbncx+xml"),
        _item("c1", "text/../text/c1.xhtml", XHTML, F.when(i % 11 == 0, "nav").otherwise("")),
        _item("c2", "text/c%202.xhtml", F.when(i % 8 != 0, XHTML)),
    ])
    there = F.array(*map(F.lit, ["mimetype", "META-INF/container.xml", OPF, "OEBPS/nav.xhtml", "OEBPS/toc.ncx", "OEBPS/text/c 2.xhtml"]), F.when(i % 5 != 1, "OEBPS/images/cover.png"), F.when(i % 9 != 2, "OEBPS/text/c1.xhtml"), F.when(i % 4 == 3, "OEBPS/extra.txt"))
    paths = docs.select("doc_id", F.explode(F.array_compact(there)).alias("path"))
    third = F.when(i % 3 == 0, "c2").when(i % 3 == 1, "gone").otherwise("img")
    refs = docs.filter(i % 13 != 0).select("doc_id", F.posexplode(F.array(F.lit("c1"), third, F.when(i % 10 != 4, "nav"))).alias("node", "id"))
    spines = docs.select("doc_id", F.when(i % 12 == 1, "zz").when(i % 12 == 5, "").when(i % 12 != 0, "ncx").alias("toc"))
    return _found(V.check_structure(_packages(docs), items, refs, spines, paths))


def v_metadata(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    uuid = "12345678-1234-1234-1234-123456789abc"
    meta = _docs(s, d).select(
        "doc_id", F.when(i % 5 == 0, "").when(i % 5 != 1, F.col("source")).alias("title"), F.when(i % 7 == 0, "").otherwise(F.col("lang")).alias("language"),
        F.when(i % 4 == 0, f"urn:uuid:{uuid}").when(i % 4 == 1, f"URN:UUID:{uuid}").when(i % 4 == 2, "urn:uuid:xyz").alias("identifier"), F.when(i % 3 == 0, "Unknown").when(i % 3 == 1, F.col("source")).alias("creator"),
        F.when(i % 6 == 0, "2024-01-02").when(i % 6 == 1, "2024-01-02T03:04:05Z\n").when(i % 6 != 2, "2024-01-02T03:04:05Z").alias("modified"), F.when(i % 8 == 0, "").when(i % 8 != 1, "img").alias("cover"),
    )
    return _found(V.check_metadata(meta))


def v_cover(s: SparkSession, d: str) -> DataFrame:
    """Covers of all sizes, some missing, empty, no image or of another type; spines that open with another page."""
    docs, i = _docs(s, d), F.col("doc_id")
    w, h = i * 37 % 1500 + 1, i * 53 % 2000 + 1

    def little(n: Column) -> Column:
        return F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))

    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(h), 8, "0")))
    gif = F.unhex(F.concat(F.lit("474946383961"), little(w), little(h)))
    image = F.when(i % 10 == 1, F.unhex(F.lit(""))).when(i % 10 == 2, gif).when(i % 10 == 3, F.unhex(F.lit("6E6F20696D616765"))).otherwise(png)
    shown = F.encode(F.when(i % 5 == 0, "none").otherwise('<img src="images/cover.png"/>'), "utf-8")
    files = docs.filter(i % 10 != 0).select("doc_id", F.lit("OEBPS/images/cover.png").alias("path"), image.alias("data")).unionAll(docs.select("doc_id", F.lit("OEBPS/cover.xhtml"), shown))
    items = V.usable(_items(docs, [_item("img", "images/cover.png", F.when(i % 14 != 3, "image/png"), F.when(i % 9 == 0, "").otherwise("cover-image")), _item("cover", "cover.xhtml", XHTML), _item("c1", "text/c1.xhtml", XHTML)]))
    meta = docs.select("doc_id", F.when(i % 11 == 0, "zz").otherwise("img").alias("cover"))
    refs = docs.filter(i % 13 != 5).select("doc_id", F.posexplode(F.when(i % 4 == 0, F.array(F.lit("c1"), F.lit("cover"))).otherwise(F.array(F.lit("cover"), F.lit("c1")))).alias("node", "id"))
    return _found(V.check_cover(meta, items, files, refs, docs.filter(i % 6 != 0).select("doc_id")))


def v_pages(s: SparkSession, d: str) -> DataFrame:
    """Three pages a package: malformed ones, none or another encoding, no charset or one out of place, a large one, links to missing pages and ids, scripts and mail."""
    docs, i, k = _docs(s, d), F.col("doc_id"), F.col("k")
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("path", F.concat(F.lit("OEBPS/text/p"), "k", F.lit(".xhtml")))
    text = F.concat(F.when((i + k) % 5 == 0, "<html>").when((i + k) % 5 == 1, '<?xml version="1.0" encoding="latin-1"?><html>').otherwise('<?xml version="1.0" encoding="UTF-8"?><html>'), F.when((i % 97 == 0) & (k == 0), F.repeat(F.lit("x"), F.lit(V.LARGE_PAGE))).otherwise(""))
    hrefs = F.array(*map(F.lit, ["p1.xhtml#h1", "#h2", "gone.xhtml", "https://x.y/", "../text/p2.xhtml#h0", "p0.xhtml#", "p%31.xhtml#h0", "p9.xhtml#h0", "javascript:x()", "MAILTO:a@b"]))
    node = "array<struct<malformed string, tag string, parent_tag string, attrs map<string,string>>>"

    def element(tag: str, key: str, value: Column, up: Column | str = "body") -> Column:
        return F.struct(F.lit(None).cast("string").alias("malformed"), F.lit(tag).alias("tag"), (up if isinstance(up, Column) else F.lit(up)).alias("parent_tag"), F.create_map(F.lit(key), value).alias("attrs"))

    links = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: element("a", "href", F.get(hrefs, ((i + k + j) % 10).cast("int"))))
    # neither images nor links of other elements are looked at
    others = F.array(element("img", "src", F.lit("gone.png")), element("link", "href", F.lit("gone.css"), "head"))
    ids = F.transform(F.sequence(F.lit(0), (i % 3).cast("int")), lambda j: element("h1", "id", F.concat(F.lit("h"), j.cast("string"))))
    charset = F.array(element("meta", "name", F.lit("x")), F.when((i + k) % 4 != 0, element("meta", "charset", F.lit("UTF-8"), F.when((i + k) % 4 == 1, "body").otherwise("head"))))
    broken = F.array(F.struct(F.lit("broken").alias("malformed"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("parent_tag"), F.lit(None).cast("map<string,string>").alias("attrs")))
    nodes = pages.select("doc_id", "path", F.inline(F.when((i + k) % 7 == 0, broken.cast(node)).otherwise(F.array_compact(F.concat(charset, ids, links, others)).cast(node))))
    return _found(V.check_pages(pages.select("doc_id", "path", F.encode(text, "utf-8").alias("data")), nodes, pages.select("doc_id", "path")))


ALL = [v_bytes, v_structure, v_metadata, v_cover, v_pages]
