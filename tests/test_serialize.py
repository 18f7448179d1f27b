"""Documents laid out, read back, packaged and validated: nothing is wrong with our own packages and no word is lost."""

import datetime as dt
import re
import zipfile
from html import unescape
from io import BytesIO

from pyspark.sql import functions as F

from quire.plans.extract import extract
from quire.publish.nested_blocks import tree_facts
from quire.publish.package import pack
from quire.publish.serialize import BANNED_CSS, CSS, block_nodes, build, package_files, rebuild, toc_hrefs
from quire.publish.validate import validate
from quire.sources.layout import layout_runs
from tests.conftest import SMALL
from tests.test_publish import png


def test_own_packages_are_valid_and_whole(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 4").select("doc_id", "text", "lang")
    extract(layout_runs(docs)).blocks.write.parquet(f"{tmp_path}/blocks")
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    meta = docs.select("doc_id", F.concat(F.lit("Title <&> "), "doc_id").alias("title"), F.col("lang").alias("language"), F.lit("A. Uthor").alias("creator"), F.lit("12345678-1234-1234-1234-123456789abc").alias("uuid"), F.lit("2024-05-06 07:08:09").cast("timestamp").alias("modified"))
    pack(package_files(block_nodes(blocks), meta, png(1200, 1600))).write.parquet(f"{tmp_path}/archives")
    archives = spark.read.parquet(f"{tmp_path}/archives")
    assert archives.count() == 4
    assert validate(archives).collect() == []
    words = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for r in archives.collect():
        with zipfile.ZipFile(BytesIO(bytes(r["data"]))) as z:
            pages = [z.read(n).decode() for n in z.namelist() if re.search(r"ch\d+\.xhtml", n)]
        kept = " ".join(unescape(re.sub("<[^>]*>", " ", p.split("<body>")[1])) for p in pages).split()
        assert len(kept) >= 0.95 * len(words[r["doc_id"]])


NODE = "doc_id long, node long, parent long, depth int, ord int, kind string, level int, anchor string, text string, asset string, alt string, ordered boolean, inlines array<struct<t:string,s:string,b:boolean,href:string,target:long,asset:string>>"
META = "doc_id long, title string, authors array<string>, language string, publisher string, subjects array<string>, uuid string, modified timestamp"


def trees(spark):
    """Two documents: chapters with a quote that holds a list, a table, figures with and without files, and links between all of them."""

    def text(s, **more):
        return {"t": "text", "s": s} | more

    def link(s, target=None, href=None):
        return {"t": "link", "s": s, "target": target, "href": href}

    def node(doc, i, parent, depth, ord_, kind, inlines=None, level=None, anchor=None, **more):
        return {"doc_id": doc, "node": i, "parent": parent, "depth": depth, "ord": ord_, "kind": kind, "inlines": inlines, "level": level, "anchor": anchor} | {c: more.get(c) for c in ("text", "asset", "alt", "ordered")}

    rows = []
    for doc in (1, 2):
        for c in range(3):
            i = c * 100
            rows += [
                node(doc, i, None, 0, i, "h", [text(f"Part {c}")], 1, f"part-{c}"), node(doc, i + 1, None, 0, i + 1, "p", [text("see "), link("next", (i + 100) % 300), link("there", 13), link("out", href="https://a.org/?a&b"), link("bad", href="javascript:x"), link("lost", 999), {"t": "br", "s": ""}, {"t": "img", "s": "x<y", "asset": "eq"}]),
                node(doc, i + 10, None, 0, i + 2, "quote"), node(doc, i + 11, i + 10, 1, 0, "list", ordered=False), node(doc, i + 12, i + 11, 2, 0, "item"), node(doc, i + 13, i + 12, 3, 0, "p", [text("deep", b=True), link("up", i)]), node(doc, i + 14, i + 10, 1, 1, "code", text="a < b"),
                node(doc, i + 20, None, 0, i + 3, "figure", asset="pic", alt="A & B"), node(doc, i + 21, None, 0, i + 4, "figure", asset="none", alt="gone"), node(doc, i + 22, None, 0, i + 5, "pre", text="r|s", asset="pic"),
            ]
    meta = [(1, "One & two", ["A", "B"], "de", "P", ["x", "y"], "12345678-1234-1234-1234-123456789abc", dt.datetime(2024, 5, 6, 7, 8, 9)), (2, None, [], None, None, None, "12345678-1234-1234-1234-123456789abd", dt.datetime(2024, 5, 6, 7, 8, 9))]
    assets = spark.createDataFrame([(d, k, a, "image/png", png(9, 9)) for d in (1, 2) for k, a in enumerate(["pic", "eq"])], "doc_id long, ord int, asset string, mime string, data binary")
    return spark.createDataFrame(rows, NODE), spark.createDataFrame(meta, META), assets


def test_trees_links_and_assets_come_into_packages(spark, tmp_path):
    tree, meta, assets = trees(spark)
    package_files(tree, meta, png(1200, 1600), assets).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    assert validate(pack(files)).filter("severity = 'error'").collect() == []
    got = {r["path"].removeprefix("OEBPS/"): bytes(r["data"]) for r in files.filter("doc_id = 1").collect()}
    assert set(got) == {"META-INF/container.xml", "content.opf", "cover.xhtml", "nav.xhtml", "toc.ncx", "style.css", "images/cover.png", "images/pic.png", "images/eq.png", "ch000.xhtml", "ch001.xhtml", "ch002.xhtml"}
    one = got["ch001.xhtml"].decode()
    assert '<h1 id="h-part-1">Part 1</h1>' in one
    assert '<p>see <a href="ch002.xhtml#h-part-2">next</a><a href="ch000.xhtml">there</a><a href="https://a.org/?a&amp;b">out</a><span>bad</span><span>lost</span><br/><img src="images/eq.png" alt="x&lt;y"' in one
    assert '    <ul>\n' not in one and '<blockquote>\n  <ul>\n    <li><strong>deep</strong><a href="#h-part-1">up</a></li>\n  </ul>\n  <pre><code>a &lt; b</code></pre>\n</blockquote>' in one
    assert one.count("<img") == 3 and 'alt="A &amp; B"' in one and "gone" not in one
    assert '<span>there</span>' in got["ch000.xhtml"].decode()
    opf = got["content.opf"].decode()
    assert '<dc:creator id="creator-1">B</dc:creator>\n    <meta refines="#creator-1" property="role" scheme="marc:relators">aut</meta>' in opf
    assert "<dc:publisher>P</dc:publisher>\n    <dc:subject>x</dc:subject>\n    <dc:subject>y</dc:subject>\n    <dc:date>2024-05-06T07:08:09Z</dc:date>" in opf
    assert re.findall('<itemref idref="([^"]*)"', opf) == ["cover", "nav", "ch000", "ch001", "ch002"] and re.findall('<item id="(img[^"]*)"', opf) == ["img-pic", "img-eq"]
    assert re.findall('<reference type="([^"]*)"', opf) == ["cover", "toc", "text"]
    assert 'viewBox="0 0 1200 1600"' in got["cover.xhtml"].decode() and '<meta name="dtb:depth" content="1"/>' in got["toc.ncx"].decode() and "<docAuthor><text>A, B</text>" in got["toc.ncx"].decode()
    assert re.findall('playOrder="([0-9]+)"', got["toc.ncx"].decode()) == ["1", "2", "3", "4"]
    two = files.filter("doc_id = 2 AND path = 'OEBPS/content.opf'").first()["data"].decode()
    assert "<dc:title>Untitled</dc:title>" in two and ">Unknown<" in two and 'xml:lang="en"' in two and "publisher" not in two


def test_weights_and_tops_of_any_depth(spark):
    tree, _, _ = trees(spark)
    facts = {r["node"]: (r["top"], r["top_ord"], r["weight"]) for r in tree_facts(tree.filter("doc_id = 1")).collect()}
    deep = '[{"t":"text","s":"deep","b":true},{"t":"link","s":"up","target":0}]'
    held = '[{"blocks":[{"kind":"p","inlines":' + deep + "}]}]"
    assert {facts[i] for i in (10, 11, 12, 13, 14)} == {(10, 2, len(held) + len("a < b"))}
    assert facts[20] == (20, 3, 32) and facts[22] == (22, 5, 3) and facts[0] == (0, 0, len('[{"t":"text","s":"Part 0"}]'))
    assert len(facts) == tree.filter("doc_id = 1").count()
    assert tree_facts(tree.limit(0)).collect() == []


def test_entries_without_heading_lead_to_the_first_chapter_or_the_cover(spark):
    placed = spark.createDataFrame([(1, 0, "h", "h-a", "ch000.xhtml"), (1, 9, "h", "h-b", "ch001.xhtml")], "doc_id long, ord int, kind string, anchor string, chapter_href string")
    entries = spark.createDataFrame([(1, 0, "h-b"), (1, 1, "h-x"), (1, 2, None), (2, 0, "h-b")], "doc_id long, ord int, anchor string")
    assert {(r["doc_id"], r["ord"]): r["href"] for r in toc_hrefs(entries, placed).collect()} == {(1, 0): "ch001.xhtml#h-b", (1, 1): "ch000.xhtml", (1, 2): "ch000.xhtml", (2, 0): "cover.xhtml"}


def test_rebuilding_touches_changed_packages_only(spark, tmp_path):
    tree, meta, assets = trees(spark)
    none = spark.createDataFrame([], "doc_id long, title string, author string, language string")
    build(tree, meta, png(1200, 1600), assets).write.parquet(f"{tmp_path}/built")
    built = spark.read.parquet(f"{tmp_path}/built")
    before = {r["doc_id"]: r for r in built.collect()}
    later = meta.withColumn("modified", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    overrides = none.union(spark.createDataFrame([(1, " ", "A, B", " "), (2, "New", " ,C,", None)], none.schema))
    after = {r["doc_id"]: r for r in rebuild(built, tree, later, png(1200, 1600), overrides, assets).collect()}
    assert sorted(after) == [1, 2] and after[1] == before[1] and after[2]["digest"] != before[2]["digest"]
    with zipfile.ZipFile(BytesIO(bytes(after[2]["data"]))) as z, zipfile.ZipFile(BytesIO(bytes(before[2]["data"]))) as old:
        opf = z.read("OEBPS/content.opf").decode()
        assert z.namelist() == old.namelist() and z.read("OEBPS/ch001.xhtml") == old.read("OEBPS/ch001.xhtml")
    assert "<dc:title>New</dc:title>" in opf and ">C</dc:creator>" in opf and "2025-01-01T00:00:00Z" in opf


def test_stylesheet_holds_nothing_banned():
    plain = CSS.replace(" ", "")
    assert not [b for b in BANNED_CSS if b in plain]
