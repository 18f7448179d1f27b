"""Package files from trees of blocks: chapters as XHTML, navigation, ncx, stylesheet, cover page and the package document.

A tree is a table of nodes as `nested_blocks` describes them, with `inlines` in place of `inline` and `asset` in place of `href`. A link
with a `target` leads to another node of its document, one with an `href` out of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import anchor, ascii_segment, squeeze, strip, xml_escape, xml_sanitize, xml_text
from quire.operators.inlines import STYLES, external_href, image_markup, internal_hrefs, link_markup, styled_markup
from quire.operators.toc import LARGEST, build_toc, chapter_groups, chapters_of, guard_size, merge_tiny
from quire.publish.covers import asset_names
from quire.publish.nested_blocks import depth_of, nested_markup, tree_facts
from quire.publish.package import pack
from quire.session import settled

#: An inline: t is text, link, img or br; s its text, of an img what stands for it.
INLINE_FIELDS = {"t": "string", "s": "string"} | dict.fromkeys(STYLES, "boolean") | {"href": "string", "target": "long", "asset": "string", "width_em": "double", "baseline": "double"}
INLINES = f"array<struct<{','.join(f'{c}:{t}' for c, t in INLINE_FIELDS.items())}>>"
FIELDS = {
    "kind": "string", "level": "int", "anchor": "string", "text": "string", "align": "string", "asset": "string", "alt": "string", "ordered": "boolean", "start": "int", "in_head": "boolean",
    "header": "boolean", "colspan": "int", "rowspan": "int", "page": "int", "label": "string", "inlines": INLINES,
}
MIME = "application/xhtml+xml"
XML = '<?xml version="1.0" encoding="utf-8"?>\n'
#: Nothing that fixes sizes or places on the page; `vw` and `vh` stand for units. Fixed values.
BANNED_CSS = ("position:fixed", "position:absolute", "float:", "@font-face", "display:flex", "display:grid", "!important", "vw", "vh")
CSS = """body { margin: 0 1em; line-height: 1.5; text-align: left; }
h1, h2, h3, h4, h5, h6 { line-height: 1.2; break-after: avoid; page-break-after: avoid; }
h1 { break-before: page; page-break-before: always; }
p { margin: 0 0 0.6em; }
.align-center { text-align: center; }
.align-right { text-align: right; }
.align-justify { text-align: justify; }
blockquote { margin: 0.7em 1em; padding-left: 0.8em; border-left: 3px solid #999; }
pre { white-space: pre-wrap; font-size: 0.8em; }
pre.table-fallback { border: 1px solid #ccc; padding: 0.4em; }
img { max-width: 100%; height: auto; }
figure { margin: 0.8em 0; text-align: center; break-inside: avoid; page-break-inside: avoid; }
table { border-collapse: collapse; width: 100%; }
th, td { border: 1px solid #ccc; padding: 0.3em 0.4em; text-align: left; }
.source-page { display: none; }
nav ol { list-style-type: none; }
"""


def xml_attr(text: Column) -> Column:
    return xml_escape(xml_sanitize(text), attribute=True)


def widened(inlines: Column, given: list[str]) -> Column:
    """Inlines with all fields; those that are not given are null."""
    return F.transform(inlines, lambda i: F.struct(*[(i[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in INLINE_FIELDS.items()]))


def block_nodes(blocks: DataFrame) -> DataFrame:
    """The tree of flat blocks (doc_id, ord, kind, level, text, ordered, list_start and perhaps inlines): a list has one item, which holds a paragraph."""
    plain = F.array(F.struct(F.lit("text").alias("t"), squeeze(F.col("text")).alias("s")))
    held = F.col("inlines") if "inlines" in blocks.columns else plain
    filled = widened(held, blocks.schema["inlines"].dataType.elementType.names if "inlines" in blocks.columns else ["t", "s"])
    base, listed = F.col("ord").cast("long") * 3, F.col("kind") == "list"

    def node(k: int, depth: int, ord_: Column, **fields: Column) -> Column:
        own = [fields.get(c, F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()]
        return F.struct((base + k).alias("node"), (base + k - 1 if k else F.lit(None).cast("long")).alias("parent"), F.lit(depth).alias("depth"), ord_.cast("int").alias("ord"), *own)

    heading = F.col("kind") == "h"
    slug = anchor(F.coalesce("text", F.lit("")), F.concat(F.lit("b"), F.col("ord").cast("string")))
    top = node(0, 0, F.col("ord"), kind=F.col("kind"), level=F.col("level"), anchor=F.when(heading, slug), ordered=F.col("ordered"), start=F.col("list_start"), text=F.when(F.col("kind").isin("code", "pre"), F.col("text")), inlines=F.when(~listed, filled))
    inner = [node(1, 1, F.lit(0), kind=F.lit("item")), node(2, 2, F.lit(0), kind=F.lit("p"), inlines=filled)]
    return blocks.select("doc_id", F.explode(F.when(listed, F.array(top, *inner)).otherwise(F.array(top))).alias("n")).select("doc_id", "n.*")


def complete(tree: DataFrame) -> DataFrame:
    """A tree with all fields; those that are not there are null. Headings bear ids made of their anchors."""
    given = set(tree.columns)
    named = {c: (F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()}
    if "inlines" in given:
        named["inlines"] = widened(F.col("inlines"), tree.schema["inlines"].dataType.elementType.names).alias("inlines")
    whole = tree.select("doc_id", "node", "parent", F.col("depth").cast("int").alias("depth"), F.col("ord").cast("int").alias("ord"), *named.values())
    bears = (F.col("kind") == "h") & F.col("anchor").isNotNull()
    return whole.withColumn("anchor", F.when(bears, F.concat(F.lit("h-"), ascii_segment(F.coalesce("anchor", F.lit("")), "h"))))


def place_blocks(tree: DataFrame, facts: DataFrame, largest: int = LARGEST) -> DataFrame:
    """The blocks at the top with the chapter they come to (chapter, part, chapter_no, chapter_href). facts: what `tree_facts` says of the tree."""
    words = F.array_join(F.transform(F.filter("inlines", lambda i: i["t"] == "text"), lambda i: i["s"]), "")
    weights = facts.filter("node = top").select("doc_id", "node", "weight")
    tops = tree.filter("depth = 0").join(weights, ["doc_id", "node"]).select("doc_id", "node", "ord", "kind", F.coalesce("level", F.lit(0)).alias("level"), "anchor", F.coalesce(words, F.lit("")).alias("text"), "weight")
    parts = guard_size(merge_tiny(chapter_groups(tops)), largest)
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("chapter", "part")) - 1
    return parts.withColumn("chapter_no", number).withColumn("chapter_href", F.concat(chapter_id(number), F.lit(".xhtml")))


def chapter_id(number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit("ch"), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")))


def node_links(tree: DataFrame, facts: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, node, links): for each node with links into its document a map from their targets to where these are, null if nowhere.

    A target at any depth is in the chapter of the block it lies in; only headings at the top can be met more exactly.
    """
    tops = placed.select("doc_id", F.col("ord").alias("top_ord"), "chapter_href")
    heads = placed.filter("kind = 'h'").select("doc_id", "node", "anchor")
    where = facts.join(tops, ["doc_id", "top_ord"]).join(heads, ["doc_id", "node"], "left").select("doc_id", "node", "chapter_href", "anchor")
    targets = F.array_distinct(F.transform(F.filter("inlines", lambda i: (i["t"] == "link") & i["target"].isNotNull()), lambda i: i["target"]))
    wanted = tree.select("doc_id", "node", F.explode(targets).alias("target_ord")).join(where.select("doc_id", "node", F.col("chapter_href").alias("from_href")), ["doc_id", "node"])
    found = internal_hrefs(wanted, where.withColumnRenamed("node", "ord"))
    return found.groupBy("doc_id", "node").agg(F.map_from_entries(F.collect_list(F.struct("target_ord", "href"))).alias("links"))


def asset_hrefs(assets: DataFrame) -> DataFrame:
    """Adds `href`, a path of its own in its package, and `base` to each asset: doc_id, ord, asset, mime, data."""
    based = assets.withColumn("base", ascii_segment(F.coalesce("asset", F.lit("")), "img"))
    return asset_names(based, "png").withColumn("href", F.concat(F.lit("images/"), "name"))


def node_assets(tree: DataFrame, hrefs: DataFrame) -> DataFrame:
    """(doc_id, node, files): for each node that shows assets a map from them to their paths; assets that are not there are not in it."""
    shown = F.transform(F.filter("inlines", lambda i: i["t"] == "img"), lambda i: i["asset"])
    every = F.array_distinct(F.array_compact(F.concat(F.array("asset"), F.coalesce(shown, F.array().cast("array<string>")))))
    last = hrefs.groupBy("doc_id", "asset").agg(F.max_by("href", "ord").alias("href"))
    found = tree.select("doc_id", "node", F.explode(every).alias("asset")).join(last, ["doc_id", "asset"])
    return found.groupBy("doc_id", "node").agg(F.map_from_entries(F.collect_list(F.struct("asset", "href"))).alias("files"))


def inline_text() -> Column:
    """The markup of a node's inlines, with its maps of links and files."""

    def piece(i: Column) -> Column:
        styled = styled_markup(F.coalesce(i["s"], F.lit("")), {c: F.coalesce(i[c], F.lit(False)) for c in STYLES})
        image = image_markup(F.col("files")[i["asset"]], F.coalesce(i["s"], F.lit("")), i["width_em"], i["baseline"])
        link = link_markup(F.when(i["target"].isNotNull(), F.col("links")[i["target"]]).otherwise(external_href(i["href"])), styled)
        return F.when(i["t"] == "br", "<br/>").when(i["t"] == "img", image).when(i["t"] == "link", link).otherwise(styled)

    return F.array_join(F.transform("inlines", piece), "")


def xhtml(title: Column, lang: Column, body: Column, head: Column | str = '  <link rel="stylesheet" type="text/css" href="style.css"/>', attrs: str = "") -> Column:
    opening = F.concat(F.lit(XML + '<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="'), xml_attr(lang), F.lit('" xml:lang="'), xml_attr(lang), F.lit('">'))
    extra = F.lit(head) if isinstance(head, str) else head
    return F.concat(F.concat_ws("\n", opening, F.lit('<head>\n  <meta charset="utf-8"/>'), F.concat(F.lit("  <title>"), xml_text(title), F.lit("</title>")), extra, F.lit(f"</head>\n<body{attrs}>"), body, F.lit("</body>\n</html>")), F.lit("\n"))


def in_order(rows: DataFrame, order: str, **pieces: tuple[Column, str]) -> DataFrame:
    """For each document the pieces of its rows in order, joined by what stands beside them."""
    held = [F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, piece.alias("p")))), lambda s: s["p"]), sep).alias(name) for name, (piece, sep) in pieces.items()]
    return rows.groupBy("doc_id").agg(*held)


def nested(toc: DataFrame, item: Column, opens: str, closes: str, ends_item: str) -> DataFrame:
    """Entries nested by their depth: what an entry closes and opens follows from the depth of the one before."""
    before = F.coalesce(F.lag("depth").over(Window.partitionBy("doc_id").orderBy("ord")), F.lit(0))
    deeper, step = F.col("depth") > before, F.lit(ends_item + closes)
    lead = F.when(deeper, F.lit(opens)).otherwise(F.concat(F.repeat(step, before - F.col("depth")), F.lit(ends_item)))
    text = toc.withColumn("piece", F.concat(lead, item)).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "piece"))), lambda s: s["piece"]), "").alias("text"), F.max_by("depth", "ord").alias("last_depth"), F.max("depth").alias("deepest"))
    return text.select("doc_id", F.concat("text", F.repeat(step, F.col("last_depth"))).alias("text"), "deepest")


def toc_hrefs(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds `href` to entries (doc_id, ord, anchor): the heading with that id, else the first chapter, else the cover."""
    heads = placed.filter("kind = 'h' AND anchor IS NOT NULL").groupBy("doc_id", "anchor").agg(F.min_by("chapter_href", "ord").alias("chapter_href"))
    first = placed.groupBy("doc_id").agg(F.min("chapter_href").alias("first_href"))
    exact = F.concat("chapter_href", F.lit("#"), "anchor")
    return entries.join(heads, ["doc_id", "anchor"], "left").join(first, "doc_id", "left").withColumn("href", F.coalesce(exact, "first_href", F.lit("cover.xhtml")))


def resolve_meta(meta: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """doc_id, title, authors (array), language, uuid, modified, publisher, subjects (array) with their defaults, and `digest`, a hash of all but the time.

    meta: doc_id, uuid, modified and any of title, authors (array) or creator, language, publisher, subjects. overrides: one row of doc_id, title, author (names
    parted by commas), language for a document whose user changed them; a blank title or language changes nothing, an author field without names leaves none.
    """
    given = set(meta.columns)

    def col(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in given else F.lit(None)).cast(kind)

    def filled(c: Column) -> Column:
        return F.nullif(strip(c), F.lit(""))

    authors = col("authors", "array<string>") if "authors" in given else F.array_compact(F.array(filled(col("creator"))))
    plain = meta.select("doc_id", F.nullif(col("title"), F.lit("")).alias("title"), authors.alias("authors"), F.nullif(col("language"), F.lit("")).alias("language"), "uuid", "modified", col("publisher").alias("publisher"), col("subjects", "array<string>").alias("subjects"))
    if overrides is not None:
        names = F.filter(F.transform(F.split("o_author", ","), strip), lambda a: a != "")
        changed = overrides.select("doc_id", filled(F.col("title")).alias("o_title"), F.col("author").alias("o_author"), filled(F.col("language")).alias("o_language"))
        plain = plain.join(changed, "doc_id", "left").withColumn("title", F.coalesce("o_title", "title")).withColumn("authors", F.coalesce(names, "authors")).withColumn("language", F.coalesce("o_language", "language"))
    none = F.array().cast("array<string>")
    whole = plain.select("doc_id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("authors", none).alias("authors"), F.coalesce("language", F.lit("en")).alias("language"), "uuid", "modified", F.nullif("publisher", F.lit("")).alias("publisher"), F.coalesce("subjects", none).alias("subjects"))
    return whole.withColumn("digest", F.sha2(F.to_json(F.struct("title", "authors", "language", "uuid", "publisher", "subjects")), 256))


def package_document(cover_mime: str = "image/png") -> Column:
    """The package document, from metadata and the lines of chapters and images."""
    stamp = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def tag(name: str, value: Column, attrs: str = "") -> Column:
        return F.concat(F.lit(f"    <dc:{name}{attrs}>"), value, F.lit(f"</dc:{name}>"))

    shown = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.array(F.lit("Unknown")))
    roles = F.transform(shown, lambda a, k: F.concat(F.lit('    <dc:creator id="creator-'), k.cast("string"), F.lit('">'), xml_text(a), F.lit('</dc:creator>\n    <meta refines="#creator-'), k.cast("string"), F.lit('" property="role" scheme="marc:relators">aut</meta>')))
    return F.concat(F.concat_ws(
        "\n",
        F.concat(F.lit(XML + '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="BookId" xml:lang="'), xml_attr(F.col("language")), F.lit('">')),
        F.lit('  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">'),
        tag("identifier", F.concat(F.lit("urn:uuid:"), xml_text(F.col("uuid"))), ' id="BookId"'), tag("title", xml_text(F.col("title"))), F.array_join(roles, "\n"), tag("language", xml_attr(F.col("language"))),
        F.when(F.col("publisher").isNotNull(), tag("publisher", xml_text(F.col("publisher")))), F.nullif(F.array_join(F.transform("subjects", lambda s: tag("subject", xml_text(s))), "\n"), F.lit("")),
        tag("date", stamp), F.concat(F.lit('    <meta property="dcterms:modified">'), stamp, F.lit("</meta>")), F.lit('    <meta name="cover" content="cover-img"/>\n  </metadata>\n  <manifest>'),
        F.lit(f'    <item id="cover-img" href="images/cover.png" media-type="{cover_mime}" properties="cover-image"/>\n    <item id="cover" href="cover.xhtml" media-type="{MIME}" properties="svg"/>'),
        F.lit(f'    <item id="nav" href="nav.xhtml" media-type="{MIME}" properties="nav"/>\n    <item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>\n    <item id="css" href="style.css" media-type="text/css"/>'),
        "items", "images", F.lit('  </manifest>\n  <spine toc="ncx">\n    <itemref idref="cover" linear="yes"/>\n    <itemref idref="nav" linear="yes"/>'), "refs", F.lit("  </spine>\n  <guide>"),
        F.lit('    <reference type="cover" title="Cover" href="cover.xhtml"/>\n    <reference type="toc" title="Table of Contents" href="nav.xhtml"/>'),
        F.concat(F.lit('    <reference type="text" title="Beginning" href="'), "first_href", F.lit('"/>')), F.lit("  </guide>\n</package>"),
    ), F.lit("\n"))


def navigation() -> Column:
    """The navigation document: the table of contents and the landmarks. Without entries it leads to the first chapter, as an empty list is none."""
    start = F.concat(F.lit('<li><a epub:type="bodymatter" href="'), "first_href", F.lit('">Start of Content</a></li>'))
    empty = F.concat(F.lit('<ol><li><a href="'), "first_href", F.lit('">'), xml_text(F.col("title")), F.lit("</a></li></ol>"))
    body = F.concat_ws(
        "\n", F.lit('  <nav epub:type="toc" id="toc">\n    <h1>Contents</h1>'), F.coalesce("nav", empty), F.lit('  </nav>\n  <nav epub:type="landmarks" id="landmarks" hidden="hidden">\n    <h2>Guide</h2>'),
        F.concat(F.lit('    <ol><li><a epub:type="cover" href="cover.xhtml">Cover</a></li><li><a epub:type="toc" href="nav.xhtml">Table of Contents</a></li>'), start, F.lit("</ol>")), F.lit("  </nav>"),
    )
    return xhtml(F.lit("Contents"), F.col("language"), body)


def nav_point(order: Column, label: Column, href: Column) -> Column:
    number = order.cast("string")
    return F.concat(F.lit('<navPoint id="np'), number, F.lit('" playOrder="'), number, F.lit('"><navLabel><text>'), xml_text(label), F.lit('</text></navLabel><content src="'), xml_attr(href), F.lit('"/>'))


def ncx() -> Column:
    """The older table of contents; the cover comes first, and the depth is that of the entries."""
    author = F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise("Unknown")
    depth = F.greatest(F.coalesce("toc_depth", F.lit(1)), F.lit(1)).cast("string")
    return F.concat(F.concat_ws(
        "\n", F.concat(F.lit(XML + '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1" xml:lang="'), xml_attr(F.col("language")), F.lit('">')),
        F.concat(F.lit('  <head>\n    <meta name="dtb:uid" content="urn:uuid:'), xml_attr(F.col("uuid")), F.lit('"/>\n    <meta name="dtb:depth" content="'), depth, F.lit('"/>\n    <meta name="dtb:totalPageCount" content="0"/>\n    <meta name="dtb:maxPageNumber" content="0"/>\n  </head>')),
        F.concat(F.lit("  <docTitle><text>"), xml_text(F.col("title")), F.lit("</text></docTitle>\n  <docAuthor><text>"), xml_text(author), F.lit("</text></docAuthor>\n  <navMap>")),
        F.concat(nav_point(F.lit(1), F.lit("Cover"), F.lit("cover.xhtml")), F.lit("</navPoint>")), "points", F.lit("  </navMap>\n</ncx>"),
    ), F.lit("\n"))


def cover_page(width: int, height: int) -> Column:
    alt = xml_attr(F.concat(F.lit("Cover of "), "title"))
    body = F.concat(
        F.lit(f'  <div style="height: 100%; margin: 0; padding: 0;"><svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" version="1.1" width="100%" height="100%" viewBox="0 0 {width} {height}" preserveAspectRatio="xMidYMid meet" role="img" aria-label="'),
        alt, F.lit('"><title>'), alt, F.lit(f'</title><image width="{width}" height="{height}" xlink:href="images/cover.png"/></svg></div>'),
    )
    style = '  <style type="text/css">html, body { margin: 0; padding: 0; height: 100%; background: #ffffff; text-align: center; }</style>'
    return xhtml(F.lit("Cover"), F.col("language"), body, style, ' epub:type="cover"')


def package_texts(placed: DataFrame, meta: DataFrame, hrefs: DataFrame | None = None, toc: DataFrame | None = None, size: tuple[int, int] = (1600, 2560)) -> DataFrame:
    """(doc_id, title, opf, cover, nav, ncx) of each document of the metadata. placed: from `place_blocks`; meta: from `resolve_meta`; hrefs: from `asset_hrefs`.

    toc: doc_id, ord, label, depth, anchor (as the headings bear it), if it is not to be made of the headings.
    """
    if toc is None:
        heads = placed.filter("kind = 'h'").select("doc_id", "ord", "anchor")
        toc = build_toc(placed.select("doc_id", "ord", "kind", "level", "text")).join(heads, ["doc_id", "ord"]).select("doc_id", "ord", "label", "depth", "anchor")
    play = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) + 1
    entries = toc_hrefs(toc, placed).withColumn("play_order", play)
    nav = nested(entries, F.concat(F.lit('<li><a href="'), xml_attr(F.col("href")), F.lit('">'), xml_text(F.col("label")), F.lit("</a>")), "<ol>", "</ol>", "</li>")
    points = nested(entries, nav_point(F.col("play_order"), F.col("label"), F.col("href")), "", "", "</navPoint>")
    names = placed.select("doc_id", "chapter_no", "chapter_href").distinct().withColumn("id", chapter_id(F.col("chapter_no")))
    lists = in_order(names, "chapter_no", items=(F.concat(F.lit('    <item id="'), "id", F.lit('" href="'), "chapter_href", F.lit(f'" media-type="{MIME}"/>')), "\n"), refs=(F.concat(F.lit('    <itemref idref="'), "id", F.lit('"/>')), "\n"))
    whole = meta.join(lists, "doc_id", "left").join(nav.select("doc_id", F.col("text").alias("nav"), F.col("deepest").alias("toc_depth")), "doc_id", "left").join(points.select("doc_id", F.col("text").alias("points")), "doc_id", "left")
    if hrefs is None:
        whole = whole.withColumn("images", F.lit(None).cast("string"))
    else:
        image = F.concat(F.lit('    <item id="img-'), F.regexp_extract("name", r"^(.*)\.[^.]*\z", 1), F.lit('" href="'), xml_attr(F.col("href")), F.lit('" media-type="'), "mime", F.lit('"/>'))
        whole = whole.join(in_order(hrefs, "ord", images=(image, "\n")), "doc_id", "left")
    ready = whole.withColumn("first_href", F.when(F.col("items").isNull(), "cover.xhtml").otherwise("ch000.xhtml"))
    return ready.select("doc_id", "title", package_document().alias("opf"), cover_page(*size).alias("cover"), navigation().alias("nav"), ncx().alias("ncx"))


def chapter_texts(tree: DataFrame, facts: DataFrame, placed: DataFrame, meta: DataFrame, hrefs: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """(doc_id, chapter_no, chapter_href, text): the chapters as XHTML, with links of any depth and the files of figures, snapshots and images in the line."""
    linked = tree.join(node_links(tree, facts, placed), ["doc_id", "node"], "left")
    shown = linked.withColumn("files", F.lit(None).cast("map<string,string>")) if hrefs is None else linked.join(node_assets(tree, hrefs), ["doc_id", "node"], "left")
    ready = shown.withColumn("inline", inline_text()).withColumn("href", F.col("files")[F.col("asset")])
    marked = nested_markup(ready, deepest).filter("markup <> ''")
    body = marked.join(placed.select("doc_id", "node", "chapter_no"), ["doc_id", "node"]).groupBy("doc_id", "chapter_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "markup"))), lambda s: s["markup"]), "\n").alias("body"))
    titled = chapters_of(placed, meta.select("doc_id", "title")).select("doc_id", "chapter_no", F.col("title").alias("shown"), F.col("href").alias("chapter_href"))
    pages = titled.join(body, ["doc_id", "chapter_no"], "left").join(meta.select("doc_id", "language"), "doc_id")
    return pages.select("doc_id", "chapter_no", "chapter_href", xhtml(F.col("shown"), F.col("language"), F.coalesce("body", F.lit(""))).alias("text"))


def package_files(tree: DataFrame, meta: DataFrame, cover: bytes, assets: DataFrame | None = None, toc: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, path, data) of the packages of all documents with metadata.

    tree: blocks as nodes, `block_nodes` makes them of flat ones; cover: a PNG; assets: doc_id, ord, asset, mime, data; meta and overrides: see `resolve_meta`;
    toc: see `package_texts`. Places of nodes and blocks are settled when this is called, all else when the files are read. Figures whose asset is not there vanish, links that lead nowhere leave their text.
    """
    whole, resolved = complete(tree), resolve_meta(meta, overrides)
    deepest = depth_of(tree)
    # all texts of a package are read off these two tables
    facts = settled(tree_facts(whole, deepest))
    placed = settled(place_blocks(whole, facts))
    hrefs = None if assets is None else asset_hrefs(assets)
    container = XML + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    size = int.from_bytes(cover[16:20]), int.from_bytes(cover[20:24])
    texts: list[tuple[str, Callable[[], Column]]] = [
        ("META-INF/container.xml", lambda: F.lit(container)), ("OEBPS/content.opf", lambda: F.col("opf")), ("OEBPS/cover.xhtml", lambda: F.col("cover")), ("OEBPS/nav.xhtml", lambda: F.col("nav")),
        ("OEBPS/toc.ncx", lambda: F.col("ncx")), ("OEBPS/style.css", lambda: F.lit(CSS)), ("OEBPS/images/cover.png", lambda: F.lit(cover)),
    ]
    fixed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(path).alias("path"), data().cast("binary").alias("data")) for k, (path, data) in enumerate(texts)])
    files = package_texts(placed, resolved, hrefs, toc, size).select("doc_id", F.inline(fixed))
    chapters = chapter_texts(whole, facts, placed, resolved, hrefs, deepest).select("doc_id", (F.col("chapter_no") + len(texts)).cast("int").alias("ord"), F.concat(F.lit("OEBPS/"), "chapter_href").alias("path"), F.col("text").cast("binary").alias("data"))
    files = files.unionAll(chapters)
    return files if hrefs is None else files.unionAll(hrefs.join(resolved, "doc_id", "left_semi").select("doc_id", (F.col("ord") + 1_000_000).cast("int").alias("ord"), F.concat(F.lit("OEBPS/"), "href").alias("path"), "data"))


def rebuild(built: DataFrame, tree: DataFrame, meta: DataFrame, cover: bytes, overrides: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(doc_id, data, digest) of all packages after changes to their metadata: those whose metadata comes out the same stay as they are, byte for byte.

    built: what this or `build` returned. Only the trees and assets of changed documents are read into new packages.
    """
    now = resolve_meta(meta, overrides)
    changed = now.join(built.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").select("doc_id")

    def of(rows: DataFrame | None) -> DataFrame | None:
        return None if rows is None else rows.join(changed, "doc_id", "left_semi")

    fresh = build(of(tree), of(meta), cover, of(assets), overrides)
    return built.select("doc_id", "data", "digest").join(changed, "doc_id", "left_anti").unionByName(fresh)


def build(tree: DataFrame, meta: DataFrame, cover: bytes, assets: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(doc_id, data, digest): packed archives, and the hash of the metadata they were made with."""
    packed = pack(package_files(tree, meta, cover, assets, None, overrides))
    return packed.join(resolve_meta(meta, overrides).select("doc_id", "digest"), "doc_id").select("doc_id", "data", "digest")
