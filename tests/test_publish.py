"""Packages: the same bytes twice, a clean one without errors, and one broken package for each rule."""

import io
import struct
import zipfile
import zlib

import pytest

from quire.publish.covers import asset_names, select_cover
from quire.publish.package import pack, unpack
from quire.publish.validate import is_valid, validate


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"")) + chunk(b"IEND", b"")


HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
OPF = f"""{HEAD}<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>
<dc:identifier>urn:uuid:12345678-1234-1234-1234-123456789abc</dc:identifier><dc:title>T</dc:title><dc:language>en</dc:language><dc:creator>A</dc:creator>
<meta property="dcterms:modified">2024-01-02T03:04:05Z</meta><meta name="cover" content="img"/></metadata><manifest>
<item id="img" href="images/cover.png" media-type="image/png" properties="cover-image"/><item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>
<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>
<item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml"/></manifest><spine toc="ncx"><itemref idref="cover"/><itemref idref="c1"/></spine>
<guide><reference type="cover" href="cover.xhtml"/></guide></package>"""


def page(body):
    return f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="UTF-8"/><title>t</title></head><body>{body}</body></html>'


CLEAN = {
    "META-INF/container.xml": f'{HEAD}<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
    "OEBPS/content.opf": OPF,
    "OEBPS/images/cover.png": png(1200, 1600),
    "OEBPS/cover.xhtml": page('<img src="images/cover.png" alt=""/>'),
    "OEBPS/nav.xhtml": page('<nav><a href="text/c1.xhtml#h">One</a></nav>'),
    "OEBPS/toc.ncx": f"{HEAD}<ncx/>",
    "OEBPS/text/c1.xhtml": page('<h1 id="h">One</h1><a href="../nav.xhtml">n</a><a href="https://x.y/">o</a>'),
}


def opf(old, new):
    return {"OEBPS/content.opf": OPF.replace(old, new)}


C1 = "OEBPS/text/c1.xhtml"
BROKEN = {
    "container-missing": {"META-INF/container.xml": None},
    "container-malformed": {"META-INF/container.xml": "<container>"},
    "rootfile-missing": {"META-INF/container.xml": "<container/>"},
    "rootfile-unresolved": {"OEBPS/content.opf": None},
    "opf-malformed": {"OEBPS/content.opf": "<package>&</package>"},
    "manifest-item-incomplete": opf('<item id="ncx" href="toc.ncx"', '<item id="ncx"'),
    "manifest-href-unresolved": {"OEBPS/toc.ncx": None},
    "spine-empty": opf('<itemref idref="cover"/><itemref idref="c1"/>', ""),
    "spine-idref-missing": opf('<itemref idref="c1"/>', "<itemref/>"),
    "spine-idref-unresolved": opf('<itemref idref="c1"/>', '<itemref idref="c9"/>'),
    "spine-media-type": opf('<itemref idref="c1"/>', '<itemref idref="img"/>'),
    "nav-count": opf(' properties="nav"', ""),
    "ncx-not-referenced": opf(' toc="ncx"', ""),
    "ncx-unresolved": opf(' toc="ncx"', ' toc="zz"'),
    "orphan-file": {"OEBPS/extra.txt": "x"},
    "dcterms-modified-missing": opf("dcterms:modified", "dcterms:other"),
    "dcterms-modified-format": opf("2024-01-02T03:04:05Z", "2024-01-02"),
    "identifier-format": opf("urn:uuid:", "isbn:"),
    "metadata-missing": opf("<dc:title>T</dc:title>", "<dc:title> </dc:title>"),
    "creator-unknown": opf("<dc:creator>A<", "<dc:creator>Unknown<"),
    "cover-meta-missing": opf('<meta name="cover" content="img"/>', ""),
    "cover-meta-empty": opf('content="img"', 'content=""'),
    "cover-meta-unresolved": opf('content="img"', 'content="zz"'),
    "cover-image-property-missing": opf(' properties="cover-image"', ""),
    "cover-file-missing": {"OEBPS/images/cover.png": None},
    "cover-file-empty": {"OEBPS/images/cover.png": b""},
    "cover-undecodable": {"OEBPS/images/cover.png": b"not an image"},
    "cover-mime-mismatch": {"OEBPS/images/cover.png": b"GIF89a" + struct.pack("<HH", 1200, 1600)},
    "cover-too-small": {"OEBPS/images/cover.png": png(50, 2000)},
    "cover-low-resolution": {"OEBPS/images/cover.png": png(400, 600)},
    "cover-page-not-first": opf('<itemref idref="cover"/><itemref idref="c1"/>', '<itemref idref="c1"/><itemref idref="cover"/>'),
    "cover-page-missing-image": {"OEBPS/cover.xhtml": page("<p>none</p>")},
    "guide-cover-missing": opf('type="cover" href', 'type="toc" href'),
    "xhtml-malformed": {C1: "<html><p></html>"},
    "xhtml-no-xml-encoding": {C1: page('<h1 id="h">x</h1>').removeprefix(HEAD)},
    "xhtml-no-meta-charset": {C1: page('<h1 id="h">x</h1>').replace('<meta charset="UTF-8"/>', "")},
    "xhtml-large": {C1: page('<h1 id="h">x</h1>' + "<p>word</p>" * 30_000)},
    "internal-link-unresolved": {C1: page('<h1 id="h">x</h1><a href="gone.xhtml">g</a>')},
    "fragment-unresolved": {C1: page('<h1 id="other">x</h1>')},
}


OPF_NAMESPACE = ('xmlns:dc="', 'xmlns:opf="http://www.idpf.org/2007/opf" xmlns:dc="')
#: Changes with exactly the issues that follow from them.
EXACT = {
    "another encoding": ({C1: page('<h1 id="h">x</h1>').replace("UTF-8", "latin-1", 1)}, {"xhtml-no-xml-encoding"}),
    "encoding in small letters": ({C1: page('<h1 id="h">x</h1>').replace("UTF-8", "utf-8", 1)}, set()),
    "charset out of place": ({C1: page('<h1 id="h">x</h1><meta charset="UTF-8"/>').replace('<meta charset="UTF-8"/>', "", 1)}, {"xhtml-no-meta-charset"}),
    "image without file": ({C1: page('<h1 id="h">x</h1><img src="gone.png" alt=""/>')}, set()),
    "script and mail": ({C1: page('<h1 id="h">x</h1><a href="javascript:x()">s</a><a href="MAILTO:a@b">m</a>')}, {"internal-link-unresolved"}),
    "prefixed cover": ({"OEBPS/content.opf": OPF.replace(*OPF_NAMESPACE).replace('<meta name="cover" content="img"/>', '<opf:meta name="cover" content="img"/>')}, {"cover-meta-missing"}),
    "first of two covers": (opf('<meta name="cover" content="img"/>', '<meta name="cover" content="img"/><meta name="cover" content="a"/>'), set()),
    "item without type": (opf('href="text/c1.xhtml" media-type="application/xhtml+xml"', 'href="text/c1.xhtml"'), {"spine-media-type", "fragment-unresolved"}),
    "cover without type": (opf('href="images/cover.png" media-type="image/png"', 'href="images/cover.png"'), {"cover-mime-mismatch"}),
    "no cover file, no guide": ({"OEBPS/images/cover.png": None, **opf('type="cover" href', 'type="toc" href')}, {"manifest-href-unresolved", "cover-file-missing"}),
    "empty spine": (opf('<itemref idref="cover"/><itemref idref="c1"/>', ""), {"spine-empty", "cover-page-not-first"}),
    "empty toc name": (opf(' toc="ncx"', ' toc=""'), {"ncx-unresolved"}),
    "undefined entity": ({C1: '<!DOCTYPE html PUBLIC "x" "y">' + page("<p>&nbsp;</p>").removeprefix(HEAD)}, {"xhtml-malformed", "fragment-unresolved"}),
}


def first_bytes(name, content=b"application/epub+zip", compress=zipfile.ZIP_STORED, extra=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        info = zipfile.ZipInfo(name)
        info.extra = extra
        z.writestr(info, content, compress)
        for p, d in CLEAN.items():
            z.writestr(p, d)
    return out.getvalue()


BYTES = {
    "zip-truncated": b"PK\x03\x04",
    "zip-magic": b"x" * 100,
    "zip-unreadable": b"x" * 100,
    "mimetype-not-first": first_bytes("mimetypo"),
    "mimetype-compressed": first_bytes("mimetype", compress=zipfile.ZIP_DEFLATED),
    "mimetype-extra-field": first_bytes("mimetype", extra=b"\x99\x99\x02\x00ab"),
    "mimetype-content": first_bytes("mimetype", b"application/epub+zap"),
    "mimetype-flags": first_bytes("mimetype")[:6] + b"\x08" + first_bytes("mimetype")[7:],
}


@pytest.fixture(scope="module")
def issues(spark):
    rows, names = [], {0: "clean"}
    for k, (code, change) in enumerate([("clean", {}), *BROKEN.items(), *((n, change) for n, (change, _) in EXACT.items())]):
        names[k] = code
        files = {p: d for p, d in (CLEAN | change).items() if d is not None}
        rows += [(k, i, p, d.encode() if isinstance(d, str) else d) for i, (p, d) in enumerate(files.items())]
    archives = pack(spark.createDataFrame(rows, "doc_id long, ord int, path string, data binary"))
    again = {r["doc_id"]: bytes(r["data"]) for r in archives.collect()}
    assert again == {r["doc_id"]: bytes(r["data"]) for r in archives.collect()}
    raw = [(1000 + k, d) for k, d in enumerate(BYTES.values())]
    names |= {1000 + k: code for k, code in enumerate(BYTES)}
    every = spark.createDataFrame([*again.items(), *raw], "doc_id long, data binary").repartition(4).cache()
    found: dict[str, set] = {n: set() for n in names.values()}
    for r in validate(every).collect():
        found[names[r["doc_id"]]].add((r["severity"], r["code"]))
    return found, every, names


def test_a_clean_package_has_no_issue(issues):
    assert issues[0]["clean"] == set()


@pytest.mark.parametrize("code", [*BROKEN, *BYTES])
def test_each_rule_fires(issues, code):
    assert code in {c for _, c in issues[0][code]}


@pytest.mark.parametrize("name", EXACT)
def test_exact_issues(issues, name):
    assert {c for _, c in issues[0][name]} == EXACT[name][1]


def test_validity(issues):
    found, every, names = issues
    ok = {names[r["doc_id"]]: r["ok"] for r in is_valid(every, validate(every.filter("doc_id < 3"))).collect() if r["doc_id"] < 3}
    assert ok["clean"] and not ok["container-missing"]


def test_unpack_gives_the_files_back(issues):
    got = {(r["path"], bytes(r["data"])) for r in unpack(issues[1].filter("doc_id = 0")).collect()}
    assert got == {("mimetype", b"application/epub+zip")} | {(p, d.encode() if isinstance(d, str) else d) for p, d in CLEAN.items()}


def test_asset_names_are_never_given_twice(spark):
    """Numbers that meet names, in any order and over several endings, and the cover's own name."""
    bases = ["a", "a", "a-1", "a-1-1", "a", "a-1", "cover", "cover-1", "cover", "b-2", "b", "b", "b", "c"]
    rows = [(d, k, b, mime) for d in (1, 2) for k, b in enumerate(bases) for mime in ("image/png", "image/jpeg")]
    rows = [(d, 2 * k + (m == "image/jpeg"), b, m) for d, k, b, m in rows]

    def plain(own):
        used, out = {"cover.jpg"}, []
        for _, _, b, m in sorted(own, key=lambda r: r[1]):
            end, n = {"image/png": "png", "image/jpeg": "jpg"}[m], 1
            name = f"{b}.{end}"
            while name in used:
                name, n = f"{b}-{n}.{end}", n + 1
            used.add(name)
            out.append(name)
        return out

    got = asset_names(spark.createDataFrame(rows, "doc_id long, ord int, base string, mime string")).collect()
    for d in (1, 2):
        assert [r["name"] for r in sorted(got, key=lambda r: r["ord"]) if r["doc_id"] == d] == plain([r for r in rows if r[0] == d])


def test_only_two_pages_are_tried_for_a_cover(spark):
    rows = [(1, "rendered", p, 50, p == 6) for p in range(8)] + [(1, "synthesized", None, 0, True), (2, "rendered", 1, 50, True), (2, "synthesized", None, 0, True)]
    got = select_cover(spark.createDataFrame(rows, "doc_id long, source string, page int, score int, usable boolean")).collect()
    assert {(r["doc_id"], r["source"], r["page"]) for r in got} == {(1, "synthesized", None), (2, "rendered", 1)}
