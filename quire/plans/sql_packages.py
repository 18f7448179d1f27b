"""The SQL of the validator's queries: which issues follow from each planted fault."""

from __future__ import annotations


def issues(rules: list[tuple[str, str, str, str]], source: str) -> str:
    """One row for each rule (severity, code, condition, path) that holds for a row of the source."""
    return " UNION ALL ".join(f"SELECT doc_id, '{s}' AS severity, '{c}' AS code, ({p})::VARCHAR AS path FROM {source} WHERE {w}" for s, c, w, p in rules)


COVER, C1, C2 = "'OEBPS/images/cover.png'", "'OEBPS/text/c1.xhtml'", "'OEBPS/text/c 2.xhtml'"
ZIPPED = "doc_id % 19 <> 0 AND doc_id % 17 <> 0 AND doc_id % 7 <> 0"
NAMED = f"{ZIPPED} AND doc_id % 11 <> 3 AND doc_id % 8 <> 5"
RESOLVED = "doc_id % 11 <> 0"
SIZED = f"{RESOLVED} AND doc_id % 10 NOT IN (0, 1, 3)"
FOUND = f"{RESOLVED} AND doc_id % 10 <> 0"
OPENING = f"doc_id % 13 <> 5 AND {FOUND}"
LEAST, MOST = "least(doc_id * 37 % 1500 + 1, doc_id * 53 % 2000 + 1)", "greatest(doc_id * 37 % 1500 + 1, doc_id * 53 % 2000 + 1)"

BYTES = [
    ("warning", "epub-large", "doc_id % 19 <> 0 AND doc_id % 17 <> 0 AND doc_id % 3 = 0", "NULL"),
    ("error", "zip-truncated", "doc_id % 19 = 0 OR doc_id % 17 = 0", "NULL"),
    ("error", "zip-magic", "doc_id % 19 <> 0 AND doc_id % 17 <> 0 AND doc_id % 7 = 0", "NULL"),
    ("error", "mimetype-flags", f"{ZIPPED} AND doc_id % 5 = 0", "NULL"),
    ("error", "mimetype-compressed", f"{ZIPPED} AND doc_id % 6 = 1", "NULL"),
    ("error", "mimetype-not-first", f"{ZIPPED} AND (doc_id % 11 = 3 OR doc_id % 8 = 5)", "NULL"),
    ("error", "mimetype-extra-field", f"{ZIPPED} AND doc_id % 13 = 2", "NULL"),
    ("error", "mimetype-content", f"{NAMED} AND doc_id % 13 <> 2 AND doc_id % 9 = 4", "NULL"),
]
STRUCTURE = [
    ("error", "manifest-item-incomplete", "doc_id % 7 = 0", "NULL"),
    ("error", "manifest-href-unresolved", "doc_id % 5 = 1", COVER),
    ("error", "manifest-href-unresolved", "doc_id % 9 = 2", C1),
    ("error", "spine-empty", "doc_id % 13 = 0", "NULL"),
    ("error", "spine-idref-missing", "doc_id % 13 <> 0 AND doc_id % 10 = 4", "NULL"),
    ("error", "spine-idref-unresolved", "doc_id % 13 <> 0 AND doc_id % 3 = 1", "NULL"),
    ("error", "spine-media-type", "doc_id % 13 <> 0 AND doc_id % 3 = 2", COVER),
    ("error", "spine-media-type", "doc_id % 13 <> 0 AND doc_id % 3 = 0 AND doc_id % 8 = 0", C2),
    ("error", "nav-count", "(CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END) + (CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) <> 1", "NULL"),
    ("warning", "ncx-not-referenced", "doc_id % 12 = 0", "NULL"),
    ("error", "ncx-unresolved", "doc_id % 12 IN (1, 5) OR (doc_id % 12 <> 0 AND doc_id % 7 = 0)", "NULL"),
    ("warning", "orphan-file", "doc_id % 4 = 3", "'OEBPS/extra.txt'"),
    ("warning", "orphan-file", "doc_id % 7 = 0", "'OEBPS/toc.ncx'"),
]
METADATA = [
    ("error", "dcterms-modified-missing", "doc_id % 6 = 2", "NULL"),
    ("error", "dcterms-modified-format", "doc_id % 6 IN (0, 1)", "NULL"),
    ("error", "identifier-format", "doc_id % 4 <> 0", "NULL"),
    ("error", "metadata-missing", "coalesce(CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 <> 1 THEN source END, '') = ''", "NULL"),
    ("error", "metadata-missing", "coalesce(CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END, '') = ''", "NULL"),
    ("warning", "creator-unknown", "doc_id % 3 <> 1 OR coalesce(source, '') IN ('', 'Unknown')", "NULL"),
    ("error", "cover-meta-missing", "doc_id % 8 = 1", "NULL"),
    ("error", "cover-meta-empty", "doc_id % 8 = 0", "NULL"),
]
COVERS = [
    ("error", "cover-meta-unresolved", "doc_id % 11 = 0", "NULL"),
    ("error", "cover-image-property-missing", f"{RESOLVED} AND doc_id % 9 = 0", COVER),
    ("error", "cover-file-missing", f"{RESOLVED} AND doc_id % 10 = 0", COVER),
    ("error", "cover-file-empty", f"{RESOLVED} AND doc_id % 10 = 1", COVER),
    ("error", "cover-undecodable", f"{RESOLVED} AND doc_id % 10 = 3", COVER),
    ("error", "cover-mime-mismatch", f"{SIZED} AND (doc_id % 10 = 2 OR doc_id % 14 = 3)", COVER),
    ("error", "cover-too-small", f"{SIZED} AND {LEAST} < 100", COVER),
    ("warning", "cover-low-resolution", f"{SIZED} AND {LEAST} >= 100 AND {MOST} < 1000", COVER),
    ("warning", "guide-cover-missing", f"{FOUND} AND doc_id % 6 = 0", "NULL"),
    ("error", "cover-page-not-first", f"{OPENING} AND doc_id % 4 = 0", C1),
    ("error", "cover-page-not-first", f"{FOUND} AND doc_id % 13 = 5", "NULL"),
    ("error", "cover-page-missing-image", f"{OPENING} AND doc_id % 4 <> 0 AND doc_id % 5 = 0", "'OEBPS/cover.xhtml'"),
]
PAGES = [
    ("error", "xhtml-malformed", "NOT sound", "path"),
    ("warning", "xhtml-no-xml-encoding", "sound AND (doc_id + k) % 5 IN (0, 1)", "path"),
    ("warning", "xhtml-no-meta-charset", "sound AND (doc_id + k) % 4 IN (0, 1)", "path"),
    ("warning", "xhtml-large", "sound AND doc_id % 97 = 0 AND k = 0", "path"),
]
#: Links by their number: the page they lead to, the number of the id they name.
LINKS = [
    ("error", "internal-link-unresolved", "n IN (2, 7, 8)", "path"),
    ("warning", "fragment-unresolved", "id IS NOT NULL AND ((doc_id + target) % 7 = 0 OR id > doc_id % 3)", "path"),
]

SQL = {
    "v_bytes": issues(BYTES, "documents"),
    "v_structure": issues(STRUCTURE, "documents"),
    "v_metadata": issues(METADATA, "documents"),
    "v_cover": issues(COVERS, "documents"),
    "v_pages": f"""WITH p AS (SELECT doc_id, k, (doc_id + k) % 7 <> 0 AS sound, 'OEBPS/text/p' || k || '.xhtml' AS path FROM documents, range(3) t(k)),
l AS (SELECT *, (doc_id + k + j) % 10 AS n FROM p, range(3) u(j) WHERE sound),
links AS (SELECT *, CASE n WHEN 0 THEN 1 WHEN 1 THEN k WHEN 4 THEN 2 WHEN 6 THEN 1 END AS target, CASE n WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 0 WHEN 6 THEN 0 END AS id FROM l)
{issues(PAGES, "p")} UNION ALL {issues(LINKS, "links")}""",
}
