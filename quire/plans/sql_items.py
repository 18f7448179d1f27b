"""The SQL of the queries on text items, inlines, metadata, covers and warnings."""

from __future__ import annotations

from quire.plans.sql import BLOCKS, GLYPHS, MERGED, PACKED, PARTS, RUNS, squeezed

#: Whether a line t is letter-spaced.
TRACKED_TEST = f"""(list_reduce(list_prepend(0, {GLYPHS}), lambda a, c: CASE WHEN c = 0 THEN a WHEN c = -1 THEN a % 100000 ELSE (a // 100000 + 1) * 100000 + greatest(a % 100000, a // 100000 + 1) END) % 100000 >= 4
  AND NOT list_has_any(string_split(t, ' '), ['=', '+', '*', '/', '<', '>', '±', '×', '÷', '≤', '≥', '≠']))"""


def xml_text(c: str) -> str:
    return rf"replace(replace(replace(regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{009F}}\x{{FFFE}}\x{{FFFF}}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def decimals(x: str) -> str:
    return rf"regexp_replace(regexp_replace(printf('%.3f', floor(({x}) * 1000 + 0.5) / 1000), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


def wrapped(text: str, width: int) -> str:
    """Words packed greedily: lines parted by line feeds, the last of which is the one that is being filled."""
    words = rf"list_filter(string_split_regex({text}, '[\t\n\v\f\r ]+'), lambda x: x <> '')"
    return f"CASE WHEN len({words}) = 0 THEN []::VARCHAR[] ELSE string_split(list_reduce({words}, lambda a, w: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) <= {width} THEN a || ' ' || w ELSE a || chr(10) || w END), chr(10)) END"


SPACED = f"""
p AS (SELECT doc_id, k, array_to_string(flatten(list_transform(string_split(t, ' '), lambda w, i: CASE WHEN (i - 1) % 3 = 0 AND length(w) BETWEEN 2 AND 6 THEN string_split(w, '') ELSE [w] END)), ' ') AS t FROM {PARTS})"""
INLINES = f"""
sty AS (SELECT doc_id, laid_line, run_no, {squeezed("str")} AS s, run_no % 7 < 2 AS b, run_no % 11 = 3 AS i, run_no % 13 = 5 AS code, run_no % 17 = 6 AS sub, run_no % 19 = 7 AS sup FROM runs WHERE {squeezed("str")} <> ''),
marks AS (SELECT *, concat(b, i, code, sub, sup) AS key FROM sty),
isl AS (SELECT *, sum(CASE WHEN lag_key IS NULL OR lag_key <> key THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, laid_line ORDER BY run_no) - 1 AS ord FROM (SELECT *, lag(key) OVER (PARTITION BY doc_id, laid_line ORDER BY run_no) AS lag_key FROM marks)),
inl AS (SELECT doc_id, laid_line, ord, string_agg(s, ' ' ORDER BY run_no) AS s, b, i, code, sub, sup FROM isl GROUP BY doc_id, laid_line, ord, b, i, code, sub, sup)"""

def lined(*pieces: str) -> str:
    """Texts and expressions (in brackets) as lines, null ones left out, with an end of line."""
    return "concat_ws(chr(10), " + ", ".join(p if p.startswith("(") else "'" + p.replace("'", "''") + "'" for p in pieces) + ") || chr(10)"


def page(title: str, head: str, attrs: str, *body: str) -> str:
    opening = """('<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="' || lang || '" xml:lang="' || lang || '">')"""
    return lined('<?xml version="1.0" encoding="utf-8"?>', "<!DOCTYPE html>", opening, "<head>", '  <meta charset="utf-8"/>', f"  <title>{title}</title>", head, "</head>", f"<body{attrs}>", *body, "</body>", "</html>")


STAMP = "2024-05-06T07:08:09Z"
XHTML = 'media-type="application/xhtml+xml"'
OPF = lined(
    '<?xml version="1.0" encoding="utf-8"?>', """('<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="BookId" xml:lang="' || lang || '">')""",
    '  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">', """('    <dc:identifier id="BookId">urn:uuid:' || uuid || '</dc:identifier>')""", "('    <dc:title>' || title || '</dc:title>')",
    """('    <dc:creator id="creator-0">' || CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE lang END || '</dc:creator>')""", '    <meta refines="#creator-0" property="role" scheme="marc:relators">aut</meta>',
    """(CASE WHEN doc_id % 3 = 2 THEN '    <dc:creator id="creator-1">B &lt;b&gt;</dc:creator>' || chr(10) || '    <meta refines="#creator-1" property="role" scheme="marc:relators">aut</meta>' END)""",
    "('    <dc:language>' || lang || '</dc:language>')", "(CASE WHEN doc_id % 2 = 1 THEN '    <dc:publisher>P</dc:publisher>' END)", "(CASE WHEN doc_id % 5 = 0 THEN '    <dc:subject>s1</dc:subject>' || chr(10) || '    <dc:subject>s&amp;2</dc:subject>' END)",
    f"    <dc:date>{STAMP}</dc:date>", f'    <meta property="dcterms:modified">{STAMP}</meta>', '    <meta name="cover" content="cover-img"/>', "  </metadata>", "  <manifest>",
    '    <item id="cover-img" href="images/cover.png" media-type="image/png" properties="cover-image"/>', f'    <item id="cover" href="cover.xhtml" {XHTML} properties="svg"/>', f'    <item id="nav" href="nav.xhtml" {XHTML} properties="nav"/>',
    '    <item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', '    <item id="css" href="style.css" media-type="text/css"/>', "(items)", "  </manifest>", '  <spine toc="ncx">', '    <itemref idref="cover" linear="yes"/>', '    <itemref idref="nav" linear="yes"/>', "(refs)",
    "  </spine>", "  <guide>", '    <reference type="cover" title="Cover" href="cover.xhtml"/>', '    <reference type="toc" title="Table of Contents" href="nav.xhtml"/>', """('    <reference type="text" title="Beginning" href="' || first || '"/>')""", "  </guide>", "</package>",
)
NAV = page(
    "Contents", '  <link rel="stylesheet" type="text/css" href="style.css"/>', "", '  <nav epub:type="toc" id="toc">', "    <h1>Contents</h1>", """(coalesce(nav, '<ol><li><a href="' || first || '">' || title || '</a></li></ol>'))""", "  </nav>", '  <nav epub:type="landmarks" id="landmarks" hidden="hidden">', "    <h2>Guide</h2>",
    """('    <ol><li><a epub:type="cover" href="cover.xhtml">Cover</a></li><li><a epub:type="toc" href="nav.xhtml">Table of Contents</a></li><li><a epub:type="bodymatter" href="' || first || '">Start of Content</a></li></ol>')""", "  </nav>",
)
NCX = lined(
    '<?xml version="1.0" encoding="utf-8"?>', """('<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1" xml:lang="' || lang || '">')""", "  <head>", """('    <meta name="dtb:uid" content="urn:uuid:' || uuid || '"/>')""", """('    <meta name="dtb:depth" content="' || coalesce(deepest, 1) || '"/>')""",
    '    <meta name="dtb:totalPageCount" content="0"/>', '    <meta name="dtb:maxPageNumber" content="0"/>', "  </head>", "('  <docTitle><text>' || title || '</text></docTitle>')", "('  <docAuthor><text>' || CASE doc_id % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN lang ELSE lang || ', B &lt;b&gt;' END || '</text></docAuthor>')",
    "  <navMap>", '<navPoint id="np1" playOrder="1"><navLabel><text>Cover</text></navLabel><content src="cover.xhtml"/></navPoint>', "(points)", "  </navMap>", "</ncx>",
)
COVER = page(
    "Cover", '  <style type="text/css">html, body { margin: 0; padding: 0; height: 100%; background: #ffffff; text-align: center; }</style>', ' epub:type="cover"',
    """('  <div style="height: 100%; margin: 0; padding: 0;"><svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" version="1.1" width="100%" height="100%" viewBox="0 0 1600 2560" preserveAspectRatio="xMidYMid meet" role="img" aria-label="Cover of ' || title || '"><title>Cover of ' || title || '</title><image width="1600" height="2560" xlink:href="images/cover.png"/></svg></div>')""",
)


def stacked(*lines: str) -> str:
    """Lines of markup as SQL; those that are null fall out. {x} stands for a column's value, pieces that begin with $ are SQL."""
    return "concat_ws(chr(10), " + ", ".join(line[1:] if line.startswith("$") else "'" + line.replace("{", "' || ").replace("}", " || '") + "'" for line in lines) + ")"


SQL: dict[str, str] = {
    "z2_nested_blocks": f"""WITH e AS (SELECT doc_id, k, t, length(t) AS n, {squeezed("t")} = '' AS blank, {xml_text("t")} AS x, replace(replace({xml_text("t")}, '"', '&quot;'), '''', '&apos;') AS a, CASE WHEN length(t) % 2 = 1 THEN ' class="align-right"' ELSE '' END AS al, 'images/' || length(t) || '.png' AS href,
  CASE WHEN length(t) % 2 = 0 THEN 'ol' ELSE 'ul' END AS l, CASE WHEN length(t) % 2 = 0 AND length(t) % 3 <> 1 THEN ' start="' || length(t) % 3 || '"' ELSE '' END AS st FROM {PARTS}),
m AS (SELECT doc_id, k, CASE k % 7
  WHEN 0 THEN CASE WHEN blank THEN '' ELSE '<p' || al || '>' || x || '</p>' END
  WHEN 1 THEN {stacked("<blockquote>", "$CASE WHEN NOT blank THEN '  <p>' || x || '</p>' END", "  <pre><code>{x}</code></pre>", "</blockquote>")}
  WHEN 2 THEN CASE WHEN blank THEN '' ELSE {stacked("<{l}{st}>", "  <li>{x}</li>", "  <li>", "    <p>{x}</p>", "    <blockquote>", "      <p>{x}</p>", "    </blockquote>", "  </li>", "</{l}>")} END
  WHEN 3 THEN {stacked("<table>", "$CASE WHEN n % 2 = 0 THEN '  <caption>' || x || '</caption>' END", "  <thead>", "    <tr>", "$'      <th' || CASE WHEN n % 4 > 1 THEN ' colspan=\"' || n % 4 || '\"' ELSE '' END || ' scope=\"col\">' || x || '</th>'", "    </tr>", "  </thead>", "  <tbody>", "    <tr>", "$'      ' || CASE WHEN n % 5 = 0 THEN '<th' ELSE '<td' END || CASE WHEN n % 3 > 1 THEN ' rowspan=\"2\"' ELSE '' END || CASE WHEN n % 5 = 0 THEN ' scope=\"row\"' ELSE '' END || al || '>' || x || CASE WHEN n % 5 = 0 THEN '</th>' ELSE '</td>' END", "      <td>", "$CASE WHEN NOT blank THEN '        <p>' || x || '</p>' END", "        <hr/>", "        </td>", "    </tr>", "  </tbody>", "</table>")}
  WHEN 4 THEN CASE WHEN n % 3 = 0 THEN '' ELSE {stacked("<figure>", '  <img src="{href}" alt="{a}"/>', "$CASE WHEN n % 2 = 0 THEN '  <figcaption>' || x || '</figcaption>' END", "</figure>")} END
  WHEN 5 THEN '<pre class="table-fallback">' || x || '</pre>' || CASE WHEN n % 3 = 0 THEN '' ELSE chr(10) || {stacked('<figure class="table-snapshot">', '  <img src="{href}" alt="Original table as it appeared in the PDF"/>', "</figure>")} END
  ELSE {stacked("<blockquote>", '  <h{(n % 6 + 1)} id="a{k}">{x}</h{(n % 6 + 1)}>', """  <span class="source-page" id="page-{(k + 1)}" epub:type="pagebreak" role="doc-pagebreak" aria-label="{CASE WHEN n % 2 = 0 THEN 'p. ' || k ELSE (k + 1)::VARCHAR END}"/>""", "</blockquote>")} END AS markup FROM e)
SELECT doc_id, k, md5(markup) AS markup, length(markup) AS n_chars FROM m""",
    "n2_tree_facts": f"""WITH e AS (SELECT doc_id, k, length(t) AS n, 19 + length(to_json({xml_text("t")})) AS held FROM {PARTS}),
-- a paragraph as JSON has 23 characters more than its inlines
w AS (SELECT *, CASE k % 7 WHEN 0 THEN held WHEN 1 THEN held + n WHEN 2 THEN 117 + 3 * (held + 23) WHEN 3 THEN 129 + CASE WHEN n % 2 = 0 THEN 4 ELSE 5 END + CASE WHEN n % 5 = 0 THEN 4 ELSE 5 END + 3 * (held + 23)
  WHEN 4 THEN 32 WHEN 5 THEN n ELSE held + 32 END AS weight, [1, 3, 9, 12, 1, 1, 3][k % 7 + 1] AS nodes FROM e)
SELECT doc_id, k * 100 + unnest(range(nodes))::INT AS node, k * 100 AS top, weight::BIGINT AS weight FROM w""",
    "z4_package_documents": f"""WITH RECURSIVE {MERGED}{PACKED.replace("> 900", "> 200000")},
c AS (SELECT doc_id, chapter, part, row_number() OVER (PARTITION BY doc_id ORDER BY chapter, part) - 1 AS no FROM (SELECT DISTINCT doc_id, chapter, part FROM g)),
lists AS (SELECT doc_id, string_agg('    <item id="ch' || lpad(no::VARCHAR, 3, '0') || '" href="ch' || lpad(no::VARCHAR, 3, '0') || '.xhtml" {XHTML}/>', chr(10) ORDER BY no) AS items, string_agg('    <itemref idref="ch' || lpad(no::VARCHAR, 3, '0') || '"/>', chr(10) ORDER BY no) AS refs FROM c GROUP BY doc_id),
h AS (SELECT doc_id, ord, text, least(level - min(level) OVER (PARTITION BY doc_id) + 1, 3) AS cap, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM blocks WHERE kind = 'h'),
d(doc_id, ord, text, rn, depth, before) AS (SELECT doc_id, ord, text, rn, 1, 0 FROM h WHERE rn = 1 UNION ALL SELECT h.doc_id, h.ord, h.text, h.rn, least(cap, depth + 1), depth FROM d JOIN h ON h.doc_id = d.doc_id AND h.rn = d.rn + 1),
entries AS (SELECT d.*, {xml_text("d.text")} AS label, 'ch' || lpad(no::VARCHAR, 3, '0') || '.xhtml#h-b' || d.ord AS href FROM d JOIN g USING (doc_id, ord) JOIN c USING (doc_id, chapter, part)),
tocs AS (SELECT doc_id, max(depth) AS deepest,
  string_agg(CASE WHEN depth > before THEN '<ol>' ELSE repeat('</li></ol>', before - depth) || '</li>' END || '<li><a href="' || href || '">' || label || '</a>', '' ORDER BY ord) || repeat('</li></ol>', arg_max(depth, ord)) AS nav,
  string_agg(CASE WHEN depth > before THEN '' ELSE repeat('</navPoint>', before - depth + 1) END || '<navPoint id="np' || (rn + 1) || '" playOrder="' || (rn + 1) || '"><navLabel><text>' || label || '</text></navLabel><content src="' || href || '"/>', '' ORDER BY ord) || repeat('</navPoint>', arg_max(depth, ord)) AS points
  FROM entries GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(lang, 'en') AS lang, coalesce('T &amp; ' || {xml_text("source")}, 'Untitled') AS title, lpad(doc_id::VARCHAR, 36, '0') AS uuid, items, refs, CASE WHEN items IS NULL THEN 'cover.xhtml' ELSE 'ch000.xhtml' END AS first, nav, points, deepest
  FROM documents LEFT JOIN lists USING (doc_id) LEFT JOIN tocs USING (doc_id))
SELECT doc_id, md5({OPF}) AS opf, md5({NAV}) AS nav, md5({NCX}) AS ncx, md5({COVER}) AS cover FROM m""",
    "p4_text_runs": f"""WITH {RUNS}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY run_no) - 1 AS n FROM runs),
u AS (SELECT *, CASE WHEN n % 5 = 0 THEN em ELSE 0.8 * em END::DOUBLE AS h, CASE WHEN bold THEN 'Serif|g1-Bold' WHEN n % 50 = 1 THEN 'Courier New|g2' WHEN n % 70 = 2 THEN 'Sans Oblique|g3' ELSE 'g4|g4' END AS font_key FROM t WHERE n % 101 <> 7 AND n % 103 <> 9 AND n % 45 > 4)
SELECT doc_id, page, (n * 3 + 1)::INT AS run_no, str, x::DOUBLE AS x, round(baseline_y - h, 6)::DOUBLE AS y, advance::DOUBLE AS w, round(h, 6) AS h, baseline_y::DOUBLE AS baseline_y, em::DOUBLE AS em, n % 97 = 5 AS skewed, advance::DOUBLE AS advance, font_key,
  font_key LIKE '%Bold' AS bold, font_key LIKE '%g3' AS italic, font_key LIKE '%g2' AS mono, CASE WHEN n % 45 BETWEEN 10 AND 14 THEN 'm' || (n - n % 45 + 10) END AS mcid FROM u""",
    "p7_overlap": "SELECT event_id, round(CASE WHEN w <= 0 THEN 0 ELSE greatest(least(x + w, ox + ow) - greatest(x, ox), 0) / w::DOUBLE END, 6)::DOUBLE AS share FROM (SELECT event_id, event_id % 97 AS x, event_id % 13 - 2 AS w, user_id % 89 AS ox, user_id % 31 AS ow FROM events)",
    "l2_scripts": f"""WITH {RUNS}, m AS (SELECT doc_id, page, run_no, laid_line, baseline_y + CASE WHEN run_no % 10 = 3 THEN -3 WHEN run_no % 11 = 4 THEN 3 ELSE 0 END AS y, CASE WHEN run_no % 10 = 3 OR run_no % 11 = 4 THEN 7 WHEN run_no % 12 = 0 THEN 30 ELSE em END AS em, length(str) AS chars, x FROM runs),
sizes AS (SELECT doc_id, page, laid_line, em, sum(chars) AS chars, min(x) AS x FROM m GROUP BY ALL),
tops AS (SELECT doc_id, page, laid_line, em AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, laid_line ORDER BY chars DESC, x) AS r FROM sizes) WHERE r = 1),
o AS (SELECT *, (median(y) OVER w - y) / top::DOUBLE AS off FROM m JOIN tops USING (doc_id, page, laid_line) WINDOW w AS (PARTITION BY doc_id, page, laid_line))
SELECT doc_id, page, run_no, CASE WHEN em < top * 0.75 AND abs(off) BETWEEN 0.2 AND 0.6 THEN CASE WHEN off > 0 THEN 'sup' ELSE 'sub' END END AS script FROM o""",
    "h2_size_levels": f"""WITH RECURSIVE e AS (SELECT DISTINCT doc_id, (k // 40)::INT AS page, (100 + length(t) % 24 * 3) / 10::DOUBLE AS em FROM {PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY em DESC) AS rn FROM e),
l(doc_id, page, rn, em, head, level) AS (SELECT doc_id, page, rn, em, em, 1 FROM r WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.page, r.rn, r.em, CASE WHEN (head - r.em) / head > 0.05 THEN r.em ELSE head END, level + CASE WHEN (head - r.em) / head > 0.05 THEN 1 ELSE 0 END FROM l JOIN r ON r.doc_id = l.doc_id AND r.page = l.page AND r.rn = l.rn + 1)
SELECT doc_id, page, em, level::INT AS level FROM l""",
    "b7_inlines": f"WITH {RUNS}, {INLINES} SELECT doc_id, laid_line, ord::INT AS ord, s, b, i, code, sub, sup FROM inl",
    "z1_inline_markup": f"""WITH {RUNS}, {INLINES}, e AS (SELECT *, {xml_text("s")} AS x FROM inl), p AS (SELECT *, CASE WHEN sup THEN '<sup>' || x || '</sup>' ELSE x END AS x1 FROM e), q AS (SELECT *, CASE WHEN sub THEN '<sub>' || x1 || '</sub>' ELSE x1 END AS x2 FROM p),
c AS (SELECT *, CASE WHEN code THEN '<code>' || x2 || '</code>' ELSE x2 END AS x3 FROM q), m AS (SELECT *, CASE WHEN i THEN '<em>' || x3 || '</em>' ELSE x3 END AS x4 FROM c)
SELECT doc_id, laid_line, string_agg(CASE WHEN b THEN '<strong>' || x4 || '</strong>' ELSE x4 END, '' ORDER BY ord) AS markup FROM m GROUP BY ALL""",
    "z1_links": f"""WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
f AS (SELECT *, length(href) AS n, {xml_text("href")} AS x, replace(replace({xml_text("href")}, '"', '&quot;'), '''', '&apos;') AS a FROM h),
w AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'width:' || {decimals("n / 7::DOUBLE")} || 'em' END AS w, CASE WHEN n % 5 = 0 THEN 'vertical-align:' || {decimals("-(n / 900::DOUBLE) * 100")} || '%' END AS v FROM f)
SELECT page_id, href, CASE WHEN regexp_matches(href, '(?i)^(https?:|mailto:)') THEN '<a href="' || a || '">' || x || '</a>' ELSE '<span>' || x || '</span>' END AS link,
  CASE WHEN n % 3 = 0 THEN '' ELSE '<img src="images/' || n || '.png" alt="' || a || '" class="inline-math"' || CASE WHEN w IS NULL AND v IS NULL THEN '' ELSE ' style="' || concat_ws(';', w, v) || '"' END || '/>' END AS image FROM w""",
    "j4_internal_links": f"""WITH RECURSIVE {MERGED}{PACKED}, f AS (SELECT g.doc_id, g.ord, 'ch-' || g.chapter || '-' || part AS file, kind FROM g JOIN merged m ON m.doc_id = g.doc_id AND m.ord = g.ord)
SELECT a.doc_id, a.ord AS from_ord, (a.ord * 3 % 50)::INT AS target_ord, CASE WHEN t.ord IS NULL THEN NULL WHEN t.kind = 'h' THEN CASE WHEN t.file = a.file THEN '' ELSE t.file END || '#h-' || t.ord WHEN t.file <> a.file THEN t.file END AS href
FROM f a LEFT JOIN f t ON t.doc_id = a.doc_id AND t.ord = a.ord * 3 % 50""",
    "b8_metadata": f"""WITH {BLOCKS}, first AS (SELECT doc_id, nullif(trim(arg_min(text, ord)), '') AS heading FROM blocks WHERE kind = 'h' GROUP BY doc_id),
r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Embedded ' || doc_id END AS xmp, CASE doc_id % 9 WHEN 4 THEN 'Report of a day' WHEN 7 THEN 'Two  words' END AS info, heading,
  CASE WHEN doc_id % 4 = 0 THEN 'Untitled' ELSE trim(regexp_replace(concat_ws('_', source, doc_id, 'x-y'), '[_-]+', ' ', 'g')) END AS stem,
  CASE doc_id % 5 WHEN 0 THEN 'A. B|C|D' WHEN 2 THEN 'Solo' ELSE '' END AS authors, CASE WHEN doc_id % 3 = 0 THEN coalesce(nullif(lang, ''), 'en') ELSE 'en' END AS language FROM documents LEFT JOIN first USING (doc_id))
SELECT doc_id, coalesce(xmp, info, heading, stem) AS title, CASE WHEN xmp IS NOT NULL THEN 'xmp' WHEN info IS NOT NULL THEN 'info' WHEN heading IS NOT NULL THEN 'first-heading' ELSE 'filename' END AS title_source, authors, language FROM r""",
    "s4_admission": r"""SELECT page_id, CASE WHEN NOT (page_id % 5 = 0 OR page_id % 3 = 0 OR (page_id % 3 = 2 AND coalesce(regexp_matches(url, '(?i)\.pdf$'), false))) THEN 'type' WHEN length(html) * 40000 > 209715200 THEN 'size' END AS refused,
  CASE page_id % 7 WHEN 0 THEN 'password' WHEN 1 THEN 'invalid' WHEN 2 THEN 'other' END AS error, CASE WHEN page_id % 2 = 1 THEN '12345678-1234-1234-1234-' || lpad(page_id::VARCHAR, 12, '0') END AS uuid FROM pages""",
    "p9_cover_sizes": """WITH p AS (SELECT p_partkey, p_partkey * 7919 % 6000 + 1 AS w, p_partkey * 104729 % 7000 + 1 AS h, p_partkey % 10 / 10::DOUBLE AS cov, p_partkey % 3 AS page, p_partkey % 4 = 0 AS gif, CASE WHEN p_partkey % 2 = 0 THEN 1600 ELSE 2560 END::DOUBLE AS target FROM part),
q AS (SELECT *, greatest(w, h) AS edge, CASE WHEN w * (target / greatest(w, h)) * h * (target / greatest(w, h)) > 4000000 THEN sqrt(4000000 / (w * h)::DOUBLE) ELSE target / greatest(w, h) END AS scale,
  cov * 100 + least(greatest(w, h), 3000) / 100::DOUBLE + CASE WHEN h / w::DOUBLE BETWEEN 1.25 AND 1.9 THEN 25 ELSE 0 END - CASE WHEN page > 0 THEN 15 ELSE 0 END - CASE WHEN gif THEN 20 ELSE 0 END AS score FROM p)
SELECT p_partkey, CASE WHEN edge <= target THEN w ELSE greatest(1, floor(w * scale + 0.5)) END::BIGINT AS fit_w, CASE WHEN edge <= target THEN h ELSE greatest(1, floor(h * scale + 0.5)) END::BIGINT AS fit_h, edge > target AS scaled, round(score, 6)::DOUBLE AS score, score >= 90 AND edge >= 800 AND w * h >= 400000 AS accepted FROM q""",
    "v1_select_cover": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'user' WHEN doc_id % 3 <> 0 THEN 'rendered' ELSE 'synthesized' END AS source, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 2 THEN 0 WHEN doc_id % 3 = 1 THEN 1 END::INT AS page, CASE WHEN doc_id % 5 = 0 THEN 100 WHEN doc_id % 3 <> 0 THEN 50 ELSE 0 END::INT AS score FROM documents",
    "v3_synthesized_cover": f"""WITH t AS (SELECT d.doc_id, source, k, t FROM documents d JOIN {PARTS} USING (doc_id))
SELECT doc_id, k, list_reduce(list_prepend(0, list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: unicode(c))), lambda h, c: (h * 31 + c) % 360)::INT AS hue,
  array_to_string(list_slice({wrapped("coalesce(nullif(t, ''), 'Untitled')", 18)}, 1, 6), '|') AS title_lines, array_to_string(list_slice({wrapped("concat_ws(', ', source, 'A. Writer')", 12)}, 1, 2), '|') AS author_lines FROM t""",
    "v4_user_covers": r"""WITH p AS (SELECT *, lower(regexp_replace(CASE page_id % 6 WHEN 0 THEN chr(10) || ' <SVG ' || left(html, 200) WHEN 1 THEN '<?xml ' || left(html, 200) ELSE left(html, 256) END, '^[\t\n\v\f\r ]+', '')) AS head, CASE WHEN page_id % 4 <> 0 THEN page_id % 9 * 60 END AS w, CASE WHEN page_id % 4 <> 0 THEN page_id % 7 * 70 END AS h FROM pages),
q AS (SELECT *, page_id % 11 = 5 OR page_id % 10 = 3 OR (w IS NULL AND (starts_with(head, '<?xml') OR starts_with(head, '<svg'))) AS svg FROM p)
SELECT page_id, svg, CASE WHEN length(html) * CASE WHEN page_id % 13 = 0 THEN 9000 ELSE 1 END > 26214400 THEN 'size' WHEN svg THEN 'svg' WHEN w IS NULL THEN 'unreadable' WHEN least(w, h) < 100 THEN 'small' END AS refused FROM q""",
    "w7_asset_names": r"""WITH RECURSIVE raw AS (SELECT lang, doc_id, CASE WHEN doc_id % 9 = 0 THEN 'cover' WHEN doc_id % 9 = 1 THEN 'cover-' || doc_id % 7 WHEN doc_id % 9 = 2 THEN source || '-' || doc_id % 5 WHEN doc_id % 9 = 3 THEN source || '-' || doc_id % 3 || '-' || doc_id % 2 WHEN doc_id % 9 < 7 THEN source ELSE 'e-' || source END AS base,
  CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'gif' END AS ext FROM documents),
a AS (SELECT lang, doc_id, coalesce(nullif(left(trim(regexp_replace(base, '[^A-Za-z0-9_.-]+', '-', 'g'), '-'), 64), ''), 'img') AS base, ext, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM raw),
g(lang, doc_id, rn, used, name) AS (
  SELECT DISTINCT lang, NULL::BIGINT, 0::BIGINT, ['cover.jpg'], NULL::VARCHAR FROM a
  UNION ALL SELECT lang, doc_id, rn, list_append(used, name), name FROM (SELECT a.lang, a.doc_id, a.rn, used, CASE WHEN NOT list_contains(used, base || '.' || ext) THEN base || '.' || ext
    ELSE base || '-' || list_filter(range(1, a.rn + 2), lambda n: NOT list_contains(used, base || '-' || n || '.' || ext))[1] || '.' || ext END AS name FROM g JOIN a ON a.lang IS NOT DISTINCT FROM g.lang AND a.rn = g.rn + 1))
SELECT lang, doc_id, name FROM g WHERE rn > 0""",
    "x9_anchors": rf"""WITH p AS (SELECT doc_id, k, regexp_replace(t, '[^\x20-\x7E]', '', 'g') AS t FROM {PARTS}), s AS (SELECT *, trim(left(regexp_replace(trim(regexp_replace(lower(t), '[^a-z0-9_ -]', '', 'g')), ' +', '-', 'g'), 48), '-') AS slug, left(trim(regexp_replace(t, '[^A-Za-z0-9_.-]+', '-', 'g'), '-'), 64) AS seg FROM p)
SELECT doc_id, k, CASE WHEN slug = '' THEN 'p0-' || k ELSE slug || '-p0-' || k END AS anchor, CASE WHEN seg = '' THEN 'asset' ELSE seg END AS segment FROM s""",
    "x7_detrack_partial": rf"""WITH {SPACED},
q AS (SELECT *, {TRACKED_TEST} AS tracked FROM p),
w AS (SELECT doc_id, k, unnest(string_split(t, ' ')) AS tok, unnest(range(len(string_split(t, ' ')))) AS pos FROM q WHERE tracked),
i AS (SELECT *, CASE WHEN length(tok) = 1 THEN pos - row_number() OVER (PARTITION BY doc_id, k, length(tok) = 1 ORDER BY pos) ELSE -1000000 - pos END AS grp FROM w),
j AS (SELECT doc_id, k, grp, min(pos) AS pos, CASE WHEN count(*) >= 4 THEN string_agg(tok, '' ORDER BY i.pos) ELSE string_agg(tok, ' ' ORDER BY i.pos) END AS piece FROM i GROUP BY doc_id, k, grp)
SELECT doc_id, k, string_agg(piece, ' ' ORDER BY pos) AS text FROM j GROUP BY ALL UNION ALL SELECT doc_id, k, t FROM q WHERE NOT tracked""",
    "a11_warnings": rf"""WITH {SPACED} SELECT doc_id, 'letter-spacing' AS code, n || CASE WHEN n = 1 THEN ' line had' ELSE ' lines had' END || ' letters set apart, which were joined' AS message FROM (SELECT doc_id, count(*) FILTER (tracked) AS n FROM (SELECT *, {TRACKED_TEST} AS tracked FROM p) GROUP BY doc_id) WHERE n > 0""",
    "a13_toc_facts": f"""WITH RECURSIVE {BLOCKS}, h AS (SELECT doc_id, least(level - min(level) OVER (PARTITION BY doc_id) + 1, 3) AS cap, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM blocks WHERE kind = 'h'),
d(doc_id, rn, depth) AS (SELECT doc_id, rn, 1 FROM h WHERE rn = 1 UNION ALL SELECT h.doc_id, h.rn, least(cap, depth + 1) FROM d JOIN h ON h.doc_id = d.doc_id AND h.rn = d.rn + 1)
SELECT doc_id, count(*) AS entries, max(depth)::INT AS depth FROM d GROUP BY doc_id""",
    "a15_confidence": "SELECT conv_id, round(coalesce(median(CASE WHEN conv_id % 4 <> 0 THEN length(text) % 101 END) / 100, 0.8), 6)::DOUBLE AS confidence FROM conversations GROUP BY conv_id",
}
