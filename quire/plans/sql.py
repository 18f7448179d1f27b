"""The driver queries in SQL, written apart from the DataFrame code they check."""

from __future__ import annotations

WS = r"[\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MARKER = r"(?i)^(\d+[.)]|[a-z][.)]|\([a-z0-9]+\)|[•·▪◦‣–—*])[\t\n\v\f\r ]+"

RUNS = """
para AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS para FROM documents),
words AS (SELECT doc_id, para, unnest(t) AS str, unnest(range(len(t))) AS k, len(t) AS para_len FROM (SELECT doc_id, para, list_filter(string_split(p, ' '), lambda x: x <> '') AS t FROM para)),
laid AS (SELECT *, row_number() OVER o - 1 AS run_no, sum(CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END) OVER o - 1 AS line, CASE WHEN para_len <= 6 THEN 14 ELSE 10 END AS em, length(str) * 6 AS advance
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY para, k)),
runs AS (SELECT doc_id, (line // 40)::INT AS page, run_no::INT AS run_no, str,
  (72 + coalesce(sum(advance + CASE WHEN em = 14 THEN 4 ELSE 3 END) OVER (PARTITION BY doc_id, line ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS x,
  (72 + 14 * (line % 40))::INT AS baseline_y, em, advance::INT AS advance, para_len <= 6 AS bold, line::INT AS laid_line FROM laid)"""


def islands(source: str) -> str:
    return f"""
isl AS (SELECT *, (sum(st) OVER (PARTITION BY doc_id, page ORDER BY baseline_y, x, run_no) - 1)::INT AS line_no FROM (
  SELECT *, CASE WHEN lag(run_no) OVER w IS NULL OR abs(baseline_y - lag(baseline_y) OVER w) * 10 >= greatest(em, lag(em) OVER w) * 4 THEN 1 ELSE 0 END AS st
  FROM {source} WINDOW w AS (PARTITION BY doc_id, page ORDER BY baseline_y, x, run_no)))"""


GAPS = """
gaps AS (SELECT *, (x - lag(x) OVER w - lag(advance) OVER w) / greatest(em, lag(em) OVER w)::DOUBLE AS gap, lag(str) OVER w AS bef, lag(advance) OVER w AS adv_bef, greatest(em, lag(em) OVER w)::DOUBLE AS em_max
  FROM isl WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY x, run_no))"""
MODAL = """
ems AS (SELECT doc_id, page, line_no, em, sum(length(str)) AS chars, min(x) AS x, min(run_no) AS run FROM isl GROUP BY doc_id, page, line_no, em),
modal AS (SELECT doc_id, page, line_no, em FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY chars DESC, x, run) AS r FROM ems) WHERE r = 1)"""


def joined(ratio: str, source: str = "gaps") -> str:
    return f"""
texts AS (SELECT doc_id, page, line_no, string_agg(CASE WHEN gap >= 1.2 THEN chr(31) WHEN gap >= greatest({ratio}, 0.16) AND NOT (ends_with(bef, ' ') OR starts_with(str, ' ')) THEN ' ' ELSE '' END || str, '' ORDER BY x, run_no) AS text FROM {source} GROUP BY ALL)"""


FACTS = """
facts AS (SELECT doc_id, page, line_no, min(x)::BIGINT AS x, (max(x + advance) - min(x))::BIGINT AS w, min(baseline_y - em)::BIGINT AS y, (max(baseline_y) - min(baseline_y - em))::BIGINT AS h,
  median(baseline_y)::DOUBLE AS baseline_y, sum(CASE WHEN bold THEN length(str) ELSE 0 END) > sum(length(str)) * 0.6 AS bold, count(*) AS n_runs FROM isl GROUP BY ALL)"""


OTSU = """
sorted AS (SELECT doc_id, page, line_no, gap, row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY doc_id, page, line_no) AS n, sum(gap) OVER (PARTITION BY doc_id, page, line_no) AS total FROM gaps WHERE gap BETWEEN -0.05 AND 3),
cum AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, page, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM sorted),
scored AS (SELECT *, low / i AS ml, (total - low) / (n - i) AS mh, (i / n::DOUBLE) * (1 - i / n::DOUBLE) * pow(low / i - (total - low) / (n - i), 2) AS v FROM cum WHERE i > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY v DESC, i) AS r FROM scored) WHERE r = 1 AND v > 0),
cluster AS (SELECT doc_id, page, line_no, least(greatest((ml + mh) / 2, 0.16), 1.0) AS ratio FROM best WHERE n >= 6 AND mh - ml >= 0.2 AND i / n::DOUBLE >= 0.4)"""


def readable(source: str) -> str:
    return f"""
readable AS (SELECT * FROM (SELECT *, sum(length(trim(str))) OVER (PARTITION BY doc_id, page) AS page_chars FROM {source}) WHERE page_chars >= 40)"""


def judged(text: str) -> str:
    """The verdict on a text."""
    plain = f"translate({text}, chr(31), ' ')"
    tokens, letters = f"list_filter(string_split_regex({plain}, '{WS}+'), lambda x: x <> '')", f"length(regexp_replace({plain}, '{WS}', '', 'g'))"
    return f"""CASE WHEN len({tokens}) >= 4 AND ({letters} / len({tokens})::DOUBLE < 2 OR len(list_filter({tokens}, lambda x: length(x) = 1)) / len({tokens})::DOUBLE > 0.6) THEN 'too-low'
      WHEN NOT contains({plain}, ' ') AND {letters} > 40 THEN 'too-high' ELSE 'ok' END"""


def carried(font: str = "'F1'") -> str:
    """Lines of each document, font and size one after the other; a line takes over what the last certain one of several runs was joined at."""

    def at(ratio: str) -> str:
        return f"array_to_string(list_transform(pieces, lambda p: CASE WHEN p.gap >= 1.2 THEN chr(31) WHEN p.gap >= greatest({ratio}, 0.16) AND NOT p.spaced THEN ' ' ELSE '' END || p.str), '')"

    def retry(inner: str) -> str:
        moved = "CASE verdict WHEN 'too-low' THEN ratio * 1.4 WHEN 'too-high' THEN ratio * 0.7 ELSE ratio END"
        return f"(SELECT * REPLACE ({judged('text')} AS verdict) FROM (SELECT * REPLACE (CASE WHEN verdict = 'ok' THEN text ELSE {at('ratio')} END AS text) FROM (SELECT * REPLACE ({moved} AS ratio) FROM {inner})))"

    first = f"(SELECT *, {judged('text')} AS verdict FROM (SELECT *, {at('ratio')} AS text FROM (SELECT k.*, c.taken, CASE WHEN n = 1 THEN 0.25 ELSE coalesce(own, c.taken) END AS ratio FROM carry c JOIN kinds k ON k.doc_id = c.doc_id AND k.font = c.font AND k.size = c.size AND k.seq = c.seq + 1)))"
    return f"""
spaces AS (SELECT doc_id, page, line_no, median(CASE WHEN bef = ' ' THEN adv_bef WHEN str = ' ' THEN advance END / em_max) AS space, median(CASE WHEN bef <> ' ' AND str <> ' ' THEN gap END) AS tracking FROM gaps WHERE bef IS NOT NULL GROUP BY ALL),
owned AS (SELECT doc_id, page, line_no, CASE WHEN space IS NOT NULL THEN least(greatest(greatest(0, coalesce(tracking, 0)) + 0.45 * space, 0.16), 1.0) ELSE ratio END::DOUBLE AS own FROM spaces LEFT JOIN cluster USING (doc_id, page, line_no)),
pieced AS (SELECT doc_id, page, line_no, list({{'gap': gap, 'spaced': coalesce(ends_with(bef, ' ') OR starts_with(str, ' '), false), 'str': str}} ORDER BY x, baseline_y, run_no) AS pieces, count(*) AS n, arg_min({font}, x) AS font, arg_min(em, x) AS size FROM gaps GROUP BY ALL),
kinds AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, font, size ORDER BY page, line_no) AS seq FROM pieced LEFT JOIN owned USING (doc_id, page, line_no)),
carry(doc_id, font, size, seq, page, line_no, taken, text, ratio, uncertain) AS (
  SELECT DISTINCT doc_id, font, size, 0::BIGINT, NULL::INT, NULL::INT, 0.25::DOUBLE, NULL::VARCHAR, NULL::DOUBLE, NULL::BOOLEAN FROM kinds
  UNION ALL SELECT doc_id, font, size, seq, page, line_no, CASE WHEN n > 1 AND verdict = 'ok' THEN ratio ELSE taken END, text, CASE WHEN n = 1 THEN 0.25 ELSE ratio END, n > 1 AND verdict <> 'ok' FROM {retry(retry(first))}),
texts AS (SELECT doc_id, page, line_no, text, ratio, uncertain FROM carry WHERE seq > 0)"""


LINES = "RECURSIVE " + ",".join([RUNS, readable("runs"), islands("readable"), GAPS, MODAL, OTSU, carried(), FACTS]) + """,
lines AS (SELECT * FROM facts JOIN modal USING (doc_id, page, line_no) JOIN texts USING (doc_id, page, line_no))"""
MANNERS = RUNS + """,
words_of AS (SELECT *, row_number() OVER w - 1 AS word, coalesce(sum(length(str)) OVER (PARTITION BY doc_id, laid_line ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars, laid_line % 6 AS manner
  FROM runs WINDOW w AS (PARTITION BY doc_id, laid_line ORDER BY run_no)),
chars_of AS (SELECT *, substr(str, k::INT + 1, 1) AS ch, (72 + 9 * (chars + k) + 6 * word)::INT AS cx FROM (SELECT *, unnest(range(length(str))) AS k FROM words_of)),
mixed AS (
  SELECT doc_id, page, (run_no * 1000)::INT AS run_no, CASE WHEN manner = 3 THEN array_to_string(regexp_extract_all(str, '(?s).'), ' ') ELSE str END AS raw, x, baseline_y - CASE WHEN manner = 5 AND word % 3 = 1 THEN 3 ELSE 0 END AS baseline_y,
    CASE WHEN manner = 5 AND word % 3 = 1 THEN 6 ELSE em END AS em, advance, bold, manner = 5 AND word % 10 = 7 AS skewed, CASE WHEN manner = 5 THEN 'F2' ELSE 'F1' END AS font_key FROM words_of WHERE manner IN (0, 2, 3, 5)
  UNION ALL SELECT doc_id, page, run_no * 1000 + 1, ' ', x + advance, baseline_y, em, 3, bold, false, 'F1' FROM words_of WHERE manner = 2
  UNION ALL SELECT doc_id, page, (run_no * 1000 + k)::INT, ch, cx, baseline_y, em, 6, bold, false, 'F1' FROM chars_of WHERE manner = 1 OR (manner = 4 AND cx < 117)),
raws AS (SELECT * RENAME (raw AS str) FROM mixed),
told AS (SELECT *, list_reduce(list_prepend(0, list_transform(string_split(str, ' '), lambda x: CASE WHEN length(x) = 1 AND regexp_matches(x, '[\\p{L}\\p{N}]') THEN 1 WHEN length(x) = 1 THEN 0 ELSE -1 END)),
    lambda a, c: CASE WHEN c = 0 THEN a WHEN c = -1 THEN a % 100000 ELSE (a // 100000 + 1) * 100000 + greatest(a % 100000, a // 100000 + 1) END) % 100000 >= 4 AND NOT list_has_any(string_split(str, ' '), ['=', '+', '*', '/', '<', '>', '±', '×', '÷', '≤', '≥', '≠']) AS apart FROM raws)"""
MIXED_LINES = "RECURSIVE " + ",".join([MANNERS, readable("told"), """
upright AS (SELECT * REPLACE (CASE WHEN apart THEN replace(str, ' ', '') ELSE str END AS str), length(str) AS em_chars FROM readable WHERE NOT skewed)""", islands("upright"), GAPS, MODAL.replace("sum(length(str))", "sum(em_chars)"), OTSU, carried("font_key"), FACTS]) + """,
bases AS (SELECT isl.*, modal.em AS line_em, facts.baseline_y AS base FROM isl JOIN modal USING (doc_id, page, line_no) JOIN facts USING (doc_id, page, line_no)),
marks AS (SELECT doc_id, page, line_no, bool_or(apart) AS detracked, coalesce(string_agg(run_no || ':' || CASE WHEN base > baseline_y THEN 'sup' ELSE 'sub' END, ' ' ORDER BY x, baseline_y, run_no)
  FILTER (em < line_em * 0.75 AND abs(base - baseline_y) / line_em BETWEEN 0.2 AND 0.6), '') AS scripts FROM bases GROUP BY ALL),
found AS (SELECT doc_id, page, line_no, text, round(ratio, 6)::DOUBLE AS ratio, uncertain, detracked, em::DOUBLE AS em, n_runs, scripts FROM facts JOIN modal USING (doc_id, page, line_no) JOIN texts USING (doc_id, page, line_no) JOIN marks USING (doc_id, page, line_no))"""


def squeezed(text: str) -> str:
    return f"trim(regexp_replace(translate({text}, chr(31), ' '), '{WS}+', ' ', 'g'))"


CANDIDATES = LINES + rf""",
plains AS (SELECT *, {squeezed("text")} AS plain FROM lines),
doc_ems AS (SELECT doc_id, em, sum(length(plain)) AS chars, min(page * 1000 + line_no) AS spot FROM plains GROUP BY doc_id, em),
bodies AS (SELECT doc_id, em AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, spot) AS r FROM doc_ems) WHERE r = 1),
cand AS (SELECT *, length(plain) BETWEEN 1 AND 120 AND NOT regexp_matches(plain, '[.!?:;,]\z') AND (em >= body * 1.12 OR (bold AND length(plain) <= 80 AND em >= body * 0.95)
  OR (length(plain) <= 60 AND regexp_matches(plain, '^[^\p{{Ll}}]+\z') AND regexp_matches(plain, '\p{{Lu}}') AND em >= body * 0.9)) AS candidate FROM plains JOIN bodies USING (doc_id))"""
DEPTH = r"CASE WHEN regexp_extract({t}, '^(\d+(?:\.\d+)*)[\t\n\v\f\r ]+[^\t\n\v\f\r ]', 1) <> '' THEN len(string_split(regexp_extract({t}, '^(\d+(?:\.\d+)*)[\t\n\v\f\r ]+[^\t\n\v\f\r ]', 1), '.')) END"
# the layout has two sizes, 29 % apart, so every size of a page is a level of its own
HEADINGS = CANDIDATES + f""",
ranks AS (SELECT doc_id, page, em, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY em DESC) AS lev FROM (SELECT DISTINCT doc_id, page, em FROM cand WHERE candidate)),
numbered AS (SELECT doc_id, count(*) FILTER (candidate AND ({DEPTH.format(t="plain")}) IS NOT NULL) >= 3 AS numbered FROM cand GROUP BY doc_id),
heads AS (SELECT cand.*, CASE WHEN NOT candidate THEN 0 ELSE least(4, greatest(1, coalesce(CASE WHEN numbered THEN {DEPTH.format(t="plain")} END, lev, 1))) END::INT AS heading_level
  FROM cand JOIN numbered USING (doc_id) LEFT JOIN ranks USING (doc_id, page, em))"""
BREAKS = HEADINGS + rf""",
edges AS (SELECT doc_id, page, min(x) AS le, max(x + w) AS re FROM heads GROUP BY ALL),
prev AS (SELECT *, baseline_y - pb AS gap FROM (SELECT *, lag(plain) OVER o AS pt, lag(x + w) OVER o AS pend, lag(em) OVER o AS pem, lag(bold) OVER o AS pbold, lag(baseline_y) OVER o AS pb, lag(heading_level) OVER o AS ph, lag(page) OVER o AS pp, lag(line_no) OVER o AS pl
  FROM heads WINDOW o AS (PARTITION BY doc_id ORDER BY page, line_no))),
lead AS (SELECT doc_id, page, coalesce(median(gap) FILTER (pp = page AND gap > 0), 0) AS ldg FROM prev GROUP BY ALL),
style AS (SELECT doc_id, page, count(*) FILTER (ok) > 0 AND count(*) FILTER (ok AND x - le > em * 0.5) / greatest(count(*) FILTER (ok), 1)::DOUBLE > 0.5 AS indents
  FROM (SELECT *, pp = page AND NOT (ldg > 0 AND gap > ldg * 1.35) AS ok FROM prev JOIN lead USING (doc_id, page) JOIN edges USING (doc_id, page)) GROUP BY ALL),
broken AS (SELECT *, pl IS NULL OR ((heading_level <> 0 OR ph <> 0) AND NOT (heading_level <> 0 AND heading_level = ph AND (ldg <= 0 OR (gap > 0 AND gap <= ldg * 1.35)))) OR
  CASE WHEN regexp_matches(pt, '[-\x{{2010}}\x{{00AD}}]\z') OR length(replace(pt, ')', '')) > length(replace(pt, '(', '')) OR length(replace(pt, ']', '')) > length(replace(pt, '[', '')) THEN false
       WHEN ldg > 0 AND gap > ldg * 1.35 THEN true
       WHEN indents AND x - le > em * 0.5 THEN true
       WHEN regexp_matches(plain, '{MARKER}') THEN true
       WHEN pend < re - em * 2.5 AND regexp_matches(pt, '[.!?"''”’)\]]\z') THEN true
       WHEN abs(em - pem) / em > 0.1 THEN true ELSE bold <> pbold END AS breaks
  FROM prev JOIN lead USING (doc_id, page) JOIN edges USING (doc_id, page) JOIN style USING (doc_id, page))"""
TRACKED = ",".join([RUNS, """
cut AS (SELECT *, row_number() OVER w - 1 AS word, coalesce(sum(length(str)) OVER (PARTITION BY doc_id, laid_line ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars
  FROM runs WINDOW w AS (PARTITION BY doc_id, laid_line ORDER BY run_no)),
tracked AS (SELECT doc_id, page, (run_no * 1000 + k)::INT AS run_no, substr(str, k::INT + 1, 1) AS str, (72 + 9 * (chars + k) + 6 * word)::INT AS x, baseline_y, em, 6 AS advance
  FROM (SELECT *, unnest(range(length(str))) AS k FROM cut))""", islands("tracked"), GAPS])
def verdict(k: int) -> str:
    """The verdict on each line's text, and the runs with the thresholds of the next attempt."""
    return rf"""
v{k} AS (SELECT *, CASE WHEN len(tok) >= 4 AND (letters / len(tok)::DOUBLE < 2 OR len(list_filter(tok, lambda x: length(x) = 1)) / len(tok)::DOUBLE > 0.6) THEN 'too-low' WHEN NOT contains(plain, ' ') AND letters > 40 THEN 'too-high' ELSE 'ok' END AS verdict
  FROM (SELECT *, list_filter(string_split_regex(plain, '{WS}+'), lambda x: x <> '') AS tok, length(regexp_replace(plain, '{WS}', '', 'g')) AS letters
    FROM (SELECT t.*, translate(t.text, chr(31), ' ') AS plain, ratio, runs FROM t{k} t JOIN (SELECT doc_id, page, line_no, any_value(ratio) AS ratio, any_value(runs) AS runs FROM r{k} GROUP BY ALL) USING (doc_id, page, line_no)))),
r{k + 1} AS (SELECT r.* REPLACE (CASE v.verdict WHEN 'too-low' THEN r.ratio * 1.4 WHEN 'too-high' THEN r.ratio * 0.7 ELSE r.ratio END AS ratio) FROM r{k} r JOIN v{k} v USING (doc_id, page, line_no))"""


BLOCKS = """
blocks AS (SELECT doc_id, ord::INT AS ord, text, CASE WHEN length(text) < 60 THEN 'h' WHEN length(text) % 11 = 0 THEN 'rule' ELSE 'p' END AS kind, CASE WHEN length(text) < 60 THEN length(text) % 3 + 1 ELSE 0 END::INT AS level
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents) WHERE trim(text) <> '')"""
SPLIT = BLOCKS + """,
counts AS (SELECT doc_id, count(*) FILTER (kind = 'h' AND level = 1) AS h1, count(*) FILTER (kind = 'h' AND level = 2) AS h2 FROM blocks GROUP BY doc_id),
split AS (SELECT *, CASE WHEN h1 >= 3 THEN 1 WHEN h2 >= 3 THEN 2 END::INT AS split_level FROM counts)"""
MERGED = SPLIT + """,
grouped AS (SELECT blocks.*, split_level, sum(CASE WHEN kind = 'h' AND level = split_level THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord)::INT AS grp FROM blocks JOIN split USING (doc_id)),
sizes AS (SELECT doc_id, grp, count(*) FILTER (kind NOT IN ('pagebreak', 'rule')) AS substantive FROM grouped GROUP BY ALL),
numbered AS (SELECT *, sum(CASE WHEN first OR substantive >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY grp)::INT AS chapter FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp) = 1 AS first FROM sizes)),
merged AS (SELECT grouped.*, substantive, chapter FROM grouped JOIN numbered USING (doc_id, grp))"""
MIXED = MERGED.replace("""'rule' ELSE 'p' END AS kind""", """'rule' WHEN ord % 5 = 0 THEN 'list' WHEN ord % 7 = 0 THEN 'quote' WHEN ord % 11 = 0 THEN 'code' WHEN ord % 13 = 0 THEN 'figure' ELSE 'p' END AS kind""")
PACKED = """,
s AS (SELECT doc_id, chapter, ord, kind, CASE WHEN kind IN ('h', 'p', 'quote') THEN 19 + length(to_json(text)) WHEN kind = 'list' THEN 57 + length(to_json(text)) WHEN kind = 'code' THEN length(text) ELSE 32 END AS w,
  row_number() OVER (PARTITION BY doc_id, chapter ORDER BY ord) AS rn, sum(CASE WHEN kind IN ('h', 'p', 'quote') THEN 19 + length(to_json(text)) WHEN kind = 'list' THEN 57 + length(to_json(text)) WHEN kind = 'code' THEN length(text) ELSE 32 END) OVER (PARTITION BY doc_id, chapter) AS total FROM merged),
g(doc_id, chapter, ord, rn, w, held, part) AS (SELECT doc_id, chapter, ord, rn, w, w, 0 FROM s WHERE rn = 1
  UNION ALL SELECT s.doc_id, s.chapter, s.ord, s.rn, s.w, CASE WHEN total > 900 AND held + s.w > 900 AND kind IN ('h', 'p', 'rule') THEN s.w ELSE held + s.w END, CASE WHEN total > 900 AND held + s.w > 900 AND kind IN ('h', 'p', 'rule') THEN part + 1 ELSE part END FROM g JOIN s ON s.doc_id = g.doc_id AND s.chapter = g.chapter AND s.rn = g.rn + 1)"""
PARTS = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10)))))::INT AS k FROM documents)"""
GLYPHS = r"list_transform(string_split(t, ' '), lambda x: CASE WHEN length(x) = 1 AND regexp_matches(x, '[\p{L}\p{N}]') THEN 1 WHEN length(x) = 1 THEN 0 ELSE -1 END)"

SQL: dict[str, str] = {
    "runs_layout": f"WITH {RUNS} SELECT doc_id, page, run_no, str, x, baseline_y, em, advance, bold FROM runs",
    "w2_line_islands": f"WITH {RUNS}, {islands('runs')} SELECT doc_id, page, line_no, count(*) AS n_runs, min(run_no) AS first_run FROM isl GROUP BY ALL",
    "a1_line_modal_em": f"WITH {RUNS}, {islands('runs')}, {MODAL} SELECT doc_id, page, line_no, em::DOUBLE AS em FROM modal",
    "a3_line_facts": f"WITH {RUNS}, {islands('runs')}, {FACTS} SELECT * FROM facts",
    "a2_body_em": f"WITH {CANDIDATES} SELECT doc_id, body::DOUBLE AS body FROM bodies",
    "a5_leading": f"WITH {LINES} SELECT doc_id, page, coalesce(median(gap) FILTER (gap > 0), 0)::DOUBLE AS leading FROM (SELECT doc_id, page, baseline_y - lag(baseline_y) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS gap FROM lines) GROUP BY ALL",
    "f4_scanned_pages": f"WITH {RUNS} SELECT doc_id, page, sum(length(trim(str)))::BIGINT AS chars FROM runs GROUP BY ALL HAVING sum(length(trim(str))) < 40",
    "g2_join_fixed": f"WITH {RUNS}, {islands('runs')}, {GAPS}, {joined('0.25')} SELECT * FROM texts",
    "g3_space_calibration": f"""WITH {RUNS}, {islands('runs')}, spaced AS (SELECT doc_id, page, line_no, run_no * 2 AS run_no, str, x, em, advance FROM isl UNION ALL SELECT doc_id, page, line_no, run_no * 2 + 1, ' ', x + advance, em, 3 FROM isl),
g AS (SELECT *, lag(str) OVER w AS bef, lag(advance) OVER w AS ab, x - lag(x) OVER w - lag(advance) OVER w AS d, greatest(em, lag(em) OVER w)::DOUBLE AS m FROM spaced WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY x, run_no)),
f AS (SELECT doc_id, page, line_no, median(CASE WHEN bef = ' ' THEN ab WHEN str = ' ' THEN advance END / m) AS space, median(CASE WHEN bef <> ' ' AND str <> ' ' THEN d / m END) AS tracking FROM g WHERE bef IS NOT NULL GROUP BY ALL)
SELECT doc_id, page, line_no, round(least(greatest(greatest(0, coalesce(tracking, 0)) + 0.45 * space, 0.16), 1.0), 6)::DOUBLE AS ratio FROM f WHERE space IS NOT NULL""",
    "g4_cluster_calibration": f"WITH {TRACKED}, {OTSU} SELECT doc_id, page, line_no, round(ratio, 6)::DOUBLE AS ratio FROM cluster",
    "g1_calibrated_text": f"""WITH {TRACKED}, {OTSU}, r0 AS (SELECT gaps.*, coalesce(ratio, 0.25)::DOUBLE AS ratio, count(*) OVER (PARTITION BY doc_id, page, line_no) AS runs FROM gaps LEFT JOIN cluster USING (doc_id, page, line_no)),
{joined('ratio', 'r0').replace('texts AS', 't0 AS')}, {verdict(0)}, {joined('ratio', 'r1').replace('texts AS', 't1 AS')}, {verdict(1)}, {joined('ratio', 'r2').replace('texts AS', 't2 AS')}, {verdict(2)}
SELECT doc_id, page, line_no, text, round(CASE WHEN runs = 1 THEN 0.25 ELSE ratio END, 6)::DOUBLE AS ratio, runs > 1 AND verdict <> 'ok' AS uncertain FROM v2""",
    "l1_lines": f"WITH {MIXED_LINES} SELECT * FROM found",
    "l1_warnings": f"""WITH {MIXED_LINES}, sheets AS (SELECT doc_id, page, sum(length(trim(str))) AS chars, count(*) FILTER (skewed) AS turned FROM raws GROUP BY ALL)
SELECT doc_id, page, 'page-skipped' AS code, 'Page ' || (page + 1) || ' has no text; it may be a scan' AS message FROM sheets WHERE chars < 40
UNION ALL SELECT doc_id, page, 'rotated-text', turned || ' turned runs were left out of page ' || (page + 1) FROM sheets WHERE chars >= 40 AND turned > 0
UNION ALL SELECT DISTINCT doc_id, page, 'space-heuristic-uncertain', 'The spaces of page ' || (page + 1) || ' are uncertain' FROM found WHERE uncertain AND NOT detracked
UNION ALL SELECT doc_id, 0, 'letter-spacing', count(*) || CASE WHEN count(*) = 1 THEN ' line had' ELSE ' lines had' END || ' letters set apart, which were joined' FROM found WHERE detracked GROUP BY doc_id""",
    "f5_heading_candidates": f"WITH {CANDIDATES} SELECT doc_id, page, line_no, candidate FROM cand",
    "h1_headings": f"WITH {HEADINGS} SELECT doc_id, page, line_no, heading_level FROM heads",
    "a9_numbering": f"WITH {LINES.replace('lines AS (SELECT * FROM facts', 'base AS (SELECT * FROM facts')}, lines AS (SELECT * REPLACE (CASE WHEN bold AND doc_id % 3 = 0 THEN (page + 1) || '.' || (line_no + 1) || ' ' || text ELSE text END AS text) FROM base){CANDIDATES[len(LINES):]} SELECT doc_id, count(*) FILTER (candidate AND ({DEPTH.format(t='plain')}) IS NOT NULL) AS n_numbered, count(*) FILTER (candidate AND ({DEPTH.format(t='plain')}) IS NOT NULL) >= 3 AS numbered FROM cand GROUP BY doc_id",
    "b2_breaks": f"WITH {BREAKS} SELECT doc_id, page, line_no, breaks FROM broken",
    "b1_blocks": f"""WITH {BREAKS}, numbered_lines AS (SELECT *, (sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, line_no) - 1)::INT AS ord FROM broken),
b AS (SELECT doc_id, ord, min(page)::INT AS page, arg_min(heading_level, page * 1000 + line_no)::INT AS level, count(*) AS n_lines, string_agg(text, ' ' ORDER BY page, line_no) AS text FROM numbered_lines GROUP BY ALL),
k AS (SELECT *, CASE WHEN level > 0 THEN 'h' WHEN regexp_matches(text, '{MARKER}') THEN 'list' ELSE 'p' END AS kind FROM b WHERE trim(text) <> '')
SELECT doc_id, ord, page, kind, level, n_lines, length(CASE WHEN kind = 'list' THEN regexp_replace(text, '{MARKER}', '') ELSE text END)::BIGINT AS n_chars FROM k""",
    "b7_block_inlines": rf"""WITH {BREAKS}, numbered_lines AS (SELECT *, (sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, line_no) - 1)::INT AS ord FROM broken),
b AS (SELECT doc_id, ord, arg_min(heading_level, page * 1000 + line_no)::INT AS level, string_agg(text, ' ' ORDER BY page, line_no) AS text FROM numbered_lines GROUP BY ALL),
k AS (SELECT doc_id, ord, level = 0 AND regexp_matches(text, '{MARKER}') AS listed, CASE WHEN level = 0 AND regexp_matches(text, '{MARKER}') THEN regexp_replace(text, '{MARKER}', '') ELSE text END AS text FROM b WHERE trim(text) <> ''),
every_run AS (SELECT isl.doc_id, ord, isl.page, isl.line_no, isl.x, run_no, length(regexp_replace(str, '{WS}', '', 'g')) AS n, isl.bold AS b, run_no % 11 = 3 AS i, run_no % 13 = 5 AS c FROM isl JOIN numbered_lines USING (doc_id, page, line_no)),
-- a list's marker is its first run
styled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY page, line_no, x, run_no) AS place FROM every_run JOIN k USING (doc_id, ord)) WHERE NOT (listed AND place = 1)),
stretches AS (SELECT *, CASE WHEN lag((b, i, c)) OVER (PARTITION BY doc_id, ord ORDER BY page, line_no, x, run_no) IS DISTINCT FROM (b, i, c) THEN 1 ELSE 0 END AS fresh FROM styled)
SELECT k.doc_id, k.ord, md5({squeezed("k.text")}) AS text, sum(fresh)::INT AS n_inlines, sum(CASE WHEN b THEN n ELSE 0 END)::INT AS n_b, sum(CASE WHEN i THEN n ELSE 0 END)::INT AS n_i, sum(CASE WHEN c THEN n ELSE 0 END)::INT AS n_code
FROM k JOIN stretches s ON s.doc_id = k.doc_id AND s.ord = k.ord GROUP BY ALL""",
    "x_text_checks": rf"""WITH p AS (SELECT *, list_reduce(list_prepend(0, {GLYPHS}), lambda a, c: CASE WHEN c = 0 THEN a WHEN c = -1 THEN a % 100000 ELSE (a // 100000 + 1) * 100000 + greatest(a % 100000, a // 100000 + 1) END) % 100000 AS best,
  list_filter(string_split_regex(translate(t, chr(31), ' '), '{WS}+'), lambda x: x <> '') AS tokens FROM {PARTS}),
q AS (SELECT *, best >= 4 AND NOT list_has_any(string_split(t, ' '), ['=', '+', '*', '/', '<', '>', '±', '×', '÷', '≤', '≥', '≠']) AS tracked, length(regexp_replace(t, '{WS}', '', 'g')) AS letters FROM p)
SELECT doc_id, k, tracked, CASE WHEN len(tokens) >= 4 AND (letters / len(tokens)::DOUBLE < 2 OR len(list_filter(tokens, lambda x: length(x) = 1)) / len(tokens)::DOUBLE > 0.6) THEN 'too-low' WHEN NOT contains(t, ' ') AND letters > 40 THEN 'too-high' ELSE 'ok' END AS verdict,
  length(replace(t, ')', '')) > length(replace(t, '(', '')) OR length(replace(t, ']', '')) > length(replace(t, '[', '')) AS unclosed, ({DEPTH.format(t='t')})::INT AS depth, length(CASE WHEN tracked THEN replace(t, ' ', '') ELSE t END)::BIGINT AS n_detracked FROM q""",
    "x11_list_markers": rf"""WITH m AS (SELECT doc_id, k, ['1. ', '2) ', '(b) ', '• ', '- ', ''][(doc_id + k) % 6 + 1] || t AS line FROM {PARTS})
SELECT doc_id, k, regexp_matches(line, '{MARKER}') AS listed, nullif(regexp_extract(line, '^(\d+)[.)][\t\n\v\f\r ]+', 1), '')::INT AS list_start FROM m""",
    "x12_dehyphenate": rf"""WITH w AS (SELECT doc_id, k, list_filter(string_split(regexp_replace(t, '[^\p{{L}} ]', ' ', 'g'), ' '), lambda x: length(x) > 3) AS w FROM {PARTS})
SELECT doc_id, k, coalesce(array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 4 = 0 AND (lower(left(x, 2)) IN ('co', 're', 'ex') OR NOT regexp_matches(substr(x, 3), '^\p{{Ll}}')) THEN left(x, 2) || '- ' || substr(x, 3) ELSE x END), ' '), '') AS text FROM w""",
    "x1_xml_escape": r"""SELECT page_id, md5(replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{009F}\x{FFFE}\x{FFFF}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS body,
  replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS attribute FROM pages""",
    "x15_normalize_path": r"""SELECT page_id, array_to_string(list_reduce(list_transform(list_prepend('', string_split('OEBPS/./text/../' || regexp_extract(url, '://[^/]*/?([^?#]*)', 1) || '//img/../c.xhtml', '/')), lambda x: CASE WHEN x IN ('', '.') THEN []::VARCHAR[] ELSE [x] END),
  lambda a, x: CASE WHEN x = ['..'] THEN list_slice(a, 1, len(a) - 1) ELSE list_concat(a, x) END), '/') AS path FROM pages""",
    "x16_split_fragment": "SELECT page_id, string_split(url, '#')[1] AS path, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) END AS fragment FROM pages",
    "k4_filename": rf"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS t, CASE WHEN doc_id % 3 = 0 THEN ' .a: "' || source || chr(9) || '?  b. ' ELSE '' END AS a, CASE WHEN doc_id % 2 = 0 THEN source ELSE '..' END AS s FROM documents),
c AS (SELECT doc_id, {{t}} AS t, {{a}} AS a, {{s}} AS s FROM f),
st AS (SELECT *, CASE WHEN t <> '' AND a <> '' THEN t || ' - ' || a ELSE t END AS stem FROM c)
SELECT doc_id, CASE WHEN coalesce(nullif(stem, ''), nullif(s, '')) IS NULL THEN 'converted.epub' ELSE rtrim(left(coalesce(nullif(stem, ''), s), 120), '. ') || '.epub' END AS filename FROM st""",
    "m4_hue": f"SELECT doc_id, k, list_reduce(list_prepend(0, list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: unicode(c))), lambda h, c: (h * 31 + c) % 360)::INT AS hue FROM {PARTS}",
    "t1_toc": f"""WITH RECURSIVE {BLOCKS}, h AS (SELECT doc_id, ord, least(level - min(level) OVER (PARTITION BY doc_id) + 1, 3) AS cap, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM blocks WHERE kind = 'h'),
d(doc_id, ord, rn, depth, p1, p2) AS (SELECT doc_id, ord, rn, 1, ord, NULL::INT FROM h WHERE rn = 1
  UNION ALL SELECT h.doc_id, h.ord, h.rn, least(cap, depth + 1), CASE WHEN least(cap, depth + 1) = 1 THEN h.ord ELSE p1 END, CASE WHEN least(cap, depth + 1) = 2 THEN h.ord ELSE p2 END FROM d JOIN h ON h.doc_id = d.doc_id AND h.rn = d.rn + 1)
SELECT doc_id, ord, depth::INT AS depth, CASE depth WHEN 2 THEN p1 WHEN 3 THEN p2 END::INT AS parent_ord, (rn + 1)::INT AS play_order FROM d""",
    "c1_split_level": f"WITH {SPLIT} SELECT doc_id, h1, h2, split_level FROM split",
    "c3_merge": f"WITH {MERGED} SELECT doc_id, ord, grp, substantive, chapter FROM merged",
    "c4_size_guard": f"""WITH RECURSIVE {MIXED}{PACKED} SELECT doc_id, chapter, ord, w::BIGINT AS weight, part::INT AS part FROM g""",
    "c5_chapters": f"""WITH RECURSIVE {MIXED}{PACKED.replace("> 900", "> 200000")}, heads AS (SELECT doc_id, chapter, arg_min(CASE WHEN kind = 'h' AND level = split_level AND trim(text) <> '' THEN text ELSE '' END, ord) AS t FROM merged GROUP BY ALL),
rows AS (SELECT doc_id, chapter, part, count(*) AS n_blocks, min(ord)::INT AS first_ord, sum(w)::BIGINT AS weight FROM g GROUP BY ALL),
named AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY chapter, part) - 1)::INT AS chapter_no, CASE WHEN t = '' THEN 'Untitled' ELSE t END || CASE WHEN part > 0 THEN ' (cont.)' ELSE '' END AS title FROM rows JOIN heads USING (doc_id, chapter))
SELECT doc_id, chapter_no, 'ch' || lpad(chapter_no::VARCHAR, 3, '0') AS id, 'ch' || lpad(chapter_no::VARCHAR, 3, '0') || '.xhtml' AS href, title, part > 0 AS continuation, n_blocks, first_ord, weight FROM named""",
    "j6_marked_content": f"""WITH RECURSIVE {RUNS}, t AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY run_no) - 1 AS n FROM runs),
e AS (SELECT doc_id, page, n * 4 + o AS seq, n, CASE WHEN o = 0 THEN n % 9 + 1 ELSE 3 END AS what, row_number() OVER (PARTITION BY doc_id, page ORDER BY n * 4 + o) AS rn FROM t, (VALUES (0), (2), (3)) v(o)
  WHERE (o = 0 AND n % 9 IN (0, 1)) OR (o = 2 AND n % 9 IN (3, 5)) OR (o = 3 AND n % 13 = 12)),
-- a stack as text: A an artifact, D another span without an id, [m1] one with an id
st(doc_id, page, rn, seq, stack) AS (
  SELECT doc_id, page, 0::BIGINT, -1::BIGINT, '' FROM (SELECT DISTINCT doc_id, page FROM t)
  UNION ALL SELECT e.doc_id, e.page, e.rn, e.seq, CASE e.what WHEN 1 THEN stack || CASE WHEN e.n % 45 = 0 THEN 'A' ELSE 'D' END WHEN 2 THEN stack || '[m' || e.n || ']' ELSE regexp_replace(stack, '(A|D|\\[m[0-9]+\\])$', '') END
  FROM st JOIN e ON e.doc_id = st.doc_id AND e.page = st.page AND e.rn = st.rn + 1),
held AS (SELECT doc_id, page, seq, is_text, last_value(stack IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY seq) AS stack
  FROM (SELECT doc_id, page, n * 4 + 1 AS seq, NULL AS stack, true AS is_text FROM t UNION ALL SELECT doc_id, page, seq, stack, false FROM st))
SELECT doc_id, page, seq::INT AS seq, nullif(regexp_extract(stack, '\\[(m[0-9]+)\\][AD]*$', 1), '') AS mcid FROM held WHERE is_text AND NOT contains(stack, 'A')""",
    "n3_merge_adjacent": "SELECT conv_id, island::BIGINT AS island, role, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, sum(CASE WHEN role IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)) GROUP BY ALL",
    "j10_dangling_links": """SELECT page_id, count(*) AS n_dangling FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) h
WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE regexp_extract(p.url, '://[^/]*(/[^?#]*)', 1) = h.href) GROUP BY page_id""",
    "a16_exactly_one": """SELECT *, n_title = 1 AND n_nav = 1 AS ok FROM (SELECT page_id, len(regexp_extract_all(html, '<title[ >]'))::INT AS n_title, len(regexp_extract_all(html, '<h1[ >]'))::INT AS n_h1, len(regexp_extract_all(html, '<nav[ >]'))::INT AS n_nav FROM pages)""",
    "v_page_checks": r"""SELECT page_id, 'xhtml-no-xml-encoding' AS code FROM pages WHERE NOT regexp_matches(html, '^<\?xml[^>]*encoding="') UNION ALL SELECT page_id, 'xhtml-no-meta-charset' FROM pages WHERE NOT regexp_matches(html, '(?i)<meta[^>]*charset') UNION ALL SELECT page_id, 'xhtml-large' FROM pages WHERE strlen(html) > 20000""",
    "a10_doc_stats": f"WITH {BLOCKS} SELECT doc_id, headings, paragraphs, rules, quality, toxic FROM (SELECT doc_id, count(*) FILTER (kind = 'h') AS headings, count(*) FILTER (kind = 'p') AS paragraphs, count(*) FILTER (kind = 'rule') AS rules FROM blocks GROUP BY doc_id) LEFT JOIN labels USING (doc_id)",
    "o7_title_fallback": f"""WITH {BLOCKS}, first AS (SELECT doc_id, nullif(trim(arg_min(text, ord)), '') AS heading FROM blocks WHERE kind = 'h' GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Title ' || doc_id WHEN heading IS NOT NULL THEN heading ELSE source END AS title, CASE WHEN doc_id % 10 = 0 THEN 'override' WHEN heading IS NOT NULL THEN 'heading' ELSE 'filename' END AS title_source FROM documents LEFT JOIN first USING (doc_id)""",
    "rel_segment_revenue": "SELECT c_mktsegment AS segment, year(o_orderdate)::INT AS year, count(*) AS n_lines, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, year(o_orderdate)::INT)",
    "rel_event_sessions": "SELECT user_id, session::BIGINT AS session, count(*) AS n_events, min(event_id) AS first_event FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    from quire.plans.sql_items import SQL as ITEMS
    from quire.plans.sql_packages import SQL as PACKAGES

    def stem(c: str) -> str:
        return rf"""trim(trim(regexp_replace(regexp_replace({c}, '[/\\?%*:|"<>\x00-\x1F\x7F]', '', 'g'), '{WS}+', ' ', 'g'), '. '))"""

    return SQL | ITEMS | PACKAGES | {"st_blocks": SQL["b1_blocks"], "k4_filename": SQL["k4_filename"].format(t=stem("t"), a=stem("a"), s=stem("s"))}
