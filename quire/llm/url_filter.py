"""URL filters: pattern rules indexed by their rarest literal token.

A rule's regular expression can only match a URL that holds all of the
pattern's literal tokens. They are read off the parsed pattern, and the rule is
filed under one of them: the one that the fewest URLs hold. The tokens of a URL
fetch the rules filed under them, and only those run their regular expression.

Edge cases: a null URL, or one without `://`, has an empty host and path, no
rule and the default verdict; a URL of any length is judged whole; ids are
passed on as they are, null and repeated ones too; columns of pages may have any
names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rule list travels with each task; a longer or larger one is refused, not cut.
MAX_RULES, MAX_PATTERN_CHARS = 200_000, 32_000_000

TOKEN = r"[a-z0-9]+"


def _literal(code: int) -> str:
    return chr(code) if chr(code).isascii() and chr(code).isalnum() else " "


def literal_text(parsed) -> str:  # noqa: ANN001
    """What every match of a parsed pattern holds, in order: its characters, a blank for any delimiter, `?` where something unknown may stand.

    Optional parts and choices count as unknown, unless no character of theirs can belong to a token.
    """
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += _literal(arg)
        elif name == "NOT_LITERAL":
            out += "?"
        elif name == "AT":
            # the ends of the text bound a token, and so does a word boundary beside a letter
            out += " " if str(arg) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING", "AT_BOUNDARY") else ""
        elif name == "SUBPATTERN":
            out += literal_text(arg[-1]) if not arg[1] and not arg[2] else "?"
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            held = literal_text(inner)
            if least == 0:
                # a part that may be missing leaves what stands before it, and if present ends as it does
                out += ("" if held.endswith(" ") and (not out or out.endswith(" ")) else "?") if held else ""
            else:
                out += held if least == most == 1 else held + "?" + held
        elif name == "BRANCH":
            bounds = {_delimits(b) for b in arg[1]}
            out += " " if bounds == {True} else "?"
        elif name == "IN":
            out += " " if all(str(o) == "LITERAL" and _literal(a) == " " for o, a in arg) else "?"
        elif name not in ("ASSERT", "ASSERT_NOT"):
            out += "?"
    return out


def _delimits(parsed) -> bool:  # noqa: ANN001
    """Whether a choice is nothing but delimiters."""
    held = literal_text(parsed)
    return bool(held) and not held.strip(" ")


def literals_of(pattern: str) -> tuple[str, ...]:
    """The whole tokens that every match of a pattern holds; case counts unless the pattern is in lower case."""
    parsed = re._parser.parse(pattern)  # the standard library's own parser
    flags = parsed.state.flags & re.IGNORECASE
    text = literal_text(parsed)
    # a pattern need not end where a token does
    whole = re.findall(rf"(?<![a-zA-Z0-9?])[a-zA-Z0-9]+(?=[ ])", text if text.startswith(" ") else "?" + text)
    # beside i, k and s other letters match if case does not count
    return tuple(dict.fromkeys(t.lower() for t in whole if not flags or not set(t.lower()) & set("iks")))


@dataclass(frozen=True)
class Rule:
    """`pattern` is matched at the start of host + path; its literals are read off it."""

    name: str
    verdict: str
    pattern: str
    listed: bool = True  # listed rules name their own result; the others only give the method's verdict
    literals: tuple[str, ...] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "literals", literals_of(self.pattern))


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule that fits a host and its subdomains below a path."""
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}")


#: Words of a host's labels, and labels before a host, that mark link farms, adverts and trackers. Fixed values, a parameter of `judge_urls`.
SPAM_HOST_WORDS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "casino-bonus", "online-casino", "poker-win", "buy-pills", "cheap-meds", "replica-watches", "payday-loans", "seo-links", "link-farm", "adult-cams", "xxx-tube")
AD_HOST_LABELS = ("adserver", "doubleclick", "popads", "clickbank", "adtracker", "trackersrv", "adnetwork", "affiliates", "telemetry")
#: First segments of a path that hold no text: adverts, trackers and carts.
EMPTY_PATHS = ("adclick", "adview", "pixel", "beacon", "trackback", "cgi-bin", "wp-login.php", "xmlrpc.php")


def default_patterns() -> list[Rule]:
    host = r"^(?:[^/?#]*\.)?"
    return [
        *[Rule(w, "block", host + re.escape(w) + r"\.[^/?#]*", listed=False) for w in SPAM_HOST_WORDS],
        *[Rule(w, "block", host + re.escape(w) + r"\.[^/?#]*", listed=False) for w in AD_HOST_LABELS],
        *[Rule("/" + w, "block", r"^[^/?#]*/" + re.escape(w) + r"(?:/|\Z)", listed=False) for w in EMPTY_PATHS],
    ]


def url_host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def index_rules(rules: list[Rule], frequency: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal; under "" those that have none."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        key = min(rule.literals, key=lambda t: (frequency.get(t, 0), -len(t), t), default="")
        index.setdefault(key, []).append(rule)
    return index


def judge_urls(pages: DataFrame, rules: list[Rule], patterns: list[Rule] | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the longest listed rule that fits, and the verdict."""
    rules = rules + (default_patterns() if patterns is None else patterns)
    if len(rules) > MAX_RULES or sum(len(r.pattern) for r in rules) > MAX_PATTERN_CHARS:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} of {MAX_PATTERN_CHARS} characters can travel with each task")
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    literals = sorted({t for r in rules for t in r.literals})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(TOKEN), 0))
    # at most one row per literal of the rule list comes back
    counted = parts.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, literals)))).alias("token")).groupBy("token").count() if literals else None
    index = index_rules(rules, {r["token"]: r["count"] for r in counted.collect()} if literals else {})
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, compiled = shared.value, {}

        def fits(rule: Rule, url: str) -> bool:
            if rule.pattern not in compiled:
                compiled[rule.pattern] = re.compile(rule.pattern)
            return bool(compiled[rule.pattern].match(url))

        def best(url: str) -> tuple[str | None, str]:
            keys = dict.fromkeys(re.findall(TOKEN, url.lower()))
            hits = [r for k in ("", *keys) for r in found.get(k, ()) if fits(r, url)]
            listed = max((r for r in hits if r.listed), key=lambda r: (len(r.name), r.name), default=None)
            other = max((r for r in hits if not r.listed), key=lambda r: (len(r.name), r.name), default=None)
            return (listed.name if listed else None, (listed or other).verdict if listed or other else default)

        for batch in batches:
            got = [best(h + p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            columns = [batch.column(c) for c in ("page_id", "host", "path")] + [pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
