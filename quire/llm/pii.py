"""Personal data by fixed forms and by bootstrapped contextual patterns; DataFrame functions only.

Base spans match the fixed forms of e-mail addresses, IP addresses, card and
phone numbers. All of them seed a bootstrap: tokens that look like identifiers and
runs of digit groups are instances. The words around one, together with its shape,
are its lexical patterns: one word before, two words before, and one word on each
side. The graph of patterns and instances is scored round by round: a pattern is
trusted by the share of its instances that are known, an instance by its best
pattern, and each round judges all patterns anew by the instances that the one
before found. What trusted patterns extract beyond the base becomes further
spans, of kind `id`.

Positions come from the gaps between matches, which a split by the same
expression returns, and running sums of lengths.

A document is known by a digest of its id and text, which comes out the same
however often and wherever Spark computes it; nothing hangs on the order of rows.

Edge cases: a null or empty text has no spans (and the digest of the empty
string); equal rows have equal results, and rows that share only their id are
searched one by one, null ids too; overlapping
spans of different kinds all stay, found ones that touch a base span do not;
columns of docs may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, small

#: The base forms, in the order of their kinds. Possessive quantifiers and the
#: checks at their start match the same spans as the plain forms, in linear time.
KINDS = ("email", "ip", "card", "phone", "id")
FORMS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A run of identifier characters that holds a digit or an at sign, from its start on.
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
#: Two or more groups of digits, joined by a dot or by spaces, brackets and hyphens; and the least digits of such a run.
GROUPS = r"(?<![A-Za-z0-9@._%+-])\+?+\(?+[0-9]++(?![A-Za-z@_%])(?:(?:\.|\x20*+[()-]*+\x20*+)[0-9]++(?![A-Za-z@_%]))++"
LEAST_DIGITS = 7

#: The bootstrap: rounds, smoothing of a pattern's score, least score and least seeds of a trusted pattern.
ROUNDS, SMOOTHING, TRUSTED, LEAST_SEEDS = 3, 2.0, 0.8, 3
#: Code points on each side of a candidate in which its context is looked for, and least length of a found identifier.
CONTEXT, LEAST_LENGTH = 48, 6


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        d = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    parts = F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 2) | (F.ltrim(p, F.lit("0")).between("100", "255") & (F.length(F.ltrim(p, F.lit("0"))) == 3)))
    return F.when(kind == 1, parts).when(kind == 2, F.length(digits).between(12, 19) & _luhn(digits)).when(kind == 3, F.length(digits).between(9, 15)).when(kind == 5, (F.length(digits) >= LEAST_DIGITS) & ~match.rlike("^" + FORMS[1] + r"\z")).otherwise(True)


def _pieces(text: Column, form: str, kind: int, needs: str) -> Column:
    """Matches of a form with the gap before each; a text without the needed character is not searched."""
    gaps = F.split(text, form, -1)
    following = F.concat(F.slice(gaps, 2, F.size(gaps)), F.array(F.lit("")))
    zipped = F.arrays_zip(gaps.alias("gap"), following.alias("next"), F.regexp_extract_all(text, F.lit(form), 0).alias("match"))

    def context(side: Column) -> Column:
        return side if kind >= 4 else F.lit(None).cast("string")

    found = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), z["match"].alias("match"), context(F.right(z["gap"], F.lit(CONTEXT))).alias("before"), context(F.left(z["next"], F.lit(CONTEXT))).alias("after")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,match:string,before:string,after:string>>")
    return F.filter(F.when(text.contains(needs) if len(needs) == 1 else text.rlike(needs), found).otherwise(none), lambda x: x["match"].isNotNull())


def _matches(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, match, before, after) of all matches of the forms and of candidates (kind 4 tokens, kind 5 runs of digit groups), base ones valid.

    Equal rows give equal matches, of which one is kept.
    """
    needs = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", "+", "[0-9@]", r"[0-9][\x20().-]")
    pieces = F.concat(*[_pieces(F.col("text"), form, k, needs[k]) for k, form in enumerate((*FORMS, CANDIDATE, GROUPS))])
    found = rows.filter(F.col("text").rlike("[0-9@]")).select("row", F.explode(pieces).alias("p")).select("row", "p.*")
    # dealt as the windows need it, so the repeats of a row go without a second shuffle
    each = found.repartition("row", "kind").dropDuplicates(["row", "kind", "i"])
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.length("match")).over(before), F.lit(0)) + F.col("gap")
    placed = each.withColumn("start", start).withColumn("end", F.col("start") + F.length("match"))
    return placed.filter(_valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end", "match", "before", "after")


def _shape(match: Column) -> Column:
    """What kind of characters an identifier has, and how long it is."""
    kind = (
        F.when(match.contains("@"), "mail").when(match.rlike(r"^[0-9]+\z"), "digits").when(match.rlike(r"^[0-9.]+\z"), "dotted").when(match.rlike(r"^[0-9a-f]+\z"), "hex").when(match.rlike(r"^[A-Z0-9]+\z"), "code").otherwise("mixed")
    )
    return F.concat(kind, F.lit(":"), F.when(F.length(match) < 20, F.length(match)).otherwise(20))


def _patterns(shape: Column) -> Column:
    """The patterns of an occurrence: its shape with one word before, with two, and with one on each side. Letters in lower case, digits as 9."""

    def plain(side: str) -> Column:
        return F.regexp_replace(F.lower(side), "[0-9]+", "9")

    near = F.regexp_extract(plain("before"), r"(\p{L}++[^\p{L}]*+)\z", 1)
    two = F.regexp_extract(plain("before"), r"(\p{L}++[^\p{L}]++\p{L}++[^\p{L}]*+)\z", 1)
    after = F.regexp_extract(plain("after"), r"^([^\p{L}]*+\p{L}++)", 1)
    # a blank in front of the shape tells the kinds of patterns apart
    return F.array_compact(F.array(F.concat(near, F.lit(" <"), shape), F.when(two != "", F.concat(two, F.lit(" <<"), shape)), F.when((near != "") & (after != ""), F.concat(near, F.lit(" <>"), shape, F.lit("> "), after))))


def _discovered(candidates: DataFrame, touched: DataFrame) -> DataFrame:
    """(row, start, end) of candidates that trusted patterns extract.

    touched: r, s, e of the base spans. Seeds are tokens that hold a base span
    and runs that overlap one, and tokens of a base form.
    """
    m = F.col("match")
    form = m.rlike("^" + FORMS[0] + r"\z") | (m.rlike("^" + FORMS[1] + r"\z") & _valid(F.lit(1), m)) | (m.rlike(r"^[0-9]{12,19}\z") & _valid(F.lit(2), m))
    meets = (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")) & ((F.col("kind") == 5) | ((F.col("start") <= F.col("s")) & (F.col("e") <= F.col("end"))))
    candidates = candidates.join(touched, (F.col("row") == F.col("r")) & meets, "left")
    seed = F.col("r").isNotNull() | ((F.col("kind") == 4) & form)
    shape = F.when(F.col("kind") == 5, "groups").otherwise(_shape(m))
    known = candidates.select("row", "start", "end", "match", seed.alias("seed"), F.explode(_patterns(shape)).alias("pattern"))
    # one edge for a pattern and an instance, however often they meet
    edges = checkpointed(known.groupBy("pattern", F.xxhash64("match").alias("instance")).agg(F.max(F.col("seed").cast("double")).alias("seed")))
    scores = edges.select("pattern", "instance", "seed", F.col("seed").alias("score"))
    n_patterns = edges.select("pattern").distinct().count()

    def trusts(scores: DataFrame) -> DataFrame:
        """Trust of each pattern that is trusted: doubtful ones must not lend their instances the score that would lift them."""
        found = scores.groupBy("pattern").agg((F.sum("score") / (F.count("*") + SMOOTHING)).alias("trust"), F.count_if(F.col("score") >= TRUSTED).alias("believed"))
        return found.filter((F.col("trust") >= TRUSTED) & (F.col("believed") >= LEAST_SEEDS)).select("pattern", "trust")

    for _ in range(ROUNDS):
        # a frequent pattern has many edges: its one score is joined, never its edges collected
        met = edges.join(small(trusts(scores), n_patterns), "pattern", "left").groupBy("instance").agg(F.greatest(F.max("seed"), F.max("trust")).alias("score"))
        scores = checkpointed(edges.join(met, "instance").select("pattern", "instance", "seed", "score"))
    trusted = trusts(scores).select("pattern")
    fresh = known.filter(~F.col("seed") & (F.length("match") >= LEAST_LENGTH))
    return fresh.join(small(trusted, n_patterns), "pattern", "left_semi").select("row", "start", "end").distinct()


def find_spans(rows: DataFrame) -> DataFrame:
    """rows: row, text (not null); rows with the same `row` are equal. Returns (row, start, kind, end), kind as its number; starts and ends in code points, ends exclusive."""
    found = checkpointed(_matches(rows))
    base = found.filter(F.col("kind") < 4).select("row", "start", "kind", "end")
    touched = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    extra = _discovered(found.filter(F.col("kind") >= 4), touched)
    fresh = extra.join(touched, (F.col("row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
    return base.unionAll(fresh.select("row", "start", F.lit(4).alias("kind"), "end"))


def _key(id_col: str, text_col: str) -> Column:
    """A digest of id and text; null ids and texts count as empty."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def _spans_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__row, __spans): the sorted spans (start, kind, end) of each digest that has any."""
    rows = docs.select(_key(id_col, text_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return find_spans(rows).groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("__spans"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts by kind, the digest of its base spans, and all spans as kind:start:end."""
    spans = _spans_of(docs, id_col, text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("__row"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    grouped = named.join(spans, "__row", "left").select("doc_id", F.coalesce("__spans", none).alias("spans"))
    names = F.array(*map(F.lit, KINDS))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 4)
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return grouped.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def mask_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with each span of their text replaced by its kind in angle brackets.

    Overlapping spans are masked together, under the kind of the first.
    """
    # the caller's columns travel in a struct, apart from those of the join
    named = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"), _key(id_col, text_col).alias("key"))
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int")), labels[span["kind"]])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(span["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    masked = F.aggregate("__spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    joined = named.join(_spans_of(docs, id_col, text_col), F.col("key") == F.col("__row"), "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"doc.{c}").alias(c) for c in docs.columns])
