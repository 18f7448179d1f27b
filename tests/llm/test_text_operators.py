"""Mixing, token counts, personal data, decontamination and language ID against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, language_id, mixing, pii, token_counts
from tests.conftest import SMALL

EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "x"), (4, "x"), (None, "a b"), (5, "word " * 30_000), (6, "ä" * 70_000), (7, "1 2 " * 20_000), (8, "9" * 30_000 + "@" + "b." * 8_000 + "c")]


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- mixing


def water_fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = {}, sum(sizes.values())
    open_ = set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check_mix(rows, got):
    sizes, by = {}, {}
    for d, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        by.setdefault(s, []).append(n)
    target = water_fill(sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    taken = {}
    src = {d: s for d, _, s in rows}
    for r in got:
        s = src[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s]
        assert r["size"] == 0 or (r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - target[s]) <= max(by[s]) / 2 + 1e-6


def test_mix_meets_targets_and_reruns_agree(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    got = mixing.mix_sources(df).collect()
    check_mix(rows, got)
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}


def test_mix_with_caps(docs):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randint(1, 40), None, rnd.choice(["a"] * 20 + ["b"] * 3 + ["c", None])) for i in range(300)]
    got = mixing.mix_sources(docs(rows)).collect()
    check_mix([(d, t, s) for d, t, _, s in rows], got)


def test_mix_edges(docs):
    got = mixing.mix_sources(docs(EDGES)).collect()
    assert len(got) == len(EDGES) and all(r["taken"] == r["size"] for r in got)
    assert mixing.mix_sources(docs([])).collect() == []
    kept = mixing.mixed_documents(docs([(1, "a b", "en", "s"), (2, "c d e", "en", "s")])).collect()
    assert [r["repeats"] for r in kept] == [1, 1] and {r["text"] for r in kept} == {"a b", "c d e"}


def test_mix_spreads_null_and_repeated_ids(docs):
    """Texts under a null id have hashes of their own, and equal rows are taken in any number."""
    unlike = [(None, f"a b c d {i}", "en", "p") for i in range(600)]
    alike = [(None, "a b c d e", "en", "q")] * 900 + [(i, "v w", "en", "r") for i in range(50)]
    for rows in (unlike + [(1, "x y z", "en", "q")] * 700, alike):
        df = docs(rows).repartition(7)
        got = mixing.mix_sources(df).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            assert r["taken"] in [k * r["size"] for k in range(4)]
            target, taken = by.get(r["source_size"], (r["target"], 0))
            by[r["source_size"]] = (target, taken + r["taken"])
        assert all(abs(taken - target) <= 5 for target, taken in by.values())
        again = mixing.mix_sources(docs(rows).repartition(3)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, again)))
        mixed = mixing.mixed_documents(df).collect()
        assert sum(r["repeats"] * len(r["text"].split()) for r in mixed) == sum(r["taken"] for r in got)


def test_mix_reruns_agree_where_only_the_source_differs(spark, docs):
    """Rows that share id and text but not the source, or, for the mixed documents, any other column."""
    rows = [(i % 50, f"a b c {i % 50}", "en", "pqrs"[i // 50 % 4]) for i in range(400)]
    got = [sorted(map(str, map(tuple, mixing.mix_sources(docs(rows).repartition(n)).collect()))) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]
    made = docs(rows).withColumn("n_chars", (F.hash("source", "doc_id") % 5).cast("long"))
    mixed = [sorted(str((r["doc_id"], r["source"], r["n_chars"], r["repeats"])) for r in mixing.mixed_documents(made.repartition(n)).collect()) for n in (1, 3, 7)]
    assert mixed[0] == mixed[1] == mixed[2]


#: Names that operators use inside, or did.
INNER = ["__row", "__spans", "__hash", "__source", "gone_id", "gone", "key", "id", "doc", "row", "hash", "h", "body", "again", "digest", "plan_source", "threshold", "passes", "rep", "print", "place"]


def test_clashing_names(spark, docs, tmp_path):
    """Columns of the caller come back as they were, whatever they are called."""
    import corpus_pipeline

    frame = docs([(1, "mail a@b.co now", "en", "s"), (1, "mail a@b.co now", "en", "s"), (2, "c d e f g h", "en", "t"), (2, "other words", "en", "t")])
    frame = frame.select("*", *[F.lit(f"own {c}").alias(c) for c in INNER])
    for out in (pii.mask_personal_data(frame), mixing.mixed_documents(frame), corpus_pipeline.near_dedup(spark, frame, str(tmp_path))):
        rows = out.collect()
        assert rows and set(frame.columns) <= set(out.columns)
        assert all(r[c] == f"own {c}" for r in rows for c in INNER)
    own = mixing.mixed_documents(frame.withColumn("repeats", F.lit("own"))).collect()
    assert all(r["repeats"] in (1, 2, 3) for r in own)
    for made in (pii.personal_data(frame), mixing.mix_sources(frame), decontaminate.benchmark_overlap(frame, spark.createDataFrame([(1, "c d e f g h")], "item_id long, text string"))):
        assert made.count() == 4


# --- token counts


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_counts_equal_the_library(spark, docs, vocabulary):
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    odd = ["Hello <|endoftext|> WÖRLD's 123...!!! áb", "x<|endoftext|><|startoftext|>y don't i'd", "ΑΣ ΣΑΣ İ é ᰜ a\x1cb\x85c\xa0d", "😀😃 ½²³ Ⅷ", "日本語 中文", "<|endoftext|", "'s'S '''"]
    odd += ["x" * 500 + ".", "中文，日本語。" * 60, "a,b;c(d)e!f?g:h" * 40]
    odd += ["".join(rnd.choice("abcdefghijklmnop'.!0 éü\n") for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1000 + i, r["text"]) for i, r in enumerate(documents(spark).limit(60).collect())]
    library = Tokenizer.from_file(vocabulary)
    want = {i: len(e.ids) for (i, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}
    for chunk in (token_counts.CHUNK, 13):
        got = token_counts.count_tokens(docs(rows), vocabulary, chunk=chunk).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == want
        assert {r["doc_id"]: r["n_bytes"] for r in got} == {i: len(t.encode()) for i, t in rows}


def test_token_counts_edges(docs, vocabulary):
    got = token_counts.count_tokens(docs(EDGES[:7]), vocabulary).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["over_limit"]) for r in got) == [(False, 1, 0, False), (False, 2, 0, False), (False, 3, 0, False), (False, 4, 1, False), (False, 4, 1, False), (False, 5, 30_000, True), (True, 0, 2, False)]
    assert token_counts.count_tokens(docs([]), vocabulary).collect() == []


def test_chunk_maps_compose_associatively(vocabulary):
    counts = token_counts.word_counts(vocabulary)
    text = "one two<|endoftext|>three  four-five six".encode()
    for i in range(len(text)):
        for j in range(i, len(text)):
            a, b, c = (token_counts.chunk_map(t, counts) for t in (text[:i], text[i:j], text[j:]))
            left = token_counts.compose(token_counts.compose(a, b, counts), c, counts)
            right = token_counts.compose(a, token_counts.compose(b, c, counts), counts)
            assert left == right and token_counts.total(left, counts) == token_counts.total(token_counts.chunk_map(text, counts), counts)


# --- personal data


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def digest(spans):
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_base_spans_equal_plain_forms(spark, docs):
    rnd = random.Random(3)
    alphabet = ["4", "1", "12", "255", "256", ".", ".", "@", "a", "b.c", "-", " ", "  ", "+1", "(", ")", "é", "😀", "4111111111111111", "_", "%"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60)))) for i in range(1500)]
    rows += [(5000 + i, t) for i, t in enumerate(["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "01.002.255.0", "4111 1111-1111 1111", "é+1 (234) 567-8901.", "x@y", "x@y.z.", "1..2.3.4", "+1+12345678901"])]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(rows)).collect()}
    for i, t in rows:
        assert got[i]["base_sha256"] == digest(base_spans(t)), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[1] == k for s in base_spans(t)) for k in range(4)]


def test_pii_edges(docs):
    got = pii.personal_data(docs(EDGES)).collect()
    assert len(got) == len(EDGES)
    assert {r["base_sha256"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {digest([])}
    assert sum(r["n_email"] for r in got) == 1
    assert pii.personal_data(docs([])).collect() == []


def test_bootstrap_finds_identifiers_in_trusted_contexts(docs):
    rnd = random.Random(4)

    def card():
        d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    rows = [(i, f"Paid with card number {card()} today in shop {rnd.randint(1, 9)}") for i in range(40)]
    bad = "4111111111111112"  # fails the check, so only its context tells
    rows += [(100, f"Paid with card number {bad} today"), (101, f"The total of page {bad} differs")]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(rows)).collect()}
    assert got[100]["n_card"] == 0 and got[100]["spans"] == "id:22:38"
    assert got[101]["spans"] == ""


def test_bootstrap_learns_from_phones_and_spaced_cards(docs):
    rnd = random.Random(6)

    def digits(n):
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return rnd.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    rows = [(i, f"please call +1 ({digits(3)}) {digits(3)}-{digits(4)} at noon") for i in range(40)]
    rows += [(50 + i, f"Paid with card number {card()} today") for i in range(40)]
    bad = "4111 1111 1111 1112"  # fails the check
    rows += [(200, "please call (555) 123 4567 at noon"), (201, "please call 555.123.4567 at noon"), (202, f"Paid with card number {bad} today"), (203, f"The total of page {bad} differs, like (555) 123 4567")]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(rows)).collect()}
    assert [got[i]["spans"] for i in (200, 201, 202, 203)] == ["id:12:26", "id:12:24", "id:22:41", ""]
    assert all(got[i]["n_phone"] == 1 and "id" not in got[i]["spans"] for i in range(40))
    assert all(got[50 + i]["spans"] == "card:22:41" for i in range(40))


def test_masks_stay_with_their_rows(spark, docs):
    """Whatever deals the rows: a shuffle below the operator, repeated rows, texts that share an id, null ids."""
    rows = [(i, f"write to user{i}@mail.example.com now" if i % 2 else f"nothing {i} here") for i in range(400)]
    rows += [(1, rows[1][1]), (1, "other text of one"), (None, "call +1 (555) 123-4567"), (None, "call nobody")]
    df = docs(rows).repartition(5)
    got = pii.personal_data(df).collect()
    assert len(got) == len(rows)
    assert sum(r["n_email"] for r in got) == sum("@" in t for _, t in rows) and sum(r["n_phone"] for r in got) == 1
    want = sorted(str((d, re.sub(r"user\d+@mail.example.com", "<EMAIL>", t).replace("+1 (555) 123-4567", "<PHONE>"))) for d, t in rows)
    assert sorted(str((r["doc_id"], r["text"])) for r in pii.mask_personal_data(df).collect()) == want


def test_patterns_of_both_sides_and_of_two_words(docs):
    """One word before does not tell cards from page numbers; two words, or the word after, do."""
    rnd = random.Random(9)

    def card():
        d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    def wrong():
        d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if not luhn(d + c))

    rows = [(i, f"The card number {card()} expires soon") for i in range(40)]
    rows += [(100 + i, f"A serial number {wrong()} follows") for i in range(40)]
    rows += [(200, f"The card number {wrong()} expires soon"), (201, f"Her card number {wrong()} was lost"), (202, f"Some number {wrong()} expires soon"), (203, f"A serial number {wrong()} follows")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(rows)).collect()}
    assert [got[i] for i in (200, 201, 202, 203)] == ["id:16:32", "id:16:32", "id:12:28", ""]


def test_masking(docs):
    rows = [(1, "mail a@b.co or 1.2.3.4!"), (2, "none"), (3, None), (3, None)]
    got = pii.mask_personal_data(docs(rows))
    assert got.columns == docs([]).columns
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == [(1, "mail <EMAIL> or <IP>!"), (2, "none"), (3, ""), (3, "")]


# --- decontamination


def test_wand_equals_scoring_everything():
    rnd = random.Random(5)
    words = [b"w%d" % i for i in range(60)]
    items = [(i, [rnd.choice(words[: rnd.randint(3, 60)]) for _ in range(rnd.randint(1, 12))], []) for i in range(400)]
    index = decontaminate.Index(items, 64, 7.5, {w: rnd.randint(0, 500) for w in words}, 500)
    for _ in range(400):
        query, scores = set(rnd.sample(words, rnd.randint(1, 30))), {}
        for t in query:
            for d, w in index.postings.get(t, []):
                scores[d] = scores.get(d, 0) + w
        want = sorted(d for d, s in scores.items() if s >= decontaminate.RETRIEVE - 1e-9)
        assert sorted(index.search(query)) == want
        # the gate before the search never loses an item
        if want:
            assert index.worth_a_search({t for t in query if t in index.rare})


def test_decontamination_on_planted_items(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    want = {d: sorted(i for i, t in items.items() if t in x) for d, x in rows}
    got = {r["doc_id"]: [int(i) for i in r["items"].split(",") if i] for r in decontaminate.benchmark_overlap(documents(spark), bench).collect()}
    assert got == want and any(want.values())
    filler = " ".join(t for _, t in rows[:3])
    planted = [(1, filler + " " + items[3].upper() + " " + filler), (2, items[5].replace(" ", "\n")), (3, " ".join(items[7].split()[:4]) + " " + filler)]
    got = {r["doc_id"]: r["items"] for r in decontaminate.benchmark_overlap(docs(planted), bench).collect()}
    assert got[1] == "3" and got[2] == "5" and "7" not in got[3].split(",")


def test_decontamination_of_an_item_depends_on_it_alone(spark, docs, monkeypatch):
    """One long item more, or smaller blocks, changes nothing for the others."""
    rnd = random.Random(11)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))

    items = [(i, words(rnd.randint(5, 90))) for i in range(30)]
    texts = docs([(i, f"{words(50)} {t if i % 3 else ' '.join(t.split()[:-2])} {words(300)}") for i, t in items])
    schema = "item_id long, text string"
    found = [sorted(map(tuple, decontaminate.benchmark_overlap(texts, spark.createDataFrame(items, schema)).collect()))]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    found.append(sorted(map(tuple, decontaminate.benchmark_overlap(texts, spark.createDataFrame(items, schema)).collect())))
    assert found[0] == found[1] and sum(r[1] for r in found[0]) >= 20
    more = sorted(map(tuple, decontaminate.benchmark_overlap(texts, spark.createDataFrame([*items, (99, words(9000))], schema)).collect()))
    assert [r[2] for r in more] == [r[2] for r in found[0]]


def test_decontamination_in_blocks_and_edges(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "eins zwei drei vier funf sechs"), (2, "eins zwei drei vier funf sechs"), (3, None), (None, "x"), (4, " ")], "item_id long, text string")
    rows = docs([*EDGES, (20, "so: alpha beta gamma delta epsilon zeta. Eins zwei drei vier funf sechs")])
    for size in (decontaminate.BLOCK_ITEMS, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        got = decontaminate.benchmark_overlap(rows, bench).collect()
        assert len(got) == len(EDGES) + 1 and {r["items"] for r in got if r["contaminated"]} == {"1,2"}
    assert decontaminate.benchmark_overlap(docs([]), bench).collect() == []
    assert not decontaminate.benchmark_overlap(rows, bench.limit(0)).filter("contaminated").collect()


def test_decontamination_of_long_changed_and_unnamed_items(spark, docs, tmp_path):
    import corpus_pipeline

    def text(seed, n):
        rnd = random.Random(seed)
        return ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]

    long, item, unnamed = text(1, 20_500), text(2, 30), text(3, 12)
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(item)), (None, " ".join(unnamed))], "item_id long, text string")
    changed = " ".join([*item[:10], "other", *item[11:]])
    rows = docs([(1, " ".join(["so", *long, "it", "is"])), (2, changed), (3, " ".join(unnamed)), (4, " ".join(text(4, 50)))])
    assert {r["doc_id"]: r["items"] for r in decontaminate.benchmark_overlap(rows, bench).collect()} == {1: "1", 2: "2", 3: "", 4: ""}
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, rows, str(tmp_path)).collect()] == [4]


# --- language ID


def test_language_held_out_accuracy(spark):
    got = language_id.predict_language(documents(spark)).join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95


def test_pair_machines_decide_inside_families(spark):
    sample = language_id.labelled_sample(documents(spark), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "doc_id", "text", "lang")
    model = language_id.fit(sample)
    assert len(model.languages) == 4 and len(model.families) == 2 and sum(len(g) * (len(g) - 1) // 2 for g in model.families) == len(model.pairs) > 0
    # without the pairs, a family's first language would be all of it
    texts = [r["text"].encode() for r in documents(spark).filter("text IS NOT NULL").limit(60).collect()]
    plain = language_id.Model(model.languages, model.families, model.weights, model.bias, [])
    assert [model.predict(t)[0] for t in texts] != [plain.predict(t)[0] for t in texts]


def test_families_are_of_bounded_size():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 9, 30, 100):
        means = rnd.random((n, 50)).astype(np.float32)
        groups = language_id.families_of(means / means.sum(1, keepdims=True))
        assert sorted(i for g in groups for i in g) == list(range(n)) and max(map(len, groups)) <= max(1, 2 * math.isqrt(n))


def test_fit_spreads_few_profiles_at_once():
    """The fit's memory does not hold all rows times all n-grams, and each row is what its text's profile is."""
    rnd = np.random.default_rng(3)
    texts = [bytes(rnd.integers(97 + 4 * (i % 3), 109 + 4 * (i % 3), 300, dtype=np.uint8)) for i in range(600)]
    full = [language_id.profile(t) for t in texts[:40]]
    rows = [(np.flatnonzero(p).astype(np.uint16), p[p > 0]) for p in map(language_id.profile, texts)]
    few = language_id.Profiles(rows[:40])
    assert (few[np.arange(40)] == np.stack(full)).all() and (few.mean(np.arange(40)) == np.stack(full).mean(0)).all()
    tracemalloc.start()
    model = language_id.fit([(f"l{i % 3}", row) for i, row in enumerate(rows)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 * (4 << language_id.HASH_BITS) / 4
    assert np.mean([model.predict(t)[0] == f"l{i % 3}" for i, t in enumerate(texts)]) > 0.95


def test_machine_comes_near_the_best_loss():
    """Against plain full-batch descent on the same loss, many steps of it."""
    rnd = np.random.default_rng(7)
    x = rnd.random((120, 30)).astype(np.float32)
    y = np.where(x @ rnd.normal(size=30) + 0.3 * rnd.normal(size=120) > 0.2, 1.0, -1.0)
    w, b = language_id.train_svm(x, np.arange(120), y)
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())

    def loss(w, b):
        return (weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2).mean()

    v, c = np.zeros(30), 0.0
    for _ in range(20_000):
        slack = weight * np.maximum(0, 1 - y * (x @ v + c)) * y
        v, c = v + 0.05 * (x.T @ slack) / 120, c + 0.05 * slack.mean()
    assert loss(w, b) < loss(v, c) + 0.25 * (loss(v * 0, 0) - loss(v, c))
    assert ((x @ w + b > 0) == (y > 0)).mean() > ((x @ v + c > 0) == (y > 0)).mean() - 0.05


def test_language_never_reads_labels_of_the_held_out(spark):
    df = documents(spark)
    lost = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("xx")).otherwise(F.col("lang")))
    plain, other = ({(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict_language(d).collect()} for d in (df, lost))
    assert plain == other


def test_language_edges(docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict_language(docs(EDGES)).collect()}
    assert got[1] == got[2] == got[7] == ("und", 0.0) and got[4][0] == "und"  # nothing to learn from
    one = [(i, "the cat sat on the mat", "en") for i in range(12)] + [(50, "...", "en"), (51, None, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_language(docs(one)).collect()}
    assert got[50] == got[51] == "und" and got[3] == "en"
    assert language_id.predict_language(docs([])).collect() == []
