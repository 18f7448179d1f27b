"""URL rules, HTML extraction, both near-duplicate operators, language model and pipeline against plain Python."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import embedding_dedup, html_text, lm, minhash, registry, url_filter
from tests.conftest import SMALL

EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "x"), (4, "x"), (None, "a b"), (5, "word " * 3000), (6, "ä" * 9000), (9, "Word " * 3000)]


def components(ids, links):
    parent = {i: i for i in ids}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(SMALL) / t}.parquet')")
    got, want = registry.queries()[name](spark, SMALL), con.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, want.select(*order).fetchall()))


# --- ids


def test_ids_come_back_as_they_are(spark):
    """Beside a null id, ids above 2**53 keep their last digits; ids may repeat."""
    ids, known = [9007199254740993, None, 9007199254740995, 5, 5], None
    pages = spark.createDataFrame([(i, "http://a.net/es/x", "<p>a</p>", "h", "r", "v") for i in ids], "page_id long, url string, html string, host string, rule string, verdict string")
    for out in (url_filter.judge_urls(pages, registry.URL_RULES), html_text.extract_main_text(pages)):
        known = sorted(str(r["page_id"]) for r in out.collect())
        assert known == sorted(map(str, ids))
    assert html_text.extract_main_text(pages.limit(0)).collect() == []


# --- URLs


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        (r"^(?:[^/?#]*\.)?example\.com/en/", ("example", "com", "en")), (r"^(?:[^/?#]*\.)?example\.com/en", ("example", "com")), (r"^[^/?#]*/pixel(?:/|\Z)", ("pixel",)),
        (r"foo\.bar/", ("bar",)), (r"^a+b/c/", ("c",)), (r"^(?:x|y)abc/", ()), (r"(?i)^Foo/kit/", ("foo",)), (r"^x?y/", ()), (r"^\w+/z/", ("z",)),
    ],
)
def test_literals_are_read_off_the_pattern(pattern, literals):
    assert url_filter.literals_of(pattern) == literals



def test_index_gives_what_all_rules_give(spark):
    rnd = random.Random(1)
    hosts = ["com", "example.com", "a.example.com", "b.net", "net", "example-shop.com", "xexample.com", "café.org"]
    rules = [url_filter.host_path_rule(rnd.choice(["allow", "block"]), h, p) for h in hosts for p in ("/", "/en/", "/en", "/x1/y") if rnd.random() < 0.7]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "x://a.example.com/en/?q#f", "http://com/", "http://a.b.net#/x1/y"]
    urls += [f"http://{rnd.choice(['', 'www.', 'm.a.'])}{rnd.choice(hosts)}{rnd.choice(['', '/', '/en', '/en/7', '/english', '/x1/y2', '/EN/'])}{rnd.choice(['', '?a/en/', '#x'])}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules, patterns=[]).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for h, p, r in ((*_split(r.name), r) for r in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: (len(r.name), r.name), default=None)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        assert (got[i]["rule"], got[i]["verdict"]) == ((best.name, best.verdict) if best else (None, "allow")), u
    assert url_filter.judge_urls(df.limit(0), rules).collect() == []


def _split(name):
    cut = name.index("/")
    return name[:cut], name[cut:]


# --- HTML


def test_extraction_on_pages_not_trained_on():
    rnd, model = random.Random(77), html_text.trained()
    pages = [html_text.sample_page(rnd) for _ in range(150)]
    right = sum(got.split() == want.split() for (_, want), got in zip(pages, html_text.extract([p for p, _ in pages], model), strict=True))
    assert right / len(pages) >= 0.93


def test_extraction_of_the_table_and_edges(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    import re
    from html import unescape

    for r in html_text.extract_main_text(pages).collect():
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["text"] == " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split()) and r["n_chars"] == len(r["text"])
    odd = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<div>" * 5000), (4, "u", "<article><p>a&amp;b\u00a0 c<b>d</b>e<br>f</article>"), (5, "u", "<article>" + "<p>word</p>" * 20_000)]
    df = spark.createDataFrame([(*r, "t", 3) for r in odd], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract_main_text(df).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["page_id"] in (1, 2, 3)} == {""}
    assert "a&b cde f" in {r["text"] for r in got} and " ".join(["word"] * 20_000) in {r["text"] for r in got}
    assert html_text.extract_main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("odd", ['<svg class="icon"/>', "<button>", "<object data=x>", "<select>", "<template>", "<div><button></div>", '<svg><title/><path d="1"/></svg>', "<svg><g><title>t</title></g></svg>", "<button><div>b</div></button>", "<object><object>b</object>", "<button><button>b</button>"])
def test_dropped_elements_hold_only_their_subtree(odd):
    def text(n):
        return "".join(p if isinstance(p, str) else text(p) for p in n.parts)

    for rest in ("", "<button>b</button>", "<svg>b</svg>"):
        nodes = html_text.parse(f"<body>{odd}<article><p>all of it</p></article>{rest}</body>")
        assert [n.tag for n in nodes if n.tag in ("article", "p")] == ["article", "p"]
        assert text(nodes[0]) == "all of it" and nodes[0].size == 9
        assert not {n.tag for n in nodes} & html_text.DROPPED


@pytest.mark.parametrize("page", ["<a " * 350_000, '<p class="x>hello ' * 50_000, "<div>" * 30_000 + "</b>" * 60_000, "<b>" * 30_000 + "<p>x" * 30_000, "<b>" * 30_000 + "<li>x" * 30_000])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 3


def test_unclosed_quotes_lose_no_text():
    nodes = html_text.parse("<article><p class=\"x>one two</p><p>it's</p><title>no</title><svg><title/>no</svg><p>three</p></article>")
    words = html_text.main_text(nodes, {id(n) for n in nodes})
    assert words == "one two it's three"


def test_decoding_never_contradicts():
    rnd = np.random.default_rng(1)
    for seed in range(30):
        nodes = html_text.parse(html_text.sample_page(random.Random(seed))[0])
        chosen = html_text.decode(nodes, rnd.normal(size=len(nodes)))
        assert all(n.parent is None or id(n.parent) in chosen for n in nodes if id(n) in chosen)


# --- MinHash


def exact_near_duplicates(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = [x for x in (t or "").encode().lower().split()]
        if d is not None and w:
            n = min(size, len(w))
            sets.setdefault(d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    ids, links = [d for d, _ in rows if d is not None], []
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    return components(ids, links), sets


def test_near_duplicates_with_large_groups(docs, monkeypatch):
    """Copies, near copies of one text at about the threshold, chains and unrelated texts; small blocks force their use."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))) for i in range(60)]
    for i in range(100, 220):
        edited = list(base)
        for _ in range(rnd.randint(0, 6)):
            edited[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i, " ".join(edited)))
    rows += [(300 + i, " ".join(base).upper()) for i in range(30)]
    rows += [(400 + i, f"{a} {b}") for i, (a, b) in enumerate([("x", "y"), ("x", "y"), ("x", "z")])]
    monkeypatch.setattr(minhash, "BLOCK", 16)
    for size in (2, 5):
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(rows), size, 80).collect()}
        want, sets = exact_near_duplicates(rows, size, 80)
        assert {d: r["component_id"] for d, r in got.items()} == want
        assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (want[d] == d) for d, r in got.items())


def test_texts_that_share_an_id_share_a_component(docs):
    a, b, c = "one two three four five six", "seven eight nine ten", "eleven twelve thirteen"
    got = minhash.near_duplicates(docs([(3, a), (7, a), (7, b), (9, b), (11, c), (7, b)]), 2, 80).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (7, 3, False), (7, 3, False), (7, 3, False), (9, 3, False), (11, 11, True)]


def test_near_duplicate_edges(docs):
    got = minhash.near_duplicates(docs(EDGES), 2, 80).collect()
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got)
    assert found == sorted([("1", 0, "1", True), ("2", 0, "2", True), ("3", 0, "3", True), ("4", 1, "4", True), ("4", 1, "4", True), ("None", 1, "None", True), ("5", 1, "5", True), ("6", 1, "6", True), ("9", 1, "5", False)])
    assert minhash.near_duplicates(docs([]), 2, 80).collect() == []


def test_bayesian_pruning_keeps_similar_pairs():
    rnd = np.random.default_rng(2)
    n = minhash.BANDS * minhash.ROWS
    for similarity, low, high in ((0.8, 0.9999, 1.0), (0.3, 0.0, 0.001)):
        a = rnd.integers(0, 1 << 32, (20_000, n), dtype=np.uint64).astype(np.uint32)
        b = np.where(rnd.random(a.shape) < similarity, a, a + np.uint32(1))
        assert low <= len(minhash.survivors(a, b, 0.8)) / len(a) <= high


# --- embeddings


@pytest.mark.parametrize(("filled", "broadcast"), [(4096, 50_000), (8, 0), (0, 50_000)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, filled, broadcast):
    """With one to three hashes to a bucket, small blocks, and buckets found by broadcast and by join."""
    monkeypatch.setattr(embedding_dedup, "FILLED", filled)
    monkeypatch.setattr(embedding_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(embedding_dedup, "LARGE", 20)
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 24))
    rows = []
    for i in range(400):
        v = base[i % 40] + rnd.normal(size=24) * rnd.choice([0.05, 0.2, 0.35])
        rows.append((i, [float(x) for x in v], int(i % 3 == 0)))
    rows += [(500 + i, rows[0][1], 1) for i in range(40)] + [(600, [2 * x for x in rows[0][1]], 1)]
    rows += [(700, None, 1), (701, [0.0] * 24, 1), (702, [1.0, None] + [1.0] * 22, 1), (703, [float("nan")] * 24, 1), (704, rows[0][1], None), (705, [], 1), (706, [1e200] * 24, 1), (707, [3e200] * 24, 1), (708, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, label int, kept boolean")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    got = {r["vec_id"]: r for r in embedding_dedup.link_embeddings(df).collect()}
    unit = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            a = np.array(v) / np.abs(v).max()
            unit[i] = (label, a / np.linalg.norm(a))
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.93]
    degree, want = Counter(x for p in links for x in p), components([r[0] for r in rows], links)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (degree[i], want[i], want[i] == i) for i, _, _ in rows}
    assert embedding_dedup.link_embeddings(df.limit(0)).collect() == []


def test_hashes_grow_with_the_labels():
    assert [embedding_dedup.hashes_for(n, 64) for n in (1000, 100_000, 1_000_000, 100_000_000)] == [1, 1, 2, 3]


def test_embeddings_with_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, a, 1), (7, a, 1), (7, b, 1), (9, b, 1), (None, c, 1), (11, c, 1), (None, None, 1), (12, a, 2)]
    got = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    found = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got)
    assert found == sorted([("3", 1, "3", True), ("7", 1, "3", False), ("7", 1, "3", False), ("9", 1, "3", False), ("None", 1, "None", True), ("11", 1, "11", True), ("None", 0, "None", True), ("12", 0, "12", True)])


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_recall_at_the_threshold(hashes):
    rnd = np.random.default_rng(4)
    a = rnd.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rnd.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    x, y = embedding_dedup.bucket_codes(a, hashes), embedding_dedup.bucket_codes(b, hashes)
    assert np.mean([bool(set(p.tolist()) & set(q.tolist())) for p, q in zip(x, y, strict=True)]) > 0.999


# --- language model


def test_base_scores_and_held_out_gain(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    words = {r["doc_id"]: r["text"].encode().lower().split() + [b""] for r in df.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = c.total(), len(c)
    got = lm.score_documents(df).collect()
    for r in got:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert r["score"] < 0
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_model_is_a_distribution_and_batches_agree():
    hot = sorted(Counter(w for i in range(300) for w in [b"w%d" % (i % 70)]).items(), key=lambda x: (-x[1], x[0]))
    model = lm.Model(hot, 5.0)
    rnd = np.random.default_rng(5)
    model.w = {k: (v + rnd.normal(size=v.shape) * 0.3).astype(np.float32) if k != "ob" else v for k, v in model.w.items()}
    h = rnd.normal(size=(1, lm.UNITS)).astype(np.float32)
    total = sum(math.exp(model.output(h, np.array([i], np.int32))[0][0]) for i in [*range(70), lm.HEAD])
    assert total == pytest.approx(1, abs=1e-4)
    docs = [rnd.integers(0, 70, rnd.integers(1, 200)).astype(np.int32) for _ in range(40)]
    assert lm.score(model, docs) == pytest.approx([lm.score(model, [d])[0] for d in docs], rel=1e-4)


def test_gradient_equals_differences_of_the_loss():
    """Of the largest entries of each weight, over two windows' worth of documents that start inside the window."""
    hot = [(b"w%d" % i, 200 - i) for i in range(150)]
    model, rnd = lm.Model(hot, 5.0), np.random.default_rng(2)
    model.w = {k: (v + rnd.normal(size=v.shape) * 0.2).astype(np.float32) if k != "ob" else v for k, v in model.w.items()}
    ids = rnd.integers(0, 150, (12, 6)).astype(np.int32)
    ids[:, 5] = lm.HEAD + rnd.integers(0, lm.ENDINGS, 12)
    ids[9:, 4] = -1
    start = rnd.random((12, 6)) < 0.2
    start[0] = True

    def loss():
        h, total = np.zeros((lm.UNITS, 6), np.float32), 0.0
        room = [np.empty((k * lm.UNITS, 6), np.float32) for k in (2, 1, 1)]
        for t in range(12):
            h[:, start[t]] = 0
            real = ids[t] >= 0
            total -= model.output(h.T[real], ids[t][real])[0].sum()
            h = model.step(h, np.ascontiguousarray(model.w["x"][np.maximum(ids[t], 0)].T), *room)
        return total

    grad, dx = lm.gradient(model, np.zeros((lm.UNITS, 6), np.float32), ids, start)
    grad["x"] = np.zeros_like(model.w["x"])
    np.add.at(grad["x"], ids[ids >= 0], dx.transpose(0, 2, 1)[ids >= 0])
    for k in model.w:
        for at in np.argsort(-np.abs(grad[k]), axis=None)[:5].tolist():
            place = np.unravel_index(at, grad[k].shape)
            kept, ends = model.w[k][place], []
            for step in (0.01, -0.01):
                model.w[k][place] = kept + np.float32(step)
                ends.append(loss())
            model.w[k][place] = kept
            assert (ends[0] - ends[1]) / 0.02 == pytest.approx(float(grad[k][place]), rel=0.03, abs=0.02), (k, place)


def test_gradient_step_lowers_the_loss():
    hot = [(b"a", 50), (b"b", 50), (b"c", 50), (b"", 20)]
    model, docs = lm.Model(hot, 1.0), [np.array([0, 1, 2] * 40 + [3], np.int32) for _ in range(30)]
    before = lm.score(model, docs).sum()
    for _ in range(6):
        lm.train(model, docs)
    assert lm.score(model, docs).sum() > 0.5 * before


def test_network_trains_on_every_training_text(docs, monkeypatch):
    average, seen = lm._average, []

    def spy(models):
        models = lm.checkpointed(models)
        seen.extend(r["n"] for r in models.collect())
        return average(models)

    monkeypatch.setattr(lm, "_average", spy)
    texts = docs([(i, f"some words of text {i}") for i in range(200)]).select("doc_id", F.col("text").cast("binary").alias("text"))
    hot = [(w, 200) for w in (b"", b"of", b"some", b"text", b"words")]
    lm.trained(texts, 30_000_000, hot, 201.0)  # told of a corpus so large, it once read a 16th
    assert sum(seen) == 200 * 6


def test_a_round_of_a_shard_fills_its_lanes():
    """Windows cost nearly the same with few lanes as with all of them."""
    rnd, docs, n = np.random.default_rng(6), [], 0
    while n < lm.SHARD_TOKENS / lm.ROUNDS:
        docs.append(np.zeros(1 + int(min(rnd.lognormal(5.65, 1.1), 9000)), np.int32))
        n += len(docs[-1])
    parts = list(lm.windows(docs, 64, mixed=True))
    assert sum((ids >= 0).sum() for ids, _, _ in parts) == n > 0.6 * len(parts) * 64 * lm.STEPS


def test_outputs_equal_plain_softmaxes():
    """Of states and ids in one column each, in any order of the classes, tail words and empty places of a class among them."""
    hot = [(b"w%d" % i, 9000 - i) for i in range(5000)]
    model, rnd = lm.Model(hot[:100] + hot[4096:], 5.0), np.random.default_rng(8)
    model.w = {k: (v + rnd.normal(size=v.shape) * 0.2).astype(np.float32) if k != "ob" else v for k, v in model.w.items()}
    h, ids = rnd.normal(size=(60, lm.UNITS)).astype(np.float32), rnd.integers(0, 100, 60).astype(np.int32)
    ids[::7] = lm.HEAD + 3
    w = {k: v.astype(float) for k, v in model.w.items()}
    for x, i, got in zip(h, ids.tolist(), model.output(h, ids)[0], strict=True):
        outer = x @ w["c"] + w["cb"]
        k = i // lm.CLASS if i < lm.HEAD else model.classes + (i - lm.HEAD) // lm.ENDINGS
        plain = outer[k] - np.log(np.exp(outer).sum())
        if i < lm.HEAD:
            inner = x @ w["o"][k] + w["ob"][k]
            plain += inner[i % lm.CLASS] - np.log(np.exp(inner).sum())
        assert got == pytest.approx(plain, abs=1e-4)


def test_tail_words_have_classes_that_follow_the_context():
    """Two tail words of different frequency alternate; the network learns which comes next."""
    hot = [(b"w%d" % i, 9000 - i) for i in range(9000)]
    model = lm.Model(hot, 5.0)
    ids, _ = model.ids([b"w2100", b"w4100", b"w8200", b"unseen"])
    assert ids[0] == 2100 and len({(i - lm.HEAD) // lm.ENDINGS for i in ids[1:].tolist()}) == 3
    total = np.exp(model.w["cb"]).astype(float)
    assert total.sum() == pytest.approx(sum(c + 1 for _, c in hot) + 5, rel=1e-4)
    assert total[model.classes + 1] == pytest.approx(sum(c + 1 for _, c in hot[4096:8192]), rel=1e-4)
    docs = [ids[[1, 2] * 60] for _ in range(30)]
    before = lm.score(model, docs).sum()
    for _ in range(6):
        lm.train(model, docs)
    assert lm.score(model, docs).sum() > 0.5 * before


def test_tokens_of_odd_texts_are_those_of_plain_splitting():
    odd = [b"", b" ", b"\n\n", b" a  b ", b"A\x0bB\x0cc\rd\te", b"x\x1cy\x1dz \x85 \xc2\xa0q", "\u00c9 \u00c0 \u00df".encode(), b"\xff\xfe bad", b"a\x00b", b"w2"]
    model = lm.Model([(b"w%d" % i, 9000 - i) for i in range(5000)], 5.0)
    for texts in (odd, odd[:1], []):
        found, plain = lm.Tokens(pa.array(texts, pa.binary())), [[*t.lower().split(), b""] for t in texts]
        words = found.words.to_pylist()
        assert [words[i] for i in found.places.tolist()] == [w for ws in plain for w in ws] and found.sizes.tolist() == list(map(len, plain))
    expected = [2, lm.HEAD + lm.ENDINGS + (48 * 31 + 48) % lm.ENDINGS, lm.HEAD, lm.HEAD + 120 * 31 % lm.ENDINGS, lm.HEAD + (121 * 31 + 120) % lm.ENDINGS]
    assert model.ids([b"w2", b"w4500", b"", b"x", b"xy"])[0].tolist() == expected


def test_texts_are_split_once_and_training_deals_ids(docs, monkeypatch):
    """Shards were once dealt as texts, which training and scoring each split again."""
    plain, seen = lm.checkpointed, []
    monkeypatch.setattr(lm, "checkpointed", lambda df: seen.append(df.columns) or plain(df))
    got = lm.score_documents(docs([(i, f"some words of text {i}") for i in range(40)])).collect()
    assert len(got) == 40 and {r["n_tokens"] for r in got} == {6}
    assert ["ids", "shard", "round"] in seen and not any("text" in columns for columns in seen)


def test_short_integer_ids_are_scored(docs):
    rows = docs([(i, f"some words of text {i}") for i in range(5)])
    assert sorted(r["doc_id"] for r in lm.score_documents(rows.withColumn("doc_id", F.col("doc_id").cast("int"))).collect()) == list(range(5))


def test_a_scored_batch_fills_its_lanes():
    rnd, docs, n = np.random.default_rng(6), [], 0
    while n < lm.BATCH_TOKENS:
        docs.append(np.zeros(1 + int(min(rnd.lognormal(5.65, 1.1), 9000)), np.int32))
        n += len(docs[-1])
    assert n > 0.8 * lm.STEPS * lm.LANES * sum(1 for _ in lm.windows(docs, lm.LANES))


def test_outputs_of_extreme_states_equal_plain_softmaxes():
    """Logits beyond the range of float32's exponentials, high and low ones."""
    model, rnd = lm.Model([(b"w%d" % i, 9000 - i) for i in range(200)], 5.0), np.random.default_rng(8)
    model.w = {k: (v + rnd.normal(size=v.shape)).astype(np.float32) if k != "ob" else v for k, v in model.w.items()}
    for scale, moved in ((100.0, 0.0), (1.0, 300.0), (1.0, -300.0)):
        h, ids = (scale * rnd.normal(size=(50, lm.UNITS))).astype(np.float32), rnd.integers(0, 200, 50).astype(np.int32)
        w = {k: v.astype(float) for k, v in model.w.items()}
        model.w["cb"] = (w["cb"] + moved).astype(np.float32)
        for x, i, got in zip(h.astype(float), ids.tolist(), model.output(h, ids)[0], strict=True):
            outer, inner = x @ w["c"] + w["cb"], x @ w["o"][i // lm.CLASS] + w["ob"][i // lm.CLASS]
            plain = sum(v[k] - v.max() - np.log(np.exp(v - v.max()).sum()) for v, k in ((outer, i // lm.CLASS), (inner, i % lm.CLASS)))
            assert got == pytest.approx(plain, rel=1e-3, abs=1e-2)
        model.w["cb"] = w["cb"].astype(np.float32)


def test_language_model_edges(docs):
    got = lm.score_documents(docs(EDGES)).collect()
    assert len(got) == len(EDGES) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert lm.score_documents(docs([])).collect() == []


# --- pipeline


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, docs, tmp_path):
    import corpus_pipeline

    def text(i):
        rnd = random.Random(i)
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40))

    item = text(999)
    rows = [(i, text(i), "en", "s" + str(i % 3)) for i in range(30)]
    rows += [(50, text(1), "en", "s0"), (51, text(2) + " more", "en", "s0"), (52, text(60) + " " + item + " " + text(61), "en", "s0"), (53, text(70) + " call +1 (234) 567-8901", "en", "s1"), (54, "123 ---", "en", "s1"), (55, None, None, None), (3, text(3), "en", "s0")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "personal_data", "source_mix"]
    frame, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = frame.columns
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns
        left[name] = Counter(r["doc_id"] for r in frame.collect())
    clean = Counter(range(30))
    assert left["language_id"] == clean + Counter([50, 51, 52, 53, 3])
    assert left["near_dedup"] == clean + Counter([52, 53]) and left["decontaminate"] == left["personal_data"] == clean + Counter([53])
    assert frame.filter("doc_id = 53").first()["text"].endswith("call <PHONE>")
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert set(r["doc_id"] for r in final.select("doc_id").collect()) <= set(clean) | {53} and final.filter(F.col("repeats") < 1).isEmpty()


def test_near_dedup_keeps_a_unique_text_whose_id_repeats(spark, docs, tmp_path):
    import corpus_pipeline

    def text(i):
        rnd = random.Random(i)
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40))

    a, b, c = text(1), text(2), text(3)
    rows = [(3, a), (5, a), (5, b), (5, b), (6, c), (7, b + " more"), (8, None), (None, a)]
    left = corpus_pipeline.near_dedup(spark, docs(rows), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(3, a), (5, b), (6, c), (8, ""), (0, a)])
