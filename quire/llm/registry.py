"""The driver queries of this subpackage, with the parameters they run with in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import byte_bpe, decontaminate, embedding_dedup, html_text, language_id, lm, minhash, mixing, pii, prefix_trie, sort_means, token_counts, url_filter
from quire.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The fixed rules of the URL query.
URL_RULES = [
    url_filter.host_path_rule("allow", "com", "/"),
    url_filter.host_path_rule("block", "example.com", "/en/"),
    url_filter.host_path_rule("allow", "www.example.com", "/en/"),
    url_filter.host_path_rule("block", "net", "/es/"),
    url_filter.host_path_rule("block", "net", "/fr/"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_language(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.sort_means(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_embedding_dedup, op3_url_filter, op4_source_mix, op5_token_counts, op6_decontaminate, op7_pii, op8_html_text, op9_minhash_dedup, op10_lm_score, op11_prefix_trie, op12_sort_means, op13_byte_bpe)}


OP3_SQL = rf"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule_host, rule_path, listed) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(listed, length(rule_host || rule_path)) AS listed
  FROM (SELECT DISTINCT host, path FROM parts) d JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule,
       coalesce(listed, CASE WHEN regexp_matches(parts.host || parts.path, '^([^/]*\.)?({"|".join(url_filter.SPAM_HOST_WORDS + url_filter.AD_HOST_LABELS)})\.|^[^/]*/({"|".join(url_filter.EMPTY_PATHS).replace(".", "[.]")})(/|\z)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fit USING (host, path)
"""


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
-- by prefix filter: a pair at the threshold shares one of the rarest shingles of each
ranked AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS r
  FROM shingles JOIN (SELECT s, count(*) AS f FROM shingles GROUP BY s) USING (s) JOIN sizes USING (doc_id)),
prefix AS (SELECT doc_id, s, n FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM pairs JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.a, e.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = d.doc_id
"""


#: The CRC table is worked out by its rule; turns are told apart by length-marked text, prefixes by chained digests.
OP11_SQL = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT b, b::BIGINT, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INTEGER + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns), crc),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d, turn, words FROM (
    SELECT convs.c, 0 AS own, b.k, turn, words FROM convs JOIN turns b ON b.c = convs.c - convs.c % 20 AND b.k < h
    UNION ALL SELECT c, 1, k, turn, words FROM convs JOIN turns USING (c) WHERE k >= h)),
prefixes(c, d, p, up, words) AS (
  SELECT c, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM convs
  UNION ALL SELECT r.c, r.d, sha256(p || r.turn), p, r.words FROM prefixes JOIN rebuilt r ON r.c = prefixes.c AND r.d = prefixes.d + 1),
lengths AS (SELECT c, max(d) AS n FROM prefixes GROUP BY c),
nodes AS (
  SELECT p, d, min(c) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (c) GROUP BY p, d),
kids AS (SELECT up AS p, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
facts AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
-- a node's ancestors are the prefixes of any of its members
below AS (SELECT a.p, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved FROM facts f JOIN prefixes a ON a.c = f.conv_id AND a.d <= f.d GROUP BY a.p)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM facts f JOIN below USING (p) LEFT JOIN nodes u ON u.p = f.up
"""


def _op12_sql(rounds: int = 10) -> str:
    """Every round as two tables: the nearest centroids, then their means rounded down."""

    def assigned(centroids: str) -> str:
        return f"""(SELECT id, vec_id, v, cluster, distance FROM (
          SELECT id, vec_id, v, cluster, distance, row_number() OVER (PARTITION BY id ORDER BY distance, cluster) AS r
          FROM (SELECT id, vec_id, kept.v, k AS cluster, list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept CROSS JOIN {centroids} c)) WHERE r = 1)"""

    steps = ["c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM kept QUALIFY k < 8)"]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED {assigned(f'c{i}')}",
            f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (SELECT cluster AS k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY k)",
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (k))",
        ]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
{", ".join(steps)},
fin AS MATERIALIZED {assigned(f"c{rounds}")}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM fin JOIN c{rounds} c ON c.k = fin.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2_SQL, "op3_url_filter": OP3_SQL, "op9_minhash_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_sort_means": _op12_sql()}
