"""The registered queries opN_<name> of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, embedding, langid, lm, packing, sharding, simhash, token_counts, toxicity, url_filter, warc, whitening
from .common import fresh_path, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, packing.word_tokens(F.col("text")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs))
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(manifest, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).drop("url")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_exponion_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_url_filter": op8_url_filter,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sharding": op10_sharding,
    "op11_exponion_clustering": op11_exponion_clustering,
    "op12_whitening": op12_whitening,
    "op13_toxicity": op13_toxicity,
}

URL_SQL = """
WITH r(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS k
      FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e, list_dot_product(e, e) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / sqrt(a.n * b.n) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c
"""

WARC_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM d GROUP BY h),
b AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
        (list_reduce(list_transform(range(1, 6), lambda i: strpos('0123456789abcdef', substr(h, CAST(5 * (k // 4) + i AS INTEGER), 1)) - 1), lambda x, y: 16 * x + y) >> CAST(5 * (3 - k % 4) AS INTEGER)) % 32 AS INTEGER), 1)), '') AS digest FROM g)
SELECT d.page_id, strlen(d.p) AS payload_bytes, b.digest AS payload_digest, CASE WHEN d.page_id = g.keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = g.keep THEN NULL ELSE g.keep END AS refers_to
FROM d JOIN g USING (h) JOIN b USING (h)
"""

DECONTAMINATION_SQL = r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(0, greatest(len(w) - 12, 1)), lambda k: array_to_string(w[k + 1:k + 13], ' '))) AS s FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM w, n WHERE len(w) >= n),
h AS (SELECT dp.doc_id, dp.p, dp.n, iw.item_id FROM dp JOIN iw ON iw.n = dp.n AND iw.s = array_to_string(dp.w[dp.p + 1:dp.p + dp.n], ' ')),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""



def clustering_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Every round by every distance, as common table expressions."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda c: CAST(floor(1024 * c) AS BIGINT)) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
     WHERE len(e) = {width} AND len(list_filter(e, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, b.cluster, b.d FROM (SELECT v.vec_id, v.x, min(struct_pack(d := CAST({apart} AS BIGINT), cluster := c.cluster)) AS b FROM v, c{r} c GROUP BY v.vec_id, v.x))")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT cluster, k, CAST(sum(x[k]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, range(1, {width + 1}) g(k) GROUP BY cluster, k)")
            steps.append(f"f{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS x FROM m{r} GROUP BY cluster)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(f.x, c.x) AS x FROM c{r} c LEFT JOIN f{r} f USING (cluster))")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"
    )


ORACLES = {"op2_embedding_dedup": EMBEDDING_SQL, "op4_decontamination": DECONTAMINATION_SQL, "op7_warc": WARC_SQL, "op8_url_filter": URL_SQL, "op11_exponion_clustering": clustering_sql()}
