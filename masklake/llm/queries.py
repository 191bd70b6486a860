"""The registered queries of this package with their oracle SQL (None where SQL cannot say it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masklake.llm import centroids, classlm, decontaminate, divergence, exactdedup, language, linededup, mixing, ngramjoin, packing, personal, secrets, tokencount
from masklake.llm.common import crc_bucket


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exactdedup.dedup(table(spark, sf, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf, "documents"))


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf, "documents")))


def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return personal.report(docs, personal.find_personal(docs))


def op5_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = classlm.held_out(table(spark, sf, "documents"))
    return classlm.score(docs, classlm.train(docs.where(~F.col("held_out"))))


def op6_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return linededup.report(docs, linededup.removed_lines(docs))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", crc_bucket(F.col("doc_id"), 4) == 2)
    filters = language.train(docs.where(~F.col("held_out")))
    found = language.identify(docs.select("doc_id", "text", "held_out"), filters)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontaminate.find_benchmark(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontaminate.report(hits)


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM bw WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
occ AS (SELECT doc_id, s, win.m, item FROM pos JOIN win ON win.m = pos.m AND win.k = array_to_string(w[s:s + pos.m - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM occ) GROUP BY 1),
items AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op11_power_of_two_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return packing.report(packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY ALL),
dense AS (SELECT lang, source, term, coalesce(cnt.n, 0) AS n, kept.n AS ln FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
p AS (SELECT lang, source, term, n,
  CAST(1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER g + count(*) OVER g) AS BIGINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (ln + 1)) // (sum(ln) OVER g + count(*) OVER g) AS BIGINT) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 200
"""

def op13_pivot_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.report(*centroids.cluster(table(spark, sf, "embeddings"))).drop("exact")


def _clusters_sql(rounds: int = centroids.ROUNDS, clusters: int = centroids.CLUSTERS) -> str:
    """Plain assignment of every vector to every centroid, round by round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT r, vec_id, v.v, c, list_sum(list_transform(list_zip(v.v, c{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{k}),
a{k} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, CAST(min(d * {clusters} + c) % {clusters} AS INTEGER) AS c, CAST(min(d * {clusters} + c) // {clusters} AS BIGINT) AS d FROM d{k} GROUP BY r)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY c, i),
n{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY c),
c{k + 1} AS (SELECT c{k}.c, coalesce(n{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN n{k} USING (c))""")
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {clusters})),
{", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


OP13_SQL = _clusters_sql()

CASES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_ngram_jaccard_join": (op2_ngram_jaccard_join, None),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_personal_data": (op4_personal_data, None),
    "op5_class_lm": (op5_class_lm, None),
    "op6_source_mix": (op6_source_mix, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_line_dedup": (op8_line_dedup, None),
    "op9_language_id": (op9_language_id, None),
    "op10_benchmark_decontamination": (op10_benchmark_decontamination, OP10_SQL),
    "op11_power_of_two_packing": (op11_power_of_two_packing, None),
    "op12_source_divergence": (op12_source_divergence, OP12_SQL),
    "op13_pivot_clusters": (op13_pivot_clusters, OP13_SQL),
}
