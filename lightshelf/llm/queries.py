"""The queries that apply the operators to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lightshelf.llm import codebooks, html_pages, id_matrices, langid, lp_packing, matroska, ngram_join, pieces, repeats, resampling, token_counts, toxicity, vectors
from lightshelf.llm.common import table
from lightshelf.llm.tokens import vocabulary_path


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.text_media(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), percent=80)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), limit=512)


def op5_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp_packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0)


def op6_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.extract(table(spark, sf_dir, "pages"))


def op9_id_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_matrices.matrices(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"), entries=64, parts=16, rounds=2)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, buckets=10000, seed=7)


def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"), least=200)


#: DuckDB forms of the operators that SQL can express; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
g AS MATERIALIZED (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS x FROM s),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN c ON node = doc_id""",
    "op6_embedding_near_duplicates": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
k AS MATERIALIZED (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id""",
}



def _codes_sql(rounds: int) -> str:
    """Product codebooks by comparing every part with every entry."""
    near = "SELECT x.row, x.p, min_by(b.k, (d, b.k)) AS k, min(d) AS d FROM (SELECT x.row, x.p, b.k, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts x JOIN {books} b USING (p)) x JOIN {books} b ON b.p = x.p AND b.k = x.k GROUP BY 1, 2"
    steps = []
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(books=f'b{i}')})",
            f"m{i} AS (SELECT p, k, list(m ORDER BY i) AS x FROM (SELECT p, k, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM (SELECT p, k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM parts JOIN a{i} USING (row, p)) GROUP BY ALL) GROUP BY ALL)",
            f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (p, k))",
        ]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, e[p * len(e) // 16 + 1:(p + 1) * len(e) // 16] AS x FROM v, range(16) AS r(p)),
b0 AS (SELECT p, row - 1 AS k, x FROM parts WHERE row <= 64),
{", ".join(steps)},
f AS MATERIALIZED ({near.format(books=f"b{rounds}")}),
c AS (SELECT row, string_agg(lower(lpad(to_hex(k), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM b{rounds}) AS codebooks_sha256 FROM v JOIN c USING (row)"""


ORACLE_SQL["op11_vector_codes"] = _codes_sql(2)
ORACLE_SQL["op12_importance_resampling"] = r"""
WITH t0 AS (SELECT b AS i, b AS r FROM range(256) AS x(b)),
steps AS (SELECT i, list_reduce([r] || range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS r FROM t0),
crc AS MATERIALIZED (SELECT list(r ORDER BY i) AS t FROM steps),
texts AS (SELECT 0 AS part, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS MATERIALIZED (SELECT part, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS MATERIALIZED (SELECT part, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
known AS MATERIALIZED (SELECT f, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, strlen(f)), lambda i: CAST(('0x' || substr(hex(f), 2 * i + 1, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM feats), crc),
placed AS MATERIALIZED (SELECT part, id, bucket FROM feats JOIN known USING (f)),
n AS (SELECT bucket, count(*) FILTER (part = 0) AS s, count(*) FILTER (part = 1) AS t FROM placed GROUP BY 1),
s AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n, s),
w AS (SELECT id AS doc_id, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM placed JOIN g USING (bucket) WHERE part = 0 GROUP BY 1),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN w USING (doc_id) JOIN (SELECT id AS doc_id, w FROM words WHERE part = 0) USING (doc_id)),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k.rank <= 25 * k.n // 100 THEN k.rank END AS rank FROM r LEFT JOIN k USING (doc_id)"""
ORACLE_SQL["op13_suffix_repeats"] = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n, hex(coalesce(text, '')) AS x FROM documents),
w AS MATERIALIZED (SELECT row, p, md5(substr(x, 2 * p + 1, 400)) AS s FROM d, unnest(range(0, greatest(0, n - 199))) AS r(p)),
hit AS (SELECT row, p FROM w JOIN (SELECT s FROM w GROUP BY 1 HAVING count(*) > 1) USING (s)),
gap AS (SELECT row, p, lag(p) OVER o AS before, lead(p) OVER o AS after FROM hit WINDOW o AS (PARTITION BY row ORDER BY p)),
first AS (SELECT row, p AS a, row_number() OVER (PARTITION BY row ORDER BY p) AS i FROM gap WHERE before IS NULL OR p - before > 200),
last AS (SELECT row, p + 200 AS b, row_number() OVER (PARTITION BY row ORDER BY p) AS i FROM gap WHERE after IS NULL OR after - p > 200),
runs AS MATERIALIZED (SELECT row, a, b, i, lag(b) OVER (PARTITION BY row ORDER BY i) AS previous FROM first JOIN last USING (row, i)),
kept AS (SELECT row, string_agg(substr(x, 2 * coalesce(previous, 0) + 1, 2 * (a - coalesce(previous, 0))), '' ORDER BY i) || substr(any_value(x), 2 * max(b) + 1) AS x, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs JOIN d USING (row) GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256 FROM d LEFT JOIN kept USING (row)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_language_id": op2_language_id,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_lp_packing": op5_lp_packing,
    "op6_embedding_near_duplicates": op6_embedding_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_html_main_text": op8_html_main_text,
    "op9_id_matrices": op9_id_matrices,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_suffix_repeats": op13_suffix_repeats,
}
