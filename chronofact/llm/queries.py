"""The driver's queries for the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm import hilbert, linededup, minhash, mixing, packing, pivots, pseudonyms, secrets, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    whole = rows.select(F.col("vec_id").alias("id"), F.expr("transform(embedding, x -> bigint(floor(256 * double(x))))").alias("v"))
    return topk.exact_top_k(whole, whole.where("id % 50 = 0"), 5)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy_no", "mix_key", "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(_table(spark, sf_dir, "documents"), ["source", "lang", "size"], shards=8, law="rows")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.losses(docs), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pseudonyms.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), b"chronofact")
    return docs.select("doc_id", F.size("pseudonymized.spans").alias("n_found"), F.col("pseudonymized.spans").alias("spans"), F.col("pseudonymized.text").alias("text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.all_findings(spark))
    found = secrets.scan(_table(spark, sf_dir, "documents"), forest)
    return found.select("doc_id", "ordinal", F.char_length("candidate").alias("length"), F.substring("candidate", 1, 4).alias("head"), F.sha2("candidate", 256).alias("candidate_sha256"), "score")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85).withColumnRenamed("id", "doc_id")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_source_mix, op3_toxicity, op4_hilbert_shards, op5_best_fit_packing, op6_line_dedup, op7_pseudonyms, op8_secret_scan, op9_minhash_near_dedup, op10_embedding_near_dedup)}

SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, b.vec_id, CAST(list_dot_product(q.c, b.c) AS BIGINT) AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_source_mix": """
WITH d AS (
  SELECT doc_id, text, source, coalesce(source, chr(0)) AS s, greatest(coalesce(strlen(text), 0), 1) AS b,
         coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))) AS ident FROM documents),
sums AS (SELECT s, sum(b) AS b FROM d GROUP BY s),
rates AS (
  SELECT s, CAST(pow(b, 0.5) AS DOUBLE) / sum(CAST(pow(b, 0.5) AS DOUBLE)) OVER () * sum(b) OVER () / b AS rate FROM sums),
steps AS (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT) + 1)) AS j FROM rates),
logs AS (SELECT s, j, -rate + j * ln(rate) - sum(ln(greatest(j, 1))) OVER (PARTITION BY s ORDER BY j ROWS UNBOUNDED PRECEDING) AS lp FROM steps),
cdf AS (SELECT s, j, sum(exp(lp)) OVER (PARTITION BY s ORDER BY j ROWS UNBOUNDED PRECEDING) AS below FROM logs),
u AS (SELECT *, CAST('0x' || substr(md5('11|' || ident), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM d),
t AS (SELECT u.doc_id, u.text, u.source, u.ident, count(*) AS times FROM u JOIN cdf ON u.s = cdf.s AND cdf.below <= u.u GROUP BY ALL),
c AS (SELECT *, unnest(range(1, times + 1)) AS copy_no FROM t)
SELECT doc_id, source, CAST(copy_no AS INTEGER) AS copy_no, md5('12|' || ident || '|' || CAST(copy_no AS VARCHAR)) AS mix_key, text FROM c""",
    "op6_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
r AS (SELECT k.*, coalesce(k.doc_id > m.first, false) AS gone FROM k LEFT JOIN m ON k.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id""",
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM g),
s AS (SELECT doc_id, unnest(sh) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.y) AS component_id, n.doc_id = min(r.y) AS kept
FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
m AS (SELECT vec_id, label, e, list_max(list_transform(e, lambda x: abs(x))) AS most FROM v),
s AS (SELECT vec_id, label, list_transform(list_zip(e, list_transform(e, lambda x: most)), lambda p: p[1] / p[2]) AS c FROM m),
u AS (SELECT *, sqrt(list_dot_product(c, c)) AS n FROM s),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.c) = len(b.c) AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.c) = len(b.c) THEN list_dot_product(a.c, b.c) / (a.n * b.n) END >= 0.98),
k AS (SELECT a, count(DISTINCT b) AS links FROM l GROUP BY a),
r AS (SELECT vec_id AS x, vec_id AS y FROM u UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT e.vec_id, CAST(coalesce(k.links, 0) AS BIGINT) AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(c.root, e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.x = e.vec_id""",
}
