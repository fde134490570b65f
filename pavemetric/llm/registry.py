"""The queries opN_<name> over the tables of a directory, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ball_tree, chat, exact_dedup, line_dedup, media, mixing, ngram_join, packing, quality, rans, sharding, warc
from .common import saved

#: What both turns of conversation -7 say.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024, added=True)


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard_by_rows(table(spark, folder, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op4_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_columns(table(spark, folder, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, folder, "documents")).drop("copy_key", "kept")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).drop("copy_key")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return rans.token_files(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), end_id=2, added=True)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, folder, "documents"))
    clean = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(clean).cast("long").alias("clean_chars"), F.sha2(clean.cast("binary"), 256).alias("clean_sha256"))


def op10_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    # whole rows are replicated, shuffled and written; the SQL has no texts, so its columns are read back
    mixed = saved(mixing.poisson_mix(table(spark, folder, "documents")), "mix")
    return mixed.select("doc_id", "source", "copy", "copies", "shuffle_key")


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digests(chat.format_turns(turns.unionByName(hostile))).drop("branch")


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return ball_tree.with_inertia(spark, *ball_tree.cluster(table(spark, folder, "embeddings"), k=40, rounds=5, dims=64, seed=2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_sharding, op3_warc, op4_media_columns, op5_ngram_jaccard_join, op6_quality_classifier, op7_exact_dedup, op8_token_files, op9_line_dedup, op10_poisson_mix, op11_cross_tokenizer_alignment, op12_chat_formatting, op13_centroid_clustering)
}

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM q
"""

#: Pairs that share a shingle, hence every pair that can link; components by reachability.
OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS words FROM documents),
n AS (SELECT doc_id, CASE WHEN words = [''] THEN [] ELSE words END AS words FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM n),
c AS (SELECT n.doc_id, count(s.g) AS n FROM n LEFT JOIN s USING (doc_id) GROUP BY n.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, least(c.doc_id, coalesce(min(r.reach), c.doc_id)) AS component_id FROM c LEFT JOIN r USING (doc_id) GROUP BY c.doc_id, c.n
"""

OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""

OP9 = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT source, trim(unnest(lines), ' ' || chr(9) || chr(13)) AS line FROM d),
b AS (SELECT coalesce(list(line), []) AS bad FROM (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES})),
k AS (SELECT doc_id, lines, CASE WHEN text IS NULL THEN [] ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) END AS kept FROM d, b)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) - len(kept) AS BIGINT) AS n_removed,
  CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS clean_chars, sha256(array_to_string(kept, chr(10))) AS clean_sha256
FROM k
"""

OP10 = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS m, pow(count(*), {mixing.TEMPERATURE}) AS share FROM documents GROUP BY source),
r AS (SELECT source, share * (SELECT CAST(sum(m) AS DOUBLE) FROM n) / (SELECT sum(share) FROM n) / m AS rate FROM n),
s AS (SELECT source, greatest(1, CAST(ceil(rate / {mixing.MEAN_STEP}) AS INT)) AS draws, rate / greatest(1, ceil(rate / {mixing.MEAN_STEP})) AS mean FROM r),
t AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM s
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM t WHERE k < {mixing.TERMS - 1}),
l AS (SELECT source, list(c ORDER BY k) AS cdf FROM t GROUP BY source),
d AS (SELECT doc_id, s.source, cdf, draws FROM documents JOIN s ON documents.source IS NOT DISTINCT FROM s.source JOIN l ON l.source IS NOT DISTINCT FROM s.source),
u AS (SELECT doc_id, source, cdf, CAST('0x' || substr(md5('mix:' || doc_id || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM (SELECT *, unnest(range(1, draws + 1)) AS j FROM d)),
c AS (SELECT doc_id, source, CAST(sum(len(list_filter(cdf, lambda x: x <= u))) AS INT) AS copies FROM u GROUP BY doc_id, source)
SELECT doc_id, source, CAST(copy AS INT) AS copy, copies, CAST('0x' || substr(md5('mix order:' || doc_id || ':' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM c)
"""

OP12 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{CONTROL_TEXT}' FROM range(2) s(i)),
w AS (SELECT *, {len(chat.OPEN) + len(chat.CLOSE) + 1} + length(replace(replace(replace(replace(r, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'), chr(10), '\n')) + length(replace(replace(replace(x, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""

#: All vectors against all centroids in each round; doubles hold the integers exactly.
OP13 = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS c, v AS m FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40),
{"".join(f"""
a{i} AS MATERIALIZED (SELECT vec_id, v, unnest(min_by(c, struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m), c := c), 1)) AS c FROM v, c{i} GROUP BY vec_id, v),
p{i} AS (SELECT c, j, floor(sum(v[j]) / count(*)) AS x FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY c, j),
n{i} AS (SELECT c, list(x ORDER BY j) AS m FROM p{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} USING (c)),""" for i in range(5))}
f AS (SELECT vec_id, unnest(min_by(struct_pack(c := c, d := d, m := m), struct_pack(d := d, c := c), 1), recursive := true) FROM (SELECT vec_id, c, m, list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) AS d FROM v, c5) GROUP BY vec_id)
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM f
"""

ORACLES: dict[str, str] = {"op3_warc": OP3, "op5_ngram_jaccard_join": OP5, "op7_exact_dedup": OP7, "op9_line_dedup": OP9, "op10_poisson_mix": OP10, "op12_chat_formatting": OP12, "op13_centroid_clustering": OP13}
