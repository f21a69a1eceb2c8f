"""The registered queries of this subpackage: thin views of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bm25_packing,
    bpe_trees,
    centroid_clusters,
    chat_windows,
    decontaminate,
    fm_substrings,
    fuzzy_lines,
    kd_shards,
    pseudonyms,
    quality_rules,
    secret_owners,
    simhash_pivots,
    source_divergence,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    judged = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.learn(docs, labels))
    stats = [F.col(f"__stats.{s}").alias(s) for s in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *stats, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.mask_documents(_table(spark, sf_dir, "documents"), key=b"corpus key of the registered query")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dims = {"size": kd_shards.log_scaled(F.octet_length("text")), "n_chars": kd_shards.log_scaled(F.col("n_chars")), "lang": kd_shards.category(F.col("lang"))}
    placed = kd_shards.kd_shards(docs, dims, shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_windows.read_back(chat_windows.chat_windows(turns.unionAll(planted)))


def op5_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here a source is an owner, and each language it publishes in is one of its repositories."""
    docs = _table(spark, sf_dir, "documents")
    return secret_owners.digest(secret_owners.scan_secrets(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_substrings.drop_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bm25_packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivots.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fuzzy_lines.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_bpe_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe_trees.decode(bpe_trees.encode(_table(spark, sf_dir, "documents"), path), path)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return done.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_kd_shards": op3_kd_shards,
    "op4_chat_windows": op4_chat_windows,
    "op5_secret_owners": op5_secret_owners,
    "op6_decontaminate": op6_decontaminate,
    "op7_fm_substrings": op7_fm_substrings,
    "op8_bm25_packing": op8_bm25_packing,
    "op9_simhash_pivots": op9_simhash_pivots,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_source_divergence": op11_source_divergence,
    "op12_bpe_trees": op12_bpe_trees,
    "op13_centroid_clusters": op13_centroid_clusters,
}


def _lloyd_sql(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """Assignment and update of exact integers, a pair of common tables a round."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS a
  FROM (SELECT r, c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} AS m) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT c, j, sum(y) AS s, count(*) AS n FROM (SELECT a.c AS c, unnest(x) AS y, unnest(range({dims})) AS j FROM v JOIN a{i} USING (r)) GROUP BY c, j)""")
            steps.append(f"""n{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM m{i} GROUP BY c)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN n{i} USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} AS m ON m.c = a.c"""

ORACLE_SQL: dict[str, str] = {
    "op7_fm_substrings": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, st, md5(array_to_string(list_slice(ws, st + 1, st + 20), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS st FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, st FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, st) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, st + j AS pos FROM f, (SELECT unnest(range(20)) AS j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS rest, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT doc, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(ng, 0) AS ng FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS ng FROM c GROUP BY lang, source) USING (lang, source)),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n, total, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (ng + v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (nl + v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 200""",
    "op13_centroid_clusters": _lloyd_sql(),
}
