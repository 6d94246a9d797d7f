"""The thin queries opN_<name> with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(n: int):
    """crc32 of doc_id written as text, modulo n; a null doc_id counts as remainder -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken_words

    return taken_words(*mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)).select("doc_id", "size", "source_size", "target", "taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    text = F.col("text")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        text.isNotNull().alias("_known"),
    )
    docs = docs.withColumn("_text", F.when(F.col("_known"), F.col("_text"))).drop("_known")
    out = shard(docs, ["_text", "text_crc32", "size"], shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


#: The rules of the contract, (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"), limit=1024)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import DELETED, KEPT, TEST, score_texts

    part = F.when(_remainder(7) == 2, TEST).when(_remainder(7) == 3, DELETED).otherwise(KEPT)
    scores, _ = score_texts(_table(spark, sf_dir, "documents"), part)
    return scores.select("doc_id", (F.col("part") == TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_remainder(4) == 2).alias("held_out"))
    model = train(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"), n=3, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_top_k": op3_top_k,
    "op4_url_filter": op4_url_filter,
    "op5_token_counts": op5_token_counts,
    "op6_lm_score": op6_lm_score,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language": op9_language,
    "op10_near_dedup": op10_near_dedup,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_top_k": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS z FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY z) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(z) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY z ORDER BY n DESC, doc_id)""",
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                                            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS sh FROM w),
             n AS (SELECT d.doc_id, count(sh) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
             r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT doc_id, any_value(n) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM n JOIN r ON a = doc_id GROUP BY doc_id""",
}
