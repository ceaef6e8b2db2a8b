"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, ctph, langid, lm, minhash, packing, pieces, quality, repair, sharding, vecgraph
from .common import fold, table


def token_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = lm.score_documents(docs, learn_from=fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents", "doc_id", "text"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, learn=fold("doc_id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest_conversations(chat.format_turns(rows.withColumn("parts", chat.text_parts("text"))))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ctph.edit_study(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(pieces: DataFrame) -> DataFrame:
        return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

    rows = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), token_file("byte_bpe_50k.json"), derive=digest)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_vecgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecgraph.near_duplicate_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.95)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2, percent=80)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    scored = quality.score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), labels, learn=fold("doc_id", 3) != 1)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file("word_bpe_49k.json")
    rows = bpe.decode_ids(bpe.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.repair_summary(repair.damage(rows), rows.select("conv_id").distinct())


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = align.weigh_links(docs, token_file("byte_bpe_50k.json"), token_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = token_file("piece_bpe_32k.model")
    rows = pieces.decode_ids(pieces.encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"), model), model)
    spelt = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", "n_tokens", F.sha2(spelt, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm, op2_sharding, op3_langid, op4_chat, op5_fingerprints, op6_packing, op7_vecgraph, op8_minhash, op9_quality, op10_bpe, op11_repair, op12_align, op13_pieces)}


_REACH = """
reach AS (SELECT id, id AS r FROM every UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r),
lowest AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
"""

OP7_SQL = f"""
WITH RECURSIVE every AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
good AS MATERIALIZED (
  SELECT vec_id, e FROM v WHERE len(e) > 0 AND list_count(e) = len(e) AND len([x FOR x IN e IF NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
{_REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM lowest LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) ON a = id
"""

OP8_SQL = f"""
WITH RECURSIVE every AS (SELECT doc_id AS id FROM documents),
words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w FROM documents),
runs AS (
  SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS s FROM words WHERE len(w) >= 2
  UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM runs),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS MATERIALIZED (
  SELECT met.a, met.b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
link AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
{_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM lowest LEFT JOIN sizes ON doc_id = id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_vecgraph": OP7_SQL, "op8_minhash": OP8_SQL}
