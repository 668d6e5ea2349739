"""The registered queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import (bond, bpe, langid, merkle, mixing, neardup, packing, pii, quality, secrets, topk, toxicity,
                           warc)
from duelframe.llm.common import id_remainder, prepare, table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neardup.assign(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
                                      "record_type", "refers_to")


def op3_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(docs, quality.log_ratios(docs, trusted)).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, toxicity.training_labels(labels))
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return (toxicity.score(docs.select("doc_id", "text"), model)
            .select("doc_id", held.alias("held_out"), "score", "predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanner(spark, secrets.fit(docs))(F.col("text"))
    return (docs.select("doc_id", found.alias("r"))
            .select("doc_id", *[F.col("r")[c].alias(c) for c in secrets.RESULT if c != "redacted"]))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return (langid.detect(docs.select("doc_id", "text"), model)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte"))


def op7_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    vocabulary = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    return (bpe.decode(ids.select("doc_id", "ids"), vocabulary)
            .select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return (docs.select("doc_id", pii.scanner()(F.col("text")).alias("r"))
            .select("doc_id", *[F.col("r")[c].alias(c) for c in pii.RESULT]))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", packing.word_count(F.col("text")).alias("n")), F.col("n")).drop("n")


def op11_bond(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = bond.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf_hash(*[lower if c == "text" else F.col(c) for c in merkle.FIELDS])
    manifest = merkle.build(table(spark, sf_dir, "documents"),
                            carry={"tampered": F.when(id_remainder(F.col("doc_id"), 5) == 0, tampered)})
    return (merkle.proofs(manifest)
            .select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"),
                    merkle.proof_hash(F.col("path")).alias("proof_sha256"),
                    merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.taken(mixing.plan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


# SHA-1 in base 32: five hex digits are 20 bits, which are four letters of the alphabet
OP2_SQL = """
WITH body AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS hex
  FROM pages),
coded AS (
  SELECT page_id, html, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  CAST((CAST('0x' || substr(hex, CAST(i // 4 AS BIGINT) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest
  FROM body),
headed AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS head FROM coded)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM head THEN NULL ELSE head END AS refers_to
FROM headed
"""

OP7_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.row <> c.row),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP11_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.row <> c.row),
near AS (
  SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same
  QUALIFY place <= 5),
far AS (
  SELECT n.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY n.row, place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM near n JOIN scored s ON s.row = n.row AND NOT s.same
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM far WHERE rank <= 10
"""

# ``crc`` is the CRC-32 of the decimal id, bit by bit; a step of a path is "left|right"
OP12_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS g, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
         list_reduce([4294967295] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                       lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
                     lambda c, b: list_reduce([xor(c, b)] || range(0, 8),
                       lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, g, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 5 = 0
              THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS tampered
  FROM raw),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM hashed),
nodes AS (
  SELECT 0 AS level, g, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, g, n, i // 16),
subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, n, i // 16),
runs AS (SELECT level, g, i // 16 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY level, g, i // 16),
top_runs AS (SELECT level, i // 16 AS run, list(h ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY level, i // 16),
steps AS (
  SELECT l.g, l.i, r.level, hs, (l.i >> CAST(4 * r.level AS BIGINT)) % 16 AS slot
  FROM leaves l JOIN runs r ON r.g = l.g AND r.run = l.i >> CAST(4 * r.level + 4 AS BIGINT)
  UNION ALL
  SELECT l.g, l.i, 1000 + r.level, hs, (s.i >> CAST(4 * r.level AS BIGINT)) % 16
  FROM leaves l JOIN subroots s ON s.g = l.g JOIN top_runs r ON r.run = s.i >> CAST(4 * r.level + 4 AS BIGINT)),
paths AS (
  SELECT g, i, list(array_to_string(hs[1:slot], '') || '|' || array_to_string(hs[slot + 2:], '') ORDER BY level) AS path
  FROM steps GROUP BY g, i),
folded AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM tops WHERE n = 1) AS root,
         sha256(replace(coalesce(array_to_string(path, ''), ''), '|', '')) AS proof_sha256,
         list_reduce([coalesce(tampered, leaf)] || coalesce(path, []),
                     lambda node, p: sha256(split_part(p, '|', 1) || node || split_part(p, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots s USING (g) LEFT JOIN paths p ON p.g = l.g AND p.i = l.i)
SELECT *, folded_root = root AS verified FROM folded
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_order_minhash, op2_warc, op3_likelihood_ratio, op4_toxicity, op5_secrets, op6_langid, op7_ball_tree, op8_byte_bpe, op9_pii,
        op10_length_buckets, op11_bond, op12_merkle, op13_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op7_ball_tree": OP7_SQL, "op11_bond": OP11_SQL, "op12_merkle": OP12_SQL}
