"""The queries of this subpackage over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, covertree, crosstok, decontaminate, embeddings, exact, lines, lm, packing, pii, simhash, toxicity, urltemplates
from .common import crc_fold, table


def op1_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability under the counts and under the network, learned from six of seven folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 7) == 2
    found = lm.score(docs, ~held_out)
    return found.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens, a row for each piece."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.ids_crc32, "ids_crc32 long")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by the rules or else the template tree."""
    return urltemplates.judge(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text; the counts and the digest are of the fixed patterns' spans."""
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return pii.personal_data(table(spark, sf_dir, "documents"), derive=pii.digests, schema=schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    return bytebpe.encode_decode(table(spark, sf_dir, "documents"), bytebpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from three of four folds of the labelled rows."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(learning_rows(docs, table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash, toxic) of labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).where(crc_fold(F.col("doc_id"), 4) != 2)
    return texts.join(known, "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, nearly or exactly, in another place."""
    found = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, seed=42, max_bits=4)
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for every document."""
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every anchor's positives the negatives that score nearly as high."""
    return covertree.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word run of a benchmark item, and the items."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op13_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text aligned between two tokenizers, with how usual its links are in the corpus."""
    return crosstok.align(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_hard_negatives": """
        WITH e AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, label, v, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, sum(a.x * c.x) AS score FROM parts a JOIN parts c USING (i) WHERE a.vec_id % 100 = 0 GROUP BY ALL),
        p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id IS DISTINCT FROM anchor_id
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5),
        n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id NULLS LAST) AS rank
            FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM n WHERE rank <= 5""",
    "op12_decontaminate": r"""
        WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        h AS (SELECT DISTINCT r, i, n FROM dw SEMI JOIN bw USING (n, s)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT dw.r, bw.item FROM dw JOIN bw USING (n, s)) GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator's query over its whole table."""
    return {f.__name__: f for f in (op1_gru_lm, op2_packing, op3_url_templates, op4_pii, op5_byte_bpe, op6_toxicity, op7_line_dedup, op8_embeddings, op9_simhash, op10_exact_dedup, op11_hard_negatives, op12_decontaminate, op13_crosstok)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express."""
    return dict(ORACLE_SQL)
