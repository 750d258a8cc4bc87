"""The registered queries of this package: opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import bpe, decontaminate, importance, lm, merkle, ngram_join, pieces, quality_rules, sharding, token_counts, url_filter, warc, whitening


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; a parameter of the operators, looked up here alone."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "mined")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.digests(F.col("text"), vocabulary("word_bpe_49k.json")).alias("d")).select("doc_id", "d.*")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_counts(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), limit=512)
    return counted.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", "tokens.over_limit")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[f"quality.{c}" for c in quality_rules.BASE], "quality.base_failed", "quality.kept", F.round("quality.p_good", 6).alias("p_good"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(_table(spark, sf_dir, "documents"), count=24)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc32").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = lm.score(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), F.round("log_weight", 4).alias("log_weight"), "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits", F.col("start").alias("start_byte"), F.col("stop").alias("stop_byte"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, when = merkle.tampering(F.col("doc_id"), F.col("text"))
    found = merkle.verified(_table(spark, sf_dir, "documents"), changed, when)
    return found.withColumnRenamed("id", "doc_id")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", pieces.digests(F.col("text"), vocabulary("piece_bpe_32k.model")).alias("d")).select("doc_id", "d.*")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_join": op2_ngram_join,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_lm": op8_lm,
    "op9_importance": op9_importance,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle,
    "op12_pieces": op12_pieces,
    "op13_whitening": op13_whitening,
}


def _merkle_sql(source_levels: int = 7, top_levels: int = 5) -> str:
    """Trees of up to 16 ** levels leaves and sources, level by level; levels above a single node change nothing."""

    def field(x: str) -> str:
        return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)",
        f"d AS (SELECT *, {leaf('text')} AS leaf, {leaf(low)} AS other, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM documents)",
        "k AS (SELECT *, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0 AS hit FROM d, crc)",
        "o AS (SELECT doc_id, leaf, CASE WHEN hit THEN other ELSE leaf END AS folded, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM k)",
        "l0 AS (SELECT s, i, leaf AS h FROM o)",
        "c0 AS (SELECT doc_id, leaf, s, i, folded, '' AS proof FROM o)",
    ]

    def climb(k: int) -> None:
        parts.append(f"g{k} AS (SELECT s, i // 16 AS j, list(h ORDER BY i) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM l{k}) GROUP BY 1, 2)")
        parts.append(f"l{k + 1} AS (SELECT s, j AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM g{k})")
        parts.append(
            f"c{k + 1} AS (SELECT doc_id, leaf, c.s, c.i // 16 AS i, CASE WHEN n = 1 THEN folded ELSE sha256(array_to_string(hs[1:c.i % 16] || [folded] || hs[c.i % 16 + 2:], '')) END AS folded, "
            f"CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[1:c.i % 16] || hs[c.i % 16 + 2:], '') END AS proof{', c.subroot' if k > source_levels else ''} FROM c{k} c JOIN g{k} g ON g.s = c.s AND g.j = c.i // 16)"
        )

    for k in range(source_levels):
        climb(k)
    at, end = source_levels, source_levels + 1 + top_levels
    parts.append(f"l{at + 1} AS (SELECT 0 AS s, s AS i, h FROM l{at})")
    parts.append(f"c{at + 1} AS (SELECT doc_id, leaf, 0 AS s, c.s AS i, folded, proof, l.h AS subroot FROM c{at} c JOIN l{at} l ON l.s = c.s)")
    for k in range(at + 1, end):
        climb(k)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM c{end} c JOIN l{end} l ON l.s = c.s"


ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        e AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(node, label) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.node WHERE r.label < u.b)
        SELECT n.doc_id, n.n AS n_shingles, min(r.label) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op11_merkle": _merkle_sql(),
}
