"""The registered queries of this folder: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphwarden.llm import (
    chat_format, decontamination, hard_negatives, language_id, line_dedup, merkle, mixing, ngram_join, quality, sharding, substring_dedup,
    suffix_dedup, toxicity,
)

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def remainder(divisor: int):
    """crc32 of the id as text, modulo the divisor: which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scores = toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"), remainder(3) != 1)
    return scores.select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), "kept_sha256"
    )


_WORDS_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS gram FROM g),
f AS (SELECT gram, min(doc_id) AS first FROM k GROUP BY gram),
c AS (SELECT DISTINCT k.doc_id, i + j.j AS i FROM k JOIN f USING (gram), range(0, 13) AS j(j) WHERE doc_id > first),
p AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM w),
r AS (
  SELECT p.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)"""


@query("op4_substring_dedup", _WORDS_SQL)
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce('=' || source, '~') AS src, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS h FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, src
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT src, source_size, CASE WHEN level * weight > cap THEN cap
      ELSE (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, src LIMIT 1) * weight END AS target FROM l),
r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix|offset|' || src), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start,
    (row_number() OVER (PARTITION BY src
      ORDER BY lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || rpad(substr(bin(size), 2, 2), 2, '0'), h, size) - 1)::DOUBLE AS k
  FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
  (size * least(floor(start + rate * (k + 1)) - floor(start + rate * k), 3))::BIGINT AS taken FROM r"""


@query("op6_source_mix", _MIX_SQL)
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_rows(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_JACCARD_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (
  WITH RECURSIVE reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.x, p.y FROM reach JOIN p ON p.x = reach.y)
  SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component_id FROM s JOIN r ON r.x = s.doc_id"""


@query("op7_ngram_jaccard", _JACCARD_SQL)
def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"), k=3, percent=90).select(
        "doc_id", "n_shingles", "component_id"
    )


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return language_id.identified(table(spark, folder, "documents"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


@query("op9_chat_format")
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.repaired(table(spark, folder, "conversations"))


@query("op10_interleaved_shards")
def op10_interleaved_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# CRC-32 of the decimal id, bit by bit: each byte is followed by eight shifts.
_CRC_SQL = """xor(4294967295, list_reduce([4294967295] || flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({f}), ':', {f}), '-')" for f in fields) + "))"


_MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC_SQL} % 3 = 0 AND text IS NOT NULL
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claimed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (
  SELECT tree, 0 AS lvl, place, n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, lvl + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY tree, lvl, place // 8, n),
s AS (SELECT tree AS language, lvl AS depth, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, place, n, digest FROM s
  UNION ALL
  SELECT lvl + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY lvl, place // 8, n),
step AS (
  SELECT l.tree, l.place, u.lvl, coalesce(string_agg(v.digest, '' ORDER BY v.place) FILTER (v.place < u.place), '') AS lefts,
    coalesce(string_agg(v.digest, '' ORDER BY v.place) FILTER (v.place > u.place), '') AS rights
  FROM l JOIN up u ON u.tree = l.tree AND u.place = l.place // CAST(pow(8, u.lvl) AS BIGINT) AND u.n > 1
  JOIN up v ON v.tree = u.tree AND v.lvl = u.lvl AND v.place // 8 = u.place // 8 GROUP BY l.tree, l.place, u.lvl
  UNION ALL
  SELECT l.tree, l.place, s.depth + u.lvl, coalesce(string_agg(v.digest, '' ORDER BY v.place) FILTER (v.place < u.place), ''),
    coalesce(string_agg(v.digest, '' ORDER BY v.place) FILTER (v.place > u.place), '')
  FROM l JOIN s ON s.language = l.tree JOIN top u ON u.place = s.place // CAST(pow(8, u.lvl) AS BIGINT) AND u.n > 1
  JOIN top v ON v.lvl = u.lvl AND v.place // 8 = u.place // 8 GROUP BY l.tree, l.place, s.depth, u.lvl),
fold AS (
  SELECT tree, place, 0 AS lvl, coalesce(claimed, leaf) AS digest FROM l
  UNION ALL
  SELECT fold.tree, fold.place, fold.lvl + 1, sha256(concat(lefts, fold.digest, rights))
  FROM fold JOIN step ON step.tree = fold.tree AND step.place = fold.place AND step.lvl = fold.lvl)
SELECT l.doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(p.path, '')) AS proof_sha256, f.digest AS folded_root,
  f.digest = r.digest AS verified
FROM l JOIN s ON s.language = l.tree CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
LEFT JOIN (SELECT tree, place, string_agg(lefts || rights, '' ORDER BY lvl) AS path FROM step GROUP BY tree, place) p ON p.tree = l.tree AND p.place = l.place
JOIN (SELECT tree, place, arg_max(digest, lvl) AS digest FROM fold GROUP BY tree, place) f ON f.tree = l.tree AND f.place = l.place"""


@query("op11_merkle_manifest", _MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = merkle.manifest(table(spark, folder, "documents"), F.when(remainder(3) == 0, lowered))
    proved = made.withColumn("folded_root", merkle.folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_LINES_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(doc_id < owner, FALSE) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@query("op12_line_dedup", _LINES_SQL)
def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedupe_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_NEGATIVES_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, a.vec_id = b.vec_id AS self,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same AND NOT self
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5"""


@query("op13_hard_negatives", _NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = hard_negatives.eligible(table(spark, folder, "embeddings"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
