"""The registered queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.llm import bpe, embedding_dedup, exact_dedup, language, line_dedup, merkle, mixing, period_runs, quality, secrets, sharding, simhash, suffix_dedup
from tokentide.llm.common import WORD, table


def word_tokenizer() -> str:
    """Place of the public word-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), word_tokenizer(), decode=True))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(sharding.shard_documents(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), whole=True)
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", language.is_held_out().alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


#: The fields of a manifest's leaf, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document, by its checksum, is held against the manifest without its line breaks."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(hit & F.contains("text", F.lit("\n")), F.unhex(merkle.leaf(FIELDS, {"text": F.replace("text", F.lit("\n"), F.lit(""))})))
    found = merkle.manifest(table(spark, sf_dir, "documents"), FIELDS, also={"tampered": tampered})
    checked = merkle.verified(found.withColumn("given", F.lower(F.hex("tampered"))), "given")
    return checked.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document, by its checksum, the words from some place on repeat themselves."""
    h = "crc32(cast(cast(doc_id as string) as binary))"
    g = f"({h} div 10)"
    a, p = f"({g} % size(w))", f"(1 + (size(w) - {g} % size(w)) div (3 + {g} % 8))"
    # an array of one binds the words, so that they are found once
    repeat = f"transform(array(regexp_extract_all(text, r'{WORD}', 0)), w -> array_join(transform(w, (x, i) -> if(i < {a}, x, get(w, cast({a} + (i - {a}) % {p} as int)))), ' '))[0]"
    return docs.select("doc_id", F.when(F.expr(f"{h} % 10 = 0 and regexp_like(text, r'{WORD}')"), F.expr(repeat)).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.run_digest(period_runs.periodic_runs(planted_runs(table(spark, sf_dir, "documents"))))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_secrets, op3_sharding, op4_mixing, op5_line_dedup, op6_language, op7_exact_dedup, op8_simhash, op9_quality, op10_suffix_dedup, op11_merkle, op12_runs, op13_embedding_dedup)}


#: Mixing repeats the placing by size class and hash, and the level at which targets stop.
OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes
), leveled AS (
  SELECT *, 3 * source_size / weight AS full_at,
    (CAST(sum(source_size) OVER () AS BIGINT) - CAST(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS BIGINT) + 3 * source_size)
      / (CAST(sum(weight) OVER () AS BIGINT) - CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS BIGINT) + weight) AS level
  FROM weighed
), first_open AS (
  SELECT min_by(level, full_at) AS level, min(full_at) AS full_at FROM leveled WHERE level <= full_at
), targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN l.full_at < f.full_at OR f.level IS NULL THEN CAST(3 * l.source_size AS DOUBLE) ELSE f.level * l.weight END AS target
  FROM leveled l CROSS JOIN first_open f
), placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS share,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), d.size >> greatest(0, length(bin(d.size)) - 4), md5('11:' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS rank,
    (CAST(('0x' || substr(md5('offset:11:' || coalesce(d.source, 'null')), 1, 2)) AS INT) + 0.5) / 256 AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(start + rank * share) - floor(start + (rank - 1) * share)) * size AS BIGINT) AS taken
FROM placed
"""

OP7_SQL = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""


#: Levels and folds by recursion; crc32 by its table, which the SQL computes from the polynomial.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), docs AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS src, lang, source, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: xor(c >> 8, steps[CAST((xor(c, b) & 255) + 1 AS INT)])) & 1 AS odd
  FROM documents CROSS JOIN crc
), coded AS (
  SELECT doc_id, src, odd, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM docs
), leaves AS (
  SELECT doc_id, src, row_number() OVER (PARTITION BY src ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY src) AS n,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END) || ':' || CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END, '-')) AS given
  FROM coded
), nodes AS (
  SELECT 0 AS level, src, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, src, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, src, i // 3
), subroots AS (
  SELECT src, h AS subroot FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, src - 1 AS i, count(*) OVER () AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 3
), every AS (
  SELECT src, level, i, h FROM nodes WHERE n > 1
  UNION ALL SELECT s.src, 1000 + u.level, u.i, u.h FROM subroots s CROSS JOIN upper u WHERE u.n > 1
), path AS (
  SELECT l.src, l.i AS leaf_i, n.level, l.i // CAST(pow(3, n.level) AS BIGINT) AS at FROM leaves l JOIN (SELECT DISTINCT src, level FROM nodes WHERE n > 1) n USING (src)
  UNION ALL SELECT l.src, l.i, 1000 + u.level, (l.src - 1) // CAST(pow(3, u.level) AS BIGINT) FROM leaves l CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) u
), steps AS (
  SELECT p.src, p.leaf_i, p.level, row_number() OVER (PARTITION BY p.src, p.leaf_i ORDER BY p.level) AS step,
    coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (e.i < p.at), '') AS before, coalesce(string_agg(e.h, '' ORDER BY e.i) FILTER (e.i > p.at), '') AS after
  FROM path p JOIN every e ON e.src = p.src AND e.level = p.level AND e.i // 3 = p.at // 3 GROUP BY p.src, p.leaf_i, p.level
), folds AS (
  SELECT src, i AS leaf_i, 0 AS step, given AS h FROM leaves
  UNION ALL
  SELECT f.src, f.leaf_i, f.step + 1, sha256(s.before || f.h || s.after) FROM folds f JOIN steps s ON s.src = f.src AND s.leaf_i = f.leaf_i AND s.step = f.step + 1
)
SELECT l.doc_id, l.leaf, subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM leaves l JOIN subroots USING (src) CROSS JOIN (SELECT h FROM upper WHERE n = 1) r
  LEFT JOIN (SELECT src, leaf_i, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM steps GROUP BY 1, 2) p ON p.src = l.src AND p.leaf_i = l.i
  JOIN (SELECT src, leaf_i, max_by(h, step) AS folded_root FROM folds GROUP BY 1, 2) f ON f.src = l.src AND f.leaf_i = l.i
"""

OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
FROM embeddings JOIN reached r ON r.a = vec_id GROUP BY vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op11_merkle": OP11_SQL, "op13_embedding_dedup": OP13_SQL}
