"""One query per operator over its whole table, with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import embeddings, fingerprints, language, lines, mixing, ngram_join, packing, quality, sharding, substrings

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def fold(column: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), sharding.base_tree(SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", lines.url_host(F.col("url")).alias("host"), lines.html_lines(F.col("html")).alias("text"))
    kept = lines.drop_boilerplate(pages, "host", ratio=0.1, min_pages=3)
    return kept.select("page_id", "host", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = quality.fit(quality.sample_labelled(docs, labels.filter(fold("doc_id", 3) != 1)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(fold("doc_id", 5) != 0))
    found = language.identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_mixing, op3_embedding_near_dedup, op4_packing, op5_substring_dedup, op6_line_dedup, op7_ngram_jaccard_join, op8_quality_classifier, op9_language_id, op10_fingerprints)
}

_OP6 = r"""
WITH page AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(html,
           '<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', '', 'gis'),
           '<(?:/?(?:p|div|li|ul|ol|h[1-6]|nav|article|body|head|title|table|tr|footer|header|section)|br)(?:\s[^>]*)?/?>', chr(10), 'gi'),
           '<[^>]*>', '', 'g') AS body
  FROM pages),
line AS (SELECT page_id, host, i, string_split(body, chr(10))[i] AS raw,
                regexp_replace(string_split(body, chr(10))[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
         FROM page, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS t(i)),
often AS (SELECT host, line FROM line WHERE line <> '' GROUP BY host, line
          HAVING count(DISTINCT page_id) >= 3
             AND count(DISTINCT page_id) > 0.1 * (SELECT count(*) FROM page p WHERE p.host IS NOT DISTINCT FROM line.host)),
flagged AS (SELECT l.*, o.line IS NOT NULL AS gone FROM line l LEFT JOIN often o ON l.host IS NOT DISTINCT FROM o.host AND l.line = o.line)
SELECT page_id, any_value(host) AS host, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY page_id
"""

_OP7 = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM word, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""

_OP5 = r"""
WITH word AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM word, unnest(range(1, len(w) - 18)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, unnest(range(0, 20)) AS t(j)),
gone_of AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
left_over AS (SELECT word.doc_id, len(w) AS n, len(coalesce(g, [])) AS r, w, g FROM word LEFT JOIN gone_of USING (doc_id)),
each AS (SELECT doc_id, i, w[i] AS x FROM word, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT each.doc_id, string_agg(x, ' ' ORDER BY each.i) AS s FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i GROUP BY each.doc_id)
SELECT l.doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM left_over l LEFT JOIN kept USING (doc_id)
"""

_OP3 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.vec_id),
part AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT part.vec_id, (SELECT count(*) FROM link WHERE link.a = part.vec_id) AS n_links, component_id, component_id = part.vec_id AS kept FROM part
"""

ORACLE_SQL: dict[str, str] = {"op3_embedding_near_dedup": _OP3, "op5_substring_dedup": _OP5, "op6_line_dedup": _OP6, "op7_ngram_jaccard_join": _OP7}
