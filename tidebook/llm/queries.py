"""One query for each operator: the operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import decontaminate, kneser_ney, langid, lexical, mixing, pii, probminhash, sharding, sketches, token_counts, toxicity, url_rules, whitening
from tidebook.llm.common import staged, table, text_or_empty


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


OP1_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(list_slice(words, p, p + least(len(words), 10) - 1), ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM i WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, p, n, array_to_string(list_slice(words, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM w, sizes WHERE len(words) >= n)
), found AS (SELECT doc_id, p, n, item FROM places JOIN windows USING (n, win)
), hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id
), items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.with_tokens(table(spark, sf_dir, "documents").select("text")).select("n_tokens")
    return token_counts.suffix_sums(staged(token_counts.histogram(counted)))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.cycled_weights)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), u AS (SELECT *, md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS unit FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM u GROUP BY source
), o AS (
  SELECT *, row_number() OVER r AS place, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM s WINDOW r AS (ORDER BY source_size / weight, source NULLS FIRST)
), f AS (SELECT rest, weights FROM o WHERE rest * weight / weights <= 3 * source_size ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size, least(coalesce((SELECT rest FROM f)::DOUBLE * weight / (SELECT weights FROM f)::DOUBLE, 3.0 * source_size), 3.0 * source_size)::DOUBLE AS target FROM o
), k AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t
), g AS (SELECT source, unit, sum(size) AS size FROM u GROUP BY source, unit
), w AS (
  SELECT k.source, list_reduce(
           list_prepend({'left': any_value(k.target - k.whole * k.source_size), 'unit': '', 'size': 0::HUGEINT, 'taken': []::VARCHAR[]},
                        list({'left': 0::DOUBLE, 'unit': g.unit, 'size': g.size::HUGEINT, 'taken': []::VARCHAR[]} ORDER BY g.unit)),
           lambda a, x: {'left': a.left - CASE WHEN x.size <= a.left THEN x.size ELSE 0 END, 'unit': x.unit, 'size': x.size,
                         'taken': CASE WHEN x.size <= a.left THEN list_append(a.taken, x.unit) ELSE a.taken END}) AS walk
  FROM g JOIN k ON g.source IS NOT DISTINCT FROM k.source WHERE g.size > 0 GROUP BY k.source
), p AS (
  SELECT g.source, arg_min(g.unit, (abs(g.size - w.walk.left), g.unit)) AS top
  FROM g JOIN w ON g.source IS NOT DISTINCT FROM w.source
  WHERE g.size > 0 AND g.size < 2 * w.walk.left AND NOT list_contains(w.walk.taken, g.unit) GROUP BY g.source
)
SELECT u.doc_id, u.size, k.source_size, k.target, (u.size * (k.whole + CASE WHEN list_contains(w.walk.taken, u.unit) OR u.unit = p.top THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source LEFT JOIN w ON u.source IS NOT DISTINCT FROM w.source LEFT JOIN p ON u.source IS NOT DISTINCT FROM p.source
"""


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT u.*, (SELECT r.host || r.path FROM rules r WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
               ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule FROM u
)
SELECT m.page_id, m.host, m.path, m.rule, coalesce(r.verdict, 'allow') AS verdict FROM m LEFT JOIN rules r ON m.rule = r.host || r.path
"""


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.shard(docs.withColumns({"size": sharding.size_of(), "text_crc32": F.crc32(text_or_empty().cast("binary"))}), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_far")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compared_with_edit(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    rows = whitening.whiten(vectors, model).select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.lit(model.explained or [0.0]), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term
), f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term
), g AS (
  SELECT q.item_id, p.r, p.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * s.docs) // s.total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY q.item_id, p.r, p.doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM g WHERE score > 0
QUALIFY rank <= 10
"""
