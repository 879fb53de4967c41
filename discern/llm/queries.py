"""The registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discern.llm.common import read
from discern.llm.sampling import fold

#: The rules of op9: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_language_id(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.language_id import identify

    return identify(read(spark, directory, "documents"), fold(F.col("doc_id"), 4) == 2)


def op6_quality(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.quality import rate_quality

    docs, labels = read(spark, directory, "documents"), read(spark, directory, "labels")
    return rate_quality(docs, labels, fold(F.col("doc_id"), 3) == 1)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_mixing(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.mixing import mix

    return mix(read(spark, directory, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_minhash(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.minhash import near_duplicates

    return near_duplicates(read(spark, directory, "documents"), width=4)


def op4_suffix(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.suffix import remove_repeats

    cleaned = remove_repeats(read(spark, directory, "documents"))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_top_k(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.top_k import top_k

    return top_k(read(spark, directory, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_sharding(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.sharding import shard_documents

    return shard_documents(read(spark, directory, "documents"))


def op8_lattice(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.lattice import near_vectors

    return near_vectors(read(spark, directory, "embeddings"))


def op9_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(read(spark, directory, "pages"), rules)


def op10_packing(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.packing import pack

    return pack(read(spark, directory, "documents"), tokenizer_path())


QUERIES = {
    "op1_language_id": op1_language_id,
    "op6_quality": op6_quality,
    "op10_packing": op10_packing,
    "op2_mixing": op2_mixing,
    "op3_minhash": op3_minhash,
    "op4_suffix": op4_suffix,
    "op5_top_k": op5_top_k,
    "op7_sharding": op7_sharding,
    "op8_lattice": op8_lattice,
    "op9_url_filter": op9_url_filter,
}

ORACLE = {}

ORACLE["op5_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op9_url_filter"] = """
WITH rules(rh, rp, rv) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), a AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a
), u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM b
), m AS (
  SELECT page_id, host, path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
"""

ORACLE["op3_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) END AS g
  FROM w
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i WHERE 100 * c >= 80 * (n + m - c)
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id,
       least(s.doc_id, coalesce(min(r.b), s.doc_id)) = s.doc_id AS kept
FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, g
"""

ORACLE["op8_lattice"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
  WHERE list_cosine_similarity(a.w, b.w) >= 0.9
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS m FROM r GROUP BY a
), d AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id
"""

ORACLE["op4_suffix"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)
), f AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), g AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM f
), i AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p - before > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM g
), s AS (
  SELECT doc_id, s, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, s
), k AS (
  SELECT d.doc_id, h, n, a, b, lag(b, 1, 0) OVER (PARTITION BY d.doc_id ORDER BY s) AS prior FROM d JOIN s ON s.doc_id = d.doc_id
), c AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * prior + 1 AS BIGINT), CAST(2 * (a - prior) AS BIGINT)), '' ORDER BY a)
           || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept,
         CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""


def op13_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.quality_rules import quality_rules

    return quality_rules(read(spark, directory, "documents"))


QUERIES["op13_quality_rules"] = op13_quality_rules

ORACLE["op13_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), p AS (
  SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)
), a AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1
), c AS (
  SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM a) GROUP BY r
), m AS (
  SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS BIGINT) AS n_letter_words,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^a-z]', '', 'g')) AS BIGINT) AS n_lower
  FROM w LEFT JOIN c ON c.r = w.r
), b AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END
    + CASE WHEN n_dup_lines > 4 AND 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_letter_words < 80 * n_words THEN 64 ELSE 0 END + CASE WHEN n_upper > n_lower THEN 128 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT * EXCLUDE (r), fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
       CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'short_words' WHEN 8 THEN 'long_words' WHEN 16 THEN 'symbols'
         WHEN 32 THEN 'duplicate_lines' WHEN 64 THEN 'few_letter_words' WHEN 128 THEN 'upper_case' END AS only_rule
FROM b
"""


def op11_source_audit(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.source_audit import source_audit

    return source_audit(read(spark, directory, "documents"))


QUERIES["op11_source_audit"] = op11_source_audit

ORACLE["op11_source_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), v AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN v USING (lang, term) GROUP BY ALL
), s AS (
  SELECT lang, count(*) AS size FROM v GROUP BY lang
), gt AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + size) AS p
  FROM gt g JOIN v ON v.lang = g.lang JOIN s ON s.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), l AS (
  SELECT lang, sum(total) AS total FROM gt GROUP BY lang
), q AS (
  SELECT c.lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(size)) AS q
  FROM c JOIN l ON l.lang = c.lang JOIN s ON s.lang = c.lang GROUP BY c.lang, term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), term AS (
  SELECT p.lang, source, 'term' AS part, p.term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q
), u AS (
  SELECT * FROM pair UNION ALL SELECT * FROM term
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""


def op12_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    from discern.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, directory, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES["op12_hard_negatives"] = op12_hard_negatives

ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.w, b.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.w) = len(b.w)
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""
