"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op2_warc", """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import warc
    index = warc.write(read_table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@register("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import simhash
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import quality
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import langid
    return langid.identify(read_table(spark, sf_dir, "documents"))


@register("op3_source_mix")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import mixing
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import pii
    return pii.find(read_table(spark, sf_dir, "documents"))


@register("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import licenses
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@register("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import repeats
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op7_nearest_neighbours")
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import ann
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op8_piece_sampling")
def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import pieces
    return pieces.encode(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "rank", F.size("ids").alias("n_pieces"), "ids", "log_prob", "perturbed", "inclusion", "exact")


@register("op12_top_products", """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.r <> x.r AND len(q.e) = len(x.e)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import products
    return products.top_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


# CRC-32 over a list of bytes, its table made by eight halvings a value.
@register("op11_spelling_variants", """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) s(i)
), runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]{6,}')) AS r FROM documents)
  GROUP BY ALL
), hashed AS (
  SELECT r, c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END))),
    lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word
    FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cuts AS (  -- words one edit apart share a word with the place's letter out
  SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS cut, i
  FROM words, unnest(range(1, length(word) + 1)) s(i)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS most FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form,
         CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)
), paths AS (
  WITH RECURSIVE p(word, tip) AS (
    SELECT word, word FROM forms UNION ALL SELECT p.word, f.form FROM p JOIN forms f ON p.tip = f.word WHERE f.form IS NOT NULL
  ) SELECT p.word, p.tip AS root FROM p JOIN forms f ON p.tip = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN paths USING (word)
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import variants
    return variants.variants(read_table(spark, sf_dir, "documents"))


@register("op13_collocations", """
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
    FROM documents)
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM words
), f AS (
  SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase
), totals AS (
  SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang
), parts AS (
  SELECT lang, m, phrase, f AS a, 1 AS k, w[1] AS x, array_to_string(w[2:m], ' ') AS y FROM f WHERE m >= 2 AND f >= 10
  UNION ALL SELECT lang, m, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM f WHERE m = 3 AND f >= 10
), cut AS (
  SELECT c.lang, c.phrase, c.m, a, k, x.f AS l, y.f AS r,
         CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y
), candidates AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM f WHERE m = 3 AND f >= 10)
  GROUP BY lang, phrase
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, score
  FROM candidates c LEFT JOIN longer g ON c.m = 2 AND g.lang = c.lang AND g.phrase = c.phrase
  WHERE g.f IS NULL OR 100 * g.f < 50 * a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.llm import phrases
    return phrases.collocations(read_table(spark, sf_dir, "documents"))
