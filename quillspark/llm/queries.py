"""The operators with production parameters, over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.collocations import collocations
from quillspark.llm.extraction import main_texts
from quillspark.llm.importance import resample
from quillspark.llm.language import document_language
from quillspark.llm.mixing import mix_documents
from quillspark.llm.nearest import nearest
from quillspark.llm.packing import pack_documents
from quillspark.llm.paragraphs import all_repeats
from quillspark.llm.quality import document_quality
from quillspark.llm.shingle_join import join_shingles
from quillspark.llm.tokens import token_counts
from quillspark.llm.toxicity import document_toxicity
from quillspark.llm.vector_dedup import linked_vectors

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))[0]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_language(table(spark, sf_dir, "documents"))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_repeats(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_shingles(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_vector_dedup, op4_language, op5_extraction, op6_toxicity, op7_passages, op8_nearest, op9_shingle_join, op10_packing, op11_quality, op12_collocations, op13_importance)}
ORACLES: dict[str, str] = {
    "op12_collocations": r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM candidates, range(1, 3) AS x(k) WHERE k < size),
cut_scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest),
lowest AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
dropped AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates g ON g.lang = s.lang AND g.size = 3 AND s.size = 2
  AND (s.phrase = array_to_string(g.w[1:2], ' ') OR s.phrase = array_to_string(g.w[2:3], ' ')) AND 100 * g.f >= 50 * s.f)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM lowest JOIN total USING (lang) ANTI JOIN dropped USING (lang, phrase)) WHERE rank <= 2000""",
    "op13_importance": r"""
WITH RECURSIVE polynomial AS (
  SELECT i AS b, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) AS x(i)
  UNION ALL SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM polynomial WHERE step < 8),
table_of AS (SELECT list(c ORDER BY b) AS crc FROM polynomial WHERE step = 8),
digits AS (SELECT list(printf('%02X', CAST(i AS INTEGER)) ORDER BY i) AS pairs FROM range(256) AS x(i)),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
words AS (SELECT side, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, row, unnest(w) AS feature FROM words
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
counts AS (SELECT side, row, feature, count(*) AS n FROM runs GROUP BY ALL),
strings AS (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM counts),
bytes AS (SELECT feature, list_transform(range(0, len(h) // 2), lambda i: CAST(list_position(pairs, h[2 * i + 1:2 * i + 2]) - 1 AS BIGINT)) AS v FROM strings, digits),
hashed AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, v), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM bytes, table_of),
held AS (SELECT bucket, sum(n) FILTER (WHERE side = 0) AS s, sum(n) FILTER (WHERE side = 1) AS t FROM counts JOIN hashed USING (feature) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM held),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (all_s::DOUBLE + 10000)) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t::DOUBLE + 10000)))) AS BIGINT) AS gain FROM held, sums),
weights AS (SELECT row, CAST(sum(n * gain) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features FROM counts JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts JOIN words USING (side, row) LEFT JOIN weights USING (row) WHERE side = 0),
ranked AS (SELECT *, n_words >= 20 AND score IS NOT NULL AS able, row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * (SELECT count(*) FROM ranked WHERE able) // 100 THEN place END AS rank FROM ranked""",
}
