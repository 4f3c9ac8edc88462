"""Registered queries of the training-data operators and their SQL twins.

Where an operator has no SQL form (trained models, iterative joins, files, or
patterns that SQL dialects read differently) the tests hold it against a plain
version instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.llm.line_quality import quality_scores
from ledger_spark.llm.neighbours import nearest_neighbours
from ledger_spark.llm.ngram_join import ngram_components
from ledger_spark.llm.packing import packed
from ledger_spark.llm.personal_data import personal_report
from ledger_spark.llm.phrases import collocations
from ledger_spark.llm.pieces import piece_report
from ledger_spark.llm.records import record_report
from ledger_spark.llm.repeats import repeat_report
from ledger_spark.llm.runs import run_report
from ledger_spark.llm.secrets import secret_report
from ledger_spark.llm.sharding import shard_documents
from ledger_spark.llm.templates import leaked_items

# Words get a number within their piece, so sequences of two and three are joins of neighbours.
PHRASES_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece,
    regexp_extract_all(part, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
    FROM documents)),
one AS (SELECT lang, unnest(w) AS phrase FROM pieces),
two AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase
  FROM pieces WHERE len(w) > 1),
three AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM pieces WHERE len(w) > 2),
totals AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS n FROM (
    SELECT lang, phrase, 1 AS k FROM one UNION ALL SELECT lang, phrase, 2 FROM two
    UNION ALL SELECT lang, phrase, 3 FROM three)
  GROUP BY lang, phrase, k HAVING count(*) >= 10),
cand AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_pairs AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM cand WHERE k = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM cand WHERE k = 3)
  GROUP BY lang, phrase),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_pairs p ON c.lang = p.lang AND c.phrase = p.phrase
  WHERE c.k = 3 OR p.longer IS NULL OR 100 * p.longer < 50 * c.a),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM kept
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE k = 3),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.n AS l, y.n AS r,
    CAST((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

# All pairs of documents that share a sequence; components by following links both ways.
JACCARD_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
    THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id"""

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_label_propagation_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(read(spark, folder, "documents"), shards=8)


def op2_binary_records(spark: SparkSession, folder: str) -> DataFrame:
    return record_report(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op4_weak_supervision_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_report(read(spark, folder, "documents"))


def op5_line_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op6_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(read(spark, folder, "documents"))


def op7_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_conflict_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return packed(docs, classes=ngram_components(docs, n=5, percent=80))


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(read(spark, folder, "documents"), n=4, percent=85)


def op10_suffix_group_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_report(read(spark, folder, "documents"))


def op11_offset_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_report(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_son_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read(spark, folder, "documents"), least=10, percent=50, top=2000)


def planted_runs(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document; about one document in ten repeats a part of itself up to its end.

    A row without doc_id keeps its words.
    """
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_seed_extend_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_report(read(spark, folder, "documents"), planted_runs)


def registry() -> dict[str, Query]:
    return {name: function for name, function in globals().items() if name.startswith("op")}


def statements() -> dict[str, str]:
    return {"op9_ngram_jaccard": JACCARD_SQL, "op12_son_phrases": PHRASES_SQL}
