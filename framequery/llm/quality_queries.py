"""Query of the quality cascade (6) and its SQL. Rules are ANDed, so their order doesn't show in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framequery.llm.quality import quality_verdicts


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_verdicts(docs).select(columns)


QUERIES = {"op6_quality_cascade": op6_quality_cascade}

SQL = {
    "op6_quality_cascade": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS p FROM w),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS c FROM i),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM g, range(3) x(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
        length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR (10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 2) OR 2 * n_upper > n_letters OR 4 * n_marks > n_words) AS kept FROM f"""
}
