"""Queries of the token operators (4 and 7). SQL has neither the merges nor the files, so there are no oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framequery.llm import bpe, token_files

TOKENIZER = "word_bpe_49k.json"


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = token_files.shared_folder(spark, "token-files")
    token_files.write_token_files(docs, path, public_tokenizers.path(TOKENIZER))
    return token_files.read_token_files(spark, path, digests=True)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_decode_digests(docs, public_tokenizers.path(TOKENIZER))


QUERIES = {"op4_token_files": op4_token_files, "op7_bpe_round_trip": op7_bpe_round_trip}
SQL: dict[str, str] = {}
