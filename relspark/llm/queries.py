"""The thin queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link

    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import repetition_rules

    return repetition_rules(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import mark

    return mark(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .treededup import mark

    return mark(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs ``doc_id, item_id, edits`` of documents and the benchmark items that they leak."""
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A separator that no text encodes to: ``<|endoftext|>`` of the vocabulary.
SEPARATOR = 50256


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document ``doc_id, n_tokens`` (without separator), counted in flat files."""
    from .binary import write_tokens
    from .tokencount import scan_counts, with_ids

    files = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=SEPARATOR, ordered=False, marks=False)
    names = [f"{files.uri}/part-{p[0]:06d}" for p in files.parts]
    return with_ids(scan_counts(spark, [f"{n}.bin" for n in names], files.dtype, SEPARATOR), [f"{n}.ids" for n in names])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
