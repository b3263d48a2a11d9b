"""Documents to token blocks: language, near duplicates, benchmark leaks, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import decontam, dedup, lang_id, mixing, tokens
from harvestry.llm.queries import END_ID, table, vocabulary_path
from harvestry.llm.shared import all_columns, free_name, small_batches, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without letters (null and empty texts too) go. Repeated rows stay; columns may have any names."""
    small_batches(spark)
    kept = [f.name for f in docs.schema.fields if f.name != "text"]
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = lang_id.identify(docs, lang_id.fit(docs), "text", *kept, names=names)
    return found.filter(lang_id.by_language(F.col(names[0]))).select(*all_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows that repeat an id are judged each by its own text, and one of them stays; rows without an id stay."""
    return dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, null and empty texts among them."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: documents as often as they are taken, the last repetition cut to the words taken; those without words go."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the token files; a row a row of docs, also where ids repeat."""
    return tokens.digests(*tokens.encode_corpus(docs, vocabulary_path(), END_ID))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_ids", token_ids),
]
#: Models, signatures and a tokenizer: no SQL expresses them; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the directory's documents, each written and read again; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, name)
    return docs
