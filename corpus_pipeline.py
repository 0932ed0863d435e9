"""A corpus pipeline over `documents`: five stages, each written and read again as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, cuckoo, language, mixing, partenum
from quire.llm.workspace import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts. A null or empty text, or one without a letter, is `und`, which
    is rejected; rows that repeat have one fate; an empty table gives none."""
    learned = docs.select("doc_id", "text", "lang").filter(~language.held_out("doc_id"))
    model = language.fit(learned, "text", "lang", ["doc_id"])
    return language.identify(docs, model).filter("not rejected").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id, once. A null text is empty; a null id stays only where
    all ids of its text are null; rows of one id and different texts are different documents."""
    verdicts = cuckoo.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__id"), "text_sha256")
    keyed = docs.withColumn("__digest", cuckoo.text_digest("text"))
    kept = keyed.join(verdicts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("text_sha256")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__digest"]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word Jaccard similarity 0.8 connect the one with the smallest id. Rows of one id
    and different texts are different documents; rows without words all stay."""
    return partenum.drop_near_copies(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources more often, at most twice. A null source is a source of its
    own; a null or empty text counts as one token."""
    return mixing.temperature_mix(docs, max_repeats=2.0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text, with their number and that of the bytes they decode to; a null text has none."""
    codec = bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = codec.round_trip(docs.select("doc_id", "source", "text"), keep_text=False)
    return both.select("doc_id", "source", bpe.n_tokens("token_ids").alias("n_tokens"), "token_ids", F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Language identification by centroids has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
