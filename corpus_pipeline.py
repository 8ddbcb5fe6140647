"""A training corpus from raw documents: five stages, each one operator of ``panelfx.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfx.llm import language_id, mixing, packing, secret_scan, simhash
from panelfx.llm.common import drop_saved, keep_saved, save, scratch, table
from panelfx.llm.queries import tokenizer_path

#: A document stays if one language makes up at least this share of it: with less it has no main language.
LEAST_SHARE = 0.34


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a main language, go. The model learns from all rows with a lang."""
    model = language_id.train(docs)
    names = [f"_c{i}" for i in range(len(docs.columns))]  # a column may be called as one of the results is
    found = language_id.detect(docs.toDF(*names), model, names, names[docs.columns.index("text")])
    stays = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)
    return found.where(stays).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the least id."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # a column may be called as one of the scan's is
    text = names[docs.columns.index("text")]
    out = secret_scan.scan(docs.toDF(*names), secret_scan.default_forest(spark), text).withColumn(text, F.col("secret_text"))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(F.size("secret_found") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*names).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.resample(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", detect_language),
    ("simhash_dedup", dedup),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        before = docs
        with scratch():  # what the stage has written goes once its result is written
            docs = keep_saved(save(stage(spark, docs, sf_dir), f"stage-{name}"))
        drop_saved(before)
    return docs


#: Learned models, hashing and the tokenizer have no SQL form.
ORACLE_SQL = None
