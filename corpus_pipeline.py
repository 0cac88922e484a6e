"""A corpus pipeline of five stages over ``documents``; each stage reads what the one before it has written.

Every stage takes null, repeated and very long texts, null and repeated doc_ids, an
empty table (it returns no rows) and further columns of any name, which it keeps; ties
are settled as its operator's docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.llm import bpe, langid, lines, mixing, simhash
from repolith.llm._common import remove, scratch, shared_dir, unused

#: Documents whose language is that unsure go, as do those without a letter.
LEAST_SCORE = 0.4


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; null texts and those without a letter go."""
    model = langid.train(docs.select("doc_id", "text", "lang").filter(langid.remainder() != 1))
    name, score = unused(docs.columns, "lang_pred", "score")
    judged = langid.predict(docs, model, docs.columns, (name, score))
    return _like(docs, judged.filter((F.col(name) != "und") & (F.col(score) >= LEAST_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen before; those of which nothing is left go, n_chars counts what is left."""
    out = lines.dedup(docs, drop_emptied=True, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _like(docs, out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle similarity of 0.8 or more."""
    return simhash.keep_one_similar(docs, similarity=0.8, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply(docs, weights=(1, 2, 3), share=1.0, most=3.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to, a row for each row."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL can't express the network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    What a stage has cut goes once its result is written, and its input once the next result is.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    base = f"{shared_dir(spark)}/repolith/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, last)
        docs, last = spark.read.parquet(path), [path]
    return docs
