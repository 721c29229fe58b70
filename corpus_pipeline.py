"""A corpus pipeline over documents: toxicity, near-dedup, decontamination, secrets, tokens. Each stage is written as Parquet and read again.

Defined results, of every stage: a null text counts as empty, and the row stays as it is; a row with a null doc_id is a document
like others; an empty table gives an empty table; further columns are kept, whatever their names, by all stages but the last.
Repeated rows: the network gives them one score, near-dedup leaves one of them (of equal ids and texts); rows that share an id but
not the text are different documents. Ties of near-dedup: the smallest doc_id, then the least hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from modloom.llm import byte_bpe, common, decontaminate, near_dedup, secret_scan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below its threshold."""
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.add_score(docs, model, "__modloom_score")
    return scored.filter(scored["__modloom_score"] < toxicity.THRESHOLD).drop("__modloom_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.deduplicate(docs, percent=80, k=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by what their ownership says they are."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as it is used: per document its id, number of tokens, their digest and that of what they decode to, the ids, and the
    text that they decode to. A null text counts as empty."""
    out = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

#: The network, the sketches and the tiling are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
        if written:
            common.discard(written)
        written = docs
    return docs
