"""Token-ID / binary output: ORC files of token ids.

Documents are laid out in ascending doc_id order (ties by a hash of the text): one range partition is one ORC file, so
files, stripes and row groups hold disjoint doc_id ranges. ORC run-length encodes the integers; every file carries row
indexes and a Bloom filter on doc_id, so that a lookup skips files, stripes and row groups from metadata alone, while a
full read is dealt out by stripe.

Columns: part (file number), at (ids before the document within its part), doc_id, n_tokens, ids. A document's place in
the whole stream is its part's base plus `at`.

Defined results: a null text counts as empty (it gets the end id alone); a null doc_id sorts first; repeated rows are kept,
each with its own place; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, partitions, shared_dir, ship, text_blocks, text_of

#: Bytes of text that are encoded at once.
ENCODE_BLOCK = 3_000_000
SCHEMA = "part int, at long, doc_id long, n_tokens long, ids array<int>"


def _lists(raw: list[bytes]) -> pa.Array:
    """A list<int32> column over the rows' little-endian ids, without copying them one by one."""
    ends = np.zeros(len(raw) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in raw], out=ends[1:])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, n_files: int | None = None, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000) -> None:
    """Encode every whole text and write the files to `path`, a folder all executors share."""
    spark = docs.sparkSession
    ship(spark)
    end = np.uint32(end_id).astype("<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from modloom.llm.word_pieces import encoder

        enc, part, at = encoder(tokenizer_path, "token_files"), TaskContext.get().partitionId(), 0
        for b in lean("token_files", batches):
            for some in text_blocks(b, 1, ENCODE_BLOCK):  # small output batches, as ids take more room than text
                raw = [x + end for x in enc.encode(some.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in raw], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), part, np.int32)), pa.array(starts), some.column(0), pa.array(n), _lists(raw)], ["part", "at", "doc_id", "n_tokens", "ids"])

    d = text_of(docs).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange(n_files or partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (
        d.mapInArrow(encode, SCHEMA)
        .write.mode("overwrite")
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids. With doc_ids, files, stripes and row groups without them are skipped."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # reads one column; a row per file
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))
    # base has a row per file, so its size is bounded by the writer's n_files
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """Replace ids by the unsigned crc32 of their little-endian unsigned 32-bit form."""
    ship(rows.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            ends = ids.offsets.to_numpy()
            v = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(v[4 * p : 4 * q]) for p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return checksums(read_token_files(spark, path))
