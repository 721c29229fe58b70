"""Token counts by overlap resynchronisation.

A short text is counted in one go. A huge one is cut into overlapping chunks, and each chunk is encoded once, with offsets.
Neighbouring chunks are spliced at a place of the overlap where both start a word (a piece of the pre-tokenizer). Such a place
is proven stable: the pre-tokenizer goes from left to right and looks back at nothing, so all words before the place are the
text's by the left chunk, and all words after it by the right one; MARGIN keeps it away from the chunks' ends, where a
contraction or a special string may be cut in two, and characters that compose with the one before are no such place. An
overlap without one is widened, up to the whole chunk; a chunk without one (a single endless word) is made longer. So the
counts are exact for any text, and the work grows with its length.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are kept; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, ship, text_blocks, text_of

#: Characters of a chunk, of the overlap that is tried first, and next to a chunk's end where nothing is spliced.
CHUNK, OVERLAP, MARGIN = 65_536, 256, 32
#: Bytes of text whose words are learnt together.
ENCODE_BLOCK = 3_000_000


@dataclass
class Chunk:
    """text[start:end] as encoded on its own: where its words start, the number of tokens before each of them, and of all."""

    start: int
    end: int
    at: np.ndarray
    before: np.ndarray
    total: int

    def tokens_to(self, place: int) -> int:
        return int(self.before[np.searchsorted(self.at, place)])


def encode_chunk(text: str, start: int, end: int, tokenizer) -> Chunk:
    e = tokenizer.encode(text[start:end], add_special_tokens=False)
    offsets = e.offsets
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    return Chunk(start, end, start + np.array([offsets[i][0] for i in first.tolist()], np.int64), first, len(words))


def _stable(text: str, place: int) -> bool:
    """Whether normalisation leaves the character at a place apart from the one before."""
    c = text[place]
    return c.isascii() or not (unicodedata.category(c).startswith("M") or "\u1160" <= c <= "\u11ff")


def splice(text: str, left: Chunk, right: Chunk) -> int | None:
    """The last place where both chunks start a word, away from the ends; None without one."""
    both = np.intersect1d(left.at, right.at)
    for place in both[(both >= right.start + MARGIN) & (both <= left.end - MARGIN)][::-1].tolist():
        if _stable(text, place):
            return place
    return None


def count_tokens(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of ids the library gives for the whole text."""
    n, total, done = len(text), 0, 0
    left = encode_chunk(text, 0, min(n, chunk), tokenizer)
    while left.end < n:
        wide, place = overlap, None
        while place is None and left.end < n:
            start = left.end - wide
            if start <= done:  # no place in the whole chunk: it is made longer
                left, wide = encode_chunk(text, left.start, min(n, left.start + 4 * (left.end - left.start)), tokenizer), overlap
                continue
            if ((left.at >= start + MARGIN) & (left.at <= left.end - MARGIN)).any():
                right = encode_chunk(text, start, min(n, left.end + chunk), tokenizer)
                place = splice(text, left, right)
            wide *= 4  # alignment failed
        if place is not None:
            total += left.tokens_to(place) - (left.tokens_to(done) if done else 0)
            left, done = right, place
    return total + left.total - (left.tokens_to(done) if done else 0)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from modloom.llm.token_counts import count_tokens
        from modloom.llm.word_pieces import encoder

        enc = encoder(tokenizer_path, "token_counts")
        for b in lean("token_counts", batches):
            n: list[int] = []
            for some in text_blocks(b, 1, ENCODE_BLOCK):
                texts = some.column(1).to_pylist()
                counted = iter([len(x) // 4 for x in enc.encode([t for t in texts if len(t) <= chunk])])
                n += [next(counted) if len(t) <= chunk else count_tokens(t, enc.tokenizer, chunk, overlap) for t in texts]
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_of(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
