"""Benchmark decontamination by greedy string tiling.

Words (ASCII punctuation apart, A-Z folded) are numbered by hashes, and a rolling (Karp-Rabin) hash names every run of MATCH
words. Runs that a document shares with a benchmark item are seeds. An item whose seeded words could reach COVERAGE of its
words goes on to the tiling, on the words themselves: the longest run that both texts share over unmarked words is searched
by rolling hashes of growing and shrinking lengths, confirmed word by word and marked in both texts, again and again until no
run of MATCH words is left. So tiles never overlap and may come in any order. An item whose tiles cover at least COVERAGE of
its words is contained in the document, in whatever order its passages stand.

The benchmark goes to the executors in blocks of bounded size (BLOCK_BYTES), one pass over the documents each; one block
holds any usual benchmark. A block is collected, sent and let go before the next, and each pass but a single one is written.

Defined results: null or empty texts match nothing; an item of fewer than MATCH words is contained where all of its words
stand in a row; an item without words matches nothing; repeated items count each; repeated documents are reported each; an
empty table, on either side, gives no matches; further columns are ignored by the search and kept by the stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, materialise, ship, text_blocks, text_of
from .shingles import mixed, word_hashes

MATCH, COVERAGE, BLOCK_BYTES = 5, 0.8, 32 << 20
TABLE = 1 << 22
SCHEMA = "doc_id long, item_id long, coverage double, matched_words long, n_tiles long, contaminated boolean"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: The base of the rolling hash, odd, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of the runs of any length of a sequence of numbers: sums of number times base ** -place, shifted to a common place."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.up = _powers(_BASE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(numbers) * _powers(_BACK, n), out=self.sums[1:])

    def runs(self, k: int) -> np.ndarray:
        """The hash of every run of k numbers, in order."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return (self.sums[k:] - self.sums[: n - k + 1]) * self.up[: n - k + 1]


def words_of(text: str) -> list[bytes]:
    """The words that word_hashes(marks=True) hashes."""
    return _WORD.findall(text.encode().lower())


def _free_runs(marked: np.ndarray, k: int) -> np.ndarray:
    """For every run of k places, whether none is marked."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[k:] == sums[:-k]


def tiles(doc: np.ndarray, item: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the document, start in the item, words), longest first; of equal ones the first in the item, then in the document.

    Each search takes time in proportion to both texts, however often words repeat."""
    d, p = Rolling(doc), Rolling(item)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)

    def find(k: int) -> tuple[int, int] | None:
        """The first free run of k words of the item that the document has, and its first free place there."""
        if k > min(len(doc), len(item)):
            return None
        at_p, at_d = np.flatnonzero(_free_runs(in_item, k)), np.flatnonzero(_free_runs(in_doc, k))
        hp, hd = p.runs(k)[at_p], d.runs(k)[at_d]
        hits = np.isin(hp, hd)
        for i in np.flatnonzero(hits):
            for j in at_d[hd == hp[i]]:
                if np.array_equal(doc[j : j + k], item[at_p[i] : at_p[i] + k]):  # equal hashes alone are no match
                    return int(j), int(at_p[i])
        return None

    out, high = [], len(item)
    while True:
        # the longest run: a run of k words holds runs of k - 1, so the lengths are searched by halving
        low, best = match - 1, None
        while low < high:
            k = (low + high + 1) // 2
            if got := find(k):
                low, best = k, got
            else:
                high = k - 1
        if best is None:
            return out
        j, i = best
        out.append((j, i, low))
        in_doc[j : j + low] = True
        in_item[i : i + low] = True
        high = low


class Index:
    """Seeds of a block of benchmark items: runs of `match` words, or all words of a shorter item."""

    def __init__(self, items: list[tuple[int, str]], match: int):
        kept = [(i, w) for i, t in items if (w := words_of(t or ""))]
        self.match, self.ids, self.sizes = match, [i for i, _ in kept], [len(w) for _, w in kept]
        self.words = [w for _, w in kept]
        self.lengths = sorted({min(match, n) for n in self.sizes})
        self.key: dict[int, np.ndarray] = {}
        self.owner: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        self.table = {}
        for k in self.lengths:
            keys, owner, place = [], [], []
            for x, w in enumerate(self.words):
                if min(match, len(w)) == k:
                    h = Rolling(word_hashes([b" ".join(w)], marks=True)[0]).runs(k)
                    keys.append(h)
                    owner.append(np.full(len(h), x))
                    place.append(np.arange(len(h)))
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            self.key[k], self.owner[k], self.place[k] = key[order], np.concatenate(owner)[order], np.concatenate(place)[order]
            self.table[k] = np.zeros(TABLE, bool)
            self.table[k][(key % np.uint64(TABLE)).astype(np.int64)] = True

    def _candidates(self, hashes: np.ndarray, coverage: float) -> list[int]:
        """Items whose seeds in the document could cover enough of them."""
        out: list[int] = []
        roll = Rolling(hashes)
        for k in self.lengths:
            h = roll.runs(k)
            h = np.unique(h[self.table[k][(h % np.uint64(TABLE)).astype(np.int64)]])
            low, high = np.searchsorted(self.key[k], h, side="left"), np.searchsorted(self.key[k], h, side="right")
            n = high - low
            at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # each seed of an item once
            owner, place = self.owner[k][at], self.place[k][at]
            order = np.lexsort((place, owner))
            owner, place = owner[order], place[order]
            # words under seeds: k for each seed, less what it shares with the seed before it
            gain = np.full(len(owner), k)
            same = owner[1:] == owner[:-1]
            gain[1:][same] = np.minimum(k, place[1:] - place[:-1])[same]
            if len(owner):
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                out += [x for x, n in zip(owner[first].tolist(), np.add.reduceat(gain, first).tolist(), strict=True) if n >= coverage * self.sizes[x]]
        return sorted(out)

    def search(self, texts: list[str], coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, words covered, tiles) of every text and item that the text contains."""
        hashes, counts = word_hashes([t.encode() for t in texts], marks=True)
        ends = np.cumsum(counts)
        starts, roll, seen = ends - counts, Rolling(hashes), set()
        for k in self.lengths:  # texts with a seed, all of them at once
            h = roll.runs(k)
            at = np.flatnonzero(self.table[k][(h % np.uint64(TABLE)).astype(np.int64)])
            doc = np.searchsorted(ends, at, side="right")
            at, doc = at[inside := at + k <= ends[doc]], doc[inside]
            seen.update(doc[np.isin(h[at], self.key[k])].tolist())
        for d in sorted(seen):
            some = self._candidates(hashes[starts[d] : ends[d]], coverage)
            if not some:
                continue
            words = words_of(texts[d])
            for x in some:
                number = {w: i + 1 for i, w in enumerate(dict.fromkeys(self.words[x]))}
                doc = np.array([number.get(w, 0) for w in words], np.uint64)
                item = np.array([number[w] for w in self.words[x]], np.uint64)
                found = tiles(doc, item, min(self.match, len(item)))
                covered = sum(n for _, _, n in found)
                if covered >= coverage * len(item):
                    yield d, x, covered, len(found)


def blocks(benchmark: DataFrame, match: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """Indexes of all items in blocks of about block_bytes, sent one at a time, and whether it is the last; one is let go when the
    next is asked for. The number of blocks is found by a count of bytes."""
    spark = benchmark.sparkSession
    ship(spark)
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    size = b.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    for i in range(n):
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        sent = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], match))
        yield sent, i == n - 1
        if i < n - 1:
            sent.unpersist()


def matches(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, matched words and tiles of every document that contains an item."""
    out = None
    for sent, last in blocks(benchmark, match, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in lean("decontaminate", batches):
                for some in text_blocks(b, 1):
                    ix, ids = sent.value, some.column(0).to_pylist()
                    rows = [(ids[d], ix.ids[x], n / ix.sizes[x], n, t, True) for d, x, n, t in ix.search(some.column(1).to_pylist(), coverage)]
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "coverage", "matched_words", "n_tiles", "contaminated"])

        part = text_of(docs).mapInArrow(run, SCHEMA)
        part = part if last else materialise(part)  # few rows
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that contain a benchmark item. Each block reads what the one before it has left."""
    at, schema, before = docs.columns.index("text"), docs.schema, None
    for sent, last in blocks(benchmark, match, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in lean("decontaminate", batches):
                for some in text_blocks(b, at):
                    keep = np.ones(len(some), bool)
                    for d, _, _, _ in sent.value.search([t or "" for t in some.column(at).to_pylist()], coverage):
                        keep[d] = False
                    yield some.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
        if not last:
            docs = materialise(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
