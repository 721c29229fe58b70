"""Byte-level BPE encoding and decoding by DuckDB queries, one connection per Python worker.

Encoding: a text falls into units at single spaces, units into matches of the pre-tokenizer's pattern. Every distinct
match becomes token-position rows (one per byte); a recursive query joins neighbouring tokens with the merge table and
contracts each word's leftmost pair of least rank until no pair is left. Decoding: token-position rows join the vocabulary
and an ordered aggregation puts their bytes together. Results of distinct units and words are kept in bounded caches, so
repeated words cost one lookup.

A match of more than LONG bytes (base64, rulers) would take a round of recursion per merge over all its rows; such words
are merged by a heap to the same result.

Defined results: a null text counts as empty (no ids); repeated rows are kept; an empty table gives no rows; further columns
are ignored; special strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import held, lean, ship, text_blocks, text_of

#: Bytes of a word that goes through the recursive query; words of one query; tokens decoded by one query; entries of each cache.
LONG, WORDS, TOKENS, MAX_UNITS, MAX_WORDS = 256, 30_000, 500_000, 150_000, 600_000
#: Bytes of text that are handled at once.
BLOCK = 4_000_000

#: a: the word's tokens so far. Each round unnests them to rows, joins neighbours with the merge table and contracts one pair a word.
MERGE_SQL = """
WITH RECURSIVE t AS (
  SELECT false AS done, w, list(tok ORDER BY pos) AS a FROM start GROUP BY w
  UNION ALL
  SELECT best IS NULL, t.w, CASE WHEN best IS NULL THEN a ELSE list_concat(list_append(a[: (best & 16777215)::INT - 1], (best >> 24)::INT), a[(best & 16777215)::INT + 2 :]) END
  FROM t LEFT JOIN (
    SELECT w, min(r::BIGINT << 24 | pos) AS best
    FROM (SELECT w, unnest(a[: len(a) - 1]) AS x, unnest(a[2:]) AS y, unnest(range(1, len(a))) AS pos FROM t WHERE NOT done AND len(a) > 1)
    JOIN merges ON ab = (x::BIGINT << 20) | y
    GROUP BY w) b ON t.w = b.w
  WHERE NOT done)
SELECT w, a AS ids FROM t WHERE done ORDER BY w
"""
DECODE_SQL = "SELECT d, unhex(array_to_string(list(h ORDER BY pos), '')) AS raw FROM tokens JOIN vocab USING (id) GROUP BY d ORDER BY d"


def codec(path: str, pattern: str) -> "Codec":
    """One codec per Python worker, file and pattern."""
    codecs = held("byte_bpe")
    if (path, pattern) not in codecs:
        codecs[path, pattern] = Codec(path, pattern)
    return codecs[path, pattern]


class Codec:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.odd = re.compile(r" \s")  # white space after a space: units would not be independent
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        size = max(self.bytes_of) + 1
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.decimal = [str(i) for i in range(size)]
        pairs = [(a << 20 | b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"modloom-duckdb-{os.getpid()}")})  # spills of one worker, which no other reads
        self.db.register("given", pa.table({"ab": pa.array([p[0] for p in pairs], pa.int64()), "r": pa.array([p[1] for p in pairs], pa.int32())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given ORDER BY ab")
        self.db.register("given", pa.table({"id": pa.array(list(self.bytes_of), pa.int32()), "h": pa.array([b.hex() for b in self.bytes_of.values()])}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM given ORDER BY id")
        self.db.unregister("given")
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _heap(self, word: bytes) -> list[int]:
        """Merges of one long word, least rank and leftmost first."""
        tok = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        end = [i + 1 for i in range(n)]

        def rank(i: int) -> int | None:
            j = after[i]
            return self.ranks.get(word[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop or rank(i) != r:
                continue
            j = after[i]
            alive[j], after[i], end[i], tok[i] = False, after[j], end[j], r
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k, end[after[k]]))
        return [t for t, a in zip(tok, alive, strict=True) if a]

    def _learn_words(self, words: set[str]) -> None:
        rest: list[tuple[str, bytes]] = []
        for w in words:
            raw = w.encode()
            if (r := self.ranks.get(raw)) is not None:
                self.words[w] = np.array([r], "<u4").tobytes()
            elif len(raw) > LONG:
                self.words[w] = np.array(self._heap(raw), "<u4").tobytes()
            else:
                rest.append((w, raw))
        for i in range(0, len(rest), WORDS):
            some = rest[i : i + WORDS]
            n = np.array([len(raw) for _, raw in some])
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = pa.table({"w": pa.array(np.repeat(np.arange(len(some), dtype=np.int32), n)), "pos": pa.array(at.astype(np.int32)), "tok": pa.array(self.single[np.frombuffer(b"".join(raw for _, raw in some), np.uint8)])})
            self.db.register("start", start)
            ids = self.db.sql(MERGE_SQL).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("start")
            values, ends = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
            for k, (w, _) in enumerate(some):
                self.words[w] = values[ends[k] : ends[k + 1]]

    def _learn(self, units: set[str]) -> None:
        """Units that follow a space are kept without it; \\0 marks a text's first unit."""
        new = {u for u in units if u not in self.units}
        if not new:
            return
        parts = {u: self.pattern.findall(u[1:] if u[:1] == "\0" else " " + u) for u in new}
        words = {w for p in parts.values() for w in p}
        self._learn_words({w for w in words if w not in self.words})
        for u, p in parts.items():
            self.units[u] = b"".join([self.words[w] for w in p])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str] | None] = []
        odd: dict[int, list[str]] = {}
        for i, t in enumerate(texts):
            if "\0" in t or self.odd.search(t):
                odd[i] = self.pattern.findall(t)
                cut.append(None)
            else:
                units = t.split(" ")
                if t.endswith(" "):  # a last space has nothing to lean on
                    units.pop()
                    odd[i] = [" "]
                units[0] = "\0" + units[0]
                cut.append(units)
        out: list[bytes] = []
        for i, units in enumerate(cut):
            raw = b""
            if units is not None:
                try:
                    raw = b"".join(map(self.units.__getitem__, units))
                except KeyError:  # not prepared
                    self._learn(set(units))
                    raw = b"".join(map(self.units.__getitem__, units))
            if i in odd:
                words = set(odd[i])
                self._learn_words({w for w in words if w not in self.words})
                raw += b"".join(map(self.words.__getitem__, odd[i]))
            out.append(raw)
        return out

    def prepare(self, texts: list[str]) -> None:
        """Learn the units of many texts by few queries; full caches begin anew here, never in between."""
        if len(self.units) > MAX_UNITS:
            self.units = {}
        if len(self.words) > MAX_WORDS:
            self.words = {}
        units: set[str] = set()
        words: set[str] = set()
        for t in texts:
            if "\0" in t or self.odd.search(t):
                words.update(self.pattern.findall(t))
            else:
                u = t.removesuffix(" ").split(" ")
                units.update(u[1:])
                units.add("\0" + u[0])
        self._learn_words({w for w in words if w not in self.words})
        self._learn(units)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each row of ids; a long row is decoded in stretches."""
        parts: list[tuple[int, np.ndarray]] = []
        for i, raw in enumerate(ids):
            v = np.frombuffer(raw, "<u4")
            parts += [(i, v[k : k + TOKENS]) for k in range(0, len(v), TOKENS)]
        out: list[list[bytes]] = [[] for _ in ids]
        k = 0
        while k < len(parts):
            some, n = [], 0
            while k < len(parts) and (not some or n + len(parts[k][1]) <= TOKENS):
                some.append(parts[k])
                n += len(parts[k][1])
                k += 1
            sizes = [len(v) for _, v in some]
            rows = pa.table({"d": np.repeat(np.arange(len(some), dtype=np.int32), sizes), "pos": np.arange(n, dtype=np.int32), "id": np.concatenate([v for _, v in some]).astype(np.int32)})
            self.db.register("tokens", rows)
            for (i, _), b in zip(some, self.db.sql(DECODE_SQL).to_arrow_table().column("raw").to_pylist(), strict=True):
                out[i].append(b)
            self.db.unregister("tokens")
        return [b"".join(x) for x in out]


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from modloom.llm.byte_bpe import codec

        c = None
        for b in lean("byte_bpe", batches):
            c = c or codec(path, pattern)
            for some in text_blocks(b, 1, BLOCK):
                c.prepare(some.column(1).to_pylist())
                ids = c.encode(some.column(1).to_pylist())
                back = c.decode(ids)
                sizes = [len(x) // 4 for x in ids]
                shas = [hashlib.sha256(" ".join(map(c.decimal.__getitem__, np.frombuffer(x, "<u4").tolist())).encode()).hexdigest() for x in ids]
                cols = [some.column(0), pa.array(sizes, pa.int64()), pa.array(shas), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    cols += [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))), pa.array(back, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return text_of(docs).mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
