"""MinHash near-dedup with odd sketches.

1. Every document: distinct word shingles (64-bit hashes), a digest of the set, BANDS x ROWS MinHash samples, a key per
   band and an odd sketch: the samples folded into a bitmap by parity. Equal sets become one class at once.
2. Classes that share a band key form a bucket. Each member is paired with the bucket's smallest class. Pairs that cannot
   link by their sizes, or whose sketches' XOR count puts them MARGIN standard errors below the threshold, go; the rest is
   confirmed on the full sets.
3. Buckets that these links leave in several components are settled exactly: their members outside the largest component
   meet all members in tiles of bounded size. Sketches and sizes alone go first and tell which members have a possible
   partner in another component; only those come again with their full sets, and a union-find tests their pairs, most
   similar first. So no candidate pair is given up, and a group of copies costs as many tests as it has members.
4. Components by label propagation; the smallest doc_id of each stays.

With 24 bands of 5 rows a pair at the threshold of 0.85 is missed with a probability below 1e-6; above it, less.

Defined results: a null text is empty; a text without words has an empty set, its own component and is kept; documents of
fewer words than a shingle have one shingle of all their words; repeated rows are copies of one another; rows that share a
doc_id but not the text are different documents; a null doc_id sorts first and is its group's smallest only if all
are null (then the text of least hash stays); an
empty table gives no rows; further columns are ignored by the grouping and kept by the stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, held, lean, materialise, ship, text_blocks, text_of
from .components import components
from .joins import share_join
from .shingles import mixed, shingles, word_hashes

BANDS, ROWS, BITS = 24, 5, 512
SAMPLES = BANDS * ROWS
#: Standard errors below the threshold at which a sketch rules a pair out; members of a tile's side, and shingles of all of them together; edges
#: of a pivot that share a copy of its set.
MARGIN, TILE, TILE_SHINGLES, SHARE = 6.0, 512, 1 << 18, 256
_rng = np.random.default_rng(8)
_A = (_rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)[:, None]
_TAG = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def samples(h: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of hashes."""
    x = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[None, i : i + 2048] * _A + _B).min(1), out=out)
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    k = _BAND.copy()
    for i in range(ROWS):
        k = mixed(k ^ s[i::ROWS].astype(np.uint64)) + np.uint64(0x632BE59BD9B4E019)
    return k.view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """The parity, for each of BITS places, of the samples that fall there; as 64-bit words."""
    at = (mixed(_TAG ^ s.astype(np.uint64)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def most_bits(threshold: float) -> int:
    """XOR counts above this put a pair's similarity below the threshold, MARGIN standard errors away."""
    least = max(0.0, threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / SAMPLES) - 0.02)
    # each differing sample flips two random places
    return int(np.ceil(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - least) / BITS))))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The shingle set of every row's text (column 1), by blocks of bounded size."""
    for some in text_blocks(batch, 1):
        words, counts = word_hashes([t.encode() for t in some.column(1).to_pylist()])
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            yield np.unique(shingles(words[a:b], k))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tie (hash of the text), n (set size), digest (null for an empty set), keys, sketch."""
    ship(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from modloom.llm import near_dedup as nd

        for b in nd.lean("near_dedup", batches):
            n, digest, keys, sketch = [], [], [], []
            for h in nd._sets(b, k):
                s = nd.samples(h) if len(h) else None
                n.append(len(h))
                digest.append(None if s is None else hashlib.md5(h.tobytes()).digest())
                keys.append(None if s is None else nd.band_keys(s))
                sketch.append(None if s is None else nd.odd_sketch(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "tie", "n", "digest", "keys", "sketch"])

    return text_of(docs).withColumn("tie", F.xxhash64("text")).mapInArrow(sign, "doc_id long, tie long, n long, digest binary, keys array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(digest, hashes) of the classes in `wanted` (digest, doc_id and tie of a member; the doc_id may be null)."""
    d = text_of(docs).withColumn("tie", F.xxhash64("text")).alias("d")
    some = wanted.select("doc_id", "tie").distinct().alias("w")
    d = d.join(some, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.tie") == F.col("w.tie")), "left_semi").select("doc_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from modloom.llm import near_dedup as nd

        for b in nd.lean("near_dedup", batches):
            for some in text_blocks(b, 1):  # sets take more room than texts: small batches
                h = list(nd._sets(some, k))
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(x.tobytes()).digest() for x in h], pa.binary()), pa.array([x.view(np.int64) for x in h], pa.list_(pa.int64()))], ["digest", "hashes"])

    made = d.mapInArrow(build, "digest binary, hashes array<long>")
    # repeated rows, and texts of equal hashes: keep the wanted ones, once each
    return made.join(wanted.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])


def _bits(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def star_links(docs: DataFrame, classes: DataFrame, bands: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) between members and their bucket's smallest class; the members (key, digest, members) of buckets of several."""
    buckets = materialise(bands.groupBy("key").agg(F.min("digest").alias("least"), F.count("digest").alias("members")).filter("members > 1"))
    # a bucket may hold a third of all classes: the members of such a one are dealt over tasks, as many as it has fair shares
    shared_keys = materialise(share_join(bands, buckets, "key", "digest", buckets, "members", "inner").select("key", "digest", "least", "members"))
    pairs = materialise(shared_keys.filter("digest <> least").select(F.col("least").alias("p"), F.col("digest").alias("m")).distinct())
    small = classes.select("digest", "n", "sketch")
    edges = materialise(pairs.groupBy("p").agg(F.count("m").alias("edges")))
    pivots = edges.join(small.withColumnRenamed("digest", "p"), "p").select("p", F.col("n").alias("n_p"), F.col("sketch").alias("s_p"), (F.col("edges") / SHARE + 1).cast("int").alias("shares"))
    near = pairs.join(small.select(F.col("digest").alias("m"), F.col("n").alias("n_m"), F.col("sketch").alias("s_m")), "m")
    near = share_join(near, pivots, "p", "m", edges, "edges", "inner")
    near = near.filter((F.least("n_p", "n_m") * 100 >= F.greatest("n_p", "n_m") * percent) & (_bits(F.col("s_p"), F.col("s_m")) <= most_bits(percent / 100)))
    near = materialise(near.select("p", "m", "shares", F.pmod(F.xxhash64("m"), F.col("shares")).cast("int").alias("share")))
    wanted = near.select(F.col("p").alias("digest")).union(near.select("m")).distinct().join(classes.select("digest", "doc_id", "tie"), "digest")
    sets = materialise(full_sets(docs, wanted, k))
    left = near.select("p", "shares").distinct().join(sets.withColumnRenamed("digest", "p"), "p").select("p", F.col("hashes").alias("h_p"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    both = near.join(sets.select(F.col("digest").alias("m"), F.col("hashes").alias("h_m")), "m").join(left, ["p", "share"])
    shared = F.size(F.array_intersect("h_p", "h_m"))
    links = both.filter(shared * 100 >= (F.size("h_p") + F.size("h_m") - shared) * percent)
    links = materialise(links.select(F.col("p").alias("a"), F.col("m").alias("b")))
    discard(buckets, pairs, edges, near, sets)
    return links, shared_keys


def _apart(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> np.ndarray:
    """XOR counts of all pairs of two sides; a large number where the sizes rule a link out."""
    sa, sb = np.stack(list(a.sketch)).astype(np.int64), np.stack(list(b.sketch)).astype(np.int64)
    na, nb = a.n.to_numpy(np.int64), b.n.to_numpy(np.int64)
    out = np.empty((len(a), len(b)), np.int32)
    for i in range(len(a)):
        out[i] = np.bitwise_count(sa[i] ^ sb).sum(1)
        out[i][np.minimum(na[i], nb) * 100 < np.maximum(na[i], nb) * percent] = BITS + 1
    return out


def possible(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of a tile (side 0: outside the largest component, 1: all; digest, label, n, sketch) with a possible partner in another component."""
    rows = rows.drop_duplicates(["side", "digest"])
    a, b = rows[rows.side == 0], rows[rows.side == 1]
    if not len(a) or not len(b):
        return rows[:0]
    names = {x: i for i, x in enumerate(set(rows.label))}
    la, lb = a.label.map(names).to_numpy(), b.label.map(names).to_numpy()
    may = (_apart(a, b, percent) <= most_bits(percent / 100)) & (la[:, None] != lb[None, :])
    return pd.concat([a[may.any(1)], b[may.any(0)]])


def settle(rows: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join the components of one tile: rows as in possible(), with the full sets (hashes)."""
    bits = most_bits(percent / 100)
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    rows = rows.drop_duplicates(["side", "digest"])
    a, b = rows[rows.side == 0], rows[rows.side == 1]
    ha, hb = list(a.hashes), list(b.hashes)  # sorted as they are made
    la, lb, da, db = list(a.label), list(b.label), list(a.digest), list(b.digest)
    apart = _apart(a, b, percent)
    found = []
    order = np.argsort(apart, axis=None, kind="stable")
    for at in order[: int(np.searchsorted(apart.ravel()[order], bits, side="right"))].tolist():
        i, j = divmod(at, len(b))
        if root(la[i]) == root(lb[j]):
            continue
        x, y = ha[i], hb[j]
        shared = len(np.intersect1d(x, y, assume_unique=True))
        if shared * 100 >= (len(x) + len(y) - shared) * percent:
            up[root(la[i])] = root(lb[j])
            found.append((da[i], db[j]))
    return found


def tile_links(docs: DataFrame, classes: DataFrame, members: DataFrame, labels: DataFrame, percent: int, k: int) -> DataFrame | None:
    """Further links (a, b) within buckets of three or more members that lie in several components; none where no bucket does."""
    named = members.select("key", "digest", "members").filter("members > 2").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    named = materialise(named.join(classes.select("digest", "n"), "digest").select("key", "digest", "label", "members", "n"))
    per = named.groupBy("key", "label").agg(F.count("digest").alias("c"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    keys = per.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("members"), F.sum("n").alias("n"), F.max_by("n", F.struct("c", "label")).alias("n_main"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("members > most")

    def tiles_of(members: Column, n: Column) -> Column:
        return F.greatest(members / TILE + 1, n / TILE_SHINGLES + 1).cast("int")

    # buckets of equal members are settled once
    keys = keys.groupBy("x", "y", "members").agg(F.min_by(F.struct("key", "main", "most", "n", "n_main"), "key").alias("k"))
    keys = keys.select("k.key", "k.main", "members", tiles_of(F.col("members"), F.col("k.n")).alias("nb"), tiles_of(F.col("members") - F.col("k.most"), F.col("k.n") - F.col("k.n_main")).alias("na"))
    keys = materialise(keys)
    if not keys.limit(1).count():  # every bucket is one component
        discard(named, keys)
        return None
    m = share_join(named.drop("members"), keys, "key", "digest", keys, "members", "inner")
    h = F.xxhash64("digest", F.lit(7))
    side_b = m.select("key", "digest", "label", F.lit(1).alias("side"), F.pmod(h, F.col("nb")).cast("int").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ta"))
    side_a = m.filter("label <> main").select("key", "digest", "label", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("tb"), F.pmod(h, F.col("na")).cast("int").alias("ta"))
    tiles = side_a.unionByName(side_b).join(classes.select("digest", "n", "sketch"), "digest")
    schema = "key long, ta int, tb int, side int, digest binary, label binary, n long, sketch array<long>"

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        from modloom.llm import near_dedup as nd

        nd.held("near_dedup")
        return nd.possible(pdf, percent)[["key", "ta", "tb", "side", "digest", "label", "n", "sketch"]]

    screened = materialise(tiles.groupBy("key", "ta", "tb").applyInPandas(screen, schema))
    wanted = materialise(screened.select("digest").distinct().join(classes.select("digest", "doc_id", "tie"), "digest"))
    sets = full_sets(docs, wanted, k)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from modloom.llm import near_dedup as nd

        return pd.DataFrame(nd.settle(pdf, percent), columns=["a", "b"])

    links = materialise(screened.join(sets, "digest").groupBy("key", "ta", "tb").applyInPandas(run, "a binary, b binary"))
    discard(named, keys, screened, wanted)
    return links


def grouped(docs: DataFrame, percent: int = 85, k: int = 3) -> DataFrame:
    """Per row of docs: doc_id, tie (hash of the text), label (of its component; null without words), n_shingles, component_id, kept."""
    sig = materialise(signatures(docs, k))
    full = sig.filter("digest IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie"))
    classes = materialise(full.groupBy("digest").agg(least["doc_id"].alias("doc_id"), least["tie"].alias("tie"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.count("tie").alias("copies")))
    bands = classes.select("digest", F.explode("keys").alias("key"))
    first, members = star_links(docs, classes, bands, percent, k)
    labels = components(first)
    more = tile_links(docs, classes, members, labels, percent, k)
    discard(members)
    if more is not None:
        if more.limit(1).count():
            discard(labels)
            labels = components(first.union(more))
        discard(more)
    discard(first)
    # classes without a link are components of their own, named by themselves; the others' components, and classes, may be large
    linked = classes.select("digest", "doc_id", "tie").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    ids = materialise(labels.join(classes.select(F.col("digest").alias("node"), "doc_id", "tie"), "node").groupBy("label").agg(least["doc_id"].alias("component_id"), least["tie"].alias("first_tie"), F.count("node").alias("classes")))
    named = share_join(linked, ids, "label", "digest", ids, "classes")
    alone = F.col("classes").isNull()
    named = materialise(named.select("digest", "label", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("tie")).otherwise(F.col("first_tie")).alias("first_tie")))
    rows = sig.select("doc_id", "tie", "digest", F.col("n").alias("n_shingles"), F.xxhash64("doc_id", "tie").alias("by"))
    out = share_join(rows.filter("digest IS NOT NULL"), named, "digest", "by", classes, "copies")
    out = out.unionByName(rows.filter("digest IS NULL"), allowMissingColumns=True)  # no words: met by nothing
    own = F.coalesce("component_id", "doc_id")
    # where all ids of a group are null, its least text is the one kept
    kept = F.col("doc_id").eqNullSafe(own) & (own.isNotNull() | F.col("first_tie").isNull() | (F.col("tie") == F.col("first_tie")))
    out = materialise(out.select("doc_id", "tie", "label", "n_shingles", own.alias("component_id"), F.coalesce(kept, F.lit(False)).alias("kept")))
    discard(sig, classes, labels, ids, named)
    return out


def deduplicate(docs: DataFrame, percent: int = 85, k: int = 3) -> DataFrame:
    """One row of each group, with all columns: that of the smallest doc_id. Rows without words stay, repeated ones once."""
    g = grouped(docs, percent, k)
    first = g.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")).alias("w")).select("w.doc_id", "w.tie")
    # a null id is told from 0 by a column of its own, so that join and dropDuplicates share one exchange of the texts
    key = ["__modloom_id", "__modloom_null", "__modloom_tie"]
    names = {key[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), key[1]: F.col("doc_id").isNull()}
    stay = first.union(g.filter("label IS NULL").select("doc_id", "tie")).distinct().withColumns(names | {key[2]: F.col("tie")}).select(*key)
    d = docs.withColumns(names | {key[2]: F.xxhash64(F.coalesce("text", F.lit("")))})
    return d.join(stay, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")
