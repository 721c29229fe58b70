"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is lower-cased and cut into words, those of over PIECE characters (scripts without spaces) into overlapping pieces
that each count as a word and together hold all its n-grams; all overlapping windows of WINDOW words, STRIDE apart, are scored (the last one
ends with the text), and the text's score is that of its strongest window. A word's input holds word-level and
character-level parts: signed likelihood-ratio evidence of the word and of its character n-grams, shape features, and
trained embeddings of both (hashed). Evidence is cross-fitted during training, so that the network sees it as on new texts.

Training uses at most TRAIN_ROWS labelled rows (least hash of doc_id first) of at most TRAIN_CHARS characters each and
TRAIN_BYTES together, by multiple-instance rounds: score all windows, then fit the strongest window of every row. Model and tables have a fixed size.

Defined results: a null text counts as empty and scores as a window without words; without labels of both kinds every
score is 0; null labels are not learnt from; repeated rows are kept; an empty table gives no rows; labels, lang, source
and doc_id are never inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, ship, text_blocks, trim

WINDOW, STRIDE = 32, 16
TRAIN_ROWS, TRAIN_CHARS, TRAIN_BYTES = 3000, 200_000, 24_000_000
HIDDEN, ATTENTION, EMBED = 8, 8, 4
#: Buckets of the evidence tables and of the embeddings; lengths of character n-grams.
EVIDENCE, BUCKETS, GRAMS = 1 << 18, 1 << 12, (3, 4, 5)
#: Most characters of a word; words hashed at once.
PIECE, HASHED = 64, 1 << 14
#: Bytes of text that are scored at once.
SCORE_BLOCK = 2_000_000
#: Rounds of choosing windows; windows fitted in each round (as many epochs as they make, 2 to 16).
FOLDS, ROUNDS, FITTED, BATCH = 4, 3, 6000, 128
THRESHOLD = 0.3
DIM = 6 + 2 * EMBED
_WORDS = re.compile(r"\w+|[^\w\s]+")


def words_of(text: str) -> list[str]:
    ws = _WORDS.findall(text.lower())
    if max(map(len, ws), default=0) <= PIECE:
        return ws
    step = PIECE - max(GRAMS) + 1  # every n-gram lies whole in a piece
    return [w[i : i + PIECE] for w in ws for i in range(0, max(1, len(w) - max(GRAMS) + 1), step)]


@dataclass
class Words:
    """Hashes of distinct words: of the word, and of its n-grams (ragged)."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    shape: np.ndarray


def hashed(words: list[str]) -> Words:
    """Part by part, for words as long as texts take many times their size on the way."""
    parts = [_hashed(words[i : i + HASHED]) for i in range(0, len(words), HASHED)]
    before = np.cumsum([0] + [len(u.gram) for u in parts[:-1]])
    first = np.concatenate([u.first + b for u, b in zip(parts, before, strict=True)])
    return Words(np.concatenate([u.word for u in parts]), np.concatenate([u.gram for u in parts]), first, np.concatenate([u.shape for u in parts]))


def _hashed(words: list[str]) -> Words:
    marked = [f"^{w or ' '}$" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    start = np.cumsum(size) - size
    left = np.repeat(start + size, size) - np.arange(len(code))  # characters to the word's end
    mix = np.uint64(0x9E3779B97F4A7C15)
    step = (code + np.uint64(1)) * mix
    power = np.uint64(1) + np.arange(len(code), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64)
    word = np.add.reduceat((step ^ (step >> np.uint64(29))) * (power * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)), start)
    word ^= word >> np.uint64(31)
    at, grams = [], []
    h = step.copy()
    for n in range(2, max(GRAMS) + 1):
        h[: -n + 1] = (h[: -n + 1] ^ (h[: -n + 1] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) + step[n - 1 :]
        if n in GRAMS:
            ok = np.flatnonzero(left >= n)
            at.append(ok)
            grams.append(h[ok] ^ (h[ok] >> np.uint64(31)) ^ np.uint64(n))
    owner = np.repeat(np.arange(len(words)), size)
    pos, gram = np.concatenate(at), np.concatenate(grams)
    order = np.argsort(owner[pos], kind="stable")
    owner, gram = owner[pos][order], gram[order]
    first = np.searchsorted(owner, np.arange(len(words)))
    shape = np.stack([np.minimum(size - 2, 20) / 10, np.array([not w.isalpha() for w in words])], 1).astype(np.float32)
    return Words(word, gram, first, shape)


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Signed root of the likelihood ratio of being in positive documents, a quarter of it, clipped."""
    prior = n_pos / max(1, n_pos + n_neg)
    n = pos + neg
    rate = np.where(n > 0, pos / np.maximum(n, 1), prior)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.where(pos > 0, pos * np.log(rate / prior), 0) + np.where(neg > 0, neg * np.log((1 - rate) / (1 - prior)), 0)
    return np.clip(np.sign(rate - prior) * np.sqrt(2 * np.maximum(g, 0)) / 4, -2, 3).astype(np.float32)


@dataclass
class Model:
    prior: float
    word_evidence: np.ndarray = field(repr=False)
    gram_evidence: np.ndarray = field(repr=False)
    p: dict[str, np.ndarray] = field(repr=False)

    def inputs(self, u: Words, word_evidence: np.ndarray | None = None, gram_evidence: np.ndarray | None = None) -> np.ndarray:
        we = (self.word_evidence if word_evidence is None else word_evidence)[u.word % EVIDENCE]
        ge = (self.gram_evidence if gram_evidence is None else gram_evidence)[u.gram % EVIDENCE]
        n = np.diff(np.append(u.first, len(u.gram)))
        top, mean = np.maximum.reduceat(ge, u.first), np.add.reduceat(ge, u.first) / n
        ew = self.p["word"][(u.word >> np.uint64(20)) % BUCKETS]
        ec = np.add.reduceat(self.p["char"][(u.gram >> np.uint64(20)) % BUCKETS], u.first) / n[:, None].astype(np.float32)
        return np.concatenate([we[:, None], top[:, None], mean[:, None].astype(np.float32), u.shape, np.ones((len(we), 1), np.float32), ew, ec], 1).astype(np.float32)


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"word": normal(BUCKETS, EMBED, scale=0.02), "char": normal(BUCKETS, EMBED, scale=0.02)}
    for d in "fb":
        p |= {f"W{d}": normal(DIM, 3 * HIDDEN, scale=DIM**-0.5), f"U{d}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"A": normal(2 * HIDDEN, ATTENTION, scale=0.3), "a": normal(ATTENTION, scale=0.5), "v": normal(2 * HIDDEN, scale=0.3), "b": np.array([-2.0], np.float32)}


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(gx: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
    """gx: (steps, rows, 3 hidden). Gates: update, reset, candidate."""
    steps, rows, _ = gx.shape
    h, out, saved = np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32), []
    for t in range(steps):
        zr = _sig(gx[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        c = np.tanh(gx[t, :, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
        new = h + z * (c - h)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep:
            saved.append((h, z, r, rh, c))
        out[t] = h = new
    return out, saved


def logits(p: dict[str, np.ndarray], table: dict[str, np.ndarray], idx: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """idx: (steps, rows) of word numbers; table: the words' input shares of the gates, for either direction."""
    hf, sf = _gru(table["f"][idx], p["Uf"], mask, keep)
    hb, sb = _gru(table["b"][idx[::-1]], p["Ub"], None if mask is None else mask[::-1], keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    k = np.tanh(h @ p["A"])
    e = k @ p["a"]
    if mask is not None:
        e = np.where(mask, e, np.float32(-1e9))
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tr,trh->rh", w, h)
    return pooled @ p["v"] + p["b"][0], (h, k, w, pooled, sf, sb)


def _gru_back(dh_out: np.ndarray, saved: list, u: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    steps, rows, _ = dh_out.shape
    dgx, du, dh = np.zeros((steps, rows, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, rh, c = saved[t]
        d = dh + dh_out[t]
        live = d if mask is None else np.where(mask[t][:, None], d, 0)
        dc = live * z * (1 - c * c)
        drh = dc @ u[:, 2 * HIDDEN :].T
        dz, dr = live * (c - h) * z * (1 - z), drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], 1)
        du[:, : 2 * HIDDEN] += h.T @ dzr
        du[:, 2 * HIDDEN :] += rh.T @ dc
        dgx[t] = np.concatenate([dzr, dc], 1)
        dh = d - live + live * (1 - z) + drh * r + dzr @ u[:, : 2 * HIDDEN].T
    return dgx, du


def gradients(p: dict[str, np.ndarray], x: np.ndarray, idx: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the mean cross-entropy by the parameters (but the embeddings) and by the words' inputs x."""
    table = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
    s, (h, k, w, pooled, sf, sb) = logits(p, table, idx, mask, keep=True)
    g = ((_sig(s) - y) / len(y)).astype(np.float32)
    out = {"v": pooled.T @ g, "b": np.array([g.sum()], np.float32)}
    dpooled = g[:, None] * p["v"]
    dh = w[:, :, None] * dpooled
    dw = np.einsum("trh,rh->tr", h, dpooled)
    de = w * (dw - (w * dw).sum(0))
    dk = de[:, :, None] * p["a"] * (1 - k * k)
    out["a"] = np.einsum("tr,tra->a", de, k)
    out["A"] = np.einsum("trh,tra->ha", h, dk)
    dh = dh + dk @ p["A"].T
    dx = np.zeros_like(x)
    for d, part, saved, turn in (("f", dh[:, :, :HIDDEN], sf, 1), ("b", dh[::-1, :, HIDDEN:], sb, -1)):
        dgx, out[f"U{d}"] = _gru_back(part, saved, p[f"U{d}"], mask[::turn])
        flat = dgx[::turn].reshape(-1, 3 * HIDDEN)
        out[f"c{d}"] = flat.sum(0)
        dtab = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(dtab, idx.ravel(), flat)
        out[f"W{d}"] = x.T @ dtab
        dx += dtab @ p[f"W{d}"].T
    return out, dx


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word within all words in a row, and number of words of every window."""
    sizes = np.asarray(sizes, np.int64)
    n = np.where(sizes <= WINDOW, 1, -(-(sizes - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(k * STRIDE, np.maximum(sizes - WINDOW, 0)[doc])
    return doc, (np.cumsum(sizes) - sizes)[doc] + at, np.minimum(sizes, WINDOW)[doc]


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (the first stands for no word), all words in a row by number, words of each text."""
    known: dict[str, int] = {"": 0}
    rows = []
    for t in texts:  # words are let go text by text
        ws = words_of(t)
        rows.append(np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int32, len(ws)))
    return list(known), np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


def _window_ids(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    at = first[None, :] + np.arange(WINDOW)[:, None]
    if (n == WINDOW).all():
        return ids[at], None
    mask = np.arange(WINDOW)[:, None] < np.maximum(n, 1)[None, :]
    padded = np.append(ids, np.int32(0))
    return np.where(np.arange(WINDOW)[:, None] < n[None, :], padded[np.minimum(at, len(ids))], 0), mask


def window_scores(p: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, first: np.ndarray, n: np.ndarray, block: int = 2048) -> np.ndarray:
    table = {d: (x @ p[f"W{d}"] + p[f"c{d}"]).astype(np.float32) for d in "fb"}
    out = np.empty(len(first), np.float32)
    for rows in (np.flatnonzero(n == WINDOW), np.flatnonzero(n < WINDOW)):
        for i in range(0, len(rows), block):
            some = rows[i : i + block]
            out[some] = logits(p, table, *_window_ids(ids, first[some], n[some]))[0]
    return out


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    if not model.p:
        return np.full(len(texts), model.prior)
    if not texts:
        return np.zeros(0)
    known, ids, sizes = _numbered(texts)
    doc, first, n = windows(sizes)
    x = np.concatenate([model.inputs(hashed(known[a : a + HASHED])) for a in range(0, len(known), HASHED)])
    s = window_scores(model.p, x, ids, first, n)
    best = np.maximum.reduceat(s, np.searchsorted(doc, np.arange(len(texts))))
    return _sig(best.astype(np.float64))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    y = np.asarray(labels, np.int64)
    zero = np.zeros(EVIDENCE, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0, zero, zero, {})
    rng = np.random.default_rng(seed)
    known, ids, sizes = _numbered(texts)
    u = hashed(known)
    fold = rng.permutation(len(y)) % FOLDS
    ends = np.cumsum(sizes)
    counts = np.zeros((FOLDS, 2, 2, EVIDENCE), np.int32)
    stop = np.append(u.first[1:], len(u.gram))
    for i in range(len(y)):  # document frequencies, by fold and label
        mine = np.unique(ids[ends[i] - sizes[i] : ends[i]])
        counts[fold[i], y[i], 0][np.unique(u.word[mine] % EVIDENCE)] += 1
        if len(mine):
            length = stop[mine] - u.first[mine]
            at = np.arange(length.sum()) + np.repeat(u.first[mine] - (np.cumsum(length) - length), length)
            counts[fold[i], y[i], 1][np.unique(u.gram[at] % EVIDENCE)] += 1
    total = counts.sum(0)
    n_pos, n_neg = int(y.sum()), int((1 - y).sum())
    tables = [[evidence(total[1, k] - counts[f, 1, k], total[0, k] - counts[f, 0, k], n_pos - int(y[fold == f].sum()), n_neg - int((1 - y[fold == f]).sum())) for k in (0, 1)] for f in range(FOLDS)]
    model = Model(float(y.mean()), evidence(total[1, 0], total[0, 0], n_pos, n_neg), evidence(total[1, 1], total[0, 1], n_pos, n_neg), new_parameters(rng))
    doc, first, n = windows(sizes)
    starts = np.searchsorted(doc, np.arange(len(y)))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    tick = 0
    chosen = np.empty(len(y), np.int64)
    for round_ in range(ROUNDS):
        for f in range(FOLDS):
            rows = np.flatnonzero(fold[doc] == f)
            x = model.inputs(u, *tables[f])
            # the first round takes the window with the strongest evidence, later ones that with the highest score
            s = window_scores(model.p, x, ids, first[rows], n[rows]) if round_ else np.array([(x[ids[a : a + m], :2].max() if m else 0) for a, m in zip(first[rows].tolist(), n[rows].tolist(), strict=True)])
            for i in np.flatnonzero(fold == f):
                a, b = np.searchsorted(doc[rows], [i, i + 1])
                chosen[i] = rows[a + int(np.argmax(s[a:b]))]
        if round_ == 0:  # strongest evidence among clean rows alone would teach too little about ordinary ones
            plain = rng.integers(starts, np.append(starts[1:], len(doc)))
            swap = (y == 0) & (rng.random(len(y)) < 0.5)
            chosen[swap] = plain[swap]
        for _ in range(min(16, max(2, FITTED // len(y)))):
            for f in rng.permutation(FOLDS):
                mine = rng.permutation(np.flatnonzero(fold == f))
                for i in range(0, len(mine), BATCH):
                    some = mine[i : i + BATCH]
                    w_ids, mask = _window_ids(ids, first[chosen[some]], n[chosen[some]])
                    mask = np.ones(w_ids.shape, bool) if mask is None else mask
                    used, local = np.unique(w_ids, return_inverse=True)
                    length = stop[used] - u.first[used]
                    at = np.arange(length.sum()) + np.repeat(u.first[used] - (np.cumsum(length) - length), length)
                    part = Words(u.word[used], u.gram[at], np.cumsum(length) - length, u.shape[used])
                    g, dx = gradients(model.p, model.inputs(part, *tables[f]), local.reshape(w_ids.shape), mask, y[some])
                    g["word"], g["char"] = np.zeros_like(model.p["word"]), np.zeros_like(model.p["char"])
                    np.add.at(g["word"], (part.word >> np.uint64(20)) % BUCKETS, dx[:, 6 : 6 + EMBED])
                    np.add.at(g["char"], (part.gram >> np.uint64(20)) % BUCKETS, np.repeat(dx[:, 6 + EMBED :] / length[:, None], length, 0))
                    tick += 1
                    for k, v in g.items():
                        m, q = moments[k]
                        m += 0.1 * (v - m)
                        q += 0.001 * (v * v - q)
                        model.p[k] -= 0.01 * (m / (1 - 0.9**tick)) / (np.sqrt(q / (1 - 0.999**tick)) + 1e-8) + (1e-4 * model.p[k] if k in ("word", "char") else 0)
    return model


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled rows outside the held-out quarter."""
    order = F.xxhash64(F.col("doc_id").cast("long"))
    some = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= chars)
    # the rows of least hash that have a label and a text, found from ids and sizes; labels without a text take no place
    sized = d.select("doc_id", F.xxhash64("text").alias("tie"), F.octet_length("text").alias("size")).join(some, "doc_id").orderBy(order, "toxic", "tie").limit(rows)
    w = Window.orderBy(order, "toxic", "tie").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumn("all", F.sum(F.col("size").cast("long")).over(w)).filter(F.col("all") <= most_bytes)  # at most `rows` rows
    got = d.withColumn("tie", F.xxhash64("text")).join(F.broadcast(sized.select("doc_id", "tie", "toxic")), ["doc_id", "tie"]).collect()
    got.sort(key=lambda r: (r["doc_id"], r["toxic"], r["tie"]))
    return [r["text"] for r in got], [r["toxic"] for r in got]


def add_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score column after its own (a column of that name is replaced)."""
    docs = docs.drop(name)
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size, about 2.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean("toxicity", batches):
            for some in text_blocks(b, at, SCORE_BLOCK):
                texts = [t or "" for t in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(score_texts(sent.value, texts), pa.float64())], [*some.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    model = fit(*training_rows(docs, labels))
    trim()
    return model


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return add_score(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
