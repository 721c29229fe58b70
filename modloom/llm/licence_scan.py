"""Licence scans: a trained paragraph classifier, scored in DataFrame functions alone.

Training happens on the driver in numpy, on variants of the texts in licence_texts (a fixed set): a multinomial logistic
regression over the presence of word n-grams (1 to 3), made sparse by an L1 penalty, with `unknown` as a class of its own fed by
other licences and by ordinary sentences. Notices and other licences held out whole (every FOLD-th, with all variants) give the
temperature that calibrates the probabilities; the weights themselves are then fitted on all of them.

Paragraphs are the lines of a text and, as notices may be wrapped, the joined lines of each part between blank lines. The
n-grams of a paragraph join the weight table (fixed size, broadcast); sums give probabilities. A family with a calibrated
probability of at least CONFIDENT is a prediction. It is confirmed by template comparison: the paragraph holds at least OVERLAP
of the word pairs of one of the family's notices, and more of them than of any other family's or licence's notice. Every
paragraph that the model can predict is scored: one that holds none of the n-grams with a weight for some family above that of
`unknown` is unknown by its biases, and every such n-gram holds a word of telling_words(), so others need no scoring.

Joined lines count where they confirm a family that none of their lines confirms, in place of the lines predicted to be of it.

Defined results: a null or empty text has no paragraphs; repeated rows are kept and get equal results; rows that share a
doc_id but not the text are different documents; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise
from .licence_texts import EVERYDAY, NEIGHBOURS, NOTICES, ORDINARY

CONFIDENT, OVERLAP = 0.5, 0.6
CLASSES = [*NOTICES, "unknown"]
VARIANTS, FOLD, PENALTY, STEPS = 5, 4, 4e-4, 250


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _variants(text: str, rng: np.random.Generator) -> list[list[str]]:
    """The words of a text, whole and with words lost or foreign words around."""
    w = _words(text)
    out = [w]
    for _ in range(VARIANTS):
        v = [x for x in w if rng.random() > 0.1] or w
        out.append(["zq%d" % i for i in rng.integers(0, 9, rng.integers(0, 12))] + v)
    return out


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by proximal gradient steps; the penalty leaves most weights at zero."""
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    rate = 4.0 / max(1.0, float((x**2).sum(1).mean()))
    for _ in range(STEPS):
        g = (_soft(x @ w + b) - y) / len(x)
        w = w - rate * len(CLASSES) * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * len(CLASSES) * PENALTY, 0)
        b -= rate * g.sum(0)
    return w, b


def training_rows() -> list[tuple[list[str], int, bool]]:
    """Words, class and whether the text is held out for calibration."""
    rng, rows = np.random.default_rng(4), []
    for texts, c in [*((t, CLASSES.index(f)) for f, t in NOTICES.items()), (NEIGHBOURS, len(NOTICES)), (ORDINARY, len(NOTICES))]:
        for i, t in enumerate(texts):
            rows += [(v, c, i % FOLD == FOLD - 1) for v in _variants(t, rng)]
    return rows


@lru_cache(1)
def model() -> tuple[dict[str, list[float]], list[float], list[tuple[int, float, int]]]:
    """Weights of every n-gram by class, and the classes' biases, the temperature divided out of both; and of the held-out rows the class
    predicted by the model that has not seen them, its probability, and the true class."""
    rows = training_rows()
    count: dict[str, int] = {}
    for v, _, _ in rows:
        for g in _grams(v):
            count[g] = count.get(g, 0) + 1
    plain = {g for t in ORDINARY for g in _grams(_words(t))}
    # what ordinary sentences hold, and everyday words alone, tell of no family
    vocab = {g: i for i, g in enumerate(sorted(g for g, c in count.items() if c >= 3 and "zq" not in g and g not in plain and not set(g.split()) <= EVERYDAY))}
    x = np.zeros((len(rows), len(vocab)))
    for i, (v, _, _) in enumerate(rows):
        x[i, [vocab[g] for g in _grams(v) if g in vocab]] = 1
    y, test = np.eye(len(CLASSES))[[c for _, c, _ in rows]], np.array([t for _, _, t in rows])
    w, b = fit(x[~test], y[~test])
    z = x[test] @ w + b
    heat = min(np.linspace(0.25, 4, 60), key=lambda h: -np.log(np.maximum(_soft(z / h)[y[test] == 1], 1e-12)).mean())
    p = _soft(z / heat)
    held = [(int(k), float(q), int(t)) for k, q, t in zip(p.argmax(1), p.max(1), y[test].argmax(1), strict=True)]
    w, b = fit(x, y)
    b = np.minimum(b, b[-1] - 0.01 * (np.arange(len(b)) < len(b) - 1))  # without a telling n-gram a paragraph is unknown
    used = {g: [round(float(v), 6) for v in w[i] / heat] for g, i in vocab.items() if np.abs(w[i]).max() > 0}
    return used, [round(float(v), 6) for v in b / heat], held


@lru_cache(1)
def templates() -> list[tuple[str, int, str, int]]:
    """(family, or other for another licence; notice; word pair; pairs of the notice)."""
    out = []
    for f, notices in [*NOTICES.items(), ("other", NEIGHBOURS)]:
        for i, t in enumerate(notices):
            w = _words(t)
            pairs = sorted({" ".join(w[k : k + 2]) for k in range(len(w) - 1)})
            out += [(f, i, p, len(pairs)) for p in pairs]
    return out


def telling_words() -> list[str]:
    """Words of which every paragraph that can be predicted holds one: of each n-gram that speaks for a family, one that is not everyday."""
    tell = {g for g, v in model()[0].items() if max(v[:-1]) > v[-1]}
    words: set[str] = set()
    for g in sorted(tell, key=lambda g: (g.count(" "), g)):
        if not words & set(g.split()):
            words.add(min(g.split(), key=lambda w: (w in EVERYDAY, -len(w), w)))
    return sorted(words)


def _ngrams(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, tie, paragraph (number of the part between blank lines), line (number within it; -1: its lines joined), family,
    probability, overlap, confirmed of all paragraphs predicted to belong to a family."""
    spark = docs.sparkSession
    weights, bias, _ = model()
    w = spark.createDataFrame([(g, v) for g, v in weights.items()], "gram string, w array<double>")
    t = spark.createDataFrame(templates(), "family string, notice int, gram string, pairs int")
    telling = "(?<![a-z0-9])(?:" + "|".join(telling_words()) + ")(?![a-z0-9])"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.lower("text").rlike(telling))
    parts = d.select("doc_id", F.xxhash64("text").alias("tie"), F.posexplode(F.split(F.lower("text"), "\n\\s*\n")).alias("paragraph", "part")).filter(F.col("part").rlike(telling))
    single = parts.select("doc_id", "tie", "paragraph", F.posexplode(F.split("part", "\n")).alias("n", "line")).filter(F.col("line").rlike(telling))
    joined = parts.filter(F.contains("part", F.lit("\n"))).select("doc_id", "tie", "paragraph", F.lit(-1).alias("n"), F.col("part").alias("line"))
    words = F.filter(F.split("line", "[^a-z0-9]+"), lambda x: x != "")
    key = ["doc_id", "tie", "paragraph", "n"]
    grams = F.array_distinct(F.concat(_ngrams(F.col("words"), 1), _ngrams(F.col("words"), 2), _ngrams(F.col("words"), 3)))
    each = single.union(joined).select(*key, words.alias("words")).select(*key, F.explode(grams).alias("gram"))
    # both tables are of fixed size: the model's n-grams and the notices' word pairs. Only n-grams of either go on
    known = w.select("gram").union(t.select("gram")).distinct()
    each = materialise(each.join(F.broadcast(known), "gram", "left_semi").distinct())
    z = each.join(F.broadcast(w), "gram").groupBy(*key).agg(*[(F.sum(F.col("w")[i]) + bias[i]).alias(f"z{i}") for i in range(len(CLASSES))])
    top = F.greatest(*[F.col(f"z{i}") for i in range(len(CLASSES))])
    total = sum((F.exp(F.col(f"z{i}") - top) for i in range(len(CLASSES))), F.lit(0.0))
    family = F.coalesce(*[F.when(F.col(f"z{i}") == top, F.lit(c)) for i, c in enumerate(CLASSES)])
    said = z.select(*key, family.alias("family"), (1 / total).alias("probability")).filter((F.col("family") != "unknown") & (F.col("probability") >= CONFIDENT))
    share = each.join(F.broadcast(t), "gram").groupBy(*key, "family", "notice").agg((F.count("gram") / F.first("pairs")).alias("share"))
    held = share.groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("family") == f, F.col("share"))), F.lit(0.0)).alias(f"o_{f}") for f in [*NOTICES, "other"]])
    same = F.col("s.doc_id").eqNullSafe(F.col("h.doc_id"))
    for k in key[1:]:
        same = same & (F.col(f"s.{k}") == F.col(f"h.{k}"))
    own = F.coalesce(*[F.when(F.col("family") == f, F.col(f"h.o_{f}")) for f in NOTICES], F.lit(0.0))
    rest = F.coalesce(*[F.when(F.col("family") == f, F.greatest(*[F.col(f"h.o_{g}") for g in [*NOTICES, "other"] if g != f])) for f in NOTICES], F.lit(0.0))
    out = said.alias("s").join(held.alias("h"), same, "left").select("s.*", own.alias("overlap"), ((own >= OVERLAP) & (own > rest)).alias("confirmed"))
    part = Window.partitionBy("doc_id", "tie", "paragraph", "family")
    whole = F.col("n") < 0
    by_line, by_part = F.max(F.col("confirmed") & ~whole).over(part), F.max(F.col("confirmed") & whole).over(part)
    out = out.withColumn("take", whole == (by_part & ~by_line)).filter("take")
    return out.select("doc_id", "tie", "paragraph", F.col("n").alias("line"), "family", "probability", "overlap", "confirmed")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: predicted and confirmed paragraphs, and the confirmed families."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = paragraphs(docs).groupBy("doc_id", "tie").agg(F.count("family").alias("n_predicted"), F.count_if("confirmed").alias("n_confirmed"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie")).alias("d")
    out = d.join(p.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.tie") == F.col("p.tie")), "left")
    return out.select("d.doc_id", F.coalesce("p.n_predicted", F.lit(0)).alias("n_predicted"), F.coalesce("p.n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("p.families", F.lit("")).alias("families"))


def op4_sql() -> str:
    """The trained tables stand in the SQL as values; it scores every line and every part, so it also checks that telling_words() loses none."""
    weights, bias, _ = model()
    w = ", ".join(f"('{g}', {v})" for g, v in weights.items())
    t = ", ".join(f"('{f}', {i}, '{g}', {n})" for f, i, g, n in templates())
    z = ", ".join(f"sum(w[{i + 1}]) + {b} AS z{i}" for i, b in enumerate(bias))
    zs = [f"z{i}" for i in range(len(CLASSES))]
    top = f"greatest({', '.join(zs)})"
    family = "CASE " + " ".join(f"WHEN z{i} = {top} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
    return f"""
WITH w(gram, w) AS (VALUES {w}), t(family, notice, gram, pairs) AS (VALUES {t}),
b AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\n\\s*\\n')) AS part, unnest(range(len(string_split_regex(lower(text), '\\n\\s*\\n')))) AS p FROM documents),
l AS (SELECT doc_id, p, unnest(string_split(part, chr(10))) AS line, unnest(range(len(string_split(part, chr(10))))) AS n FROM b UNION ALL SELECT doc_id, p, part, -1 FROM b WHERE contains(part, chr(10))),
v AS (SELECT doc_id, p, n, list_filter(regexp_split_to_array(line, '[^a-z0-9]+'), lambda x: x <> '') AS s FROM l),
g AS (SELECT DISTINCT doc_id, p, n, unnest(list_concat(s, list_transform(range(1, len(s)), lambda i: array_to_string(s[i:i + 1], ' ')), list_transform(range(1, len(s) - 1), lambda i: array_to_string(s[i:i + 2], ' ')))) AS gram FROM v),
z AS (SELECT doc_id, p, n, {z} FROM g JOIN w USING (gram) GROUP BY doc_id, p, n),
c AS (SELECT doc_id, p, n, {family} AS family, 1 / ({' + '.join(f'exp({x} - {top})' for x in zs)}) AS probability FROM z),
h AS (SELECT doc_id, p, n, family, max(share) AS overlap FROM (SELECT doc_id, p, n, family, notice, count(*) / any_value(pairs) AS share FROM g JOIN t USING (gram) GROUP BY doc_id, p, n, family, notice) GROUP BY ALL),
s AS (SELECT c.doc_id, c.p, c.n, c.family, coalesce(max(overlap) FILTER (h.family = c.family), 0) AS own, coalesce(max(overlap) FILTER (h.family <> c.family), 0) AS rest
  FROM c LEFT JOIN h ON c.doc_id = h.doc_id AND c.p = h.p AND c.n = h.n WHERE c.family <> 'unknown' AND probability >= {CONFIDENT} GROUP BY ALL),
k AS (SELECT *, own >= {OVERLAP} AND own > rest AS confirmed FROM s),
o AS (SELECT *, bool_or(confirmed AND n >= 0) OVER q AS by_line, bool_or(confirmed AND n < 0) OVER q AS by_part FROM k WINDOW q AS (PARTITION BY doc_id, p, family)),
r AS (SELECT doc_id, count(*) AS n_predicted, count(*) FILTER (confirmed) AS n_confirmed, string_agg(DISTINCT family, ',' ORDER BY family) FILTER (confirmed) AS families FROM o WHERE (n < 0) = (by_part AND NOT by_line) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(families, '') AS families FROM documents d LEFT JOIN r USING (doc_id)
"""
