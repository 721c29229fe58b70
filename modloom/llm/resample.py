"""Importance resampling of a corpus towards a target, with identical texts collapsed.

Texts are grouped in full; each distinct text is split into words, and its features (runs of 1 to `most` words) into hashed buckets
once, which are written. Bucket counts of the corpus are those of the distinct texts times their copies; with the target's counts they give each
bucket its gain, a log ratio in thousandths. A distinct text's weight is the sum of its features' gains. Weights go back to the
documents by a join on the text's digest, in which texts with more copies than a fair share of the rows are dealt over tasks. Only
then comes noise, from a digest of the document's id; the highest scores are the sample (Gumbel's top k, drawing without replacement).
What the driver holds is the table of gains: `buckets` numbers.

Defined results: a null or empty text has no features and weight 0; a null doc_id is hashed as '' and comes after all others among equal
scores; repeated rows are kept and take places one after the other; empty tables (documents, target) give no rows and gains from the
other's counts; columns other than doc_id and text are ignored. A target text that is null has no features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, text_of
from .joins import numbered, share_join

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Production parameters: words of a feature, buckets, the seed, percent of the documents with `LEAST_WORDS` words that are drawn.
MOST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, "2024", 10, 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(text: Column, most: int = MOST, buckets: int = BUCKETS) -> Column:
    """(n_words, buckets of all runs of 1 to `most` words, repeats included)."""

    def runs(w: Column, k: int) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *[w[i + j] for j in range(k)]))
        return F.when(F.size(w) >= k, run).otherwise(F.array().cast("array<string>"))

    def of(w: Column) -> Column:
        found = F.concat(w, *[runs(w, k) for k in range(2, most + 1)]) if most > 1 else w
        hashed = F.transform(found, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))
        return F.struct(F.size(w).alias("n_words"), hashed.alias("buckets"))

    return F.transform(F.array(words(text)), of)[0]


def _counts(rows: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs: rows has the columns buckets and copies. `buckets` numbers at most come back."""
    each = rows.select(F.explode("buckets").alias("bucket"), "copies").groupBy("bucket").agg(F.sum("copies").alias("n"))
    out = [0] * buckets
    for r in each.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    n, s, t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus, target, strict=True)]


def weigh(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """Per row of docs: doc_id, tie (the text's digest), n_words, n_features, weight."""
    rows = text_of(docs)
    collapsed = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    f = features(F.col("text"), most, buckets)
    distinct = materialise(collapsed.select(F.unhex(F.sha2("text", 256)).alias("tie"), "copies", f.alias("f")).select("tie", "copies", "f.n_words", "f.buckets"))
    wanted = target.select(f.alias("f")).select("f.buckets", F.lit(1).cast("long").alias("copies"))
    table = gains(_counts(distinct, buckets), _counts(wanted.filter(F.col("buckets").isNotNull()), buckets))
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")  # one constant in the plan
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    weights = materialise(distinct.select("tie", "copies", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")))
    discard(distinct)
    keyed = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("tie"))
    return share_join(keyed, weights.drop("copies"), "tie", "doc_id", weights, "copies", "inner")


def draw(weighed: DataFrame, seed: str = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed with score and rank (null where not drawn)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= least_words)
    quota = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    places = numbered(able, order, "rank").withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(rest)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return draw(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


#: The same over all rows, for DuckDB: crc32 of each distinct word byte by byte.
OP13_SQL = f"""
WITH RECURSIVE z(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM z WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS f FROM benchmark),
e AS (SELECT r, unnest(w) AS f FROM d),
dw AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM e UNION SELECT f FROM b)),
hw AS (SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT),
  lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS k FROM dw, crc),
s AS (SELECT k, count(*) AS n FROM e JOIN hw USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN hw USING (f) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM e) + {BUCKETS}) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + {BUCKETS}))))::BIGINT AS gain
  FROM (SELECT range AS k FROM range({BUCKETS})) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
w AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM e JOIN hw USING (f) JOIN g USING (k) GROUP BY r),
c AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score,
  coalesce(weight, 0) AS weight FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(place) * {PERCENT} // 100 FROM o) THEN place END AS rank FROM o
"""
