"""How the sources of a language differ in their words: distances of all pairs, and each source's 50 most over-used terms.

Words are counted once by (language, source, term), with the number of documents that hold them: in Arrow batches within tasks,
which pass on sums of what they hold, a bounded number of terms, then in one aggregation. A language keeps the terms of
at least `least_docs` documents. The postings (kept terms of a group with a count above 0) are written and are all that later steps read.

Pairs: a distance is a sum over all kept terms, of which most groups have few. Terms that one group lacks have a probability there that
depends on the group alone (its floor), so a distance is a sum over each group's own terms against the other's floor, taken from the
group's counts, plus a correction for the terms that both have, which come from the postings joined by term.

Terms: a group's postings fall into count buckets (exact counts to 63, then 32 to a doubling: at most about 2,000 a group). Within a
bucket the largest count and the least probability that the language gives a term bound f from above. Buckets are evaluated best first, some more for
each round; a group is done when the bound of its best unseen bucket is strictly below its 50th value (or no f above 0 is left). A
round moves only postings of the buckets it evaluates; a group's best 50 are kept by partial limits.

Whole numbers throughout: a floor of 10^9 * a / b is taken in two steps that stay within 64 bits while b is below 9 * 10^13.

Defined results: null text, lang or source are ''; a group without kept terms takes part in pairs with the floors of an empty group, and
in no terms; a language without kept terms has distances of 0; repeated rows count each; null and equal doc_ids do not matter; an
empty table gives no rows; columns other than text, lang and source are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import discard, lean, materialise
from .joins import share_join

#: Bytes as a term has them: A-Z folded, letters and all bytes of other characters kept, what parts terms as a space.
FOLD = bytes(i + 32 if chr(i) in ascii_uppercase else i if i >= 128 or chr(i) in ascii_lowercase else 32 for i in range(256))
#: Terms that a Python task holds before it passes their sums on.
HELD = 1 << 18
LEAST_DOCS, SMOOTH, TOP = 30, 5, 50
#: Postings of a term that one task pairs with all others of the term; pairs of groups that one task makes.
PER_TASK = 256
#: Terms that the first round evaluates for each group; each further round takes GROWTH times as many in all.
FIRST, GROWTH = 4 * TOP, 8


def probability(count: Column, total: Column, terms: Column, smooth: int = SMOOTH) -> Column:
    """1 + floor(10^9 * (count + smooth) / (total + smooth * terms)), by long division in two steps."""
    high, below = (count + smooth) * 100_000, F.greatest(total + terms * smooth, F.lit(1).cast("long"))
    return F.call_function("div", high, below) * 10_000 + F.call_function("div", (high % below) * 10_000, below) + 1


def bucket(count: Column) -> Column:
    """The count itself up to 63, beyond that its leading six bits and their place: grows with the count."""
    shift = F.greatest(F.length(F.bin(count)) - 6, F.lit(0))
    return shift.cast("long") * 64 + F.call_function("shiftright", count, shift)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) to (lang, source, term, n, docs): sums over what came since the last rows; HELD terms at most are kept."""
    kept: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in lean("source_audit", batches):
        for i in range(len(batch)):
            text = (batch.column(2)[i].as_py() or b"").translate(FOLD)
            n, docs = kept.setdefault((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in _parts(text):
                words = part.split()
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in kept.values()) > HELD:
            yield from _told(kept)
            kept.clear()
    yield from _told(kept)


def _parts(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about `size`, cut at spaces."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _told(kept: dict[tuple[str, str], tuple[Counter, Counter]], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in kept.items():
        terms = list(n)
        for i in range(0, len(terms), rows):
            some = terms[i : i + rows]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, lead): counts of the kept terms by group and language; lead is 1 in one row of each (lang, term)."""
    common.ship(docs.sparkSession)
    each = _grouped(docs, F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts = each.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    seen = counts.select("*", F.sum("docs").over(of_term).alias("lang_docs"), F.sum("n").over(of_term).alias("lang_n"), F.min("source").over(of_term).alias("first"))
    return seen.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first")).cast("long").alias("lead"))


def _grouped(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), *more)


def groups(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """A row for each (lang, source) that occurs: g (both), total and terms (own postings), lang_total, kept (terms of the language),
    floor (its probability of a term that it lacks), n_groups of the language."""
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    of_lang = posts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("lead").alias("kept"))
    there = _grouped(docs).distinct()
    sizes = there.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    zero = F.lit(0).cast("long")
    out = there.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").join(sizes, "lang").na.fill(0, ["total", "terms", "lang_total", "kept"])
    return out.select(F.struct("lang", "source").alias("g"), "*", probability(zero, F.col("total"), F.col("kept")).alias("floor"))


def _all_against_all(left: DataFrame, right: DataFrame, on: list[str], size: str, by: str) -> DataFrame:
    """left joined with right on keys that both hold `size` rows of: left's are dealt over shares of about PER_TASK rows, right's go to each."""
    shares = F.ceil(F.col(size) / F.lit(PER_TASK)).cast("int")
    return left.withColumn("share", F.pmod(F.xxhash64(by), shares).cast("int")).drop(size).join(right.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop(size), [*on, "share"]).drop("share")


def distances(known: DataFrame, scored: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all pairs of groups of a language, from `groups` and from postings with p."""
    a = known.select("lang", F.col("source").alias("a"), "n_groups", F.col("floor").alias("floor_a"), F.col("terms").alias("terms_a"), "kept")
    b = known.select("lang", F.col("source").alias("b"), "n_groups", F.col("floor").alias("floor_b"), F.col("terms").alias("terms_b"))
    pairs = _all_against_all(a, b, ["lang"], "n_groups", "a").filter("a <> b")
    # each group's own terms against the floors of the others: running sums over its probabilities and their floors in one order
    of_group = scored.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    events = of_group.select("lang", "a", "at", "n", (F.col("n") * F.col("at")).alias("s"), F.lit(None).cast("string").alias("b")).unionByName(pairs.select("lang", "a", F.col("floor_b").alias("at"), none.alias("n"), none.alias("s"), "b"))
    group = W.partitionBy("lang", "a").orderBy("at", F.col("b").asc_nulls_first())
    so_far = group.rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = scored.groupBy("lang", F.col("source").alias("a")).agg(F.sum("p").alias("p_sum"))
    below = events.select("lang", "a", "b", "at", F.sum("n").over(so_far).alias("n"), F.sum("s").over(so_far).alias("s")).filter(F.col("b").isNotNull())
    own = below.select("lang", "a", "b", ((F.col("at") * F.col("n") - F.col("s")) * 2).alias("value"))
    rest = pairs.join(sums, ["lang", "a"], "left").select("lang", "a", "b", (F.coalesce("p_sum", none) - F.col("terms_a") * F.col("floor_b") + F.when(F.col("a") < F.col("b"), (F.col("kept") - F.col("terms_a") - F.col("terms_b")) * F.abs(F.col("floor_a") - F.col("floor_b"))).otherwise(none)).alias("value"))
    # terms of both: what was added for them above goes, their real difference comes
    mine = scored.select("lang", "term", "n_sources", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("floor").alias("floor_a"))
    theirs = scored.select("lang", "term", "n_sources", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("floor").alias("floor_b"))
    both = _all_against_all(mine, theirs, ["lang", "term"], "n_sources", "a").filter("a < b")
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    shared = both.groupBy("lang", "a", "b").agg(F.sum(gap("p_a", "p_b") - gap("p_a", "floor_b") - gap("floor_a", "p_b") + gap("floor_a", "floor_b")).alias("value"))
    parts = own.unionByName(rest).unionByName(shared).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    whole = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return whole.select("lang", "value", F.inline(sides)).select("lang", "source", "item", "value")


def top_terms(scored: DataFrame, top: int = TOP, first: int = FIRST) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms of the largest f = p - q above 0, from postings with p, q and bucket."""
    key = ["lang", "source"]
    size = scored.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"), (F.max("p") - F.min("q")).alias("bound")).filter("bound > 0")
    best_first = W.partitionBy(*key).orderBy(F.col("bound").desc(), "bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = materialise(size.withColumn("before", F.sum("n").over(best_first) - F.col("n")))
    in_order = W.partitionBy(*key).orderBy(F.col("value").desc(), "item")
    seen, upto, active, best, settled = 0, first, None, None, []
    while True:
        open_buckets = buckets if active is None else buckets.join(active, key, "left_semi")
        due = open_buckets.filter((F.col("before") >= seen) & (F.col("before") < upto)).select(*key, "bucket")
        found = scored.join(due, [*key, "bucket"], "left_semi").select(*key, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).filter("value > 0")
        if best is not None:
            found = found.unionByName(best.join(active, key, "left_semi").drop("rank"))
        now = materialise(found.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= top))
        kth = now.filter(F.col("rank") == top).select(*key, F.col("value").alias("kth"))
        unseen = open_buckets.filter(F.col("before") >= upto).groupBy(*key).agg(F.max("bound").alias("bound"))
        left = materialise(unseen.join(kth, key, "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select(*key))
        settled.append(now.join(left, key, "left_anti"))
        if not left.limit(1).count():
            break
        seen, upto, active, best = upto, upto * GROWTH, left, now
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair`, all other sources by distance; `term`, the most over-used terms."""
    raw = materialise(postings(docs, least_docs))
    known = materialise(groups(docs, raw))
    n_sources = F.count(F.lit(1)).over(W.partitionBy("lang", "term"))
    said = raw.select(F.struct("lang", "source").alias("g"), "term", "n", "lang_n", n_sources.alias("n_sources"))
    facts = known.select("g", "total", "kept", "lang_total", "floor")
    joined = share_join(said, facts, "g", "term", known.filter("terms > 0"), "terms", "inner")
    p, q = probability(F.col("n"), F.col("total"), F.col("kept")), probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    scored = materialise(joined.select("g.lang", "g.source", "term", "n_sources", "floor", bucket(F.col("n")).alias("bucket"), p.alias("p"), q.alias("q")))
    discard(raw)
    apart = distances(known, scored)
    in_order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(in_order).alias("rank"))
    terms = top_terms(scored, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The definition over the dense table of groups and kept terms, for DuckDB.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total, sum(lang_n) AS lang_total, count(*) AS v FROM dense GROUP BY lang, source),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + {SMOOTH}) // (total + {SMOOTH} * v) AS p, 1 + 1000000000::HUGEINT * (lang_n + {SMOOTH}) // (lang_total + {SMOOTH} * v) AS q FROM dense JOIN s USING (lang, source)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
