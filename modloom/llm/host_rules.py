"""Quality rules at the level of hosts, in DataFrame functions alone.

Each document is measured once: words, characters in them, symbols, repeated lines, words in repeated runs of three. RULES judge the
measures. Failures of each rule are added up by host; a host's rates are shrunk towards those of all hosts by a beta prior fitted
to the hosts (moments of the beta-binomial distribution, so that hosts of few documents neither pass nor fail by chance), and a host of
which more than `reject` of the documents are thought to fail some rule is rejected. The verdict goes back to the documents by a
join in which hosts beyond a fair share of the rows are dealt over tasks.

A run of three words is found again by sorting a text's runs: linear space and n log n time in one text. All sums are of whole
numbers, so every partitioning gives the same rates.

Defined results: a null text has no words and fails as short; a null host is the host ''; repeated rows count each and get equal
results; a null doc_id is a document like others; an empty table gives no rows; columns other than doc_id, text and the host column are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .joins import share_join

WORD = r"[^\x20\x09-\x0D]+"
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Words of a run, least words of a document.
RUN, LEAST_WORDS = 3, 50
#: The rules, on the columns of `measure`; the first two are the base rules.
RULES: dict[str, str] = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
BASE = ("short", "repeats")
#: A host is rejected where its shrunk rate of documents that fail some rule is above this.
REJECT = 0.5
#: Bounds of the share of variance that lies between hosts: the prior weighs from about 0.01 to 9,999 documents.
LEAST_RHO, MOST_RHO = 0.0001, 0.99


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a run of RUN words found twice or more, first ones included."""

    def covered(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: F.struct(F.concat_ws(" ", *[w[i + k] for k in range(RUN)]).alias("run"), i.alias("at")))

        def starts(s: Column) -> Column:
            rest = F.size(s) - 1
            return F.flatten(F.filter(F.zip_with(F.slice(s, F.lit(1), rest), F.slice(s, F.lit(2), rest), lambda a, b: F.when(a["run"] == b["run"], F.array(a["at"], b["at"]))), lambda x: x.isNotNull()))

        again = _let(F.sort_array(runs), starts)
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda p: F.array(*[p + k for k in range(RUN)])))))

    return F.when(F.size(words) > RUN, covered(words)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, host and the measures (long)."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col in docs.columns else F.lit("")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("again")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    length = lambda c: F.length(c).cast("long")
    out = rows.select("doc_id", "host", of_words.alias("w"), of_lines.alias("l"), length(F.translate("text", SPACES, "")).alias("word_chars"), (length("text") - length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"))
    return out.select("doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.again").alias("n_dup_lines"), F.col("w.again").alias("n_repeat_words"))


def judge(measured: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """measured with a boolean column fails_<rule> for each rule, and fails_any."""
    rules = RULES if rules is None else rules
    out = measured.withColumns({f"fails_{k}": F.expr(v) for k, v in rules.items()})
    return out.withColumn("fails_any", F.expr(" OR ".join(f"fails_{k}" for k in rules)))


def shrunk(hosts: DataFrame, failures: str, n: str = "n_docs") -> DataFrame:
    """hosts (a row each, columns n and failures) with rate_<failures>: failures by documents under a beta prior fitted to all hosts.

    With N documents and X failures in K hosts, the hosts' sum of squares S = sum(x^2 / n) - X^2 / N is expected to be
    m (1 - m) ((K - 1) + rho (N - sum(n^2) / N - (K - 1))), m = X / N: this gives rho, and the prior's weight (1 - rho) / rho."""
    big = "decimal(38,0)"
    x, k = F.col(failures).cast("decimal(18,0)"), F.col(n).cast("decimal(18,0)")
    whole = hosts.agg(
        F.sum(n).alias("N"), F.sum(failures).alias("X"), F.count(F.lit(1)).alias("K"),
        F.sum((k * k).cast(big)).cast("double").alias("NN"), F.sum(F.floor(F.col(failures).cast("double") * F.col(failures) / F.col(n) * 1000).cast(big)).cast("double").alias("Q"),
    ).first()
    weight, mean = prior(whole["N"] or 0, whole["X"] or 0, whole["K"], whole["NN"] or 0.0, whole["Q"] or 0.0)
    rate = (x.cast("double") + F.lit(mean * weight)) / (k.cast("double") + F.lit(weight))
    return hosts.withColumn(f"rate_{failures}", rate)


def prior(n: int, x: int, k: int, nn: float, q: float) -> tuple[float, float]:
    """The prior's weight in documents and its mean, from the sums of `shrunk` (q is 1,000 times the sum of x^2 / n)."""
    if not n:
        return 1.0, 0.0
    mean = x / n
    spread, room = mean * (1 - mean), n - nn / n - (k - 1)
    rho = ((q / 1000 - x * mean) / spread - (k - 1)) / room if spread > 0 and room > 0 else LEAST_RHO
    rho = min(max(rho, LEAST_RHO), MOST_RHO)
    return (1 - rho) / rho, mean


def by_host(judged: DataFrame, rules: dict[str, str] | None = None, reject: float = REJECT) -> DataFrame:
    """(host, n_docs, fails_<rule> counts, rate_fails_<rule>, rejected): a row for each host, written to the shared folder."""
    names = [f"fails_{k}" for k in (RULES if rules is None else rules)] + ["fails_any"]
    hosts = materialise(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(c)).alias(c) for c in names]))
    for c in names:
        hosts = shrunk(hosts, c)
    return materialise(hosts.withColumn("rejected", F.col("rate_fails_any") > reject))


def filter_hosts(docs: DataFrame, host_col: str = "source", reject: float = REJECT) -> DataFrame:
    """Per row of docs: doc_id, host, the measures, fails_<rule>, base_failed, the host's n_docs and shrunk rate, and kept."""
    judged = materialise(judge(measure(docs, host_col)))
    hosts = by_host(judged, reject=reject)
    verdicts = hosts.select("host", "n_docs", F.col("rate_fails_any").alias("host_rate"), "rejected")
    out = share_join(judged, verdicts, "host", "doc_id", hosts, "n_docs")
    base = F.expr(" OR ".join(f"fails_{k}" for k in BASE))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_hosts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", F.col("n_docs").alias("host_docs"), F.round("host_rate", 6).alias("host_rate"), F.col("rejected").alias("host_rejected"))


#: The same measures, sums and rates, for DuckDB.
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a, w FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d)),
g AS (SELECT r, i, list_slice(w, i, i + 2) AS run FROM w WHERE i + 2 <= len(w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT doc_id, host, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
j AS (SELECT *, {" OR ".join(f"({RULES[k]})" for k in BASE)} AS base_failed, {" OR ".join(f"({v})" for v in RULES.values())} AS bad FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (bad) AS x FROM j GROUP BY host),
s AS (SELECT sum(n)::DOUBLE AS n, sum(x)::DOUBLE AS x, count(*) AS k, sum(n::HUGEINT * n)::DOUBLE AS nn, sum(floor(x::DOUBLE * x / n * 1000)::HUGEINT)::DOUBLE AS q FROM h),
o AS (SELECT *, x / n AS mean, CASE WHEN x > 0 AND x < n AND n - nn / n - (k - 1) > 0
  THEN ((q / 1000 - x * (x / n)) / (x / n * (1 - x / n)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE {LEAST_RHO} END AS rho FROM s),
p AS (SELECT mean, (1 - least(greatest(rho, {LEAST_RHO}), {MOST_RHO})) / least(greatest(rho, {LEAST_RHO}), {MOST_RHO}) AS weight FROM o),
v AS (SELECT host, n, (x + mean * weight) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > {REJECT} AS kept, n_lines, n AS host_docs,
  round(rate, 6) AS host_rate, rate > {REJECT} AS host_rejected
FROM j JOIN v USING (host)
"""
