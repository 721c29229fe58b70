"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Three base patterns give spans (leftmost, non-overlapping per kind). A fourth kind, `opaque`, proposes long mixed strings
that no base span touches. Every value is hashed; hashes are aggregated by distinct owners and repositories over the whole
corpus. A value that at least EXAMPLE_OWNERS owners carry is a copied example (`example`). Of the owner-specific ones, a value
that does not look live (short, of few different characters, or holding a placeholder's word) is a `dummy`; one that stands in
at least SHARED_REPOS repositories for each of its owners is `shared` (an owner's credential in many places); the rest is `live`.
Base spans stay whatever their class; an opaque span is added only where its value is live or shared.

Positions come from the pieces between matches: the start of match i is the length of all pieces and matches before it,
summed in blocks of blocks. Spans of one kind are in order and apart, so a span meets those of another kind by binary search, and
a text is redacted from pieces that are joined once: texts with very many matches stay cheap.

Defined results: a null text counts as empty, a null owner as one owner of its own; repeated rows are kept and get equal
results (they count once as a repository); an empty table gives no rows; columns other than doc_id, text and the owner
column are ignored by the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .joins import share_join

#: The base patterns, in the order in which kinds are listed, and the kind that the method adds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Values that at least so many owners hold are copied examples; repositories for each owner that make a value a shared one.
EXAMPLE_OWNERS, SHARED_REPOS = 3, 20
#: Words of placeholders; characters, and different ones, of a value that looks live.
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567"
LIVE_LENGTH, LIVE_DISTINCT = 8, 5
#: Matches of a block, and blocks of an upper block, whose sums give positions; code points of a piece of a text that is cut.
BLOCK, PIECE = 64, 1024
SPAN = "array<struct<kind:int,start:long,end:long,value:string>>"


def _matches(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 1) -> Column:
    """Spans of all matches whose value has `least` characters; counted in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    sizes = F.transform(whole, lambda m: F.length(m).cast("long"))
    s = F.struct(whole.alias("whole"), values.alias("values"), gaps.alias("gaps"), F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), sizes, lambda g, m: g + m).alias("steps"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def sums(a: Column) -> Column:
        """The sums of runs of BLOCK numbers."""
        n = F.ceil(F.size(a) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda b: total(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))

    def before(a: Column, i: Column) -> Column:
        """The sum of those of the first i numbers that stand in the i-th one's block."""
        return total(F.slice(a, (F.floor(i / F.lit(BLOCK)) * BLOCK + 1).cast("int"), (i % BLOCK).cast("int")))

    def upper(x: Column) -> Column:
        return F.struct(x["values"].alias("values"), x["whole"].alias("whole"), x["gaps"].alias("gaps"), x["steps"].alias("steps"), x["blocks"].alias("blocks"), sums(x["blocks"]).alias("tops"))

    def spans(x: Column) -> Column:
        y = F.struct(x["values"].alias("values"), x["whole"].alias("whole"), x["gaps"].alias("gaps"), x["steps"].alias("steps"), sums(x["steps"]).alias("blocks"))

        def span(y: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                b = F.floor(i / F.lit(BLOCK)).cast("int")
                start = total(F.slice(y["tops"], F.lit(1), F.floor(b / F.lit(BLOCK)).cast("int"))) + before(y["blocks"], b) + before(y["steps"], i) + F.element_at(y["gaps"], i + 1)
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.element_at(y["values"], i + 1).alias("value"))

            return F.filter(F.transform(y["whole"], one), lambda r: F.length(r["value"]) >= least)

        return F.transform(F.transform(F.array(y), upper), span)[0]

    return F.transform(F.array(s), spans)[0]


def _spans(text: Column) -> Column:
    """All candidate spans of a text; texts without a candidate cost four pattern searches and no more."""
    none = F.lit(None).cast(SPAN)
    base = [
        F.when(text.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), _matches(text, ASSIGN, 0, 2, 6)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, 1)).otherwise(none),
        F.when(text.rlike(HEX), _matches(text, HEX, 2)).otherwise(none),
    ]
    base = [F.coalesce(b, F.array().cast(SPAN)) for b in base]
    more = F.when(text.rlike(OPAQUE), _matches(text, OPAQUE, 3)).otherwise(none)
    more = F.filter(F.coalesce(more, F.array().cast(SPAN)), lambda r: r["value"].rlike("[0-9]") & r["value"].rlike("[A-Z]") & r["value"].rlike("[a-z]"))

    def untouched(x: Column) -> Column:
        apart = lambda r: reduce(and_, [_last_end(x[f"k{k}"], lambda b: b["start"] < r["end"]) <= r["start"] for k in range(3)])
        return F.concat(x["k0"], x["k1"], x["k2"], F.filter(x["more"], apart))

    return F.transform(F.array(F.struct(*[b.alias(f"k{k}") for k, b in enumerate(base)], more.alias("more"))), untouched)[0]


def _last_end(spans: Column, holds: Callable[[Column], Column]) -> Column:
    """The end of the last span for which `holds`, 0 without one, by binary search: spans are in order and apart, and `holds` is true
    of the first ones alone."""
    state = "struct<low:int,high:int>"

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"] + 1) / F.lit(2)).cast("int")
        open_ = a["low"] < a["high"]
        yes = open_ & F.when(open_, holds(F.get(spans, mid - 1)))
        return F.struct(F.when(yes, mid).otherwise(a["low"]).alias("low"), F.when(open_ & ~yes, mid - 1).otherwise(a["high"]).alias("high")).cast(state)

    first = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")).cast(state)
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(spans))))
    return F.aggregate(steps, first, step, lambda a: F.coalesce(F.get(spans, a["low"] - 1)["end"], F.lit(0).cast("long")))


def _looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_LENGTH) & (distinct >= LIVE_DISTINCT) & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, shared_repos: int = SHARED_REPOS) -> DataFrame:
    """Per row of docs: doc_id, tie (hash of its text), spans (kind, start, end, value, n_owners, n_repos, class), ordered by start and kind."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col in docs.columns else F.lit("")
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), repo.alias("repo"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # what the patterns find is written once and read by the counts and the join; the result reads it, so it stays until the end
    rows = materialise(d.select("doc_id", "owner", "repo", F.xxhash64("text").alias("tie"), _spans(F.col("text")).alias("found")))
    hits = rows.filter(F.size("found") > 0)
    each = hits.select("doc_id", "tie", "owner", "repo", F.explode("found").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    # distinct (hash, owner, repo) first: partial sums before each exchange keep a hot value from one task
    n_repos = each.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_repos"))
    n_owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_owners"))
    places = each.select("doc_id", "tie", "s", "hash").distinct()
    seen = materialise(n_owners.join(n_repos, "hash").join(places.groupBy("hash").agg(F.count("s").alias("n_places")), "hash"))
    judged = (
        share_join(places.withColumn("by", F.xxhash64("doc_id", "tie", "s.start")), seen.drop("n_places"), "hash", "by", seen, "n_places", "inner")
        .withColumn("class", F.when(F.col("n_owners") >= example_owners, "example").when(~_looks_live(F.col("s.value")), "dummy").when(F.col("n_repos") >= shared_repos * F.col("n_owners"), "shared").otherwise("live"))
        .filter((F.col("s.kind") < 3) | F.col("class").isin("live", "shared"))
    )
    per_doc = judged.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), "n_owners", "n_repos", "class"))).alias("spans"))
    out = rows.select(F.col("doc_id"), F.col("tie")).alias("r").join(per_doc.alias("p"), F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.tie") == F.col("p.tie")), "left")
    return out.select("r.doc_id", "r.tie", "p.spans")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda r: F.concat(F.element_at(names, r["kind"] + 1), F.lit(":"), r["start"].cast("string"), F.lit(":"), r["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    spans = F.coalesce(F.col("spans"), F.expr("array()").cast("array<struct<start:long,kind:int,end:long,value:string,n_owners:long,n_repos:long,class:string>>"))
    found = found.select("doc_id", spans.alias("s"))
    n = lambda test: F.size(F.filter("s", test)).cast("long")
    return found.select(
        "doc_id",
        n(lambda r: r["kind"] == 0).alias("n_assign"),
        n(lambda r: r["kind"] == 1).alias("n_access"),
        n(lambda r: r["kind"] == 2).alias("n_hex"),
        F.sha2(_listed(F.filter("s", lambda r: r["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
        n(lambda r: r["class"] == "live").alias("n_live"),
        n(lambda r: r["class"] == "shared").alias("n_shared"),
        n(lambda r: r["class"] == "dummy").alias("n_dummy"),
        n(lambda r: r["class"] == "example").alias("n_example"),
        F.coalesce(F.array_max(F.transform("s", lambda r: r["n_owners"])), F.lit(0).cast("long")).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("s", lambda r: r["n_repos"])), F.lit(0).cast("long")).alias("most_repos"),
    )


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the mark of its first one: what stands between the runs is cut from
    pieces of PIECE code points, not from the text's beginning, and all is joined once."""
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))

    def of_kind(k: int) -> Column:
        return F.filter(spans, lambda r: r["kind"] == k).alias(f"k{k}")

    x = F.struct(spans.alias("all"), pieces.alias("pieces"), F.length(text).cast("long").alias("size"), F.array_max(F.transform(spans, lambda r: r["end"])).alias("last"), *map(of_kind, range(len(KINDS))))

    def cut(x: Column, start: Column, end: Column) -> Column:
        at = F.floor(start / F.lit(PIECE)).cast("int")
        some = F.slice(x["pieces"], at + 1, F.floor(end / F.lit(PIECE)).cast("int") - at + 1)
        return F.substring(F.array_join(some, ""), (start % PIECE + 1).cast("int"), (end - start).cast("int"))

    def joined(x: Column) -> Column:
        def reached(r: Column) -> Column:
            """The furthest end of the spans that stand before r."""

            def before(k: int) -> Column:
                return _last_end(x[f"k{k}"], lambda b: (b["start"] < r["start"]) | ((b["start"] == r["start"]) & (F.lit(k) < r["kind"])))

            ends = map(before, range(len(KINDS)))
            return F.struct(F.greatest(*ends).alias("pos"), r["start"].alias("start"), r["class"].alias("class"))

        heads = F.filter(F.transform(x["all"], reached), lambda h: h["pos"] <= h["start"])
        tag = lambda h: F.when(h["class"].isin("live", "shared"), F.lit("<secret>")).otherwise(F.lit("<example>"))
        parts = F.transform(heads, lambda h: F.concat(cut(x, h["pos"], h["start"]), tag(h)))
        return F.concat(F.array_join(parts, ""), cut(x, x["last"], x["size"]))

    return F.transform(F.array(x), joined)[0]


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced in its text: <secret> for live and shared values, <example> for copied ones and dummies; all rows and columns stay, n_chars follows."""
    found = scan(docs).filter(F.col("spans").isNotNull()).dropDuplicates(["doc_id", "tie"])
    f = found.select(F.col("doc_id").alias("__modloom_id"), F.col("tie").alias("__modloom_tie"), F.col("spans").alias("__modloom_spans"))
    d = docs.withColumn("__modloom_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    d = d.join(f, F.col("doc_id").cast("long").eqNullSafe(F.col("__modloom_id")) & (F.col("__modloom_hash") == F.col("__modloom_tie")), "left")
    clean = _redacted(F.col("text"), F.col("__modloom_spans"))
    out = d.withColumn("text", F.when(F.col("__modloom_spans").isNotNull(), clean).otherwise(F.col("text"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: What the patterns, positions and frequencies give, for DuckDB.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, owner, text, 0 AS kind, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p FROM d
  UNION ALL SELECT doc_id, owner, text, 1, 'AKIA[A-Z0-9]+' FROM d
  UNION ALL SELECT doc_id, owner, text, 2, '[0-9a-f]{24,}' FROM d
  UNION ALL SELECT doc_id, owner, text, 3, '[A-Za-z0-9+/_-]{24,}' FROM d),
g AS (SELECT doc_id, owner, kind, regexp_extract_all(text, p) AS w,
        CASE WHEN kind = 0 THEN regexp_extract_all(text, p, 2) ELSE regexp_extract_all(text, p) END AS v,
        string_split_regex(text, p) AS gap FROM m WHERE regexp_matches(text, p)),
e AS (SELECT doc_id, owner, kind, w[i] AS w, v[i] AS v, length(gap[i]) AS gl, i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM g)),
s AS (SELECT doc_id, owner, kind, v, sum(gl + length(w)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(w) AS a, sum(gl + length(w)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS b FROM e),
base AS (SELECT * FROM s WHERE (kind = 0 AND length(v) >= 6) OR (kind = 1 AND length(v) >= 20) OR (kind = 2 AND length(v) >= 24)),
more AS (SELECT * FROM s WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
  AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = s.doc_id AND x.a < s.b AND s.a < x.b)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM more),
f AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT doc_id) AS n_repos FROM cand GROUP BY v),
k AS (SELECT v, n_owners, n_repos, CASE WHEN n_owners >= 3 THEN 'example'
  WHEN length(v) < 8 OR len(list_distinct(string_split(v, ''))) < 5 OR regexp_matches(v, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567') THEN 'dummy'
  WHEN n_repos >= 20 * n_owners THEN 'shared' ELSE 'live' END AS class FROM f),
j AS (SELECT c.*, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || a || ':' || b AS said, n_owners, n_repos, class FROM cand c JOIN k USING (v) WHERE kind < 3 OR class IN ('live', 'shared')),
p AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(said, ',' ORDER BY a, kind) FILTER (kind < 3), '') AS base, string_agg(said, ',' ORDER BY a, kind) AS spans, count(*) FILTER (class = 'live') AS n_live,
  count(*) FILTER (class = 'shared') AS n_shared, count(*) FILTER (class = 'dummy') AS n_dummy, count(*) FILTER (class = 'example') AS n_example, max(n_owners) AS most_owners, max(n_repos) AS most_repos FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_dummy, 0) AS n_dummy, coalesce(n_example, 0) AS n_example,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN p USING (doc_id)
"""
