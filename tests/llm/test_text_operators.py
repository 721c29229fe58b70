"""The operators over texts: brute force, exact round trips and odd inputs."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from modloom.llm import byte_bpe, decontaminate, licence_scan, near_dedup, secret_scan, shard_table, shingles, token_counts, token_files, toxicity, word_pieces

WORD_BPE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, source string, n_chars long, start long, tie long, spans string, label int, score double, slot int, keys string, __x string"


def docs_of(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, s, 0, 1, 2, "x", 3, 0.5, 4, "k", "y") for i, t, s in rows], SCHEMA)


LONG = "lorem ipsum dolor " * 30_000
ODD = [(None, "a null id", "s"), (1, None, None), (2, "", "s"), (3, "twice the same row", "s"), (3, "twice the same row", "s"), (3, "another text, same id", "s"), (4, LONG, "s"), (5, " \n\t ", "s"), (6, "İ Σ é ́ 漢字 <|endoftext|> \0 x", "s")]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_word_encoder_is_the_library():
    rng, enc, lib = random.Random(1), word_pieces.WordEncoder(WORD_BPE, max_entries=60), library()
    bits = ["a", "É", "İ", "Σ", " ", "\n", "\t", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "'", "s", ".", "!!", "1", "é", "́", "漢", " ", "$$", "<|", "|>", "Ab"]
    for _ in range(800):
        t = "".join(rng.choices(bits, k=rng.randint(0, 50)))
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == want
        assert token_counts.count_tokens(t * 9, lib, chunk=90, overlap=70) == len(lib.encode(t * 9, add_special_tokens=False).ids)


def test_a_text_without_boundaries_widens_the_overlap():
    lib = library()
    for t in ("x" * 3000 + " end " + "y1" * 900, "<|endoftext|>" * 200, "don't" * 300, " " * 5000 + "a", "é" * 3000, ""):
        assert token_counts.count_tokens(t, lib, chunk=100, overlap=40) == len(lib.encode(t, add_special_tokens=False).ids)


def test_a_long_text_is_spliced_from_chunks_in_linear_time(monkeypatch):
    lib = library()
    sizes = []
    encode = token_counts.encode_chunk
    monkeypatch.setattr(token_counts, "encode_chunk", lambda text, a, b, t: sizes.append(b - a) or encode(text, a, b, t))
    for t, most in (("aZ" * 500_000, 2.0), ("ab1," * 100_000, 1.1), ("some plain words " * 20_000, 1.1)):
        sizes.clear()
        assert token_counts.count_tokens(t, lib) == len(lib.encode(t, add_special_tokens=False).ids)
        assert sum(sizes) <= most * len(t)


def test_token_files_on_odd_rows(spark, tmp_path):
    lib = library()
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs_of(spark, ODD), path, WORD_BPE, n_files=3)
    back = token_files.read_token_files(spark, path).collect()
    assert len(back) == len(ODD)
    want = sorted(tuple(lib.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t, _ in ODD)
    assert sorted(tuple(r["ids"]) for r in back) == want
    at = 0
    order = sorted(back, key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"]) for r in order] == sorted((i is not None, i) for i, _, _ in ODD)
    for r in order:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    some = token_files.read_token_files(spark, path, doc_ids=[4]).collect()
    assert len(some) == 1 and some[0]["start"] == next(r["start"] for r in order if r["doc_id"] == 4)
    crc = {r["start"]: r["ids_crc32"] for r in token_files.checksums(token_files.read_token_files(spark, path)).collect()}
    assert all(crc[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in order)


def test_token_counts_on_odd_rows(spark):
    lib = library()
    got = token_counts.token_counts(docs_of(spark, ODD), WORD_BPE, chunk=5000).collect()
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_the_library(tiktoken_encoding, monkeypatch):
    rng, c = random.Random(3), byte_bpe.Codec(RANKS, P.PATTERN)
    bits = ["a", "É", " ", "  ", "\n", "\t", "\x1c", "<|endoftext|>", "'re", "'", "s", "!!", "1", "é", "́", "漢", "\xa0", "$$", "the", "\0", "\r", "²", " ", "x" * 300, "ab" * 200]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(600)]
    c.prepare(texts)
    ids = c.encode(texts)
    assert c.decode(ids) == [t.encode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "TOKENS", 50)
    assert c.decode(ids) == [t.encode() for t in texts]


def test_byte_bpe_on_odd_rows(spark, tiktoken_encoding):
    got = byte_bpe.encode_decode(docs_of(spark, ODD), RANKS, P.PATTERN, with_ids=True).collect()
    assert sorted(tuple(r["ids"]) for r in got) == sorted(tuple(tiktoken_encoding.encode_ordinary(t or "")) for _, t, _ in ODD)
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest() and r["n_tokens"] == len(r["ids"])


def base_spans(t):
    out = []
    for k, p, group, least in ((0, r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6), (1, r"AKIA[A-Z0-9]+", 0, 20), (2, r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[group]) >= least]
    return sorted(out)


def test_secret_spans_by_brute_force(spark):
    rng = random.Random(5)
    bits = ["token", "Secret", "PASSWORD", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOP", "é", "𝒳", "x", ".", "\n", "deadbeef", "passwd = hunter2!"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 40))), f"s{i % 3}") for i in range(300)]
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(docs_of(spark, rows))).collect()}
    for i, t, _ in rows:
        want = base_spans(t)
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert set(text.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_many_matches_in_one_text(spark):
    t = "é token=abcdef1 " * 700
    r = secret_scan.digest(secret_scan.scan(docs_of(spark, [(1, t, "s")]))).first()
    assert r["n_assign"] == 700 and r["base_sha256"] == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in base_spans(t)).encode()).hexdigest()


def test_copied_values_are_examples_and_redacted(spark):
    rows = [(i, f"see password=example123 in doc {i}", f"s{i}") for i in range(4)] + [(9, "my password=hunter2zz and\nnothing", "s1")]
    out = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(docs_of(spark, rows))).collect()}
    assert out[0]["n_example"] == 1 and out[0]["n_live"] == 0 and out[9]["n_live"] == 1
    clean = {r["doc_id"]: r for r in secret_scan.redact(docs_of(spark, rows)).collect()}
    assert clean[9]["text"] == "my <secret> and\nnothing" and clean[0]["text"] == "see <example> in doc 0"
    assert clean[9]["n_chars"] == len(clean[9]["text"]) and clean[9]["__x"] == "y"


def test_owners_and_repositories_decide_the_class(spark):
    rows = [(i, "secret=k3Yq9zTwA1 and more", "one") for i in range(25)] + [(30 + i, "secret=k3Yq9zTwB2", f"o{i % 2}") for i in range(25)] + [(60, "secret=changeme9", "one"), (61, "secret=aaaaaaaaaa", "one"), (62, "x Zk3Yq9zTwA1pP0oI9uU8yY7z", "one")]
    out = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(docs_of(spark, rows))).collect()}
    assert (out[0]["n_shared"], out[0]["most_owners"], out[0]["most_repos"]) == (1, 1, 25)
    assert (out[30]["n_live"], out[30]["most_owners"], out[30]["most_repos"]) == (1, 2, 25)
    assert out[60]["n_dummy"] == out[61]["n_dummy"] == 1 and out[62]["spans"].startswith("opaque:2:")
    assert secret_scan.redact(docs_of(spark, rows)).filter("doc_id = 0").first()["text"] == "<secret> and more"


def plain_redaction(text, spans):
    out, pos = [], 0
    for s in spans:
        if s["start"] >= pos:
            out += [text[pos : s["start"]], "<secret>" if s["class"] in ("live", "shared") else "<example>"]
        pos = max(pos, s["end"])
    return "".join([*out, text[pos:]])


def test_overlapping_spans_and_redaction_by_brute_force(spark):
    rng = random.Random(6)
    bits = ["token=", "api_key: ", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOP", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8", "g", "/", ".", " ", "é", "𝒳", "\n", "Zz9", "deadbeef" * 3]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 200))), f"s{i % 2}") for i in range(150)]
    found = {r["doc_id"]: r["spans"] or [] for r in secret_scan.scan(docs_of(spark, rows)).collect()}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs_of(spark, rows)).collect()}
    some = 0
    for i, t, _ in rows:
        base = base_spans(t)
        assert [(s["start"], s["kind"], s["end"]) for s in found[i] if s["kind"] < 3] == base
        mixed = [(m.start(), m.end()) for m in re.finditer(secret_scan.OPAQUE, t) if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
        apart = {(a, b) for a, b in mixed if not any(x < b and a < y for x, _, y in base)}
        more = {(s["start"], s["end"]) for s in found[i] if s["kind"] == 3}
        assert more <= apart
        some += len(more)
        assert clean[i] == plain_redaction(t, found[i])
    assert some


def test_a_hundred_thousand_spans_in_one_text_take_linear_time(spark):
    def text(n):
        return " ".join(f"{i:06d}fedcba9876543210fe Zk3Yq9zTwA1pP0oI9uU8y{i:06d}é" for i in range(n))

    took = {}
    for n in (6_250, 50_000):
        t = text(n)
        began = time.perf_counter()
        r = secret_scan.digest(secret_scan.scan(docs_of(spark, [(1, t, "s")]))).first()
        clean = secret_scan.redact(docs_of(spark, [(1, t, "s")])).first()["text"]
        took[n] = time.perf_counter() - began
        assert r["n_hex"] == n and r["spans"].count("opaque") == n
        assert clean == " ".join(["<secret> <secret>é"] * n)
    assert took[50_000] < 120 and took[50_000] < 12 * took[6_250], took


def test_secrets_on_odd_rows(spark):
    odd = [*ODD, (7, "token: " + "q" * 50_000, None), (None, "secret=abcdefgh", "s"), (None, "secret=abcdefgh", "s")]
    assert secret_scan.digest(secret_scan.scan(docs_of(spark, odd))).count() == len(odd)
    assert secret_scan.redact(docs_of(spark, odd)).count() == len(odd)
    assert secret_scan.scan(docs_of(spark, ODD).limit(0)).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, percent, k):
    sets = [shingle_set(t, k) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), 10**9), rows[i][0])
    return [(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))]


def chained(rng, n, words=60):
    """A chain of documents, each one word away from one before it: neighbours link, far ones do not."""
    texts = [[f"w{rng.randrange(400)}" for _ in range(words)]]
    for _ in range(n - 1):
        t = list(rng.choice(texts))
        t[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("tile", [512, 7])
def test_near_groups_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(8)
    texts = chained(rng, 60) + chained(rng, 25, 25) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(30)] + ["a b", "A  b", "a", "", None, "  "]
    rng.shuffle(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = near_dedup.grouped(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_groups(rows, 85, 3))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = near_dedup.deduplicate(docs_of(spark, rows), 85, 3)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"]) and kept.columns == docs_of(spark, rows).columns


def test_near_dedup_on_odd_rows(spark):
    got = near_dedup.grouped(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in near_dedup.deduplicate(docs_of(spark, ODD)).collect())
    assert kept == sorted({(str(i), t or "") for i, t, _ in ODD})
    assert near_dedup.grouped(docs_of(spark, ODD).limit(0)).count() == 0


def test_near_copies_with_null_ids(spark):
    rng = random.Random(3)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(3))
    rows = [(None, " ".join(a), "s"), (None, " ".join([*a[:-1], "x"]), "s"), (None, " ".join(b), "s"), (5, " ".join([*b[:-1], "x"]), "s"), (None, " ".join(c), "s"), (None, " ".join(c), "s")]
    rows += [(None, " ".join(t.split()), "s") for t in chained(rng, 12)]
    got = near_dedup.grouped(docs_of(spark, rows)).collect()
    want = brute_groups([(i, t, s) for i, (_, t, s) in enumerate(rows)], 85, 3)
    assert len({r["label"] for r in got}) == len({g for _, _, g in want}) and len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] == 5} == {5} and sum(r["component_id"] == 5 for r in got) == 2
    assert len({(r["label"], r["tie"]) for r in got if r["kept"]}) == len({g for _, _, g in want})
    kept = [r["text"] for r in near_dedup.deduplicate(docs_of(spark, rows)).collect()]
    assert len(kept) == len({g for _, _, g in want}) and rows[3][1] in kept and rows[2][1] not in kept


def test_sketches_tell_similarities_apart():
    rng = np.random.default_rng(2)
    for same in (0.5, 0.85, 0.95):
        both = int(2000 * 2 * same / (1 + same))
        a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 2**63, 2000 - both, dtype=np.uint64)])
        x = int(np.bitwise_count(near_dedup.odd_sketch(near_dedup.samples(a)) ^ near_dedup.odd_sketch(near_dedup.samples(b))).sum())
        guess = 1 + near_dedup.BITS / (4 * near_dedup.SAMPLES) * np.log(1 - 2 * x / near_dedup.BITS)
        assert abs(guess - same) < 0.15
        assert (x <= near_dedup.most_bits(0.85)) or same < 0.85


def test_word_hashes_follow_the_words():
    texts = [b"", b" A  b\x0bc ", b"a b c", ("q" * 700 + " é\xa0x").encode(), b"\n"]
    h, n = shingles.word_hashes(texts)
    assert n.tolist() == [0, 3, 3, 2, 0] and h[:3].tolist() == h[3:6].tolist() and len(set(h.tolist())) == 5


def brute_tiles(doc, item, match):
    """Greedy tiling by definition."""
    used_d, used_i, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while j + n < len(doc) and p + n < len(item) and doc[j + n] == item[p + n] and j + n not in used_d and p + n not in used_i:
                    n += 1
                best = max(best, (n, -p, -j))
        if best[0] < match:
            return out
        n, p, j = best[0], -best[1], -best[2]
        used_d.update(range(j, j + n))
        used_i.update(range(p, p + n))
        out += n


def test_tiling_by_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(4, 30) if i else 4))) for i in range(12)]
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 30))]
        part = rng.choice(items)[1].split()
        cut = rng.randrange(len(part))
        rows.append((i, " ".join([*w[:10], *part[cut:], *w[10:], *part[:cut]]), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontaminate.matches(docs_of(spark, rows), bench).collect()}
    want = {(i, k): n for i, t, _ in rows for k, b in items if (n := brute_tiles(t.split(), b.split(), min(5, len(b.split())))) >= 0.8 * len(b.split())}
    assert got == want and want and any(len(b.split()) < 5 for _, b in items)
    # the benchmark in several blocks, each a pass of its own
    small = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontaminate.matches(docs_of(spark, rows), bench, block_bytes=150).collect()}
    assert small == want
    left = decontaminate.clean(docs_of(spark, rows), bench, block_bytes=150)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _, _ in rows} - {i for i, _ in want}


def test_tiling_takes_repeated_words_and_confirms_words():
    doc, item = np.ones(20_000, np.uint64), np.ones(4000, np.uint64)
    assert decontaminate.tiles(doc, item, 5) == [(0, 0, 4000)]
    ix = decontaminate.Index([(1, "a " * 4000), (2, "yes no"), (3, "...")], 5)
    assert list(ix.search(["A, " * 5000, "well, YES: no!", "no yes", ""], 0.8)) == [(0, 0, 4000, 1), (1, 1, 2, 1)]
    roll = decontaminate.Rolling(np.array([7, 8, 9, 7, 8, 9], np.uint64))
    assert all(roll.runs(k)[0] == roll.runs(k)[3] for k in (1, 2, 3)) and len(set(roll.runs(3).tolist())) == 3


def test_blocks_of_long_texts_stay_small():
    """500 texts of 100,000 characters: what the arrays take does not grow with their number."""
    import resource

    import pyarrow as pa

    texts = [" ".join(f"w{(i * 7919 + j) % 5000}" for j in range(17_000)) for i in range(4)] * 125
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["doc_id", "text"])
    ix = decontaminate.Index([(1, "one two three four five six")], 5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(len(list(ix.search(some.column(1).to_pylist(), 0.8))) for some in decontaminate.text_blocks(batch, 1)) == 0
    assert sum(len(x) > 0 for x in near_dedup._sets(batch, 5)) == 500
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000  # KB


def test_reordered_passages_are_caught_and_clean_documents_stay(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "x y z Seven, eight nine ten eleven twelve! then q ONE two three four five six end", "s"), (2, "one two three four other words here", "s"), *ODD]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "so short"), (7, item), (10, "")], "item_id long, text string")
    docs = docs_of(spark, rows)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()) == [(1, 7), (1, 7)]
    kept = decontaminate.clean(docs, bench)
    assert kept.count() == len(rows) - 1 and kept.columns == docs.columns
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


def test_licences(spark):
    rows = [(1, "some prose\nReleased under the MIT License.\nmore", "s"), (2, "THIS WORK IS LICENSED under the GNU General Public License, version 3.", "s"), (3, "a fishing license is needed here", "s"), (4, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "s"), *[(i if i is None else i + 10, t, s) for i, t, s in ODD]]
    docs = docs_of(spark, rows)
    p = {(r["doc_id"], r["family"]) for r in licence_scan.paragraphs(docs).filter("confirmed").collect()}
    assert p == {(1, "mit"), (2, "gpl"), (4, "cc_by_nc"), (4, "apache")}
    assert licence_scan.paragraphs(docs.limit(0)).count() == 0


def test_licences_without_anchors_and_wrapped(spark):
    rows = [
        (1, "some prose\nYou can modify it under the terms of the GNU General Public\nmore", "s"),
        (2, "Title\n\nRedistribution and use in\nsource and binary forms, with or\nwithout modification, are permitted\nprovided that the following\nconditions are met.\n \nEnd\nof it", "s"),
        (3, "Der Hund ging mit dem Ball.\nmit", "s"),
        (None, "Neither the name of the\ncopyright holder nor the names of its\ncontributors may be used to endorse or promote products\nderived from this software", "s"),
        (4, "Released under the MIT License.\nThis program is free", "s"),
    ]
    got = licence_scan.paragraphs(docs_of(spark, [*rows, rows[1]])).collect()
    said = {(r["doc_id"], r["paragraph"], r["line"], r["family"], r["confirmed"]) for r in got}
    assert {x for x in said if x[-1]} == {(2, 1, -1, "bsd", True), (None, 0, -1, "bsd", True), (4, 0, 0, "mit", True)}
    assert {(i, f) for i, _, _, f, c in said if not c} <= {(1, "gpl")} and len(got) == len(said)


def test_neighbours_of_the_families_stay_unconfirmed(spark):
    others = ["Mozilla Public License, version 2.0", "Eclipse Public License, Version 2.0", "CC BY-SA 4.0", "GNU Affero General Public License, version 3", "ISC", "Unlicense", "SPDX-License-Identifier: WTFPL", *licence_scan.NEIGHBOURS]
    assert licence_scan.paragraphs(docs_of(spark, [(i, t, "s") for i, t in enumerate(others)])).filter("confirmed").count() == 0
    known = [(f, t) for f, notices in licence_scan.NOTICES.items() for t in notices]
    got = licence_scan.paragraphs(docs_of(spark, [(i, f"word {t} word", "s") for i, (_, t) in enumerate(known)])).filter("confirmed").collect()
    assert all(known[r["doc_id"]][0] == r["family"] for r in got) and len({r["doc_id"] for r in got}) >= 0.9 * len(known)


def test_every_paragraph_that_can_be_predicted_holds_a_telling_word():
    weights, bias, held = licence_scan.model()
    words = set(licence_scan.telling_words())
    assert all(b < bias[-1] for b in bias[:-1])
    assert all(words & set(g.split()) for g, v in weights.items() if max(v[:-1]) > v[-1])
    assert np.mean([k < 6 and q >= 0.5 for k, q, t in held if t == 6]) < 0.1  # other licences and sentences, held out whole


def test_shard_table(spark):
    names = shard_table.names(7)
    t = shard_table.fill(names, 1009)
    count = np.bincount(t)
    assert count.max() - count.min() <= 1 and len(t) == 1009
    fewer = shard_table.fill(names[:-1], 1009)
    assert ((t != fewer) & (t != 6)).mean() < 0.15  # few slots move besides those of the shard that left
    heavy = np.bincount(shard_table.fill(names, 1009, [3, 1, 1, 1, 1, 1, 1]))
    assert abs(heavy[0] / heavy[1] - 3) < 0.1
    # each shard's slots, by definition: turns of first free slots in its own order
    owner, at = {}, [0] * 3
    for k in list(range(3)) * 11:
        if len(owner) < 31:
            o, s = shard_table._hash(names[k], "offset") % 31, shard_table._hash(names[k], "skip") % 30 + 1
            while (slot := (o + at[k] * s) % 31) in owner:
                at[k] += 1
            owner[slot] = k
    assert shard_table.fill(names[:3], 31).tolist() == [owner[i] for i in range(31)]
    got = shard_table.place(docs_of(spark, ODD), "doc_id", t)
    assert got.count() == len(ODD) and got.columns.count("slot") == 1
    assert all(r["shard"] == t[r["slot"]] for r in got.collect())


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters(rng).items()}
    x, idx = rng.standard_normal((9, toxicity.DIM)), rng.integers(0, 9, (5, 4))
    mask, y = np.arange(5)[:, None] < np.array([5, 3, 1, 4])[None], np.array([1, 0, 1, 0])

    def loss(p):
        s, _ = toxicity.logits(p, {d: x @ p["W" + d] + p["c" + d] for d in "fb"}, idx, mask)
        return np.mean(np.logaddexp(0, s) - y * s)

    g, _ = toxicity.gradients(p, x, idx, mask, y)
    for k in g:
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            up, down = {a: b.copy() for a, b in p.items()}, {a: b.copy() for a, b in p.items()}
            up[k][i] += 1e-3
            down[k][i] -= 1e-3
            assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-3, abs=2e-4)


def test_windows_cover_every_word_and_overlap():
    doc, first, n = toxicity.windows(np.array([0, 5, 32, 33, 100]))
    seen = [set() for _ in range(5)]
    starts = np.cumsum([0, 0, 5, 32, 33])
    for d, f, m in zip(doc, first, n, strict=True):
        seen[d].update(range(f - starts[d], f - starts[d] + m))
    assert [len(s) for s in seen] == [0, 5, 32, 33, 100] and (np.bincount(doc) == [1, 1, 1, 2, 6]).all()


def test_no_character_of_a_long_word_is_left_out():
    for n in (1, 60, 63, 64, 65, 66, 68, 69, 124, 125, 128, 129, 1000):
        w = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(w)
        assert max(map(len, pieces)) <= 64 and (n > 64 or pieces == [w])
        assert {w[i : i + 5] for i in range(n)} - {w[i:] for i in range(max(0, n - 4), n)} <= {p[i : i + 5] for p in pieces for i in range(len(p))} and "".join(pieces)[-1] == w[-1]
    rng = random.Random(5)
    letters = [chr(0x0E01 + i) for i in range(40)]

    def sentence(bad):  # one word, the telling part behind its 64th character
        t = "".join(rng.choices(letters, k=rng.randint(150, 400)))
        at = rng.randint(80, len(t) - 20)
        return t[:at] + "กขฃคฅฆงจฉช" + t[at:] if bad else t

    rows = [(sentence(i % 3 == 0), int(i % 3 == 0)) for i in range(360)]
    got = toxicity.score_texts(toxicity.fit([t for t, _ in rows[:270]], [y for _, y in rows[:270]]), [t for t, _ in rows[270:]])
    assert np.mean([(s >= toxicity.THRESHOLD) == bool(y) for s, (_, y) in zip(got, rows[270:], strict=True)]) > 0.8


def test_hashes_do_not_depend_on_parts(monkeypatch):
    words = ["", *(f"w{i}" * (i % 9 + 1) for i in range(100))]
    a = toxicity.hashed(words)
    monkeypatch.setattr(toxicity, "HASHED", 7)
    b = toxicity.hashed(words)
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("word", "gram", "first", "shape"))


def test_toxicity_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(6)
    syllables = ["an", "er", "tion", "st", "the", "re", "ou", "nd"]

    def text(bad):
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        for _ in range(bad and rng.randint(2, 5)):
            w[rng.randrange(len(w))] = rng.choice(["vilest", "grubbo" + rng.choice(syllables), "wretch"])
        return " ".join(w)

    rows = [(i, text(i % 6 == 0), "s") for i in range(700)]
    docs = docs_of(spark, [*rows, *[(i if i is None else i + 1000, t, s) for i, t, s in ODD]])
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i, _, _ in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.add_score(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in held]) > 0.95
    assert toxicity.add_score(docs, model).count() == len(rows) + len(ODD)
    assert toxicity.add_score(docs.limit(0), model).count() == 0
    none = toxicity.trained(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.add_score(docs.limit(5), none).collect()} == {0.0}
    flags = docs.select(toxicity.held_out("doc_id").alias("h"), "doc_id").collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in flags)
