"""The pipeline's stages in a row, on planted documents."""

import random

import corpus_pipeline
from modloom.llm import toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["an", "er", "tion", "st", "re", "ou", "nd", "li"], k=rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(80)), "en", f"s{i % 5}") for i in range(400)]
    bad = set(range(0, 400, 8))
    rows = [(i, t.replace(" ", " vilest wretch ", 2) if i in bad else t, a, b) for i, t, a, b in rows]
    item = " ".join(word() for _ in range(40))
    plain = [i for i, *_ in rows if i not in bad]
    rows += [(1000, rows[1][1], "en", "s0"), (1001, rows[2][1] + " tail", "en", "s1"), (1002, "before " + item + " after " + word(), "en", "s2"), (1003, "my token = abcdef123456 " + " ".join(word() for _ in range(40)), "en", "s3"), (1004, None, None, None), (1005, "", "en", "s1")]
    d = str(tmp_path)
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.common.materialise(stage(spark, now, d))
        if name != "byte_bpe":
            assert out.columns == now.columns
        seen.append({r["doc_id"] for r in out.select("doc_id").collect()})
        if name == "secrets":
            assert "<secret>" in out.filter("doc_id = 1003").first()["text"]
        now = out
    assert len(seen[0] & bad) <= 3 and len(seen[0] & set(plain)) >= 0.97 * len(plain)
    assert not {1000, 1001} & seen[1] and seen[0] - seen[1] <= {1000, 1001, 1, 2}
    assert seen[1] - seen[2] == {1002}
    assert seen[3] == seen[2] == seen[4] and {1004, 1005} <= seen[4]
    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(done) == seen[4] and "<secret>" in done[1003]["text"] and len(done[1003]["ids"]) == done[1003]["n_tokens"]
    assert toxicity.THRESHOLD == 0.3
