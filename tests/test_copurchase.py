"""Co-purchase pairs: partitions grow in number with the lines."""

from collections import Counter

from modloom.sources import graphs


def test_partitions_grow_with_the_lines_and_results_stay(spark, tmp_path, monkeypatch):
    lines = [(o, (o * 7 + i * i) % 11) for o in range(60) for i in range(o % 5 + 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = Counter((a, b) for o in range(60) for x, a in lines if x == o for y, b in lines if y == o and a != b)
    monkeypatch.setattr(graphs, "LINES", 20)
    got = graphs.copurchase(spark, str(tmp_path))
    assert {(r["src"], r["dst"]): r["w"] for r in got.collect()} == dict(want)
    assert got.rdd.getNumPartitions() == -(-len(lines) // 20)
