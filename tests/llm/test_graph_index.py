"""Nearest neighbours by the pruned graph against brute force."""

import numpy as np
import pytest

from modloom.llm import ann_graph


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
    return [i for _, i in sorted((float(a), i) for a, i in zip(d, ids, strict=True) if i != q)][:k]


def test_recall_over_shards(spark):
    x = np.random.default_rng(0).standard_normal((1500, 24))
    rows = spark.createDataFrame([(i, list(map(float, v)), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, v string")
    got = ann_graph.search(ann_graph.index(rows, shard=400), rows.filter("vec_id % 100 = 0")).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(found) == list(range(0, 1500, 100))
    hits = [len(set(f.values()) & set(brute(list(range(1500)), x, q, 10))) / 10 for q, f in found.items()]
    assert np.mean(hits) >= 0.9
    for r in got:
        assert abs(r["score"] - np.sqrt(((x[r["query_id"]] - x[r["vec_id"]]) ** 2).sum())) < 1e-12


def test_odd_vectors(spark):
    good = [float(i) for i in (1, 2, 3)]
    rows = [(0, good), (0, good), (1, good), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (None, good), (7, [1.0, 2.0, 4.0]), (8, [1.0, 2.0]), (9, []), *[(100 + i, good) for i in range(30)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_graph.search(ann_graph.index(df), df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, *range(100, 109)]
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [0, 1, *range(101, 109)]
    assert {r["query_id"] for r in got} == {0, 100}
    few = df.filter("vec_id in (0, 7)")
    assert [r["vec_id"] for r in ann_graph.search(ann_graph.index(few), few.filter("vec_id = 0")).collect()] == [7]
    assert ann_graph.search(ann_graph.index(df.limit(0)), df.limit(0)).count() == 0


@pytest.mark.parametrize(("scale", "offset"), [(1e20, 0.0), (1e-30, 0.0), (1.0, 1e4), (1e200, 0.0)])
def test_recall_at_any_scale_and_offset(scale, offset):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((600, 8)) + offset) * scale
    centre, size = ann_graph.scaling(x)
    inner = ann_graph.scaled(x, centre, size)
    graph, start = ann_graph.build(inner)
    asked = x[::50] * (1 + 1e-9)
    found, _ = ann_graph.beam_search(inner, graph, start, ann_graph.scaled(asked, centre, size), 96)
    hits = []
    for q, f in zip(asked, found, strict=True):
        d = np.sqrt((((x - q) / scale) ** 2).sum(1))
        assert np.allclose(ann_graph.euclidean(x, q) / scale, d, rtol=1e-9)
        hits.append(len(set(f[:10].tolist()) & set(np.argsort(d)[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_far_queries_end_and_far_clusters_are_told_apart():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((300, 8)) + 1e4, rng.standard_normal((300, 8)) - 1e4])
    graph, start = ann_graph.build(ann_graph.scaled(x, *ann_graph.scaling(x)))
    inner = ann_graph.scaled(x, *ann_graph.scaling(x))
    found, _ = ann_graph.beam_search(inner, graph, start, ann_graph.scaled(x[::60], *ann_graph.scaling(x)), 96)
    want = [set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist()) for q in x[::60]]
    assert np.mean([len(set(f[:10].tolist()) & w) / 10 for f, w in zip(found, want, strict=True)]) >= 0.9
    far, _ = ann_graph.beam_search(inner, graph, start, ann_graph.scaled(np.full((3, 8), 1e300), *ann_graph.scaling(x)), 96)
    assert (far >= 0).any()
