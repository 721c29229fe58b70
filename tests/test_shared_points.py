import numpy as np

from modloom.operators import neighbours


def test_a_point_goes_once_to_each_part(spark, monkeypatch):
    """However many lists it stands in; the parts change no result, nor does merging lists in several goes."""
    x = np.random.default_rng(8).normal(size=(400, 8))
    x[::3] = x[::3].astype(np.float32)  # packed in single precision
    points = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, features array<double>")
    dealt, keep = [], type(points).repartitionById

    def watched(df, n, column):
        dealt.append((n, df.filter("x is not null").count(), df.filter("x is null").count()))
        return keep(df, n, column)

    monkeypatch.setattr(type(points), "repartitionById", watched)
    got = []
    for parts, vectors, most in ((3, 1_000_000, 2_000_000), (2, 100, 500)):
        monkeypatch.setattr(neighbours, "PARTS", parts)
        monkeypatch.setattr(neighbours, "VECTORS", vectors)
        monkeypatch.setattr(neighbours, "MOST", most)
        got.append(sorted(map(tuple, neighbours.approximate_knn(points, 4, tables=2, bucket=30).collect())))
        if parts == 3:
            assert dealt and all(n == 3 and sent <= 3 * 400 for n, sent, _ in dealt) and dealt[0][2] > 5 * dealt[0][1]
    assert got[0] == got[1] and len(got[0]) == 1600
    assert all(np.isclose(r[2], ((x[r[0]] - x[r[1]]) ** 2).sum(), rtol=1e-14) for r in got[0])
