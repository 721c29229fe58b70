import numpy as np
import pytest

from modloom.plans import blocks, spectral
from modloom.sources import graphs


@pytest.mark.parametrize(("kind", "null"), [("lmix_sym", "ng"), ("lb_rw", "er")])
def test_a_polynomial_is_one_written_table(spark, monkeypatch, kind, null):
    """Eight products, over several parts, write one table and are the dense matrix's."""
    monkeypatch.setattr(blocks, "LEAST", 100)
    e, _ = graphs.block_model(spark, 60, 3, 0.6, 0.1)
    op = spectral.operator(e, kind, null)
    ids, a = op.dense()
    b = blocks.Blocks(op)
    assert b.parts == 4
    x = np.random.default_rng(1).normal(size=(60, 3))
    w = np.array([[1.0, 2.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 1.0]])
    state = b.start(spark.createDataFrame([(i, list(map(float, r))) for i, r in zip(ids, x, strict=True)], "id long, v array<double>"))
    rows = lambda t: np.array([r["v"] for r in blocks.unpacked(t, 3, [], 3).orderBy("id").collect()])
    assert np.array_equal(rows(state), x)
    assert np.allclose(b.gram(state, 3, [w]), (x @ w).T @ a @ (x @ w))
    written = []
    keep = blocks.materialise
    monkeypatch.setattr(blocks, "materialise", lambda t: written.append(keep(t)) or written[-1])
    got = b.filtered(state, 3, [w], 8, 1.5, 4.0)
    scaled = (a - 2.75 * np.eye(60)) / 1.25
    before, now = x @ w, scaled @ x @ w
    for _ in range(7):
        before, now = now, 2 * scaled @ now - before
    assert len(written) == 1 and np.allclose(rows(got), now, rtol=1e-9, atol=1e-9 * np.abs(now).max())


def test_no_table_is_written_for_a_product(spark, monkeypatch):
    e, _ = graphs.block_model(spark, 40, 4, 0.95, 0.02)
    op = spectral.operator(e, "lmix_sym")
    made = []
    for module in (spectral, blocks):
        for name in ("materialise", "materialise_by"):
            keep = getattr(module, name)
            monkeypatch.setattr(module, name, lambda *a, keep=keep: made.append(a) or keep(*a))
    rounds = []
    monkeypatch.setattr(blocks.Blocks, "gram", lambda *a, keep=blocks.Blocks.gram: rounds.append(a) or keep(*a))
    spectral.smallest(op, 4, dense=0)
    assert len(made) == len(rounds) + 3  # a table for each round, the parts, the start and the result
