import time

import numpy as np
import pytest

from modloom.plans import blocks, spectral
from modloom.sources import graphs


def vectors_of(table):
    return np.array([r["v"] for r in table.orderBy("id").collect()])


@pytest.mark.parametrize(("kind", "p_out"), [("lmix_sym", 0.02), ("laplacian_sym", 0.0)])
def test_a_basis_is_kept_and_no_filter_is_needed(spark, monkeypatch, kind, p_out):
    """Over several parts the values and vectors are the dense matrix's, a value that comes three times among them."""
    monkeypatch.setattr(blocks, "LEAST", 2000)
    monkeypatch.setattr(blocks.Blocks, "filtered", lambda *a: pytest.fail("subspace iteration"))
    chains = []
    monkeypatch.setattr(blocks.Blocks, "terms", lambda *a, keep=blocks.Blocks.terms: chains.append(a) or keep(*a))
    e, _ = graphs.block_model(spark, 330, 3, 0.2, p_out)
    op = spectral.operator(e, kind)
    _, a = op.dense()
    want = np.linalg.eigvalsh((a + a.T) / 2)[:4]
    lam, table = spectral.smallest(op, 4, dense=0)
    v = vectors_of(table)
    assert np.allclose(lam, want, atol=1e-7)
    assert np.abs(a @ v - v * lam).max() < 2e-4 and np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    assert chains and chains[0][0].parts > 1 and len(chains) * spectral.CHAIN < 60
    assert kind != "laplacian_sym" or np.abs(lam[:3]).max() < 1e-7 < lam[3]


def test_where_the_krylov_space_ends_subspaces_go_on(spark):
    """80 cliques of 4 have two values in all, the smallest one 80 times."""
    e = spark.createDataFrame([(4 * c + i, 4 * c + j, 1.0) for c in range(80) for i in range(4) for j in range(4) if i != j], "src long, dst long, w double")
    op = spectral.operator(e, "laplacian_sym")
    b = blocks.Blocks(op)
    assert spectral.krylov(b, op, 4) is None
    lam, table = spectral.smallest(op, 4, dense=0)
    v = vectors_of(table)
    assert np.allclose(lam, 0, atol=1e-7) and np.allclose(v.T @ v, np.eye(4), atol=1e-7)


def test_a_chain_leaves_no_shuffle_behind(spark):
    e, _ = graphs.block_model(spark, 60, 3, 0.6, 0.1)
    op = spectral.operator(e, "lmix_sym")
    b = blocks.Blocks(op)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "id long, v array<double>")
    basis = b.kept(b.start(rows))
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in files.getAllBlocks().mkString(" ").split() if "shuffle" in f}
    before = names()
    b.terms(basis, 2, 1, 3, 0.0, 4.0)
    for _ in range(50):  # they are deleted in the background
        left = names() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
