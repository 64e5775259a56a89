import numpy as np

from graphloom.llm import hnsw


class Blind(hnsw.Graph):
    """Below a beam of 256, a search finds nothing but the query's own row."""

    def near_to(self, q, beam, least):
        i, j = super().near_to(q, beam, least)
        if beam >= 256:
            return i, j
        same = np.einsum("nd,nd->n", q[i], self.x[j]) > 1 - 1e-5
        return i[same], j[same]


def real(x, **more):
    own = np.arange(len(x))
    i, j = hnsw.links_between(x, x, graph=Blind(hnsw._unit(x)), own=own, **more)
    return {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a != b}


def truth(x):
    u = hnsw._unit(x)
    return {(a, b) for a, b in zip(*(k.tolist() for k in np.nonzero(u @ u.T >= hnsw.COSINE)), strict=True) if a != b}


def test_own_rows_prove_nothing():
    rnd = np.random.default_rng(7)
    x = rnd.standard_normal((2000, 32))
    x[1::40] = x[0::40] + 0.05 * rnd.standard_normal((50, 32))  # few links, some of them audited
    assert len(truth(x)) >= 100 and real(x) == truth(x)


def test_links_outside_the_first_sample():
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((2000, 32))
    x[7] = x[3] + 0.05 * rnd.standard_normal(32)
    assert real(x) == truth(x) == {(3, 7), (7, 3)}


def test_enough_links_are_audited_by_the_beam():
    rnd = np.random.default_rng(9)
    x = np.concatenate([rnd.standard_normal(32) + 0.05 * rnd.standard_normal((60, 32)) for _ in range(40)])
    assert len(real(x)) >= hnsw.RECALL * len(truth(x))
