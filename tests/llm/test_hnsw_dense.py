from functools import cache

import numpy as np

from graphloom.llm import hnsw

from .test_hnsw_audit import truth


@cache
def graph(seed):
    return hnsw.Graph(hnsw._unit(dense_and_pairs(seed)))


def links(x, g):
    i, j = hnsw.links_between(x, x, graph=g, own=np.arange(len(x)))
    return {*zip(i.tolist(), j.tolist(), strict=True)}


def dense_and_pairs(seed):
    """A dense place of 700 rows, and 1,000 pairs."""
    rnd = np.random.default_rng(seed)
    pairs = np.repeat(rnd.standard_normal((1000, 32)), 2, axis=0)
    pairs[1::2] += 0.05 * rnd.standard_normal((1000, 32))
    x = np.concatenate([rnd.standard_normal(32) + 0.05 * rnd.standard_normal((700, 32)), pairs])
    return x[rnd.permutation(len(x))]


def test_a_dense_place_takes_no_beam_of_its_width(monkeypatch):
    x, g = dense_and_pairs(4), graph(4)
    met, inner = [], hnsw.Graph._beam
    monkeypatch.setattr(hnsw.Graph, "_beam", lambda self, q, start, k, beam, **more: met.append(len(q) * beam) or inner(self, q, start, k, beam, **more))
    got = {(a, b) for a, b in links(x, g) if a != b}
    assert 700 * 699 < len(got) and got <= truth(x) and len(got) >= hnsw.RECALL * len(truth(x))
    assert sum(met) <= 2 * hnsw.FIRST_BEAM * len(x)


class Half(hnsw.Graph):
    """Below a beam of 64, a search loses the links of every query that has only a few."""

    def near_to(self, q, beam, least):
        i, j = super().near_to(q, beam, least)
        if beam >= 64:
            return i, j
        kept = (np.bincount(i, minlength=len(q))[i] > 32) | (np.einsum("nd,nd->n", q[i], self.x[j]) > 1 - 1e-5)
        return i[kept], j[kept]


def test_links_of_a_dense_place_prove_nothing_of_others():
    x = dense_and_pairs(5)
    want = truth(x)
    few = np.bincount([a for a, _ in want], minlength=len(x)) < 32
    want = {(a, b) for a, b in want if few[a]}
    assert len(want) > 1900
    assert len(want & links(x, Half(hnsw._unit(x)))) >= hnsw.RECALL * len(want)


def test_own_rows_are_no_links_whether_audited_or_not():
    assert not [a for a, b in links(dense_and_pairs(4), graph(4)) if a == b]
