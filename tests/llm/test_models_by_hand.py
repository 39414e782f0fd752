"""Model scores written out: pairwise sums, densities with explicit inverses, likeness from the fingerprints themselves."""

import random

import numpy as np
import pytest

from gleaner.llm import order_minhash, quality, toxicity
from tests.llm.helpers import documents, prose


def test_machine_is_a_sum_over_pairs():
    rng = np.random.default_rng(4)
    n = 9
    machine = toxicity.Machine(np.arange(n, dtype=np.uint32), rng.standard_normal(n), rng.standard_normal((n, 5)), 0.3)
    rows = [sorted(rng.choice(n, rng.integers(0, 7), replace=False).tolist()) for _ in range(40)]
    owner = np.repeat(np.arange(40), [len(r) for r in rows])
    got = machine.raw(owner, np.array([t for r in rows for t in r], np.int64), 40)
    for r, value in zip(rows, got):
        pairs = sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(r) for b in r[i + 1 :])
        assert value == pytest.approx(0.3 + sum(machine.weights[t] for t in r) + pairs)


def test_discriminant_is_a_difference_of_log_densities():
    rng = np.random.default_rng(5)
    classes = {}
    samples = {}
    for value, n in ((0, 60), (1, 200)):
        mixed = rng.standard_normal((n, quality.SIZE)) @ rng.standard_normal((quality.SIZE, quality.SIZE)) * 0.3 + value
        samples[value] = mixed
        classes[value] = (float(n), mixed.sum(0), mixed.T @ mixed)
    model = quality.solve(classes)
    every = np.vstack([samples[0], samples[1]])
    centre, spread = every.mean(0), np.sqrt(np.maximum(every.var(0), 1e-9))
    scaled = {v: (s - centre) / spread for v, s in samples.items()}
    pooled = sum(len(scaled[v]) * np.cov(scaled[v].T, bias=True) for v in (0, 1)) / len(every)
    x = rng.standard_normal((30, quality.SIZE))
    logs = []
    for v in (0, 1):
        c = (1 - quality.TO_POOLED) * np.cov(scaled[v].T, bias=True) + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.maximum(np.diag(c), 1e-3)) + 1e-6 * np.eye(len(c))
        off = (x - centre) / spread - scaled[v].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(c), off) - 0.5 * np.linalg.slogdet(c)[1])
    want = np.clip(logs[1] - logs[0], -quality.CLIP, quality.CLIP)
    assert np.allclose(model.differences(x), want, rtol=1e-6, atol=1e-6)


def by_hand(a: str, b: str) -> float:
    """Likeness of two fingerprints: equal entries among the slots that either fills."""
    left, right = ({f[i : i + 3]: f[i : i + 12] for i in range(0, len(f), 12)} for f in (a, b))
    slots = left.keys() | right.keys()
    return sum(left.get(s) == right.get(s) for s in slots) / len(slots) if slots else 1.0


def test_likeness_from_fingerprints(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(30)] + [(50, None), (51, ""), (52, "a"), (53, "a")]
    got = {r["doc_id"]: r for r in order_minhash.compare_with_next(documents(spark, rows)).collect()}
    order = sorted(got, reverse=True)
    for doc_id, following in zip(order, order[1:] + order[:1]):
        r = got[doc_id]
        assert r["near_edited"] == pytest.approx(by_hand(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(by_hand(r["fingerprint"], got[following]["fingerprint"]))
