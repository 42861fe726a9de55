"""The models' fits against plain computations of the same."""

import math
import random

import numpy as np
import pyarrow as pa

from harborlens.llm.quality import fit_labels, fit_lexicon, fit_scorer, telling_terms


def test_em_is_that_of_plain_loops():
    """Votes row by row, tables as dicts, probabilities as products: the same accuracies, share and posteriors."""
    rng = random.Random(1)
    accuracy, names = (0.9, 0.75, 0.6), ["a", "b", "c"]
    rows = []
    for _ in range(400):
        good = rng.random() < 0.7
        rows.append(tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < p) == good else -1) for p in accuracy))
    p = [0.05 if -1 in r else 0.95 if sum(r) > 0 else 0.5 for r in rows]
    for _ in range(100):
        share = min(0.99, max(0.01, sum(p) / len(p)))
        table = {}
        for j in range(3):
            for kind, weight in (("bad", [1 - x for x in p]), ("good", p)):
                met = {v: 1 + sum(w for w, r in zip(weight, rows, strict=True) if r[j] == v) for v in (-1, 0, 1)}
                table[j, kind] = {v: n / sum(met.values()) for v, n in met.items()}
        after = []
        for r in rows:
            good, bad = share * math.prod(table[j, "good"][r[j]] for j in range(3)), (1 - share) * math.prod(table[j, "bad"][r[j]] for j in range(3))
            after.append(good / (good + bad))
        done = max(abs(a - b) for a, b in zip(p, after, strict=True)) < 1e-6
        p = after
        if done:
            break
    patterns, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    model = fit_labels(patterns, counts.astype(float), names)
    assert abs(model.good - share) < 1e-6
    for j, name in enumerate(names):
        for k, kind in enumerate(("bad", "good")):
            assert all(abs(model.votes[name][k][v + 1] - table[j, kind][v]) < 1e-6 for v in (-1, 0, 1))
    got = model.posterior(np.array(rows))
    assert max(abs(a - b) for a, b in zip(got, p, strict=True)) < 1e-5


def test_scorer_is_a_least_loss():
    """No step from the fitted weights lowers the loss by more than a trace."""
    rng = np.random.default_rng(2)
    n, features = 300, 12
    row, slot = np.repeat(np.arange(n), 4), rng.integers(0, features, 4 * n)
    keep = np.unique(np.stack((row, slot)), axis=1, return_index=True)[1]
    row, slot = row[keep], slot[keep]
    share = rng.random(len(row))
    target = 1 / (1 + np.exp(-(np.bincount(row, share * np.linspace(-4, 4, features)[slot], n))))
    w, bias = fit_scorer(row, slot, share, target, features, rounds=3_000, rate=0.02)
    scale = np.bincount(slot, share, features) / np.bincount(slot, minlength=features)

    def loss(w, bias):
        z = np.bincount(row, share * w[slot], n) + bias
        return np.mean(np.log1p(np.exp(-z)) * target + np.log1p(np.exp(z)) * (1 - target)) + 0.5e-3 * ((w * scale) ** 2).sum()

    best = loss(w, bias)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.05, features) / scale, bias + rng.normal(0, 0.05)) > best - 1e-5
    assert np.corrcoef(w, np.linspace(-4, 4, features))[0, 1] > 0.95


def test_lexicon_needs_the_telling_terms_alone():
    """Of texts as Arrow lists only telling terms become Python objects, and the lexicon is that of all terms."""
    rng = random.Random(3)
    bad = [rng.random() < 0.3 for _ in range(400)]
    rows = [sorted({f"w{rng.randrange(300)}" for _ in range(40)} | ({f"bad{rng.randrange(4)}"} if b else set())) for b in bad]
    told = telling_terms(pa.array([[], *rows], pa.list_(pa.string())).slice(1), np.array(bad))
    assert fit_lexicon(told, bad) == fit_lexicon([set(r) for r in rows], bad)
    assert set().union(*told) == {"bad0", "bad1", "bad2", "bad3"}
    assert telling_terms(pa.array([], pa.list_(pa.string())), np.zeros(0, bool)) == []
