"""Cores of operators 1, 4 and 6 against plain versions: cheapest flows, all sets of languages, a dense fit."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import language, mixing, toxicity


def plain_cheapest_flow(supply, quota, tiers):
    """(words, cost) of a min-cost maximum flow, one word at a time along the cheapest path (Bellman-Ford)."""
    edges = []  # from, to, room, cost; the reverse of edge k is k ^ 1

    def edge(a, b, room, cost):
        edges.extend([[a, b, room, cost], [b, a, 0, -cost]])

    for p, n in supply.items():
        for t in range(tiers):
            edge("from", ("p", p), n, t)
        for s in p:
            edge(("p", p), ("s", s), 10**9, 0)
    for s, n in quota.items():
        edge(("s", s), "to", n, 0)
    words = cost = 0
    while True:
        dear, by = {"from": 0}, {}
        changed = True
        while changed:
            changed = False
            for k, (a, b, room, c) in enumerate(edges):
                if room and a in dear and dear[a] + c < dear.get(b, math.inf):
                    dear[b], by[b], changed = dear[a] + c, k, True
        if "to" not in dear:
            return words, cost
        words, cost, at = words + 1, cost + dear["to"], "to"
        while at != "from":
            edges[by[at]][2] -= 1
            edges[by[at] ^ 1][2] += 1
            at = edges[by[at]][0]


@pytest.mark.parametrize("seed", range(30))
def test_flow_is_a_cheapest_one(seed):
    rng = random.Random(seed)
    patterns = [p for k in (1, 2, 3) for p in itertools.combinations("abc", k)]
    supply = {p: rng.randint(0, 6) for p in rng.sample(patterns, rng.randint(2, 7))}
    quota = {s: rng.randint(0, 20) for s in "abc"}
    flow = mixing.cheapest_flow(supply, quota, 3)
    given = {p: sum(f.values()) for p, f in flow.items()}
    taken = Counter()
    for p, f in flow.items():
        assert set(f) <= set(p) and all(n >= 0 for n in f.values()) and given[p] <= 3 * supply[p]
        taken.update(f)
    assert all(taken[s] <= quota[s] for s in quota)
    cost = sum(max(0, given[p] - t * n) for p, n in supply.items() for t in (1, 2))
    assert (sum(given.values()), cost) == plain_cheapest_flow(supply, quota, 3)


def plain_mixture(counts, likelihood, langs, rounds=300):
    """Proportions of some languages and the log likelihood, entry by entry."""
    share = {j: 1 / len(langs) for j in langs}
    total = sum(counts.values())
    for _ in range(rounds):
        got = dict.fromkeys(langs, 0.0)
        for g, n in counts.items():
            mixed = sum(share[j] * likelihood[g][j] for j in langs)
            for j in langs:
                got[j] += n * share[j] * likelihood[g][j] / mixed
        share = {j: x / total for j, x in got.items()}
    return share, sum(n * math.log(sum(share[j] * likelihood[g][j] for j in langs)) for g, n in counts.items())


def test_language_sets_against_all_sets():
    rng = np.random.default_rng(3)
    likelihood = rng.gamma(0.3, size=(60, 3)) + 1e-3
    likelihood /= likelihood.sum(0)
    texts = []
    for k in range(40):
        part = [(1, 0, 0), (0.6, 0.4, 0), (0.1, 0, 0.9), (0.3, 0.4, 0.3)][k % 4]
        texts.append(Counter(rng.choice(60, size=int(rng.integers(30, 300)), p=likelihood @ np.array(part)).tolist()))
    entries = [(i, g, n) for i, c in enumerate(texts) for g, n in sorted(c.items())]
    rows, share, kept = language.language_sets(*(np.array(x) for x in zip(*entries)), likelihood)
    assert rows.tolist() == [*range(40)]
    for i, counts in enumerate(texts):
        price = language.PENALTY * 0.5 * math.log(max(2, sum(counts.values())))
        found = [plain_mixture(counts, likelihood, s) for k in (1, 2, 3) for s in itertools.combinations(range(3), k)]
        values = [fit - price * len(s) for s, fit in found]
        best = found[int(np.argmax(values))][0]
        own = tuple(np.flatnonzero(share[i]))
        assert len(own) == kept[i] and share[i].sum() == pytest.approx(1)
        # its value, by few rounds, comes near the best one of all sets
        value = sum(n * math.log(float(likelihood[g] @ share[i])) for g, n in counts.items()) - price * kept[i]
        assert value >= max(values) - 0.5
        assert share[i].argmax() == max(best, key=best.get) and set(own) == set(best), i


def test_fit_is_the_dense_one():
    rng = np.random.default_rng(5)
    y = np.arange(50) % 3 == 0
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 12), (rng.integers(40, 60, 6) if hot else [])]).astype(np.int32)) for hot in y]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    weights, bias = toxicity.fit_ratio_scaled(np.concatenate(rows), at, y, (300, 100))

    x = np.zeros((50, 60))
    for i, r in enumerate(rows):
        x[i, r] = 1
    every, hot = x.sum(0), x[y].sum(0)
    known = every >= 3
    p, q = 1 + hot, 1 + every - hot
    ratio = np.where(known, np.log((p / p[known].sum()) / (q / q[known].sum())), 0)
    scaled, each = x * ratio, np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())

    def loss(w, b):
        z = scaled @ w + b
        return (each * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-3 * w @ w

    # Newton's method, to the optimum
    w, full = np.zeros(61), np.hstack([scaled, np.ones((50, 1))])
    ridge = np.diag([1e-3] * 60 + [1e-9])
    for _ in range(100):
        f = 1 / (1 + np.exp(-full @ w))
        step = np.linalg.solve(full.T @ (full * (each * f * (1 - f))[:, None]) + ridge, full.T @ (each * (f - y)) + ridge @ w)
        size = 1.0
        while size > 1e-6 and loss((w - size * step)[:-1], (w - size * step)[-1]) > loss(w[:-1], w[-1]):
            size /= 2
        w = w - size * step
    prior = math.log(100.5 / 300.5) / 2
    raw = np.divide(weights[:60], ratio, out=np.zeros(60), where=ratio != 0)
    least, own, start = loss(w[:-1], w[-1]), loss(raw, bias - prior), loss(np.zeros(60), 0.0)
    assert not weights[60:].any() and least <= own <= least + 0.1 * (start - least)
    ours, dense = x @ weights[:60] + bias - prior, scaled @ w[:-1] + w[-1]
    assert ((ours > 0) == (dense > 0)).all() and np.corrcoef(ours, dense)[0, 1] > 0.97
