"""op7_lm: what a walk and the scores of a model cost, and that both are still the formulas written out."""

import math
import tracemalloc

import numpy as np
import pytest

from schemaloom.llm import lm


def model(v, p, scale=0.5, seed=4):
    rng = np.random.default_rng(seed)
    unigram = rng.random(v) + 0.1
    unigram /= unigram.sum()
    weights = {k: rng.normal(0, scale, x.shape).astype(np.float32) for k, x in lm.start(unigram, p).items()}
    return weights, unigram, rng


def plain(w, ids, one, two, p):
    """Log probabilities in double precision, every score written out."""
    w = {k: x.astype(np.float64) for k, x in w.items()}
    found = []
    for x, a, b in zip(ids, one, two):
        hidden = w["context"][a] @ w["first"] + w["context"][b] @ w["second"]
        c = x // p.class_size
        at = slice(c * p.class_size, (c + 1) * p.class_size)
        found.append(0.0)
        for s, own in ((w["class"] @ hidden + w["class_bias"], c), (w["target"][at] @ hidden + w["bias"][at], x - at.start)):
            found[-1] += s[own] - s.max() - math.log(np.exp(s - s.max()).sum())
    return np.array(found)


def test_exponentials_of_scores_grow_with_the_model_and_not_with_the_tokens(monkeypatch):
    p = lm.LmParams(size=8, class_size=5)
    weights, _, rng = model(18, p)  # the last class has three words
    ids, one, two = (rng.integers(0, 18, 20_000) for _ in range(3))
    taken, exp = [0], np.exp

    def counted(x, *args, **more):
        taken[0] += np.size(x)
        return exp(x, *args, **more)

    monkeypatch.setattr(np, "exp", counted)
    got = lm.log_probabilities(weights, ids, one, two, p)
    monkeypatch.undo()
    assert taken[0] < len(ids), taken  # a token took 4 + 5 before
    assert np.allclose(got[:500], plain(weights, ids[:500], one[:500], two[:500], p), atol=1e-4)


@pytest.mark.parametrize("scale", [0.1, 2.0, 6.0])
@pytest.mark.parametrize("tokens", [30, 3_000])
def test_scores_of_any_width_equal_the_formula(scale, tokens):
    p = lm.LmParams(size=8, class_size=5)
    weights, _, rng = model(18, p, scale)
    ids, one, two = (rng.integers(0, 18, tokens) for _ in range(3))
    scorer = lm.Scorer(weights, p)
    wide = np.concatenate(scorer.classes[2:])
    assert (scale == 0.1 and not wide.any()) or (scale == 2.0 and wide.any() and not wide.all()) or (scale == 6.0 and wide.all())
    want = plain(weights, ids, one, two, p)
    for _ in range(2):  # the second time with what the first one has left
        assert np.allclose(scorer.log_probabilities(ids, one, two), want, rtol=1e-4, atol=1e-3)


def test_one_step_equals_the_gradient_written_out():
    p = lm.LmParams(size=6, class_size=5, class_noise=7, word_noise=4)
    weights, unigram, rng = model(18, p)
    n = 2_500  # three blocks
    ids, one, two = np.sort(rng.integers(0, 18, n)), rng.integers(0, 18, n), rng.integers(0, 18, n)
    trainer = lm.Trainer(weights, unigram, p, 0)
    trainer.step(ids[:40], one[:40], two[:40], 0.0)  # leaves its memory behind and moves nothing
    trainer.grown = {k: np.ones_like(x) for k, x in weights.items()}
    trainer.step(ids, one, two, 0.35)
    w = {k: x.astype(np.float64) for k, x in weights.items()}
    g = {k: np.zeros_like(x) for k, x in w.items()}
    share = np.bincount(np.arange(18) // 5, unigram)
    for x, a, b in zip(ids, one, two):
        hidden = w["context"][a] @ w["first"] + w["context"][b] @ w["second"]
        c = x // 5
        at = slice(c * 5, min((c + 1) * 5, 18))
        back = np.zeros(6)
        for table, bias, own, rows, noise in (("class", "class_bias", c, slice(None), 7 * share), ("target", "bias", x - at.start, at, 4 * unigram[at] / share[c])):
            chance = 1 / (1 + np.exp(np.log(noise) - w[table][rows] @ hidden - w[bias][rows]))
            by_score = noise * chance
            by_score[own] += chance[own] - 1
            g[table][rows] += np.outer(by_score, hidden)
            g[bias][rows] += by_score
            back += by_score @ w[table][rows]
        for name, i in (("first", a), ("second", b)):
            g["context"][i] += w[name] @ back
            g[name] += np.outer(w["context"][i], back)
    for k, x in g.items():
        want = w[k] - 0.35 * (0.2 if k in ("first", "second") else 1) * x / np.sqrt(1 + x * x)
        assert np.allclose(trainer.w[k], want, atol=2e-3), k


def test_a_step_uses_the_memory_of_the_one_before():
    p = lm.LmParams()
    weights, unigram, rng = model(12_992, p, 0.05)
    trainer = lm.Trainer(weights, unigram, p, 0)
    ids, one, two = np.sort(rng.zipf(1.3, p.batch) % 12_992), rng.integers(0, 12_992, p.batch), rng.integers(0, 12_992, p.batch)
    trainer.step(ids, one, two, 0.1)
    tracemalloc.start()
    trainer.step(ids, one, two, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 11e6, peak
