"""The personal-data model's scores: those of the plain model, for windows of every length at once."""

import random

import numpy as np
import pytest

from sievemark.llm import pii


@pytest.fixture(scope="module")
def model():
    p = pii.train(pii.made_examples(60), steps=3, rows=16)
    g = np.random.default_rng(5)
    return {n: v + g.normal(0, 0.2, v.shape) for n, v in p.items()}


def made_texts(sizes):
    g = random.Random(4)
    return ["".join(g.choice("abc xyz.@+-0123456789()é\n") for _ in range(n)) for n in sizes]


def plain_scores(text, p):
    """Window by window, with nothing beyond its ends, in double precision."""
    c, out = pii.codes(text).astype(int), np.zeros((len(text), pii.TAGS))
    ramp = np.arange(1, pii.OVERLAP + 1)[:, None] / (pii.OVERLAP + 1)
    for a, b in pii.windows(len(c)):
        s = pii._scores(c[None, a:b], p)[0][:, 0].copy()
        if a > 0:
            s[: pii.OVERLAP] *= ramp
        if b < len(c):
            s[-pii.OVERLAP :] *= ramp[::-1]
        out[a:b] += s
    return out[:, 1:] - out[:, :1]


def test_scores_are_the_plain_models(model):
    texts = made_texts((1, 2, 31, 33, 0, 100, 511, 512, 513, 520, 700, 992, 993, 0, 2500, 77, 5))
    wanted, reader = np.concatenate([plain_scores(t, model) for t in texts]), pii.Reader(model)
    for block in (3, 1024):
        found = pii.Scores([(pii.codes(t), 0, len(t)) for t in texts], reader, block)
        assert np.abs(found.at(np.arange(len(wanted))) - wanted).max() < 1e-3
        assert np.abs(found.top - wanted.max(1)).max() < 1e-3
    long = texts[14]
    wanted = plain_scores(long, model)
    for lo, hi in ((100, 500), (480, 1000), (511, 513), (512, 993), (1000, 2500), (2499, 2500)):
        found = pii.Scores([(pii.codes(long), lo, hi)], reader)
        assert np.abs(found.at(np.arange(hi - lo)) - wanted[lo:hi]).max() < 1e-3 and np.abs(found.top - wanted[lo:hi].max(1)).max() < 1e-3


def test_texts_of_all_lengths_are_read_together(model, monkeypatch):
    """A pass costs about as much for one window as for a hundred, so lengths don't get passes of their own."""
    calls, own = [], pii.Reader.scores
    monkeypatch.setattr(pii.Reader, "scores", lambda self, ids, *more: calls.append(ids.shape) or own(self, ids, *more))
    texts = made_texts(range(5, 505, 10))
    pii.model_spans(texts, model)
    assert len(calls) == 1 and calls[0][1] == len(texts)
