"""Scoring lines texts up in rows of about equal length: few steps, and every text as if alone."""

import warnings

import numpy as np

from papertide.llm.gated_lm import GatedModel


def texts(r, lengths):
    return [r.integers(0, 50, n).astype(np.uint16) for n in lengths]


def trained(r) -> GatedModel:
    model = GatedModel(50, 8)
    model.train(r.integers(0, 50, 3_000).astype(np.uint16), 1, rows=16)
    return model


def test_a_long_text_has_others_beside_it():
    r = np.random.default_rng(1)
    model, steps = trained(r), []
    run = model._unrolled
    model._unrolled = lambda ids, *a, **k: (steps.append(len(ids)), run(ids, *a, **k))[1]
    model.score(texts(r, [10] * 30 + [100]), rows=4)
    assert sum(steps) == 100  # 400 places in four rows; in groups of like length 170


def test_texts_in_rows_score_as_alone():
    r = np.random.default_rng(2)
    model = trained(r)
    some = texts(r, [0, 1, 1, 300, 2, 0, 40, 41, 7, 7, 7, 90, 1, 0])
    some[6][-1], some[8][-1] = 1, 1  # some end with the end token, others do not
    alone = np.array([model.score([t])[0] if len(t) else 0.0 for t in some])
    for rows in (1, 2, 3, 5, 512):
        for steps in (1, 8):
            assert np.allclose(model.score(some, rows=rows, steps=steps), alone, rtol=1e-5, atol=1e-5)
    assert model.score([]).tolist() == [] and model.score(some[:1]).tolist() == [0.0]


def test_shut_gates_are_zero_without_warnings():
    r = np.random.default_rng(3)
    model = trained(r)
    model.p["b"] = model.p["b"] - np.array([500, 500, 0], np.float32).reshape(3, 1, 1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        states, gates = model._unrolled(np.zeros((2, 3), np.uint16), np.ones((3, 8), np.float32))
    assert (gates[:2] == 0).all() and np.isfinite(states).all()
