"""Scores without shifts and biases in the logits."""

import numpy as np


def test_log_probs_against_plain_softmax():
    from papertide.llm.gated_lm import GatedModel

    def plain(model, states, targets):
        p, out = {k: v.astype(np.float64) for k, v in model.p.items()}, []
        soft = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
        for h, t in zip(states.astype(np.float64), targets.tolist(), strict=True):
            c, i = divmod(t, model.width)
            out.append(soft(h @ p["wc"] + p["bc"])[c] + soft(h @ p["ww"][c] + p["bw"][c])[i])
        return np.array(out)

    r = np.random.default_rng(3)
    for n_vocab, size, bias in ((10, 1, 1), (50, 3, 5), (50, 60, 20), (1, 1, 0)):  # the third has logits beyond the bound
        model = GatedModel(n_vocab, 6)
        for k in ("wc", "ww"):
            model.p[k] = r.normal(0, size, model.p[k].shape).astype(np.float32)
        for k in ("bc", "bw"):
            model.p[k] += r.normal(0, bias, model.p[k].shape).astype(np.float32)
        states, targets = r.uniform(-1, 1, (300, 6)).astype(np.float32), r.integers(0, n_vocab, 300)
        got, expected = model.log_probs(states, targets), plain(model, states, targets)
        assert np.abs(got - expected).max() < 1e-4 * max(1, np.abs(expected).max()), (n_vocab, size)


def test_tables_are_made_once_a_call():
    from papertide.llm.gated_lm import GatedModel

    model, made = GatedModel(20, 4), []
    plain = model._tables
    model._tables = lambda: (made.append(1), plain())[1]
    texts = [np.arange(n) % 20 for n in range(1, 200)]
    found = model.score(texts, rows=16)
    assert len(made) == 1
    alone = np.array([GatedModel(20, 4).score([t])[0] for t in texts[::40]])
    assert np.abs(found[::40] - alone).max() < 1e-3
