"""The language model learns from all training documents."""


def test_all_training_documents_are_learned(spark):
    from papertide.llm.lm_score import is_held_out, score

    # Two long texts of different words: a prefix of the training stream holds one of them at most.
    say = lambda kind, n: " ".join(f"{kind}{i % 8}" for i in range(n))
    train, held = [i for i in range(100) if not is_held_out(i)], [i for i in range(100) if is_held_out(i)]
    docs = [(train[0], say("a", 210_000)), (train[1], say("b", 210_000)), (held[0], say("a", 200)), (held[1], say("b", 200))]
    found = {r.doc_id: r.score / r.n_tokens for r in score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[held[0]] > -0.3 and found[held[1]] > -0.3


def test_streams_hold_every_training_token(spark):
    import numpy as np

    from papertide.llm.lm_score import Vocabulary, is_held_out, training_streams

    docs = [(i, "x " * (i * 37 % 50)) for i in range(300)] + [(None, None), (3, "y"), (3, "y")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    streams = training_streams(rows, Vocabulary([], 1), 3, 4).collect()
    sizes = sum(len(np.frombuffer(r.stream, np.uint16)) for r in streams)
    assert sizes == sum(len((t or "").split()) + 1 for i, t in docs if not is_held_out(i))
    assert len({(r.round, r.shard) for r in streams}) == len(streams) > 6


def test_training_leaves_no_token_out():
    import numpy as np

    from papertide.llm.gated_lm import GatedModel

    seen, model = [], GatedModel(64, 4)
    plain = model._window
    model._window = lambda x, y, h: (seen.append(y.copy()), plain(x, y, h))[1]
    model.train(np.arange(45), 1, rows=8)
    assert {*np.concatenate([y.reshape(-1) for y in seen]).tolist()} == {*range(1, 45)}


def test_scores_against_plain_steps(spark, monkeypatch):
    """Each text alone, a word at a time, with the weights that the operator trained."""
    import math
    from collections import Counter

    import numpy as np

    from papertide.llm import lm_score

    kept = []
    plain = lm_score.trained
    monkeypatch.setattr(lm_score, "trained", lambda rows, words, *a, **k: kept.append((plain(rows, words, *a, **k), words)) or kept[-1][0])
    docs = [(i, " ".join(f"W{(i * j * j + j) % (3 + i % 90)}" for j in range(i * 13 % 150))) for i in range(120)] + [(500, "rare " * 3 + "w1 " * 900), (501, None), (501, None)]
    found = lm_score.score(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary=20).collect()
    model, words = kept[0]
    split = lambda t: (t or "").lower().split()
    count = Counter(w for i, t in docs if not lm_score.is_held_out(i) for w in split(t))
    from papertide.llm.words import Chunk

    ids_of = lambda t: words.of(Chunk([(t or "").lower().encode()]).hashes()).tolist()
    in_vocabulary = {w for w in count if ids_of(w) != [0]}
    rest = {w: c for w, c in count.items() if w not in in_vocabulary}
    price = lambda w: math.log10((rest.get(w, 0) + 1) / (sum(rest.values()) + len(rest) + 1))
    p, n = {k: v.astype(np.float64) for k, v in model.p.items()}, model.hidden
    logistic = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def by_hand(t):
        h, before, total = np.zeros(n), 1, 0.0
        for i in [*ids_of(t), 1]:
            x = p["win"][:, before] + p["b"][:, 0]
            z, r = (logistic(x[k] + h @ p["u"][k]) for k in (0, 1))
            h = z * h + (1 - z) * np.tanh(x[2] + r * (h @ p["u"][2]))
            c, within = divmod(i, model.width)
            total += math.log10(softmax(h @ p["wc"] + p["bc"])[c] * softmax(h @ p["ww"][c] + p["bw"][c])[within])
            before = i
        return total + sum(price(w) for w in split(t) if w not in in_vocabulary)

    expected = sorted((i, by_hand(t)) for i, t in docs)
    got = sorted((r.doc_id, r.score) for r in found)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 * max(1, abs(b[1])) for a, b in zip(got, expected, strict=True))
