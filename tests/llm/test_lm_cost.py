"""Cheaper ways to the same vocabulary ids, counts and gradients."""

import numpy as np
import pyarrow as pa

from papertide.llm import lm_score
from papertide.llm.gated_lm import LONG, GatedModel


def test_words_are_looked_up_without_a_search(monkeypatch):
    r = np.random.default_rng(1)
    top = r.integers(-(1 << 63), 1 << 63, 1_022).tolist()
    words = lm_score.Vocabulary([(h, 1) for h in top], 3)
    asked = np.concatenate([np.array(top).view(np.uint64), r.integers(0, 1 << 63, 5_000).astype(np.uint64), np.zeros(1, np.uint64)])
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: 1 / 0)
    assert words.of(asked).tolist() == [*range(2, 1_024), *[lm_score.UNKNOWN] * 5_001]


def test_words_whose_bits_are_equal_are_told_apart():
    r = np.random.default_rng(2)
    first = r.integers(0, 1 << 63, 50).astype(np.uint64)
    many = r.integers(0, 1 << 63, 70_000).astype(np.uint64)  # more than places tell apart
    for hashes in (np.array([], np.uint64), first, np.repeat(many[:1], 1), many):
        words = lm_score.Vocabulary([(int(h), 1) for h in hashes.view(np.int64)], 1)
        asked = np.concatenate([hashes, ~first, hashes ^ np.uint64(1), np.array([0, 1], np.uint64)])
        ids = {int(h): i + 2 for i, h in enumerate(hashes)}
        assert words.of(asked).tolist() == [ids.get(int(h), lm_score.UNKNOWN) for h in asked]


def test_counts_over_groups(monkeypatch):
    from collections import Counter

    from papertide.llm.words import Chunk

    monkeypatch.setattr(lm_score, "CHUNK", 50)
    monkeypatch.setattr(lm_score, "COUNTED", 20)
    ids = list(range(100))
    texts = [" ".join(f"W{j * j % (3 + i)}" for j in range(i % 17)) or None for i in ids]
    found = pa.Table.from_batches(lm_score._count([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["id", "text"])])).to_pylist()
    train = [(t or "").lower() for i, t in zip(ids, texts, strict=True) if not lm_score.is_held_out(i)]
    expected = Counter(int(Chunk([w.encode()]).hashes().view(np.int64)[0]) for t in train for w in t.split())
    expected[int(lm_score._END_HASH.view(np.int64))] = len(train)
    assert {r["h"]: r["c"] for r in found} == expected and len(found) == len(expected)


def test_sums_by_id():
    r = np.random.default_rng(3)
    for n, ids in ((1, 1), (40, 400), (3_000, 60), (3_000, 700), (LONG, 1), (LONG + 1, 1)):
        where = np.minimum(r.integers(0, ids, n), r.integers(0, ids, n)).astype(np.uint16)
        rows = r.normal(size=(n, 6))
        expected = np.zeros((ids, 6))
        np.add.at(expected, where, rows)
        model = GatedModel(ids, 2)
        model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
        found, sums = model._by_id(where, rows)
        assert found.tolist() == np.unique(where).tolist() and np.allclose(sums, expected[found])


def test_a_step_of_adam_in_blocks(monkeypatch):
    from papertide.llm import gated_lm

    ids = np.random.default_rng(4).integers(0, 40, 2_000).astype(np.uint16)
    made = []
    for size in (7, 1 << 14):
        monkeypatch.setattr(gated_lm, "BLOCK", size)
        model = GatedModel(40, 8)
        losses = model.train(ids, 2, rows=16)
        made.append((losses, model.flat()))
    assert np.allclose(made[0][0], made[1][0]) and np.allclose(made[0][1], made[1][1], atol=1e-6)


def test_training_words_are_dealt_in_packed_rows(monkeypatch):
    from collections import Counter

    texts = [" ".join(f"w{(i * 7 + j * j) % 9_000}" for j in range(i % 400)) for i in range(200)]
    half = [pa.RecordBatch.from_arrays([pa.array([*range(a, a + 100)]), pa.array(texts[a : a + 100])], ["id", "text"]) for a in (0, 100)]
    words = Counter()
    for batch in lm_score._count(half):
        words.update({r["h"]: r["c"] for r in batch.to_pylist()})
    end = words.pop(int(lm_score._END_HASH.view(np.int64)))
    dealt = pa.Table.from_batches(lm_score._dealt(half)).sort_by("shard")
    assert len(words) > 4 << lm_score.DEALT and len(dealt) <= 2 << lm_score.DEALT  # a row a shard and batch, not a word
    for counted in (1 << 19, 3):
        monkeypatch.setattr(lm_score, "COUNTED", counted)
        for most in (10, 10**6):
            *top, last = pa.Table.from_batches(lm_score._commonest(most)(dealt.to_batches(max_chunksize=100))).to_pylist()
            assert [(r["h"], r["c"]) for r in top] == sorted(words.items(), key=lambda r: (-r[1], r[0]))[:most]
            assert (last["h"], last["tokens"], last["words"], last["ends"]) == (None, sum(words.values()) + end, len(words) + 1, end)
    assert list(lm_score._commonest(10)([])) == []


def test_training_takes_few_tasks_of_bounded_size():
    for shards, cores, tasks in ((1, 6, 1), (23, 6, 23), (110, 6, 24), (6_600, 6, 413), (6_600, 600, 2_400)):
        assert lm_score.training_tasks(shards, cores) == tasks and shards / tasks <= max(lm_score.SHARDS, 110 / 24)
