"""The near-duplicate join's Python steps hold a bounded part of what a batch or a cluster has."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from papertide.llm import jaccard_join


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sets_of_a_large_batch_are_listed_in_pieces():
    r = random.Random(5)
    texts = [" ".join(str(r.randrange(1 << 30)) for _ in range(400)) for _ in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    some = batch.slice(0, 100)
    run = jaccard_join._list_sets(5, 64)
    list(run(iter([some])))  # tables of powers are made
    rows: list[int] = []
    assert batch.nbytes > 7_000_000
    assert peak(lambda: rows.extend(b.num_rows for b in run(iter([batch])))) < 24_000_000
    assert sum(rows) == len(texts)
    parts = [b for _, b in zip(range(100), (row for b in run(iter([batch])) for row in b.to_pylist()))]
    assert parts == [row for b in run(iter([some])) for row in b.to_pylist()]


def test_pieces_of_null_empty_and_long_texts():
    texts = ["ab", None, "", "x" * 25, "cd", "é" * 4, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = list(jaccard_join.pieces(iter([batch, batch.slice(3, 2), batch.slice(0, 0)]), "text", 10))
    whole = [(t or "").encode() for t in texts]
    assert [t for _, t in found] == [whole[:3], whole[3:4], whole[4:6], whole[6:], whole[3:4], whole[4:5]]
    assert [p.column(0).to_pylist() for p, _ in found] == [[0, 1, 2], [3], [4, 5], [6], [3], [4]]


def test_a_cluster_takes_a_few_times_its_sets():
    r = np.random.default_rng(3)
    core = r.integers(0, 1 << 63, 9_500, np.uint64)
    sets = [np.unique(np.concatenate([core, r.integers(0, 1 << 63, 500, np.uint64)])) for _ in range(60)]
    elements = sum(map(len, sets))
    found: list = []
    assert peak(lambda: found.append(jaccard_join.join_cluster(sets, None, [1] * len(sets), 80, 100))) < 30 * elements
    assert found == [([0] * 60, [59] * 60)]


def test_a_cluster_does_not_hold_its_texts():
    r = random.Random(6)
    core = [str(r.randrange(1 << 60)) for _ in range(300)]
    texts = [" ".join([*core, str(i)]) for i in range(1_500)]
    kinds = [("label", pa.binary()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.binary()), ("copies", pa.int64()), ("text", pa.string())]
    rows = [{"label": b"l" if i < 1_499 else b"m", "i": 0, "j": 0, "side": 0, "node": i.to_bytes(2, "big"), "copies": 1, "text": t} for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
    del rows
    held: list[int] = []

    def seen(sets, side, copies, num, den):
        held.append((len(sets), tracemalloc.get_traced_memory()[0]))
        return list(range(len(sets))), [0] * len(sets)

    join, jaccard_join.join_cluster = jaccard_join.join_cluster, seen
    try:
        peak(lambda: list(jaccard_join._join_clusters(5, 80, 100)(iter([batch, batch.slice(1_499)]))))
    finally:
        jaccard_join.join_cluster = join
    assert [n for n, _ in held] == [1_499, 1]
    assert held[0][1] < batch.nbytes  # the sets are 8 bytes an element, the texts 20
