"""The Python steps of substring dedup and quality rules hold a bounded part of what a batch has."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from papertide.llm import quality_rules, substring_dedup

K, M = 35, 8
TEXTS = 2_500


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def table() -> pa.RecordBatch:
    """Texts of 3.5 kB, each with a passage that another has too and one that all have."""
    r = random.Random(7)
    words = lambda n: " ".join(str(r.randrange(1 << 30)) for _ in range(n))
    every, some = words(40), [words(40) for _ in range(TEXTS // 2)]
    texts = [" ".join([words(150), some[i // 2], words(100), every]) for i in range(TEXTS)]
    rids = [i.to_bytes(16, "big") for i in range(TEXTS)]
    kinds = [("rid", pa.binary()), ("doc_id", pa.int64()), ("text", pa.string()), ("host", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.binary()), pa.array(range(TEXTS)), pa.array(texts), pa.array(["h"] * TEXTS)], schema=pa.schema(kinds))


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def wanted(batch: pa.RecordBatch, hot: bool) -> pa.RecordBatch:
    sizes = pa.Table.from_batches(substring_dedup._routes(K, M)(iter([batch]))).column("routes").to_pylist()
    each = [[{"ord": i, "hot": hot} for i in range(len(x))] for x in sizes]
    return with_column(batch, "wanted", pa.array(each, pa.list_(pa.struct([("ord", pa.int32()), ("hot", pa.bool_())]))))


def covered(packed: list[pa.RecordBatch]) -> tuple[int, set]:
    """The peak of counting, and the covered places."""
    batch = pa.Table.from_batches(packed).sort_by("route").combine_chunks().to_batches()[0]
    run = substring_dedup._count(K)
    found = {(x["rid"], p) for b in run(iter([batch])) for x in b.to_pylist() for p in range(x["start"], x["stop"])}
    return peak(lambda: [b.num_rows for b in run(iter([batch]))]), found


def test_a_large_batch_is_taken_in_pieces(table):
    spans = [[{"start": 3, "stop": 50}] if i % 2 else None for i in range(TEXTS)]
    stripped = with_column(table, "spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))))
    steps = {"routes": (substring_dedup._routes(K, M), table), "pack": (substring_dedup._pack(K, M), wanted(table, False)), "strip": (substring_dedup._strip("doc_id"), stripped), "quality": (quality_rules._read, table)}
    assert table.nbytes > 8_000_000
    for name, (run, batch) in steps.items():
        few = [row for b in run(iter([batch.slice(0, 100)])) for row in b.to_pylist()]
        sizes: list[int] = []
        most = peak(lambda: sizes.extend(b.nbytes for b in run(iter([batch]))))  # noqa: B023
        assert most < 26_000_000 and max(sizes) < 2_000_000, (name, most, max(sizes))
        whole = [row for b in run(iter([batch])) for row in b.to_pylist()]
        assert [x for x in whole if x["rid"] < table["rid"][100].as_py()] == few, name


def test_buckets_are_counted_in_pieces(table):
    half = table.slice(0, TEXTS // 2)
    most, found = covered(list(substring_dedup._pack(K, M)(iter([wanted(half, False)]))))
    rows = range(half.num_rows)
    assert found == {(half["rid"][i].as_py(), p) for i in rows for p in [*range(150, 190), *range(290, 330)]}
    assert most < 26_000_000


@pytest.mark.parametrize("places", [1, 3_000, 50_000])
def test_windows_of_hot_buckets_are_combined_over_pieces(table, places, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PLACES", places)
    monkeypatch.setattr(substring_dedup, "pieces", lambda batches, text, f=substring_dedup.pieces: f(batches, text, 20_000))
    some = table.slice(0, 120)
    packed = list(substring_dedup._pack(K, M)(iter([wanted(some, True)])))
    _, found = covered(packed)
    assert found == {(some["rid"][i].as_py(), p) for i in range(120) for p in [*range(150, 190), *range(290, 330)]}
    shared = sum(x["kind"] == substring_dedup._REPEATED for b in packed for x in b.to_pylist())
    if places == 50_000:
        assert shared == 6 * 60 + 6  # each repeated window once
