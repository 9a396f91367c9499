"""WARC round trips, preference pairs, and the pipeline against brute force."""

import os

import brute
import pytest

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, compression):
    from papertide.llm.warc import archive_pages, read_pages

    rows = [(1, "http://a\r\nb%0D", "x" * 1200), (2, None, "x" * 1200), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (6, "é", "é" * 600), (7, "u", "é" * 600), (8, "u", "x" * 1200), (None, "u", "x" * 1200), (8, "u", "x" * 1200), (9, "u", "y\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, digest string")
    folder = archive_pages(pages, compression=compression)
    found = brute.rows(read_pages(spark, folder), "page_id", "payload_bytes", "record_type", "refers_to")
    expected = []
    for i, _, html in rows:
        same = [j for j, _, h in rows if h == html and j is not None] if len(brute.raw(html)) >= 1000 else [i]
        revisit = bool(same) and i != max(same)
        expected.append((i, len(brute.raw(html)), "revisit" if revisit else "response", max(same) if revisit else None))
    assert found == sorted(expected, key=str)
    one = spark.read.format("warc").load(folder).where("warc_type = 'revisit' and record_id = 'urn:page:1'")
    assert "Filter (" not in one._jdf.queryExecution().executedPlan().toString()
    assert [(r.target_uri, r.refers_to) for r in one.collect()] == [("http://a\r\nb%0D", "urn:page:8")]
    assert spark.read.format("warc").option("payload", "false").load(folder).where("payload is not null").count() == 0
    assert read_pages(spark, archive_pages(pages.limit(0), compression=compression)).count() == 0


def test_preference_pairs(spark):
    from papertide.llm.preference import conversations_of, format_pairs, reply_pairs

    turn = "array<struct<role string,text string>>"
    rows = [(1, [("user", "a"), ("assistant", "b<|end|>"), ("user", "c"), ("assistant", "d")], [("user", "a"), ("assistant", "X")], 0), (2, None, [("user", "a")], 0), (3, [], [], 0), (None, [("user", None)], [("user", "")], 0), (4, [("user", "a")] * 2, [("user", "a")], 0)]
    found = {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask]) for r in format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}, n int")).collect()}
    assert found[1] == (1, "<|user|>\na<|end|>\n", "<|assistant|>\nb< |end|><|end|>\n<|user|>\nc<|end|>\n<|assistant|>\nd<|end|>\n", "<|assistant|>\nX<|end|>\n", [(14, 30), (63, 71)])
    assert found[1][2][14:30] == "b< |end|><|end|>" and found[1][2][63:71] == "d<|end|>"
    assert found[2] == (0, "", "", "<|user|>\na<|end|>\n", []) and found[3] == (0, "", "", "", [])
    assert found[None][0] == 1 and found[4][0] == 1 and found[4][3] == ""
    turns = spark.createDataFrame([(1, 2, "assistant", "r"), (1, 1, "user", "q"), (2, 1, "user", "alone"), (None, None, None, None), (3, 1, "assistant", "r"), (3, 2, "assistant", "r")], "conv_id long, turn int, role string, text string")
    pairs = {r.conv_id: (r.n_prompt_turns, r.chosen, r.rejected) for r in format_pairs(reply_pairs(conversations_of(turns)), id_col="conv_id").collect()}
    assert pairs == {1: (1, "<|assistant|>\nr<|end|>\n", "<|assistant|>\nq<|end|>\n"), 3: (2, "", "")}


@here
@pytest.mark.parametrize("name", ["op8_warc", "op10_preference"])
def test_queries_against_sql(spark, name):
    import duckdb

    from papertide.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in ("pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = db.sql(ORACLE_SQL[name])
    assert brute.rows(QUERIES[name](spark, DATA), *expected.columns) == sorted(expected.fetchall(), key=str)


@here
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "decontamination", "encoding"]
    now = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = now.columns
    now = stages["quality"](spark, now, DATA)
    kept = dict(brute.rows(now, "doc_id", "text"))
    assert now.columns == columns and {*kept} <= {x[0] for x in brute.quality(docs) if not x[6]}
    assert len(kept) > 0.9 * sum(not x[6] for x in brute.quality(docs))
    groups = brute.jaccard(sorted(kept.items()))
    now = corpus_pipeline.near_duplicates(spark, now, DATA)
    kept = {i: kept[i] for i, _, c, _ in groups if i == c}
    assert now.columns == columns and dict(brute.rows(now, "doc_id", "text")) == kept
    lost = {x[0]: x for x in brute.substring(sorted(kept.items()), 35)}
    now = corpus_pipeline.repeated_passages(spark, now, DATA)
    assert now.columns == columns
    texts = dict(brute.rows(now, "doc_id", "text"))
    assert {i: len(t.encode().split()) for i, t in texts.items()} == {i: x[1] - x[2] for i, x in lost.items()}
    assert all(texts[i] == t for i, t in kept.items() if not lost[i][2])
    clean = {x[0] for x in brute.contaminated(sorted(texts.items()), items) if not x[5]}
    final = brute.rows(corpus_pipeline.run(spark, DATA), "doc_id", "decoded_sha256")
    import hashlib

    assert final == sorted([(i, hashlib.sha256(texts[i].encode()).hexdigest()) for i in clean], key=str)
