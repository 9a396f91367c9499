"""Stages of the pipeline on repeated rows, and null ids."""

SCHEMA = "doc_id long, text string, source string, n_chars long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "h", len(t)) for i, t in docs], SCHEMA)


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    say = lambda k: " ".join(f"{k}{i}" for i in range(40))
    docs = [(1, say("a"))] * 3 + [(None, say("a")), (None, say("b")), (None, say("b")), (None, say("c")), (4, say("c")), (5, say("d")), (5, say("e"))]
    found = corpus_pipeline.near_duplicates(spark, frame(spark, docs), "")
    assert sorted(((r.doc_id, r.text[:1]) for r in found.collect()), key=str) == [(1, "a"), (4, "c"), (5, "d"), (5, "e"), (None, "b")]


def test_passages_go_from_the_rows_that_hold_them(spark):
    import brute
    import corpus_pipeline

    say = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    core = say("core", 60)
    docs = [(1, f"{say('a', 9)} {core}"), (1, f"{core} {say('b', 9)}"), (None, f"{core}\n{say('c', 9)}"), (None, say("d", 9)), (1, f"plain\n{say('e', 40)}"), (2, ""), (3, None), (4, say("f", 50_000) + f" {core}")]
    rows = spark.createDataFrame([(i, t, "h", len(t or ""), k) for k, (i, t) in enumerate(docs)], SCHEMA + ", rid int")
    found = corpus_pipeline.repeated_passages(spark, rows, "")
    assert found.columns == rows.columns
    got = {r.rid: (r.doc_id, r.text, r.n_chars) for r in found.collect()}
    kept = {0: say("a", 9), 1: say("b", 9), 2: say("c", 9), 7: say("f", 50_000)}
    assert got == {k: (i, kept.get(k, t), len(kept.get(k, t) or "")) for k, (i, t) in enumerate(docs)}
    assert brute.rows(corpus_pipeline.repeated_passages(spark, rows.limit(0), ""), "doc_id") == []


def test_stages_on_empty_tables_and_null_rows(spark):
    import corpus_pipeline

    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    for docs in ([], [(None, None), (None, None), (1, None), (2, "")]):
        rows = spark.createDataFrame([(i, t, None, 0) for i, t in docs], SCHEMA)
        assert corpus_pipeline.quality(spark, rows, "").count() == 0
        assert corpus_pipeline.repeated_passages(spark, rows, "").count() == len(docs)
        assert corpus_pipeline.near_duplicates(spark, rows, "").count() == len({*docs})
        assert corpus_pipeline.decontaminate.clean(rows, items).count() == len(docs)
        assert corpus_pipeline.encoding(spark, rows, "").count() == len(docs)
