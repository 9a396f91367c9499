"""Operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string"
EDGES = [(None, None), (None, "x y z"), (9001, ""), (9002, " \n\t"), (9003, None), (9004, "lone")]


def clashing(df):
    """With further columns named as the operators' own."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("other") for c in ("rid", "node", "label", "h", "n_words", "words", "score", "kept", "tkey", "spans", "start", "component_id", "content")})


def corpus(seed, n, words, size):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    core = [r.choice(vocabulary) for _ in range(400)]
    docs = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, size))]
        if r.random() < 0.5:
            a = r.randrange(300)
            w[len(w) // 2 : len(w) // 2] = core[a : a + r.randint(5, 80)]
        if r.random() < 0.1:
            w += ["a", "b", "c"] * r.randint(5, 40)
        docs.append((i, r.choice([" ", "\n", "  "]).join(w)))
    return docs + EDGES + [docs[3], docs[3], (7000, docs[5][1]), (7001, " ".join(core * 30))]


@pytest.mark.parametrize(("hot", "k", "m"), [(5_000, 35, 8), (2, 35, 8), (2, 10, 4)])
def test_substring_dedup(spark, hot, k, m):
    from papertide.llm.substring_dedup import remove_repeated

    docs = corpus(1, 150, 60, 90)
    found = remove_repeated(clashing(spark.createDataFrame(docs, SCHEMA)), window=k, minimiser=m, hot=hot)
    assert brute.rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(docs, k)


def test_windows_with_equal_hashes_are_compared(monkeypatch):
    from papertide.llm import substring_dedup as s

    monkeypatch.setattr(s, "windows", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    _, found = s.repeated_windows([b"a b c", b"x y z", b"a  b\nc", b"b c d"], 3)
    assert found.tolist() == [0, 6]


def near_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(3000)]
    line = [r.choice(vocabulary) for _ in range(30)]
    docs = [(i, [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 8, 20, 40, 100, 300, 900]))] + (line if r.random() < 0.4 else [])) for i in range(100)]
    for i in range(200):
        b = list(r.choice(docs)[1])
        for _ in range(r.randint(0, max(1, len(b) // 45))):
            if b:
                b[r.randrange(len(b))] = r.choice(vocabulary)
        docs.append((1000 + i, b))
    docs = [(i, " ".join(w)) for i, w in docs]
    return docs + EDGES + [(None, docs[9][1]), docs[3], docs[3]]


@pytest.mark.parametrize("options", [{}, {"block_nodes": 3, "broadcast_nodes": 0}, {"exact": True}])
def test_jaccard_join(spark, options):
    from papertide.llm.jaccard_join import similar

    docs = near_copies(7)
    found = similar(clashing(spark.createDataFrame(docs, SCHEMA)), **options)
    assert brute.rows(found, "doc_id", "n_shingles", "component_id", "n_links") == brute.jaccard(docs)


def test_prefix_tree_finds_every_match():
    from papertide.llm.jaccard_join import PrefixTree, error_bound

    r = random.Random(2)
    sets = [np.array(sorted(r.sample(range(40), r.randint(1, 30))), np.int32) for _ in range(300)]
    sets += [np.sort(np.array(list({*s.tolist()} - {int(s[0])} or {1}), np.int32)) for s in sets[:100]]
    tree, sizes, plain = PrefixTree(sets), [len(s) for s in sets], [{*s.tolist()} for s in sets]
    for i, x in enumerate(sets):
        mask = np.zeros(41, bool)
        mask[x] = True
        assert sorted(tree.matches(x, mask, 80, 100, sizes)) == [j for j, y in enumerate(plain) if 100 * len(plain[i] & y) >= 80 * len(plain[i] | y)]
    assert error_bound(0.8) < 1e-12


def test_components_of_long_chains_and_stars(spark):
    from papertide.llm.components import components

    links = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (2000, 2001), (2001, 2000)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)} | {2000: 2000, 2001: 2000}


@pytest.mark.parametrize("block", [20_000, 7])
def test_decontamination(spark, block):
    from papertide.llm.decontaminate import clean, contamination

    r = random.Random(3)
    vocabulary = [*(f"A{i}" for i in range(12)), "é", "É", "x"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 8, 9, 12])))) for i in range(40)] + [(None, "zz A1"), (3, "q " * 11), (99, None)]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) + " " + (r.choice(items)[1] or "")) for i in range(150)]
    docs += [*EDGES, (None, "zz a1"), docs[5], docs[5], (2, "q " * 3000)]
    a, b = clashing(spark.createDataFrame(docs, SCHEMA)), spark.createDataFrame(items, "item_id long, text string")
    expected = brute.contaminated(docs, items)
    assert brute.rows(contamination(a, b, block=block), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    kept = clean(a, b, block=block)
    assert kept.columns == a.columns
    assert sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted(str(x[0]) for x in expected if not x[5])


def test_licence_scan(spark):
    from papertide.llm.license_scan import BASE, FURTHER, scan

    r = random.Random(4)
    vocabulary = "gnu general public license apache cc by mit version 2 3 0 sa nc lesser the é GNU License".split()
    docs = [(i, r.choice([" ", ", ", "-"]).join(r.choice(vocabulary) for _ in range(r.randint(0, 80)))) for i in range(200)]
    docs += [*EDGES, (500, "license " * 3000), (501, FURTHER[10].text.title()), docs[8], docs[8], (502, "cc by cc by")]
    found = brute.rows(scan(clashing(spark.createDataFrame(docs, SCHEMA))), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for got, (expected, labels) in zip(found, brute.licences(docs, BASE + FURTHER), strict=True):
        assert got[:6] == expected
        assert labels <= {*got[6].split(",")}
        assert got[7] == 1 if labels else 0 <= got[7] < 1


def test_quality_rules(spark):
    from papertide.llm.quality_rules import filtered, verdicts

    docs = corpus(5, 120, 500, 120)
    docs = [(i, f"{t}\n# <shared> line here\n{t[:20]}\n{t[:20]}" if t and i and i % 3 == 0 else t) for i, t in docs] + [(8000, "Menu of the site\n" * 3 + "a few words"), (8001, "\n".join(["Menu of THE  site"] * 30))]
    df = spark.createDataFrame([(i, t, None if i is None else f"h{i % 2}", len(t or "")) for i, t in docs], "doc_id long, text string, source string, n_chars long")
    found = verdicts(clashing(df), min_docs=5)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert brute.rows(found, *names) == brute.quality(docs)
    # Lines above the limit, by brute force.
    texts, hosts = {}, {}
    for i, t in docs:
        host = None if i is None else i % 2
        hosts.setdefault(host, set()).add(t or "")
        for line in (t or "").split("\n"):
            if line.split():
                texts.setdefault((host, " ".join(line.lower().split())), set()).add(t)
    common = {k for k, d in texts.items() if len(d) >= 5 and len(d) > 0.01 * len(hosts[k[0]])}
    assert common
    lost = {(i, t): sum(len(x.split()) for x in (t or "").split("\n") if (None if i is None else i % 2, " ".join(x.lower().split())) in common) for i, t in docs}
    assert brute.rows(found, "doc_id", "n_common_words") == sorted([(i, lost[i, t]) for i, t in docs], key=str)
    failed = {x[0]: x[6] for x in brute.quality(docs)}
    keep = [(i, t) for i, t in docs if not failed[i] and lost[i, t] <= 0.5 * len((t or "").split())]
    out = filtered(clashing(df), min_docs=5)
    assert out.columns == clashing(df).columns
    shown = lambda i, t: "\n".join(x for x in t.split("\n") if (None if i is None else i % 2, " ".join(x.lower().split())) not in common)
    assert brute.rows(out, "doc_id", "text", "n_chars") == sorted([(i, shown(i, t), len(shown(i, t))) for i, t in keep], key=str)


def test_bpe(spark):
    from papertide.llm.bpe import encode_decode, encoding, safe_pieces

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = encoding(ranks, public_tokenizers.PATTERN)
    r = random.Random(6)
    docs = [(i, "".join(r.choice(["a", "b'", "'s", "  ", " ", "\n", "é", "漢", "1", "!", " I'll", "<|endoftext|>", "　"]) for _ in range(r.randint(0, 300)))) for i in range(60)] + EDGES + [(5, "x" * 5000), (5, "x" * 5000)]
    found = {}
    for piece in (7, 65_536):
        found[piece] = encode_decode(clashing(spark.createDataFrame(docs, SCHEMA)), ranks, public_tokenizers.PATTERN, piece_chars=piece)
        expected = sorted([(i, len(x := enc.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(brute.raw(t)).hexdigest()) for i, t in docs], key=str)
        assert brute.rows(found[piece], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert all("".join(safe_pieces(t, 5)) == t for _, t in docs if t)


def test_token_files(spark):
    import pyarrow as pa

    from papertide.llm.token_files import Encoder, TokenReader, TokenWriter, read_files, write_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = Encoder(path, pieces=50)
    plain = enc.tokenizer
    plain.encode_special_tokens = True
    r = random.Random(7)
    texts = ["".join(r.choice(["a", "Bc", "b'", "'s", "  ", ".", ",", " ", "\n", "\t", "é", "ɐ", "漢", "1", "23", "!", " ", "\x1c", "　", " I'll", "<|endoftext|>"]) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    assert all(enc.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids for t in texts)
    for bits in (5, 16, 17):
        out, parts = pa.BufferOutputStream(), [np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint32) for n in (3, 0, 50, 1, 7, 200)]
        writer = TokenWriter(out, bits, 7)
        for k, x in enumerate(parts):
            writer.add(k, x)
        writer.close(pa.int64())
        reader, whole = TokenReader(pa.BufferReader(out.getvalue())), np.concatenate(parts)
        assert all((reader.ids(i, j) == whole[i:j]).all() for i in range(0, 261, 13) for j in range(i, 262, 11))
    docs = [(i * 7 % 64, t) for i, t in enumerate(texts[:64])] + [(None, None), (100, "")]
    found = [tuple(x) for x in read_files(write_files(clashing(spark.createDataFrame(docs, SCHEMA).repartition(3)), path)).orderBy("start").collect()]
    expected, at = [], 0
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == expected


def test_lm_scores(spark):
    from papertide.llm.lm_score import score

    docs = corpus(8, 150, 300, 60)
    found = brute.rows(score(clashing(spark.createDataFrame(docs, SCHEMA)), vocabulary=64), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    expected = brute.base_scores(docs)
    assert [x[:5] for x in found] == [x[:5] for x in expected]
    assert all(abs(x[5] - y[5]) < 1e-6 * max(1, abs(y[5])) for x, y in zip(found, expected, strict=True))
    held = [x for x in found if x[1]]
    assert sum(x[6] for x in held) > sum(x[5] for x in held)  # the model beats single counts on texts it did not see
    alone = {x[0]: x[6] for x in brute.rows(score(spark.createDataFrame(docs, SCHEMA).repartition(7), vocabulary=64), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
    assert all(abs(alone[x[0]] - x[6]) < 1e-3 for x in found if x[0] not in (None, 3))


def test_gradients_and_normalisation():
    from papertide.llm.gated_lm import GatedModel

    model = GatedModel(10, 4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(1)
    x, y, h = r.integers(0, 10, (5, 3)), r.integers(0, 10, (5, 3)), np.zeros((3, 4))
    _, grads, _ = model._window(x, y, h)
    for name, v in model.p.items():
        for i in np.ndindex(*(min(2, n) for n in v.shape)):
            if abs(v[i]) > 1e8:
                continue
            kept = v[i]
            v[i] = kept + 1e-5
            up = model._window(x, y, h)[0]
            v[i] = kept - 1e-5
            down = model._window(x, y, h)[0]
            v[i] = kept
            assert abs((up - down) / 2e-5 / x.size - grads[name][i]) < 1e-4
    state = r.normal(size=(1, 4))
    assert abs(np.exp(model.log_probs(np.repeat(state, 10, 0), np.arange(10))).sum() - 1) < 1e-9


def test_empty_tables(spark):
    from papertide.llm import bpe, decontaminate, jaccard_join, license_scan, lm_score, quality_rules, substring_dedup, token_files

    docs, items = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long"), spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path
    found = [
        substring_dedup.remove_repeated(docs), bpe.encode_decode(docs, path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), license_scan.scan(docs), jaccard_join.similar(docs), decontaminate.contamination(docs, items),
        lm_score.score(docs), token_files.read_files(token_files.write_files(docs, path("byte_bpe_50k.json"))), quality_rules.verdicts(docs), quality_rules.filtered(docs),
    ]
    assert all(df.count() == 0 for df in found)
    one = spark.createDataFrame([(1, "a b c d e f g h i")], SCHEMA)
    assert decontaminate.contamination(one, items).first().n_items == 0
