"""The encoder's cache of pieces, and where it cuts texts."""


def _path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_common_pieces_outlast_rare_ones():
    from papertide.llm.token_files import Encoder

    enc, asked = Encoder(_path(), pieces=40), []
    plain = enc._ids
    enc._ids = lambda shown: (asked.append(shown), plain(shown))[1]
    letters = "abcdefghijklmnopqrst"
    for a in letters:
        enc.encode(" ".join(f"common rare{a}{b}" for b in letters))
    assert asked.count("Ġcommon") == 1
    assert len(enc._after_blank) + len(enc._after_blank.old) <= 80


def test_texts_are_cut_where_the_library_does():
    import random

    from tokenizers import Tokenizer

    from papertide.llm.token_files import Encoder

    plain, enc, r = Tokenizer.from_file(_path()), Encoder(_path(), pieces=40), random.Random(5)
    parts = ["\n", "\n", " ", " ", "\n\n", "\r\n", "\t", "\x1c", "\x85", " ", "a", "Word", "don't", "it's", "'s", "12", "é", "Ünd", "二", ".", "!?", "***", "₂", "ǅ"]
    texts = ["\n", "\na", "a\n", "a\nb", "a \nb", "a\n b", "a.\nOred", "'\ns", "word " * 70 + "x" * 90]
    texts += ["".join(r.choices(parts, k=r.randrange(1, 12))) for _ in range(4_000)]
    for text in texts:
        assert enc.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text
