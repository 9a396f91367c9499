"""Texts that hold the content of an added token."""


def test_added_tokens_as_by_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from papertide.llm.token_files import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, enc = Tokenizer.from_file(path), Encoder(path, added=True)
    for text in ("<|endoftext|>", "a <|endoftext|>b  c", "plain words", ""):
        assert enc.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
