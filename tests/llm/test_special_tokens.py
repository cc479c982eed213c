"""Special tokens that a text spells out."""

import public_tokenizers

from foliotab.llm.packing import Ids


def test_spelled_special_token_is_one_id():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, own = Ids(path), Tokenizer.from_file(path)
    assert ids.ranked is not None
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "plain text"):
        assert ids(text).tolist() == own.encode(text, add_special_tokens=False).ids
    assert ids("<|endoftext|>").tolist() == [50256]
