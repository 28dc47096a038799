"""Words that skip the tokenizer's normaliser have the ids that the whole tokenizer gives."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import words

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(tokenizer, text):
    return b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


def test_plain_words_skip_the_normaliser_and_keep_their_ids():
    tokenizer, ends = words._plain_tokenizer(PATH)
    assert tokenizer.normalizer is None
    whole, r = Tokenizer.from_file(PATH), random.Random(1)
    some = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzàçéñöøßÿ") for _ in range(r.randint(1, 12))) for _ in range(500)]
    for w in some:
        row = tokenizer.encode(w, add_special_tokens=False).ids
        assert row == whole.encode(w, add_special_tokens=False).ids
        assert [bool(ends[i]) for i in row] == [False] * (len(row) - 1) + [True]


def test_chunks_of_any_kind_match_the_whole_tokenizer():
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    texts = [
        "Plain words, Élan. ÀÉ; ÑCO&&& word### x* it's IT'S don't. 'tis o'clock' l'été, µm ªº ÷ ×2 a×b ß ẞ İ İ é é É, ẗx.",
        "foo). (bar) a.b c--d, ---- ___ e_f g_ h__! i???? j????? <|endoftext|> <| a<| <|a K Å Ω ſt ﬁ x\x01y \x01",
        "Foo foo, foo. FOO! foo​ 12 3, a1 1a a1. 中文, 中文。 Straße, straße. ÿ ŸŸ Σας ΣΑΣ",
    ]
    encode = words.word_tokenizer(PATH)
    for _ in range(2):
        assert encode(texts) == [_ids(whole, t) for t in texts]
