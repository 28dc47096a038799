import random

import numpy as np
import public_tokenizers
import tiktoken

from tessera.llm.bpe import MergeReplay, bpe_decode, bpe_encode, read_ranks, text_encoder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def _ids(text):
    return np.array(REFERENCE.encode_ordinary(text), "<u4").tobytes()


def test_odd_texts_match():
    r = random.Random(1)
    texts = ["".join(r.choice(" ab\n\x1c 'sdtelmr0-é你\t́x") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * n for n in range(80)] + ["", " ", "\n\n x", "it's we'll  'tis"]
    assert text_encoder(PATH, public_tokenizers.PATTERN)(texts) == [_ids(t) for t in texts]


def test_a_merge_that_gives_rise_to_an_earlier_one():
    # abc stands before ab, which only later merges can reach
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"ababc": 258, b"bc": 259}
    replay = MergeReplay(ranks)
    words = [b"abc", b"ababc", b"abcabc", b"aabbcc", b"bcbc", b"", b"abababc"]
    assert [np.frombuffer(x, "<u4").tolist() for x in replay.encode(words)] == [replay.one(w) for w in words]


def test_round_trip(docs_of):
    texts = [None, "", "The quick  brown fox\n\njumps", "naïve 你好 🙂" * 500, "same", "same"]
    rows = {r["doc_id"]: r for r in bpe_decode(bpe_encode(docs_of(texts), PATH, public_tokenizers.PATTERN, batch_chars=50), PATH).collect()}
    for i, t in enumerate(texts):
        assert bytes(rows[i]["ids"]) == _ids(t or "")
        assert bytes(rows[i]["decoded"]) == (t or "").encode()
    both = bpe_encode(docs_of(texts), PATH, public_tokenizers.PATTERN, decode=True).collect()
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in both} == {i: (r["ids"], r["decoded"]) for i, r in rows.items()}
    assert bpe_encode(docs_of(["x"]).where("false"), PATH, public_tokenizers.PATTERN).count() == 0
