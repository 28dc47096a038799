"""Word-level caching over a tokenizer whose tokens never cross white space."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

#: Entries of the cache from a chunk of text to its ids. Beyond this number it becomes the older of two generations, whose
#: entries are taken over as they are met again and otherwise go; this bounds a worker's memory.
CACHED = 150_000
#: Stands between chunks that are encoded in one call; chunks that hold it are encoded alone.
_MARK = "\x01"
#: Marks that, behind a word, are parted from it in any case; not the apostrophe, which may belong to it.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Plain words: of these letters, which have one code point each in either case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: First bytes of the marks that make one character with an ASCII letter (U+0300 to U+036F), not always with its capital too.
_COMBINING = (b"\xcc", b"\xcd")
#: Normalisers and pre-tokenizers of files for which that holds, and for which a plain word, lowered, is a token's whole text.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
_SPLIT = {"type": "Split", "pattern": _PATTERN, "behavior": "Removed", "invert": True}


def _plain_tokenizer(path: str):
    """The file's model for plain words that are lowered already, with spaces between them, and if each id ends a word.

    Such words need no normaliser, which takes most of the time, and no mark between them. None for other kinds of files.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    if None in (tokenizer.normalizer, tokenizer.pre_tokenizer) or tokenizer.post_processor or not isinstance(tokenizer.model, models.BPE):
        return None
    normalizer, split = (json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    steps = split.get("pretokenizers", [])
    if normalizer.get("normalizers") != _NORMALIZER or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not (suffix := tokenizer.model.end_of_word_suffix) or tokenizer.model.dropout:
        return None
    if steps[0] != _SPLIT or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    ends = np.array([(tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(tokenizer.get_vocab_size())])
    tokenizer.encode_special_tokens = True
    tokenizer.normalizer = None
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer, ends


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit integers.

    The tokenizer turns white space into one space and drops it before it forms words, so chunks
    between white space can be encoded alone; each distinct chunk of the texts is encoded once while it is cached.
    Chunks are UTF-8, cut at ASCII white space; other white space stays in them and is the tokenizer's.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    plain = _plain_tokenizer(path)
    known: dict[bytes, bytes] = {}
    before: dict[bytes, bytes] = {}

    def ids(text: str, by: Tokenizer = tokenizer) -> np.ndarray:
        return np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    mark = ids(_MARK)
    if len(mark) != 1:
        raise ValueError("the tokenizer has no single token for the mark between chunks")

    def cut(text: str) -> list[bytes]:
        data = text.encode()
        if plain and not any(c in data for c in _COMBINING):
            data = data.lower()  # A to Z only, as the tokenizer would
        return data.split()

    def learn_plain(chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of those chunks that are a plain word with marks behind it or none."""
        by, ends = plain
        bare, split = [], []
        for c in chunks:
            if c.isalpha() and c.islower():
                bare.append(c)
                continue
            word = c.rstrip(_MARKS)
            if word.isalpha():
                split.append((c, word.lower(), c[len(word) :]))
            elif not word.isascii() and _LETTERS.fullmatch(letters := word.decode()):
                split.append((c, letters.lower().encode(), c[len(word) :]))
        found: dict[bytes, bytes] = {}
        behind = {w for _, w, _ in split}
        have = {w: data for w in behind if (data := known.get(w) or before.get(w))}
        behind.difference_update(have, bare)
        bare.extend(behind)
        for i in range(0, len(bare), 4096):
            part = bare[i : i + 4096]
            row = ids(b" ".join(part).decode(), by)
            cuts = (4 * np.flatnonzero(ends[row]) + 4).tolist()
            data = row.tobytes()
            found.update(zip(part, [data[a:b] for a, b in zip([0, *cuts], cuts)], strict=True))
        have.update(found)
        marks = {b"": b""} | learn_marked(list({t for _, _, t in split if t}))
        found.update([(c, have[w] + marks[t]) for c, w, t in split])
        return found

    def learn_marked(chunks: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        own = _MARK.encode()
        for i in range(0, len(chunks), 4096):
            part = [c for c in chunks[i : i + 4096] if own not in c]
            if part:
                row = ids((b" " + own + b" ").join(part).decode())
                cuts = [-1, *np.flatnonzero(row == mark[0]).tolist(), len(row)]
                data = row.tobytes()
                found.update(zip(part, [data[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:])], strict=True))
        found.update((c, ids(c.decode()).tobytes()) for c in chunks if own in c)
        return found

    def learn(chunks: list[bytes]) -> dict[bytes, bytes]:
        found = learn_plain(chunks) if plain else {}
        return found | learn_marked([c for c in chunks if c not in found])

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal known, before
        parts = list(map(cut, texts))
        need = set(chain.from_iterable(parts))
        if len(known) + len(need) > CACHED:
            known, before = {}, known
        new = need.difference(known)
        old = {c: before[c] for c in new if c in before}
        known.update(old)
        known.update(learn(list(new.difference(old))))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    return encode
