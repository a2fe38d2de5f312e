"""Per-worker cache from words to tokenizer ids."""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Entries that a worker keeps of words and of their parts; a cache starts anew beyond it, so memory is bounded.
CACHE_WORDS, CACHE_PARTS = 600_000, 400_000
#: Letters whose lower case is one precomposed letter, then punctuation: such words are split by rule.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-Þà-öø-ÿ]*)([.,;:!?]*)")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Parts(dict):
    """Lower-case runs of letters or of punctuation -> ids."""

    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_PARTS:
            self.clear()
        spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        out = self[part] = np.array([t.id for t in self.tokenize(spelled)], "<u4").tobytes() if part else b""
        return out


class WordTokenizer(dict):
    """Encodes whole texts with a public tokenizer, word by word; maps words (bytes) to their ids.

    Valid for tokenizers whose pre-tokenizer never lets a token cross white space and drops it, lower-cases, and parts
    letters from punctuation (``word_bpe_49k.json``): the ids of a text are those of its ASCII-space-separated words
    in turn.  Words that ``SIMPLE`` doesn't match go through the whole tokenizer.
    ``encode`` returns little-endian unsigned 32-bit ids as bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.parts = _Parts(self.whole.model)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode()
        if m := SIMPLE.fullmatch(text):
            out = self.parts[m[1].lower()] + self.parts[m[2]]
        else:
            out = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
